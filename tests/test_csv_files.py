import random

import pytest
from pyspark.sql import functions as F

from tallyflow import operators as ops
from tallyflow.session import prepare
from tallyflow.sources import csv_files
from tallyflow.sources.discovery import discover, list_files, literal_path, pending

HEADER = "timestamp,price,user_id"


def read(spark, tmp_path, multi_line=False, broadcast_limit=1000):
    prepare(spark)
    paths = [literal_path(r["path"]) for r in list_files(spark, str(tmp_path)).collect()]
    stored = str(tmp_path / "blocks")
    csv_files.survey_blocks(csv_files.line_scan(spark, paths)).write.parquet(stored)
    blocks = spark.read.parquet(stored)
    layout = csv_files.read_layout(blocks)
    if multi_line:
        records = str(tmp_path / "records")
        csv_files.survey_records(spark, paths, blocks, layout.width).write.parquet(records)
        blocks = spark.read.parquet(records)
    return csv_files.read_source_rows(
        spark, paths, blocks, layout, multi_line, broadcast_limit
    )


def contents(df):
    out = {}
    for r in df.orderBy("file_name", "ordinal").collect():
        out.setdefault(r["file_name"], []).append(
            (r["ordinal"], r["ts_raw"], r["price_raw"], r["user_raw"], r["too_long"])
        )
    return out


def test_columns_are_found_by_name_in_each_file(spark, tmp_path):
    files = {
        "plain.csv": f"{HEADER}\nd,1,2\n",
        "reordered.csv": "user_id,timestamp,price\n2,d,1\n",
        "extra.csv": "note,price,a,timestamp,b,user_id\nx,1,y,d,z,2\n",
        "twice.csv": "price,price,timestamp,user_id\n1,9,d,2\n",
        "quoted.csv": '"price","timestamp",user_id,"a,b"\n1,d,2,"p,q"\n',
        "inches.csv": '"a ""b"", c",,"price","timestamp",user_id,\nx,,1,d,2,y\n',
        "blank.csv": f"\n  \n{HEADER}\n\nd,1,2\n\n",
        "crlf.csv": f"{HEADER}\r\nd,1,2\r\n",
        "unended.csv": f"{HEADER}\nd,1,2",
        "sp ace+%25[x]{y}.csv": f"{HEADER}\nd,1,2\n",
    }
    for name, text in files.items():
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "bom.csv").write_bytes(b"\xef\xbb\xbf" + f"{HEADER}\nd,1,2\n".encode())
    (tmp_path / "header-only.csv").write_text(HEADER + "\n")
    expected = {name: [(0, "d", "1", "2", False)] for name in [*files, "bom.csv"]}
    assert contents(read(spark, tmp_path)) == expected


def test_short_and_long_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text(f"{HEADER}\nd\nd,1\nd,1,2,9\nd,1,2,\nd,\"1,\"\"x\",2\nd,1,2,,junk\nd,1,2,\"\"\n")
    # A wider neighbour must not hide that a row of the narrow file is too long.
    (tmp_path / "wide.csv").write_text(f"a,b,c,{HEADER}\n1,2,3,d,4,5\n1,2,3,d,4,5,6\n")
    assert contents(read(spark, tmp_path)) == {
        "a.csv": [
            (0, "d", None, None, False),
            (1, "d", "1", None, False),
            (2, "d", "1", "2", True),
            (3, "d", "1", "2", True),
            (4, "d", '1,"x', "2", False),
            (5, "d", "1", "2", True),
            (6, "d", "1", "2", True),
        ],
        "wide.csv": [(0, "d", "4", "5", False), (1, "d", "4", "5", True)],
    }


def test_header_names_as_the_csv_reader_splits_them(spark):
    # One line, and the names in it; an empty name is None.
    headers = {
        "a": ["a"],
        "a,b,": ["a", "b", None],
        ",": [None, None],
        '"a,b",c': ["a,b", "c"],
        '"a ""b""",c': ['a "b"', "c"],
        " a, b ": [" a", " b "],
        'a,"b': ["a", '"b'],
        ",".join(f"c{i}" for i in range(2000)): [f"c{i}" for i in range(2000)],
    }
    lines = spark.createDataFrame([(line,) for line in [*headers, None]], "line string")
    most = csv_files.most_fields(lines, "line")
    names = lines.select("line", csv_files.header_columns(F.col("line"), most).alias("names"))
    got = {r["line"]: r["names"] for r in names.collect()}
    assert most == 2000
    assert got.pop(None) is None
    got['a,"b'][1] = '"' + got['a,"b'][1].lstrip('"')
    assert got == headers


@pytest.mark.parametrize("broadcast_limit", [1000, 0])
def test_positions_over_many_small_splits(spark, tmp_path, broadcast_limit):
    rng = random.Random(5)
    sizes = {"a.csv": 1500, "b.csv": 3, "hot.csv": 4000, "z.csv": 40}
    for name, n in sizes.items():
        lines = [f"d,{i},{'7' * rng.randint(1, 9)}" + "\n" * rng.choice([1, 1, 1, 2]) for i in range(n)]
        (tmp_path / name).write_text(HEADER + "\n" + "".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        rows = read(spark, tmp_path, broadcast_limit=broadcast_limit)
        wrong = rows.where(F.col("ordinal").cast("string") != F.col("price_raw")).count()
        counts = {r["file_name"]: r["count"] for r in rows.groupBy("file_name").count().collect()}
        splits = spark.read.parquet(str(tmp_path / "blocks")).count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert splits > 20
    assert wrong == 0
    assert counts == sizes


def test_a_survey_of_other_splits_is_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEADER + "\n" + "d,1,2\n" * 500)
    rows = read(spark, tmp_path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        with pytest.raises(Exception, match="differs from its survey"):
            rows.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_quoted_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text(f'note,{HEADER}\n"two\nlines",d,1,2\nx,d,3,4\n')
    (tmp_path / "b.csv").write_text(f"{HEADER}\nd,5,6\n")
    expected = {
        "a.csv": [(0, "d", "1", "2", False), (1, "d", "3", "4", False)],
        "b.csv": [(0, "d", "5", "6", False)],
    }
    assert contents(read(spark, tmp_path, multi_line=True)) == expected
    paths = [str(tmp_path / name) for name in expected]
    assert contents(csv_files.open_source(spark, paths, multi_line=True)) == expected


def test_chunked_reading_without_an_ingest(spark, tmp_path):
    path = tmp_path / "transactions.csv"
    path.write_text(HEADER + "\n1/1/2026,10,1\n1/2/2026,,2\n1/3/2026,30,3\n")
    chunks = ops.assign_chunks(csv_files.open_source(spark, [str(path)]), 2)
    good, bad = ops.split_valid_rejected(ops.coerce_rows(chunks))
    seen = [(r["chunk_index"], r["price"]) for r in good.orderBy("ordinal").collect()]
    assert seen == [(1, 10.0), (2, 30.0)]
    assert [(r["chunk_index"], r["user_id"]) for r in bad.collect()] == [(1, 2)]
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    with pytest.raises(csv_files.ColumnContractError):
        csv_files.open_source(spark, [str(tmp_path / "bad.csv")])


def test_contract_names_missing_columns(spark, tmp_path):
    files = {
        "ok.csv": (HEADER, None),
        "case.csv": ("timestamp,Price,user_id", ["price"]),
        "padded.csv": ("timestamp, price,user_id", ["price"]),
        "two.csv": ("price,other", ["timestamp", "user_id"]),
        "mention.csv": ("timestamp_price_user_id,x", ["price", "timestamp", "user_id"]),
        "blank.csv": ("\n", ["price", "timestamp", "user_id"]),
        "one.csv": ("x", ["price", "timestamp", "user_id"]),
    }
    for name, (header, _) in files.items():
        (tmp_path / name).write_text(header + "\n")
    # The names appear in a row, not in the header.
    (tmp_path / "later.csv").write_text(f"a,b,c\n{HEADER}\n")
    files["later.csv"] = ("a,b,c", ["price", "timestamp", "user_id"])
    listed = list_files(spark, str(tmp_path))
    paths = [r["path"] for r in listed.collect()]
    blocks = csv_files.survey_blocks(csv_files.line_scan(spark, paths))
    broken = csv_files.broken_files(listed, blocks)
    explained = csv_files.with_missing(spark, broken, paths).collect()
    got = {r["file_name"]: r["missing"] for r in explained}
    layout = csv_files.read_layout(blocks)
    # A file of blank lines has no block at all.
    assert (layout.file_count, layout.broken_count) == (len(files) - 1, len(got) - 1)
    assert got == {name: missing for name, (_, missing) in files.items() if missing}


def test_discovery(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        discover(spark, str(tmp_path))
    (tmp_path / "validation.csv").write_text(HEADER)
    with pytest.raises(FileNotFoundError):
        discover(spark, str(tmp_path))
    (tmp_path / "b.csv").write_text(HEADER)
    (tmp_path / "a.csv").write_text(HEADER)
    (tmp_path / "c.txt").write_text(HEADER)
    (tmp_path / "nested").mkdir()
    (tmp_path / "nested" / "d.csv").write_text(HEADER)
    assert [r["file_name"] for r in discover(spark, str(tmp_path)).collect()] == ["a.csv", "b.csv"]
    everything = discover(spark, str(tmp_path), include_validation=True)
    assert everything.count() == 3
    done = spark.createDataFrame([("a.csv",)], "file_name string")
    assert [r["file_name"] for r in pending(discover(spark, str(tmp_path)), done).collect()] == ["b.csv"]
    with pytest.raises(FileNotFoundError):
        discover(spark, str(tmp_path / "absent"))
