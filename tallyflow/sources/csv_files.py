"""CSV files as raw text rows with their position, read without shuffling them.

Two passes over the same file splits. The first reduces every split to one line of
``blocks``: how many rows it holds, the id its first row carried, and the header line
if it begins a file. The second joins that small table back, which turns the per-task
row id into a position in the file and tells which field holds which column.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyflow.functions.text import batch_id_ends, decoded_path, file_name_of
from tallyflow.schemas import REQUIRED_COLUMNS
from tallyflow.session import broadcast_if_at_most, prepare, shared_dir, written

# The doubled quote is the escape, as in RFC 4180.
_CSV_OPTIONS = {"mode": "PERMISSIVE", "quote": '"', "escape": '"'}

# A separator no line contains and no quoting: one column holds the line. Reading it
# with the same reader as the fields makes both passes agree on what a row is.
_LINE_OPTIONS = {"mode": "PERMISSIVE", "sep": "\u0001", "quote": ""}

# Rows with more or fewer fields than the widest header are kept whole in a column of
# their own. That needs all fields of a row to be split, also those not asked for.
_ODD_ROW, _MARK = "_odd_row", "\u0001end"
_ODD_ROWS = {"columnNameOfCorruptRecord": _ODD_ROW, "columnPruning": "false"}

BROADCAST_BLOCK_LIMIT = 200_000


class ColumnContractError(ValueError):
    """A source file lacks required columns."""


@dataclass(frozen=True)
class Layout:
    """What the headers of a set of files have in common: a few numbers, kept on the driver."""

    block_count: int
    file_count: int
    broken_count: int
    # 1-based field numbers under which each required column occurs.
    positions: dict[str, list[int]]
    header_widths: list[int]
    # No header has more fields; unlike ``width`` also of those in broken files.
    most_fields: int

    @property
    def width(self) -> int:
        return max(self.header_widths, default=1)


def _positioned(scan: DataFrame, *columns) -> DataFrame:
    """Adds the split a row came from and ``mid``, which grows by one per row of a split."""
    return scan.select(
        *columns,
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block_start"),
    ).withColumn("mid", F.monotonically_increasing_id())


def line_scan(spark: SparkSession, paths) -> DataFrame:
    """Non-blank lines as ``value``."""
    scan = spark.read.options(**_LINE_OPTIONS).schema("value string").csv(list(paths))
    return _positioned(scan, "value")


def record_scan(spark: SparkSession, paths, width: int, multi_line: bool = False) -> DataFrame:
    """Records, header included, as ``c0, c1, ...``; a file is one split if they span lines."""
    names = _positional_names(width)
    scan = (
        spark.read.options(**_CSV_OPTIONS, **_ODD_ROWS, multiLine=multi_line)
        .schema(", ".join(f"{name} string" for name in [*names, _ODD_ROW]))
        .csv(list(paths))
    )
    return _positioned(scan, *names, _ODD_ROW)


def survey_blocks(lines: DataFrame, required=REQUIRED_COLUMNS) -> DataFrame:
    """One row per file split: ``file_path, block_start, block_rows, first_mid, header_line``.

    ``header_line`` is the first line of a file if it mentions every required name;
    elsewhere it is NULL. Candidates are filtered before they are collected, and a
    group never exceeds one split.
    """
    may_be_header = F.col("block_start") == 0
    for name in required:
        may_be_header = may_be_header & F.col("value").contains(name)
    candidate = F.when(may_be_header, F.struct("mid", "value"))
    return (
        lines.groupBy("file_path", "block_start")
        .agg(
            F.count("*").alias("block_rows"),
            F.min("mid").alias("first_mid"),
            F.collect_list(candidate).alias("_candidates"),
        )
        .withColumn(
            "header_line",
            F.get(F.filter("_candidates", lambda c: c["mid"] == F.col("first_mid")), 0)["value"],
        )
        .drop("_candidates")
    )


def survey_records(spark: SparkSession, paths, headers: DataFrame, width: int) -> DataFrame:
    """``survey_blocks`` for multi-line records; header lines come from a line survey."""
    counted = (
        record_scan(spark, paths, width, multi_line=True)
        .groupBy("file_path", "block_start")
        .agg(F.count("*").alias("block_rows"), F.min("mid").alias("first_mid"))
    )
    lines = headers.where("block_start = 0").select("file_path", "header_line")
    return counted.join(lines, "file_path", "left")


def read_layout(blocks: DataFrame) -> Layout:
    """Two small queries over the stored survey."""
    begins_file = F.col("block_start") == 0
    fields = most_fields(blocks, "header_line")
    headers = blocks.select(
        begins_file.alias("begins_file"),
        header_columns(F.col("header_line"), fields).alias("header"),
    ).select(
        "begins_file",
        F.size("header").alias("width"),
        (F.col("header").isNull() | (F.size(missing_columns(F.col("header"))) > 0)).alias("broken"),
        *[F.array_position("header", name).cast("int").alias(name) for name in REQUIRED_COLUMNS],
    )
    intact = F.col("begins_file") & ~F.col("broken")
    # At most as many values per set as the widest header has fields.
    facts = headers.agg(
        F.count(F.lit(1)).alias("blocks"),
        F.count_if("begins_file").alias("files"),
        F.count_if(F.col("begins_file") & F.col("broken")).alias("broken"),
        *[
            F.collect_set(F.when(intact, F.col(name))).alias(name)
            for name in ("width", *REQUIRED_COLUMNS)
        ],
    ).first()
    return Layout(
        facts["blocks"],
        facts["files"],
        facts["broken"],
        {name: sorted(facts[name]) for name in REQUIRED_COLUMNS},
        sorted(facts["width"]),
        fields,
    )


def _positional_names(width: int) -> list[str]:
    return [f"c{i}" for i in range(width)]


def most_fields(headers: DataFrame, line: str) -> int:
    """A number of fields that no line exceeds, from the commas of the widest one."""
    commas = F.length(line) - F.length(F.replace(F.col(line), F.lit(",")))
    return headers.agg(F.coalesce(F.max(commas), F.lit(0)).alias("commas")).first()["commas"] + 1


def header_columns(line: Column, most: int) -> Column:
    """Column names of a header line, in order, as Spark's CSV reader splits it; an empty name is NULL.

    ``most`` is what ``most_fields`` gives. The mark put behind the line tells where its
    fields end. A quote that is not closed leaves the mark in the last name, which it ends.
    """
    names = [f"h{i}" for i in range(most + 1)]
    options = {**_CSV_OPTIONS, "maxColumns": str(most + 1)}
    marked = F.from_csv(F.concat(line, F.lit(f",{_MARK}")), ", ".join(f"{n} string" for n in names), options)

    def named(fields: Column) -> Column:
        whole = F.filter(fields, lambda _, i: i < F.size(fields) - 1)
        rest = F.substring_index(F.element_at(fields, -1), f",{_MARK}", 1)
        return F.when(F.element_at(fields, -1) == _MARK, whole).otherwise(F.concat(whole, F.array(rest)))

    def up_to_mark(record: Column) -> Column:
        fields = F.array(*[record[n] for n in names])
        ends = F.transform(fields, lambda f: F.coalesce(f.contains(_MARK), F.lit(False)))
        return F.slice(fields, 1, F.array_position(ends, True).cast("int"))

    # The record is the variable of a lambda, so a line is parsed once and not for every field.
    records = F.transform(F.array(marked), up_to_mark)
    return F.when(line.isNotNull(), F.get(F.transform(records, named), 0))


def missing_columns(header: Column, required=REQUIRED_COLUMNS) -> Column:
    """Required names absent from a header, sorted; names compare exactly."""
    wanted = F.array(*[F.lit(name) for name in required])
    return F.array_sort(F.array_except(wanted, header))


def broken_files(files: DataFrame, blocks: DataFrame) -> DataFrame:
    """Files that break the column contract, from the survey alone.

    A file with no line at all has no block and therefore breaks it too.
    """
    fields = most_fields(blocks, "header_line")
    headers = blocks.where("block_start = 0").select(
        decoded_path(F.col("file_path")).alias("path"),
        missing_columns(header_columns(F.col("header_line"), fields)).alias("missing"),
    )
    return (
        files.join(headers, "path", "left")
        .where(F.col("missing").isNull() | (F.size("missing") > 0))
        .drop("missing")
    )


def with_missing(spark: SparkSession, broken: DataFrame, paths) -> DataFrame:
    """Adds the sorted ``missing`` names to broken files by reading their first lines.

    The survey keeps no header that lacks a name, so these files are read once more.
    """
    lines = line_scan(spark, paths).where("block_start = 0")
    first = lines.groupBy("file_path").agg(F.min("mid").alias("mid"))
    # Stored, so that the files are not read a third time for their widest line.
    stored = written(lines.join(first, ["file_path", "mid"]).select("file_path", "value"), "headers")
    headers = stored.select(
        decoded_path(F.col("file_path")).alias("path"),
        missing_columns(header_columns(F.col("value"), most_fields(stored, "value"))).alias("missing"),
    )
    everything = F.array_sort(F.array(*[F.lit(name) for name in REQUIRED_COLUMNS]))
    return broken.join(headers, "path", "left").withColumn(
        "missing", F.coalesce("missing", everything)
    )


def block_offsets(blocks: DataFrame, most: int) -> DataFrame:
    """Per block: the position of its first row, and where its file keeps which column."""
    in_file = Window.partitionBy("file_path").orderBy("block_start")
    before = in_file.rowsBetween(Window.unboundedPreceding, -1)
    prefix, suffix = batch_id_ends(F.col("file_name"))
    return (
        blocks.select(
            "file_path",
            "block_start",
            "block_rows",
            "first_mid",
            # The header is row -1, so the first data row is row 0.
            (F.coalesce(F.sum("block_rows").over(before), F.lit(0)) - 1).alias("block_offset"),
            F.first("header_line").over(in_file).alias("header_line"),
            file_name_of(decoded_path(F.col("file_path"))).alias("file_name"),
        )
        .withColumn("header", header_columns(F.col("header_line"), most))
        .select(
            "file_path",
            "block_start",
            "block_rows",
            "first_mid",
            "block_offset",
            "file_name",
            prefix.alias("batch_prefix"),
            suffix.alias("batch_suffix"),
            F.size("header").alias("header_width"),
            *[
                F.array_position("header", name).cast("int").alias(f"at_{name}")
                for name in REQUIRED_COLUMNS
            ],
        )
    )


def _required_field(name: str, positions: list[int]) -> Column:
    """The field a file keeps a column in; a plain column when all files agree."""
    if len(positions) == 1:
        return F.col(f"c{positions[0] - 1}")
    choices = [F.when(F.col(f"at_{name}") == p, F.col(f"c{p - 1}")) for p in positions]
    return F.coalesce(*choices)


def _too_long(width: int) -> Column:
    """The row has more fields than its file's header, empty ones counted.

    The reader hands over whole rows that haven't ``width`` fields. A mark is put behind
    such a row; the field in which it is read back tells how many come before it.
    """
    schema = ", ".join(f"m{i} string" for i in range(width + 1))
    marked = F.from_csv(F.concat(F.col(_ODD_ROW), F.lit(f",{_MARK}")), schema, _CSV_OPTIONS)
    fields = F.coalesce(
        *[F.when(marked[f"m{i}"].contains(_MARK), i) for i in range(width + 1)], F.lit(width + 1)
    )
    return F.when(F.col(_ODD_ROW).isNull(), width).otherwise(fields) > F.col("header_width")


def read_source_rows(
    spark: SparkSession,
    paths,
    blocks: DataFrame,
    layout: Layout,
    multi_line: bool = False,
    broadcast_limit: int = BROADCAST_BLOCK_LIMIT,
) -> DataFrame:
    """Raw rows ``file_name, ordinal, ts_raw, price_raw, user_raw, too_long`` and the ends
    of their batch ids.

    ``blocks`` must come from a survey of the same paths and be stored, so that both
    passes agree; a split that does not match it fails the job instead of giving wrong
    positions. Fields are taken by the position of their name in the file's own header.
    """
    scan = record_scan(spark, paths, layout.width, multi_line)
    offsets = broadcast_if_at_most(block_offsets(blocks, layout.most_fields), layout.block_count, broadcast_limit)
    inside = F.col("mid") - F.col("first_mid")
    known = inside.between(F.lit(0), F.col("block_rows") - 1)
    mismatch = F.raise_error(
        F.concat(F.lit("file split differs from its survey: "), F.col("file_path"))
    )
    fields = {name: _required_field(name, layout.positions[name]) for name in REQUIRED_COLUMNS}
    return (
        scan.join(offsets, ["file_path", "block_start"], "left")
        .select(
            "file_name",
            F.when(F.coalesce(known, F.lit(False)), F.col("block_offset") + inside)
            .otherwise(mismatch.cast("bigint"))
            .alias("ordinal"),
            fields["timestamp"].alias("ts_raw"),
            fields["price"].alias("price_raw"),
            fields["user_id"].alias("user_raw"),
            _too_long(layout.width).alias("too_long"),
            "batch_prefix",
            "batch_suffix",
        )
        .where(F.col("ordinal") >= 0)
    )


def open_source(spark: SparkSession, paths, multi_line: bool = False) -> DataFrame:
    """Positioned raw rows of CSV files outside any ingest.

    The survey is stored in the shared folder, so the result can be used repeatedly.
    """
    prepare(spark)
    paths = list(paths)
    stored = shared_dir(spark, "survey")
    survey_blocks(line_scan(spark, paths)).write.parquet(f"{stored}/lines")
    blocks = spark.read.parquet(f"{stored}/lines")
    layout = read_layout(blocks)
    if layout.broken_count or not layout.file_count:
        raise ColumnContractError("some source files lack required columns")
    if multi_line:
        survey_records(spark, paths, blocks, layout.width).write.parquet(f"{stored}/records")
        blocks = spark.read.parquet(f"{stored}/records")
    return read_source_rows(spark, paths, blocks, layout, multi_line)
