"""Benchmark hits against windows compared one by one."""

import hashlib
import re

import duckdb
import pytest

from tallyflow.llm import decontamination
from tallyflow.llm.queries import QUERIES
from tests.llm.conftest import others, store

TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PLAIN = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(PLAIN))


def expected(rows, items):
    """doc_id to words, positions hit and item ids found."""
    grams = {}
    for item in items:
        words = terms(item["text"])
        n = min(10, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            grams.setdefault(tuple(words[i : i + n]), set()).add(item["item_id"])
    widths = {len(g) for g in grams}
    out = {}
    for row in rows:
        words = terms(row["text"])
        hit, found = set(), set()
        for n in widths:
            for i in range(len(words) - n + 1):
                names = grams.get(tuple(words[i : i + n]))
                if names:
                    hit |= set(range(i, i + n))
                    found |= names - {None}
        out[row["doc_id"]] = words, hit, sorted(map(str, found))
    return out


def test_query(spark, sf_dir, rows):
    want = expected(rows, others(rows)["benchmark"][0])
    found = QUERIES["op11_decontamination"](spark, sf_dir).collect()
    assert len(found) == len(rows) and sum(r.contaminated for r in found) > 10
    for r in found:
        words, hit, items = want[r.doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(words), len(hit), len(items), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(items).encode()).hexdigest()


@pytest.mark.parametrize("block_words, bits", [(150, 64), (10**6, 5), (400, 7)])
def test_blocks_and_equal_hashes(spark, docs, sf_dir, rows, block_words, bits):
    """Many broadcast blocks, and hashes so short that most looks find other n-grams."""
    want = expected(rows, others(rows)["benchmark"][0])
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontamination.scanned(docs, benchmark, ("doc_id", "_text"), block_words, bits).collect()
    assert len(found) == len(rows)
    for r in found:
        words, hit, items = want[r.doc_id]
        assert {p for s in r.spans for p in range(s.start, s.stop)} == hit and r["items"] == items and r.n_words == len(words)
        assert all(a.stop < b.start for a, b in zip(r.spans, r.spans[1:])) and r._text == "c"


def test_blocks_are_bounded(spark, sf_dir):
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    sizes = [sum(len(g.grams) for g in b.sets) for b in decontamination.blocks(benchmark, 150)]
    assert len(sizes) > 3 and max(sizes) < 400


def test_removal(spark, docs, sf_dir, rows):
    want = expected(rows, others(rows)["benchmark"][0])
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    cleaned = decontamination.decontaminated(docs, benchmark)
    assert cleaned.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in rows}
    for r in cleaned.collect():
        words, hit, _ = want[r.doc_id]
        assert terms(r.text) == [w for p, w in enumerate(words) if p not in hit]
        assert hit or r.text == texts[r.doc_id]
    left = decontamination.decontaminated(docs, benchmark, "documents")
    assert {r.doc_id for r in left.collect()} == {d for d, (_, hit, _) in want.items() if not hit}


def test_repeated_rows_and_long_items(spark, tmp_path):
    passage = " ".join(f"w{k % 977}x{k}" for k in range(9000))
    rows = [{"doc_id": None, "text": passage[5000:20000], "source": "s"}] * 3 + [{"doc_id": 1, "text": "clean", "source": None}]
    docs = spark.read.parquet(store(rows, tmp_path / "sf") + "/documents.parquet")
    benchmark = spark.createDataFrame([(1, passage), (1, passage), (2, "")], "item_id long, text string")
    found = decontamination.scanned(docs, benchmark).collect()
    n = len(terms(passage[5000:20000]))
    assert sorted((len(r.spans), r.spans[0].stop - r.spans[0].start >= n - 2, r["items"]) for r in found if r.spans) == [(1, True, ["1"])] * 3
    assert decontamination.scanned(docs, benchmark.limit(0)).where("size(spans) > 0").count() == 0


def test_sql_twin(spark):
    from tallyflow.llm.oracles import ORACLES

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    want = con.execute(f"SELECT doc_id, n_words, n_hit, n_items, items_sha256, contaminated FROM ({ORACLES['op11_decontamination']})").fetchall()
    assert sorted(want) == sorted(tuple(r) for r in QUERIES["op11_decontamination"](spark, folder).collect())
