"""Removal of repeated windows against a dictionary of all windows."""

import hashlib
import random

import numpy as np

from tallyflow.llm import substrings
from tallyflow.llm.queries import QUERIES
from tests.llm.conftest import store


def brute(rows):
    first, out = {}, {}
    order = sorted(rows, key=lambda r: r["doc_id"])
    words = {r["doc_id"]: (r["text"] or "").encode().split() for r in order}
    for doc, own in words.items():
        for i in range(len(own) - 19):
            first.setdefault(tuple(own[i : i + 20]), (doc, i))
    for doc, own in words.items():
        gone = set()
        for i in range(len(own) - 19):
            if first[tuple(own[i : i + 20])] != (doc, i):
                gone.update(range(i, i + 20))
        kept = b" ".join(w for i, w in enumerate(own) if i not in gone)
        out[doc] = (len(own), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def test_awkward_documents(spark, sf_dir, rows):
    found = {r.doc_id: tuple(r)[1:] for r in QUERIES["op5_substring_dedup"](spark, sf_dir).collect()}
    assert found == brute(rows)


def test_random_overlaps(spark, tmp_path):
    """Few distinct words and shuffled passages: windows repeat in every possible way."""
    rng = random.Random(11)
    pool = [[rng.choice("abcdefgh") for _ in range(rng.randint(5, 70))] for _ in range(12)]
    rows = []
    for i in range(120):
        own = [w for _ in range(rng.randint(0, 6)) for w in rng.choice(pool)] + [rng.choice("ab") for _ in range(rng.randint(0, 40))]
        rows.append({"doc_id": i * 7 % 121, "text": " ".join(own), "source": "s"})
    rows += [{"doc_id": 500, "text": "p " * 61, "source": "s"}, {"doc_id": 501, "text": "p q " * 33, "source": "s"}]
    folder = store(rows, tmp_path / "sf", parts=5)
    found = {r.doc_id: tuple(r)[1:] for r in QUERIES["op5_substring_dedup"](spark, folder).collect()}
    expected = brute(rows)
    assert found == expected
    assert 0 < sum(e[1] for e in expected.values()) < sum(e[0] for e in expected.values())


def test_repeated_rows_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (None, None), (2, text + " x")], "doc_id long, text string")
    found = sorted((r.doc_id or 9, r.n_words, r.n_removed, len(r.intervals)) for r in substrings.without_repeats(docs).collect())
    assert found == [(1, 40, 0, 0), (1, 40, 0, 0), (2, 41, 40, 1), (9, 0, 0, 0), (9, 40, 40, 1)]


def test_thousands_of_equal_rows(spark, tmp_path):
    """Every copy has its own spans only, so the work grows with the number of copies."""
    text = " ".join(f"w{i}" for i in range(400))
    rows = [{"doc_id": 1, "text": text, "source": "s"}] * 5000 + [{"doc_id": 2, "text": "head " + text, "source": "s"}]
    folder = store(rows, tmp_path / "sf")
    found = QUERIES["op5_substring_dedup"](spark, folder).groupBy("doc_id", "n_words", "n_removed").count().collect()
    assert sorted(map(tuple, found)) == [(1, 400, 0, 5000), (2, 401, 400, 1)]


def test_intervals_are_maximal(docs):
    for row in substrings.without_repeats(docs).collect():
        spans = [(i.from_word, i.to_word) for i in row.intervals]
        assert all(b < c for (_, b), (c, _) in zip(spans, spans[1:], strict=False))
        assert row.n_removed == sum(b - a for a, b in spans)
        assert len(row.kept_text.encode().split()) == row.n_words - row.n_removed


def test_sliding_minimum():
    values = np.random.default_rng(0).integers(0, 50, 200)
    for width in (1, 2, 3, 8, 13, 16):
        expected = [values[i : i + width].min() for i in range(len(values) - width + 1)]
        assert substrings.sliding_min(values, width).tolist() == expected
