"""The pipeline stage by stage against plain Python over what the stage before kept."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from tallyflow.llm import bpe_monoid
from tallyflow.llm.common import documents
from tallyflow.session import written
from tests.llm.conftest import store
from tests.llm.test_jaccard_join import brute
from tests.llm.test_row_queries import expected_targets, host_verdicts, measures, normal, words


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs, out = documents(spark, sf_dir), []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
        out.append(docs)
    return out


def rows_of(frame):
    return [r.asDict() for r in frame.select("doc_id", "text", "source").collect()]


def test_names_and_columns(stages, docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "mix_sources", "encode"]
    assert all(frame.columns == docs.columns for frame in stages[:-1])


def test_quality_rules(stages, rows):
    verdict = host_verdicts(rows)
    expected = set()
    for r in rows:
        m = measures(r["text"])
        if m["n_words"] >= 50 and 100 * m["n_repeat_words"] <= 50 * m["n_words"] and verdict[r["source"]]:
            expected.add(r["doc_id"])
    assert {r["doc_id"] for r in rows_of(stages[0])} == expected


def test_exact_dedup(stages):
    first = {}
    for r in sorted(rows_of(stages[0]), key=lambda r: r["doc_id"]):
        first.setdefault(normal(r["text"]), r["doc_id"])
    assert sorted(r["doc_id"] for r in rows_of(stages[1])) == sorted(first.values())


def test_near_dedup(stages):
    expected = {component for _, component in brute(rows_of(stages[1])).values()}
    assert sorted(r["doc_id"] for r in rows_of(stages[2])) == sorted(expected)


def test_mix_sources(stages):
    before = rows_of(stages[2])
    _, goal = expected_targets(before)
    texts, sizes, taken, by_source = {}, {}, Counter(), Counter()
    for r in before:
        texts[r["doc_id"]], sizes[r["doc_id"]] = r["text"], len(words(r["text"]))
    for r in rows_of(stages[3]):
        assert r["text"] in texts[r["doc_id"]]
        taken[r["doc_id"]] += len(words(r["text"]))
        by_source[r["source"]] += len(words(r["text"]))
    assert all(taken[d] <= 2 * n for d, n in sizes.items())
    assert all(abs(by_source[s] - aim) <= 1 for s, aim in goal.items())


def test_encode(stages, spark, sf_dir):
    ranks = bpe_monoid.TreeEncoder.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = Counter()
    for r in rows_of(stages[3]):
        ids = library.encode_ordinary(r["text"])
        expected[r["doc_id"], r["source"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in stages[4].collect()) == expected
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect()) == expected


def test_empty_table(spark, empty_dir):
    assert corpus_pipeline.run(spark, empty_dir).count() == 0


def test_nothing_passes_the_rules(spark, tmp_path):
    folder = store([{"doc_id": i, "text": "short", "source": None} for i in range(3)], tmp_path / "sf")
    assert corpus_pipeline.run(spark, folder).count() == 0
