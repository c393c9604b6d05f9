"""Components of near-duplicate links against a comparison of all pairs."""

import random

import pytest

from tallyflow.llm import jaccard_join
from tallyflow.llm.queries import QUERIES
from tests.llm.conftest import store


def shingle_set(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) or frozenset([tuple(words)])


def brute(rows):
    sets = {r["doc_id"]: shingle_set(r["text"]) for r in rows}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {d: (len(sets[d]), find(d)) for d in ids}


def check(spark, folder, rows):
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op4_jaccard_join"](spark, folder).collect()}
    expected = brute(rows)
    assert found == expected
    return expected


def near_rows(seed, n=150):
    """Chains of edits, passages in otherwise different texts, short and equal texts."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    passage = [rng.choice(words) for _ in range(25)]
    rows, current = [], []
    for i in range(n):
        kind = rng.random()
        if kind < 0.15 or not current:
            current = [rng.choice(words) for _ in range(rng.choice([4, 8, 30, 60, 120]))]
        elif kind < 0.3:
            current = passage + [rng.choice(words) for _ in range(rng.randint(1, 40))]
        elif kind < 0.9:
            current = list(current)
            for _ in range(rng.randint(0, 2)):
                at = rng.randrange(len(current))
                current[at : at + 1] = rng.choice([[], [rng.choice(words)], [rng.choice(words)] * 2]) or current[at : at + 1]
        rows.append({"doc_id": 1000 - i, "text": " ".join(w.upper() if rng.random() < 0.1 else w for w in current), "source": "s"})
    return rows


def test_awkward_documents(spark, sf_dir, rows):
    check(spark, sf_dir, rows)


@pytest.mark.parametrize(("leaf", "heavy"), [(jaccard_join.LEAF, jaccard_join.HEAVY), (2, jaccard_join.HEAVY), (2, 1)])
def test_chains_of_edits(spark, tmp_path, monkeypatch, leaf, heavy):
    monkeypatch.setattr(jaccard_join, "LEAF", leaf)
    monkeypatch.setattr(jaccard_join, "HEAVY", heavy)
    rows = near_rows(3)
    expected = check(spark, store(rows, tmp_path / "sf"), rows)
    assert 5 < len({c for _, c in expected.values()}) < len(rows) - 20


def test_copies_around_half_the_size_of_a_frequent_pivot(spark, tmp_path, monkeypatch):
    """Articles with and without a common passage: the longer cuts lie within twice the size, the shorter ones don't."""
    monkeypatch.setattr(jaccard_join, "LEAF", 2)
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(194)]
    texts = [[f"o{k}.{i}" for i in range(250)] + passage for k in range(60)]
    for k, n in enumerate((200, 208, 214, 222, 300)):
        article = [f"a{k}.{i}" for i in range(n)]
        cuts = [article, article[1:], article[:-20], article[1:-20], article[:-n // 3], article[1 : -n // 3]]
        texts += [article + passage, *cuts, passage * 2 + article]
    rng.shuffle(texts)
    rows = [{"doc_id": i, "text": " ".join(t), "source": "s"} for i, t in enumerate(texts)]
    expected = check(spark, store(rows, tmp_path / "sf"), rows)
    assert len({c for _, c in expected.values()}) < len(rows) - 20


def test_keep_documents(spark, sf_dir, docs, rows):
    kept = jaccard_join.keep_documents(docs)
    assert kept.columns == docs.columns
    expected = brute(rows)
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted({c for _, c in expected.values()})


def test_repeated_rows_and_null_ids(spark):
    text = "a b c d e f g h i j"
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (None, "x y"), (2, None), (3, "  ")], "doc_id long, text string")
    found = sorted(((r.doc_id or 9), r.n_shingles, r.component_id or 9) for r in jaccard_join.components(docs).collect())
    assert found == [(1, 6, 1), (1, 6, 1), (2, 0, 2), (3, 0, 3), (9, 1, 9), (9, 6, 1)]
    assert jaccard_join.keep_documents(docs).count() == 4


def test_connected(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 460)]
    found = {r.node: r.root for r in jaccard_join.connected(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    assert found == {x: find(x) for pair in pairs if pair[0] != pair[1] for x in pair}
