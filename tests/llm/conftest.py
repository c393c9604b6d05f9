import os
import random

# The networks' matrices are small; more threads only wait for each other.
os.environ.setdefault("OMP_NUM_THREADS", "1")

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tallyflow.llm.common import documents


def awkward_rows():
    """Small documents with nulls, ties, repeats, odd white space and one long text."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(400)]

    def prose(n):
        return "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\n", "  ", "\t"]) for _ in range(n))

    passage = prose(60)
    base = prose(300)
    texts = [prose(rng.choice([3, 40, 60, 90, 200])) for _ in range(60)]
    texts += [None, "", "   \n\t ", "a", "one two three four", "ONE two Three four", "one two three four five", "x y z w", "it's <|endoftext|> they'll"]
    texts += [passage + prose(50), prose(30) + passage, passage + passage, passage.upper()]
    words = base.split()
    for k in range(12):
        copy = list(words)
        for _ in range(k):
            copy[rng.randrange(len(copy))] = "edit%d" % rng.randrange(50)
        texts.append(" ".join(copy))
    texts += [base, base, base.replace(" ", "\n\n"), base + " tail", "same line\n" * 30, "w " * 500, "## ** && " * 80]
    texts += [prose(20_000), "y" * 30_000, "z1 " * 3_000, "éß" * 4_000]
    sources = ["s10", "s2", "s1", None, "", "é", "Z", "s2", "s2", "s2"]
    rows = [{"doc_id": 3 * i + 7, "text": t, "source": sources[i % 10]} for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


COLUMNS = {"lang": "en", "n_chars": 5, "size": "clash", "start": 1.5, "spans": "c", "_text": "c", "pair": 7, "_file": "f", "_row": 2, "kept": None, "host": "h", "n_words": [1, 2], "_size": 4, "digest": "d", "shard": 3}


def store(rows, folder, parts=3):
    """Write rows as a documents table with further columns whose names clash."""
    path = folder / "documents.parquet"
    path.mkdir(parents=True)
    kinds = {"doc_id": pa.int64(), "text": pa.string(), "source": pa.string(), "lang": pa.string(), "n_chars": pa.int64(), "size": pa.string(), "start": pa.float64(), "spans": pa.string(), "_text": pa.string(), "pair": pa.int64(), "_file": pa.string(), "_row": pa.int64(), "kept": pa.bool_(), "host": pa.string(), "n_words": pa.list_(pa.int32()), "_size": pa.int32(), "digest": pa.string(), "shard": pa.int64()}
    for k in range(parts):
        part = [COLUMNS | {"n_chars": len(r["text"] or "")} | r for r in rows[k::parts]]
        pq.write_table(pa.Table.from_pylist(part, schema=pa.schema(list(kinds.items()))), path / f"part-{k}.parquet")
    for name, (own, kinds) in others(rows).items():
        pq.write_table(pa.Table.from_pylist(own, schema=pa.schema(list(kinds.items()))), folder / f"{name}.parquet")
    return str(folder)


def others(rows):
    """The other tables the queries read; empty where there are no documents."""
    rng = random.Random(3)
    labels = [{"doc_id": r["doc_id"], "quality": 1, "toxic": int(k % 3 == 0)} for k, r in enumerate(rows)]
    texts = [r["text"] for r in rows if r["text"]]
    items = [" ".join(t.split()[k : k + 14]) for k, t in enumerate(texts)] + ["", None, "- !", "One TWO, three", "z1 z1", texts[0][:200] if texts else "", "nowhere to be found " * 6] if rows else []
    benchmark = [{"item_id": None if k == 4 else k // 2 * 7, "text": t, "doc_id": k, "spans": "clash"} for k, t in enumerate(items)]
    vectors = [[rng.gauss(0, 0.2) * (1 + d % 5) for d in range(12)] for _ in range(len(rows) * 3)]
    if vectors:
        vectors += [None, [], [1.0] * 11, [None] + [0.5] * 11, [float("nan")] * 12, [float("inf")] + [0.0] * 11, [1e30] * 12, vectors[0], vectors[0]]
    embeddings = [{"vec_id": None if k == 3 else k, "embedding": v, "label": 1, "component": "clash"} for k, v in enumerate(vectors)]
    return {
        "labels": (labels, {"doc_id": pa.int64(), "quality": pa.int32(), "toxic": pa.int32()}),
        "benchmark": (benchmark, {"item_id": pa.int64(), "text": pa.string(), "doc_id": pa.int64(), "spans": pa.string()}),
        "embeddings": (embeddings, {"vec_id": pa.int64(), "embedding": pa.list_(pa.float32()), "label": pa.int32(), "component": pa.string()}),
    }


@pytest.fixture(scope="session")
def rows():
    return awkward_rows()


@pytest.fixture(scope="session")
def sf_dir(rows, tmp_path_factory):
    return store(rows, tmp_path_factory.mktemp("awkward") / "sf")


@pytest.fixture(scope="session")
def empty_dir(tmp_path_factory):
    return store([], tmp_path_factory.mktemp("empty") / "sf", parts=1)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return documents(spark, sf_dir)
