"""Whitening against numpy's own eigenvectors."""

import math
from collections import defaultdict

import numpy as np
import pytest

from tallyflow.llm import whitening
from tallyflow.llm.queries import QUERIES
from tests.llm.conftest import others


def check(found, vectors, limit):
    """``vectors``: pairs of identifier and integer vector, as the contract makes them."""
    x = np.array([v for _, v in vectors], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    z = np.array([[float(n * v - s) / n for v, s in zip(row, sums)] for row in x])
    values, units = np.linalg.eigh(z.T @ z / n)
    values, units = values[::-1], units[:, ::-1]
    kept = min(limit, int((values > len(values) * 2.3e-16 * values[0]).sum()))
    rows = defaultdict(list)
    for r in found.collect():
        rows[r.vec_id].append(r)
    per_id = defaultdict(list)
    for k, (i, _) in enumerate(vectors):
        per_id[i].append(k)
    assert rows.keys() == per_id.keys()
    table = np.empty((n, kept))
    for i, own in per_id.items():
        assert sorted(r.component for r in rows[i]) == sorted(list(range(1, kept + 1)) * len(own))
        assert {r.deviation for r in rows[i]} == {sum((n * v - s) ** 2 for v, s in zip(x[own[0]], sums))}
        for r in rows[i]:
            table[own, r.component - 1] = r.whitened
            assert r.n == n and r.identity_error < 1e-10
            assert math.isclose(r.explained, values[r.component - 1] / values.sum(), rel_tol=1e-9)
    plain = z @ units[:, :kept] / np.sqrt(values[:kept])
    signs = np.sign((plain * table).sum(axis=0))
    assert np.abs(plain * signs - table).max() < 1e-8


def integers(vectors):
    return [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in vectors]


@pytest.mark.parametrize("limit", [32, 5])
def test_whitening(spark, sf_dir, rows, limit):
    usable = [(r["vec_id"], integers(r["embedding"])) for r in others(rows)["embeddings"][0] if r["embedding"] and len(r["embedding"]) == 12 and None not in r["embedding"] and np.isfinite(r["embedding"]).all() and max(r["embedding"]) < 1e20]
    assert len({i for i, _ in usable}) > 200 and None in {i for i, _ in usable}
    # A repeated vector has rows of its own.
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    check(whitening.whitened(vectors, limit), usable, limit)


def frame(spark, vectors):
    return spark.createDataFrame([(k, v) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>")


def test_given_table(spark):
    folder = "/root/testdata/sf0.001"
    vectors = [(r.vec_id, integers(r.embedding)) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    check(QUERIES["op13_whitening"](spark, folder), vectors, 32)


def test_dependent_and_constant_dimensions(spark):
    rng = np.random.default_rng(1)
    base = np.round(rng.normal(size=(60, 3)) * 8) / 8
    vectors = np.concatenate([base, base[:, :1] * 2, np.full((60, 1), 3.0)], axis=1)
    check(whitening.whitened(frame(spark, vectors.tolist())), [(k, integers(v)) for k, v in enumerate(vectors)], 32)


def test_large_entries_are_exact(spark):
    rng = np.random.default_rng(2)
    vectors = (rng.normal(size=(40, 4)) * 2.0**40).astype(np.float32)
    exact = [(k, integers(v)) for k, v in enumerate(vectors)]
    found = whitening.whitened(frame(spark, vectors.tolist()))
    assert {r.deviation for r in found.collect()} == {None} and found.count() == 160
    sums = [sum(v[d] for _, v in exact) for d in range(4)]
    fitted = whitening.fit(whitening.integer_vectors(frame(spark, vectors.tolist())), 4)
    assert fitted.centre.sums == sums and fitted.identity_error < 1e-10


@pytest.mark.parametrize("vectors", [[], [[1.0, 2.0]], [[1.0, 2.0]] * 9, [[], []], [None]])
def test_nothing_varies(spark, vectors):
    assert whitening.whitened(frame(spark, vectors)).count() == 0


def test_divide_and_conquer():
    rng = np.random.default_rng(7)
    for values in ([5, 4, 3, 2, 1], [1e12, 1e6, 3.0, 3.0, 1e-3], [2.0] * 6, [-3, 0, 0, 7], list(range(1, 65)), [1e3] * 5 + [1.0] * 5, 1.0 + rng.random(40) * 1e-6):
        basis, _ = np.linalg.qr(rng.normal(size=(len(values), len(values))))
        a = basis * np.array(values, float) @ basis.T
        a = (a + a.T) / 2
        found, units = whitening.components(a)
        size = np.abs(found).max()
        assert np.abs(found - np.linalg.eigvalsh(a)[::-1]).max() < 1e-13 * size * len(a)
        assert np.abs(units.T @ units - np.eye(len(a))).max() < 1e-12 and np.abs(a @ units - units * found).max() < 1e-12 * size


def test_polar_factor():
    a = np.diag([3.0, -2.0, 1e-9, -1e-12])
    u = whitening.polar(a)
    assert np.abs(u - np.diag([1, -1, 1, -1])).max() < 1e-12
