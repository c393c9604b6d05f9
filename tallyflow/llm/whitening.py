"""Whitening of embeddings by spectral divide and conquer.

Every entry c of a vector becomes the integer floor(64 * c) + 1000000. Sums of all vectors
are gathered exactly in Spark, then their co-moments: every task centres its vectors, adds
up products, and parts are merged row by row of the matrix. The covariance, whose size
depends on the dimension only, is taken apart on the driver: the polar factor of the
covariance less a shift (found by QDWH iterations) gives the projector on the eigenvalues
above the shift; bases of it and of its complement divide the matrix into two blocks, which
are divided in turn, until every block is one component. The components, scaled by the root
of their eigenvalues, are broadcast, and tasks project their vectors on them.

Defined cases: a vector that is null, or holds an entry that is null, not finite, or too
large for 64 * c to fit a long, is dropped. The most frequent length is the dimension (of
equally frequent ones the largest); vectors of other lengths are dropped as well. A null
identifier is kept; repeated rows count and are returned one by one. Components without
variance (below the rounding of the largest eigenvalue) can't be scaled and are left out,
so equal vectors, a single vector or an empty table give an empty result. A deviation
that no long holds is null. Other columns are ignored.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyflow.llm.common import map_batches
from tallyflow.session import written

#: An entry c is taken as floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
LARGEST = 2.0**56
#: Vectors that a task multiplies at once.
STEP = 8192
EPS = np.finfo(np.float64).eps


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id and x of every vector that remains."""
    fits = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < LARGEST))
    usable = vectors.where(F.col("embedding").isNotNull() & fits)
    common = usable.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    whole = F.transform("embedding", lambda c: (F.floor(c.cast("double") * SCALE) + SHIFT).cast("long"))
    read = usable.where(F.size("embedding") == (common[0] if common else 0)).select("vec_id", whole.alias("x"))
    return written(read, "integer-vectors")


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, STEP):
            part = batch.slice(at, STEP)
            yield part, part.column("x").flatten().to_numpy().reshape(part.num_rows, -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each dimension: vectors, exact sum, least and greatest entry."""
    n, total, least, most = 0, None, None, None
    for _, x in _matrices(batches):
        # In halves no sum of a step leaves 64 bits.
        high, low = x >> 31, x & (2**31 - 1)
        own = [(int(h) << 31) + int(lo) for h, lo in zip(high.sum(axis=0), low.sum(axis=0), strict=True)]
        total = own if total is None else [a + b for a, b in zip(total, own, strict=True)]
        least = x.min(axis=0) if least is None else np.minimum(least, x.min(axis=0))
        most = x.max(axis=0) if most is None else np.maximum(most, x.max(axis=0))
        n += len(x)
    if n:
        columns = [pa.array(np.arange(len(total))), pa.array(np.full(len(total), n)), pa.array(list(map(Decimal, total)), pa.decimal128(38, 0)), pa.array(least), pa.array(most)]
        yield pa.RecordBatch.from_arrays(columns, names=["i", "n", "total", "least", "most"])


@dataclass
class Centre:
    """Vectors and exact sums; entries are handled as differences from an integer near the mean."""

    n: int
    sums: list[int]
    reach: int

    def __post_init__(self) -> None:
        self.near = [round(s / self.n) if abs(s) < 2**53 else s // self.n for s in self.sums]
        self.rest = [s - self.n * m for s, m in zip(self.sums, self.near, strict=True)]
        self.near_array, self.fraction = np.array(self.near, np.int64), np.array([r / self.n for r in self.rest])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.near_array) - self.fraction

    def deviations(self, x: np.ndarray) -> list[int | None] | np.ndarray:
        """Sum over dimensions of (n * x - S) ** 2, exact."""
        bound = self.n * self.reach + max(map(abs, self.rest))
        if bound * bound * x.shape[1] < 2**63:
            d = self.n * (x - self.near_array) - np.array(self.rest, np.int64)
            return (d * d).sum(axis=1)
        exact = [sum((self.n * (v - m) - r) ** 2 for v, m, r in zip(row, self.near, self.rest, strict=True)) for row in x.tolist()]
        return [v if v < 2**63 else None for v in exact]


def _merge(a: tuple[int, np.ndarray, np.ndarray], b: tuple[int, np.ndarray, np.ndarray], rows: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Join two counts, means and (some rows of) centred co-moments."""
    n = a[0] + b[0]
    apart = b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart[rows], apart) * (a[0] * (b[0] / n))


def _moments(batches: Iterator[pa.RecordBatch], shared: Broadcast) -> Iterator[pa.RecordBatch]:
    centre, project = shared.value
    held = None
    for _, x in _matrices(batches):
        z = centre.centred(x)
        z = z if project is None else z @ project
        mean = z.mean(axis=0)
        z = z - mean
        own = (len(z), mean, z.T @ z)
        held = own if held is None else _merge(held, own, np.arange(z.shape[1]))
    if held:
        yield from _moment_rows({i: (held[0], held[1], held[2][i : i + 1]) for i in range(len(held[1]))})


def _moment_rows(rows: dict[int, tuple[int, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    columns = [pa.array(list(rows), pa.int32()), pa.array([n for n, _, _ in rows.values()], pa.int64())]
    columns += [pa.array([values.reshape(-1) for values in part], pa.list_(pa.float64())) for part in zip(*[(m, c) for _, m, c in rows.values()], strict=True)]
    yield pa.RecordBatch.from_arrays(columns, names=["i", "n", "mean", "products"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Join the parts of each matrix row; a task holds one part of each of its rows."""
    rows: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for i, n, mean, products in zip(*(batch.column(c).to_pylist() for c in ("i", "n", "mean", "products")), strict=True):
            part = (n, np.array(mean), np.array(products)[None, :])
            rows[i] = _merge(rows[i], part, np.array([i])) if i in rows else part
    if rows:
        yield from _moment_rows(rows)


def covariance(vectors: DataFrame, centre: Centre, project: np.ndarray | None = None) -> np.ndarray:
    """Covariance, divisor n, of the centred vectors or of their projections."""
    schema = "i int, n long, mean array<double>, products array<double>"
    shared = vectors.sparkSession.sparkContext.broadcast((centre, project))
    parts = map_batches(vectors.select("x"), partial(_moments, shared=shared), schema)
    # As many rows as the matrix has.
    rows = map_batches(parts.repartition("i"), _merged, schema).orderBy("i").select("products").toArrow()
    matrix = np.array(rows.column("products").to_pylist()) / centre.n
    return (matrix + matrix.T) / 2


def polar(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix, by QDWH iterations."""
    x = a / max(np.linalg.norm(a), np.finfo(np.float64).tiny)
    # A bound that is too low costs an iteration, never accuracy.
    low = EPS / 4
    one = np.eye(len(a))
    for _ in range(12):
        square = low * low
        root = np.sqrt(1 + np.cbrt(4 * (1 - square) / square**2))
        p = root + 0.5 * np.sqrt(max(8 - 4 * (root**2 - 1) + 8 * (2 - square) / (square * root), 0.0))
        q = (p - 1) ** 2 / 4
        r = p + q - 1
        if r > 100:
            basis, _ = np.linalg.qr(np.concatenate([np.sqrt(r) * x, one]))
            after = q / r * x + (p - q / r) / np.sqrt(r) * basis[: len(a)] @ basis[len(a) :].T
        else:
            after = q / r * x + (p - q / r) * np.linalg.solve(one + r * x @ x, x)
        after = (after + after.T) / 2
        moved = np.linalg.norm(after - x)
        x, low = after, min(low * (p + q * square) / (1 + r * square), 1.0)
        if abs(low - 1) < 10 * EPS and moved < np.cbrt(EPS):
            break
    return x


def _divided(a: np.ndarray, size: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of two invariant subspaces, or None where all eigenvalues are equal to rounding."""
    m = len(a)
    diagonal = np.sort(np.diag(a))
    mean = diagonal.mean()
    if np.linalg.norm(a - mean * np.eye(m)) <= 4 * m * EPS * size:
        return None
    best = None
    # The mean lies between the eigenvalues always; the others are for even halves, and for a shift that meets one.
    for shift in (np.median(diagonal), mean, *(mean + f * (diagonal[-1] - diagonal[0] + size * EPS) for f in (0.11, -0.13, 0.03, -0.05))):
        projector = (polar(a - shift * np.eye(m)) + np.eye(m)) / 2
        k = round(np.trace(projector))
        if not 0 < k < m:
            continue
        upper = projector @ np.random.default_rng(m).standard_normal((m, k))
        for _ in range(3):
            upper, _ = np.linalg.qr(projector @ upper)
        basis, _ = np.linalg.qr(upper, mode="complete")
        upper, lower = basis[:, :k], basis[:, k:]
        left = np.linalg.norm(upper.T @ a @ lower)
        if best is None or left < best[0]:
            best = left, upper, lower
        if left <= 4 * m * EPS * size:
            break
    return best and best[1:]


def components(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and their unit vectors as columns."""
    size = np.linalg.norm(a)
    parts, todo = [], [np.eye(len(a))]
    while todo:
        basis = todo.pop()
        block = basis.T @ a @ basis
        halves = _divided((block + block.T) / 2, size) if len(block) > 1 else None
        if halves is None:
            parts.append(basis)
        else:
            todo.extend(basis @ half for half in halves)
    vectors = np.concatenate(parts, axis=1)
    vectors = vectors / np.linalg.norm(vectors, axis=0)
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


@dataclass
class Whitening:
    """What a task needs for projecting: the centre, and components over the roots of their eigenvalues as columns."""

    centre: Centre
    project: np.ndarray
    explained: np.ndarray
    identity_error: float


def fit(vectors: DataFrame, n_components: int) -> Whitening | None:
    """Fit to all integer vectors; None where nothing varies."""
    gathered = map_batches(vectors.select("x"), _sums, "i long, n long, total decimal(38,0), least long, most long")
    rows = gathered.groupBy("i").agg(F.sum("n"), F.sum("total"), F.min("least"), F.max("most")).orderBy("i").collect()
    if not rows:
        return None
    sums = [int(r[2]) for r in rows]
    reach = max(max(r[4] - s // r[1], s // r[1] - r[3]) + 2 for r, s in zip(rows, sums, strict=True))
    centre = Centre(rows[0][1], sums, reach)
    matrix = covariance(vectors, centre)
    values, units = components(matrix)
    kept = int((values > len(values) * EPS * max(values[0], 0.0)).sum())
    kept = min(kept, n_components)
    if not kept:
        return None
    project = units[:, :kept] / np.sqrt(values[:kept])
    error = np.abs(covariance(vectors, centre, project) - np.eye(kept)).max()
    return Whitening(centre, project, values[:kept] / np.trace(matrix), float(error))


def _whitened(batches: Iterator[pa.RecordBatch], shared: Broadcast) -> Iterator[pa.RecordBatch]:
    fitted: Whitening = shared.value
    k = fitted.project.shape[1]
    for part, x in _matrices(batches):
        n = len(x)
        deviation = pa.array(fitted.centre.deviations(x), pa.int64())
        row = pa.array(np.repeat(np.arange(n), k))
        yield pa.RecordBatch.from_arrays([
            part.column("vec_id").take(row), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(np.full(n * k, fitted.centre.n)), deviation.take(row),
            pa.array((fitted.centre.centred(x) @ fitted.project).reshape(-1)), pa.array(np.tile(fitted.explained, n)), pa.array(np.full(n * k, fitted.identity_error)),
        ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])


def whitened(vectors: DataFrame, components: int = 32) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every remaining vector and component."""
    spark = vectors.sparkSession
    integers = integer_vectors(vectors)
    schema = T.StructType([integers.schema["vec_id"]])
    for name, kind in (("component", "integer"), ("n", "long"), ("deviation", "long"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")):
        schema = schema.add(name, kind)
    fitted = fit(integers, components)
    if fitted is None:
        return spark.createDataFrame([], schema)
    task = partial(_whitened, shared=spark.sparkContext.broadcast(fitted))
    return map_batches(integers, task, schema)
