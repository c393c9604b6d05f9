import math
import itertools
import random
from decimal import Context, Decimal

import pytest
from pyspark.sql import functions as F

from tallyflow import operators as ops

STATE = "global_count long, global_sum double, global_min double, global_max double"
METRICS = (
    "phase int, file_name string, chunk_index long, row_count long, price_sum double, "
    "min_price double, max_price double"
)


def state(spark, *row):
    return spark.createDataFrame([row], STATE)


def shown(df):
    return tuple(ops.accumulated(df).first())


# The prices of the next three tests are fixed values of known results.
def test_first_batch(spark):
    merged = ops.merge_states(state(spark, 0, 0.0, None, None), state(spark, 3, 60.0, 10.0, 30.0))
    assert shown(merged) == (3, 60.0, 20.0, 10.0, 30.0)


def test_bounds_are_kept(spark):
    merged = ops.merge_states(state(spark, 3, 60.0, 10.0, 30.0), state(spark, 2, 100.0, 40.0, 60.0))
    assert shown(merged) == (5, 160.0, 32.0, 10.0, 60.0)


def test_empty_batch_changes_nothing(spark):
    before = state(spark, 5, 160.0, 10.0, 60.0)
    assert shown(ops.merge_states(before, state(spark, 0, 0.0, None, None))) == shown(before)


def test_empty_state_has_no_mean_and_no_bounds(spark):
    assert shown(state(spark, 0, 0.0, math.inf, -math.inf)) == (0, 0.0, None, None, None)


def test_batch_metrics(spark):
    rows = spark.createDataFrame(
        [("a", 1, 10.0), ("a", 1, None), ("a", 2, None)], "file_name string, chunk_index long, price double"
    )
    got = {r["chunk_index"]: tuple(r)[2:] for r in ops.batch_metrics(rows, ("file_name", "chunk_index")).collect()}
    assert got == {1: (1, 10.0, 10.0, 10.0), 2: (0, 0.0, None, None)}
    with pytest.raises(ValueError, match="price"):
        ops.batch_metrics(rows.drop("price"))


def brute_history(batches, start=(0, 0.0, None, None)):
    count, amount, low, high = start
    out = []
    for phase, name, chunk, n, s, lo, hi in sorted(batches):
        if n == 0:
            continue
        count, amount = count + n, amount + s
        low = lo if low is None else min(low, lo)
        high = hi if high is None else max(high, hi)
        out.append((name, chunk, n, count, amount, amount / count, low, high))
    return out


def random_batches(seed, hot=200):
    rng = random.Random(seed)
    batches = []
    # One file holds most batches, as a hot source would.
    for phase, name, chunks in [(0, "z.csv", 5), (0, "hot.csv", hot), (0, "one.csv", 1), (1, "a.csv", 9)]:
        for chunk in range(1, chunks + 1):
            n = rng.choice([0, 1, 2, 5])
            prices = sorted(float(rng.randint(-50, 50)) for _ in range(n))
            bounds = (prices[0], prices[-1]) if n else (None, None)
            batches.append((phase, name, chunk, n, float(sum(prices)), *bounds))
    return batches


@pytest.mark.parametrize("segment_chunks", [1, 7, 1 << 16])
@pytest.mark.parametrize("sum_scale", [None, 2])
def test_running_history_equals_a_sequential_loop(spark, segment_chunks, sum_scale):
    batches = random_batches(segment_chunks)
    start = (4, 100.0, -3.0, 55.0)
    history = ops.running_history(
        spark.createDataFrame(batches, METRICS),
        state(spark, *start),
        segment_chunks=segment_chunks,
        sum_scale=sum_scale,
    )
    got = [
        tuple(r)
        for r in history.orderBy("total_accumulated_rows").select(
            "file_name", "chunk_index", "batch_rows", "total_accumulated_rows", "accumulated_sum",
            "accumulated_avg", "global_min_price", "global_max_price",
        ).collect()
    ]
    assert got == brute_history(batches, start)


@pytest.mark.parametrize("prefix_rows", [1, 5])
@pytest.mark.parametrize("sum_scale", [None, 2])
def test_running_history_over_levels(spark, prefix_rows, sum_scale):
    """More files than a task may hold: ranges, and ranges of ranges, carry the totals."""
    rng = random.Random(prefix_rows)
    batches = []
    for f in range(40):
        for chunk in range(1, rng.randint(2, 5)):
            low = float(rng.randint(-20, 20))
            batches.append((f % 2, f"f{f:02d}.csv", chunk, 2, 2 * low + 1, low, low + 1))
    start = (4, 100.0, -3.0, 5.0)
    history = ops.running_history(spark.createDataFrame(batches, METRICS), state(spark, *start), segment_chunks=2, sum_scale=sum_scale, prefix_rows=prefix_rows)
    got = [tuple(r) for r in history.orderBy("total_accumulated_rows").select(
        "file_name", "chunk_index", "batch_rows", "total_accumulated_rows", "accumulated_sum",
        "accumulated_avg", "global_min_price", "global_max_price",
    ).collect()]
    assert got == brute_history(batches, start)


def test_running_history_without_state(spark):
    batches = random_batches(3, hot=20)
    history = ops.running_history(spark.createDataFrame(batches, METRICS), segment_chunks=4)
    last = history.orderBy(F.desc("total_accumulated_rows")).first()
    assert last["total_accumulated_rows"] == sum(b[3] for b in batches)
    assert last["accumulated_sum"] == sum(b[4] for b in batches)
    assert ops.repeated_batch_ids(history).isEmpty()
    assert not ops.repeated_batch_ids(history.unionByName(history)).isEmpty()


@pytest.mark.parametrize("width", [3, 1 << 20])
def test_ordinals_of_sparse_ids_in_a_hot_source(spark, width):
    rng = random.Random(width)
    ids = rng.sample(range(-40, 400), 150)
    rows = [("hot" if i % 5 else f"s{i % 3}", i) for i in ids]
    df = spark.createDataFrame(rows, "file_name string, id long")
    got = {(r["file_name"], r["id"]): r["ordinal"] for r in ops.ordinals_by_id(df, "id", bucket_width=width).collect()}
    expected = {}
    for name in {n for n, _ in rows}:
        for place, i in enumerate(sorted(i for n, i in rows if n == name)):
            expected[(name, i)] = place
    assert got == expected


@pytest.mark.parametrize("spread", [1, 1 << 52])
def test_ranges_hold_equally_many_rows_however_thin_the_ids(spark, spread):
    rng = random.Random(spread)
    ids = [i * spread for i in rng.sample(range(-1500, 1500), 2000)]
    rows = [("hot" if n % 3 else f"s{n % 2}", i) for n, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "file_name string, id long").repartition(5)
    numbered = ops.ordinals_by_range(df, "id", range_rows=100)
    got = {(r["file_name"], r["id"]): r["ordinal"] for r in numbered.collect()}
    expected = {}
    for name in {n for n, _ in rows}:
        for place, i in enumerate(sorted(i for n, i in rows if n == name)):
            expected[(name, i)] = place
    assert got == expected
    # The same bounds as ids of any spread would have: rows decide, not width.
    ranges = df.repartitionByRange(20, "file_name", "id").groupBy(F.spark_partition_id().alias("r")).count()
    sizes = [r["count"] for r in ranges.collect()]
    assert len(sizes) == 20 and max(sizes) <= 250
    assert ops.ordinals_by_range(df.limit(0), "id").count() == 0


def test_chunks_count_source_rows(spark):
    rows = spark.range(7).select(F.col("id").alias("ordinal"))
    assert [r["chunk_index"] for r in ops.assign_chunks(rows, 3).orderBy("ordinal").collect()] == [
        1, 1, 1, 2, 2, 2, 3,
    ]
    with pytest.raises(ValueError):
        ops.assign_chunks(rows, 0)


def test_reconciliation(spark):
    rows = spark.createDataFrame([(10.0,), (30.0,), (50.0,), (None,)], "price double")
    scan = ops.full_scan_stats(rows)
    assert tuple(scan.first()) == (3, 30.0, 10.0, 50.0)
    assert ops.reconciliation(state(spark, 3, 90.0, 10.0, 50.0), scan).first()["matches"]
    assert not ops.reconciliation(state(spark, 4, 90.0, 10.0, 50.0), scan).first()["matches"]
    empty = ops.full_scan_stats(rows.where("price > 99"))
    assert tuple(empty.first()) == (0, None, None, None)
    assert ops.reconciliation(state(spark, 0, 0.0, None, None), empty).first()["matches"]


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_large_prices_are_added_or_refused(spark, ansi):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        rows = spark.createDataFrame([(1e17,), (2.0,)], "price double")
        assert ops.batch_metrics(rows, (), sum_scale=2).first()["price_sum"] == 1e17 + 2
        with pytest.raises(Exception, match="not exact as a decimal"):
            ops.batch_metrics(spark.createDataFrame([(1e40,)], "price double"), (), sum_scale=2).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


#: More digits than Python's decimals have by default.
EXACT = Context(prec=60)


@pytest.mark.parametrize("scale", [2, 9])
@pytest.mark.parametrize("prefix_rows", [2, 1 << 16])
def test_exact_totals_beyond_the_digits_of_a_double(spark, scale, prefix_rows):
    """Batches, segments, files, ranges of files and the saved state lose no digit."""
    rng = random.Random(scale)
    prices = [Decimal(rng.randint(-(10**14), 10**15)).scaleb(-scale) for _ in range(200)]
    rows = [(0, f"f{i % 11:02d}.csv", i // 11 // 3 + 1, float(p)) for i, p in enumerate(prices)]
    metrics = ops.batch_metrics(spark.createDataFrame(rows, "phase int, file_name string, chunk_index long, price double"), sum_scale=scale)
    start = Decimal("123456789012345678901234567.5")
    saved = spark.createDataFrame([(7, float(start), None, None, str(start))], STATE + ", global_exact string")
    history = ops.running_history(metrics, saved, segment_chunks=2, sum_scale=scale, prefix_rows=prefix_rows)
    found = {(r.file_name, r.chunk_index): (r.total_accumulated_rows, r.accumulated_exact, r.accumulated_sum) for r in history.collect()}
    by_batch = {}
    for (_, name, chunk, _), price in zip(rows, prices, strict=True):
        by_batch.setdefault((name, chunk), []).append(price)
    count, total, expected = 7, start, {}
    for key in sorted(by_batch):
        count, total = count + len(by_batch[key]), EXACT.add(total, sum(by_batch[key]))
        expected[key] = (count, total, float(total))
    assert found == expected


def test_states_merge_exactly_in_any_order(spark):
    sums = ["90071992547409930.01", "0.02", "-90071992547409930.00"]
    parts = [spark.createDataFrame([(1, float(s), float(s), float(s), s)], STATE + ", global_exact string") for s in sums]
    for order in itertools.permutations(parts):
        row = ops.merge_states(*order, sum_scale=2).first()
        assert (row.global_count, str(row.global_exact), row.global_sum) == (3, "0.03", 0.03)
    # A state without an exact figure is taken by its double; without a scale all are.
    plain = state(spark, 1, 0.5, 0.5, 0.5)
    assert str(ops.merge_states(parts[1], plain, sum_scale=2).first().global_exact) == "0.52"
    assert "global_exact" not in ops.merge_states(parts[1], plain).columns


# A recorded history of six monthly files in batches of ten source rows: file,
# batch, rows, sum, total rows, total sum, mean with two places, least and greatest so far.
RECORDED = [
    ("2012-1", 1, 10, 630, 10, 630, 63.00, 14, 97),
    ("2012-1", 2, 9, 475, 19, 1105, 58.16, 14, 97),
    ("2012-1", 3, 1, 88, 20, 1193, 59.65, 14, 97),
    ("2012-2", 1, 10, 618, 30, 1811, 60.37, 14, 100),
    ("2012-2", 2, 10, 423, 40, 2234, 55.85, 10, 100),
    ("2012-2", 3, 9, 549, 49, 2783, 56.80, 10, 100),
    ("2012-3", 1, 10, 547, 59, 3330, 56.44, 10, 100),
    ("2012-3", 2, 10, 661, 69, 3991, 57.84, 10, 100),
    ("2012-3", 3, 10, 577, 79, 4568, 57.82, 10, 100),
    ("2012-3", 4, 1, 65, 80, 4633, 57.91, 10, 100),
    ("2012-4", 1, 10, 540, 90, 5173, 57.48, 10, 100),
    ("2012-4", 2, 9, 561, 99, 5734, 57.92, 10, 100),
    ("2012-4", 3, 9, 506, 108, 6240, 57.78, 10, 100),
    ("2012-5", 1, 10, 497, 118, 6737, 57.09, 10, 100),
    ("2012-5", 2, 10, 573, 128, 7310, 57.11, 10, 100),
    ("2012-5", 3, 10, 703, 138, 8013, 58.07, 10, 100),
    ("2012-5", 4, 1, 33, 139, 8046, 57.88, 10, 100),
    ("validation", 1, 8, 334, 147, 8380, 57.01, 10, 100),
]


@pytest.mark.parametrize("segment_chunks", [1, 2, 100])
def test_recorded_history(spark, segment_chunks):
    rows = [(int(f == "validation"), f"{f}.csv", b, n, float(s), float(low), float(high)) for f, b, n, s, _, _, _, low, high in RECORDED]
    history = ops.running_history(spark.createDataFrame(rows, METRICS), segment_chunks=segment_chunks)
    found = [
        (r.file_name.removesuffix(".csv"), r.chunk_index, r.batch_rows, r.batch_sum, r.total_accumulated_rows, r.accumulated_sum, round(r.accumulated_avg, 2), r.global_min_price, r.global_max_price)
        for r in history.orderBy("phase", "file_name", "chunk_index").collect()
    ]
    assert found == RECORDED
