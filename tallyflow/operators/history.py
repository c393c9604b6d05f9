"""Running totals after every batch, starting from a saved state."""

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyflow.functions.text import batch_id
from tallyflow.operators.metrics import carried
from tallyflow.session import written

DEFAULT_SEGMENT_CHUNKS = 1 << 16
#: Totals that one task puts in order at most.
PREFIX_ROWS = 1 << 16
FILE_ORDER = ("phase", "file_name")


def running_history(
    metrics: DataFrame,
    state: DataFrame | None = None,
    file_order=FILE_ORDER,
    segment_chunks: int = DEFAULT_SEGMENT_CHUNKS,
    sum_scale: int | None = None,
    most_files: int | None = None,
    prefix_rows: int = PREFIX_ROWS,
) -> DataFrame:
    """One row per batch that accepted something, with totals up to and including it.

    Batches are ordered by ``file_order`` and then ``chunk_index``. Levels keep every
    task small: a window inside a segment of ``segment_chunks`` batches of one file, a
    prefix over the segments of a file, and one over the files. The saved state enters
    as the file before the first, so it needs no join of its own.

    One task holds at most about ``prefix_rows`` files. Where ``most_files`` says that
    there are no more, all is lazy; else their totals are stored and counted, and more
    are cut into ranges, whose totals are a level of their own.

    With ``sum_scale`` the rows have ``accumulated_exact`` as well, the total as a decimal.
    """
    keys = [*file_order, "segment"]
    # Stating here what the join below implies keeps both uses of ``batches`` the same
    # plan, so its shuffle is done once and reused.
    present = F.col("row_count") > 0
    for name in (*file_order, "chunk_index"):
        present = present & F.col(name).isNotNull()
    batches = metrics.where(present).withColumn(
        "segment", F.expr(f"coalesce((chunk_index - 1) div {segment_chunks}, 0)")
    )
    price_sum = carried(metrics, "price_sum", sum_scale)

    totals = batches.groupBy(*keys).agg(
        F.sum("row_count").alias("rows"),
        F.sum(price_sum).alias("price_sum"),
        F.min("min_price").alias("low"),
        F.max("max_price").alias("high"),
    )
    in_file = Window.partitionBy(*file_order).orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    segments = totals.select(*keys, *_before(in_file, "_in_file"))
    files = totals.groupBy(*file_order).agg(*[f(c).alias(c) for c, f in _FOLDS.items()], F.lit(1).alias("origin"))
    if state is not None:
        saved = state.select(
            *[F.lit(None).cast(totals.schema[k].dataType).alias(k) for k in file_order],
            F.col("global_count").alias("rows"),
            carried(state, "global_sum", sum_scale).alias("price_sum"),
            F.col("global_min").alias("low"),
            F.col("global_max").alias("high"),
            F.lit(0).alias("origin"),
        )
        files = files.unionByName(saved)
    of_files = prefix(files, ("origin", *file_order), most_files, prefix_rows).where("origin = 1")
    brought = segments.join(of_files.select(*file_order, *[f"{c}_before" for c in _FOLDS]), list(file_order)).select(
        *keys,
        _plus(F.col("rows_before"), F.col("rows_in_file")).alias("rows_before"),
        _plus(F.col("price_sum_before"), F.col("price_sum_in_file"), sum_scale).alias("sum_before"),
        F.least("low_before", "low_in_file").alias("low_before"),
        F.greatest("high_before", "high_in_file").alias("high_before"),
    )

    so_far = (
        Window.partitionBy(*keys)
        .orderBy("chunk_index")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    rows = _plus(F.sum("row_count").over(so_far), F.col("rows_before"))
    amount = _plus(F.sum(price_sum).over(so_far), F.col("sum_before"), sum_scale)
    exact = [] if sum_scale is None else [amount.alias("accumulated_exact")]
    return (
        batches.join(brought, keys)
        .select(
            *file_order,
            *[c for c in ("file_name",) if c not in file_order],
            "chunk_index",
            batch_id(F.col("file_name"), F.col("chunk_index")).alias("batch_id"),
            F.col("row_count").alias("batch_rows"),
            F.col("price_sum").alias("batch_sum"),
            rows.alias("total_accumulated_rows"),
            amount.cast("double").alias("accumulated_sum"),
            *exact,
            F.least(F.min("min_price").over(so_far), "low_before").alias("global_min_price"),
            F.greatest(F.max("max_price").over(so_far), "high_before").alias("global_max_price"),
        )
        .withColumn(
            "accumulated_avg", F.try_divide("accumulated_sum", "total_accumulated_rows")
        )
    )


def prefix(totals: DataFrame, order: tuple[str, ...], most: int | None, limit: int = PREFIX_ROWS, level: int = 0) -> DataFrame:
    """Rows of ``totals`` with the fold of all rows before each, by ``order``, in ``<column>_before``.

    ``most`` bounds the rows; None if nothing is known. Above ``limit`` they are stored in
    ranges of about ``limit`` rows. Each range is one window, and the totals of the ranges
    are prefixed in turn.
    """
    limit = max(limit, 2)  # ranges of one row would be as many again
    if most is None:
        totals = written(totals, "prefix")
        most = totals.count()
    if most <= limit:
        everything = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return totals.select("*", *_before(everything, "_before"))
    # Stored, since ranges are drawn anew whenever they are asked for.
    ranges, name = -(-most // limit), f"_range{level}"
    ranged = written(totals.repartitionByRange(ranges, *order).withColumn(name, F.spark_partition_id()), "prefix")
    of_ranges = ranged.groupBy(name).agg(*[f(c).alias(c) for c, f in _FOLDS.items()])
    brought = prefix(of_ranges, (name,), ranges, limit, level + 1).select(name, *[F.col(f"{c}_before").alias(f"{c}_ranges") for c in _FOLDS])
    inside = Window.partitionBy(name).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    both = ranged.select("*", *_before(inside, "_inside")).join(brought, name)
    scale = getattr(totals.schema["price_sum"].dataType, "scale", None)
    joint = {"rows": _plus, "price_sum": partial(_plus, scale=scale), "low": F.least, "high": F.greatest}
    return both.select(*totals.columns, *[join(F.col(f"{c}_inside"), F.col(f"{c}_ranges")).alias(f"{c}_before") for c, join in joint.items()])


_FOLDS = {"rows": F.sum, "price_sum": F.sum, "low": F.min, "high": F.max}


def _before(window, suffix: str) -> list[Column]:
    return [f(c).over(window).alias(c + suffix) for c, f in _FOLDS.items()]


def _plus(current: Column, before: Column, scale: int | None = None) -> Column:
    """Sum of two, of which a missing one counts as nothing; ``scale`` says that they are decimals."""
    current, before = F.coalesce(current, F.lit(0)), F.coalesce(before, F.lit(0))
    if scale is None:
        return current + before
    # With 38 digits on both sides Spark would give up a place of many for the carry.
    return current.cast(f"decimal(37,{scale})") + before.cast(f"decimal(37,{scale})")
