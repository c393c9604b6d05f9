"""Batch metrics and mergeable running state.

``sum_scale`` makes a sum independent of order: prices are added as decimals with that
many places (more are rounded away). Metrics, states and histories then carry the decimal
beside the double that is shown, and are folded by it, so that a sum is the same however
the rows are split into batches and runs. Without it sums are doubles.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Column of the exact sum beside the double it is shown as.
EXACT_OF = {"price_sum": "price_exact", "global_sum": "global_exact", "accumulated_sum": "accumulated_exact"}

CHUNK_KEYS = ("phase", "file_name", "chunk_index")


def addend(value: Column, sum_scale: int | None, precision: int = 28) -> Column:
    """The value as it is added; one that no decimal of this size holds is an error.

    The error does not depend on the ANSI setting, which would else turn such a price
    into NULL and leave it out of the sum.
    """
    if sum_scale is None:
        return value
    exact = value.try_cast(f"decimal({precision},{sum_scale})")
    failure = F.raise_error(F.concat(F.lit("not exact as a decimal: "), value.cast("string")))
    return F.when(value.isNotNull() & exact.isNull(), failure.cast(f"decimal({precision},{sum_scale})")).otherwise(exact)


def carried(rows: DataFrame, name: str, sum_scale: int | None) -> Column:
    """A sum as it is added to others: exact where ``rows`` have it so, else from the double."""
    if sum_scale is None:
        return F.col(name)
    rounded = addend(F.col(name), sum_scale, 38)
    if EXACT_OF[name] not in rows.columns:
        return rounded
    return F.coalesce(F.col(EXACT_OF[name]).cast(f"decimal(38,{sum_scale})"), rounded)


def total(value: Column, sum_scale: int | None) -> Column:
    """Sum as double; 0 where nothing was added."""
    return F.coalesce(F.sum(addend(value, sum_scale)).cast("double"), F.lit(0.0))


def _totals(value: Column, name: str, sum_scale: int | None) -> list[Column]:
    """The sum as double, and as decimal if it is one; 0 where nothing was added."""
    if sum_scale is None:
        return [F.coalesce(F.sum(value), F.lit(0.0)).alias(name)]
    exact = F.coalesce(F.sum(value), F.lit(0).cast(f"decimal(38,{sum_scale})"))
    return [exact.cast("double").alias(name), exact.alias(EXACT_OF[name])]


def batch_metrics(rows: DataFrame, by=CHUNK_KEYS, sum_scale: int | None = None) -> DataFrame:
    """Count, sum, min and max of the non-missing prices of every batch.

    A batch with no price at all yields 0, 0.0, NULL, NULL.
    """
    if "price" not in rows.columns:
        raise ValueError("a batch must have a 'price' column")
    price = F.col("price")
    return rows.groupBy(*by).agg(
        F.count(price).alias("row_count"),
        *_totals(addend(price, sum_scale), "price_sum", sum_scale),
        F.min(price).alias("min_price"),
        F.max(price).alias("max_price"),
    )


def state_of(metrics: DataFrame, sum_scale: int | None = None) -> DataFrame:
    """Fold batch metrics into one state row (an empty input gives the zero state)."""
    return metrics.agg(
        F.coalesce(F.sum("row_count"), F.lit(0)).alias("global_count"),
        *_totals(carried(metrics, "price_sum", sum_scale), "global_sum", sum_scale),
        F.min("min_price").alias("global_min"),
        F.max("max_price").alias("global_max"),
    )


def merge_states(*states: DataFrame, sum_scale: int | None = None) -> DataFrame:
    """Add any number of states: counts and sums add up, bounds skip NULL."""
    sums = ["global_sum"]
    if sum_scale is not None:
        states = tuple(s.withColumn("global_exact", carried(s, "global_sum", sum_scale)) for s in states)
        sums.append("global_exact")
    stacked = reduce(DataFrame.unionByName, [s.select("global_count", *sums, "global_min", "global_max") for s in states])
    return state_of(
        stacked.select(
            F.col("global_count").alias("row_count"),
            *[F.col(name).alias(name.replace("global", "price")) for name in sums],
            F.col("global_min").alias("min_price"),
            F.col("global_max").alias("max_price"),
        ),
        sum_scale,
    )


def accumulated(state: DataFrame) -> DataFrame:
    """State as shown to users: adds the mean, hides the bounds of an empty state."""
    filled = F.col("global_count") > 0
    return state.select(
        F.col("global_count").alias("total_rows"),
        F.col("global_sum").alias("accumulated_sum"),
        F.try_divide("global_sum", "global_count").alias("accumulated_avg"),
        F.when(filled, F.col("global_min")).alias("global_min_price"),
        F.when(filled, F.col("global_max")).alias("global_max_price"),
    )
