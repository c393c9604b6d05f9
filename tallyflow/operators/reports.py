"""Analytic queries over the stored tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyflow.operators.metrics import accumulated, total


def full_scan_stats(rows: DataFrame, sum_scale: int | None = None) -> DataFrame:
    """Count, mean, min and max over all stored prices, read from the rows themselves."""
    price = F.col("price")
    return (
        rows.where(price.isNotNull())
        .agg(
            F.count("*").alias("row_count"),
            total(price, sum_scale).alias("_sum"),
            F.min(price).alias("min_price"),
            F.max(price).alias("max_price"),
        )
        .select(
            "row_count",
            F.try_divide("_sum", "row_count").alias("avg_price"),
            "min_price",
            "max_price",
        )
    )


def reconciliation(state: DataFrame, scan: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Incremental figures beside full-scan figures, and whether they agree.

    Both inputs are one row; they are stacked and folded, so nothing is joined.
    """
    names = ("row_count", "avg_price", "min_price", "max_price")
    shown = accumulated(state).select(
        F.lit("state").alias("side"),
        F.col("total_rows").alias("row_count"),
        F.col("accumulated_avg").alias("avg_price"),
        F.col("global_min_price").alias("min_price"),
        F.col("global_max_price").alias("max_price"),
    )
    both = shown.unionByName(scan.select(F.lit("scan").alias("side"), *names))
    side_by_side = both.agg(*[
        F.max(F.when(F.col("side") == side, F.col(name))).alias(f"{side}_{name}")
        for side in ("state", "scan")
        for name in names
    ])
    agree = F.lit(True)
    for name in names:
        left, right = F.col(f"state_{name}"), F.col(f"scan_{name}")
        close = F.abs(left - right) <= tolerance * F.greatest(F.abs(left), F.lit(1.0))
        agree = agree & (left.eqNullSafe(right) | F.coalesce(close, F.lit(False)))
    return side_by_side.withColumn("matches", agree)


LOADED = ("loaded_at", "file_name")
#: Stored rows know their place; a clock is the same for all rows of an ingest, and names say nothing of order.
STORED = ("ingest_no", "file_no")


def recent_history(history: DataFrame, k: int = 10) -> DataFrame:
    """The last ``k`` batches. Batches of one ingest share a clock value, so the running
    row count, which grows with every batch, puts them in order."""
    return history.orderBy(
        F.desc("processed_at"), F.desc("total_accumulated_rows"), F.desc("batch_id")
    ).limit(k)


def recent_rows(rows: DataFrame, k: int = 5, load_order: tuple[str, ...] = LOADED) -> DataFrame:
    """``k`` rows of the newest batch or batches, in row order inside a batch."""
    newest = [F.desc(c) for c in (*load_order, "chunk_index")]
    return rows.orderBy(*newest, F.asc("ordinal")).limit(k)


def repeated_batch_ids(history: DataFrame) -> DataFrame:
    """Batch ids stored more than once; empty while the key holds."""
    return history.groupBy("batch_id").agg(F.count("*").alias("n")).where(F.col("n") > 1)
