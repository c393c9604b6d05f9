"""Row positions inside a source, computed without gathering a source in one task."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyflow.session import written

DEFAULT_BUCKET_WIDTH = 1 << 20


def ordinals_by_id(
    rows: DataFrame,
    id_col: str,
    source_col: str = "file_name",
    bucket_width: int = DEFAULT_BUCKET_WIDTH,
) -> DataFrame:
    """Add ``ordinal``: the 0-based position of a row in its source, by a unique integer id.

    Ids are cut into ranges of ``bucket_width``, so a window task holds at most that
    many rows however large one source is. Rows before a range come from a prefix sum
    over one count per (source, range).
    """
    bucket = F.expr(f"{id_col} div {bucket_width}")
    return _ordinals(rows.withColumn("_bucket", bucket), id_col, source_col)


def ordinals_by_range(
    rows: DataFrame,
    id_col: str,
    source_col: str = "file_name",
    range_rows: int = DEFAULT_BUCKET_WIDTH,
) -> DataFrame:
    """``ordinals_by_id`` for ids that lie thinly: ranges hold about equally many rows.

    Spark draws the ranges from a sample of (source, id), so their number follows from
    the rows and not from how far the ids spread. A range may hold several small
    sources; a large one fills many. The rows are stored once, since ranges are drawn
    anew whenever they are asked for.
    """
    ranges = max(-(-rows.count() // range_rows), 1)
    ranged = rows.repartitionByRange(ranges, source_col, id_col).withColumn("_bucket", F.spark_partition_id())
    return _ordinals(written(ranged, "ordinals"), id_col, source_col)


def _ordinals(keyed: DataFrame, id_col: str, source_col: str) -> DataFrame:
    """Positions from ``_bucket``, a number that grows with the id within a source."""
    preceding = (
        Window.partitionBy(source_col)
        .orderBy("_bucket")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        keyed.groupBy(source_col, "_bucket")
        .agg(F.count("*").alias("_n"))
        .select(
            source_col,
            "_bucket",
            F.coalesce(F.sum("_n").over(preceding), F.lit(0)).alias("_before"),
        )
    )
    inside = Window.partitionBy(source_col, "_bucket").orderBy(id_col)
    return (
        keyed.join(offsets, [source_col, "_bucket"])
        .withColumn("ordinal", F.col("_before") + F.row_number().over(inside) - 1)
        .drop("_bucket", "_before")
    )


def assign_chunks(rows: DataFrame, chunk_size: int) -> DataFrame:
    """Add the 1-based ``chunk_index`` of the count-based window a row falls into.

    Counts source rows, so a rejected row still takes up its place.
    """
    if chunk_size <= 0:
        raise ValueError("chunk_size must be greater than zero")
    return rows.withColumn("chunk_index", F.expr(f"ordinal div {chunk_size} + 1"))
