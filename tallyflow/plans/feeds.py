"""Raw text rows derived from the given tables, in the shape a CSV source delivers.

``events`` gives one file per day of the month. Day 15 plays the reserved validation
file, whose name sorts before all others although it comes last. Some prices, ids and
dates are made unusable so that coercion and rejection have work on every part.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.operators import assign_chunks, batch_metrics, coerce_rows, ordinals_by_id, ordinals_by_range
from tallyflow.schemas import VALIDATION_FILE_NAME
from tallyflow.sources.discovery import with_phase

EVENT_CHUNK = 10
ORDER_CHUNK = 100
# The first fifteen daily files in processing order end with this one.
LAST_EARLY_FILE = "zday-16.csv"
# Files at most: days of a month and the reserved name; first characters of a priority; months.
DAYS, PRIORITIES, MONTHS = 32, 1 << 16, 1 << 16
# Prices have two decimals, so sums of them can be exact.
SCALE = 2
# Factor that brings prices close to the digits of a double, and their sums beyond.
LARGE = 1_000_003


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id, file_name, phase`` and the three fields as text."""
    event_id, day = F.col("event_id"), F.day("ts")
    daily = F.concat(F.lit("zday-"), F.lpad(day.cast("string"), 2, "0"), F.lit(".csv"))
    no_price = (event_id % 17 == 0) | event_id.between(700, 799) | (day == 20)
    texts = table(spark, sf_dir, "events").select(
        "event_id",
        F.when(day == 15, VALIDATION_FILE_NAME).otherwise(daily).alias("file_name"),
        F.when(event_id % 19 == 0, "not-a-date")
        .otherwise(F.concat_ws("/", F.month("ts"), day, F.year("ts")))
        .alias("ts_raw"),
        F.when(no_price, F.lit(None))
        .when(event_id % 23 == 0, "N/A")
        .when(event_id % 29 == 0, "1,000")
        .otherwise(F.col("value").cast("string"))
        .alias("price_raw"),
        F.when(event_id % 31 == 0, "anon")
        .otherwise(F.col("user_id").cast("string"))
        .alias("user_raw"),
    )
    return with_phase(texts)


def event_rows(spark: SparkSession, sf_dir: str, files: Column | None = None) -> DataFrame:
    """Numbered rows, of some files only where ``files`` says which; they are chosen before
    rows are numbered, which is done file by file."""
    texts = event_texts(spark, sf_dir)
    if files is not None:
        texts = texts.where(files)
    return assign_chunks(ordinals_by_id(texts, "event_id"), EVENT_CHUNK)


def event_coerced(spark: SparkSession, sf_dir: str, files: Column | None = None) -> DataFrame:
    return coerce_rows(event_rows(spark, sf_dir, files))


def event_metrics(spark: SparkSession, sf_dir: str, files: Column | None = None) -> DataFrame:
    return batch_metrics(event_coerced(spark, sf_dir, files), sum_scale=SCALE)


def is_early() -> Column:
    return (F.col("phase") == 0) & (F.col("file_name") <= LAST_EARLY_FILE)


def order_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five sources, one per priority, each holding a large share of all orders."""
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.lit(0).alias("phase"),
        F.concat(F.substring("o_orderpriority", 1, 1), F.lit("-priority.csv")).alias("file_name"),
        F.col("o_orderdate").cast("string").alias("ts_raw"),
        F.when(F.col("o_orderkey") % 13 != 0, F.col("o_totalprice").cast("string")).alias(
            "price_raw"
        ),
        F.col("o_custkey").cast("string").alias("user_raw"),
    )


def order_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = assign_chunks(ordinals_by_id(order_texts(spark, sf_dir), "o_orderkey"), ORDER_CHUNK)
    return batch_metrics(coerce_rows(rows), sum_scale=SCALE)


def sparse_order_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by a digest of their key: ids that lie thinly over 60 bits."""
    digest = F.substring(F.md5(F.col("o_orderkey").cast("string").cast("binary")), 1, 15)
    texts = order_texts(spark, sf_dir).withColumn("sparse_id", F.conv(digest, 16, 10).cast("bigint"))
    rows = assign_chunks(ordinals_by_range(texts, "sparse_id"), ORDER_CHUNK)
    return batch_metrics(coerce_rows(rows), sum_scale=SCALE)


def large_order_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source per month of ordering and one batch per day, with prices so large that
    their sum has more digits than a double holds."""
    ordered = F.col("o_orderdate")
    days = table(spark, sf_dir, "orders").select(
        F.lit(0).alias("phase"),
        F.concat_ws("-", F.year(ordered), F.lpad(F.month(ordered).cast("string"), 2, "0")).alias("file_name"),
        F.day(ordered).cast("bigint").alias("chunk_index"),
        (F.col("o_totalprice").cast("decimal(18,2)") * LARGE).cast("double").alias("price"),
    )
    return batch_metrics(days, sum_scale=SCALE)


def shipment_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source per month and one batch per day of shipping."""
    shipped = F.col("l_shipdate")
    month = F.concat_ws("-", F.year(shipped), F.lpad(F.month(shipped).cast("string"), 2, "0"))
    days = table(spark, sf_dir, "lineitem").select(
        F.lit(0).alias("phase"),
        month.alias("file_name"),
        F.day(shipped).cast("bigint").alias("chunk_index"),
        F.when(F.col("l_quantity") != 13, F.col("l_extendedprice")).alias("price"),
    )
    return batch_metrics(days, sum_scale=SCALE)
