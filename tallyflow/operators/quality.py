"""Coercion and the accept / reject split."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyflow.functions.coerce import (
    DEFAULT_TIMESTAMP_FORMATS,
    number_in,
    parse_timestamp,
    parse_user_id,
    price_from,
)
from tallyflow.schemas import LONG_ROW_REASON, PRICE_REASON


def coerce_rows(
    rows: DataFrame,
    timestamp_formats=DEFAULT_TIMESTAMP_FORMATS,
    finite_only: bool = False,
    strict_ids: bool = False,
) -> DataFrame:
    """Type the three contract columns and set ``reject_reason`` (NULL when accepted).

    Only a missing price, or more fields than the header names, rejects a row; a NULL
    timestamp or user id stays.
    """
    price = price_from(F.col("_price"), F.col("price_raw"), finite_only)
    reason = F.when(F.col("price").isNull(), PRICE_REASON)
    if "too_long" in rows.columns:
        price = F.when(~F.col("too_long"), price)
        reason = F.when(F.col("too_long"), LONG_ROW_REASON).otherwise(reason)
    return (
        # A column of its own, so that the text is parsed once for all its uses.
        rows.withColumn("_price", number_in(F.col("price_raw")))
        .withColumns({
            "timestamp": parse_timestamp(F.col("ts_raw"), timestamp_formats),
            "price": price,
            "user_id": parse_user_id(F.col("user_raw"), strict_ids),
            "raw_price": F.col("price_raw"),
        })
        .withColumn("reject_reason", reason)
        .drop("ts_raw", "price_raw", "user_raw", "too_long", "_price")
    )


def accepted(coerced: DataFrame) -> DataFrame:
    return coerced.where(F.col("price").isNotNull()).drop("reject_reason", "raw_price")


def rejected(coerced: DataFrame) -> DataFrame:
    """Rejects keep the text they carried in ``raw_price``; their ``price`` is always NULL."""
    return coerced.where(F.col("price").isNull()).withColumn(
        "price", F.lit(None).cast("string")
    )


def split_valid_rejected(coerced: DataFrame) -> tuple[DataFrame, DataFrame]:
    return accepted(coerced), rejected(coerced)
