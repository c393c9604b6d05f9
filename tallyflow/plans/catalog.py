"""Every query of the library over the given tables: name to ``(spark, sf_dir) -> DataFrame``."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow import operators as ops
from tallyflow.functions import batch_id, batch_summary_line, file_stem, scan_summary_line
from tallyflow.operators.metrics import EXACT_OF
from tallyflow.plans import feeds, roundtrip
from tallyflow.plans.feeds import SCALE
from tallyflow.session import written
from tallyflow.sources.csv_files import missing_columns
from tallyflow.sources.discovery import pending

# Column names of the history table.
HISTORY_COLUMNS = (
    "batch_id",
    "file_name",
    "chunk_index",
    "batch_rows",
    "total_accumulated_rows",
    "accumulated_sum",
    "accumulated_avg",
    "global_min_price",
    "global_max_price",
)


def chunk_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.event_rows(spark, sf_dir).select("event_id", "file_name", "chunk_index")


def coerced_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Positions are not asked for, so nothing has to be shuffled.
    typed = ops.coerce_rows(feeds.event_texts(spark, sf_dir))
    return typed.select("event_id", "timestamp", "price", "user_id")


def valid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        ops.accepted(feeds.event_coerced(spark, sf_dir))
        .withColumn("file_stem", file_stem(F.col("file_name")))
        .select(
            "event_id", "timestamp", "price", "user_id", "file_name", "chunk_index", "file_stem"
        )
    )


def rejected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.rejected(feeds.event_coerced(spark, sf_dir)).select(
        "event_id",
        "timestamp",
        "price",
        "user_id",
        "file_name",
        "chunk_index",
        "reject_reason",
        "raw_price",
    )


def batch_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches = feeds.event_rows(spark, sf_dir).select("file_name", "chunk_index").distinct()
    return batches.withColumn("batch_id", batch_id(F.col("file_name"), F.col("chunk_index")))


def batch_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.event_metrics(spark, sf_dir).drop("phase", "price_exact")


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.running_history(feeds.event_metrics(spark, sf_dir), sum_scale=SCALE, most_files=feeds.DAYS)


def running_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir).select(*HISTORY_COLUMNS)


def history_from_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History of the later files only, on top of the state the earlier ones left."""
    saved = ops.state_of(feeds.event_metrics(spark, sf_dir, feeds.is_early()), SCALE)
    later = feeds.event_metrics(spark, sf_dir, ~feeds.is_early())
    return ops.running_history(later, saved, sum_scale=SCALE, most_files=feeds.DAYS).select(*HISTORY_COLUMNS)


def final_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State after everything, with its sorted list of files (at most one per day of a month)."""
    rows = ops.coerce_rows(feeds.event_texts(spark, sf_dir))
    per_file = ops.batch_metrics(rows, ("file_name",), SCALE)
    files = per_file.agg(
        F.concat_ws(",", F.array_sort(F.collect_set("file_name"))).alias("processed_files")
    )
    stacked = ops.state_of(per_file, SCALE).drop("global_exact").unionByName(files, allowMissingColumns=True)
    return stacked.agg(*[F.max(name).alias(name) for name in stacked.columns])


def merged_state_two_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ops.coerce_rows(feeds.event_texts(spark, sf_dir))
    metrics = ops.batch_metrics(rows, ("phase", "file_name"), SCALE)
    first = ops.state_of(metrics.where(feeds.is_early()), SCALE)
    second = ops.state_of(metrics.where(~feeds.is_early()), SCALE)
    return ops.accumulated(ops.merge_states(first, second, sum_scale=SCALE))


def exact_state_any_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State after one, two and three runs: merged from theirs, and as the history of the last one ends."""
    metrics = written(feeds.large_order_metrics(spark, sf_dir), "metrics")
    found = []
    for runs in (1, 2, 3):
        run = F.pmod(F.crc32(F.col("file_name")), F.lit(runs))
        states = [ops.state_of(metrics.where(run == n), SCALE) for n in range(runs)]
        merged = ops.merge_states(*states, sum_scale=SCALE)
        before = ops.merge_states(*states[:-1], sum_scale=SCALE) if runs > 1 else None
        history = ops.running_history(metrics.where(run == runs - 1), before, sum_scale=SCALE, most_files=feeds.MONTHS)
        last = history.agg(F.max_by(F.struct("*"), "total_accumulated_rows").alias("h")).select("h.*")
        for way, state, count, total in (
            ("merged", merged, "global_count", "global_sum"),
            ("history", last, "total_accumulated_rows", "accumulated_sum"),
        ):
            found.append(state.select(
                F.lit(runs).cast("bigint").alias("runs"),
                F.lit(way).alias("way"),
                F.col(count).alias("total_rows"),
                F.col(EXACT_OF[total]).cast("string").alias("exact_sum"),
                F.col(total).alias("shown_sum"),
            ))
    return reduce(DataFrame.unionByName, found)


def pending_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = feeds.event_texts(spark, sf_dir).select("phase", "file_name").distinct()
    return pending(files, files.where(feeds.is_early())).orderBy("phase", "file_name").select(
        "file_name"
    )


def missing_columns_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract check on the header each daily file would have.

    A file names ``price`` only if one of its rows has one, and spells the user column
    in capitals when its smallest user id is even.
    """
    headers = (
        feeds.event_texts(spark, sf_dir)
        .groupBy("file_name")
        .agg(
            F.count("price_raw").alias("prices"),
            F.min(F.col("user_raw").try_cast("bigint")).alias("least_user"),
        )
        .select(
            "file_name",
            F.array(
                F.lit("timestamp"),
                F.when(F.col("prices") > 0, "price").otherwise("amount"),
                F.when(F.col("least_user") % 2 == 0, "USER_ID").otherwise("user_id"),
                F.lit("note"),
            ).alias("header"),
        )
    )
    missing = missing_columns(F.col("header"))
    return headers.where(F.size(missing) > 0).select(
        "file_name", F.concat_ws(", ", missing).alias("missing")
    )


def _stored_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.coerce_rows(feeds.event_texts(spark, sf_dir))


def full_scan_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.full_scan_stats(_stored_prices(spark, sf_dir), SCALE)


def scan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return full_scan_stats(spark, sf_dir).select(scan_summary_line().alias("summary"))


def reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State folded from batches against a scan that knows nothing of batches."""
    state = ops.state_of(feeds.event_metrics(spark, sf_dir), SCALE)
    return ops.reconciliation(state, full_scan_stats(spark, sf_dir))


def recent_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last ten batches; every file was loaded one second after the one before."""
    history = _history(spark, sf_dir).withColumn("processed_at", _load_second())
    return ops.recent_history(history, 10).select(*HISTORY_COLUMNS)


def recent_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ops.accepted(feeds.event_coerced(spark, sf_dir)).withColumn(
        "loaded_at", _load_second()
    )
    return ops.recent_rows(rows, 5).select(
        "event_id", "timestamp", "price", "user_id", "file_name", "chunk_index"
    )


def _load_second():
    """A load clock that follows processing order: the day, with the validation file last."""
    day = F.regexp_extract("file_name", r"zday-(\d+)", 1).try_cast("int")
    return F.when(F.col("phase") == 1, 100).otherwise(day)


def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir).select(
        "file_name", "chunk_index", batch_summary_line().alias("summary")
    )


def repeated_batch_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that a history has twice after its early files were loaded once more."""
    history = _history(spark, sf_dir).select("batch_id", "phase", "file_name")
    return ops.repeated_batch_ids(history.unionByName(history.where(feeds.is_early())))


def orders_running_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = feeds.order_metrics(spark, sf_dir)
    return ops.running_history(metrics, sum_scale=SCALE, most_files=feeds.PRIORITIES).select(*HISTORY_COLUMNS)


def sparse_id_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = feeds.sparse_order_metrics(spark, sf_dir)
    return ops.running_history(metrics, sum_scale=SCALE, most_files=feeds.PRIORITIES).select(*HISTORY_COLUMNS)


def shipments_running_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = feeds.shipment_metrics(spark, sf_dir)
    return ops.running_history(metrics, sum_scale=SCALE, most_files=feeds.MONTHS).select(*HISTORY_COLUMNS)


QUERIES = {
    "chunk_assignment": chunk_assignment,
    "coerced_rows": coerced_rows,
    "valid_rows": valid_rows,
    "rejected_rows": rejected_rows,
    "batch_ids": batch_ids,
    "batch_metrics": batch_metrics,
    "running_history": running_history,
    "history_from_state": history_from_state,
    "final_state": final_state,
    "merged_state_two_runs": merged_state_two_runs,
    "exact_state_any_split": exact_state_any_split,
    "pending_files": pending_files,
    "missing_columns": missing_columns_per_file,
    "full_scan_stats": full_scan_stats,
    "scan_summary": scan_summary,
    "reconciliation": reconciliation,
    "recent_history": recent_history,
    "recent_rows": recent_rows,
    "batch_summary": batch_summary,
    "repeated_batch_ids": repeated_batch_ids,
    "orders_running_history": orders_running_history,
    "shipments_running_history": shipments_running_history,
    "sparse_id_history": sparse_id_history,
    "csv_roundtrip_history": roundtrip.ingested_history,
    "csv_roundtrip_raw": roundtrip.ingested_rows,
    "csv_roundtrip_rejects": roundtrip.ingested_rejects,
    "csv_mixed_headers": roundtrip.mixed_headers,
    "ingest_counts": roundtrip.ingest_counts,
    "state_document_roundtrip": roundtrip.state_document_roundtrip,
    "stream_validation_phase": roundtrip.stream_validation_phase,
    "stored_recent_rows": roundtrip.stored_recent_rows,
    "stored_recent_history": roundtrip.stored_recent_history,
    "stream_ingest_state": roundtrip.streamed_state,
    "stream_ingest_reconciliation": roundtrip.streamed_reconciliation,
}
