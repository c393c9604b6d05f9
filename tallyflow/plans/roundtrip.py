"""Events written as real CSV files by Spark and taken in again."""

import re
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.operators.reports import STORED, full_scan_stats, recent_history, recent_rows, reconciliation
from tallyflow.plans.feeds import EVENT_CHUNK, SCALE, event_texts
from tallyflow.schemas import VALIDATION_FILE_NAME
from tallyflow.session import shared_dir
from tallyflow.sources.discovery import list_files
from tallyflow.streaming import IncrementalIngest, IngestOptions, IngestReport, Warehouse

# The same at every size, so that a row's file does not depend on the rest of the table.
ROWS_PER_FILE = 1000

_OPTIONS = IngestOptions(chunk_size=EVENT_CHUNK, sum_scale=SCALE)


def numbered_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """Event texts with the number of the file each row goes to, and the number of files."""
    texts = event_texts(spark, sf_dir)
    top = texts.agg(F.coalesce(F.max("event_id"), F.lit(0)).alias("top")).first()["top"]
    numbered = texts.withColumn("file_no", F.expr(f"cast(event_id div {ROWS_PER_FILE} as int)"))
    return numbered, top // ROWS_PER_FILE + 1


def write_csv(numbered: DataFrame, first: int, end: int, target: str) -> None:
    """Files ``first`` to ``end - 1``, rows by event id; part numbers in names count from 0."""
    (
        numbered.where(F.col("file_no").between(first, end - 1))
        .repartitionById(end - first, F.col("file_no") - first)
        .sortWithinPartitions("event_id")
        .select(
            F.col("ts_raw").alias("timestamp"),
            F.col("price_raw").alias("price"),
            F.col("user_raw").alias("user_id"),
        )
        .write.mode("append")
        .option("header", True)
        .csv(target)
    )


def _part_number(path: str) -> int:
    return int(re.search(r"part-(\d+)-", path).group(1))


def _ingested(spark: SparkSession, sf_dir: str, options: IngestOptions) -> tuple[IncrementalIngest, list[IngestReport]]:
    numbered, n_files = numbered_files(spark, sf_dir)
    source = shared_dir(spark, "events-csv")
    write_csv(numbered, 0, n_files, source)
    ingest = IncrementalIngest(spark, source, shared_dir(spark, "warehouse"), options=options)
    listed = [row["path"] for row in list_files(spark, source).collect()]
    return ingest, ingest.ingest_files(sorted(listed, key=_part_number))


def ingest_written_events(spark: SparkSession, sf_dir: str) -> IncrementalIngest:
    return _ingested(spark, sf_dir, _OPTIONS)[0]


def ingested_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = ingest_written_events(spark, sf_dir).warehouse.history()
    part = F.regexp_extract("file_name", r"part-(\d+)-", 1).cast("bigint")
    return history.select(
        part.alias("file_no"),
        "chunk_index",
        "batch_rows",
        "batch_sum",
        "total_accumulated_rows",
        "accumulated_sum",
        "accumulated_avg",
        "global_min_price",
        "global_max_price",
    )


def ingested_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted rows as stored, but for the clock and the names that hold the part's file name."""
    rows = ingest_written_events(spark, sf_dir).warehouse.raw_transactions()
    part = F.regexp_extract("file_name", r"part-(\d+)-", 1).cast("bigint")
    return rows.select(part.alias("file_no"), "chunk_index", "ordinal", "timestamp", "price", "user_id")


def mixed_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted rows of files that take turns in three headers: plain; reordered with a name that
    holds a comma and quotes; all names quoted, with a name that is empty."""
    fields = {"timestamp": F.col("ts_raw"), "price": F.col("price_raw"), "user_id": F.col("user_raw")}
    note = F.lit("1, 2")
    kinds = (
        ({**fields}, {}),
        ({"user_id": fields["user_id"], 'a "note", twice': note, "price": fields["price"], "timestamp": fields["timestamp"]}, {}),
        ({"price": fields["price"], "timestamp": fields["timestamp"], "": note, "user_id": fields["user_id"]}, {"quoteAll": True}),
    )
    numbered, n_files = numbered_files(spark, sf_dir)
    turn, paths = F.expr(f"cast(file_no div {len(kinds)} as int)"), {}
    for kind, (columns, options) in enumerate(kinds):
        of_kind = len(range(kind, n_files, len(kinds)))
        if not of_kind:
            continue
        target = shared_dir(spark, "mixed-csv")
        (
            numbered.where(F.col("file_no") % len(kinds) == kind)
            .repartitionById(of_kind, turn)
            .sortWithinPartitions("event_id")
            .select(*[value.alias(name) for name, value in columns.items()])
            .write.mode("append")
            .options(header=True, escape='"', **options)
            .csv(target)
        )
        for row in list_files(spark, target).collect():
            paths[_part_number(row["path"]) * len(kinds) + kind] = row["path"]
    ingest = IncrementalIngest(spark, shared_dir(spark, "unused"), shared_dir(spark, "warehouse"), options=_OPTIONS)
    ingest.ingest_files([paths[n] for n in sorted(paths)])
    rows = ingest.warehouse.raw_transactions()
    place = (F.col("ingest_no") - 1) * _OPTIONS.max_files_per_ingest + F.col("file_no") - 1
    return rows.select(place.alias("file_no"), "chunk_index", "ordinal", "timestamp", "price", "user_id")


def ingested_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rejects = ingest_written_events(spark, sf_dir).warehouse.rejected_transactions()
    part = F.regexp_extract("file_name", r"part-(\d+)-", 1).cast("bigint")
    return rejects.select(
        part.alias("file_no"),
        "chunk_index",
        "ordinal",
        "timestamp",
        "price",
        "user_id",
        "reject_reason",
        "raw_price",
    )


def stream_in_two_runs(spark: SparkSession, sf_dir: str) -> IncrementalIngest:
    """Half the files arrive, the stream runs, the rest arrives, it runs again."""
    numbered, n_files = numbered_files(spark, sf_dir)
    source = shared_dir(spark, "events-csv")
    ingest = IncrementalIngest(spark, source, shared_dir(spark, "warehouse"), options=_OPTIONS)
    half = (n_files + 1) // 2
    for first, end in ((0, half), (half, n_files)):
        if first < end:
            write_csv(numbered, first, end, source)
            ingest.run()
    return ingest


def streamed_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _state_and_files(stream_in_two_runs(spark, sf_dir).warehouse)


def _state_and_files(warehouse: Warehouse) -> DataFrame:
    files = warehouse.processed_files().agg(F.count("*").alias("n_files"))
    stacked = warehouse.state().unionByName(files, allowMissingColumns=True)
    return stacked.agg(*[F.max(name).alias(name) for name in stacked.columns])


def streamed_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    warehouse = stream_in_two_runs(spark, sf_dir).warehouse
    scan = full_scan_stats(warehouse.raw_transactions(), SCALE)
    return reconciliation(warehouse.state(), scan)


def ingest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows each ingest counted while it wrote them; three files make an ingest."""
    files = 3
    _, reports = _ingested(spark, sf_dir, replace(_OPTIONS, max_files_per_ingest=files))
    counted = [(r.version, len(r.files), r.rows_accepted, r.rows_rejected) for r in reports]
    return spark.createDataFrame(counted, "version long, n_files long, rows_accepted long, rows_rejected long")


def state_document_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State and number of files of a warehouse that was started from another's state document."""
    document = shared_dir(spark, "state")
    ingest_written_events(spark, sf_dir).warehouse.export_state(document)
    warehouse = Warehouse(spark, shared_dir(spark, "warehouse")).initialize()
    warehouse.import_state(document)
    return _state_and_files(warehouse)


def stream_validation_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History of the reserved file, a copy of the last one, in a run that takes all of them."""
    numbered, n_files = numbered_files(spark, sf_dir)
    source, reserved = shared_dir(spark, "events-csv"), shared_dir(spark, "reserved-csv")
    write_csv(numbered, 0, n_files, source)
    write_csv(numbered, n_files - 1, n_files, reserved)
    _give_name(spark, reserved, f"{source}/{VALIDATION_FILE_NAME}")
    ingest = IncrementalIngest(spark, source, shared_dir(spark, "warehouse"), options=_OPTIONS)
    ingest.run()
    return ingest.warehouse.history().where(F.col("file_name") == VALIDATION_FILE_NAME).select(*_TOTALS)


def _give_name(spark: SparkSession, folder: str, path: str) -> None:
    """Move the one CSV file of a folder to a name Spark would not give it."""
    (found,) = list_files(spark, folder).collect()
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    system = make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.rename(make(found["path"]), make(path)):
        raise OSError(f"could not rename {found['path']}")


def stored_recent_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stream_in_two_runs(spark, sf_dir).warehouse.raw_transactions()
    newest = recent_rows(rows, 5, STORED)
    return newest.select("ingest_no", "file_no", "chunk_index", "ordinal", "timestamp", "price", "user_id")


def stored_recent_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = stream_in_two_runs(spark, sf_dir).warehouse.history()
    return recent_history(history, 10).select("ingest_no", "file_no", *_TOTALS)


_TOTALS = (
    "chunk_index",
    "batch_rows",
    "batch_sum",
    "total_accumulated_rows",
    "accumulated_sum",
    "accumulated_avg",
    "global_min_price",
    "global_max_price",
)
