"""Exactly-once incremental ingest of a growing directory of CSV files."""

import hashlib
import re
from dataclasses import dataclass, replace
from datetime import UTC, datetime

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructField, StructType

from tallyflow.functions.coerce import DEFAULT_TIMESTAMP_FORMATS
from tallyflow.functions.text import numbered_batch
from tallyflow.operators.history import DEFAULT_SEGMENT_CHUNKS, running_history
from tallyflow.operators.metrics import batch_metrics
from tallyflow.operators.ordinals import assign_chunks
from tallyflow.operators.quality import coerce_rows
from tallyflow.operators.reports import full_scan_stats, reconciliation
from tallyflow.schemas import (
    EXACT_STATE,
    FILE_LISTING,
    QUARANTINED_FILES,
    STATE,
    STATISTICS_HISTORY,
    TRANSACTIONS,
    VALIDATION_FILE_NAME,
)
from tallyflow.session import prepare
from tallyflow.sources import csv_files
from tallyflow.sources.csv_files import ColumnContractError, Layout
from tallyflow.sources.discovery import (
    discover,
    empty_files,
    list_files,
    literal_path,
    stream_files,
)
from tallyflow.streaming.warehouse import Commit, Warehouse

# How many broken files an error message spells out.
_NAMED_IN_ERROR = 20

# Files and bytes up to which several ingests share one pass over their files.
_PASS_FILES, _PASS_BYTES = 10_000, 8 << 40


class RepeatedBatchError(ValueError):
    """A batch id of the new history stands in the stored history, or twice in the new one."""


@dataclass(frozen=True)
class IngestOptions:
    chunk_size: int = 10
    timestamp_formats: tuple[str, ...] = DEFAULT_TIMESTAMP_FORMATS
    finite_only: bool = False
    strict_ids: bool = False
    multi_line: bool = False
    sum_scale: int | None = None
    quarantine_bad_files: bool = False
    # A file without a byte waits for content, or is an error of ``run``.
    refuse_empty_files: bool = False
    validation_name: str = VALIDATION_FILE_NAME
    segment_chunks: int = DEFAULT_SEGMENT_CHUNKS
    # One ingest takes at most this much; the rest follows in further ingests.
    max_files_per_ingest: int = 10_000
    max_bytes_per_ingest: int = 8 << 40
    # With a limit, files are taken by age across triggers and by path only within one.
    max_files_per_trigger: int | None = None


@dataclass(frozen=True)
class IngestReport:
    ingest_key: str
    version: int
    files: tuple[str, ...]
    rows_accepted: int
    rows_rejected: int
    state: Commit


@dataclass(frozen=True)
class _File:
    path: str
    file_name: str
    length: int
    changed: str = ""


class IncrementalIngest:
    """Loads each new file once and keeps running statistics without rereading old data."""

    def __init__(
        self,
        spark: SparkSession,
        source_dir: str,
        warehouse_dir: str,
        chunk_size: int | None = None,
        options: IngestOptions | None = None,
    ) -> None:
        self.spark = prepare(spark)
        self.source_dir = source_dir.rstrip("/")
        self.warehouse = Warehouse(spark, warehouse_dir).initialize()
        if options is not None and chunk_size not in (None, options.chunk_size):
            options = replace(options, chunk_size=chunk_size)
        self.options = options or IngestOptions(**({} if chunk_size is None else {"chunk_size": chunk_size}))
        # Surveys made ahead of their ingest, by key; only their numbers are held here.
        self._surveys: dict[str, tuple[DataFrame, Layout]] = {}
        if self.options.chunk_size <= 0:
            raise ValueError("chunk_size must be greater than zero")

    # Entry points

    def run(self) -> list[IngestReport]:
        """Take everything that has arrived and stop: source files, then the reserved file."""
        discover(self.spark, self.source_dir, validation_name=self.options.validation_name)
        if self.options.refuse_empty_files:
            self._refuse_empty()
        reports = self._drain("source", "*.csv", self._source_files)
        reports += self._drain(
            "validation", literal_path(self.options.validation_name), self._validation_files
        )
        return reports

    def ingest_files(
        self, paths, initial_state: DataFrame | None = None
    ) -> list[IngestReport]:
        """Batch twin of the stream: the given files, in the given order, unless done already.

        Totals go on from ``initial_state`` (one row) if given, else from the saved state.
        """
        paths = list(paths)
        if not paths:
            return []
        start = None
        if initial_state is not None:
            start = initial_state.select(*STATE.names).first().asDict()
            if "global_exact" in initial_state.columns:
                start["global_exact"] = initial_state.select(F.col("global_exact").cast("string")).first()[0]
        # As many as were given, done ones too: each path must be found.
        listing = list_files(self.spark, map(literal_path, paths), glob="*")
        ordered = _in_given_order(self._collect(listing), paths)
        undone = {file.file_name for file in self._collect(self.warehouse.pending(listing))}
        return self._ingest_pending([f for f in ordered if f.file_name in undone], start)

    def discover(self, include_validation: bool = False) -> DataFrame:
        return discover(
            self.spark, self.source_dir, include_validation, self.options.validation_name
        )

    def reconcile(self) -> DataFrame:
        """Running state beside a full aggregate over the stored rows."""
        scan = full_scan_stats(self.warehouse.raw_transactions(), self.options.sum_scale)
        return reconciliation(self.warehouse.state(), scan)

    def start(self, processing_time: str = "1 minute") -> StreamingQuery:
        """Keep taking source files as they arrive, until the query is stopped."""
        trigger = {"processingTime": processing_time}
        return self._arrivals("source", "*.csv", self._ingest_pending, trigger)

    def empty_files(self) -> DataFrame:
        """``path, file_name`` of files that wait for content: without a byte, and not done."""
        return self.warehouse.pending(empty_files(self.spark, literal_path(self.source_dir)))

    def _refuse_empty(self) -> None:
        empty = self.empty_files()
        shown = [row["file_name"] for row in empty.orderBy("path").limit(_NAMED_IN_ERROR).collect()]
        if shown:
            raise ColumnContractError(f"no columns to read in {empty.count()} file(s): {', '.join(shown)}")

    # Streaming

    def _arrivals(self, phase: str, glob: str, take, trigger: dict) -> StreamingQuery:
        def on_arrival(files: DataFrame, _batch: int) -> None:
            take(self._unseen(files.where(self._in_phase(phase))))

        limit = self.options.max_files_per_trigger
        return (
            stream_files(self.spark, self.source_dir, glob, limit)
            .writeStream.foreachBatch(on_arrival)
            .option("checkpointLocation", self.warehouse.path(f"_checkpoints/{phase}"))
            .trigger(**trigger)
            .start()
        )

    def _drain(self, phase: str, glob: str, unseen) -> list[IngestReport]:
        """One available-now query, then a look for files its log missed.

        The look covers a file repaired in place after quarantine and one that was
        still empty when its name first appeared.
        """
        reports: list[IngestReport] = []
        failures: list[Exception] = []

        def take(arrived: list[_File]) -> None:
            try:
                reports.extend(self._ingest_pending(arrived))
            except Exception as error:
                failures.append(error)
                raise

        query = self._arrivals(phase, glob, take, {"availableNow": True})
        try:
            query.awaitTermination()
        except StreamingQueryException as wrapped:
            raise (failures[0] if failures else wrapped) from wrapped
        reports.extend(self._ingest_pending(self._unseen(unseen())))
        return reports

    def _unseen(self, files: DataFrame) -> list[_File]:
        """Files not done yet, by path. What is done leaves before anything reaches the driver."""
        return self._collect(self.warehouse.pending(files).orderBy("path"))

    def _in_phase(self, phase: str):
        reserved = F.col("file_name") == self.options.validation_name
        return reserved if phase == "validation" else ~reserved

    def _source_files(self) -> DataFrame:
        files = list_files(self.spark, literal_path(self.source_dir))
        return files.where(self._in_phase("source"))

    def _validation_files(self) -> DataFrame:
        return list_files(self.spark, literal_path(self.source_dir), literal_path(self.options.validation_name))

    # One ingest

    def _collect(self, files: DataFrame) -> list[_File]:
        """File names reach the driver anyway, to be handed to a reader; rows never do."""
        return [_File(r["path"], r["file_name"], r["length"], str(r["changed"])) for r in files.collect()]

    def _ingest_pending(
        self, files: list[_File], start: dict | None = None
    ) -> list[IngestReport]:
        """Files whose names are not done, in this order; of equal names the first counts."""
        chosen: dict[str, _File] = {}
        for file in files:
            chosen.setdefault(file.file_name, file)
        reports = []
        groups = list(self._groups(list(chosen.values())))
        passes = list(_passes(groups))
        if len(groups) > 1 and not self.options.quarantine_bad_files:
            # What aborts must do so before anything is committed, however the work is split.
            for together in passes:
                self._surveyed(together)
        for together in passes:
            made = self._ingest(together, start)
            if made:
                reports += made
                start = None
        return reports

    def _listing(self, files: list[_File]) -> DataFrame:
        rows = [(f.path, f.file_name, f.length, f.changed) for f in files]
        return self.spark.createDataFrame(rows, FILE_LISTING)

    def _groups(self, files: list[_File]):
        group: list[_File] = []
        size = 0
        for file in files:
            full = len(group) >= self.options.max_files_per_ingest
            if group and (full or size + file.length > self.options.max_bytes_per_ingest):
                yield group
                group, size = [], 0
            group.append(file)
            size += file.length
        if group:
            yield group

    def _ingest(self, groups: list[list[_File]], start: dict | None) -> list[IngestReport]:
        """One ingest for each group of files, each with its key and commit, in one pass over all of them."""
        survey, blocks, layout, intact = self._surveyed(groups)
        if intact != groups:
            return self._ingest(intact, start) if intact else []

        previous = self.warehouse.latest_commit()
        if start:
            previous = replace(previous, **{"global_exact": None, **start})
        clock = F.lit(datetime.now(UTC).replace(tzinfo=None).isoformat(" ")).cast("timestamp_ntz")
        keys = {previous.version + k: _ingest_key(group, self.options) for k, group in enumerate(groups, 1)}
        # At most max_files_per_ingest rows, or _PASS_FILES.
        placed = [(f.file_name, n, no, key) for (no, key), group in zip(keys.items(), groups, strict=True) for n, f in enumerate(group, 1)]
        places = F.broadcast(self.spark.createDataFrame(placed, "file_name string, file_no long, ingest_no long, ingest_key string"))
        files = [f for group in groups for f in group]
        counts = self._write_transactions(files, list(keys.values()), places, blocks, layout, clock)
        self._write_history(places, len(files), list(keys.values()), previous, clock)
        del self._surveys[survey]
        refused = self._repeated_ids(list(keys.values()), [f.file_name for f in files])
        made, reports = [], []
        last = self._last_rows(list(keys.values()))
        for (no, key), group in zip(keys.items(), groups, strict=True):
            if refused and no >= refused[0]:
                break
            previous = self._next_commit(last.get(no), previous)
            names = [f.file_name for f in group]
            made.append((previous, key, names))
            reports.append(IngestReport(key, previous.version, tuple(names), *counts[key], previous))
        if len(made) == 1:
            self.warehouse.append_commit(*made[0])
        elif made:
            self.warehouse.append_commits(made)
        if refused:
            raise RepeatedBatchError(f"batch ids stored already: {', '.join(refused[1])}")
        return reports

    def _repeated_ids(self, keys: list[str], names: list[str]) -> tuple[int, list[str]] | None:
        """A batch id is a key of the history: one that is there already must not count again.

        The first ingest that has such ids, and some of them.
        """
        repeated = self.warehouse.repeated_batch_ids(keys, names)
        if repeated.isEmpty():
            return None
        having = self.warehouse.uncommitted_history(*keys).join(repeated, "batch_id").groupBy("batch_id").agg(F.max("ingest_no").alias("ingest_no"))
        first = having.agg(F.min("ingest_no")).first()[0]
        shown = having.where(F.col("ingest_no") == first).orderBy("batch_id").limit(_NAMED_IN_ERROR).collect()
        return first, [row["batch_id"] for row in shown]

    def _surveyed(self, groups: list[list[_File]]) -> tuple[str, DataFrame, Layout, list[list[_File]]]:
        """Key and survey of some groups of files, and what of them keeps the column contract."""
        files = [f for group in groups for f in group]
        keys = [_ingest_key(group, self.options) for group in groups]
        key = keys[0] if len(keys) == 1 else hashlib.sha256(repr(keys).encode()).hexdigest()[:16]
        if key not in self._surveys:
            self._surveys = {k: self._surveys[k] for k in list(self._surveys)[-1000:]}
            self._surveys[key] = self._survey(files, key)
        blocks, layout = self._surveys[key]
        if layout.broken_count or layout.file_count < len(files):
            broken = csv_files.broken_files(self._listing(files), blocks)
            del self._surveys[key]
            return key, blocks, layout, self._set_aside(groups, keys, broken)
        return key, blocks, layout, groups

    def _survey(self, files: list[_File], key: str) -> tuple[DataFrame, Layout]:
        """First pass, stored: later steps must all see the same split table."""
        paths = [literal_path(f.path) for f in files]
        self._store_blocks(csv_files.survey_blocks(csv_files.line_scan(self.spark, paths)), key)
        blocks = self.warehouse.source_blocks(key)
        layout = csv_files.read_layout(blocks)
        if not self.options.multi_line:
            return blocks, layout
        records = csv_files.survey_records(self.spark, paths, blocks, layout.width)
        self._store_blocks(records, f"{key}-records")
        return self.warehouse.source_blocks(f"{key}-records"), layout

    def _store_blocks(self, blocks: DataFrame, key: str) -> None:
        self.warehouse.replace_partitions(
            blocks.withColumn("ingest_key", F.lit(key)), "source_blocks", "ingest_key"
        )

    def _set_aside(self, groups: list[list[_File]], keys: list[str], broken: DataFrame) -> list[list[_File]]:
        """Abort on broken files, or record them and go on with the others."""
        names = {row["file_name"] for row in broken.select("file_name").collect()}
        bad = [f for group in groups for f in group if f.file_name in names]
        if not self.options.quarantine_bad_files:
            shown = self._with_missing(bad[:_NAMED_IN_ERROR]).orderBy("path").collect()
            described = "; ".join(f"{r['file_name']}: {', '.join(r['missing'])}" for r in shown)
            raise ColumnContractError(
                f"missing required columns in {len(bad)} file(s): {described}"
            )
        of = [(f.file_name, key) for group, key in zip(groups, keys, strict=True) for f in group if f.file_name in names]
        aside = self._with_missing(bad).join(F.broadcast(self.spark.createDataFrame(of, "file_name string, ingest_key string")), "file_name")
        self.warehouse.replace_partitions(
            aside.select(*QUARANTINED_FILES.names), "quarantined_files", "file_name"
        )
        intact = [[f for f in group if f.file_name not in names] for group in groups]
        return [group for group in intact if group]

    def _with_missing(self, files: list[_File]) -> DataFrame:
        paths = [literal_path(f.path) for f in files]
        return csv_files.with_missing(self.spark, self._listing(files), paths)

    def _write_transactions(self, files, keys, places, blocks, layout, clock) -> dict[str, tuple[int, int]]:
        """Second pass: one job that writes accepted and rejected rows side by side.

        Gives the accepted and rejected rows of each ingest.
        """
        options = self.options
        raw = csv_files.read_source_rows(
            self.spark,
            [literal_path(f.path) for f in files],
            blocks,
            layout,
            options.multi_line,
        )
        typed = coerce_rows(
            assign_chunks(raw, options.chunk_size),
            options.timestamp_formats,
            options.finite_only,
            options.strict_ids,
        )
        is_rejected = F.col("reject_reason").isNotNull()
        rows = typed.join(places, "file_name").withColumns({
            "loaded_at": clock,
            "batch_id": numbered_batch(
                F.col("batch_prefix"), F.col("chunk_index"), F.col("batch_suffix")
            ),
            "raw_price": F.when(is_rejected, F.col("raw_price")),
            "branch": F.when(is_rejected, "rejected").otherwise("raw"),
        }).select(*TRANSACTIONS.names)
        # Only a rejected row has no price.
        counts = Observation()
        observed = rows.observe(
            counts, F.count(F.lit(1)).alias("rows"), F.count("price").alias("accepted")
        )
        self.warehouse.replace_partitions(observed, "transactions", "branch", "ingest_key")
        accepted, rejected = counts.get["accepted"], counts.get["rows"] - counts.get["accepted"]
        if len(keys) == 1:
            return {keys[0]: (accepted, rejected)}
        # Of several ingests only the total is observed; their shares are counted in their folders.
        shares = self.warehouse.uncommitted_counts(keys)
        if (sum(a for a, _ in shares.values()), sum(r for _, r in shares.values())) != (accepted, rejected):
            raise RuntimeError("stored rows are not those that were written")
        return {key: shares.get(key, (0, 0)) for key in keys}

    def _write_history(self, places, n_files: int, keys: list[str], previous: Commit, clock) -> None:
        """Batch metrics from the columns just written, then totals on top of the saved state."""
        options = self.options
        written = self.warehouse.uncommitted_raw(*keys)
        metrics = batch_metrics(written, ("file_name", "chunk_index"), options.sum_scale)
        kinds = StructType([*STATE, StructField(*EXACT_STATE)])
        state = self.spark.createDataFrame([tuple(getattr(previous, name) for name in kinds.names)], kinds)
        history = running_history(
            metrics.join(places.drop("ingest_key"), "file_name"),
            state,
            file_order=("ingest_no", "file_no"),
            segment_chunks=options.segment_chunks,
            sum_scale=options.sum_scale,
            most_files=n_files,
        ).withColumn("processed_at", clock)
        history = history.join(places.select("file_name", "ingest_key"), "file_name")
        exact = F.lit(None) if options.sum_scale is None else F.col("accumulated_exact")
        history = history.withColumn("accumulated_exact", exact.cast("string"))
        self.warehouse.replace_partitions(
            history.select(*STATISTICS_HISTORY.names), "history", "ingest_key"
        )

    def _last_rows(self, keys: list[str]) -> dict[int, Row]:
        """The last history row of each ingest that has one, by its number."""
        shown = F.struct("total_accumulated_rows", "accumulated_sum", "global_min_price", "global_max_price", "accumulated_exact")
        rows = self.warehouse.uncommitted_history(*keys)
        last = rows.groupBy("ingest_no").agg(F.max_by(shown, "total_accumulated_rows").alias("last")).collect()
        return {row["ingest_no"]: row["last"] for row in last}

    def _next_commit(self, last: Row | None, previous: Commit) -> Commit:
        """The last history row is the new state; without one nothing was accepted."""
        if last is None:
            return replace(previous, version=previous.version + 1)
        return Commit(previous.version + 1, *last)


def _passes(groups: list[list[_File]]):
    """Runs of groups that are taken in one pass: as many as its limits hold, or one larger group."""
    together: list[list[_File]] = []
    files, size = 0, 0
    for group in groups:
        more = sum(f.length for f in group)
        if together and (files + len(group) > _PASS_FILES or size + more > _PASS_BYTES):
            yield together
            together, files, size = [], 0, 0
        together.append(group)
        files, size = files + len(group), size + more
    if together:
        yield together


def _ingest_key(files: list[_File], options: IngestOptions) -> str:
    """Names the work, not the attempt, so a replay finds its own partitions.

    Options, file sizes and times of change are part of it: partitions of an abandoned
    attempt that would have come out differently are never taken for those of this one.
    """
    work = [(f.file_name, f.length, f.changed) for f in sorted(files, key=lambda f: f.file_name)]
    return hashlib.sha256(repr((work, options)).encode()).hexdigest()[:16]


def _in_given_order(files: list[_File], paths: list[str]) -> list[_File]:
    """Listed files by the position of the path that asked for them.

    Listed paths are qualified, given ones need not be. A given path that lists
    nothing is a file without content, hence without columns.
    """
    wanted: dict[str, list[tuple[int, str]]] = {}
    for position, path in enumerate(paths):
        tail = "/" + re.sub(r"^\w+:/*", "", path).lstrip("/")
        wanted.setdefault(tail.rsplit("/", 1)[-1], []).append((position, tail))
    # Of several listed paths that end like a given one, the shortest is meant: the others
    # lie in folders below it.
    placed = []
    named: dict[str, list[_File]] = {}
    for file in files:
        named.setdefault(file.file_name, []).append(file)
    for name, tails in wanted.items():
        same = named.get(name, [])
        for position, tail in tails:
            ends = [f for f in same if ("/" + f.path.lstrip("/")).endswith(tail)]
            if ends:
                placed.append((position, min(ends, key=lambda f: len(f.path))))
    absent = set(range(len(paths))) - {position for position, _ in placed}
    if absent:
        raise ColumnContractError(f"no columns to read in {paths[min(absent)]}")
    return [file for _, file in sorted(placed, key=lambda pair: pair[0])]
