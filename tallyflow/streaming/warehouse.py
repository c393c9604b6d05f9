"""Parquet tables of one ingest target.

Data tables are partitioned by ``ingest_key``, which names the set of files of one
ingest. A row counts only if its key is committed; a commit is written last, so a
half-written ingest is invisible and a replay overwrites its own partitions.

Commits are one small file each, in folders of ``snapshot_every`` commits (epochs). When
an epoch is full, a snapshot takes up all commits so far: the names of the files done, in
folders by a hash of the name, and the keys with their states. What is read is the newest
snapshot and the epochs after it, so the files opened don't grow with the commits. A crash
between a commit and its snapshot costs nothing: a later snapshot takes up the epoch, and
one that is incomplete is not looked at.
"""

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from tallyflow import schemas
from tallyflow.session import remove
from tallyflow.sources.discovery import pending


@dataclass(frozen=True)
class Commit:
    """The newest state row, held on the driver."""

    version: int = 0
    global_count: int = 0
    global_sum: float = 0.0
    global_min: float | None = None
    global_max: float | None = None
    #: The sum as decimal text, if sums are decimals.
    global_exact: str | None = None


#: Commits of an epoch, folders over which the names of a snapshot are spread, snapshots kept.
SNAPSHOT_EVERY, NAME_BUCKETS, KEPT_SNAPSHOTS = 64, 64, 3


def name_bucket(file_name="file_name"):
    return F.pmod(F.xxhash64(file_name), F.lit(NAME_BUCKETS)).cast("int")


class Warehouse:
    def __init__(self, spark: SparkSession, root: str, snapshot_every: int = SNAPSHOT_EVERY) -> None:
        self.spark = spark
        self.root = root.rstrip("/")
        self.snapshot_every = snapshot_every

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def initialize(self) -> "Warehouse":
        """Create the tables that do not exist yet."""
        tables = {
            "transactions": (schemas.TRANSACTIONS, ["branch", "ingest_key"]),
            "history": (schemas.STATISTICS_HISTORY, ["ingest_key"]),
            "source_blocks": (schemas.SOURCE_BLOCKS, ["ingest_key"]),
            "quarantined_files": (schemas.QUARANTINED_FILES, ["file_name"]),
        }
        for name, (schema, keys) in tables.items():
            empty = self.spark.createDataFrame([], schema)
            empty.write.mode("ignore").partitionBy(*keys).parquet(self.path(name))
        return self

    # Reading

    def _stored(self, table: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path(table))

    def _exists(self, path: str) -> bool:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def _snapshots(self) -> list[int]:
        """Last epochs of the complete snapshots, the newest first."""
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path("snapshots"), "upto=*/keys/_SUCCESS")
        system = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = system.globStatus(where) or []
        return sorted((int(f.getPath().getParent().getParent().getName().partition("=")[2]) for f in found), reverse=True)

    def _log(self) -> tuple[int | None, DataFrame]:
        """Newest snapshot, if any, and the commits after it."""
        newest = next(iter(self._snapshots()), None)
        epoch = 0 if newest is None else newest + 1
        folders = []
        while self._exists(folder := self.path(f"commits/epoch={epoch}")):
            folders.append(folder)
            epoch += 1
        if not folders:
            return newest, self.spark.createDataFrame([], schemas.COMMITS)
        return newest, self.spark.read.schema(schemas.COMMITS).parquet(*folders)

    def _snapshot(self, upto: int, part: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path(f"snapshots/upto={upto}/{part}"))

    def commits(self) -> DataFrame:
        """version, ingest_key and state of every commit."""
        newest, tail = self._log()
        return self._with_tail(newest, tail)

    def _with_tail(self, newest: int | None, tail: DataFrame) -> DataFrame:
        tail = tail.select(*schemas.COMMIT_KEYS.names)
        return tail if newest is None else self._snapshot(newest, "keys", schemas.COMMIT_KEYS).unionByName(tail)

    def _committed(self, table: DataFrame) -> DataFrame:
        return table.join(self.commits().select("ingest_key"), "ingest_key", "left_semi")

    def _of_keys(self, table: str, schema, ingest_keys: Iterable[str], *before: str) -> DataFrame:
        """Rows of some ingests, from their own folders: what earlier ones wrote is not even listed."""
        folders = ["/".join([self.path(table), *before, f"ingest_key={key}"]) for key in ingest_keys]
        folders = [folder for folder in folders if self._exists(folder)]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self.path(table)).parquet(*folders)

    def uncommitted_raw(self, *ingest_keys: str) -> DataFrame:
        return self._of_keys("transactions", schemas.TRANSACTIONS, ingest_keys, "branch=raw")

    def uncommitted_counts(self, ingest_keys: list[str]) -> dict[str, tuple[int, int]]:
        """Accepted and rejected rows that some ingests have stored; one row per ingest."""
        branches = [self._of_keys("transactions", schemas.TRANSACTIONS, ingest_keys, f"branch={b}").groupBy("ingest_key").agg(F.count("*").alias(b)) for b in ("raw", "rejected")]
        both = branches[0].join(branches[1], "ingest_key", "full").na.fill(0, ["raw", "rejected"])
        return {row["ingest_key"]: (row["raw"], row["rejected"]) for row in both.collect()}

    def raw_transactions(self) -> DataFrame:
        stored = self._stored("transactions", schemas.TRANSACTIONS).where("branch = 'raw'")
        return self._committed(stored).select(*schemas.RAW_TRANSACTIONS.names)

    def rejected_transactions(self) -> DataFrame:
        stored = self._stored("transactions", schemas.TRANSACTIONS).where("branch = 'rejected'")
        return (
            self._committed(stored)
            .withColumn("price", F.lit(None).cast("string"))
            .select(*schemas.REJECTED_TRANSACTIONS.names)
        )

    def history(self) -> DataFrame:
        stored = self._stored("history", schemas.STATISTICS_HISTORY)
        return self._committed(stored).select(*schemas.STATISTICS_HISTORY.names)

    def repeated_batch_ids(self, ingest_keys: list[str], names: list[str]) -> DataFrame:
        """Batch ids of ingests under way that they have twice, or that committed history has already.

        An id names its file, so only history of the same files is looked at.
        """
        new = self.uncommitted_history(*ingest_keys).select("batch_id")
        twice = new.groupBy("batch_id").agg(F.count("*").alias("n")).where("n > 1").select("batch_id")
        files = self.spark.createDataFrame([(name,) for name in names], "file_name string")
        stored = self.history().where(~F.col("ingest_key").isin(ingest_keys)).join(F.broadcast(files), "file_name", "left_semi")
        return twice.unionByName(new.join(stored.select("batch_id"), "batch_id", "left_semi")).distinct()

    def uncommitted_history(self, *ingest_keys: str) -> DataFrame:
        return self._of_keys("history", schemas.STATISTICS_HISTORY, ingest_keys)

    def source_blocks(self, ingest_key: str) -> DataFrame:
        return self._of_keys("source_blocks", schemas.SOURCE_BLOCKS, [ingest_key]).drop("ingest_key")

    def quarantined_files(self) -> DataFrame:
        """Files set aside and not taken since."""
        stored = self._stored("quarantined_files", schemas.QUARANTINED_FILES)
        return stored.join(self.processed_files(), "file_name", "left_anti")

    def processed_files(self, buckets: list[int] | None = None) -> DataFrame:
        """Names of all files done, one per row; of a snapshot those of some buckets only."""
        newest, tail = self._log()
        names = tail.select(F.explode("files").alias("file_name"))
        if newest is None:
            return names
        held = self._snapshot(newest, "names", schemas.DONE_NAMES)
        if buckets is not None:
            held = held.where(F.col("bucket").isin(buckets))
        return held.select("file_name").unionByName(names)

    def pending(self, files: DataFrame) -> DataFrame:
        """Files whose name is not done yet; only the buckets of a snapshot they fall into are read."""
        buckets = None
        if self._snapshots():
            # At most NAME_BUCKETS rows.
            buckets = [row["bucket"] for row in files.select(name_bucket().alias("bucket")).distinct().collect()]
        return pending(files, self.processed_files(buckets))

    def state(self, exact: bool = False) -> DataFrame:
        """The newest state as one row; the zero state before the first commit.

        ``exact`` adds ``global_exact``, the sum as decimal text, NULL if sums are doubles.
        """
        newest = self.commits().orderBy(F.desc("version")).limit(1)
        return newest.groupBy().agg(
            F.coalesce(F.max("global_count"), F.lit(0)).alias("global_count"),
            F.coalesce(F.max("global_sum"), F.lit(0.0)).alias("global_sum"),
            F.max("global_min").alias("global_min"),
            F.max("global_max").alias("global_max"),
            *([F.max("global_exact").alias("global_exact")] if exact else []),
        )

    def latest_commit(self) -> Commit:
        newest, tail = self._log()
        names = [c for c in schemas.COMMIT_KEYS.names if c != "ingest_key"]
        row = tail.orderBy(F.desc("version")).select(*names).limit(1).first()
        if row is None and newest is not None:
            row = self._snapshot(newest, "keys", schemas.COMMIT_KEYS).orderBy(F.desc("version")).select(*names).limit(1).first()
        return Commit(**row.asDict()) if row else Commit()

    # Writing

    def replace_partitions(self, rows: DataFrame, table: str, *keys: str) -> None:
        (
            rows.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(*keys)
            .parquet(self.path(table))
        )

    def append_commit(self, commit: Commit, ingest_key: str, files: list[str]) -> None:
        """Makes one ingest count. One row in one file, so it appears whole or not at all."""
        self.append_commits([(commit, ingest_key, files)])

    def append_commits(self, made: list[tuple[Commit, str, list[str]]]) -> None:
        """Makes ingests count, in their order: those of an epoch are one file, and epochs follow each other."""
        epochs: dict[int, list[tuple]] = {}
        for commit, ingest_key, files in made:
            row = (
                commit.version,
                ingest_key,
                commit.global_count,
                commit.global_sum,
                commit.global_min,
                commit.global_max,
                commit.global_exact,
                files,
            )
            epochs.setdefault((commit.version - 1) // self.snapshot_every, []).append(row)
        for rows in epochs.values():
            self._append(self.spark.createDataFrame(rows, schemas.COMMITS), rows[0][0])
        if any(commit.version % self.snapshot_every == 0 for commit, _, _ in made):
            self.take_snapshot()

    def _append(self, rows: DataFrame, version: int) -> None:
        epoch = (version - 1) // self.snapshot_every
        rows.coalesce(1).write.mode("append").parquet(self.path(f"commits/epoch={epoch}"))

    def take_snapshot(self) -> None:
        """Names and keys of all full epochs as new tables; the keys last, they make it count."""
        newest, tail = self._log()
        last = tail.agg(F.max("version")).first()[0]
        upto = last // self.snapshot_every - 1 if last else -1
        if upto < 0 or upto == newest:
            return
        full = tail.where(F.col("version") <= (upto + 1) * self.snapshot_every)
        names = full.select(F.explode("files").alias("file_name")).withColumn("bucket", name_bucket())
        if newest is not None:
            names = self._snapshot(newest, "names", schemas.DONE_NAMES).unionByName(names)
        folder = self.path(f"snapshots/upto={upto}")
        names.repartition(NAME_BUCKETS, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/names")
        self._with_tail(newest, full).repartition(1).write.mode("overwrite").parquet(f"{folder}/keys")
        for old in self._snapshots()[KEPT_SNAPSHOTS:]:
            remove(self.spark, self.path(f"snapshots/upto={old}"))

    # State documents

    def state_document(self) -> DataFrame:
        """State as one JSON text: keys and file names sorted, empty bounds as infinities.

        ``global_exact`` is there only if sums are decimals.
        """
        state = self.state(exact=True)
        files = self.processed_files().agg(
            F.array_sort(F.collect_set("file_name")).alias("processed_files")
        )
        # Both sides are one row; stacking and folding them needs no join.
        both = state.unionByName(files, allowMissingColumns=True).agg(
            F.max("global_count").alias("global_count"),
            F.max("global_exact").alias("global_exact"),
            F.coalesce(F.max("global_max"), F.lit(float("-inf"))).alias("global_max"),
            F.coalesce(F.max("global_min"), F.lit(float("inf"))).alias("global_min"),
            F.max("global_sum").alias("global_sum"),
            F.max("processed_files").alias("processed_files"),
        )
        return both.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("value"))

    def export_state(self, path: str) -> None:
        self.state_document().coalesce(1).write.mode("overwrite").text(path)

    def import_state(self, path: str) -> None:
        """Starts an empty warehouse from a state document written elsewhere.

        Missing keys take the values of an empty state. An exact sum counts only while the
        double beside it is the same figure, as it is not if another tool went on from there.
        """
        if not self.commits().isEmpty():
            raise ValueError("a state can only be imported into an empty warehouse")
        text = self.spark.read.text(path, wholetext=True)
        # A schema instead of a walk through the document: absent keys are NULL, and names
        # given as numbers are read as text.
        fields = [*schemas.STATE, StructField(*schemas.EXACT_STATE), StructField("processed_files", ArrayType(StringType())), StructField("unfit", StringType())]
        parsed = F.from_json("value", StructType(fields), {"columnNameOfCorruptRecord": "unfit"})
        document = text.select(parsed.alias("d"))
        if not document.where("d IS NULL OR d.unfit IS NOT NULL").isEmpty():
            raise ValueError(f"not a state document: {path}")
        document = document.select("d.*")
        filled = F.col("global_count") > 0
        row = document.select(
            F.lit(1).cast("long").alias("version"),
            F.lit("imported").alias("ingest_key"),
            F.coalesce("global_count", F.lit(0)).alias("global_count"),
            F.coalesce("global_sum", F.lit(0.0)).alias("global_sum"),
            F.when(filled, F.col("global_min")).alias("global_min"),
            F.when(filled, F.col("global_max")).alias("global_max"),
            F.when(F.col("global_exact").try_cast("double") == F.col("global_sum"), F.col("global_exact")).alias("global_exact"),
            F.array_distinct(F.coalesce("processed_files", F.array().cast("array<string>"))).alias("files"),
        )
        self._append(row, 1)
