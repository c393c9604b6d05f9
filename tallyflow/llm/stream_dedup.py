"""Exact deduplication with keyed streaming state.

Arrivals are a stream of thin rows: the digest of the normalised text, the stable
identifier, and a locator (file and row) of the content. A streaming aggregation keeps
one state entry per digest, without expiry, on the executors' disks (RocksDB): the
smallest identifier with its locator, and the number of arrivals. Further arrivals of
the same digest are hits; the full texts of every group with hits are compared, so
two texts that merely share a digest are told apart. All of it is DataFrame code.

``decisions`` judges a table at once, with a state of its own. ``arrived`` keeps the state:
files added to the table since the last call are hashed and meet what all earlier calls left.

Defined cases: a null text counts as empty. A null identifier comes after all others.
Of rows with the same identifier and text the first by locator stays. An empty table
gives an empty result. Other columns are ignored, and kept by ``keep_documents``.
"""

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.llm.common import SPACE, located, packed, stored
from tallyflow.session import remove, shared_dir, written

#: Arrival files that one micro-batch takes.
FILES_PER_BATCH = 4096
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    # Without it every state partition reserves disk space in advance.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text: Column) -> Column:
    """The text with every run of white space replaced by one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def keyed_state(arrivals: DataFrame, path: str, checkpoint: str | None = None) -> DataFrame:
    """One row per digest: the first arrival's identifier and locator, and the arrivals.

    ``arrivals`` is the table stored at ``path``; it is read as a stream and folded into the
    state, whose last version is then read back as a table. With a ``checkpoint`` that was
    used before, the state goes on from there and only files new in ``path`` are read.
    """
    spark = arrivals.sparkSession
    checkpoint = checkpoint or shared_dir(spark, "dedup-state")
    stream = spark.readStream.schema(arrivals.schema).option("maxFilesPerTrigger", FILES_PER_BATCH).parquet(path)
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "_file", "_row")
    folded = stream.groupBy("digest").agg(F.min(first).alias("first"), F.count("*").alias("arrivals"))
    before = {key: spark.conf.get(key, None) for key in STATE_SETTINGS}
    try:
        for key, value in STATE_SETTINGS.items():
            spark.conf.set(key, value)
        query = folded.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
    state = spark.read.format("statestore").load(checkpoint)
    first, arrived = state.schema["value"].dataType.names
    return state.select("key.digest", F.col(f"value.`{first}`").alias("first"), F.col(f"value.`{arrived}`").alias("arrivals"))


def decisions(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row, with its ``_file`` and ``_row``."""
    placed = located(docs.select("doc_id", "text"))
    arrivals = written(_thin(placed, digest), "arrivals")
    folders = {file.rpartition("/")[0] for file in arrivals.inputFiles()}
    if not folders:
        return _of_nothing(arrivals)
    (path,) = folders
    return _judged(placed, arrivals, keyed_state(arrivals, path))


def arrived(docs: DataFrame, store: str, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """The decisions on all documents so far; files that an earlier call took are not hashed again.

    ``docs`` is read from files, to which others are added between calls; files taken must
    stay as they are. ``store`` is a lasting folder that all executors share, with one
    writer and one ``digest``: the thin rows of each call, and the checkpoint with the
    state. After any calls the result is that of ``decisions`` over the same files. A call
    that broke off while it wrote is undone by the next; one that broke off later is
    finished by it.
    """
    spark = docs.sparkSession
    try:
        files = docs.select(F.col("_metadata.file_path").alias("_file")).distinct()
    except AnalysisException as error:
        raise ValueError("arrivals must be read from files, whose names tell old ones from new") from error
    placed = located(docs.select("doc_id", "text"))
    thin = _thin(placed, digest)
    folder = f"{store.rstrip('/')}/arrivals"
    finished = _finished(spark, folder)
    if finished:
        files = files.join(spark.read.schema(thin.schema).parquet(f"{folder}/*").select("_file"), "_file", "left_anti")
    # Names of new files only. Spark skips the other files by name, before it reads them.
    new = sorted(row["_file"] for row in files.collect())
    for at in range(0, len(new), FILES_PER_BATCH):
        taken = thin.where(F.col("_file").isin(new[at : at + FILES_PER_BATCH]))
        taken.write.parquet(f"{folder}/{uuid.uuid4().hex}")
    if not finished and not new:
        return _of_nothing(thin)
    arrivals = spark.read.schema(thin.schema).parquet(f"{folder}/*")
    return _judged(placed, arrivals, keyed_state(arrivals, f"{folder}/*", f"{store.rstrip('/')}/state"))


def _finished(spark: SparkSession, folder: str) -> int:
    """Number of complete batches of arrivals; what broke off half-way is removed first."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    system = make(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    count = 0
    for batch in system.globStatus(make(folder, "*")) or []:
        if system.exists(make(batch.getPath(), "_SUCCESS")):
            count += 1
        else:
            remove(spark, batch.getPath().toString())
    return count


def _thin(placed: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    text = normalised(F.col("text"))
    return placed.select("doc_id", "_file", "_row", sha256(text).alias("text_sha256"), digest(text).alias("digest"))


def _of_nothing(arrivals: DataFrame) -> DataFrame:
    first = F.struct(F.lit(False).alias("unnamed"), "doc_id", "_file", "_row")
    return _named(arrivals.withColumn("first", first).withColumn("arrivals", F.lit(1).cast("long")))


def _judged(placed: DataFrame, arrivals: DataFrame, state: DataFrame) -> DataFrame:
    found = written(arrivals.join(state, "digest"), "found")
    hits = found.where("arrivals > 1").select("_file", "_row", "digest")
    hit_texts = placed.join(hits, ["_file", "_row"]).select("digest", "doc_id", "_file", "_row", normalised(F.col("text")).alias("text"))
    unequal = written(hit_texts.groupBy("digest").agg(F.min("text").alias("a"), F.max("text").alias("b")).where("a <> b").select("digest"), "unequal")
    if unequal.isEmpty():
        return _named(found)
    # One digest, several texts: such groups are divided by the texts themselves.
    apart = written(hit_texts.join(unequal, "digest").withColumn("unnamed", F.col("doc_id").isNull()), "apart")
    classes = apart.groupBy("digest", "text").agg(F.min(F.struct("unnamed", "doc_id", "_file", "_row")).alias("own"), F.count("*").alias("own_size"))
    rows = apart.join(classes, ["digest", "text"]).select("_file", "_row", "own", "own_size")
    found = found.join(rows, ["_file", "_row"], "left")
    return _named(found.withColumn("first", F.coalesce("own", "first")).withColumn("arrivals", F.coalesce("own_size", "arrivals")))


def _named(found: DataFrame) -> DataFrame:
    kept = (F.col("first._file") == F.col("_file")) & (F.col("first._row") == F.col("_row"))
    return found.select("doc_id", F.col("first.doc_id").alias("keep_id"), F.col("arrivals").alias("group_size"), kept.alias("kept"), "text_sha256", "_file", "_row")


def keep_documents(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns."""
    docs = stored(docs)
    dropped = decisions(docs).where("not kept").select("_file", "_row")
    return packed(docs).join(dropped, ["_file", "_row"], "left_anti").select("_doc.*")
