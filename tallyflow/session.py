"""Session helpers: settings the jobs rely on, shared scratch space, size-checked broadcast."""

import atexit
import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MADE: list[tuple[SparkSession, str]] = []
_SHIPPED: set[str] = set()


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the settings the ingest depends on, leaving any the user already chose.

    ``minPartitionNum`` defaults to the cores registered at planning time, so with
    dynamic allocation two scans of the same files could be split differently.
    Concurrent writers let one task write both branches without sorting its rows.
    """
    pinned = {
        "spark.sql.files.minPartitionNum": str(spark.sparkContext.defaultParallelism),
        "spark.sql.maxConcurrentOutputFileWriters": "8",
    }
    for key, value in pinned.items():
        if spark.conf.get(key, None) in (None, "0"):
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the folder all executors share, removed when Python exits.

    The folder is ``spark.checkpoint.dir`` or the one given to ``setCheckpointDir``.
    Where neither is set, a local master uses the machine's own temporary folder; with
    any other master that is an error, since executors would not see each other's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        base = f"{tempfile.gettempdir()}/tallyflow-{spark.sparkContext.applicationId}"
    path = f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex[:12]}"
    _MADE.append((spark, path))
    return path


#: With it Spark deletes the shuffle files of a query when it ends, and not when the driver collects garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The rows of ``df`` as a Parquet table in the shared folder.

    Cuts the lineage: a lost executor costs a re-read, not a re-run. What the query
    shuffled is deleted at once.
    """
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def released(*tables: DataFrame) -> None:
    """Delete tables that ``written`` stored and nothing will read again."""
    for table in tables:
        for folder in {file.rpartition("/")[0] for file in table.inputFiles()}:
            made = [(spark, path) for spark, path in _MADE if _bare(path) == _bare(folder)]
            for spark, path in made:
                remove(spark, path)
                _MADE.remove((spark, path))


def _bare(path: str) -> str:
    """Without the slashes behind the scheme, which listings write differently; plain paths are files."""
    return re.sub("^file:/*", "/", path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch path through Hadoop's file system, if the session still runs."""
    if spark.sparkContext._jsc is None:
        return
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def remove_scratch() -> None:
    """Delete every folder that ``shared_dir`` gave out and that is still there."""
    while _MADE:
        spark, path = _MADE.pop()
        try:
            remove(spark, path)
        except Exception:  # the JVM is gone already, and with it the way to the folder
            return


def ship_package(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    path = f"{tempfile.mkdtemp()}/{os.path.basename(package)}.zip"
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(package)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def broadcast_if_at_most(df: DataFrame, row_count: int, limit: int) -> DataFrame:
    """Hint a broadcast only below a known row count; otherwise Spark shuffles the join."""
    return F.broadcast(df) if row_count <= limit else df
