"""Which files exist and which of them still have to be processed."""

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BinaryType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

from tallyflow.functions.text import decoded_path, file_name_of
from tallyflow.schemas import SOURCE_PHASE, VALIDATION_FILE_NAME, VALIDATION_PHASE

_BINARY_FILE = StructType([
    StructField("path", StringType()),
    StructField("modificationTime", TimestampType()),
    StructField("length", LongType()),
    StructField("content", BinaryType()),
])


def literal_path(path: str) -> str:
    """A reader takes paths as globs; this one stands for itself."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def list_files(spark: SparkSession, paths, glob: str = "*.csv") -> DataFrame:
    """``path, file_name, length, changed`` of the files directly in a directory, or of the given
    files. The content column is pruned, so no file is opened."""
    return _listed(_found(spark, paths, glob))


def empty_files(spark: SparkSession, paths, glob: str = "*.csv") -> DataFrame:
    """``path, file_name`` of files without a byte: those of the listing that its scan passes over.

    All names listed go through the driver.
    """
    found = _found(spark, paths, glob)
    named = [(path,) for path in found.inputFiles()]
    every = spark.createDataFrame(named, "path string").select(decoded_path(F.col("path")).alias("path"))
    # The two sides write the slashes behind the scheme differently.
    same = F.regexp_replace("path", "^([a-zA-Z0-9+.-]+):/+", "$1:/")
    scanned = found.select(same.alias("_same"))
    passed_over = every.withColumn("_same", same).join(scanned, "_same", "left_anti")
    return passed_over.select("path", file_name_of(F.col("path")).alias("file_name"))


def _found(spark: SparkSession, paths, glob: str) -> DataFrame:
    try:
        return (
            spark.read.format("binaryFile")
            .schema(_BINARY_FILE)
            .option("pathGlobFilter", glob)
            .load(paths if isinstance(paths, str) else list(paths))
        )
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(error.getMessageParameters().get("path")) from error


def _listed(found: DataFrame) -> DataFrame:
    changed = F.unix_micros("modificationTime").cast("string").alias("changed")
    return found.select("path", file_name_of(F.col("path")).alias("file_name"), "length", changed)


def stream_files(
    spark: SparkSession, source_dir: str, glob: str = "*.csv", max_files: int | None = None
) -> DataFrame:
    """File arrivals as a stream of ``path, file_name, length, changed``.

    A name counts once. Files are taken however old they are: the default age limit
    would silently skip an unseen file with an old modification time.
    """
    reader = (
        spark.readStream.format("binaryFile")
        .schema(_BINARY_FILE)
        .option("pathGlobFilter", glob)
        .option("fileNameOnly", "true")
        .option("maxFileAge", "36500d")
    )
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return _listed(reader.load(literal_path(source_dir)))


def with_phase(files: DataFrame, validation_name: str = VALIDATION_FILE_NAME) -> DataFrame:
    """The reserved file belongs to a later phase than every other file."""
    is_last = F.col("file_name") == validation_name
    return files.withColumn(
        "phase", F.when(is_last, VALIDATION_PHASE).otherwise(SOURCE_PHASE)
    )


def discover(
    spark: SparkSession,
    source_dir: str,
    include_validation: bool = False,
    validation_name: str = VALIDATION_FILE_NAME,
) -> DataFrame:
    """Source files in processing order; an error when there is none."""
    refuse_hidden(spark, source_dir)
    files = list_files(spark, literal_path(source_dir))
    if not include_validation:
        files = files.where(F.col("file_name") != validation_name)
    if files.isEmpty():
        raise FileNotFoundError(f"no source CSV file in {source_dir}")
    return files.orderBy("path")


def refuse_hidden(spark: SparkSession, source_dir: str) -> None:
    """An error where CSV files have names that Spark's listing passes over."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source_dir)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(where):
        return
    named = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(literal_path(source_dir), "{_,.}*.csv")
    hidden = sorted(status.getPath().getName() for status in system.globStatus(named) or [])
    if hidden:
        raise ValueError(f"files whose names Spark hides must be renamed: {', '.join(hidden)}")


def pending(files: DataFrame, processed: DataFrame) -> DataFrame:
    """Files whose name is not in ``processed(file_name)``. Only the name identifies a file."""
    return files.join(processed.select("file_name"), "file_name", "left_anti")
