"""What several operators share: reading documents, words of Arrow text batches, numbering."""

import ctypes
import sys
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyflow.session import ship_package, written

#: White space that ends a word; everything else, non-breaking spaces too, belongs to words.
SPACE = r"[\x20\x09-\x0D]+"
#: Text bytes that one step of a Python task handles at once; bounds its memory.
STEP_BYTES = 4 << 20
#: Bytes up to which texts are hashed as arrays.
SHORT_TEXT = 64
#: An odd number with as many ones as zeros.
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def map_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` with this package at hand on the executors."""
    ship_package(df.sparkSession)
    return df.mapInArrow(partial(_given_back, function=function), schema)


def _given_back(batches: Iterator[pa.RecordBatch], function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """What a task freed goes back to the system when it ends; the worker lives on for other tasks."""
    try:
        yield from function(batches)
    finally:
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
        if trim is not None:
            trim(0)


_PLACE = {"_file": "_metadata.file_path", "_row": "_metadata.row_index"}


def stored(docs: DataFrame) -> DataFrame:
    """The documents as read from files; stored first, where they are not."""
    try:
        docs.select("_metadata.file_path")
        return docs
    except AnalysisException:
        return written(docs, "documents")


def located(docs: DataFrame) -> DataFrame:
    """The documents with ``_file`` and ``_row``, which name one stored row each."""
    return stored(docs).select("*", *[F.col(c).alias(name) for name, c in _PLACE.items()])


def packed(docs: DataFrame, *also: str) -> DataFrame:
    """``_file``, ``_row``, ``also``, and all columns of stored documents as ``_doc``, where their names clash with none."""
    return docs.select(F.struct("*").alias("_doc"), *also, *[F.col(c).alias(name) for name, c in _PLACE.items()])


def word_count(text: Column) -> Column:
    """Number of words; 0 for null, empty and blank texts."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{SPACE}|{SPACE}$", "")
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, SPACE))).cast("long")


def steps(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows of at most ``most`` text bytes, or a single longer row."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            used = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, used + most, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def split_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, pa.StringArray]:
    """Words of all texts in one array, and the n + 1 offsets of each text's share of it."""
    bare = pc.ascii_trim_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    if lower:
        bare = pc.ascii_lower(bare)
    lists = pc.ascii_split_whitespace(bare)
    counts = np.diff(np.asarray(lists.offsets)) - np.asarray(pc.equal(bare, ""))
    words = lists.flatten()
    return np.concatenate(([0], np.cumsum(counts))), words.filter(pc.not_equal(words, ""))


def word_ids(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Small integer for each word, and the distinct words they stand for."""
    coded = words.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hash of each word; the same word has the same hash in every task."""
    ids, distinct = word_ids(words)
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in distinct.cast(pa.large_binary()).to_pylist()), np.uint64, len(distinct))
    return hashes[ids]


def text_hashes(texts: pa.Array) -> np.ndarray:
    """64-bit hash of each text, not that of ``word_hashes``: its length, and its bytes by eights, mixed in one after another.

    Of texts of up to eight bytes no two of the same length have the same hash.
    """
    texts = texts.cast(pa.large_binary())
    _, ends, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint64)
    ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.concatenate((np.frombuffer(data or b"", np.uint8), np.zeros(8, np.uint8)))
    eights = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))  # those that begin at each byte
    at, left = ends[:-1].copy(), np.diff(ends)
    hashes = mixed(left.astype(np.uint64) + GOLDEN)
    short = np.flatnonzero((left > 0) & (left <= SHORT_TEXT))
    while len(short):
        unused = np.maximum(8 - left[short], 0).astype(np.uint64) * np.uint64(8)
        hashes[short] = mixed((hashes[short] ^ ((eights[at[short]] << unused) >> unused)) + GOLDEN)
        at[short] += 8
        left[short] -= 8
        short = short[left[short] > 0]
    for k in np.flatnonzero(left > SHORT_TEXT):
        hashes[k] = xxhash.xxh64_intdigest(data[at[k] : at[k] + left[k]])
    return hashes


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers over the whole range."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def window_starts(offsets: np.ndarray, width: int) -> np.ndarray:
    """Positions at which a window of ``width`` words fits into its own text."""
    ends = np.repeat(offsets[1:], np.diff(offsets))
    at = np.arange(len(ends))
    return at[at + width <= ends]


def owners(offsets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Row that owns each word position."""
    return np.searchsorted(offsets, at, side="right") - 1


def running_start(rows: DataFrame, key: list[str], order: list[Column], size: str, out: str, bucket: Column) -> DataFrame:
    """Add ``out``: the sum of ``size`` over all rows of the same key that come before.

    Rows come by bucket, then by ``order``. Positions inside a bucket need only its own
    rows, and one total per bucket gives the rest, so a key with a third of all rows is
    still dealt over as many tasks as it has buckets.
    """
    rows = rows.withColumn("_bucket", bucket)
    of_key = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in key]
    totals = rows.groupBy(*key, "_bucket").agg(F.sum(size).alias("_total"))
    before = Window.partitionBy(*key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*[F.col(k).alias(f"_k_{k}") for k in key], F.col("_bucket").alias("_b"), F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*key, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_inside", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    joined = placed.join(totals, [*of_key, F.col("_bucket") == F.col("_b")])
    return joined.withColumn(out, F.col("_before") + F.col("_inside")).drop("_bucket", "_b", "_total", "_before", "_inside", *[f"_k_{k}" for k in key])
