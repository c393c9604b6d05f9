"""Removal of repeated token windows.

Every window of fixed length has a Rabin-Karp hash. Equal windows have equal minimizers
(the smallest hash of a shorter gram inside them), and neighbouring windows mostly share
one, so windows are counted in segments: runs of neighbouring windows with one minimizer.
A segment whose whole content occurs earlier is removed as it stands. Only the first
segments of their content whose minimizer also occurs with other content are taken apart
into single windows, which are counted one by one. What is removed from a document is
merged into maximal intervals of words.

Segments that repeat inside one step of a task are marked there, so a passage found in a
third of all documents reaches the shuffle at most once per step.

Order is by doc_id, then start; rows that share a doc_id but not their text come in the
order of a hash of both; a null doc_id comes last. Equal starts are not earlier than each
other, so of fully repeated rows none loses anything to the other.

Defined cases: a null text has no words. An empty table gives an empty result. Other
columns are ignored.
"""

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyflow.llm.common import located, map_batches, mixed, owners, split_words, steps, window_starts, word_hashes
from tallyflow.session import written

#: Words in a window, and in the grams whose smallest hash is a window's minimizer.
WINDOW, GRAM = 20, 8
#: Odd bases of two independent polynomial hashes modulo 2^64.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


class RollingHash:
    """Polynomial hash of any run of items, from prefix sums."""

    def __init__(self, items: np.ndarray, base: int):
        powers = np.full(len(items) + 1, base, np.uint64)
        powers[0] = 1
        self.inverse = np.full(len(items) + 1, pow(base, -1, 1 << 64), np.uint64)
        self.inverse[0] = 1
        np.cumprod(self.inverse, out=self.inverse)
        self.prefix = np.zeros(len(items) + 1, np.uint64)
        np.cumsum(items * np.cumprod(powers)[:-1], out=self.prefix[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.prefix[end] - self.prefix[start]) * self.inverse[start])


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All numbers of the ranges [start, start + length), one range after the other."""
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(starts, lengths)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` neighbours."""
    reach, out = 1, values
    while reach * 2 <= width:
        out = np.minimum(out[:-reach], out[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def segments(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, start, windows, minimizer, content hash of each segment, and if it may repeat inside itself."""
    at = window_starts(offsets, WINDOW)
    if not len(at):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, bool))
    rolling = RollingHash(hashes, BASES[0])
    grams = np.arange(len(hashes) - GRAM + 1)
    gram = rolling.of(grams, grams + GRAM)
    smallest = sliding_min(gram, WINDOW - GRAM + 1)[at]
    row = owners(offsets, at)
    first = np.flatnonzero(np.append(True, (smallest[1:] != smallest[:-1]) | (row[1:] != row[:-1])))
    count = np.diff(np.append(first, len(at)))
    start, value, row = at[first], smallest[first], row[first]
    span = count + WINDOW - GRAM
    hits = gram[ragged(start, span)] == np.repeat(value, span)
    occurs = np.add.reduceat(hits.astype(np.int64), np.cumsum(span) - span)
    return row, start, count, value, rolling.of(start, start + count + WINDOW - 1), occurs > 1


def document_order(batch: pa.RecordBatch) -> np.ndarray:
    """Place of each row in the order of doc_id (null last) and key; equal for equal ones."""
    ids = batch.column("doc_id").to_pandas()
    frame = pd.DataFrame({"null": ids.isna(), "id": ids, "key": batch.column("_k").to_numpy()})
    frame = frame.sort_values(["null", "id", "key"], kind="stable")
    new = (frame[["null", "key"]].ne(frame[["null", "key"]].shift()).any(axis=1)) | (frame["id"].ne(frame["id"].shift()) & ~frame["null"])
    place = np.empty(len(frame), np.int64)
    place[frame.index.to_numpy()] = np.cumsum(new.to_numpy()) - 1
    return place


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches):
        offsets, words = split_words(batch.column("text"))
        row, start, count, value, content, twice = segments(mixed(word_hashes(words)), offsets)
        inside = start - offsets[row]
        order = (document_order(batch)[row] << 32) + inside
        codes, distinct = pd.factorize(mixed(content + mixed(value + count.astype(np.uint64))))
        earliest = np.full(len(distinct), np.iinfo(np.int64).max)
        np.minimum.at(earliest, codes, order)
        later = order > earliest[codes]
        # Those that are settled here need not meet the others: a key of their own spreads them.
        value = np.where(later, mixed(value + order.astype(np.uint64)), value)
        owned = batch.select(["doc_id", "_k", "_u"]).take(pa.array(row))
        columns = [*owned.columns, pa.array(inside.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(value.view(np.int64)), pa.array(content.view(np.int64)), pa.array(twice), pa.array(later)]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "_k", "_u", "start", "windows", "value", "content", "twice", "later"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches):
        offsets, words = split_words(batch.column("text"))
        hashes = mixed(word_hashes(words))
        spans = batch.column("_spans")
        span = spans.flatten()
        row = np.repeat(np.arange(batch.num_rows), spans.value_lengths().to_numpy(zero_copy_only=False))
        own = np.asarray(pa.compute.fill_null(pa.compute.equal(span.field("doc_id"), batch.column("doc_id").take(pa.array(row))), False))
        own |= np.asarray(pa.compute.and_(pa.compute.is_null(span.field("doc_id")), pa.compute.is_null(batch.column("doc_id").take(pa.array(row)))))
        row = row[own]
        start, count = (span.field(n).to_numpy(zero_copy_only=False).astype(np.int64)[own] for n in ("start", "windows"))
        at = ragged(start + offsets[row], count)
        row = np.repeat(row, count)
        first, second = (RollingHash(hashes, base).of(at, at + WINDOW) for base in BASES)
        inside = at - offsets[row]
        order = (document_order(batch)[row] << 32) + inside
        codes, distinct = pd.factorize(mixed(first + second))
        earliest = np.full(len(distinct), np.iinfo(np.int64).max)
        np.minimum.at(earliest, codes, order)
        later = order > earliest[codes]
        first = np.where(later, mixed(first + order.astype(np.uint64)), first)
        owned = batch.select(["doc_id", "_k", "_u"]).take(pa.array(row))
        columns = [*owned.columns, pa.array(inside.astype(np.int32)), pa.array(first.view(np.int64)), pa.array(second.view(np.int64)), pa.array(later)]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "_k", "_u", "start", "first", "second", "later"])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal intervals that cover the same words."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches):
        n_words, removed, intervals, kept = [], [], [], []
        for doc_id, text, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "_spans")), strict=True):
            words = (text or "").encode().split()
            own = merged([(s["start"], s["start"] + s["windows"] + WINDOW - 1) for s in spans or () if s["doc_id"] == doc_id])
            n_words.append(len(words))
            removed.append(sum(b - a for a, b in own))
            intervals.append([{"from_word": a, "to_word": b} for a, b in own])
            for a, b in reversed(own):
                del words[a:b]
            kept.append(b" ".join(words).decode())
        columns = [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(intervals, pa.list_(pa.struct([("from_word", pa.int32()), ("to_word", pa.int32())]))), pa.array(kept, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "intervals", "kept_text"])


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, the removed intervals of words, and the text of the kept ones."""
    spark = docs.sparkSession
    # _k orders rows of one doc_id, _u tells stored rows apart, equal ones too.
    keyed = located(docs.select("doc_id", "text")).select("doc_id", "text", F.xxhash64("doc_id", "text").alias("_k"), F.xxhash64("_file", "_row").alias("_u"))
    id_field = T.StructField("doc_id", docs.schema["doc_id"].dataType)
    start = T.StructType([id_field]).add("_k", "long").add("_u", "long").add("start", "integer")
    found = map_batches(keyed, _segments, T.StructType(list(start)).add("windows", "integer").add("value", "long").add("content", "long").add("twice", "boolean").add("later", "boolean"))

    earlier = [F.col("doc_id").asc_nulls_last(), F.col("_k"), F.col("start")]
    of_value = Window.partitionBy("value")
    of_content = Window.partitionBy("value", "content", "windows").orderBy(*earlier)
    shape = F.struct("content", "windows")
    found = found.select("*", F.count("*").over(of_value).alias("_n"), (F.min(shape).over(of_value) != F.max(shape).over(of_value)).alias("_several"), (F.rank().over(of_content) > 1).alias("_again"))
    gone = F.col("later") | F.col("_again")
    found = found.where(((F.col("_n") > 1) | F.col("twice") | F.col("later")) & (gone | F.col("_several") | F.col("twice")))
    found = written(found.select("doc_id", "_k", "_u", "start", "windows", gone.alias("gone")), "segments")

    # Both joins below read one exchange of the texts.
    placed = keyed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "_u")
    span = F.collect_list(F.struct("doc_id", "start", "windows")).alias("_spans")
    apart = placed.join(found.where("not gone").groupBy("_u").agg(span), "_u")
    windows = map_batches(apart, _windows, T.StructType(list(start)).add("first", "long").add("second", "long").add("later", "boolean"))
    of_window = Window.partitionBy("first", "second").orderBy(*earlier)
    single = windows.withColumn("_again", F.col("later") | (F.rank().over(of_window) > 1)).where("_again")
    runs = found.where("gone").select("doc_id", "_u", "start", "windows")
    runs = runs.unionByName(single.select("doc_id", "_u", "start", F.lit(1).alias("windows")))
    cut = placed.join(runs.groupBy("_u").agg(span), "_u", "left")
    interval = T.ArrayType(T.StructType().add("from_word", "integer").add("to_word", "integer"))
    return map_batches(cut, _cut, T.StructType([id_field]).add("n_words", "long").add("n_removed", "long").add("intervals", interval).add("kept_text", "string"))
