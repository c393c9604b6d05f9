"""Benchmark decontamination: spans of training documents that repeat benchmark text.

Texts are lower-cased (A to Z) and cut into words of digits, letters and characters beyond
ASCII. Every run of WINDOW words of a benchmark item, or a shorter item whole, is an n-gram
to look for. Their hashes go to all tasks as a set; a task slides windows over the words of
its documents, looks each hash up, verifies every hit word by word, and marks the words
that hits cover. Documents with hits can lose those spans or go as a whole.

The set is broadcast in blocks of at most some BLOCK_WORDS benchmark words, so its size has
a bound however large the benchmark is. One block holds the usual benchmarks; beyond that
documents are scanned once per block and the spans found are merged.

Defined cases: a null text, or one without words, has no hits. An item without words is never
found; one without item_id marks words but is not listed. Rows of one item_id are one item of
several texts. Repeated documents are judged row by row. An empty documents table gives an
empty result, an empty benchmark no hits. Other columns are ignored, and kept by
``decontaminated``, whatever their names.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyflow.llm.common import map_batches, mixed, owners, steps
from tallyflow.session import written

#: Words of a window.
WINDOW = 10
#: Benchmark words of one broadcast block, and windows of a piece into which items are cut.
BLOCK_WORDS, PIECE_WINDOWS = 2_000_000, 4096
#: Document bytes scanned at once.
STEP = 2 << 20
SPANS = "array<struct<start:int,stop:int>>"

_SPACE = ord(" ")
#: Every byte as it counts: lower case, and a space for whatever ends a word.
_PLAIN = np.array([ord(chr(b).lower()) if b >= 128 or chr(b).isalnum() else _SPACE for b in range(128)] + list(range(128, 256)), np.uint8)


@dataclass
class Words:
    """Words of some texts: ``offsets`` of each text's share, the words, and their bytes in the joined data."""

    offsets: np.ndarray
    words: pa.Array
    starts: np.ndarray
    stops: np.ndarray
    text_starts: np.ndarray


def cut(texts: pa.Array) -> Words:
    """The normalised words of all texts."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    plain = _PLAIN[np.frombuffer(data, np.uint8, ends[-1] - ends[0], ends[0])] if data is not None else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    inside = plain != _SPACE
    border = np.zeros(len(plain) + 1, bool)
    border[ends] = True
    gap = np.concatenate(([True], ~inside, [True]))
    starts = np.flatnonzero(inside & (gap[:-2] | border[:-1]))
    stops = np.flatnonzero(inside & (gap[2:] | border[1:])) + 1
    lengths = np.concatenate(([0], np.cumsum(stops - starts)))
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(lengths), pa.py_buffer(plain[inside])])
    return Words(np.searchsorted(starts, ends), words, starts, stops, ends)


def _hashed(ids: np.ndarray, at: np.ndarray, width: int, bits: int) -> np.ndarray:
    """Hash of the words at each position and after it."""
    h = np.zeros(len(at), np.uint64)
    for k in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + ids[at + k].astype(np.uint64) + np.uint64(1)
    return mixed(h) >> np.uint64(64 - bits)


class HashSet:
    """n-grams of one width: sorted hashes, their words for verifying, and the items that have them."""

    def __init__(self, grams: np.ndarray, gram_items: np.ndarray, bits: int):
        """``grams`` has a row of word ids per window, ``gram_items`` its item's number or -1."""
        width = grams.shape[1]
        distinct, gram = np.unique(grams, axis=0, return_inverse=True)
        gram = gram.reshape(-1)
        hashes = _hashed(distinct.reshape(-1), np.arange(len(distinct)) * width, width, bits)
        order = np.argsort(hashes, kind="stable")
        self.width, self.bits, self.hashes, self.grams = width, bits, hashes[order], distinct[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        listed = np.unique(np.stack([place[gram], gram_items], axis=1)[gram_items >= 0], axis=0)
        self.items = listed[:, 1]
        self.item_offsets = np.searchsorted(listed[:, 0], np.arange(len(order) + 1))
        # Most windows of clean documents end at one look into this table.
        self.filter_bits = min(bits, int(16 * len(order)).bit_length() + 1)
        self.filter = np.zeros(1 << self.filter_bits, bool)
        self.filter[(self.hashes >> np.uint64(bits - self.filter_bits)).astype(np.int64)] = True

    def hits(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions among ``at`` where an n-gram stands, verified, and its number."""
        h = _hashed(ids, at, self.width, self.bits)
        maybe = self.filter[(h >> np.uint64(self.bits - self.filter_bits)).astype(np.int64)]
        at, h = at[maybe], h[maybe]
        first = np.searchsorted(self.hashes, h, side="left")
        many = np.searchsorted(self.hashes, h, side="right") - first
        at, first = np.repeat(at, many), np.repeat(first - np.cumsum(many) + many, many)
        gram = first + np.arange(len(first))
        same = np.ones(len(at), bool)
        for k in range(self.width):
            same &= self.grams[gram, k] == ids[at + k]
        return at[same], gram[same]


class Benchmark:
    """One block of n-grams as tasks look them up."""

    def __init__(self, items: list[str | None], pieces: pa.Array, bits: int = 64):
        split = cut(pieces)
        coded = split.words.dictionary_encode()
        self.vocabulary = coded.dictionary
        ids = coded.indices.to_numpy().astype(np.int32)
        #: In the order of their names as strings.
        self.names = sorted({name for name in items if name is not None})
        number = {name: k for k, name in enumerate(self.names)} | {None: -1}
        of_piece = np.array([number[name] for name in items], np.int64)
        sizes = np.diff(split.offsets)
        self.sets = []
        for width in np.unique(np.minimum(sizes[sizes > 0], WINDOW)).tolist():
            own = np.flatnonzero(sizes >= WINDOW if width == WINDOW else sizes == width)
            starts = np.concatenate([np.arange(split.offsets[p], split.offsets[p + 1] - width + 1) for p in own])
            of_start = np.repeat(of_piece[own], sizes[own] - width + 1)
            self.sets.append(HashSet(ids[starts[:, None] + np.arange(width)], of_start, bits))

    def scan(self, split: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which words of the texts are hit, and distinct pairs of a text and an item found in it."""
        n = len(split.words)
        coded = split.words.dictionary_encode()
        known = pc.fill_null(pc.index_in(coded.dictionary, value_set=self.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int32)
        ids = known[coded.indices.to_numpy()] if n else np.zeros(0, np.int32)
        place = np.arange(n)
        # A window must end before the next unknown word and within its text.
        unknown = np.where(ids < 0, place, n)
        limit = np.minimum(np.minimum.accumulate(unknown[::-1])[::-1], np.repeat(split.offsets[1:], np.diff(split.offsets)))
        change = np.zeros(n + 1, np.int64)
        pairs = [np.zeros(0, np.int64)]
        for grams in self.sets:
            at, gram = grams.hits(ids, np.flatnonzero(place + grams.width <= limit))
            change += np.bincount(at, minlength=n + 1) - np.bincount(at + grams.width, minlength=n + 1)
            found = np.unique(owners(split.offsets, at) * len(grams.hashes) + gram)
            text, gram = np.divmod(found, max(1, len(grams.hashes)))
            many = grams.item_offsets[gram + 1] - grams.item_offsets[gram]
            entry = np.repeat(grams.item_offsets[gram] - np.cumsum(many) + many, many) + np.arange(many.sum())
            pairs.append(np.unique(np.repeat(text, many) * max(1, len(self.names)) + grams.items[entry]))
        text, item = np.divmod(np.unique(np.concatenate(pairs)), max(1, len(self.names)))
        return np.cumsum(change[:-1]) > 0, text, item


def _runs(hit: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last-but-one position of each run of hit words within one text."""
    border = np.zeros(len(hit) + 1, bool)
    border[offsets] = True
    clear = np.concatenate(([True], ~hit, [True]))
    return np.flatnonzero(hit & (clear[:-2] | border[:-1])), np.flatnonzero(hit & (clear[2:] | border[1:])) + 1


def _lists(values: pa.Array, owner: np.ndarray, n: int) -> pa.Array:
    """One list for each of ``n`` rows from values in the order of their owners."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)), values)


def _scanned(batches: Iterator[pa.RecordBatch], shared: Broadcast, keep: list[str], all_rows: bool) -> Iterator[pa.RecordBatch]:
    benchmark: Benchmark = shared.value
    names = pa.array(benchmark.names, pa.string())
    for batch in steps(batches, "_text", STEP):
        split = cut(batch.column("_text"))
        hit, text, item = benchmark.scan(split)
        first, last = _runs(hit, split.offsets)
        owner = owners(split.offsets, first)
        base = split.offsets[owner]
        spans = pa.StructArray.from_arrays([pa.array((first - base).astype(np.int32)), pa.array((last - base).astype(np.int32))], names=["start", "stop"])
        out = [*(batch.column(c) for c in keep), pa.array(np.diff(split.offsets).astype(np.int64)), _lists(spans, owner, batch.num_rows), _lists(names.take(pa.array(item)), text, batch.num_rows)]
        result = pa.RecordBatch.from_arrays(out, names=[*keep, "n_words", "spans", "items"])
        yield result if all_rows else result.filter(pc.greater(pc.list_value_length(result.column("spans")), 0))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items as pieces of bounded size that together have every window of the item."""
    for batch in steps(batches, "_text", STEP):
        split = cut(batch.column("_text"))
        items = batch.column("item").to_pylist()
        words = split.words.to_pylist()
        for k in range(batch.num_rows):
            own = words[split.offsets[k] : split.offsets[k + 1]]
            starts = range(0, max(len(own) - WINDOW + 1, min(len(own), 1)), PIECE_WINDOWS)
            parts = [own[s : s + PIECE_WINDOWS + WINDOW - 1] for s in starts]
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array([items[k]] * len(parts), pa.string()), pa.array([b" ".join(p) for p in parts], pa.binary()), pa.array(list(map(len, parts)), pa.int64())], names=["item", "piece", "size"])


def blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS, bits: int = 64) -> Iterator[Benchmark]:
    """The benchmark's n-grams, block by block; a single empty block without any."""
    read = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").alias("_text"))
    pieces = written(map_batches(read, _pieces, "item string, piece binary, size long").distinct(), "benchmark")
    total = pieces.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    count = max(1, -(-total // block_words))
    # Pieces are short beside a block, so equal shares of their hashes are nearly equal in words.
    number = F.pmod(F.xxhash64(F.coalesce("item", F.lit("")), "piece"), F.lit(count))
    for k in range(count):
        part = pieces.where(number == k).select("item", "piece").toArrow().combine_chunks()
        columns = [pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type) for c in part.columns]
        yield Benchmark(columns[0].to_pylist(), columns[1], bits)


def scanned(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",), block_words: int = BLOCK_WORDS, bits: int = 64) -> DataFrame:
    """``keep``, n_words, spans (runs of hit words, as word positions) and items (found, sorted as strings)."""
    spark = docs.sparkSession
    out = f"n_words long, spans {SPANS}, items array<string>"
    found = None
    parts = blocks(benchmark, block_words, bits)
    held = next(parts)
    following = next(parts, None)
    if following is None:
        read = docs.select(F.struct(*keep).alias("_kept"), F.col("text").alias("_text"))
        task = partial(_scanned, shared=spark.sparkContext.broadcast(held), keep=["_kept"], all_rows=True)
        found = map_batches(read, task, T.StructType([*read.drop("_text").schema, *_fields(spark, out)]))
        return found.select("_kept.*", "n_words", "spans", "items")
    stored = written(docs.select(F.monotonically_increasing_id().alias("_key"), F.struct(*keep).alias("_kept"), F.col("text").alias("_text")), "scanned")
    while held is not None:
        shared = spark.sparkContext.broadcast(held)
        task = partial(_scanned, shared=shared, keep=["_key"], all_rows=found is None)
        part = written(map_batches(stored.select("_key", "_text"), task, f"_key long, {out}"), "spans")
        shared.destroy()
        found = part if found is None else found.unionByName(part)
        held, following = following, next(parts, None)
    # A document's rows: one of the first block and one for each further block with hits.
    merged = found.groupBy("_key").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    merged = map_batches(merged, _merged, merged.schema)
    return stored.select("_key", "_kept").join(merged, "_key").select("_kept.*", "n_words", "spans", "items")


def _fields(spark: SparkSession, schema: str) -> list[T.StructField]:
    return spark.createDataFrame([], schema).schema.fields


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Join spans of one document that touch or overlap."""
    for batch in batches:
        all_spans = []
        for spans in batch.column("spans").to_pylist():
            joined: list[dict] = []
            for span in sorted(spans, key=lambda s: s["start"]):
                if joined and span["start"] <= joined[-1]["stop"]:
                    joined[-1]["stop"] = max(joined[-1]["stop"], span["stop"])
                else:
                    joined.append(dict(span))
            all_spans.append(joined)
        at = batch.schema.get_field_index("spans")
        yield batch.set_column(at, batch.schema.field(at), pa.array(all_spans, batch.schema.field(at).type))


def _without_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches, "_text", STEP):
        split = cut(batch.column("_text"))
        texts = []
        for k, (text, spans) in enumerate(zip(batch.column("_text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist(), strict=True)):
            if spans:
                first, base = split.offsets[k], split.text_starts[k]
                kept, at = [], 0
                for span in spans:
                    kept.append(text[at : split.starts[first + span["start"]] - base])
                    at = split.stops[first + span["stop"] - 1] - base
                text = b"".join([*kept, text[at:]])
            texts.append(text)
        columns = [batch.column("_doc"), pa.array(texts, pa.binary()).cast(pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["_doc", "_text"])


def decontaminated(docs: DataFrame, benchmark: DataFrame, remove: str = "spans") -> DataFrame:
    """The documents, with all their columns, without hit ``spans`` or without hit ``documents``."""
    if remove not in ("spans", "documents"):
        raise ValueError("remove must be 'spans' or 'documents'")
    found = scanned(docs.select(F.struct("*").alias("_doc"), "text"), benchmark, keep=("_doc",))
    if remove == "documents":
        return found.where(F.size("spans") == 0).select("_doc.*")
    read = found.select("_doc", F.col("_doc.text").alias("_text"), "spans")
    cleaned = map_batches(read, _without_spans, read.drop("spans").schema)
    return cleaned.select(*[F.col("_text").alias("text") if c == "text" else F.col("_doc").getField(c).alias(c) for c in docs.columns])
