"""Alignment of the tokens of two tokenizers, and how often token pairs are linked in a corpus.

Tokens of both sides are laid over the bytes of a text. Dictionaries lead from the byte
offset at which a token ends to its index; the offsets in both key sets cut the text into
groups, each a slice of both id lists, and within a group tokens whose bytes overlap are
linked. The number of documents that hold a pair of ids linked is counted over the corpus,
and every document is scored against these counts.

A text falls into segments where a space follows a byte that ends no white space. There
neither side has a token across: byte-level pre-tokens and pieces have spaces at their
start only. So both sides end a token at each segment's end, groups lie inside segments,
and each distinct segment of a step is encoded and aligned once. Where a segment's tokens don't give
its bytes back, the whole text is taken as one segment.

Pairs a document has are stored with it. Counts are summed in each task before they are
shuffled. The most frequent pairs, HOT_PAIRS at most, are sent to all tasks, which score
the documents with them; the other pairs, each with less than its share of one in HOT_PAIRS
of all rows, are joined by the pair. All pairs count one way or the other.

Defined cases: a text that is null or empty, or whose joined bytes differ on either side, has
no tokens, zeros, and an empty text for groups. Repeated rows are documents of their own,
for the counts too. An empty table gives an empty result. Other columns are ignored.
"""

import hashlib
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import accumulate, chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tokenizers
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyflow.llm.bpe_arrays import byte_symbols
from tallyflow.llm.common import map_batches, steps
from tallyflow.session import written

#: Pairs that are sent to all tasks at most.
HOT_PAIRS = 2_000_000
#: Text bytes handled at once, and pairs a task holds before it passes their counts on.
STEP, HELD = 4 << 20, 1_000_000
#: Segments the first tokenizer gets as one text.
TOGETHER = 2000
#: Counts are told apart by 1/LEVELS of an octave when the hot pairs are chosen.
LEVELS = 8

_SPACE = ord(" ")
#: Last bytes of white space beyond ASCII; other characters end in them too, which only spares a cut.
_ENDS_SPACE = {0x80, 0x81, 0x82, 0x83, 0x84, 0x85, 0x86, 0x87, 0x88, 0x89, 0x8A, 0x9F, 0xA0, 0xA8, 0xA9, 0xAF}
#: After these a text's last segment may not be followed by another: all that str counts as white space.
_WHITE = {chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace()} | {""}
_CUTS_AFTER = np.array([b > _SPACE and b not in _ENDS_SPACE for b in range(256)])


class Segments:
    """Aligned segments as columns: ``numbers`` has rows n_a, n_b, n_groups and n_links, ``groups`` texts that
    end with a semicolon, ``pairs`` the links of one segment after another."""

    def __init__(self, faithful: np.ndarray, numbers: np.ndarray, groups: pa.Array, pairs: np.ndarray):
        self.faithful, self.numbers, self.groups, self.pairs = faithful, numbers, groups, pairs

    def __add__(self, more: "Segments") -> "Segments":
        return Segments(*(np.concatenate([a, b], axis=-1) for a, b in ((self.faithful, more.faithful), (self.numbers, more.numbers))), pa.concat_arrays([self.groups, more.groups]), np.concatenate([self.pairs, more.pairs]))


class Aligner:
    """Both tokenizers, read from the contents of their files where they are first used."""

    def __init__(self, vocabulary: str, model: bytes):
        self.files = vocabulary, model
        self.size_b = 0

    def ready(self) -> "Aligner":
        if self.size_b:
            return self
        vocabulary, model = self.files
        self.first = tokenizers.Tokenizer.from_str(vocabulary)
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_proto=model)
        symbols = byte_symbols()
        entries = {i: bytes(map(symbols.__getitem__, t)) if set(t) <= symbols.keys() else t.encode() for t, i in self.first.get_vocab().items()}
        pieces = self.second.id_to_piece(list(range(self.second.get_piece_size())))
        #: A text of nothing has no piece for the space put before it.
        self.lone_space = [self.second.piece_to_id("▁")]
        self.bytes_a = pa.array([entries.get(i, b"") for i in range(max(entries) + 1)], pa.large_binary())
        self.bytes_b = pa.array([bytes.fromhex(p[3:5]) if self.second.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)], pa.large_binary())
        self.lengths_a, self.lengths_b = (pc.binary_length(t).to_numpy() for t in (self.bytes_a, self.bytes_b))
        #: Decimals of the ids of both sides, followed by what stands after a token, and after the last of a group.
        self.decimals = pa.array([f"{i}{mark}" for size, marks in ((len(self.bytes_a), ",|"), (len(pieces), ",;")) for i in range(size) for mark in marks], pa.large_binary())
        self.size_b = len(pieces)
        return self

    def ids_first(self, texts: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all segments and how many each has. Where a segment begins, a pre-token begins,
        so segments that another may follow are encoded together, as one text."""
        followed = np.array([t[-1:] not in _WHITE for t in texts], bool)
        apart, alone = np.flatnonzero(followed), np.flatnonzero(~followed)
        order = np.concatenate([apart, alone])
        together = [apart[k : k + TOGETHER] for k in range(0, len(apart), TOGETHER)]
        parts, counts = [], np.zeros(len(texts), np.int64)
        for own in [*together, *alone[:, None]]:
            ids = np.array(self.encoded("".join([texts[k] for k in own])), np.int64)
            ends, wanted = np.cumsum(self.lengths_a[ids]), np.cumsum(sizes[own])
            stops = np.searchsorted(ends, wanted, side="right")
            if len(own) > 1 and not np.array_equal(ends[stops - 1], wanted):
                each = [np.array(self.encoded(texts[k]), np.int64) for k in own]
                ids, stops = np.concatenate(each), np.cumsum(list(map(len, each)))
            counts[own] = np.diff(stops, prepend=0) if len(own) > 1 else len(ids)
            parts.append(ids)
        flat = np.concatenate(parts)
        # Back from the order of encoding to the order of segments.
        starts = np.empty(len(texts), np.int64)
        starts[order] = np.cumsum(counts[order]) - counts[order]
        return flat[np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(len(flat))], counts

    def encoded(self, text: str) -> list[int]:
        return self.first.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def ids_second(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = [ids or self.lone_space for ids in self.second.encode([t[1:] for t in texts], num_threads=1)]
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter(chain.from_iterable(lists), np.int64, int(counts.sum())), counts

    def align(self, segments: pa.Array) -> Segments:
        """Alignments of distinct texts that each begin with a space."""
        texts, n = segments.to_pylist(), len(segments)
        sizes = pc.binary_length(segments).to_numpy().astype(np.int64)
        data = np.frombuffer(b"".join(segments.cast(pa.large_binary()).to_pylist()), np.uint8)
        sides = [[self.bytes_a, self.lengths_a, *self.ids_first(texts, sizes)], [self.bytes_b, self.lengths_b, *self.ids_second(texts)]]
        faithful = np.ones(n, bool)
        for look in ("length", "bytes"):
            kept = np.ones(n, bool)
            for table, lengths, ids, counts in sides:
                of_token = np.repeat(np.arange(n), counts)
                if look == "length":
                    kept &= np.bincount(of_token, weights=lengths[ids], minlength=n) == sizes
                else:
                    joined = np.frombuffer(table.take(pa.array(ids)).buffers()[2] or b"", np.uint8)
                    kept[np.repeat(np.arange(n), sizes)[joined != data]] = False
            if not kept.all():
                faithful &= kept
                data = data[np.repeat(kept, sizes)]
                for side in sides:
                    side[2], side[3] = side[2][np.repeat(kept, side[3])], np.where(kept, side[3], 0)
                sizes = np.where(kept, sizes, 0)
        (_, lengths_a, a, n_a), (_, lengths_b, b, n_b) = sides
        ends_a, ends_b = np.cumsum(lengths_a[a]), np.cumsum(lengths_b[b])
        # Dictionary of one side's ends, the other's looked up in it: the common ends, in order.
        index = pd.Index(ends_b).get_indexer(ends_a)
        last_a = np.flatnonzero(index >= 0)
        last_b = index[last_a]
        n_groups = np.bincount(np.repeat(np.arange(n), n_a)[last_a], minlength=n)
        # A group's tokens of the one side, then those of the other.
        group_a, group_b = (np.searchsorted(last, np.arange(len(ids))) for last, ids in ((last_a, a), (last_b, b)))
        code = np.empty(len(a) + len(b), np.int64)
        before = np.concatenate(([0], last_b + 1))
        code[np.arange(len(a)) + before[group_a]] = 2 * a + (index >= 0)
        is_last = np.zeros(len(b), bool)
        is_last[last_b] = True
        code[np.arange(len(b)) + (last_a + 1)[group_b]] = 2 * (len(self.bytes_a) + b) + is_last
        _, ends, text = self.decimals.take(pa.array(code)).buffers()
        bounds = np.concatenate(([0], np.cumsum(n_a + n_b)))
        groups = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(np.frombuffer(ends, np.int64, len(code) + 1)[bounds]), text])
        # Links of a slice: each token with the other side's from the one it begins in to the one it ends in.
        begin, end = np.searchsorted(ends_b, ends_a - lengths_a[a], side="right"), np.searchsorted(ends_b, ends_a, side="left")
        many = end - begin + 1
        pairs = np.repeat(a * self.size_b, many) + b[np.repeat(begin - np.cumsum(many) + many, many) + np.arange(many.sum())]
        n_links = np.bincount(np.repeat(np.arange(n), n_a), weights=many, minlength=n).astype(np.int64)
        return Segments(faithful, np.stack([n_a, n_b, n_groups, n_links]), groups, pairs)


def cut(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets of each text's segments, and the segments of all; texts are not empty and begin with a space."""
    texts = texts.cast(pa.large_binary())
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(data, np.uint8, ends[-1] - ends[0], ends[0])
    ends = ends - ends[0]
    begins = data == _SPACE
    begins[1:] &= _CUTS_AFTER[data[:-1]]
    begins[ends[:-1]] = True
    starts = np.append(np.flatnonzero(begins), len(data))
    segments = pa.Array.from_buffers(pa.large_string(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(data.tobytes())])
    return np.searchsorted(starts, ends), segments


def _aligned(batches: Iterator[pa.RecordBatch], shared: Broadcast, schema: pa.Schema, digests: bool) -> Iterator[pa.RecordBatch]:
    aligner: Aligner = shared.value.ready()
    held: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])

    def filled(columns: dict[str, pa.Array], n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def counted() -> pa.RecordBatch:
        keys, code = np.unique(np.concatenate(held[0]), return_inverse=True)
        sums = np.bincount(code, weights=np.concatenate(held[1])).astype(np.int64)
        for part in held:
            part.clear()
        return filled({"pair": pa.array(keys), "n": pa.array(sums)}, len(keys))

    for batch in steps(batches, "_text", STEP):
        n = batch.num_rows
        texts = pc.fill_null(batch.column("_text").cast(pa.large_string()), "")
        full = np.flatnonzero(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        tables = _step(aligner, _spaced(texts.take(pa.array(full))), digests) if len(full) else None
        sums = np.zeros((4, n), np.int64)
        groups, pairs, many, owner = [""] * n, *(np.zeros(0, np.int64) for _ in range(3))
        if tables:
            sums[:, full], own_groups, owner, pairs, many = tables
            owner = full[owner]
            for k, text in zip(full.tolist(), own_groups, strict=True):
                groups[k] = text
            keys, counts = np.unique(pairs, return_counts=True)
            held[0].append(keys)
            held[1].append(counts)
        offsets = pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32))
        lists = {name: pa.ListArray.from_arrays(offsets, pa.array(values).cast(schema.field(name).type.value_type)) for name, values in (("pairs", pairs), ("pair_counts", many))}
        kept = {c: batch.column(c) for c in batch.schema.names if c != "_text"}
        numbers = dict(zip(("n_a", "n_b", "n_groups", "n_links"), map(pa.array, sums), strict=True))
        yield filled(kept | numbers | {"groups_sha256" if digests else "groups": pa.array(groups, pa.string())} | lists, n)
        if sum(map(len, held[0])) > HELD:
            yield counted()
    if held[0]:
        yield counted()


def _spaced(texts: pa.Array) -> pa.Array:
    nothing, space = (pa.scalar(s, pa.large_string()) for s in ("", " "))
    return pc.binary_join_element_wise(nothing, texts, space)


def _step(aligner: Aligner, texts: pa.Array, digests: bool):
    """Numbers of each text, its groups, and owner, pair and number of each of its distinct pairs."""
    offsets, parts = cut(texts)
    coded = parts.dictionary_encode()
    codes, distinct = coded.indices.to_numpy(), aligner.align(coded.dictionary)
    # Texts with a segment that doesn't give its bytes back are taken whole.
    unfaithful = np.flatnonzero(np.add.reduceat(~distinct.faithful[codes], offsets[:-1], dtype=np.int64))
    if len(unfaithful):
        pieces = np.split(codes, offsets[1:-1])
        for k, row in enumerate(unfaithful):
            pieces[row] = np.array([len(coded.dictionary) + k])
        distinct = distinct + aligner.align(texts.take(pa.array(unfaithful)))
        codes, offsets = np.concatenate(pieces), np.concatenate(([0], np.cumsum(list(map(len, pieces)))))
    sums = np.add.reduceat(distinct.numbers[:, codes], offsets[:-1], axis=1)
    _, ends, data = distinct.groups.take(pa.array(codes)).buffers()
    ends = np.frombuffer(ends, np.int64, len(codes) + 1)[offsets]
    view = memoryview(data or b"")
    groups = [view[a : max(a, b - 1)] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    groups = [hashlib.sha256(g).hexdigest() if digests and len(g) else bytes(g).decode() for g in groups]
    n_links = distinct.numbers[3]
    lengths = n_links[codes]
    starts = np.cumsum(n_links) - n_links
    at = np.repeat(starts[codes] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
    text = np.repeat(np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)), lengths)
    space = int(distinct.pairs.max(initial=0)) + 1
    keys, many = np.unique(text * space + distinct.pairs[at], return_counts=True)
    owner, pairs = np.divmod(keys, space)
    return sums, groups, owner, pairs, many


@dataclass
class Alignment:
    """``documents``: a row per document, with its pairs and how often it has each linked.
    ``counts``: pair, n (documents that hold it linked), best (n is the highest of its first id).
    A pair is its first id times ``size_b`` plus its second."""

    documents: DataFrame
    counts: DataFrame
    size_b: int


def aligned(docs: DataFrame, vocabulary: str, model: str, keep: tuple[str, ...] = ("doc_id",), digests: bool = False) -> Alignment:
    """Align every whole text under a tokenizers file (with a space put before the text) and a sentencepiece file."""
    spark = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as first, open(model, "rb") as second:
        aligner = Aligner(first.read(), second.read())
    local = Aligner(*aligner.files).ready()
    size_b = local.size_b
    kind = T.IntegerType() if len(local.bytes_a) * size_b < 2**31 else T.LongType()
    read = docs.select(F.struct(*keep).alias("_kept"), F.col("text").alias("_text"))
    schema = T.StructType(read.drop("_text").schema.fields).add("n_a", "long").add("n_b", "long").add("n_groups", "long").add("n_links", "long")
    schema = schema.add("groups_sha256" if digests else "groups", "string").add("pairs", T.ArrayType(kind)).add("pair_counts", T.ArrayType(T.IntegerType()))
    columns = ["_kept.*", *schema.names[1:]]
    both = T.StructType([T.StructField(f.name, f.dataType) for f in schema]).add("pair", "long").add("n", "long")
    shared = spark.sparkContext.broadcast(aligner)
    task = partial(_aligned, shared=shared, schema=_arrow(both), digests=digests)
    stored = written(map_batches(read, task, both), "alignments")
    counts = written(stored.where("pair IS NOT NULL").groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    # As many rows as the second vocabulary has entries at most.
    of_first = Window.partitionBy(F.floor(F.col("pair") / size_b))
    counts = written(counts.withColumn("best", F.col("n") == F.max("n").over(of_first)), "pair-counts")
    return Alignment(stored.where("pair IS NULL").select(columns), counts, size_b)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _scored(batches: Iterator[pa.RecordBatch], shared: Broadcast, keep: list[str]) -> Iterator[pa.RecordBatch]:
    hot, count, best = shared.value
    for batch in batches:
        lists = batch.column("pairs")
        offsets = np.asarray(lists.offsets)
        pairs = lists.flatten().to_numpy().astype(np.int64)
        many = batch.column("pair_counts").flatten().to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        at = np.minimum(np.searchsorted(hot, pairs), max(len(hot) - 1, 0))
        found = hot[at] == pairs if len(hot) else np.zeros(len(pairs), bool)
        weight = np.zeros(len(pairs), np.int64)
        weight[found] = count[at[found]]
        good = np.zeros(len(pairs), bool)
        good[found] = best[at[found]]
        n_best, count_sum = (np.diff(np.concatenate(([0], np.cumsum(v * many)))[offsets]) for v in (good, weight))
        rest = pa.array(np.concatenate(([0], np.cumsum(~found)))[offsets].astype(np.int32))
        rest = [pa.ListArray.from_arrays(rest, pa.array(v[~found])) for v in (pairs, many)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(n_best), pa.array(count_sum), *rest], names=[*keep, "n_best", "count_sum", "_rest", "_rest_counts"])


def scored(alignment: Alignment, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """The documents, without their pairs, with n_best and count_sum, both over all links."""
    docs, counts = alignment.documents, alignment.counts
    spark = docs.sparkSession
    docs = docs.select(F.struct(*docs.drop("pairs", "pair_counts").columns).alias("_doc"), "pairs", "pair_counts")
    level = F.floor(F.log2(F.col("n").cast("double")) * LEVELS)
    sizes = sorted((tuple(r) for r in counts.groupBy(level.alias("level")).count().collect()), reverse=True)
    taken = list(accumulate(size for _, size in sizes))
    fitting = sum(t <= hot_pairs for t in taken)
    hot = counts.where(level >= sizes[fitting - 1][0]) if fitting else counts.limit(0)
    table = hot.orderBy("pair").toArrow()
    shared = spark.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("pair", "n", "best")))
    schema = T.StructType(docs.select("_doc").schema.fields).add("n_best", "long").add("count_sum", "long").add("_rest", T.ArrayType(T.LongType())).add("_rest_counts", T.ArrayType(T.LongType()))
    found = map_batches(docs, partial(_scored, shared=shared, keep=["_doc"]), schema)
    names = ["_doc.*", "n_best", "count_sum"]
    if fitting == len(sizes):
        return found.select(names)
    found = written(found.withColumn("_row", F.monotonically_increasing_id()), "scored")
    rest = found.select("_row", F.explode(F.arrays_zip("_rest", "_rest_counts")).alias("r")).select("_row", F.col("r._rest").alias("pair"), F.col("r._rest_counts").alias("many"))
    sums = rest.join(counts, "pair").groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("many")).otherwise(0)).alias("_best"), F.sum(F.col("many") * F.col("n")).alias("_sum"))
    both = found.join(sums, "_row", "left")
    return both.withColumns({"n_best": F.col("n_best") + F.coalesce("_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("_sum", F.lit(0))}).select(names)
