"""Language-model scores by context-tree weighting over bytes.

A document is the bytes of its lower-cased words, a space after each, and an end mark.
Every byte is eight binary decisions. For each decision and each context of 0 to DEPTH
preceding bytes, training counts give a Krichevsky-Trofimov estimate; the weighting mixes
the estimates of all depths, each by how well it and its deeper contexts coded the
training text. Counts of all grams of the training documents are gathered in Spark,
summed over shorter contexts, weighted from the deepest level up and mixed from the top
down, so that each kept node holds the mixed probability of its rarer bit for texts whose
deepest known context it is. A context never seen in training ends the mix at its parent. A node
with the same counts as its parent predicts the same and is left out.

Texts are scored against the kept nodes and the training counts of words. Both are sent
to all tasks in blocks of a bounded number of entries, split by a hash of the last SPLIT
bytes of the context and by the word's hash; nodes of shorter contexts are in every block.
Where one block does not hold all, texts are scored block by block, each look taking only
the grams and words of its block, and the parts are added up. Words are looked up in as many
blocks as they fill, not in those that only the nodes need.

Defined cases: a null text counts as empty and is just its end mark. A null doc_id
trains. Repeated rows count and are scored one by one. An empty table gives an empty
result; without training documents every bit has probability 1/2. Other columns are ignored.
"""

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyflow.llm.common import map_batches, steps, text_hashes, word_ids
from tallyflow.session import written

#: Bytes of context at most, and the end mark, which also fills the context before a text.
DEPTH, END = 5, 10
#: Entries of nodes, and of words, in a block that is sent to all tasks.
BLOCK_ENTRIES = 2_000_000
#: Text bytes counted at once, and counts a task holds before it passes them on.
STEP, HELD = 2 << 20, 2_000_000
#: Nodes linked to their children at once.
LINKED_TOGETHER = 1 << 19
GRAM, WORD = 0, 1
#: Last bytes of a context whose hash gives its block, and the shares into which they fall.
SPLIT, SHARES = 3, 1 << 16
#: Grams whose probability a task remembers at most, for as long as it uses a block.
REMEMBERED = 1 << 19
#: Bits of a node's number below its context, and of the context below its depth.
NODE_BITS, CONTEXT_BITS = 8, 8 * DEPTH


#: Odd multiplier small enough that products of SPLIT bytes stay in 64 bits.
SPREAD = 40_503_001


def share(context: np.ndarray) -> np.ndarray:
    """Share of a context's last SPLIT bytes, the same as in Spark."""
    bits = 8 * SPLIT
    return (((context & ((1 << bits) - 1)) * SPREAD) & ((1 << bits) - 1)) >> (bits - 16)


def share_column(context: Column) -> Column:
    bits = 8 * SPLIT
    return F.shiftright((context.bitwiseAND((1 << bits) - 1) * SPREAD).bitwiseAND((1 << bits) - 1), bits - 16)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


#: Upper case and white space of any kind, and what stands for them.
UPPER, WHITE = bytes(range(65, 91)), b"\t\n\v\f\r"
SPELLED = bytes.maketrans(UPPER + WHITE, UPPER.lower() + b" " * len(WHITE))


@dataclass
class Spelled:
    """Documents as they are coded, one after another, DEPTH end marks before each."""

    data: np.ndarray
    #: Where each document ends, behind its end mark, and the offsets of its words.
    ends: np.ndarray
    offsets: np.ndarray
    #: Behind each word.
    spaces: np.ndarray

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate(([0], self.ends))[:-1] + DEPTH

    @property
    def words(self) -> pa.Array:
        """All words, one after another."""
        letters = self.data[(self.data != 32) & (self.data != END)]
        own = np.repeat(np.arange(len(self.ends)), np.diff(self.offsets))
        # Before a word's end lie a space for each word before it, and the end marks.
        ends = self.spaces - np.arange(len(own)) - own * (DEPTH + 1) - DEPTH
        ends = np.concatenate(([0], ends)).astype(np.int32)
        return pa.StringArray.from_buffers(len(own), pa.py_buffer(ends), pa.py_buffer(letters))

    def keys(self, at: np.ndarray | slice) -> np.ndarray:
        """DEPTH + 1 bytes from each position on."""
        eights = np.ndarray(len(self.data) - 7, ">u8", self.data, strides=(1,))
        return (eights[at].astype(np.uint64) >> np.uint64(8 * (7 - DEPTH))).view(np.int64)

    def shares(self) -> np.ndarray:
        """``share`` of the context at each position where DEPTH + 1 bytes begin."""
        fours = np.ndarray(len(self.data) - 7, ">u4", self.data, offset=DEPTH - 4, strides=(1,))
        return ((fours.astype(np.uint32) * np.uint32(SPREAD)) >> np.uint32(8 * SPLIT - 16)) & np.uint32(SHARES - 1)

    def own(self) -> np.ndarray:
        """Whether the bytes from a position on end in a document, not in the end marks before it."""
        own = np.ones(len(self.data) - 7, bool)
        for k in range(DEPTH):
            own[self.ends - DEPTH + k] = False
        own[self.ends[-1] if len(self.ends) else 0 :] = False
        return own


def spelled(texts: pa.Array) -> Spelled:
    texts = pa.compute.fill_null(texts.cast(pa.large_binary()), b"")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    first, last = int(offsets[0]), int(offsets[-1])
    data = data[first:last].to_pybytes().translate(SPELLED) if last > first else b""
    # Before each text come end marks only, whatever document lies before it.
    bounds = (offsets - first).tolist()
    before, after = bytes([END]) * DEPTH, b" " + bytes([END])
    data = before + (after + before).join([data[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]) + after + bytes([END]) * 8
    data = np.frombuffer(data, np.uint8)
    # Of white space stays the first byte after a word.
    space = data == 32
    bare = space | (data == END)
    dropped = space[1:] & bare[:-1]
    if dropped.any():
        data = data[np.concatenate(([True], ~dropped))]
    ends = np.flatnonzero(data == END)[DEPTH :: DEPTH + 1][: len(texts)] + 1
    spaces = np.flatnonzero(data == 32)
    return Spelled(data, ends, np.concatenate(([0], np.searchsorted(spaces, ends))), spaces)


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """DEPTH + 1 bytes ending at each byte of each document, byte offsets, word offsets, words."""
    docs = spelled(texts)
    return docs.keys(docs.own()), np.concatenate(([0], np.cumsum(docs.ends - docs.starts))), docs.offsets, docs.words


def counted_once(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and how often each occurs."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and their summed counts."""
    codes, distinct = pd.factorize(np.concatenate(keys))
    return distinct, np.bincount(codes, weights=np.concatenate(counts), minlength=len(distinct)).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, tuple[list[np.ndarray], list[np.ndarray]]] = {GRAM: ([], []), WORD: ([], [])}

    def given(kind: int) -> pa.RecordBatch:
        (distinct,), (sums,) = held[kind]
        held[kind] = ([], [])
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(distinct), kind, np.int32)), pa.array(distinct), pa.array(sums)], names=["kind", "key", "n"])

    for batch in steps(batches, most=STEP):
        docs = spelled(batch.column("text"))
        ids, words = word_ids(docs.words)
        for kind, (distinct, sums) in ((GRAM, counted_once(docs.keys(docs.own()))), (WORD, (text_hashes(words).view(np.int64), np.bincount(ids, minlength=len(words))))):
            held[kind][0].append(distinct)
            held[kind][1].append(sums)
            if sum(map(len, held[kind][0])) > HELD:
                held[kind] = tuple([part] for part in added(*held[kind]))
                # Few keys that came again and again are held on, so that each is passed on once.
                if 2 * len(held[kind][0][0]) > HELD:
                    yield given(kind)
    for kind, (parts, sums) in held.items():
        if parts:
            held[kind] = tuple([part] for part in added(parts, sums))
            yield given(kind)


def log_gamma(x: Column) -> Column:
    """Stirling's series, shifted up by eight so that it holds for all x > 0."""
    product = x
    for k in range(1, 8):
        product = product * (x + k)
    y = x + 8
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y)
    return series - F.log(product)


def log_kt(zeros: Column, ones: Column) -> Column:
    """Logarithm of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - math.log(math.pi)


def weighted_nodes(counted: DataFrame) -> DataFrame:
    """key (depth, context, node) and rarer of every kept node: the mixed probability of its
    less probable bit, negative if that is the 0. Of a probability close to 1 a float would
    keep only the 1."""
    byte = F.col("key").bitwiseAND(255)
    level = counted.select("n", F.shiftright("key", 8).alias("context"), byte.alias("byte"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("bit"))
    one = F.expr("shiftright(byte, 7 - bit) & 1")
    level = level.select("context", F.expr("(shiftleft(1, bit) | shiftright(byte, 8 - bit))").cast("int").alias("node"), (F.col("n") * (1 - one)).alias("zeros"), (F.col("n") * one).alias("ones"))
    estimate = log_kt(F.col("zeros"), F.col("ones"))
    levels = []
    for depth in range(DEPTH, -1, -1):
        if depth == DEPTH:
            level = level.groupBy("context", "node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones")).withColumn("weighted", estimate).withColumn("gap", F.lit(float("-inf")))
        else:
            parent = F.col("context").bitwiseAND((1 << (8 * depth)) - 1)
            level = level.groupBy(parent.alias("context"), "node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("below"))
            level = level.withColumn("kt", estimate).withColumn("high", F.greatest("kt", "below"))
            # log of (kt + below) / 2, and of below / kt
            level = level.withColumn("weighted", F.col("high") + F.log(F.exp(F.col("kt") - F.col("high")) + F.exp(F.col("below") - F.col("high"))) - math.log(2))
            level = level.withColumn("gap", F.col("below") - F.col("kt")).drop("kt", "high", "below")
        level = written(level, f"contexts-{depth}")
        levels.append(level)
    above, kept = None, None
    for depth, level in enumerate(reversed(levels)):
        # Both bits are mixed: 1 - p would lose the rare one. So would a share that rounding lifts above 1.
        p0, p1 = ((F.col(c) + 0.5) / (F.col("zeros") + F.col("ones") + 1.0) for c in ("zeros", "ones"))
        share, rest = 1 / (1 + F.exp("gap")), 1 / (1 + F.exp(-F.col("gap")))
        if above is None:
            level = level.withColumn("mixed0", F.lit(0.0)).withColumn("mixed1", F.lit(0.0)).withColumn("left", F.lit(1.0)).withColumn("new", F.lit(True))
        else:
            parent = F.col("context").bitwiseAND((1 << (8 * (depth - 1))) - 1)
            level = level.withColumn("_up", parent).join(above, (F.col("_up") == F.col("up")) & (F.col("node") == F.col("up_node"))).withColumn("new", (F.col("zeros") != F.col("up_zeros")) | (F.col("ones") != F.col("up_ones")))
        level = level.withColumn("p0", p0).withColumn("p1", p1)
        if depth < DEPTH:
            level = written(level.select("context", "node", "zeros", "ones", "gap", "mixed0", "mixed1", "left", "new", "p0", "p1"), f"mixed-{depth}")
        key = F.shiftleft(F.lit(depth).cast("long"), CONTEXT_BITS + NODE_BITS).bitwiseOR(F.shiftleft("context", NODE_BITS)).bitwiseOR(F.col("node").cast("long"))
        zero, one = (F.col(f"mixed{b}") + F.col("left") * F.col(f"p{b}") for b in (0, 1))
        own = level.where("new").select(key.alias("key"), share_column(F.col("context")).alias("share"), F.lit(depth).alias("depth"), F.when(zero < one, -zero).otherwise(one).cast("float").alias("rarer"))
        kept = own if kept is None else kept.unionByName(own)
        above = level.select(
            F.col("context").alias("up"), F.col("node").alias("up_node"), F.col("zeros").alias("up_zeros"), F.col("ones").alias("up_ones"),
            *((F.col(f"mixed{b}") + F.col("left") * share * F.col(f"p{b}")).alias(f"mixed{b}") for b in (0, 1)), (F.col("left") * rest).alias("left"),
        )
    return written(kept, "nodes")


class Hashed:
    """Open-addressing table from 64-bit keys to positions, in numpy arrays."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(len(keys) * 2).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.keys = keys
        todo = np.arange(len(keys), dtype=np.int32)
        at = self.place(keys)
        while len(todo):
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]
            lost = self.slots[at] != todo
            todo, at = todo[lost], (at[lost] + 1) & ((1 << self.bits) - 1)

    def place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key, or -1."""
        out = np.full(len(keys), -1, np.int64)
        if not len(self.keys):
            return out
        todo, at = np.arange(len(keys)), self.place(keys)
        while len(todo):
            slot = self.slots[at]
            hit = (slot >= 0) & (self.keys[slot] == keys[todo])
            out[todo[hit]] = slot[hit]
            more = (slot >= 0) & ~hit
            todo, at = todo[more], (at[more] + 1) & ((1 << self.bits) - 1)
        return out


class Block:
    """Nodes and word counts of one block; tasks arrange them for look-up when they first use it."""

    def __init__(self, number: int, blocks: int, word_blocks: int, nodes: tuple[np.ndarray, np.ndarray], words: tuple[np.ndarray, np.ndarray], totals: tuple[int, int, int]):
        self.number, self.blocks, self.word_blocks = number, blocks, word_blocks
        self.raw: tuple | None = (nodes, words)
        self.train_tokens, self.distinct_tokens, self.end_count = totals

    def ready(self) -> "Block":
        if self.raw is None:
            return self
        (keys, self.rarer), (self.words, self.word_counts) = self.raw
        self.raw = None
        #: Positions of the nodes for a 0 and a 1 below each node, or -1. Keys come sorted.
        self.children = np.full((2, len(keys)), -1, np.int32)
        for start in range(0, len(keys), LINKED_TOGETHER):
            own = keys[start : start + LINKED_TOGETHER]
            node = own & 255
            for bit in (0, 1):
                child = own + node + bit
                at = np.minimum(np.searchsorted(keys, child), len(keys) - 1)
                found = (node < 128) & (keys[at] == child)
                self.children[bit, start : start + len(own)][found] = at[found]
        self.root_at = np.flatnonzero(keys & 255 == 1)
        self.roots = Hashed(keys[self.root_at])
        #: Grams looked up before and what was found; each has one place, the latest stays.
        self.seen, self.found = np.full(REMEMBERED, -1, np.int64), np.zeros(REMEMBERED)
        return self

    def count_of(self, hashes: np.ndarray) -> np.ndarray:
        """Training count of words of this block, 0 for others."""
        if not len(self.words):
            return np.zeros(len(hashes), np.int64)
        # In order, neighbours are looked for in the same part of the table.
        order = np.argsort(hashes)
        at = np.empty(len(hashes), np.int64)
        at[order] = np.minimum(np.searchsorted(self.words, hashes[order]), len(self.words) - 1)
        return np.where(self.words[at] == hashes, self.word_counts[at], 0)

    def log10_of(self, keys: np.ndarray) -> np.ndarray:
        """log10 of the probability of each gram's last byte after the bytes before it."""
        at = self.place(keys)
        out = self.found[at]
        new = np.flatnonzero(self.seen[at] != keys)
        codes, distinct = pd.factorize(keys[new])
        walked, at = self.walked(distinct), self.place(distinct)
        out[new] = walked[codes]
        self.seen[at] = distinct
        stays = self.seen[at] == distinct
        self.found[at[stays]] = walked[stays]
        return out

    def place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - REMEMBERED.bit_length())).astype(np.int64)

    def walked(self, keys: np.ndarray) -> np.ndarray:
        """What ``log10_of`` gives, from the nodes along each gram."""
        context, byte = keys >> 8, keys & 255
        at = np.full((DEPTH + 1, len(keys)), -1, np.int64)
        for depth in range(DEPTH + 1):
            root = (np.int64(depth) << (CONTEXT_BITS + NODE_BITS)) | ((context & ((1 << (8 * depth)) - 1)) << NODE_BITS) | 1
            found = self.roots.find(root)
            at[depth] = np.where(found >= 0, self.root_at[found], -1) if len(self.root_at) else -1
        product = np.ones(len(keys))
        for step in range(8):
            bit = (byte >> (7 - step)) & 1
            rarer = np.full(len(keys), 0.5, np.float32)
            for depth in range(DEPTH + 1):
                known = np.flatnonzero(at[depth] >= 0)
                rarer[known] = self.rarer[at[depth, known]]
                at[depth, known] = self.children[bit[known], at[depth, known]]
            p = np.abs(rarer).astype(np.float64)
            product *= np.where((rarer > 0) == (bit == 1), p, 1 - p)
        # Counts of 64 bits leave no factor below 1e-20.
        return np.log10(product)


def _scored(batches: Iterator[pa.RecordBatch], shared: Broadcast) -> Iterator[pa.RecordBatch]:
    block: Block = shared.value.ready()
    floor = block.train_tokens + block.distinct_tokens + 1
    for batch in steps(batches, most=STEP):
        docs = spelled(batch.column("text"))
        own = docs.own()
        if block.blocks > 1:
            own &= docs.shares() % block.blocks == block.number
        own = np.flatnonzero(own)
        summed = np.concatenate(([0.0], np.cumsum(block.log10_of(docs.keys(own)))))
        score = np.diff(summed[np.searchsorted(own, np.concatenate(([0], docs.ends)))])

        offsets, base, known = docs.offsets, np.zeros(len(docs.ends)), np.zeros(len(docs.ends), np.int64)
        if block.number < block.word_blocks:
            ids, distinct = word_ids(docs.words)
            hashes = text_hashes(distinct).view(np.int64)
            mine, count = (hashes & (SHARES - 1)) % block.word_blocks == block.number, np.zeros(len(hashes), np.int64)
            count[mine] = block.count_of(hashes[mine])
            base = np.concatenate(([0.0], np.cumsum(np.where(mine, np.log10((count + 1) / floor), 0.0)[ids])))
            known = np.concatenate(([0], np.cumsum((mine & (count > 0))[ids])))
            first = block.number == 0
            base = base[offsets[1:]] - base[offsets[:-1]] + first * math.log10((block.end_count + 1) / floor)
            known = known[offsets[1:]] - known[offsets[:-1]] + first * (block.end_count > 0)
        columns = [*(batch.column(c) for c in batch.schema.names if c != "text"), pa.array(np.diff(offsets) + 1), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score), pa.array(docs.ends - docs.starts)]
        yield pa.RecordBatch.from_arrays(columns, names=[c for c in batch.schema.names if c != "text"] + ["n_tokens", "n_known", "base_score", "score", "n_bytes"])


@dataclass
class Model:
    """Kept nodes and training words as stored tables, and totals over the training tokens."""

    nodes: DataFrame
    words: DataFrame
    train_tokens: int
    distinct_tokens: int
    end_count: int
    blocks: int
    largest_count: int
    #: Blocks, the first ones, that hold the words.
    word_blocks: int = 1

    def block(self, number: int) -> Block:
        nodes = self.nodes.where((F.col("depth") < SPLIT) | (F.col("share") % self.blocks == number)).select("key", "rarer").orderBy("key").toArrow()
        words = self.words.where(F.pmod(F.col("key").bitwiseAND(SHARES - 1), F.lit(self.word_blocks)) == number if number < self.word_blocks else F.lit(False))
        # 32 bits where they hold every count, and one more of it.
        words = words.select("key", F.col("n").cast("int" if self.largest_count < 2**31 - 1 else "long")).orderBy("key").toArrow()
        pairs = [tuple(t.column(c).to_numpy().copy() for c in ("key", value)) for t, value in ((nodes, "rarer"), (words, "n"))]
        del nodes, words
        # The driver holds a block once only, and gives back what Arrow needed for it.
        pa.default_memory_pool().release_unused()
        return Block(number, self.blocks, self.word_blocks, *pairs, (self.train_tokens, self.distinct_tokens, self.end_count))


def train(docs: DataFrame) -> Model:
    """Gather the counts of all training documents and weight them."""
    training = docs.where(~held_out(F.col("doc_id"))).select("text")
    counted = map_batches(training, _counts, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    counted = written(counted, "gram-counts")
    words = counted.where(F.col("kind") == WORD).select("key", "n")
    tokens, distinct, largest = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    documents = training.count()
    nodes = weighted_nodes(counted.where(F.col("kind") == GRAM).select("key", "n"))
    blocks, word_blocks = (max(1, -(-entries // BLOCK_ENTRIES)) for entries in (nodes.count(), distinct))
    return Model(nodes, words, tokens + documents, distinct + (documents > 0), documents, max(blocks, word_blocks), largest, word_blocks)


def score(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte."""
    read = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    fields = [T.StructField(f.name, f.dataType) for f in read.schema if f.name != "text"]
    if model.blocks > 1:  # rows need a name under which their parts are added up
        read = read.withColumn("_k", F.xxhash64("doc_id", "text")).select("doc_id", "held_out", "_k", "text")
        fields.append(T.StructField("_k", T.LongType()))
    schema = T.StructType(fields).add("n_tokens", "long").add("n_known", "long").add("base_score", "double").add("score", "double").add("n_bytes", "long")
    parts = []
    for number in range(model.blocks):
        shared = spark.sparkContext.broadcast(model.block(number))
        part = map_batches(read, partial(_scored, shared=shared), schema)
        if model.blocks > 1:
            part = written(part, "scores")
            shared.destroy()
        parts.append(part)
    scored = parts[0]
    if model.blocks > 1:
        for part in parts[1:]:
            scored = scored.unionByName(part)
        same = ["doc_id", "held_out", "_k", "n_tokens", "n_bytes"]
        scored = scored.groupBy(*same).agg((F.count("*") / model.blocks).cast("int").alias("_rows"), *[F.sum(c).alias(c) for c in ("n_known", "base_score", "score")])
        scored = scored.select("*", F.explode(F.sequence(F.lit(1), F.col("_rows"))).alias("_")).withColumns({c: F.col(c) / F.col("_rows") for c in ("base_score", "score")}).withColumn("n_known", (F.col("n_known") / F.col("_rows")).cast("long"))
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"), "base_score", "score", "n_bytes",
        (-F.col("score") / F.lit(math.log10(2)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
