"""Mixing sources to target weights.

The words of each source, its documents in a fixed pseudorandom order, are packed into
blocks of fixed length. The mix is a row of output shards with a fixed number of slots.
Each shard draws from a multinomial how many of its slots each source fills. What all
draws together differ from the targets is settled evenly: a source drawn too often gives
every so-many-th slot to the sources drawn too seldom. A source's slots, counted over
all shards, pass through a keyed permutation of its block numbers, a new one for every
pass over the source, so that each block comes once per pass. Slots and blocks are joined
by source and block number.

The last slot of a source is cut so that its words meet the target exactly.

Defined cases: a null or empty text has no words and is in no block; null is a source of
its own. Repeated rows have words of their own. An empty table gives an empty result.
Other columns are ignored by ``mix`` and kept by ``mixed_documents``.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.llm.common import located, map_batches, mixed, packed, running_start, steps, stored, word_count
from tallyflow.session import written

#: Words in a block, and slots in an output shard.
BLOCK_WORDS, SHARD_SLOTS = 256, 1024
#: Weights of the sources in code point order, repeating; share of all words; passes at most.
WEIGHTS, SHARE, PASSES = (5.0, 2.0, 1.0), 1.5, 2.0
#: Documents of a source are dealt over this many ranges of their hash.
BUCKETS = 1024
#: One row per source reaches the driver; more sources than this are an error.
MOST_SOURCES = 100_000
SEED = 20_240_601


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, passes: float = PASSES) -> list[float]:
    """Words each source should give: by weight, at most ``passes`` times its size."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    result = [0.0] * len(sizes)
    open_, left = list(range(len(sizes))), share * sum(sizes)
    while open_:
        per_weight = left / sum(weight[i] for i in open_)
        over = [i for i in open_ if per_weight * weight[i] > passes * sizes[i]]
        if not over:
            for i in open_:
                result[i] = per_weight * weight[i]
            break
        for i in over:
            result[i] = passes * sizes[i]
            left -= result[i]
        open_ = [i for i in open_ if i not in set(over)]
    return result


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Keyed permutation of 0 .. size - 1, for arrays of equal length.

    A Feistel network permutes the next even power of two; what falls outside goes
    through again until it falls inside.
    """
    half = np.ones(len(index), np.uint64)
    while (grow := (np.uint64(1) << (half * np.uint64(2))) < size).any():
        half[grow] += np.uint64(1)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half[todo], out[todo] & mask[todo]
        for turn in range(4):
            left, right = right, left ^ (mixed(right + key[todo] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(turn << 40)) & mask[todo])
        out[todo] = (left << half[todo]) | right
        todo = todo[out[todo] >= size[todo]]
    return out.astype(np.int64)


@dataclass
class Plan:
    """Per source, in code point order with null last: words, target, and slots of the mix."""

    names: list[str | None]
    sizes: np.ndarray
    targets: np.ndarray
    #: Words taken, the rounded target.
    words: np.ndarray
    block_words: int
    shard_slots: int

    def __post_init__(self) -> None:
        b = self.block_words
        self.full = self.sizes // b
        self.per_pass = -(-self.sizes // b)
        whole = np.where(self.sizes > 0, self.words // np.maximum(self.sizes, 1), 0)
        rest = self.words - whole * self.sizes
        self.slots = whole * self.per_pass + np.where(rest > self.full * b, self.full + 1, -(-rest // b))
        self.total = int(self.slots.sum())
        self.shards = -(-self.total // self.shard_slots)

    def draws(self, shard: int) -> np.ndarray:
        """Slots of the shard that each source fills, before settling."""
        slots = min(self.shard_slots, self.total - shard * self.shard_slots)
        return np.random.default_rng((SEED, shard)).multinomial(slots, self.slots / self.total)

    def settle(self, drawn: np.ndarray) -> None:
        """Learn how often each source was drawn in all, and so who gives and who takes."""
        self.drawn = drawn
        self.given = np.cumsum(np.maximum(drawn - self.slots, 0))
        self.taken = np.cumsum(np.maximum(self.slots - drawn, 0))

    def settled(self, source: np.ndarray, ordinal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Source and ordinal of drawn slots after settling."""
        drawn, due = self.drawn[source], self.slots[source]
        before, after = ordinal * due // np.maximum(drawn, 1), (ordinal + 1) * due // np.maximum(drawn, 1)
        keeps = (drawn <= due) | (after > before)
        out_source, out_ordinal = source.copy(), np.where(drawn <= due, ordinal, before)
        gives = ~keeps
        if gives.any():
            number = (self.given - np.maximum(self.drawn - self.slots, 0))[source[gives]] + (ordinal - before)[gives]
            total = np.full(len(number), self.given[-1], np.uint64)
            number = permuted(number, total, np.full(len(number), SEED, np.uint64))
            taker = np.searchsorted(self.taken, number, side="right")
            out_source[gives] = taker
            out_ordinal[gives] = self.drawn[taker] + number - (self.taken - np.maximum(self.slots - self.drawn, 0))[taker]
        return out_source, out_ordinal

    def blocks(self, source: np.ndarray, ordinal: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pass, block number and words taken of a source's slots."""
        per_pass, full, b = self.per_pass[source], self.full[source], self.block_words
        turn, at = ordinal // per_pass, ordinal % per_pass
        key = mixed((source.astype(np.uint64) << np.uint64(20)) + turn.astype(np.uint64) + np.uint64(SEED))
        block = at.copy()  # the short last block ends every pass
        inner = at < full
        block[inner] = permuted(at[inner], full[inner].astype(np.uint64), key[inner])
        length = np.minimum(b, self.sizes[source] - at * b)
        left = self.words[source] - turn * self.sizes[source] - at * b
        return turn, block, np.minimum(length, left)


def plan_mix(sizes: DataFrame, weights: tuple[float, ...], share: float, block_words: int, shard_slots: int) -> Plan:
    rows = sizes.groupBy("source").agg(F.sum("size").alias("size")).limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    rows.sort(key=lambda r: (r.source is None, r.source or ""))
    words = [r["size"] for r in rows]
    goal = targets(words, weights, share)
    return Plan([r.source for r in rows], np.array(words, np.int64), np.array(goal), np.floor(np.array(goal) + 0.5).astype(np.int64), block_words, shard_slots)


def shard_draws(spark: SparkSession, plan: Plan) -> DataFrame:
    """shard, source_no and the count drawn, where not 0."""
    shared = spark.sparkContext.broadcast(plan)  # one entry per source, MOST_SOURCES at most

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                counts = shared.value.draws(shard)
                (source,) = np.nonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(source), shard)), pa.array(source.astype(np.int32)), pa.array(counts[source])], names=["shard", "source_no", "drawn"])

    return map_batches(spark.range(plan.shards), draw, "shard long, source_no int, drawn long")


def mixed_slots(spark: SparkSession, plan: Plan) -> DataFrame:
    """One row per slot of the mix: shard, position, source_no, pass, block, words taken."""
    draws = written(shard_draws(spark, plan), "draws")
    totals = np.zeros(len(plan.names), np.int64)
    for row in draws.groupBy("source_no").agg(F.sum("drawn").alias("drawn")).collect():  # one row per source
        totals[row.source_no] = row.drawn
    plan.settle(totals)
    shared = spark.sparkContext.broadcast(plan)
    in_shard = running_start(draws, ["shard"], [F.col("source_no")], "drawn", "position", F.lit(0))
    placed = running_start(in_shard, ["source_no"], [F.col("shard")], "drawn", "ordinal", F.floor(F.col("shard") / BUCKETS))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, source, drawn, position, ordinal = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns)
            inside = np.arange(drawn.sum()) - np.repeat(np.cumsum(drawn) - drawn, drawn)
            source, number = shared.value.settled(np.repeat(source, drawn), np.repeat(ordinal, drawn) + inside)
            turn, block, words = shared.value.blocks(source, number)
            columns = (np.repeat(shard, drawn), np.repeat(position, drawn) + inside, source.astype(np.int32), turn.astype(np.int32), block, words)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["shard", "position", "source_no", "pass", "block", "words"])

    return map_batches(placed.select("shard", "source_no", "drawn", "position", "ordinal"), spread, "shard long, position long, source_no int, pass int, block long, words long")


def mix(docs: DataFrame, keep: tuple[str, ...] = (), weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS) -> tuple[DataFrame, DataFrame, Plan]:
    """The sized documents, the pieces of documents that fill the mix's slots, and the plan.

    Sized: doc_id, the columns ``keep``, source_no, size, start (of its words in its source). Pieces: shard,
    position, source_no, pass, block, start (names the document), from_word and to_word.
    """
    spark = docs.sparkSession
    sizes = written(docs.select(*keep, "doc_id", "source", word_count(F.col("text")).alias("size"), F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("_crc")), "sizes")
    plan = plan_mix(sizes, weights, share, block_words, shard_slots)
    names = spark.createDataFrame([(i, n) for i, n in enumerate(plan.names)], "source_no int, _name string")
    # One row per source, MOST_SOURCES at most.
    numbered = sizes.join(F.broadcast(names), F.col("source").eqNullSafe(F.col("_name"))).drop("_name", "source")
    order = [F.xxhash64("doc_id", "_crc"), F.col("doc_id"), F.col("_crc"), F.col("size"), *map(F.col, keep)]
    sized = written(running_start(numbered, ["source_no"], order, "size", "start", F.shiftrightunsigned(order[0], 54)), "placed")
    first, last = F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words)
    parts = sized.where("size > 0").select("source_no", "start", "size", F.explode(F.sequence(first, last)).alias("block"))
    at = F.col("block") * block_words
    parts = parts.select("source_no", "block", "start", F.greatest(at, "start").alias("_from"), F.least(at + block_words, F.col("start") + F.col("size")).alias("_to"))
    slots = mixed_slots(spark, plan)
    end = F.least("_to", at + F.col("words"))
    pieces = slots.join(parts, ["source_no", "block"]).where(end > F.col("_from")).select(
        "shard", "position", "source_no", "pass", "block", "start", (F.col("_from") - F.col("start")).alias("from_word"), (end - F.col("start")).alias("to_word")
    )
    return sized, pieces, plan


def document_counts(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    sized, pieces, plan = mix(docs)
    facts = [(i, int(s), float(t)) for i, (s, t) in enumerate(zip(plan.sizes, plan.targets, strict=True))]
    sources = docs.sparkSession.createDataFrame(facts, "source_no int, source_size long, target double")
    taken = pieces.groupBy("source_no", "start").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    # A document without words starts where the next one does, and takes nothing.
    taken = taken.select(F.col("source_no").alias("_s"), F.col("start").alias("_at"), "taken")
    own = (F.col("source_no") == F.col("_s")) & (F.col("start") == F.col("_at")) & (F.col("size") > 0)
    counted = sized.join(taken, own, "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))
    return counted.join(F.broadcast(sources), "source_no").select("doc_id", "size", "source_size", "target", "taken")


def _cut(batches: Iterator[pa.RecordBatch], kept: list[str]) -> Iterator[pa.RecordBatch]:
    find = regex.compile(r"[^\x20\x09-\x0D]+").finditer
    for batch in steps(batches):
        rows, texts, lengths = [], [], []
        for row, (text, pieces) in enumerate(zip(batch.column("text").to_pylist(), batch.column("_pieces").to_pylist(), strict=True)):
            spans = [m.span() for m in find(text)]
            runs: list[list[int]] = []
            for piece in pieces:
                if runs and runs[-1][0] == piece["pass"] and runs[-1][2] == piece["from_word"]:
                    runs[-1][2] = piece["to_word"]
                else:
                    runs.append([piece["pass"], piece["from_word"], piece["to_word"]])
            for _, first, end in runs:
                rows.append(row)
                texts.append(text if first == 0 and end == len(spans) else text[spans[first][0] : spans[end - 1][1]])
                lengths.append(len(texts[-1]))
        taken = batch.column("_doc").take(pa.array(rows, pa.int64()))
        own = {"text": pa.array(texts, pa.string()), "n_chars": pa.array(lengths, pa.int64())}
        columns = [own[c].cast(taken.field(c).type) if c in own else taken.field(c) for c in kept]
        yield pa.RecordBatch.from_arrays(columns, names=kept)


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents: every run of words that one pass takes from a document is a row.

    A whole pass over a document gives its text unchanged; a run is the text from its first
    to its last word. All columns are kept; ``n_chars``, where there is one, is that of the run.
    """
    docs = stored(docs)
    sized, pieces, _ = mix(located(docs.select("doc_id", "text", "source")), keep=("_file", "_row"))
    by_document = pieces.groupBy("source_no", "start").agg(F.sort_array(F.collect_list(F.struct("pass", "from_word", "to_word"))).alias("_pieces"))
    taken = sized.where("size > 0").join(by_document, ["source_no", "start"]).select("_file", "_row", "_pieces")
    return map_batches(packed(docs, "text").join(taken, ["_file", "_row"]), partial(_cut, kept=docs.columns), docs.schema)
