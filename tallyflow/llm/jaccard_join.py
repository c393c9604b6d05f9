"""Exact self-join of documents by the Jaccard similarity of their word shingles.

Jaccard distance is a metric, but two sets with nothing in common are at distance 1
exactly, so no document taken as a pivot tells apart the many that share nothing with
it. The first level therefore has single shingles as pivots: a document's regions are
the first shingles of its set in a common order, as many as it could lose and still be
similar to anything. Two similar documents share such a region. The order is by a sketch
of shingle frequencies, rare ones first; any order gives the same links.

Inside a region the document whose shingles are most frequent is the pivot, as an
original is among its copies. Every member is compared with it, and who is within the
threshold is linked. If links do not hold a whole region together yet, it is joined
further, by member if it is small. Else it is divided by the distance from the pivot:
those near it, with those that the triangle inequality leaves open to partners of theirs,
are joined by their differences from the pivot; those far from it form a region with a
pivot of its own in the next turn. Members that links already hold together need no
further comparison, so the pairs of a group of copies are never all listed.

Documents with equal sets are one node. Nodes are known by a 64-bit digest of their set
beside the full one; every link is computed from the whole texts.

Defined cases: a text without words, or null, has an empty set and is linked with
nothing. Rows that share a doc_id are separate nodes. A null doc_id never names a
component that has another member. An empty table gives an empty result. Other columns
are ignored by ``components`` and kept by ``keep_documents``.
"""

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyflow.llm.common import located, map_batches, mixed, packed, split_words, steps, stored, window_starts, word_hashes
from tallyflow.session import released, written

#: Words in a shingle; least similarity as a fraction.
SHINGLE, SIMILAR, OF = 5, 4, 5
#: Counters of the frequency sketch, and the chunks in which they travel.
COUNTERS, CHUNKS = 1 << 21, 16
#: A shingle this much more frequent than the average counter has its region dealt over shares.
HEAVY, SALTS = 2_000, 64
#: Regions up to this size are compared member by member.
LEAF = 32
#: Pairs of texts compared at once.
PAIRS = 1024
#: Distance up to which a node belongs to its pivot, and the threshold as a distance.
NEAR, REACH = 0.5, (OF - SIMILAR) / OF
#: Within NEAR + REACH of a pivot, the smaller set has OPEN tenths of the larger one's size or more.
OPEN = 3
#: Sets are similar if TWICE times the size of their difference is at most the sum of their sizes.
TWICE = (OF + SIMILAR) // (OF - SIMILAR)


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text, and the offsets of each text's share."""
    offsets, words = split_words(texts, lower=True)
    h = mixed(word_hashes(words))
    n_words = np.diff(offsets)
    at = window_starts(offsets, SHINGLE)
    many = np.zeros(len(at), np.uint64)
    for k in range(SHINGLE):
        many = mixed(many + h[at + k])
    row = np.searchsorted(offsets, at, side="right") - 1
    short = np.flatnonzero((n_words > 0) & (n_words < SHINGLE))
    few = short.astype(np.uint64) * np.uint64(0)
    for k in range(SHINGLE - 1):
        here = n_words[short] > k
        few[here] = mixed(few[here] + h[offsets[short[here]] + k])
    few = mixed(few ^ n_words[short].astype(np.uint64))
    row, hashes = np.concatenate((row, short)), np.concatenate((many, few))
    new = ~pd.Series(mixed(hashes + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))).duplicated().to_numpy()
    row, hashes = row[new], hashes[new]
    order = np.argsort(row, kind="stable")
    return np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(texts))))), hashes[order]


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, values.dtype), np.cumsum(values)))
    return total[offsets[1:]] - total[offsets[:-1]]


def digests(offsets: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free digests of each set."""
    return sums(mixed(hashes), offsets).view(np.int64), sums(mixed(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)), offsets).view(np.int64)


def _sets(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    counters = np.zeros(COUNTERS, np.uint32)
    schema = None
    for batch in steps(batches):
        offsets, hashes = shingles(batch.column("text"))
        counters += np.bincount((hashes & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS).astype(np.uint32)
        node, second = digests(offsets, hashes)
        none = pa.nulls(batch.num_rows)
        out = pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("doc_id", "_file", "_row")), pa.array(np.diff(offsets)), pa.array(node), pa.array(second), none.cast(pa.int32()), none.cast(pa.binary())], names=names
        )
        schema = out.schema
        yield out
    if schema is not None:
        parts = np.split(counters, CHUNKS)
        columns = [pa.nulls(CHUNKS, f.type) for f in schema][:-2] + [pa.array(range(CHUNKS), pa.int32()), pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts = np.frombuffer(zlib.decompress(packed), np.uint32).astype(np.uint64)
            total[chunk] = total[chunk] + counts if chunk in total else counts
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([zlib.compress(c.tobytes(), 1) for c in total.values()], pa.binary())], names=["chunk", "counts"])


def frequencies(chunks: DataFrame) -> np.ndarray:
    """The sketch added up over all tasks; it has a fixed size."""
    found = map_batches(chunks.repartition(CHUNKS, "chunk"), _summed, "chunk int, counts binary").collect()
    total = np.zeros((CHUNKS, COUNTERS // CHUNKS), np.uint64)
    for row in found:
        total[row.chunk] += np.frombuffer(zlib.decompress(row.counts), np.uint64)
    return total.ravel()


def _regions(batches: Iterator[pa.RecordBatch], shared: Broadcast) -> Iterator[pa.RecordBatch]:
    counts, limit = shared.value
    for batch in steps(batches):
        offsets, hashes = shingles(batch.column("text"))
        node, _ = digests(offsets, hashes)
        size = np.diff(offsets)
        row = np.repeat(np.arange(len(size)), size)
        count = counts[(hashes & np.uint64(COUNTERS - 1)).astype(np.int64)]
        order = np.lexsort((hashes, count, row))
        place = np.arange(len(order)) - np.repeat(offsets[:-1], size)
        lead = size - (SIMILAR * size + OF - 1) // OF + 1
        first = ~pd.Series(node).duplicated().to_numpy()
        chosen = order[(place < lead[row]) & first[row]]
        # An original's shingles are all in its copies too; each edit of a copy makes new, rare ones.
        rarity = -np.floor(1024 * sums(np.log2(count + 1.0), offsets) / np.maximum(size, 1)).astype(np.int64)
        columns = (hashes[chosen].view(np.int64), node[row[chosen]], size[row[chosen]], rarity[row[chosen]], count[chosen] >= limit)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["region", "node", "size", "rarity", "heavy"])


def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Some pairs of texts at a time, with the number of the pair, the hash and a key of both for
    every shingle of either text, and the set sizes of both sides. A text in many pairs is
    split once."""
    for whole in batches:
        for at in range(0, whole.num_rows, PAIRS):
            batch = whole.slice(at, PAIRS)
            both = pa.chunked_array([batch.column("text_a"), batch.column("text_b")]).combine_chunks().dictionary_encode()
            index = both.indices.to_numpy()
            offsets, hashes = shingles(both.dictionary)
            size = np.diff(offsets)[index]
            own = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(offsets[index], size)
            pair = np.repeat(np.arange(len(index)) % batch.num_rows, size)
            key = mixed(hashes[own] + pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            yield batch, pair, hashes[own], key, size[: batch.num_rows], size[batch.num_rows :]


def _overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, pair, _, key, a, b in paired(batches):
        shared = np.bincount(pair[pd.Series(key).duplicated().to_numpy()], minlength=batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(shared), pa.array(a + b - shared)], names=["a", "b", "common", "united"])


def compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Intersection and union sizes of pairs of nodes (a, b), from their whole texts."""
    side = [texts.select(F.col("node").alias(s), F.col("text").alias(f"text_{s}")) for s in "ab"]
    joined = pairs.select("a", "b").distinct().join(side[0], "a").join(side[1], "b")
    return map_batches(joined, _overlap, "a long, b long, common long, united long")


def similar(a: str, b: str) -> Column:
    """Whether two set sizes allow a link at all."""
    return OF * F.least(a, b) >= SIMILAR * F.greatest(a, b)


LINKED = f"{OF} * common >= {SIMILAR} * united"


def connected(edges: DataFrame) -> DataFrame:
    """node and the smallest node it is connected with, for all nodes with an edge.

    Large-star and small-star steps in turn: each hangs neighbours on the smallest one
    known, until nothing changes.
    """

    def checked(table: DataFrame) -> tuple[DataFrame, tuple]:
        table = written(table.distinct(), "stars")
        return table, tuple(table.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    def smallest(of: DataFrame) -> DataFrame:
        least = of.groupBy("u").agg(F.min("v").alias("m"))
        return of.join(least, "u").withColumn("m", F.least("m", "u"))

    table, state = checked(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v"))
    while True:
        both = table.unionByName(table.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = smallest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = smallest(large.where("u <> v"))
        hung = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        before = table
        table, after = checked(hung.where("u <> v"))
        released(before)
        if after == state:
            break
        state = after
    return table.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(table.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _differences(batches: Iterator[pa.RecordBatch], shared: Broadcast) -> Iterator[pa.RecordBatch]:
    counts, _ = shared.value
    for batch, pair, hashes, key, a, b in paired(batches):
        alone = ~pd.Series(key).duplicated(keep=False).to_numpy()
        pair, element = pair[alone], hashes[alone]
        order = np.lexsort((element, counts[(element & np.uint64(COUNTERS - 1)).astype(np.int64)], pair))
        pair, element = pair[order], element[order]
        delta = np.bincount(pair, minlength=batch.num_rows)
        place = np.arange(len(pair)) - np.repeat(np.cumsum(delta) - delta, delta)
        excess = TWICE * delta - a
        linked = excess <= b
        # Fewest common differences with a partner that isn't linked to the pivot, and with any partner.
        fewest = np.maximum((excess + b) // (2 * TWICE) + 1, 1)
        with_any = np.maximum(-(-(excess + TWICE - OF * a // SIMILAR - 1) // (2 * TWICE)), 1)
        short = place < (delta - fewest + 1)[pair]
        chosen = short | (~linked[pair] & (place < (delta - with_any + 1)[pair]))
        rows = pair[chosen]
        owned = [batch.column(c).take(pa.array(rows)) for c in "ba"]
        yield pa.RecordBatch.from_arrays([*owned, pa.array(element[chosen].view(np.int64)), pa.array(linked[rows]), pa.array(short[chosen])], names=["pivot", "node", "element", "linked", "short"])


def around_pivots(near: DataFrame, texts: DataFrame, counts: Broadcast, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The stored differences, and the pairs that may be similar although links don't hold them together yet, of nodes near one pivot.

    Two sets differ by the difference of their differences from the pivot. If both were
    closer to it than the threshold they would be linked through it; so the differences of
    any other similar pair have a least number of elements in common, and share one of the
    first few in a common order. ``facts`` has node, root and size.
    """
    side = [texts.select(F.col("node").alias(s), F.col("text").alias(f"text_{s}")) for s in "ab"]
    joined = near.select("a", "b").join(side[0], "a").join(side[1], "b")
    rows = map_batches(joined, partial(_differences, shared=counts), "pivot long, node long, element long, linked boolean, short boolean")
    rows = written(rows.join(facts, "node"), "differences")
    other = rows.where("not linked").select("pivot", "element", F.col("node").alias("b"), F.col("short").alias("b_short"), F.col("size").alias("b_size"), F.col("root").alias("b_root"))
    met = rows.where("short").withColumnRenamed("node", "a").join(other, ["pivot", "element"]).where("root <> b_root and (linked or (b_short and a < b))")
    return rows, met.where(similar("size", "b_size")).select("a", "b").distinct()


def first_regions(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """region, node, size, rarity and pivot (the least rare node) of all regions with two nodes or more.

    Regions of frequent shingles are first taken in SALTS shares, so that one that holds a
    third of all documents is no single group.
    """
    limit = int(counts.sum()) // COUNTERS + HEAVY
    shared = docs.sparkSession.sparkContext.broadcast((counts, limit))
    rows = map_batches(docs.select("text"), partial(_regions, shared=shared), "region long, node long, size long, rarity long, heavy boolean")
    region = Window.partitionBy("region", "share")
    rows = rows.withColumn("share", F.when(F.col("heavy"), F.pmod("node", F.lit(SALTS))).otherwise(0))
    rows = rows.select("*", F.min(F.struct("rarity", "node")).over(region).alias("pivot"), F.max(F.struct("rarity", "node")).over(region).alias("last"))
    rows = written(rows.where("heavy or pivot <> last"), "regions")
    light, heavy = rows.where("not heavy"), rows.where("heavy")
    pivots = heavy.groupBy("region").agg(F.min("pivot").alias("pivot"), F.max("last").alias("last")).where("pivot <> last").drop("last")
    columns = ["region", "node", "size", "rarity", F.col("pivot.node").alias("pivot")]
    return light.select(*columns).unionByName(heavy.drop("pivot").join(pivots, "region").select(*columns))


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Facts of every row (doc_id, n_shingles, node, second, _file, _row), and node -> root of all linked nodes."""
    placed = located(docs.select("doc_id", "text"))
    head = [placed.schema[c] for c in ("doc_id", "_file", "_row")]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in head]).add("n_shingles", "long").add("node", "long").add("second", "long").add("chunk", "integer").add("counts", "binary")
    sets = written(map_batches(placed, partial(_sets, names=schema.names), schema), "sets")
    facts = written(sets.where("chunk is null").drop("chunk", "counts"), "facts")
    counts = frequencies(sets.where("chunk is not null").select("chunk", "counts"))
    released(sets)
    rows = first_regions(placed, counts)
    if rows.isEmpty():
        return facts, None

    # Texts of one row of each node that is in some region.
    chosen = facts.where("n_shingles > 0").groupBy("node", "second").agg(F.min(F.struct("_file", "_row")).alias("at"))
    chosen = chosen.join(rows.select("node").distinct(), "node").select("node", "at.*")
    texts = written(placed.join(chosen, ["_file", "_row"]).select("node", "text"), "texts")
    shared = placed.sparkSession.sparkContext.broadcast((counts, 0))
    edges, roots, turn = None, None, 0
    while True:
        turn, of_turn = turn + 1, [rows]
        sizes = rows.select(F.col("node").alias("b"), F.col("size").alias("b_size")).distinct()
        meets = rows.where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b"), "size").distinct().join(sizes, "b")
        # Beyond twice the size the distance is over NEAR, which is all that is asked of it.
        meets = meets.where(similar("size", "b_size") if turn == 1 else 2 * F.least("size", "b_size") >= F.greatest("size", "b_size"))
        found = written(compared(meets, texts), "distances")
        linked = found.where(LINKED)
        edges = written(linked if edges is None else edges.unionByName(linked), "links")
        roots = connected(edges)
        labelled = rows.where("node <> pivot").distinct().join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        shares = labelled.groupBy("region", "root").agg(F.count("*").alias("n"))
        state = shares.groupBy("region").agg(F.sum("n").alias("members"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
        left = written(labelled.join(state, "region"), "left")
        of_turn += [found, left]
        if left.isEmpty():
            released(texts, *of_turn)
            return facts, roots
        # Small regions, and larger ones in every further turn, are compared member by member.
        leaf = LEAF * 4 ** (turn - 1)
        small = left.where(F.col("members") <= leaf)
        other = small.select("region", F.col("node").alias("b"), F.col("size").alias("b_size"), F.col("root").alias("b_root"))
        pairs = small.withColumnRenamed("node", "a").join(other, "region").where("root <> b_root and a < b").where(similar("size", "b_size")).select("a", "b")
        large = written(left.where(F.col("members") > leaf).select("region", "node", "size", "rarity", "pivot", "root"), "large")
        again = not large.isEmpty()
        if again:
            meets = large.select(F.col("node").alias("a"), F.col("pivot").alias("b"), "size").distinct().join(sizes, "b").where(10 * F.least("size", "b_size") >= OPEN * F.greatest("size", "b_size"))
            found = written(found.unionByName(compared(meets.join(found.select("a", "b"), ["a", "b"], "left_anti"), texts)), "distances")
            distance = 1 - F.col("common") / F.col("united")
            near = meets.join(found, ["a", "b"]).where(distance <= NEAR + REACH + 1e-9)
            differing, around = around_pivots(near, texts, shared, large.select("node", "root", "size").distinct())
            pairs = pairs.unionByName(around)
            of_turn += [found, differing]
            known = found.select(F.col("a").alias("node"), F.col("b").alias("pivot"), distance.alias("distance"))
            far = large.join(known, ["node", "pivot"], "left").where(F.coalesce("distance", F.lit(1.0)) > NEAR)
        edges = written(edges.unionByName(compared(pairs, texts).where(LINKED)), "links")
        if not again:
            released(texts, large, *of_turn)
            return facts, connected(edges)
        pivots = far.groupBy("region").agg(F.min(F.struct("rarity", "node")).alias("p"), F.count("*").alias("n")).where("n > 1").select("region", F.col("p.node").alias("pivot"))
        rows = written(far.select("region", "node", "size", "rarity").join(pivots, "region"), "far")
        released(large, *of_turn)
        if rows.isEmpty():
            released(texts, rows)
            return facts, connected(edges)


def components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row, with its ``_file`` and ``_row``."""
    facts, roots = links(docs)
    named = facts if roots is None else facts.join(roots, "node", "left")
    # Nodes without a link stand for themselves; an empty set stands alone.
    group = F.coalesce("root", "node") if roots is not None else F.col("node")
    named = named.withColumn("_group", group)
    least = named.where("n_shingles > 0").groupBy("_group").agg(F.min("doc_id").alias("_least")).withColumnRenamed("_group", "_g")
    joined = named.join(least, (F.col("_group") == F.col("_g")) & (F.col("n_shingles") > 0), "left")
    return joined.select("doc_id", "n_shingles", F.coalesce("_least", "doc_id").alias("component_id"), "_file", "_row", F.when(F.col("n_shingles") > 0, F.col("_group")).alias("_group"))


def keep_documents(docs: DataFrame) -> DataFrame:
    """One document of each component, that of the smallest doc_id, with all its columns."""
    docs = stored(docs)
    found = written(components(docs), "components")
    first = found.where("_group is not null").groupBy("_group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "_file", "_row")).alias("first"))
    dropped = found.join(first, "_group").where(~((F.col("first._file") == F.col("_file")) & (F.col("first._row") == F.col("_row")))).select("_file", "_row")
    return packed(docs).join(dropped, ["_file", "_row"], "left_anti").select("_doc.*")
