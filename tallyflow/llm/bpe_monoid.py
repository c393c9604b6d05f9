"""Byte-level BPE encoding and decoding as a tree reduction.

A piece of text is halved down to short leaves. Leaves are merged by rank; two encoded
neighbours are joined by encoding again a window around their border, which grows until
nothing outside it can change. The test for that: a sequence of tokens is the encoding
of its bytes exactly if each two neighbours are what their joined bytes encode to. So a
window may stop growing once its outermost tokens and their outer neighbours stand this
test. Where it has taken in both sides whole, it is the encoding itself.

Joining is associative, so pieces of any length are reduced in a tree; decoding
concatenates bytes up the same tree.

Defined cases: a null text counts as empty and has no ids. Repeated rows are encoded one
by one; an empty table gives an empty result; other columns are passed through.
"""

import base64
import hashlib
from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tallyflow.llm.common import map_batches, steps

#: Bytes of a leaf, and tokens by which a border window grows.
LEAF, GROW = 16, 2
#: Memory for the ids of pieces that a worker remembers, what one takes besides its contents, and the longest piece.
REMEMBERED_BYTES, ENTRY_BYTES, REMEMBERED_CHARS = 32 << 20, 200, 64
#: Neighbours whose test a worker remembers at most.
REMEMBERED_PAIRS = 200_000
#: Text bytes encoded at once.
STEP = 1 << 20
ID = np.dtype(np.int32)


SINGLE = [bytes((byte,)) for byte in range(256)]


class TreeEncoder:
    """Encoder over a rank table: bytes of each token to its id, which is its rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self._stable: dict[tuple[int, int], bool] = {}
        none = len(ranks)
        #: Rank of each pair of bytes, by first and second, and the decimals of each id.
        self.pair_ranks = [[ranks.get(bytes((a, b)), none) for b in range(256)] for a in range(256)]
        every = range(max(self.bytes_of, default=-1) + 1)
        self.token_bytes = pa.array([self.bytes_of.get(i, b"") for i in every], pa.large_binary())
        self.decimals = pa.array([b"%d," % i for i in every], pa.large_binary())
        #: Ids of pieces seen before, as bytes, and what they take up in memory.
        self.known: dict[str, bytes] = {}
        self.held = 0

    @staticmethod
    def read_ranks(path: str) -> dict[bytes, int]:
        with open(path, "rb") as file:
            return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}

    def leaf(self, data: bytes) -> list[int]:
        """Ids of a short piece: the pair of lowest rank is merged until none is left."""
        parts = [SINGLE[byte] for byte in data]
        none = len(self.ranks)
        rank = self.ranks.get
        pair_ranks = self.pair_ranks
        pairs = [pair_ranks[a][b] for a, b in zip(data, data[1:], strict=False)]
        while pairs and (best := min(pairs)) < none:
            at = pairs.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = rank(parts[at - 1] + parts[at], none)
            if at < len(pairs):
                pairs[at] = rank(parts[at] + parts[at + 1], none)
        return [self.ranks[p] for p in parts]

    def stable(self, left: int, right: int) -> bool:
        """Whether two neighbours are what their joined bytes encode to."""
        known = self._stable.get((left, right))
        if known is None:
            if len(self._stable) > REMEMBERED_PAIRS:
                self._stable.clear()
            known = self._stable[left, right] = self.leaf(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Encoding of two neighbours from the encodings of each."""
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        a = b = GROW
        while True:
            kept_left, kept_right = left[: max(len(left) - a, 0)], right[b:]
            window = self.leaf(self.decode(left[len(kept_left) :] + right[:b]))
            left_holds = not kept_left or self.stable(kept_left[-1], window[0])
            right_holds = not kept_right or self.stable(window[-1], kept_right[0])
            if left_holds and right_holds:
                return kept_left + window + kept_right
            a += 0 if left_holds else a
            b += 0 if right_holds else b

    def encode(self, data: bytes) -> list[int]:
        if len(data) <= LEAF:
            return self.leaf(data)
        half = len(data) // 2
        return self.join(self.encode(data[:half]), self.encode(data[half:]))

    def remembered(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces, as bytes."""
        known, out = self.known, []
        for piece in pieces:
            ids = known.get(piece)
            if ids is None:
                ids = np.array(self.encode(piece.encode()), ID).tobytes()
                if len(piece) <= REMEMBERED_CHARS:
                    size = ENTRY_BYTES + 2 * len(piece) + len(ids)
                    if self.held + size > REMEMBERED_BYTES:
                        known.clear()
                        self.held = 0
                    known[piece] = ids
                    self.held += size
            out.append(ids)
        return out

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of a sequence of ids: concatenation, in halves of any shape."""
        return b"".join(map(self.bytes_of.__getitem__, ids))


def _encoded(batches: Iterator[pa.RecordBatch], shared: Broadcast, kept: list[str], prefix: str, digests: bool) -> Iterator[pa.RecordBatch]:
    encoder, pattern = shared.value
    find = regex.compile(pattern).findall
    for batch in steps(batches, most=STEP):
        pieces = [find(text or "") for text in batch.column("text").to_pylist()]
        last = np.cumsum(list(map(len, pieces)))
        coded = pa.array(chain.from_iterable(pieces), pa.string()).dictionary_encode()
        del pieces
        codes, encoded = coded.indices.to_numpy(), encoder.remembered(coded.dictionary.to_pylist())
        # Pieces are encoded apart, so the root of the tree joins them as they are.
        lengths = np.fromiter(map(len, encoded), np.int64, len(encoded)) // ID.itemsize
        many = lengths[codes]
        bounds = np.concatenate(([0], np.cumsum(many)))[np.concatenate(([0], last))]
        starts = np.cumsum(lengths) - lengths
        ids = np.frombuffer(b"".join(encoded), ID)[np.repeat(starts[codes] - np.cumsum(many) + many, many) + np.arange(many.sum())]
        ends, decoded = joined(encoder.token_bytes, ids, bounds)
        if digests:
            second = pa.array([hashlib.sha256(decoded[a:b]).hexdigest() for a, b in zip(ends, ends[1:], strict=False)], pa.string())
            ends, listed = joined(encoder.decimals, ids, bounds)
            # Without the comma after the last id.
            first = pa.array([hashlib.sha256(listed[a : max(a, b - 1)]).hexdigest() for a, b in zip(ends, ends[1:], strict=False)], pa.string())
        else:
            first = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
            second = pa.array([bytes(decoded[a:b]) for a, b in zip(ends, ends[1:], strict=False)], pa.binary())
        names = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["n_tokens", "ids", "decoded"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(np.diff(bounds)), first, second], names=[*kept, *(prefix + n for n in names)])


def joined(table: pa.Array, ids: np.ndarray, bounds: np.ndarray) -> tuple[list[int], memoryview]:
    """The entries of a table for all ids, one after another, and where each text's share begins."""
    _, ends, data = table.take(pa.array(ids)).buffers()
    return np.frombuffer(ends, np.int64, len(ids) + 1)[bounds].tolist(), memoryview(data or b"")


def encode_documents(spark: SparkSession, docs: DataFrame, ranks: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), digests: bool = False, prefix: str = "") -> DataFrame:
    """Encode every whole text and decode it again.

    Adds ``n_tokens``, ``ids`` and ``decoded`` (the bytes the ids stand for), or with
    ``digests`` their SHA-256 instead. The rank table is read once on the driver and
    broadcast; its size is that of the file.
    """
    shared = spark.sparkContext.broadcast((TreeEncoder(TreeEncoder.read_ranks(ranks)), pattern))
    schema = T.StructType([docs.schema[c] for c in keep]).add(prefix + "n_tokens", "long")
    if digests:
        schema = schema.add(prefix + "ids_sha256", "string").add(prefix + "decoded_sha256", "string")
    else:
        schema = schema.add(prefix + "ids", T.ArrayType(T.IntegerType())).add(prefix + "decoded", "binary")
    read = list(dict.fromkeys([*keep, "text"]))
    return map_batches(docs.select(*read), partial(_encoded, shared=shared, kept=list(keep), prefix=prefix, digests=digests), schema)
