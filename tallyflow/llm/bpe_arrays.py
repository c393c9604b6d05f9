"""Token counts by rank-synchronous merging of ragged arrays.

All distinct pre-tokens of a batch lie in one flat array of symbols. In every round each
pre-token finds its pair of lowest rank and merges all its occurrences, for all
pre-tokens at once; the symbols left at the end are the tokens.

Defined cases: a null text counts as empty and has no tokens. Repeated rows are counted
one by one; an empty table gives an empty result; other columns are ignored.
"""

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
import tokenizers
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession

from tallyflow.llm.common import map_batches, steps

#: Distinct pre-tokens whose counts a task remembers at most, and their longest length.
REMEMBERED, REMEMBERED_CHARS = 400_000, 64
#: Up to this character the pattern library and the tokenizer library class all characters
#: alike; beyond it some newer letters differ, so the latter splits such texts.
LAST_ALIKE = "\u0557"
NO_RANK = np.iinfo(np.int64).max


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Merges:
    """Merge table as sorted arrays: pair key, its rank, the symbol it makes."""

    size: int
    keys: np.ndarray
    ranks: np.ndarray
    makes: np.ndarray
    #: Symbol of each byte.
    first: np.ndarray
    #: Strings that are a token of their own wherever they occur in a text.
    special: list[str]
    pattern: str
    #: Counts of pieces seen before.
    known: dict[str, int] = field(default_factory=dict)

    @classmethod
    def read(cls, path: str, pattern: str) -> "Merges":
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        vocab, merges = model["model"]["vocab"], model["model"]["merges"]
        size = max(vocab.values()) + 1
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in merges]
        keys = np.array([vocab[a] * size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        first = np.zeros(256, np.int64)
        for char, byte in byte_symbols().items():
            first[byte] = vocab[char]
        makes = np.array([vocab[a + b] for a, b in pairs], np.int64)
        special = sorted((t["content"] for t in model["added_tokens"] if t["special"]), key=len, reverse=True)
        return cls(size, keys[order], order, makes[order], first, special, pattern)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK), self.makes[at]

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        """Number of symbols left of each piece."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        result = lengths.copy()
        symbols = self.first[np.frombuffer(b"".join(pieces), np.uint8)]
        piece = np.repeat(np.arange(len(pieces)), lengths)
        while len(symbols) > 1:
            rank, makes = self.look_up(symbols[:-1], symbols[1:])
            rank = np.append(np.where(piece[:-1] == piece[1:], rank, NO_RANK), NO_RANK)
            starts = np.flatnonzero(np.append(True, piece[1:] != piece[:-1]))
            lowest = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(symbols)))
            result[piece[starts]] = sizes
            going = np.repeat(lowest < NO_RANK, sizes)
            if not going.any():
                break
            merge = going & (rank == np.repeat(lowest, sizes))
            # In a run of one repeated symbol neighbouring pairs overlap: take every other one.
            at = np.flatnonzero(merge)
            new_run = np.append(True, np.diff(at) > 1)
            run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run_start) % 2 == 0]
            symbols[at] = makes[at]
            going[at + 1] = False
            symbols, piece = symbols[going], piece[going]
        return result


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """Function that splits a text into pre-tokens."""
    find = regex.compile(pattern).findall
    newer = regex.compile(f"[^\0-{LAST_ALIKE}]").search
    library = tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str

    def split(text: str) -> list[str]:
        return [text[a:b] for _, (a, b) in library(text)] if newer(text) else find(text)

    return split


def _counted(batches: Iterator[pa.RecordBatch], shared: Broadcast) -> Iterator[pa.RecordBatch]:
    merges: Merges = shared.value
    find = splitter(merges.pattern)
    cut = regex.compile("|".join(map(regex.escape, merges.special))) if merges.special else None
    known = merges.known
    for batch in steps(batches):
        texts = [t or "" for t in batch.column("text").to_pylist()]
        pieces, extra = [], []
        for text in texts:
            parts = cut.split(text) if cut else [text]
            extra.append(len(parts) - 1)
            pieces.append(find(text) if len(parts) == 1 else [p for part in parts for p in find(part)])
        if len(known) > REMEMBERED:
            known.clear()
        new = list(set().union(*pieces).difference(known))
        known.update(zip(new, merges.counts([p.encode() for p in new]).tolist(), strict=True))
        count = known.__getitem__
        n_tokens = [more + sum(map(count, p)) for more, p in zip(extra, pieces, strict=True)]
        for piece in (p for p in new if len(p) > REMEMBERED_CHARS):
            del known[piece]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n_tokens, pa.int64())],
            names=["doc_id", "n_bytes", "n_tokens"],
        )


def token_counts(spark: SparkSession, docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, n_bytes and n_tokens of every document.

    The vocabulary is read once on the driver and broadcast; its size is that of the file.
    """
    shared = spark.sparkContext.broadcast(Merges.read(vocabulary, pattern))
    schema = docs.select("doc_id").schema.add("n_bytes", "long").add("n_tokens", "long")
    return map_batches(docs.select("doc_id", "text"), lambda batches: _counted(batches, shared), schema)
