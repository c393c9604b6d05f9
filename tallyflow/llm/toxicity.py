"""Toxicity scores by a bidirectional gated recurrent network with attention pooling.

Each word enters as a word embedding beside two made of its characters, the mean of its
grams and the one of its head, so that words the sample hardly knows are read by their letters. A text is cut into overlapping
windows of words; a gated recurrent unit reads each window from either side, attention
pools what both saw, and a logistic output scores the window. A document's score is that
of its most toxic window. All windows of whole texts are scored, in numpy inside the tasks.

The network is trained in numpy on a bounded sample: at most MOST_TOXIC toxic and
MOST_CLEAN other labelled training documents, chosen by a hash of their doc_id, and of
each at most BAG windows, chosen by a hash of their position. Only a document's most
toxic window learns. The output is then shifted from the sample's share of toxic
documents to their share among all labelled training documents.

Defined cases: a null, empty or blank text has nothing toxic in it and scores 0. Training labels that are null are left out; of several labels of a
doc_id the highest counts. Without labels of both kinds everything scores the known share
of toxic documents, or 0. Repeated rows are scored one by one. An empty table gives an
empty result. Other columns are ignored.
"""

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyflow.llm.common import map_batches, mixed, split_words, steps, word_hashes, word_ids

#: Words of a window, and from one window's start to the next.
WINDOW, STRIDE = 64, 48
#: Bounds of the training sample: documents of either kind, and windows of each.
MOST_TOXIC, MOST_CLEAN, BAG = 1500, 3000, 16
#: Words found in this many sample documents have an embedding of their own; others share one.
LEAST_DOCUMENTS = 4
#: Bytes of a word that make its head.
HEAD = 5
#: Rows of the character and head tables, widths of the tables, hidden units of each direction, attention width.
CHAR_ROWS, HEAD_ROWS, WORD_DIM, CHAR_DIM, HEAD_DIM, HIDDEN, ATTENTION = 1 << 12, 1 << 14, 8, 6, 8, 12, 8
#: Training: documents per update, passes, updates at least, learning rate, decay of embeddings.
BATCH, EPOCHS, UPDATES, RATE, DECAY = 64, 6, 200, 0.01, 1e-4
#: Punctuation at either end of a word that the network does not see.
TRIMMED = ".,;:!?\"'()[]"
#: Windows that go through the network together.
TOGETHER = 4096
#: Score from which a document counts as toxic.
THRESHOLD = 0.3

Parameters = dict[str, np.ndarray]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def seen_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Word offsets and lower-cased words without punctuation around them."""
    offsets, words = split_words(texts, lower=True)
    bare = pa.compute.ascii_trim(words, TRIMMED)
    return offsets, pa.compute.if_else(pa.compute.equal(bare, ""), words, bare)


class Vocabulary:
    """Distinct words of a batch: rows of the word table, and of the character table in one ragged array."""

    def __init__(self, words: pa.Array, known: np.ndarray):
        self.ids, distinct = word_ids(words)
        hashes = word_hashes(distinct)
        at = np.searchsorted(known, hashes)
        # Row 0 is for all words without an embedding of their own.
        self.word_rows = np.where(np.append(known, [0])[at] == hashes, at + 1, 0) if len(known) else np.zeros(len(hashes), np.int64)
        distinct = distinct.cast(pa.large_binary())
        sizes = np.asarray(pa.compute.binary_length(distinct)).astype(np.int64)
        # A mark on either side; grams of three bytes, as many as the word has.
        data = np.frombuffer(b"".join(b"\x01" + w + b"\x02" for w in distinct.to_pylist()), np.uint8).astype(np.uint64)
        starts = np.cumsum(sizes + 2) - (sizes + 2)
        at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)
        grams = (data[at] << np.uint64(16)) | (data[at + 1] << np.uint64(8)) | data[at + 2] if len(at) else np.zeros(0, np.uint64)
        self.char_rows = (mixed(grams) % np.uint64(CHAR_ROWS)).astype(np.int64)
        self.sizes, self.char_starts = sizes, np.cumsum(sizes) - sizes
        head = np.zeros(len(sizes), np.uint64)
        for k in range(HEAD):
            here = starts + 1 + k
            head = (head << np.uint64(8)) | np.where(k < sizes, data[np.minimum(here, max(len(data) - 1, 0))], 0).astype(np.uint64) if len(data) else head
        self.head_rows = (mixed(head) % np.uint64(HEAD_ROWS)).astype(np.int64)

    def inputs(self, p: Parameters) -> np.ndarray:
        """Input vector of each distinct word."""
        if not len(self.sizes):
            return np.zeros((0, WORD_DIM + CHAR_DIM + HEAD_DIM), np.float32)
        chars = np.add.reduceat(p["chars"][self.char_rows], self.char_starts, axis=0) / self.sizes[:, None].astype(np.float32)
        return np.concatenate([p["words"][self.word_rows], chars, p["heads"][self.head_rows]], axis=1)


def windows(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and length of all windows; the last one of a text ends with it, and an empty text has one."""
    n = np.diff(offsets)
    count = 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE))
    row = np.repeat(np.arange(len(n)), count)
    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    start = np.minimum(step * STRIDE, np.maximum(n[row] - WINDOW, 0))
    return row, offsets[row] + start, np.minimum(n[row], WINDOW)


def initial(known: np.ndarray, seed: int = 7) -> Parameters:
    """Random parameters; ``known`` has the sorted hashes of the words with an embedding."""
    rng = np.random.default_rng(seed)
    d, h = WORD_DIM + CHAR_DIM + HEAD_DIM, HIDDEN
    shapes = {"words": (len(known) + 1, WORD_DIM), "chars": (CHAR_ROWS, CHAR_DIM), "heads": (HEAD_ROWS, HEAD_DIM), "attend": (2 * h, ATTENTION), "attend_b": (ATTENTION,), "focus": (ATTENTION,), "out": (2 * h,), "out_b": (1,)}
    for side in "fb":
        shapes |= {f"in_{side}": (d, 3 * h), f"re_{side}": (h, 3 * h), f"bias_{side}": (3 * h,)}
    p = {k: (rng.standard_normal(s) * (0.1 if k in ("words", "chars", "heads") else 1 / np.sqrt(s[0]))).astype(np.float32) for k, s in shapes.items()}
    for k in ("attend_b", "out_b", "bias_f", "bias_b"):
        p[k][:] = 0
    return p


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def read(projected: np.ndarray, token: np.ndarray, length: np.ndarray, p: Parameters, side: str, tape: list | None) -> np.ndarray:
    """States of one direction, by position: token has positions in rows and windows in columns."""
    span, many, h = *token.shape, HIDDEN
    states = np.zeros((span, many, h), np.float32)
    state = np.zeros((many, h), np.float32)
    for t in range(span) if side == "f" else range(span - 1, -1, -1):
        inside = (length > t)[:, None]
        x = projected[token[t]]
        u = state @ p[f"re_{side}"]
        gates = sigmoid(x[:, : 2 * h] + u[:, : 2 * h])
        z, r = gates[:, :h], gates[:, h:]
        new = np.tanh(x[:, 2 * h :] + r * u[:, 2 * h :])
        after = np.where(inside, new + z * (state - new), state)
        if tape is not None:
            tape.append((t, state, z, r, new, u[:, 2 * h :], inside))
        state = after
        states[t] = state
    return states


def attended(states: np.ndarray, length: np.ndarray, p: Parameters) -> tuple[np.ndarray, ...]:
    """Logits of the windows, and what the gradient needs."""
    hidden = np.tanh(states @ p["attend"] + p["attend_b"])
    energy = hidden @ p["focus"]
    energy = np.where(np.arange(len(states))[:, None] < length[None, :], energy, -np.inf)
    top = np.where(length > 0, energy.max(axis=0, initial=-np.inf), 0)
    weight = np.exp(energy - top)
    weight /= np.maximum(weight.sum(axis=0), 1e-30)
    pooled = np.einsum("tb,tbh->bh", weight, states)
    return pooled @ p["out"] + p["out_b"][0], hidden, weight, pooled


def tokens(ids: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Word of each position (rows) of each window (columns); any word beyond its end."""
    span = int(length.max(initial=0))
    at = start[None, :] + np.minimum(np.arange(span)[:, None], np.maximum(length - 1, 0)[None, :])
    return ids[np.minimum(at, max(len(ids) - 1, 0))] if len(ids) else np.zeros((span, len(start)), np.int64)


def logits(vocabulary: Vocabulary, start: np.ndarray, length: np.ndarray, p: Parameters) -> np.ndarray:
    """Scores of windows before the logistic function."""
    inputs = vocabulary.inputs(p)
    projected = {s: inputs @ p[f"in_{s}"] + p[f"bias_{s}"] for s in "fb"}
    out = np.zeros(len(start), np.float32)
    order = np.argsort(length, kind="stable")  # windows of like length go together
    for at in range(0, len(order), TOGETHER):
        part = order[at : at + TOGETHER]
        token = tokens(vocabulary.ids, start[part], length[part])
        states = np.concatenate([read(projected[s], token, length[part], p, s, None) for s in "fb"], axis=2)
        out[part] = attended(states, length[part], p)[0]
    return out


def gradients(vocabulary: Vocabulary, start: np.ndarray, length: np.ndarray, label: np.ndarray, p: Parameters) -> Parameters:
    """Gradient of the mean logistic loss over some windows."""
    h = HIDDEN
    inputs = vocabulary.inputs(p)
    token = tokens(vocabulary.ids, start, length)
    projected = {s: inputs @ p[f"in_{s}"] + p[f"bias_{s}"] for s in "fb"}
    tapes: dict[str, list] = {"f": [], "b": []}
    states = np.concatenate([read(projected[s], token, length, p, s, tapes[s]) for s in "fb"], axis=2)
    logit, hidden, weight, pooled = attended(states, length, p)
    d_logit = ((sigmoid(logit) - label) / len(label)).astype(np.float32)
    g = {k: np.zeros_like(v) for k, v in p.items()}
    g["out"] = pooled.T @ d_logit
    g["out_b"] = d_logit.sum(keepdims=True)
    d_pooled = d_logit[:, None] * p["out"]
    d_states = weight[:, :, None] * d_pooled[None]
    d_weight = np.einsum("tbh,bh->tb", states, d_pooled)
    d_energy = weight * (d_weight - (weight * d_weight).sum(axis=0))
    g["focus"] = np.einsum("tba,tb->a", hidden, d_energy)
    d_hidden = d_energy[:, :, None] * p["focus"] * (1 - hidden**2)
    g["attend"] = np.einsum("tbh,tba->ha", states, d_hidden)
    g["attend_b"] = d_hidden.sum(axis=(0, 1))
    d_states += d_hidden @ p["attend"].T
    d_inputs = np.zeros_like(inputs)
    for k, side in enumerate("fb"):
        d_projected = np.zeros_like(projected[side])
        back = np.zeros((len(start), h), np.float32)
        for t, before, z, r, new, u_new, inside in reversed(tapes[side]):
            d = d_states[t, :, k * h : (k + 1) * h] + back
            live = np.where(inside, d, 0)
            d_z = live * (before - new) * z * (1 - z)
            d_new = live * (1 - z) * (1 - new**2)
            d_r = d_new * u_new * r * (1 - r)
            d_x = np.concatenate([d_z, d_r, d_new], axis=1)
            d_u = np.concatenate([d_z, d_r, d_new * r], axis=1)
            np.add.at(d_projected, token[t], d_x)
            g[f"re_{side}"] += before.T @ d_u
            back = np.where(inside, live * z, d) + d_u @ p[f"re_{side}"].T
        g[f"bias_{side}"] = d_projected.sum(axis=0)
        g[f"in_{side}"] = inputs.T @ d_projected
        d_inputs += d_projected @ p[f"in_{side}"].T
    np.add.at(g["words"], vocabulary.word_rows, d_inputs[:, :WORD_DIM])
    np.add.at(g["heads"], vocabulary.head_rows, d_inputs[:, WORD_DIM + CHAR_DIM :])
    share = d_inputs[:, WORD_DIM : WORD_DIM + CHAR_DIM] / np.maximum(vocabulary.sizes, 1)[:, None].astype(np.float32)
    np.add.at(g["chars"], vocabulary.char_rows, np.repeat(share, vocabulary.sizes, axis=0))
    return g


def own_words(bags: list[list[str]]) -> np.ndarray:
    """Sorted hashes of the words that enough documents of the sample hold."""
    each = []
    for bag in bags:
        _, words = seen_words(pa.array(bag, pa.string()))
        each.append(np.unique(word_hashes(words)))
    found, documents = np.unique(np.concatenate(each), return_counts=True)
    return found[documents >= LEAST_DOCUMENTS]


def fit(bags: list[list[str]], labels: np.ndarray) -> tuple[np.ndarray, Parameters]:
    """Train on bags of windows with one label each; known words and parameters."""
    known = own_words(bags)
    p = initial(known)
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in p.items()}
    rng = np.random.default_rng(11)
    bag = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    last = np.flatnonzero(np.append(np.diff(bag) > 0, True))
    texts = [w for b in bags for w in b]
    offsets, words = seen_words(pa.array(texts, pa.string()))
    everything = Vocabulary(words, known)
    step = 0
    for _ in range(max(EPOCHS, -(-UPDATES * BATCH // len(bags)))):
        found = logits(everything, offsets[:-1], np.diff(offsets), p)
        best = np.lexsort((found, bag))[last]  # of each document, its most toxic window so far
        order = rng.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            own, words = seen_words(pa.array([texts[i] for i in best[part]], pa.string()))
            step += 1
            for k, grad in gradients(Vocabulary(words, known), own[:-1], np.diff(own), labels[part], p).items():
                if k in ("words", "chars", "heads"):
                    grad += DECAY * p[k]
                first, second = moment[k]
                first += 0.1 * (grad - first)
                second += 0.001 * (grad * grad - second)
                p[k] -= (RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return known, p


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches):
        texts = [(t or "").encode().split() for t in batch.column("text").to_pylist()]
        row, start, length = windows(np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64))
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        bags: list[list[str]] = [[] for _ in texts]
        chance = mixed((start - offsets[row] + 1).astype(np.uint64))
        for k in np.lexsort((chance, row)):
            if len(bags[row[k]]) < BAG:
                own = start[k] - offsets[row[k]]
                bags[row[k]].append(b" ".join(texts[row[k]][own : own + length[k]]).decode())
        yield pa.RecordBatch.from_arrays([pa.array(bags, pa.list_(pa.string())), batch.column("toxic")], names=["bag", "toxic"])


def train(docs: DataFrame, labels: DataFrame) -> tuple[tuple[np.ndarray, Parameters] | None, float]:
    """Fit the network; known words and parameters, and what to add to a window's logit."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    counts = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    toxic, clean = counts.get(1, 0), counts.get(0, 0)
    if not toxic or not clean:
        return None, float(toxic > 0)
    by_chance = F.xxhash64("doc_id")
    chosen = known.where("toxic = 1").orderBy(by_chance).limit(MOST_TOXIC).unionByName(known.where("toxic = 0").orderBy(by_chance).limit(MOST_CLEAN))
    # At most MOST_TOXIC + MOST_CLEAN rows; of several texts of one doc_id the least by its hash.
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = map_batches(sample.select("text", "toxic"), _bags, T.StructType().add("bag", T.ArrayType(T.StringType())).add("toxic", "integer")).collect()
    rows.sort(key=lambda r: (r.toxic, r.bag))
    label = np.array([r.toxic for r in rows], np.float32)
    if not 0 < label.sum() < len(label):
        return None, toxic / (toxic + clean)
    shift = np.log(toxic / clean) - np.log(label.sum() / (len(label) - label.sum()))
    return fit([r.bag for r in rows], label), float(shift)


def _scored(batches: Iterator[pa.RecordBatch], shared: Broadcast) -> Iterator[pa.RecordBatch]:
    fitted, shift = shared.value
    for batch in steps(batches):
        if fitted is None:
            score = np.full(batch.num_rows, shift)
            row = np.arange(batch.num_rows)
        else:
            known, p = fitted
            offsets, words = seen_words(batch.column("text"))
            row, start, length = windows(offsets)
            found = logits(Vocabulary(words, known), start, length, p)
            score = sigmoid(np.maximum.reduceat(found, np.flatnonzero(np.append(True, np.diff(row) > 0))).astype(np.float64) + shift)
            score[np.diff(offsets) == 0] = 0
        count = np.bincount(row, minlength=batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array(count)], names=["doc_id", "held_out", "score", "n_windows"])


def score(spark: SparkSession, docs: DataFrame, model: tuple[tuple[np.ndarray, Parameters] | None, float]) -> DataFrame:
    """doc_id, held_out, score, n_windows and predicted of every document."""
    shared = spark.sparkContext.broadcast(model)  # its size is bounded by the sample's
    read_ = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    schema = T.StructType([f for f in read_.schema if f.name != "text"]).add("score", "double").add("n_windows", "long")
    scored = map_batches(read_, partial(_scored, shared=shared), schema)
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
