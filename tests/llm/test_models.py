"""Language-model scores and toxicity: definitions on small inputs, and held-out quality."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tallyflow.llm import context_tree, toxicity
from tallyflow.llm.queries import QUERIES
from tests.llm.conftest import store


def bytes_of(text):
    return b"".join(w.lower() + b" " for w in (text or "").encode().split()) + b"\n"


def trains(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 7 != 2


def log_kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)


class PlainTree:
    """Context-tree weighting over dictionaries, nothing left out."""

    def __init__(self, texts, depth=context_tree.DEPTH):
        self.depth, self.counts, self.children = depth, {}, {}
        for text in texts:
            data = b"\n" * depth + bytes_of(text)
            for i in range(depth, len(data)):
                for d in range(depth + 1):
                    for node, bit in self.path(data[i]):
                        key = (data[i - d : i], node)
                        self.counts.setdefault(key, [0, 0])[bit] += 1
                        if d:
                            self.children.setdefault((key[0][1:], node), set()).add(key[0])
        self.weighted = {}

    @staticmethod
    def path(byte):
        for i in range(8):
            yield (1 << i) | (byte >> (8 - i)), byte >> (7 - i) & 1

    def weight(self, context, node):
        key = (context, node)
        if key not in self.weighted:
            kt = log_kt(*self.counts[key])
            if len(context) == self.depth:
                self.weighted[key] = kt
            else:
                below = sum(self.weight(c, node) for c in self.children[key])
                self.weighted[key] = np.logaddexp(kt, below) - math.log(2)
        return self.weighted[key]

    def one(self, data, i, node):
        mixed, left = 0.0, 1.0
        for d in range(self.depth + 1):
            key = (data[i - d : i], node)
            if key not in self.counts:
                return 0.5 if d == 0 else mixed + left * p
            a, b = self.counts[key]
            p = (b + 0.5) / (a + b + 1)
            if d == self.depth:
                return mixed + left * p
            deeper = (data[i - d - 1 : i], node)
            if deeper not in self.counts:
                return mixed + left * p
            share = math.exp(log_kt(a, b) - self.weight(*key)) / 2
            mixed, left = mixed + left * share * p, left * (1 - share)

    def log10(self, text):
        data, total = b"\n" * self.depth + bytes_of(text), 0.0
        for i in range(self.depth, len(data)):
            for node, bit in self.path(data[i]):
                p = self.one(data, i, node)
                total += math.log10(p if bit else 1 - p)
        return total


def check_scores(found, rows):
    training = [r["text"] for r in rows if trains(r["doc_id"])]
    tree = PlainTree(training)
    tokens = Counter(w for t in training for w in [*(t or "").encode().lower().split(), None])
    n, v = sum(tokens.values()), len(tokens)
    for r in rows:
        got = found[r["doc_id"]]
        own = [*(r["text"] or "").encode().lower().split(), None]
        assert (got.held_out, got.n_tokens, got.n_known, got.train_tokens) == (not trains(r["doc_id"]), len(own), sum(w in tokens for w in own), n)
        assert got.base_score == pytest.approx(sum(math.log10((tokens[w] + 1) / (n + v + 1)) for w in own))
        assert got.score == pytest.approx(tree.log10(r["text"]), rel=1e-4)


@pytest.mark.parametrize("entries", [context_tree.BLOCK_ENTRIES, 1000])
def test_scores(spark, tmp_path, rows, entries, monkeypatch):
    monkeypatch.setattr(context_tree, "BLOCK_ENTRIES", entries)
    some = [r for r in rows if len(r["text"] or "") < 1500]
    folder = store(some, tmp_path / "sf")
    result = QUERIES["op3_context_tree"](spark, folder).collect()
    assert len(result) == len(some)
    check_scores({r.doc_id: r for r in result}, some)


def test_long_repeated_and_unnamed_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(context_tree, "BLOCK_ENTRIES", 3000)
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    some = [{"doc_id": k, "text": " ".join(rng.choice(words) for _ in range(n)), "source": "s"} for k, n in enumerate([5, 900, 30, 12, 3000, 7, 60])]
    some += [{"doc_id": None, "text": "abc " * 5, "source": "s"}] * 2 + [some[3]] * 3
    found = QUERIES["op3_context_tree"](spark, store(some, tmp_path / "sf")).collect()
    assert Counter(r.doc_id for r in found) == Counter(r["doc_id"] for r in some)
    check_scores({r.doc_id: r for r in found}, some)
    assert len({(r.doc_id, round(r.score, 6)) for r in found}) == 8


def test_blocks_split_frequent_byte_pairs():
    """Shares follow three bytes, so contexts with one pair at their end fall into many."""
    same_pair = (np.arange(256, dtype=np.int64) << 16) | 0x6520
    assert len(set(context_tree.share(same_pair).tolist())) > 200


def test_scores_without_training_documents(spark):
    none = next(i for i in range(100) if not trains(i))
    docs = spark.createDataFrame([(none, "a")], "doc_id long, text string")
    (row,) = context_tree.score(spark, docs, context_tree.train(docs)).collect()
    assert row.score == pytest.approx(3 * 8 * math.log10(0.5)) and row.bits_per_byte == pytest.approx(8)


def many_times(factor):
    """The counting of training texts as if each stood there so many times."""
    count = context_tree._counts

    def counts(batches):
        for batch in count(batches):
            yield pa.RecordBatch.from_arrays([batch.column("kind"), batch.column("key"), pa.array(batch.column("n").to_numpy() * factor)], names=["kind", "key", "n"])

    return counts


@pytest.mark.parametrize("n", [10**8, 10**16])
def test_node_without_zeros(spark, n):
    counted = spark.createDataFrame([(0x61626364FFFF, n)], "key long, n long")
    model = context_tree.Model(context_tree.weighted_nodes(counted), spark.createDataFrame([], "key long, n long"), 0, 0, 0, 1, 0)
    zero, one = model.block(0).ready().log10_of(np.array([0x6162636465_00, 0x6162636465_FF]))
    assert zero == pytest.approx(math.log10(0.5 / (n + 1)) + 7 * math.log10(0.5), rel=1e-6)
    assert one == pytest.approx(8 * math.log1p(-0.5 / (n + 1)) / math.log(10), rel=1e-6, abs=1e-14)


def test_rare_bit_after_many(spark, monkeypatch):
    monkeypatch.setattr(context_tree, "_counts", many_times(10**8))
    own = next(i for i in range(100) if trains(i))
    other = next(i for i in range(100) if not trains(i))
    docs = spark.createDataFrame([(own, "g" * 50), (other, "ga gag")], "doc_id long, text string")
    scores = {r.doc_id: r for r in context_tree.score(spark, docs, context_tree.train(docs)).collect()}
    assert -200 < scores[other].score < -16 and 0 < scores[own].bits_per_byte < 1


@pytest.mark.parametrize("factor", [10**9, (2**31 - 1) // 3 + 1])
def test_words_counted_more_often_than_32_bits(spark, monkeypatch, factor):
    monkeypatch.setattr(context_tree, "_counts", many_times(factor))
    own = next(i for i in range(100) if trains(i))
    docs = spark.createDataFrame([(own, "hot hot hot cold")], "doc_id long, text string")
    (row,) = context_tree.score(spark, docs, context_tree.train(docs)).collect()
    floor = 4 * factor + 1 + 3 + 1
    expected = 3 * math.log10((3 * factor + 1) / floor) + math.log10((factor + 1) / floor) + math.log10(2 / floor)
    assert row.base_score == pytest.approx(expected, rel=1e-12)


def toxic_rows(n):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        own = [rng.choice(words) for _ in range(rng.choice([5, 40, 150]))]
        toxic = rng.random() < 0.3
        for _ in range(max(2, len(own) // 15) if toxic else 0):
            own.insert(rng.randrange(len(own)), rng.choice(["zounds", "Zoundry,", "zoundest"]))
        rows.append({"doc_id": i, "text": " ".join(own), "source": "s"})
        labels.append({"doc_id": i, "quality": 1, "toxic": int(toxic)})
    return rows, labels


def test_toxicity_of_held_out_documents(spark, tmp_path):
    import pyarrow.parquet as pq

    rows, labels = toxic_rows(600)
    rows += [{"doc_id": 9001, "text": None, "source": None}, {"doc_id": 9002, "text": " \n", "source": "s"}, {"doc_id": 9003, "text": "... !!", "source": "s"}, {"doc_id": 9004, "text": "quiet " * 5000 + "zounds zoundry zounds " * 10, "source": "s"}]
    folder = store(rows, tmp_path / "sf")
    table = pa.Table.from_pylist([*labels, {"doc_id": 9001, "quality": None, "toxic": None}, {"doc_id": None, "quality": 1, "toxic": 1}], schema=pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())]))
    pq.write_table(table, f"{folder}/labels.parquet")
    found = {r.doc_id: r for r in QUERIES["op10_toxicity"](spark, folder).collect()}
    assert len(found) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found.values())
    assert all(found[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in found)
    held = [label for label in labels if found[label["doc_id"]].held_out]
    assert sum(found[h["doc_id"]].predicted == h["toxic"] for h in held) >= 0.93 * len(held)
    assert found[9004].predicted == 1 and found[9001].predicted == 0


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.score(spark, docs, toxicity.train(docs, labels)).collect()] == [0, 0]


def test_windows_cover_whole_texts():
    offsets = np.array([0, 0, 1, 64 + 1, 64 + 1 + 65, 64 + 66 + 500])
    row, start, length = toxicity.windows(offsets)
    for k in range(len(offsets) - 1):
        covered = {w for s, n in zip(start[row == k], length[row == k], strict=True) for w in range(s, s + n)}
        assert covered == set(range(offsets[k], offsets[k + 1])) and (row == k).any()


def test_gradients():
    offsets, words = toxicity.seen_words(pa.array(["you zounds the a b c", "nice day", "a a a b", "x"]))
    known = np.unique(toxicity.word_hashes(words))[:4]
    p = {k: v.astype(np.float64) for k, v in toxicity.initial(known).items()}
    vocabulary, start, length = toxicity.Vocabulary(words, known), offsets[:-1], np.diff(offsets)
    label = np.array([1, 0, 0, 1.0])

    def loss():
        q = toxicity.sigmoid(toxicity.logits(vocabulary, start, length, p).astype(np.float64))
        return -(label * np.log(q) + (1 - label) * np.log(1 - q)).mean()

    found = toxicity.gradients(vocabulary, start, length, label, p)
    rng = np.random.default_rng(0)
    for name, values in p.items():
        rows = {"words": vocabulary.word_rows, "chars": vocabulary.char_rows, "heads": vocabulary.head_rows}.get(name)
        at = (rows[0], 1) if rows is not None else tuple(rng.integers(0, s) for s in values.shape)
        old = values[at]
        values[at] = old + 1e-2
        above = loss()
        values[at] = old - 1e-2
        slope = (above - loss()) / 2e-2
        values[at] = old
        assert found[name][at] == pytest.approx(slope, abs=3e-4)


def test_grams_looked_up_before_are_not_walked_again(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"some words {i} and other words") for i in range(30)], "doc_id long, text string")
    monkeypatch.setattr(context_tree, "REMEMBERED", 64)  # fewer places than grams, so some are taken from each other
    block = context_tree.train(docs).block(0).ready()
    keys = np.unique(context_tree.grams(pa.array([f"some words {i} and other words, new ones" for i in range(40)]))[0])
    plain, walked = block.walked(keys), []
    monkeypatch.setattr(block, "walked", lambda k, own=block.walked: walked.append(len(k)) or own(k))
    rng = np.random.default_rng(1)
    for _ in range(20):
        some = rng.choice(len(keys), 50, replace=False)
        assert (block.log10_of(keys[some]) == plain[some]).all()
    for _ in range(3):
        assert (block.log10_of(keys[:5]) == plain[:5]).all()
    assert len(keys) > 64 and walked[0] == 50 and walked[-1] < 5


def test_documents_as_they_are_coded():
    rng = random.Random(3)
    texts = ["".join(rng.choice("aBéZ[@\0 \t\n\v\f\r\x1c") for _ in range(rng.choice([0, 1, 2, 6, 40]))) for _ in range(300)] + [None, "", " ", "x"]
    for given in (pa.array(texts), pa.array(["other ", *texts, "one"], pa.large_string()).slice(1, len(texts)), pa.array(texts[:1]), pa.array([None], pa.string()), pa.array([], pa.string())):
        plain, docs = given.to_pylist(), context_tree.spelled(given)
        coded = [bytes_of(t) for t in plain]
        assert [bytes(docs.data[a:b]) for a, b in zip(docs.starts, docs.ends, strict=True)] == coded
        keys, ends, offsets, words = context_tree.grams(given)
        padded = [bytes([context_tree.END]) * context_tree.DEPTH + c for c in coded]
        assert keys.tolist() == [int.from_bytes(p[i : i + context_tree.DEPTH + 1]) for p in padded for i in range(len(p) - context_tree.DEPTH)]
        assert np.diff(ends).tolist() == [len(c) for c in coded] and np.diff(offsets).tolist() == [c.count(b" ") for c in coded]
        assert words.to_pylist() == [w.decode() for c in coded for w in c[:-1].split(b" ")[:-1]]
        assert docs.shares().tolist() == context_tree.share(docs.keys(slice(None)) >> 8).tolist()


def test_words_are_looked_up_in_their_blocks_only(spark, monkeypatch):
    monkeypatch.setattr(context_tree, "BLOCK_ENTRIES", 300)
    own = next(i for i in range(100) if trains(i))
    words = [f"w{i}" for i in range(400)]
    docs = spark.createDataFrame([(own, " ".join(words * 2)), (own, "w1 w2")], "doc_id long, text string")
    model, looked = context_tree.train(docs), []
    assert (model.word_blocks, model.distinct_tokens) == (2, 401) and model.blocks > 3
    monkeypatch.setattr(context_tree, "word_ids", lambda w, f=context_tree.word_ids: looked.append(len(w)) or f(w))
    batch = pa.RecordBatch.from_pydict({"text": ["W7 w8 unknown", None]})
    found = np.zeros((2, 2))
    for number in range(model.blocks):
        (part,) = context_tree._scored(iter([batch]), Shared(model.block(number)))
        found += [part.column(c).to_pylist() for c in ("n_known", "base_score")]
        assert part.column("n_tokens").to_pylist() == [4, 1]
    assert looked == [3, 3] and found[0].tolist() == [3, 1]
    floor = 804 + 401 + 1
    assert found[1].tolist() == pytest.approx([math.log10(3 * 3 * 1 * 3 / floor**4), math.log10(3 / floor)])


class Shared:
    def __init__(self, value):
        self.value = value


def test_keys_that_come_again_are_passed_on_once(monkeypatch):
    monkeypatch.setattr(context_tree, "STEP", 200)
    monkeypatch.setattr(context_tree, "HELD", 300)
    batch = pa.RecordBatch.from_pydict({"text": ["one sentence, word for word the same in every text of this table"] * 60})
    passed = pa.Table.from_batches(context_tree._counts(iter([batch]))).to_pydict()
    keys = list(zip(passed["kind"], passed["key"], strict=True))
    assert len(keys) == len(set(keys)) and sum(passed["n"]) == 60 * (len(bytes_of(batch["text"][0].as_py())) + 13)


def test_hashes_of_texts_as_arrays():
    from tallyflow.llm.common import text_hashes

    texts = ["", "a", "b", "ab", "ba", "\0", "\0\0", "x" * 8, "x" * 9, "é" * 4, "y" * 64, "y" * 65, "y" * 65 + "z", "y" * 200]
    hashes = text_hashes(pa.array(texts))
    assert len(set(hashes.tolist())) == len(texts)
    assert text_hashes(pa.array(["other", *texts]).slice(1)).tolist() == hashes.tolist() == text_hashes(pa.array(texts, pa.large_string())).tolist()
    assert len(text_hashes(pa.array([], pa.string()))) == 0
