"""Alignments against the libraries' tokens of whole texts, compared byte range by byte range."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tallyflow.llm import alignment
from tallyflow.llm.bpe_arrays import byte_symbols
from tallyflow.llm.queries import QUERIES
from tests.llm.conftest import store

FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["  two  spaces  ", " ", "a ", "tab\tand\n new  lines \n\n end", "x  y  z", "▁ literal", "<s> <unk> <0x41> <|endoftext|>", "日本語 テキスト です", "\u0000 nul", "é é ﬁ Ａ", "🙂🙂 🙃", "it's  'll 　 x", "a\u0085 b", "1234567 89,000.5 !!!??", "\r\n \x1c \x1f q"]


def spans(tokens):
    at, out = 0, []
    for i, size in tokens:
        out.append((i, at, at + size))
        at += size
    return out


def plain(texts):
    """Links, ids and groups of each text, by comparing ranges."""
    first = Tokenizer.from_file(FILES[0])
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    symbols = byte_symbols()
    out = []
    for text in texts:
        a = first.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        bytes_a = [bytes(symbols[c] for c in first.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(second.id_to_piece(i)[1:-1], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode() for i in b]
        whole = (" " + (text or "")).encode()
        if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            out.append(([], [], [], ""))
            continue
        a, b = spans(zip(a, map(len, bytes_a))), spans(zip(b, map(len, bytes_b)))
        links = [(i, j) for i, s, e in a for j, p, q in b if s < q and p < e] if len(a) < 3000 else None
        ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups = [",".join(str(i) for i, _, x in a if low < x <= e) + "|" + ",".join(str(j) for j, _, x in b if low < x <= e) for low, e in zip([0, *ends], ends)] if len(a) < 3000 else None
        out.append((a, b, links, groups))
    return out


@pytest.fixture(scope="module")
def odd(rows, tmp_path_factory):
    kept = [r for r in rows if len(r["text"] or "") < 5000] + [{"doc_id": 10_000 + k, "text": t, "source": "s"} for k, t in enumerate(ODD)]
    return kept, store(kept, tmp_path_factory.mktemp("odd") / "sf")


@pytest.fixture(scope="module")
def want(odd):
    rows, _ = odd
    found = plain([r["text"] for r in rows])
    counts = Counter(pair for _, _, links, _ in found for pair in set(links))
    best = defaultdict(int)
    for (i, _), n in counts.items():
        best[i] = max(best[i], n)
    out = {}
    for row, (a, b, links, groups) in zip(rows, found):
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        out[row["doc_id"]] = (len(a), len(b), len(groups), len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), digest)
    return out


def test_query(spark, odd, want):
    rows, folder = odd
    found = QUERIES["op12_token_alignment"](spark, folder)
    assert found.columns[:8] == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in found.collect()}
    assert len(got) == len(rows) and got == want
    assert sum(v[0] == 0 for v in got.values()) >= 3


def test_few_hot_pairs(spark, odd, want):
    """Scores are the same whether a pair's count is sent to all tasks or joined."""
    _, folder = odd
    found = alignment.aligned(spark.read.parquet(f"{folder}/documents.parquet"), *FILES, keep=("doc_id", "pair"))
    for hot in (0, 40):
        got = {r.doc_id: (r.n_best, r.count_sum) for r in alignment.scored(found, hot_pairs=hot).collect()}
        assert got == {k: v[4:6] for k, v in want.items()}
    groups = {r.doc_id: r.groups for r in found.documents.collect()}
    assert all(hashlib.sha256(groups[k].encode()).hexdigest() == v[6] for k, v in want.items() if v[6])


def test_long_texts_are_the_librarys(spark, rows, tmp_path):
    long = [r for r in rows if len(r["text"] or "") >= 5000]
    found = {r.doc_id: r for r in QUERIES["op12_token_alignment"](spark, store(long * 2, tmp_path / "sf")).collect()}
    assert len(long) >= 3
    for row, (a, b, _, _) in zip(long, plain([r["text"] for r in long])):
        ends = {e for _, _, e in a} & {e for _, _, e in b}
        r = found[row["doc_id"]]
        assert (r.n_a, r.n_b, r.n_groups) == (len(a), len(b), len(ends)) and r.n_links >= max(len(a), len(b)) and r.count_sum >= 2 * r.n_links


def test_cuts():
    offsets, parts = alignment.cut(pa.array([" a b", " \n  c", " x  y z"]).slice(0))
    assert parts.to_pylist() == [" a", " b", " \n  c", " x  y", " z"] and offsets.tolist() == [0, 2, 3, 5]
