"""Queries whose rows follow from each document, or plain grouping, against plain Python."""

import hashlib
import os
import re
import shutil
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken
from tokenizers import Tokenizer

from tallyflow.llm import bpe_monoid, host_rules, mixing, sharding, stream_dedup
from tallyflow.llm.queries import QUERIES
from tests.llm.conftest import store


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def by_id(frame):
    return {r.doc_id: r for r in frame.collect()}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_table(spark, empty_dir, name):
    result = QUERIES[name](spark, empty_dir)
    assert result.count() == 0 and {"doc_id", "vec_id"} & set(result.columns)


def test_token_counts(spark, sf_dir, rows):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = by_id(QUERIES["op6_token_counts"](spark, sf_dir))
    assert len(found) == len(rows)
    for row in rows:
        text = row["text"] or ""
        n = len(tokenizer.encode(text, add_special_tokens=False).ids)
        assert tuple(found[row["doc_id"]]) == (row["doc_id"], len(text.encode()), n, n > 512)


def test_bpe(spark, sf_dir, rows):
    ranks = bpe_monoid.TreeEncoder.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = by_id(QUERIES["op8_bpe"](spark, sf_dir))
    assert len(found) == len(rows)
    for row in rows:
        text = row["text"] or ""
        ids = library.encode_ordinary(text)
        expected = (row["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        assert tuple(found[row["doc_id"]]) == expected


def test_bpe_keeps_ids_and_bytes(spark, docs, rows):
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe_monoid.encode_documents(spark, docs, ranks, public_tokenizers.PATTERN, keep=("doc_id", "n_words"), prefix="bpe_")
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in rows}
    for row in encoded.collect():
        assert row.bpe_decoded == texts[row.doc_id] and len(row.bpe_ids) == row.bpe_n_tokens


@pytest.mark.parametrize("alphabet", ["a", "ab", "theanding on", "äöß", "\x00\xff", "0123456789"])
def test_tree_of_long_pieces(alphabet):
    import random

    rng = random.Random(alphabet)
    ranks = bpe_monoid.TreeEncoder.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    encoder = bpe_monoid.TreeEncoder(ranks)
    for n in (0, 1, 2, 7, 8, 9, 17, 100, 3001):
        piece = "".join(rng.choice(alphabet) for _ in range(n))
        assert encoder.encode(piece.encode()) == library.encode_ordinary(piece)


def measures(text):
    own = words(text)
    triples = list(zip(own, own[1:], own[2:], strict=False))
    often = Counter(triples)
    covered = {i + k for i, t in enumerate(triples) if often[t] > 1 for k in range(3)}
    lines = [line for line in (text or "").split("\n") if words(line)]
    return {
        "n_words": len(own),
        "word_chars": sum(map(len, own)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text or ""),
        "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
    }


def host_verdicts(rows):
    """Failure rates of each source shrunk towards the common one, written out again."""
    failed = {r["doc_id"]: {n: eval(c, {}, measures(r["text"])) for n, c in host_rules.RULES.items()} for r in rows}
    hosts = defaultdict(list)
    for r in rows:
        hosts[r["source"]].append(failed[r["doc_id"]])
    verdict = dict.fromkeys(hosts, True)
    for name in host_rules.RULES:
        mean = sum(f[name] for f in failed.values()) / len(rows)
        spread = sum(len(h) * (sum(f[name] for f in h) / len(h) - mean) ** 2 for h in hosts.values()) / len(rows)
        between = spread - mean * (1 - mean) * len(hosts) / len(rows)
        strength = 1e6 if between <= 0 else min(max(mean * (1 - mean) / between - 1, 1.0), 1e6)
        for host, own in hosts.items():
            verdict[host] &= (sum(f[name] for f in own) + mean * strength) / (len(own) + strength) <= host_rules.HOST_LIMIT
    return verdict


def check_rules(spark, sf_dir, rows):
    found = by_id(QUERIES["op7_quality_rules"](spark, sf_dir))
    verdict = host_verdicts(rows)
    for row in rows:
        m = measures(row["text"])
        failed = m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"]
        got = found[row["doc_id"]]
        assert [got[k] for k in m if k != "n_lines"] == [v for k, v in m.items() if k != "n_lines"]
        assert got.base_failed == failed
        assert got.kept == (not failed and verdict[row["source"]])
    return verdict


def test_quality_rules(spark, sf_dir, rows):
    check_rules(spark, sf_dir, rows)


def test_a_bad_host_goes(spark, tmp_path, rows):
    junk = [{"doc_id": 10_000 + i, "text": "few words only" if i % 9 else " ".join(f"w{j}" for j in range(80)), "source": "junk"} for i in range(60)]
    lone = [{"doc_id": 20_000, "text": "short", "source": "lone"}]
    folder = store(rows + junk + lone, tmp_path / "sf")
    verdict = check_rules(spark, folder, rows + junk + lone)
    assert not verdict["junk"] and verdict["lone"]
    kept = host_rules.keep_documents(spark.read.parquet(folder + "/documents.parquet"))
    assert kept.where("source = 'junk'").count() == 0
    assert kept.columns == spark.read.parquet(folder + "/documents.parquet").columns
    expected = {d for d, r in by_id(QUERIES["op7_quality_rules"](spark, folder)).items() if r.kept}
    assert {r.doc_id for r in kept.collect()} == expected


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def check_dedup(found, rows):
    groups = defaultdict(list)
    for r in rows:
        groups[normal(r["text"])].append(r["doc_id"])
    assert len(found) == len(rows)
    for r in rows:
        got, text = found[r["doc_id"]], normal(r["text"])
        assert (got.keep_id, got.group_size) == (min(groups[text]), len(groups[text]))
        assert got.kept == (got.keep_id == got.doc_id)
        assert got.text_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_exact_dedup(spark, sf_dir, rows):
    check_dedup(by_id(QUERIES["op9_exact_dedup"](spark, sf_dir)), rows)


def test_exact_dedup_tells_texts_of_one_digest_apart(docs, rows):
    from pyspark.sql import functions as F

    weak = stream_dedup.decisions(docs, digest=lambda text: F.crc32(F.encode(text, "UTF-8")) % 5)
    check_dedup(by_id(weak), rows)


def test_exact_dedup_keeps_one_of_repeated_rows(spark):
    twice = spark.createDataFrame([(1, "a  b"), (1, "a b"), (None, "a b"), (2, "c"), (None, None)], "doc_id long, text string")
    found = [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in stream_dedup.decisions(twice).collect()]
    assert sorted(found, key=str) == sorted([(1, 1, 3, True), (1, 1, 3, False), (None, 1, 3, False), (2, 2, 1, True), (None, None, 1, True)], key=str)
    assert stream_dedup.keep_documents(twice).count() == 3


@pytest.mark.parametrize("weak", [False, True])
def test_arrivals_meet_the_state_of_earlier_calls(spark, rows, tmp_path, monkeypatch, weak):
    from pyspark.sql import functions as F

    digest = (lambda text: F.crc32(F.encode(text, "UTF-8")) % 5) if weak else stream_dedup.sha256
    whole = f"{store(rows, tmp_path / 'sf', parts=3)}/documents.parquet"
    folder, kept = tmp_path / "growing", str(tmp_path / "store")
    folder.mkdir()

    def arrive():
        return stream_dedup.arrived(spark.read.parquet(str(folder)), kept, digest)

    pq.write_table(pq.read_table(f"{whole}/part-0.parquet").slice(0, 0), folder / "none.parquet")
    assert arrive().count() == 0
    for k in range(3):
        os.link(f"{whole}/part-{k}.parquet", folder / f"part-{k}.parquet")
        if k == 1:
            # Broken off while it wrote, then after it: neither loses nor repeats a row.
            (tmp_path / "store/arrivals/broken").mkdir()
            shutil.copy(next((tmp_path / "store/arrivals").glob("*/*.parquet")), tmp_path / "store/arrivals/broken")
            with monkeypatch.context() as patch:
                patch.setattr(stream_dedup, "keyed_state", lambda *_: 1 / 0)
                with pytest.raises(ZeroDivisionError):
                    arrive()
        check_dedup(by_id(arrive()), [r for part in range(k + 1) for r in rows[part::3]])
    batches = sorted(os.listdir(tmp_path / "store/arrivals"))
    assert len(batches) == 3
    check_dedup(by_id(arrive()), rows)
    assert sorted(os.listdir(tmp_path / "store/arrivals")) == batches
    with pytest.raises(ValueError, match="read from files"):
        stream_dedup.arrived(spark.createDataFrame([(1, "a")], "doc_id long, text string"), kept)


def test_sharding(spark, sf_dir, rows):
    found = by_id(QUERIES["op2_sharding"](spark, sf_dir))
    places, totals = defaultdict(list), Counter({s: 0 for s in range(24)})
    for r in rows:
        got = found[r["doc_id"]]
        data = (r["text"] or "").encode()
        assert (got.size, got.text_crc32, got.law, got.grown_shard) == (len(data) + 8, zlib.crc32(data), "bytes", None)
        places[got.shard].append(got.slot)
        totals[got.shard] += got.size
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    largest = sorted((len((r["text"] or "").encode()) + 8 for r in rows), reverse=True)
    assert set(totals) == set(range(24)) and max(totals.values()) <= max(largest[0], 1.05 * sum(largest) / 24)


def test_slot_maps_are_edited():
    import numpy as np

    loads = np.random.default_rng(1).lognormal(8, 1, 4096).astype(np.int64)
    loads[:2000] = 0
    dealt = sharding.first_map(4096, 10)
    even = sharding.rebalanced(dealt, loads, 10)
    totals = np.bincount(even, weights=loads, minlength=10)
    assert totals.max() - totals.min() <= 0.01 * totals.mean()
    assert (even[loads > 0] == dealt[loads > 0]).mean() > 0.6
    more = sharding.grown(even, loads, 10)
    assert set(more[more != even]) == {10}
    totals = np.bincount(more, weights=loads, minlength=11)
    assert totals.max() <= 1.05 * totals.mean()


def test_map_versions_and_written_shards(spark, docs, tmp_path, rows):
    placed, path = sharding.shard(docs, 5, slots=64)
    first, second = (sharding.read_map(spark, path, v) for v in (1, 2))
    assert first.count() == second.count() == 64
    sharding.write_shards(docs, second, str(tmp_path / "out"), slots=64)
    stored = spark.read.parquet(str(tmp_path / "out")).select("doc_id", "_shard", "text").collect()
    assert {(r.doc_id, r._shard) for r in stored} == {(r.doc_id, r.shard) for r in placed.collect()}
    assert {r.doc_id: r.text for r in stored} == {r["doc_id"]: r["text"] for r in rows}


def expected_targets(rows):
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += len(words(r["text"]))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    goal = {n: 1.5 * sum(sizes.values()) * weight[n] / sum(weight.values()) for n in names}
    while over := [n for n in names if goal[n] > 2 * sizes[n] + 1e-9]:
        excess = sum(goal[n] - 2 * sizes[n] for n in over)
        for n in over:
            goal[n] = 2.0 * sizes[n]
        free = [n for n in names if goal[n] < 2 * sizes[n] - 1e-9]
        for n in free:
            goal[n] += excess * weight[n] / sum(weight[m] for m in free)
    return sizes, goal


def test_mixing(spark, sf_dir, rows):
    found = by_id(QUERIES["op1_mixing"](spark, sf_dir))
    sizes, goal = expected_targets(rows)
    taken = Counter()
    assert len(found) == len(rows)
    for r in rows:
        got = found[r["doc_id"]]
        assert (got.size, got.source_size) == (len(words(r["text"])), sizes[r["source"]])
        assert got.target == pytest.approx(goal[r["source"]])
        assert 0 <= got.taken <= 2 * got.size
        taken[r["source"]] += got.taken
    for source, aim in goal.items():
        assert abs(taken[source] - aim) <= 1
    again = by_id(QUERIES["op1_mixing"](spark, sf_dir))
    assert found == again


def test_mixed_documents_hold_what_was_taken(docs, rows):
    counts = by_id(mixing.document_counts(docs))
    out = mixing.mixed_documents(docs).collect()
    texts = {r["doc_id"]: r["text"] for r in rows}
    taken = Counter()
    for r in out:
        assert r.text in texts[r.doc_id] and r.n_chars == len(r.text) and r.size == "clash"
        taken[r.doc_id] += len(words(r.text))
    assert all(taken[d] == c.taken for d, c in counts.items())


def test_slots_fill_shards_and_passes(spark, docs):
    _, pieces, plan = mixing.mix(docs, block_words=16, shard_slots=32)
    slots = mixing.mixed_slots(spark, plan).collect()
    assert len({(s.shard, s.position) for s in slots}) == plan.total == len(slots)
    assert max(s.position for s in slots) < 32
    assert len({(s.source_no, s["pass"], s.block) for s in slots}) == len(slots)
    assert [sum(s.words for s in slots if s.source_no == i) for i in range(len(plan.names))] == plan.words.tolist()
    assert pieces.count() >= len(slots)


def test_targets_stop_at_two_passes():
    assert mixing.targets([10, 1000, 1000]) == pytest.approx([20, 2 / 3 * (3015 - 20), 1 / 3 * (3015 - 20)])
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0, 0]


def test_permutations():
    import numpy as np

    for size in (1, 2, 3, 5, 64, 1000, 4097):
        index = np.arange(size)
        for key in (0, 9):
            out = mixing.permuted(index, np.full(size, size, np.uint64), np.full(size, key, np.uint64))
            assert sorted(out.tolist()) == index.tolist()


def test_remembered_pieces_never_take_more_than_their_memory(monkeypatch):
    monkeypatch.setattr(bpe_monoid, "REMEMBERED_BYTES", 20_000)
    encoder = bpe_monoid.TreeEncoder({bytes((b,)): b for b in range(256)})
    pieces = [f"piece {k}" for k in range(1_000)]  # distinct pieces of one step
    assert encoder.remembered(pieces) == [np.frombuffer(p.encode(), np.uint8).astype(bpe_monoid.ID).tobytes() for p in pieces]
    assert 0 < encoder.held <= 20_000 and len(encoder.known) * bpe_monoid.ENTRY_BYTES <= encoder.held
