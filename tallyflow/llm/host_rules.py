"""Quality rules with verdicts on whole hosts.

Every document is measured on its whole text. Rule failures are counted by host; a
host's failure rate is shrunk towards the rate of all hosts with a beta prior fitted to
them, so that a few unlucky documents of a small host do not condemn it. Hosts whose
shrunk rate stays above the limit are rejected, and the verdict is joined back.

Defined cases: a null text counts as empty and fails for its length. Null hosts form one
host of their own. Repeated rows are judged and counted one by one. An empty table gives
an empty result. Other columns are passed through untouched by ``keep_documents``.
"""

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyflow.llm.common import map_batches, mixed, owners, split_words, steps, window_starts, word_ids
from tallyflow.session import written

#: Characters that count as symbols (fixed by the query's definition).
SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

#: Rules whose failures are counted by host, as conditions over the measures.
RULES: dict[str, str] = {
    "short": "n_words < 50",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > word_chars",
    "dup_lines": "100 * n_dup_lines > 50 * n_lines",
}
#: Rules that reject a document by themselves.
BASE_RULES = ("short", "repeats")
#: A host is rejected when its shrunk failure rate for any rule is above this.
HOST_LIMIT = 0.7
#: Prior strength, in documents, is kept inside these bounds.
STRENGTH = (1.0, 1_000_000.0)


def _between(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return sums[ends] - sums[starts]


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """The measures of each text."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    sizes = pc.binary_length(texts).to_numpy().astype(np.int64)
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(texts.cast(pa.large_binary()).to_pylist()), np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    lead = (data & 0xC0) != 0x80

    lines = pc.split_pattern(texts, "\n")
    line_row = np.repeat(np.arange(n), np.diff(np.asarray(lines.offsets)))
    line = lines.flatten()
    worded = np.asarray(pc.not_equal(pc.ascii_trim_whitespace(line), ""))
    ids, distinct = word_ids(line)
    rows = line_row[worded]
    different = np.unique(rows * max(len(distinct), 1) + ids[worded]) // max(len(distinct), 1)
    n_lines = np.bincount(rows, minlength=n)

    offsets, words = split_words(texts)
    ids, _ = word_ids(words)
    at = window_starts(offsets, 3)
    row = owners(offsets, at)
    h = ids.astype(np.uint64)
    for number in (row, ids[at], ids[at + 1], ids[at + 2]):
        h = mixed((h[: len(at)] if number is not row else np.zeros(len(at), np.uint64)) + number.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    codes, _ = pd.factorize(h)
    repeated = at[np.bincount(codes, minlength=1)[codes] > 1]
    covered = np.zeros(len(words), bool)
    for step in range(3):
        covered[repeated + step] = True
    return {
        "n_words": np.diff(offsets),
        "word_chars": _between(lead & ~space, ends - sizes, ends),
        "n_symbols": _between(np.isin(data, np.frombuffer(SYMBOLS, np.uint8)), ends - sizes, ends),
        "n_lines": n_lines,
        "n_dup_lines": n_lines - np.bincount(different, minlength=n),
        "n_repeat_words": _between(covered, offsets[:-1], offsets[1:]),
    }


def _measured(batches: Iterator[pa.RecordBatch], kept: list[str], text: str, out: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches, text):
        found = measure(batch.column(text))
        columns = [batch.column(c) for c in kept] + [pa.array(found[m], pa.int64()) for m in MEASURES]
        yield pa.RecordBatch.from_arrays(columns, names=out)


def measured(docs: DataFrame, keep: list[str], prefix: str = "", text: str = "text") -> DataFrame:
    """The columns ``keep`` and, under ``prefix``, the measures of every document."""
    fields = [docs.schema[c] for c in keep] + [T.StructField(prefix + m, T.LongType(), False) for m in MEASURES]
    read = list(dict.fromkeys([*keep, text]))
    names = [f.name for f in fields]
    return map_batches(docs.select(*read), partial(_measured, kept=keep, text=text, out=names), T.StructType(fields))


def rule(name: str, prefix: str = "") -> Column:
    """Whether a document fails a rule."""
    condition = RULES[name]
    for m in MEASURES:
        condition = condition.replace(m, f"`{prefix}{m}`")
    return F.expr(condition)


def base_failed(prefix: str = "") -> Column:
    failed = rule(BASE_RULES[0], prefix)
    for name in BASE_RULES[1:]:
        failed = failed | rule(name, prefix)
    return failed


def host_rates(measures: DataFrame, host: str) -> DataFrame:
    """One row per host: documents, failures and shrunk failure rate by rule, verdict."""
    counted = measures.groupBy(F.col(host).alias("host")).agg(
        F.count("*").alias("n_docs"), *[F.sum(rule(r).cast("long")).alias(f"n_{r}") for r in RULES]
    )
    counted = written(counted, "hosts")
    total = counted.agg(F.sum("n_docs").alias("n"), F.count("*").alias("hosts"), *[F.sum(f"n_{r}").alias(r) for r in RULES]).first()
    if not total.n:
        return counted.select("*", *[F.lit(0.0).alias(f"rate_{r}") for r in RULES], F.lit(True).alias("host_kept"))
    mean = {r: total[r] / total.n for r in RULES}
    spread = counted.agg(*[(F.sum((F.col(f"n_{r}") - mean[r] * F.col("n_docs")) ** 2 / F.col("n_docs")) / total.n).alias(r) for r in RULES]).first()
    for r in RULES:
        by_chance = mean[r] * (1 - mean[r]) * total.hosts / total.n
        between = max(spread[r] - by_chance, 0.0)
        strength = min(max(mean[r] * (1 - mean[r]) / between - 1, STRENGTH[0]), STRENGTH[1]) if between > 0 else STRENGTH[1]
        counted = counted.withColumn(f"rate_{r}", (F.col(f"n_{r}") + mean[r] * strength) / (F.col("n_docs") + strength))
    return counted.withColumn("host_kept", F.greatest(*[F.col(f"rate_{r}") for r in RULES]) <= HOST_LIMIT)


def judged(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host, measures, ``base_failed``, ``host_kept`` and ``kept`` of every document."""
    facts = written(measured(docs, ["doc_id", host]), "measures").withColumnRenamed(host, "host")
    rejected = host_rates(facts, "host").where("not host_kept").select(F.col("host").alias("_host"), F.lit(False).alias("_kept"))
    joined = facts.join(rejected, F.col("host").eqNullSafe(F.col("_host")), "left")
    joined = joined.withColumn("base_failed", base_failed()).withColumn("host_kept", F.coalesce("_kept", F.lit(True)))
    return joined.withColumn("kept", ~F.col("base_failed") & F.col("host_kept")).drop("_host", "_kept")


def keep_documents(docs: DataFrame, host: str = "source") -> DataFrame:
    """The documents that pass, with all their columns.

    Texts are measured once to judge the hosts and once more beside the rows, which costs
    less than moving all texts to where their verdict is.
    """
    facts = written(measured(docs, [host]), "measures").withColumnRenamed(host, "host")
    rejected = host_rates(facts, "host").where("not host_kept").select(F.col("host").alias("_q_host"))
    passed = measured(docs, docs.columns, prefix="_q_").where(~base_failed("_q_"))
    return passed.join(rejected, F.col(host).eqNullSafe(F.col("_q_host")), "left_anti").select(*docs.columns)
