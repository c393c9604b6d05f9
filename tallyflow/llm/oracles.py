"""SQL twins of the queries that SQL can express, for DuckDB."""

from tallyflow.llm import host_rules

_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
_PLAIN = _WORDS.format(text="coalesce(text, '')")
_LOWER = _WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")

EXACT_DEDUP = r"""
WITH texts AS (
    SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM texts WINDOW same AS (PARTITION BY t)
"""

SUBSTRING_DEDUP = f"""
WITH split AS (SELECT doc_id, {_PLAIN} AS w FROM documents),
windows AS (SELECT doc_id, unnest(range(len(w) - 19)) AS i, w FROM split),
ranked AS (
    SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i + 1 : i + 20], ' ') ORDER BY doc_id, i) AS place
    FROM windows
),
gone AS (SELECT DISTINCT doc_id, i + unnest(range(20)) AS p FROM ranked WHERE place > 1),
positions AS (SELECT doc_id, unnest(range(len(w))) AS p, unnest(w) AS word FROM split),
kept AS (
    SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text
    FROM positions ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT split.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (doc_id)
"""

JACCARD_JOIN = f"""
WITH RECURSIVE split AS (SELECT doc_id, {_LOWER} AS w FROM documents),
shingles AS (
    SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM split WHERE len(w) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
    FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
),
links AS (
    SELECT a, b FROM common JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id
    WHERE 100 * c >= 80 * (x.n + y.n - c)
),
reach AS (
    SELECT doc_id AS a, doc_id AS b FROM split
    UNION
    SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT split.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(b) AS component_id
FROM split LEFT JOIN sizes USING (doc_id) JOIN reach ON reach.a = split.doc_id GROUP BY split.doc_id
"""


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
WITH split AS (SELECT doc_id, {_TERMS} AS w FROM documents),
items AS (SELECT item_id, w, least(len(w), 10) AS n FROM (SELECT item_id, {_TERMS} AS w FROM benchmark)),
grams AS (
    SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS g
    FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM items WHERE n > 0)
),
windows AS (
    SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS g
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM split, (SELECT DISTINCT n FROM grams) WHERE len(w) >= n)
),
hits AS (SELECT doc_id, i, n, item_id FROM windows JOIN grams USING (n, g)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
found AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
)
SELECT split.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM split LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""


def _quality_rules() -> str:
    low, high = host_rules.STRENGTH
    rules = host_rules.RULES
    counted = ", ".join(f"sum(CASE WHEN {condition} THEN 1 ELSE 0 END)::DOUBLE AS f_{name}" for name, condition in rules.items())
    means = ", ".join(f"sum(f_{r}) / sum(n) AS m_{r}" for r in rules)
    between = ", ".join(f"sum(n * (f_{r} / n - m_{r}) ^ 2) / sum(n) - any_value(m_{r}) * (1 - any_value(m_{r})) * count(*) / sum(n) AS b_{r}, any_value(m_{r}) AS m_{r}" for r in rules)
    strength = ", ".join(f"m_{r}, CASE WHEN b_{r} > 0 THEN least(greatest(m_{r} * (1 - m_{r}) / b_{r} - 1, {low}), {high}) ELSE {high} END AS s_{r}" for r in rules)
    verdict = " AND ".join(f"(f_{r} + m_{r} * s_{r}) / (n + s_{r}) <= {host_rules.HOST_LIMIT}" for r in rules)
    failed = " OR ".join(rules[r] for r in host_rules.BASE_RULES)
    return rf"""
WITH split AS (SELECT doc_id, source, coalesce(text, '') AS t, {_PLAIN} AS w FROM documents),
lines AS (
    SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
    FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM split)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
),
triples AS (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS often
    FROM (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM split))
),
repeats AS (
    SELECT doc_id, count(DISTINCT p) AS n_repeat_words
    FROM (SELECT doc_id, i + unnest([0, 1, 2]) AS p FROM triples WHERE often > 1) GROUP BY doc_id
),
measures AS (
    SELECT doc_id, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
           len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, coalesce(n_lines, 0) AS n_lines,
           coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
    FROM split LEFT JOIN lines USING (doc_id) LEFT JOIN repeats USING (doc_id)
),
hosts AS (SELECT source AS host, count(*)::DOUBLE AS n, {counted} FROM measures GROUP BY source),
means AS (SELECT {means} FROM hosts),
spread AS (SELECT {between} FROM hosts, means),
prior AS (SELECT {strength} FROM spread),
verdicts AS (SELECT host, {verdict} AS host_kept FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       ({failed}) AS base_failed, NOT ({failed}) AND host_kept AS kept
FROM measures JOIN verdicts ON source IS NOT DISTINCT FROM host
"""


ORACLES: dict[str, str] = {
    "op4_jaccard_join": JACCARD_JOIN,
    "op5_substring_dedup": SUBSTRING_DEDUP,
    "op7_quality_rules": _quality_rules(),
    "op9_exact_dedup": EXACT_DEDUP,
    "op11_decontamination": DECONTAMINATION,
}
