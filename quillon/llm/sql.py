"""SQL twins of the queries that SQL can express, written apart from the DataFrame plans."""

from __future__ import annotations

import string

from quillon.llm.quality import LADDERS

WORD = r"[^\x20\x09-\x0D]+"


def op1_sql(risk: float = 0.05, error: float = 0.05) -> str:
    """Counts by lists; the binomial test by summing all its terms with lgamma."""
    p = risk / len(LADDERS)
    steps = ", ".join(f"('{f}', {k}, {i}, {c})" for k, (f, ladder) in enumerate(LADDERS.items()) for i, c in enumerate(ladder, 1))
    value = "CASE s.f " + " ".join(f"WHEN '{f}' THEN g.{f}" for f in LADDERS) + " END"
    lost = " OR ".join(f"coalesce(b.{f} >= (SELECT c.cutoff FROM chosen c WHERE c.stratum IS NOT DISTINCT FROM b.stratum AND c.f = '{f}'), FALSE)" for f in LADDERS)
    return rf"""
WITH texts AS (SELECT doc_id, lang AS stratum, coalesce(text, '') AS t FROM documents),
parts AS (SELECT *, regexp_extract_all(t, '{WORD}') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM texts),
grams AS (SELECT doc_id, i, list_aggregate(w[i : i + 4], 'string_agg', ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM parts WHERE len(w) >= 5)),
often AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
again AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM often, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id),
base AS (SELECT p.doc_id, p.stratum, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(a.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines, length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS n_upper
  FROM parts p LEFT JOIN again a ON a.doc_id = p.doc_id),
rated AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0.0 END AS symbol_share, CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0.0 END AS dup_line_share,
  CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0.0 END AS repeat_share, CASE WHEN word_chars > 0 THEN n_upper / word_chars ELSE 0.0 END AS upper_share, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0.0 END AS long_words FROM base),
good AS (SELECT r.* FROM rated r JOIN (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1) l ON l.doc_id = r.doc_id WHERE NOT base_failed),
steps(f, k, i, cutoff) AS (VALUES {steps}),
counts AS (SELECT g.stratum, s.f, s.i, s.cutoff, count(*) AS n, sum(CASE WHEN {value} >= s.cutoff THEN 1 ELSE 0 END) AS lost FROM good g, steps s GROUP BY ALL),
tails AS (SELECT stratum, f, i, cutoff, sum(exp(lgamma(n + 1.0) - lgamma(j + 1.0) - lgamma(n - j + 1.0) + j * ln({p!r}) + (n - j) * ln(1 - {p!r}))) AS tail, any_value(lost > n * {p!r}) AS high
  FROM (SELECT *, unnest(range(0, lost::BIGINT + 1)) AS j FROM counts) GROUP BY ALL),
tests AS (SELECT *, NOT high AND tail <= {error} / ((SELECT count(*) FROM (SELECT DISTINCT stratum FROM good)) * {len(LADDERS)}) AS ok FROM tails),
chosen AS (SELECT stratum, f, max_by(cutoff, i) AS cutoff FROM (SELECT *, min(ok::INTEGER) OVER (PARTITION BY stratum, f ORDER BY i) AS sofar FROM tests) WHERE sofar = 1 GROUP BY stratum, f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR {lost}) AS kept FROM rated b"""


def op7_sql(n: int = 4, percent: int = 85) -> str:
    """All pairs that share a shingle, by a join; components by following links from every document."""
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    return rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '{WORD}') AS w FROM documents),
grams AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + {n - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {n - 1}, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
links AS (SELECT a, b FROM shared s JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * s.n >= {percent} * (p.n + q.n - s.n)),
reach AS (SELECT a AS doc_id, b FROM links UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, coalesce(max(s.n), 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(min(r.b), d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN reach r ON r.doc_id = d.doc_id GROUP BY d.doc_id"""


SQL = {"op1_quality": op1_sql(), "op7_jaccard_join": op7_sql()}
