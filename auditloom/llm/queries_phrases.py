"""The query of phrase collocation mining, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from auditloom.llm import phrases
from auditloom.registry import Registry, read

SQL = r"""
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT lang, unnest(list_transform(string_split_regex(text, '[.,;:!?\x0A-\x0D]'), lambda p: regexp_extract_all(p, '[^\x20\x09]+'))) AS w FROM texts),
words AS (SELECT lang, sum(len(w)) AS n FROM pieces GROUP BY lang),
grams AS (
  SELECT lang, k, array_to_string(unnest(list_transform(range(1, greatest(len(w) - k + 2, 1)), lambda i: w[i:i + k - 1])), ' ') AS phrase
  FROM pieces, (VALUES (1), (2), (3), (4), (5)) AS sizes(k)),
phrases AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
cuts AS (SELECT lang, k, phrase, f AS a, unnest(range(1, k)) AS cut, string_split(phrase, ' ') AS w FROM phrases WHERE k >= 2),
met AS (
  SELECT c.lang, c.k, c.phrase, c.a, c.cut, l.f AS l, r.f AS r, n.n,
         (1000::HUGEINT * c.a * n.n) // (l.f::HUGEINT * r.f) AS score
  FROM cuts c JOIN phrases l ON c.lang = l.lang AND array_to_string(c.w[1:c.cut], ' ') = l.phrase
       JOIN phrases r ON c.lang = r.lang AND array_to_string(c.w[c.cut + 1:], ' ') = r.phrase JOIN words n ON c.lang = n.lang),
lowest AS (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
best AS (
  SELECT * FROM lowest a WHERE NOT EXISTS (
    SELECT 1 FROM phrases b WHERE b.lang = a.lang AND b.k > a.k AND 100 * b.f >= 100 * a.a AND contains(' ' || b.phrase || ' ', ' ' || a.phrase || ' '))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked WHERE rank <= 2000
"""


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrases of all documents, the best 2000 of each language."""
    return phrases.collocations(read(spark, sf_dir, "documents").select("text", "lang"))


def register(registry: Registry) -> None:
    registry.add("op12_collocations", SQL)(op12_collocations)
