"""The query of mixing sources to target weights, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.llm.mix import mix
from auditloom.registry import Registry, read

SQL = r"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS hash
  FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS DOUBLE) AS size FROM docs GROUP BY source),
turns AS (SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight FROM sizes),
levels AS (
  SELECT *, (sum(size) OVER () * 1.5::DOUBLE - coalesce(sum(size * 2) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM turns WINDOW w AS (ORDER BY size / weight, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goal AS (SELECT source, size AS source_size, coalesce(least(size * 2, weight * max(level) FILTER (level * weight <= size * 2) OVER ()), size * 2) AS target FROM levels),
placed AS (
  SELECT d.*, g.source_size, g.target, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.hash, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS so_far
  FROM docs d JOIN goal g ON d.source IS NOT DISTINCT FROM g.source),
copies AS (SELECT *, (r * source_size + so_far) / target AS finish FROM placed, (VALUES (0), (1)) AS rounds(r) WHERE size > 0),
queue AS (SELECT *, sum(size) OVER (ORDER BY finish, hash, doc_id, r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS all_so_far FROM copies),
taken AS (SELECT doc_id, CAST(sum(size) AS BIGINT) AS taken FROM queue WHERE all_so_far <= (SELECT sum(target) FROM goal) GROUP BY doc_id)
SELECT p.doc_id, CAST(p.size AS BIGINT) AS size, CAST(p.source_size AS BIGINT) AS source_size, round(p.target, 4) AS target, coalesce(t.taken, 0) AS taken
FROM placed p LEFT JOIN taken t USING (doc_id)
"""


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed by weights 3, 1, 2 to 150 % of all words."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"), "taken")


def register(registry: Registry) -> None:
    registry.add("op5_mix_sources", SQL)(op5_mix_sources)
