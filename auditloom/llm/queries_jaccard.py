"""The query of the n-gram Jaccard join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from auditloom.llm.jaccard import join
from auditloom.registry import Registry, read


#: All pairs, exactly; for the small tables.
SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM d),
c AS (SELECT doc_id, s, md5(array_to_string(list_sort(s), '|')) AS cls FROM g),
k AS (SELECT cls, any_value(s) AS s, min(doc_id) AS copy_id, count(*) AS n FROM c GROUP BY cls),
t AS (SELECT cls, len(s) AS size, unnest(s) AS gram FROM k),
shared_by AS (SELECT a.cls AS a, b.cls AS b, any_value(a.size) AS na, any_value(b.size) AS nb, count(*) AS shared FROM t a JOIN t b ON a.gram = b.gram AND a.cls <> b.cls GROUP BY 1, 2),
link AS (SELECT a, b FROM shared_by WHERE shared >= 0.8 * (na + nb - shared) - 1e-9),
reach AS (SELECT cls AS a, cls AS b FROM k UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
part AS (SELECT reach.a AS cls, min(k.copy_id) AS class_id FROM reach JOIN k ON k.cls = reach.b GROUP BY 1),
near AS (SELECT link.a AS cls, sum(k.n) AS n FROM link JOIN k ON k.cls = link.b GROUP BY 1)
SELECT c.doc_id, part.class_id, k.copy_id, k.n AS n_copies, CAST(k.n - 1 + coalesce(near.n, 0) AS BIGINT) AS n_links, c.doc_id = part.class_id AS is_first
FROM c JOIN k ON k.cls = c.cls JOIN part ON part.cls = c.cls LEFT JOIN near ON near.cls = c.cls
"""


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by runs of five words, similarity 0.8 or more: a row a document with its class and its number of links."""
    return join(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("row")


def register(registry: Registry) -> None:
    registry.add("op2_ngram_jaccard", SQL)(op2_ngram_jaccard)
