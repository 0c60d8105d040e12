"""The query of exact top-k search, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from auditloom.llm.pivots import top_k
from auditloom.registry import Registry, read

SQL = """
WITH cells AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM cells q JOIN cells c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score
FROM scored WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY rank <= 5
"""


def op9_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of every row for each 50th row of embeddings."""
    return top_k(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def register(registry: Registry) -> None:
    registry.add("op9_pivot_top_k", SQL)(op9_pivot_top_k)
