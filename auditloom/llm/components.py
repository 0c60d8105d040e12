"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the least node of its component.

    Alternates two steps until nothing changes: every node links its greater neighbours to the least node around it,
    then its smaller ones. The number of edges never grows, a node's neighbours are never collected, and the rounds
    grow with the logarithm of the nodes. Loops and repeated edges are ignored; null ends are left out.
    """
    pairs = edges.filter("a IS NOT NULL AND b IS NOT NULL").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = cut(pairs)
    nodes = cut(now.select(F.col("a").alias("node")).union(now.select("b")).distinct())
    now = cut(now.filter("a <> b"))
    while True:
        before = _mark(now)
        now = cut(_small(cut(_large(now))))
        if _mark(now) == before:
            break
    least = now.groupBy("a").agg(F.min("b").alias("b"))
    return nodes.join(least, F.col("node") == F.col("a"), "left").select("node", F.coalesce("b", "node").alias("root"))


def _mark(edges: DataFrame) -> tuple:
    """Tells edge tables apart without reading them out."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("a", "b").cast("long"))).first())


def _linked(edges: DataFrame, least: DataFrame) -> DataFrame:
    # the table of least nodes is cut, so that a node with very many edges can be split over tasks
    return edges.join(cut(least), "node")


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
    least = both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("low"))
    return _linked(both.filter("other > node"), least).select(F.col("other").alias("a"), F.col("low").alias("b")).filter("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    at = edges.select(F.col("a").alias("node"), F.col("b").alias("other"))
    least = at.groupBy("node").agg(F.min("other").alias("low"))
    moved = _linked(at, least).select(F.col("other").alias("a"), F.col("low").alias("b")).filter("a <> b")
    return moved.union(least.select(F.col("node").alias("a"), F.col("low").alias("b"))).distinct()
