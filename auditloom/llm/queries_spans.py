"""The query of substring dedup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.llm.spans import dedup
from auditloom.registry import Registry, read


def op6_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without repeated sentence spans; the kept text as its digest and length."""
    done = dedup(read(spark, sf_dir, "documents").select("doc_id", "text"), ends=True)
    return done.select("doc_id", "n_sentences", "n_removed", "n_chars_removed", F.length("text").cast("long").alias("n_chars_kept"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def register(registry: Registry) -> None:
    registry.add("op6_sentence_spans")(op6_sentence_spans)
