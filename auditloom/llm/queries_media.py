"""The query of media columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from auditloom.llm import media
from auditloom.registry import Registry, read


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents as a stored picture, resolved by digest from each document's own sequence."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    known = media.read_back(media.store(docs, "text"))
    sequences = media.interleave(media.documents_as_pages(docs, "doc_id", "text")).drop("html")
    rows = media.resolve(sequences, known)
    return rows.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def register(registry: Registry) -> None:
    registry.add("op8_media_columns")(op8_media_columns)
