"""The query of cross-tokenizer alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from auditloom.llm import align
from auditloom.registry import Registry, read

#: The vocabulary files; read by the driver only.
FIRST, SECOND = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents, both tokenizations aligned by their bytes."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return align.align(docs, align.load(FIRST, SECOND))


def register(registry: Registry) -> None:
    registry.add("op11_align")(op11_align)
