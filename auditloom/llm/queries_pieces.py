"""The query of SentencePiece encoding and decoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.llm import pieces
from auditloom.registry import Registry, read

#: The vocabulary file; read by the driver only.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents, encoded and decoded."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    done = pieces.encode(docs, pieces.load(MODEL), with_ids=False)
    return done.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens", "ids_sha256", "round_trip")


def register(registry: Registry) -> None:
    registry.add("op4_sentencepiece")(op4_sentencepiece)
