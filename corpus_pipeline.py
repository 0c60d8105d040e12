"""From raw documents to token ids: toxic documents go, near copies go, repeated sentences go, sources are mixed, texts are encoded.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns what is left of docs. All stages
but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.llm import jaccard, mix, pieces, spans, toxicity
from auditloom.llm.common import stored
from auditloom.llm.queries_pieces import MODEL
from auditloom.llm.queries_toxicity import model_of

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score doesn't reject, unchanged."""
    docs = docs.select(*COLUMNS)
    return toxicity.score(docs, model_of(spark, sf_dir, docs)).filter("predicted = 0").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, unchanged: that of the least doc_id."""
    docs = docs.select(*COLUMNS)
    found = jaccard.join(docs.select("doc_id", "text"))
    first = found.filter("is_first").groupBy("row").agg(F.count("*").alias("_n")).withColumnRenamed("row", "_first")
    left = docs.withColumn("_row", F.xxhash64("doc_id", "text")).join(first, F.col("_row") == F.col("_first"))
    once = left.filter("_n = 1").select(*COLUMNS)
    # rows that repeat another in doc_id and text: one of each
    return once.unionByName(left.filter("_n > 1").dropDuplicates(["_row"]).select(*COLUMNS))


def drop_repeated_sentences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the sentences of repeated spans; n_chars is that of the text that is left. Documents of which nothing is left go."""
    done = spans.dedup(docs.select(*COLUMNS), ends=True)
    return done.filter("n_removed = 0 OR text <> ''").withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: once, twice or not at all."""
    mixed = mix.mix(docs.select(*COLUMNS))
    times = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    return mixed.withColumn("_times", times).filter("_times > 0").withColumn("_time", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document; the text itself stays behind."""
    return pieces.encode(docs.select(*COLUMNS), pieces.load(MODEL)).select("doc_id", "source", "lang", "n_tokens", "ids_sha256", "round_trip", "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("substring_dedup", drop_repeated_sentences),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]
#: SQL can express neither the score nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage leaves is written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs)
    return docs
