"""Small helpers that the operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir; where it is unset and all runs in this process (tests), a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: executors need a shared folder")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, rows: int = 0) -> DataFrame:
    """Cuts the lineage by a Parquet table in the shared folder; for wide rows, where a checkpoint takes more room. rows: how many a file has at most; 0: any number."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("maxRecordsPerFile", rows).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, n: int | None, *keys: str) -> DataFrame:
    """Rows in n partitions by keys, each key's rows in one of them; for n None, in as many as their size asks for.

    The keys are hashed first, so that the exchange differs from that of a join on the same keys. Otherwise it is left out
    behind such a join, and where adaptive planning then broadcasts the join's other side, a key's rows come apart.
    """
    return df.repartition(F.xxhash64(*keys)) if n is None else df.repartition(n, F.xxhash64(*keys))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def plain(name: str, taken: list[str]) -> str:
    """A column name that clashes with none of those taken."""
    while name.lower() in {x.lower() for x in taken}:
        name = f"_{name}"
    return name


def fresh(taken: list[str], *names: str) -> list[str]:
    """Column names that clash neither with those taken nor with each other."""
    out: list[str] = []
    for name in names:
        out.append(plain(name, [*taken, *out]))
    return out
