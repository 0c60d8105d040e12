"""All queries of the library outside the optional subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from auditloom.plans import checks, evaluation, extraction, grids, histories, logs, review, sources, texts
from auditloom.registry import Registry

REGISTRY = Registry()
for _module in (evaluation, review, grids, logs, extraction, sources, checks, texts, histories):
    _module.register(REGISTRY)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return REGISTRY.queries["a1_eval_aggregate"](spark, sf_dir)
