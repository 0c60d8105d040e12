"""The query of HTML extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from auditloom.llm.markup import extract
from auditloom.registry import Registry, read


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(read(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")


def register(registry: Registry) -> None:
    registry.add("op7_html_text")(op7_html_text)
