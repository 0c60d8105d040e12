"""Versioned profiles of rules, and what they find in a table of cases."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Kinds of rules in the order in which they are evaluated.
CATEGORIES = ["syntax-validation", "canonical-text-comparison", "numeric-agreement", "external-evidence-dependent"]


@dataclass(frozen=True)
class Rule:
    """A rule. finding: PASS, WARN, FAIL or NEEDS_REVIEW as a column over a case; None: it needs evidence from elsewhere and never runs."""

    id: str
    version: str
    category: str
    finding: Column | None = None


class Profile:
    """Rules that are evaluated together, by category and then by id. prepare adds columns that rules read.

    Raises ValueError if an id is there twice or a category is unknown.
    """

    def __init__(self, id: str, version: str, rules: list[Rule], prepare: Callable[[DataFrame], DataFrame] = lambda cases: cases) -> None:
        ids = [r.id for r in rules]
        if len(set(ids)) < len(ids):
            raise ValueError(f"profile {id}: a rule is there twice")
        if any(r.category not in CATEGORIES for r in rules):
            raise ValueError(f"profile {id}: a category is unknown")
        self.id, self.version, self.prepare = id, version, prepare
        self.rules = sorted(rules, key=lambda r: (CATEGORIES.index(r.category), r.id))

    def manifest(self, spark: SparkSession) -> DataFrame:
        """(position, rule, rule_version, profile, profile_version): a row a rule, in order from 1."""
        rows = [(i, r.id, r.version, self.id, self.version) for i, r in enumerate(self.rules, 1)]
        return spark.createDataFrame(rows, "position int, rule string, rule_version string, profile string, profile_version string")


def evaluated(cases: DataFrame, profile: Profile) -> DataFrame:
    """(case_id, rule, execution, finding): one row for each case and rule. cases: case_id, sufficient and what the profile reads.

    A rule runs where the evidence suffices; a null there counts as not. Its finding is null where its column is. Nothing is shuffled.
    """
    enough = F.coalesce("sufficient", F.lit(False))

    def row(rule: Rule) -> Column:
        if rule.finding is None:
            execution, finding = F.lit("not_run_external_dependency"), F.lit("not_run")
        else:
            execution = F.when(enough, "executed").otherwise("not_run_insufficient_evidence")
            finding = F.when(enough, rule.finding).otherwise("not_run")
        return F.struct(F.lit(rule.id).alias("rule"), execution.alias("execution"), finding.alias("finding"))

    if not profile.rules:
        return cases.select("case_id", F.lit("").alias("rule"), F.lit("").alias("execution"), F.lit("").alias("finding")).limit(0)
    found = profile.prepare(cases).select("case_id", F.explode(F.array(*map(row, profile.rules))).alias("f"))
    return found.select("case_id", "f.*")


def category_counts(findings: DataFrame, profile: Profile) -> DataFrame:
    """(category, rule, n, executed, passed, failed, review): what each rule of a profile found, in the profile's order of categories; rules without findings count 0."""
    spark = findings.sparkSession
    listed = spark.createDataFrame([(r.category, r.id) for r in profile.rules], "category string, rule string")
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    told = findings.groupBy("rule").agg(F.count("*").alias("n"), count(F.col("execution") == "executed").alias("executed"), *[count(F.col("finding") == k).alias(v) for k, v in (("PASS", "passed"), ("FAIL", "failed"), ("NEEDS_REVIEW", "review"))])
    joined = listed.join(told, "rule", "left")
    return joined.select("category", "rule", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "executed", "passed", "failed", "review")])
