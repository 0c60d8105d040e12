"""Profiles of rules, exact scores and global ranks."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from auditloom.functions import text
from auditloom.operators import extraction as ex
from auditloom.operators import logs as lg
from auditloom.operators.rules import Profile, Rule, category_counts, evaluated


def test_a_second_profile_needs_no_change_of_the_job(spark):
    rules = [Rule("vintage-plausible", "2", "numeric-agreement", F.when(F.col("year").between(1900, 2030), "PASS").otherwise("FAIL")), Rule("lab-report", "1", "external-evidence-dependent"), Rule("year-digits", "1", "syntax-validation", F.when(F.col("declared").rlike("^[0-9]{4}$"), "PASS").when(F.col("declared").isNull(), "NEEDS_REVIEW").otherwise("FAIL"))]
    profile = Profile("spirits", "7", rules, lambda cases: cases.withColumn("year", F.expr("try_cast(declared AS int)")))
    cases = spark.createDataFrame([(1, True, "1999"), (2, True, "99"), (3, True, None), (4, False, "2001"), (5, None, "2001")], "case_id int, sufficient boolean, declared string")
    got = {(r["case_id"], r["rule"]): (r["execution"], r["finding"]) for r in ex.evaluate_rules(cases, profile).collect()}
    assert len(got) == 15
    assert got[1, "year-digits"] == ("executed", "PASS") and got[2, "vintage-plausible"] == ("executed", "FAIL") and got[3, "year-digits"] == ("executed", "NEEDS_REVIEW")
    assert got[4, "year-digits"] == got[5, "year-digits"] == ("not_run_insufficient_evidence", "not_run") and got[1, "lab-report"] == ("not_run_external_dependency", "not_run")
    assert [tuple(r) for r in profile.manifest(spark).orderBy("position").collect()] == [(1, "year-digits", "1", "spirits", "7"), (2, "vintage-plausible", "2", "spirits", "7"), (3, "lab-report", "1", "spirits", "7")]
    counts = {r["rule"]: tuple(r)[2:] for r in category_counts(evaluated(cases, profile), profile).collect()}
    assert counts == {"year-digits": (5, 3, 1, 1, 1), "vintage-plausible": (5, 3, 1, 2, 0), "lab-report": (5, 0, 0, 0, 0)}
    assert evaluated(cases, Profile("none", "1", [])).collect() == [] and evaluated(cases.limit(0), profile).collect() == []


def test_profiles_refuse_what_no_profile_can_be():
    with pytest.raises(ValueError, match="twice"):
        Profile("p", "1", [Rule("a", "1", "syntax-validation"), Rule("a", "2", "syntax-validation")])
    with pytest.raises(ValueError, match="category"):
        Profile("p", "1", [Rule("a", "1", "guesswork")])


def test_global_ranks_over_many_ranges(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", f"k{rng.randrange(900)}"]), i) for i in range(3000)]
    got = lg.global_ranks(spark.createDataFrame(rows, "k string, id int").repartition(7), ["k"]).collect()
    assert [(r["k"], r["id"], r["rank"]) for r in sorted(got, key=lambda r: r["rank"])] == [(k, i, n) for n, (k, i) in enumerate(sorted(rows), 1)]
    assert lg.global_ranks(spark.createDataFrame([], "k string, id int"), ["k"]).collect() == []


def test_counterbalanced_order_is_balanced(spark):
    got = lg.counterbalanced_order(spark.range(501).withColumnRenamed("id", "case_id"), "s").collect()
    by_case = {}
    for r in got:
        by_case.setdefault(r["case_id"], {})[r["block"]] = r["mode"]
    assert len(by_case) == 501 and all(set(v.values()) == {"A", "B"} for v in by_case.values())
    assert sum(v[1] == "A" for v in by_case.values()) == 251
    first = min(range(501), key=lambda i: hashlib.md5(f"s|{i}".encode()).hexdigest())
    assert next(r["rank"] for r in got if r["case_id"] == first) == 1


def test_rows_without_a_path_or_parent_do_not_meet(spark):
    from auditloom.catalog import REGISTRY

    plan = REGISTRY.queries["v6_corpus_issues"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(directory" in plan and not re.search(r"hashpartitioning\(directory#\d+, image#\d+, \d+\)", plan)
    assert not re.search(r"hashpartitioning\(derived_from#\d+L?, \d+\)", plan)


def test_words_meet_their_pass_before_they_are_split(spark):
    from auditloom.catalog import REGISTRY

    plan = REGISTRY.queries["x1_map_word_geometry"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join")


def test_each_brand_key_is_worked_out_once(spark):
    rows = [(b,) for b in ("Acme, Inc.", "ACME  l.l.c", "Inc.", " Co ", "", None, "Oak‘s Hill Ltd.,", "a co inc", "Ünï  corp")]
    keys = text.with_brand_keys(spark.createDataFrame(rows, "b string"), "b").select("_b", text.brand_base(F.col("b")), "_b_key", text.brand_key(F.col("b"))).collect()
    assert len(keys) == len(rows) and all(r[0] == r[1] and r[2] == r[3] for r in keys)
    cases = spark.range(3).selectExpr("id AS case_id", "true AS sufficient", "'OBSERVED' AS state", "concat('ALC. ', id) AS statement", "'5%' AS declared", "concat('b ', id) AS brand", "concat('B ', id) AS declared_brand")
    plan = ex.evaluate_rules(cases)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(brand#") == plan.count("translate(declared_brand#") == 1 and plan.count("[.,\\s]+$") == 4
