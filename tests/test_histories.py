"""Histories replayed against a plain loop, rules one by one, and pages by key against pages by offset."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from auditloom.operators import histories as hs
from auditloom.operators import review as rv

ENTRY = "case_id string, moment int, entry_id int, disposition_id string, rule_ids array<string>, check_ids array<string>"


def slowly_replayed(entries, rules, checks):
    out, done = {}, {}
    for case, moment, entry, name, own_rules, own_checks in sorted(entries, key=lambda e: (e[1], e[2])):
        ids = done.setdefault(case, [])
        own_rules, own_checks = own_rules or [], own_checks or []
        bad = any((case, x) not in rules for x in own_rules) or any((case, x) not in checks for x in own_checks) or len(set(own_rules)) < len(own_rules) or len(set(own_checks)) < len(own_checks)
        if name in ids:
            out[entry] = ("refused", "DUPLICATE_DISPOSITION_ID", None)
        elif bad:
            out[entry] = ("refused", "INVALID_DISPOSITION", None)
        else:
            ids.append(name)
            out[entry] = ("accepted", None, len(ids))
    return out


def test_replay_equals_a_loop(spark):
    rng = random.Random(1)
    some = lambda of: None if rng.random() < 0.2 else [f"{of}{rng.randrange(5)}" for _ in range(rng.randrange(3))]
    entries = [(rng.choice(["hot", "hot", "a", "b"]), rng.randrange(50), i, f"d{rng.randrange(40)}", some("r"), some("c")) for i in range(300)]
    rules, checks = [(c, f"r{i}") for c in ("hot", "a", "b") for i in range(4)] * 2, [(c, f"c{i}") for c in ("hot", "a") for i in range(4)]
    tables = spark.createDataFrame(rules, "case_id string, rule string"), spark.createDataFrame(checks, "case_id string, check string")
    got = {r["entry_id"]: (r["outcome"], r["reason"], r["sequence"]) for r in hs.replayed(spark.createDataFrame(entries, ENTRY).repartition(5), *tables).collect()}
    want = slowly_replayed(entries, set(rules), set(checks))
    assert got == want and {x[1] for x in want.values()} == {None, "DUPLICATE_DISPOSITION_ID", "INVALID_DISPOSITION"}
    assert hs.replayed(spark.createDataFrame([], ENTRY), *tables).collect() == []


def test_every_rule_of_a_stored_history(spark):
    rows = [("a", 1, 1, "d1", ["r1"], ["c1"]), ("a", 2, 3, "d2", None, None), ("a", 3, 3, "d1", ["r9"], None), ("a", 4, 4, "d4", ["r1", "r1"], ["c9"]), ("a", 5, None, "d5", [], ["c1", "c1"]), ("b", 1, 1, "d1", [], [])]
    history = spark.createDataFrame(rows, "case_id string, position int, sequence long, disposition_id string, rule_ids array<string>, check_ids array<string>")
    known = spark.createDataFrame([("a", "r1")], "case_id string, rule string"), spark.createDataFrame([("a", "c1")], "case_id string, check string")
    assert {tuple(r) for r in hs.disposition_issues(history, *known).collect()} == {
        ("a", 2, "sequence_not_contiguous"), ("a", 3, "duplicate_disposition"), ("a", 3, "unknown_rule"), ("a", 4, "rule_named_twice"), ("a", 4, "unknown_check"), ("a", 5, "sequence_not_contiguous"), ("a", 5, "check_named_twice"),
    }


def test_every_rule_of_confirmations(spark):
    rows = [(1, "brand", "accepted-machine-reading", None, None), (2, "alcohol", "accepted-machine-reading", None, None), (3, "brand", "selected-alternate", "x", None), (4, "brand", "selected-alternate", None, None), (5, "brand", "corrected-value", None, "brand"), (6, "brand", "corrected-value", None, None), (7, "other", "selected-alternate", "x", None), (8, "alcohol", "selected-alternate", "x", None)]
    history = spark.createDataFrame([("a", *r) for r in rows], "case_id string, position int, field string, decision string, alternate_id string, corrected_field string")
    seen = spark.createDataFrame([("a", "brand", "v", ["x"]), ("a", "alcohol", None, None)], "case_id string, field string, value string, alternate_ids array<string>")
    assert {tuple(r)[1:] for r in hs.confirmation_issues(history, seen).collect()} == {(2, "nothing_to_accept"), (4, "unknown_alternate"), (6, "other_field"), (7, "unknown_field"), (8, "unknown_alternate")}


def test_pages_by_key_equal_pages_by_offset(spark, tmp_path):
    rng = random.Random(2)
    spark.createDataFrame([(i, rng.randrange(12), "x") for i in range(230)], "id int, day int, other string").write.parquet(str(tmp_path / "rows"))
    rows, order = spark.read.parquet(str(tmp_path / "rows")), [("day", False), ("id", True)]
    last, number = None, 0
    while True:
        number += 1
        got = rv.page_after(rows, order, last, 40).collect()
        assert got == rv.page(rows, [F.desc("day"), F.asc("id")], number, 40).collect()
        if not got:
            break
        last = [F.lit(got[-1]["day"]), F.lit(got[-1]["id"])]
    assert number == 7
    plan = rv.page_after(rows, order, [F.lit(5), F.lit(9)], 40)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(day,5)" in plan
