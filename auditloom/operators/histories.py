"""Append-only histories of what people decide about a result: entries replayed one by one, and the rules that a stored history keeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.operators.logs import carried, issue_rows


def _missing(entries: DataFrame, known: DataFrame, listed: str, name: str, key: list[str]) -> DataFrame:
    """Entries (key) that list something their case doesn't have."""
    each = entries.select(*key, F.explode(listed).alias(name))
    return each.join(known.select("case_id", name).distinct(), ["case_id", name], "left_anti").select(*key).distinct()


def _repeats(listed: str) -> Column:
    return F.size(F.array_distinct(F.coalesce(listed, F.array()))) < F.size(F.coalesce(listed, F.array()))


def replayed(entries: DataFrame, findings: DataFrame, checks: DataFrame) -> DataFrame:
    """(case_id, moment, entry_id, disposition_id, outcome, reason, sequence): what becomes of each entry when they are appended in turn.

    entries: case_id, moment and entry_id (the order; entry_id is unique), disposition_id, rule_ids, check_ids (arrays, null for none);
    findings: case_id, rule; checks: case_id, check. An entry is refused as DUPLICATE_DISPOSITION_ID if one of its id was accepted
    before, and as INVALID_DISPOSITION if it refers to a finding or check that its case doesn't have or names one twice. A refused entry
    leaves no trace: its id is free, and the next accepted entry gets the number that it would have had. Numbers begin with 1.

    Which entries are good doesn't depend on earlier ones, and the first good entry of an id is the accepted one; so only the
    count of accepted entries is carried from row to row, and a case may have any number of them.
    """
    key = ["case_id", "moment", "entry_id"]
    bad = _missing(entries, findings, "rule_ids", "rule", key).unionByName(_missing(entries, checks, "check_ids", "check", key)).distinct().withColumn("_bad", F.lit(True))
    told = entries.select(*key, "disposition_id", (_repeats("rule_ids") | _repeats("check_ids")).alias("_twice")).join(bad, key, "left").withColumn("_good", F.col("_bad").isNull() & ~F.col("_twice"))
    first = told.filter("_good").groupBy("case_id", "disposition_id").agg(F.min(F.struct("moment", "entry_id")).alias("_first"))
    j = told.join(first, ["case_id", "disposition_id"], "left")
    own = F.struct("moment", "entry_id")
    reason = F.when(own > F.col("_first"), "DUPLICATE_DISPOSITION_ID").when(~F.col("_good"), "INVALID_DISPOSITION")
    rows = j.select(*key, "disposition_id", reason.alias("reason")).withColumn("outcome", F.when(F.col("reason").isNull(), "accepted").otherwise("refused"))

    def step(state: tuple, row: tuple) -> tuple[tuple, tuple]:
        n = state[0] + (row[0] == "accepted")
        return (n,), (n if row[0] == "accepted" else None,)

    return carried(rows, "case_id", ["moment", "entry_id"], ["outcome"], (0,), step, "sequence long").select(*key, "disposition_id", "outcome", "reason", "sequence")


def disposition_issues(history: DataFrame, findings: DataFrame, checks: DataFrame) -> DataFrame:
    """(case_id, position, issue): rules that a stored history breaks. history: case_id, position (its order, unique in a case), sequence, disposition_id, rule_ids, check_ids.

    sequence_not_contiguous, duplicate_disposition, unknown_rule, unknown_check, rule_named_twice, check_named_twice.
    """
    key = ["case_id", "position"]
    numbered = carried(history.select(*key, "sequence", "disposition_id", "rule_ids", "check_ids"), "case_id", ["position"], ["sequence"], (0,), lambda state, row: ((state[0] + 1,), (state[0] + 1,)), "expected long")
    first = history.groupBy("case_id", "disposition_id").agg(F.min("position").alias("_first"))
    rules = _missing(history, findings, "rule_ids", "rule", key).withColumn("_rule", F.lit(True))
    tests = _missing(history, checks, "check_ids", "check", key).withColumn("_check", F.lit(True))
    j = numbered.join(first, ["case_id", "disposition_id"], "left").join(rules, key, "left").join(tests, key, "left")
    broken = {
        "sequence_not_contiguous": ~F.col("sequence").eqNullSafe(F.col("expected")), "duplicate_disposition": F.col("position") > F.col("_first"), "unknown_rule": F.col("_rule"), "unknown_check": F.col("_check"),
        "rule_named_twice": _repeats("rule_ids"), "check_named_twice": _repeats("check_ids"),
    }
    return issue_rows(j.withColumn("k", F.struct(*key)), "k", broken).select("k.*", "issue")


def confirmation_issues(history: DataFrame, observations: DataFrame) -> DataFrame:
    """(case_id, position, issue): confirmations of a field that its observation doesn't allow.

    history: case_id, position, field, decision ('accepted-machine-reading', 'selected-alternate' or 'corrected-value'), alternate_id,
    corrected_field; observations: case_id, field, value, alternate_ids (array), one row for each case and field. nothing_to_accept: the
    machine has no value; unknown_alternate; other_field: a correction of another field; unknown_field: no such observation.
    """
    seen = observations.select("case_id", "field", "value", "alternate_ids", F.lit(True).alias("_seen"))
    j = history.join(seen, ["case_id", "field"], "left")
    alternate = F.coalesce(F.array_contains("alternate_ids", F.col("alternate_id")), F.lit(False))
    broken = {
        "unknown_field": F.col("_seen").isNull(), "nothing_to_accept": F.col("_seen") & (F.col("decision") == "accepted-machine-reading") & F.col("value").isNull(),
        "unknown_alternate": F.col("_seen") & (F.col("decision") == "selected-alternate") & ~alternate, "other_field": (F.col("decision") == "corrected-value") & ~F.col("corrected_field").eqNullSafe(F.col("field")),
    }
    return issue_rows(j.withColumn("k", F.struct("case_id", "position")), "k", broken).select("k.*", "issue")
