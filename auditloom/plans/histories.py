"""Queries of histories and of pages by key, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.fixtures import duck, view
from auditloom.operators import histories as hs
from auditloom.operators import review as rv
from auditloom.registry import Registry

ENTRIES = """SELECT event_id % 97 AS case_id, event_id AS moment, event_id AS entry_id, concat('d', CAST(event_id % 450 AS {s})) AS disposition_id, {a}(concat('rule', CAST(user_id % 4 AS {s})), concat('rule', CAST(event_id % 2 AS {s}))) AS rule_ids,
  CASE WHEN event_id % 3 = 0 THEN {a}(concat('check-', event_type)) END AS check_ids, CAST(floor(event_id / 97) AS BIGINT) + CASE WHEN event_id % 53 = 0 THEN 2 ELSE 1 END AS sequence FROM {t}"""
RULES = "SELECT DISTINCT event_id % 97 AS case_id, concat('rule', CAST(event_id % 3 AS {s})) AS rule FROM {t}"
CHECKS = "SELECT DISTINCT event_id % 97 AS case_id, concat('check-', event_type) AS check FROM {t} WHERE event_type <> 'error'"
SQL = {k: v.format(s="VARCHAR", a="list_value", t="events") for k, v in (("e", ENTRIES), ("r", RULES), ("c", CHECKS.replace(" check ", ' "check" ')))}
KNOWN = f"""e AS ({SQL['e']}), r AS ({SQL['r']}), c AS ({SQL['c']}), x AS (SELECT entry_id, unnest(rule_ids) AS rule, case_id FROM e), y AS (SELECT entry_id, unnest(check_ids) AS "check", case_id FROM e),
  m AS (SELECT e.*, entry_id IN (SELECT entry_id FROM x WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.case_id = x.case_id AND r.rule = x.rule)) AS no_rule, entry_id IN (SELECT entry_id FROM y WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.case_id = y.case_id AND c."check" = y."check")) AS no_check, rule_ids[1] = rule_ids[2] AS twice FROM e)"""
REPLAYED = f"""WITH {KNOWN}, g AS (SELECT *, min(moment) FILTER (NOT (no_rule OR no_check OR twice)) OVER (PARTITION BY case_id, disposition_id) AS first FROM m),
  o AS (SELECT *, CASE WHEN moment > first THEN 'DUPLICATE_DISPOSITION_ID' WHEN no_rule OR no_check OR twice THEN 'INVALID_DISPOSITION' END AS reason FROM g)
  SELECT case_id, moment, entry_id, disposition_id, CASE WHEN reason IS NULL THEN 'accepted' ELSE 'refused' END AS outcome, reason, CASE WHEN reason IS NULL THEN count(*) FILTER (reason IS NULL) OVER (PARTITION BY case_id ORDER BY moment) END AS sequence FROM o"""
BROKEN = f"""WITH {KNOWN}, n AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY moment) AS expected, min(moment) OVER (PARTITION BY case_id, disposition_id) AS first FROM m)
  SELECT case_id, moment AS position, unnest(list_filter([CASE WHEN sequence <> expected THEN 'sequence_not_contiguous' END, CASE WHEN moment > first THEN 'duplicate_disposition' END, CASE WHEN no_rule THEN 'unknown_rule' END, CASE WHEN no_check THEN 'unknown_check' END, CASE WHEN twice THEN 'rule_named_twice' END], lambda x: x IS NOT NULL)) AS issue FROM n"""
CONFIRMED = """SELECT l_orderkey AS case_id, l_linenumber + 10 * l_partkey AS position, CASE WHEN l_suppkey % 13 = 0 THEN 'other' WHEN l_linestatus = 'O' THEN 'brandName' ELSE 'alcoholStatement' END AS field, CASE l_partkey % 3 WHEN 0 THEN 'accepted-machine-reading' WHEN 1 THEN 'selected-alternate' ELSE 'corrected-value' END AS decision,
  CASE WHEN l_suppkey % 4 > 0 THEN concat('alt', CAST(l_suppkey % 4 AS {s})) END AS alternate_id, CASE WHEN l_suppkey % 5 > 0 THEN 'brandName' END AS corrected_field FROM {t}"""
OBSERVED = "SELECT o_orderkey AS case_id, field, CASE WHEN o_custkey % 3 > 0 THEN 'x' END AS value, CASE WHEN o_custkey % 5 > 0 THEN {a}('alt1', 'alt2') END AS alternate_ids FROM (SELECT DISTINCT o_orderkey, max(o_custkey) AS o_custkey FROM {t} GROUP BY o_orderkey), (VALUES ('brandName'), ('alcoholStatement')) AS f(field)"
REFUSED = f"""WITH h AS ({CONFIRMED.format(s='VARCHAR', t='lineitem')}), o AS ({OBSERVED.format(a='list_value', t='orders')}), j AS (SELECT h.*, value, alternate_ids, o.case_id IS NOT NULL AS seen FROM h LEFT JOIN o ON o.case_id = h.case_id AND o.field = h.field)
  SELECT case_id, position, unnest(list_filter([CASE WHEN NOT seen THEN 'unknown_field' END, CASE WHEN seen AND decision = 'accepted-machine-reading' AND value IS NULL THEN 'nothing_to_accept' END, CASE WHEN seen AND decision = 'selected-alternate' AND NOT coalesce(list_contains(alternate_ids, alternate_id), false) THEN 'unknown_alternate' END,
    CASE WHEN decision = 'corrected-value' AND corrected_field IS DISTINCT FROM field THEN 'other_field' END], lambda x: x IS NOT NULL)) AS issue FROM j"""
#: The last row of the page before: created at, submission.
AFTER = ("1996-03-14", 1200)


def register(r: Registry) -> None:
    """Adds the queries of this module."""
    sql = lambda s, d, text, table: s.sql(text.format(s="STRING", a="array", t="{t}"), t=view(s, d, table))
    three = lambda s, d: (sql(s, d, ENTRIES, "events"), sql(s, d, RULES, "events"), sql(s, d, CHECKS, "events"))
    r.add("v23_replayed_dispositions", REPLAYED)(lambda s, d: hs.replayed(*three(s, d)))
    r.add("v23_disposition_issues", BROKEN)(lambda s, d: hs.disposition_issues(*[x.withColumnRenamed("moment", "position") for x in three(s, d)]))
    r.add("v23_confirmation_issues", REFUSED)(lambda s, d: hs.confirmation_issues(sql(s, d, CONFIRMED, "lineitem"), sql(s, d, OBSERVED, "orders")))
    r.add("t1_page_after", duck("fx_submissions", sql=f"SELECT submission_id, created_at FROM fx_submissions WHERE created_at < TIMESTAMP '{AFTER[0]}' OR (created_at = TIMESTAMP '{AFTER[0]}' AND submission_id > {AFTER[1]}) ORDER BY created_at DESC, submission_id LIMIT 50"))(
        lambda s, d: rv.page_after(view(s, d, "fx_submissions").select("submission_id", "created_at"), [("created_at", False), ("submission_id", True)], [F.to_timestamp(F.lit(AFTER[0])), F.lit(AFTER[1])], 50)
    )
