"""Queries of the log, order and validation jobs, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.fixtures import duck, view
from auditloom.operators import logs as lg
from auditloom.operators import manifests as mf
from auditloom.operators.dealing import dealt, tasks
from auditloom.registry import Registry

TOKENS = "SELECT event_id % 200 AS case_id, user_id % 6 AS pass_order, props AS token FROM {}"
CANDS = "SELECT case_id, priority AS pass, value, score FROM {}"
DECS = "SELECT event_id AS decision_id, user_id AS submission_id, event_id % 40 AS revision_number, event_id AS version_before, CASE WHEN event_id % 13 = 0 THEN event_id + 2 ELSE event_id + 1 END AS version_after FROM {}"
RUNS = "SELECT user_id AS run_id, event_id AS sequence, CAST(floor(event_id / (user_id % 5 + 1)) + CASE WHEN user_id % 3 = 0 AND event_id % 2 = 0 THEN 100 ELSE 0 END AS BIGINT) AS measure FROM {}"


#: Declarations of orders: every rule is broken by some.
DECLARED = """SELECT o_orderkey AS case_id, CASE WHEN o_orderkey % 41 = 0 THEN 'v0' ELSE 'v1' END AS version, CASE WHEN o_orderkey % 43 = 0 THEN 'run-9' ELSE 'run-1' END AS run_id, CASE WHEN o_orderkey % 47 = 0 THEN ' ' ELSE 'img' END AS image_ref, CASE WHEN o_orderkey % 53 = 0 THEN 'x' ELSE concat(md5('a'), md5('b')) END AS sha256,
  CASE WHEN o_orderkey % 59 = 0 THEN 'text/plain' ELSE 'image/png' END AS media_type, CASE WHEN o_orderkey % 61 = 0 THEN 0 ELSE 5 END AS bytes, CASE o_orderkey % 8 WHEN 0 THEN 'EXCLUDED' WHEN 1 THEN 'NON_BLIND_OPERATIONAL' WHEN 2 THEN 'PENDING' WHEN 3 THEN 'BAD' ELSE 'PRIMARY_BLIND_CANDIDATE' END AS eligibility,
  CASE o_orderkey % 9 WHEN 0 THEN 'ABSENT' WHEN 1 THEN 'ODD' ELSE 'PRESENT' END AS brand_state, CASE WHEN o_orderkey % 67 = 0 OR (o_orderkey % 9 < 2 AND o_orderkey % 71 <> 0) THEN NULL ELSE 'Acme  Wines' END AS brand_text, CASE WHEN o_orderkey % 73 = 0 THEN 'other' ELSE 'acme wines' END AS brand_normal,
  CASE o_orderkey % 10 WHEN 0 THEN 'ABSENT' WHEN 1 THEN 'ODD' ELSE 'PRESENT' END AS alcohol_state, CASE WHEN o_orderkey % 83 = 0 OR o_orderkey % 10 < 2 THEN NULL WHEN o_orderkey % 79 = 0 THEN 'strong' ELSE '12.5% by vol' END AS alcohol_text, CASE WHEN o_orderkey % 89 = 0 THEN 1 ELSE 1250 END AS alcohol_normal,
  CASE WHEN o_orderkey % 97 = 0 THEN -5 ELSE o_orderkey % 5 END AS search_ms, CASE WHEN o_orderkey % 29 = 0 THEN -1 ELSE o_orderkey % 7 END AS transcription_ms, CASE WHEN o_orderkey % 31 = 0 THEN -2 ELSE o_orderkey % 3 END AS verification_ms, CASE WHEN o_orderkey % 37 = 0 THEN -3 WHEN o_orderkey % 101 <> 0 THEN o_orderkey % 5 + o_orderkey % 7 + o_orderkey % 3 + o_orderkey % 4 - 1 END AS total_ms,
  CASE WHEN o_orderkey % 23 <> 0 THEN o_orderdate END AS started_at, CASE WHEN o_orderkey % 103 = 0 THEN NULL WHEN o_orderkey % 6 = 0 THEN o_orderdate - INTERVAL 1 DAY ELSE o_orderdate + INTERVAL 1 DAY END AS completed_at, CASE WHEN o_orderkey % 107 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN o_orderdate - INTERVAL 3 DAY ELSE o_orderdate + INTERVAL 4 DAY END AS recorded_at,
  CASE WHEN o_orderkey % 109 <> 0 THEN o_orderdate END AS accessed_at, CASE WHEN o_orderkey % 113 = 0 THEN 'BAD' WHEN o_orderkey % 127 <> 0 THEN 'ARCHIVE' END AS source_type, CASE WHEN o_orderkey % 131 = 0 THEN 'run-001/out' WHEN o_orderkey % 137 = 0 THEN '' ELSE 'book 4' END AS source_ref, CASE WHEN o_orderkey % 13 = 0 THEN 'case-7' END AS prior_identity,
  CASE WHEN o_orderkey % 3 <> 0 THEN 'why' END AS exclusion_reason, CASE WHEN o_orderkey % 149 = 0 THEN '' ELSE 'own' END AS independence, CASE WHEN o_orderkey % 151 <> 0 THEN 'by hand' END AS method, CASE WHEN o_orderkey % 157 <> 0 THEN 'kay' END AS recorder, CASE WHEN o_orderkey % 163 = 0 THEN ' ' ELSE 'clerk' END AS recorder_role,
  CASE WHEN o_orderkey % 17 = 0 THEN 'bad' WHEN o_orderkey % 2 = 0 THEN concat(md5('d'), md5('d')) END AS digest, CASE WHEN o_orderkey % 19 = 0 THEN concat(md5('e'), md5('e')) ELSE concat(md5('d'), md5('d')) END AS digest_found FROM {}"""
_PRIMARY = "eligibility = 'PRIMARY_BLIND_CANDIDATE' AND "
#: What a primary candidate must have, and the conditions under which it hasn't.
_NEEDED = {
    "values": "brand_state <> 'PRESENT' OR alcohol_state <> 'PRESENT'", "source_type": "source_type IS NULL", "source_ref": "source_ref = ''", "access_date": "accessed_at IS NULL", "independence": "independence = ''", "method": "method IS NULL", "recorder": "recorder IS NULL OR recorder_role = ' '", "recorded_at": "recorded_at IS NULL", "started_at": "started_at IS NULL", "completed_at": "completed_at IS NULL",
    **{f"{t}_ms": f"{t}_ms IS NULL OR {t}_ms < 0" for t in ("search", "transcription", "verification", "total")},
}
_ORDER = {"completed_before_start": "completed_at < started_at", "recorded_before_completion": "recorded_at < completed_at"} | {f"{a}_not_before_{t}": f"{b} >= {t}" for t in ("randomized_at", "exposed_at", "executed_at") for a, b in (("recorded", "recorded_at"), ("completed", "completed_at"))}
_BURDEN = "total_ms < search_ms + transcription_ms + verification_ms"
DECLARATION_RULES = {
    "version": "run_version IS NULL OR version <> run_version", "run": "run_version IS NULL", "image_ref": "image_ref = ' '", "sha256": "sha256 = 'x'", "media_type": "media_type = 'text/plain'", "bytes": "bytes = 0", "eligibility": "eligibility = 'BAD'", "brand_state": "brand_state = 'ODD'", "brand_text": "(brand_state = 'PRESENT') = (brand_text IS NULL)",
    "brand_normal": "brand_state = 'PRESENT' AND (brand_text IS NULL OR brand_normal = 'other')", "alcohol_state": "alcohol_state = 'ODD'", "alcohol_text": "(alcohol_state = 'PRESENT') = (alcohol_text IS NULL)", "alcohol_syntax": "alcohol_state = 'PRESENT' AND alcohol_text = 'strong'", "alcohol_normal": "alcohol_state = 'PRESENT' AND alcohol_text = '12.5% by vol' AND alcohol_normal = 1",
    **{f"{t}_ms_negative": f"{t}_ms < 0" for t in ("search", "transcription", "verification", "total")}, "burden": _BURDEN, **_ORDER, "source_type": "source_type = 'BAD'", "source_forbidden": "source_ref = 'run-001/out'", "exposed_primary": f"{_PRIMARY}prior_identity = 'case-7'", "reason_missing": "eligibility IN ('EXCLUDED', 'NON_BLIND_OPERATIONAL') AND exclusion_reason IS NULL",
    **{f"primary_{k}": f"{_PRIMARY}({c})" for k, c in _NEEDED.items()}, "primary_incomplete": f"{_PRIMARY}(" + " OR ".join(f"coalesce({c}, false)" for c in [*_NEEDED.values(), *_ORDER.values(), _BURDEN, "source_type = 'BAD'", "source_ref = 'run-001/out'"]) + ")", "digest": "digest = 'bad'", "digest_differs": "digest <> 'bad' AND digest <> digest_found",
}


def register(r: Registry) -> None:
    ent = lambda s, d: view(s, d, "fx_entries")
    obs = "SELECT l_orderkey * 10 + l_linenumber AS case_id, l_returnflag AS value, {a}(l_linestatus, CAST(l_linenumber AS {t})) AS alternates, CASE WHEN l_partkey % 3 = 0 THEN 'O' ELSE 'R' END AS truth FROM {lineitem}"
    r.add("w1_truth_rank", f"WITH o AS ({obs.format(a='list_value', t='VARCHAR', lineitem='lineitem')}) SELECT case_id, CASE WHEN value = truth THEN 1 WHEN alternates[1] = truth THEN 2 WHEN alternates[2] = truth THEN 3 END::BIGINT AS rank, coalesce(value = truth OR alternates[1] = truth OR alternates[2] = truth, false) AS in_top FROM o")(
        lambda s, d: lg.truth_rank(s.sql(obs.format(a="array", t="STRING", lineitem="{t}"), t=view(s, d, "lineitem")))
    )
    r.add("w2_first_seen_tokens", f"WITH w AS ({TOKENS.format('events')}), f AS (SELECT case_id, token, min(pass_order) AS pass_order FROM w GROUP BY ALL) SELECT case_id, pass_order, count(*) AS new_tokens FROM f GROUP BY ALL")(lambda s, d: lg.first_seen_tokens(s.sql(TOKENS.format("{e}"), e=view(s, d, "events"))))
    r.add("w3_cumulative_cost", duck("fx_passes", sql="SELECT case_id, pass_order, CAST(sum(execution_ms) OVER (PARTITION BY case_id ORDER BY pass_order) AS BIGINT) AS cost FROM fx_passes"))(lambda s, d: lg.cumulative_cost(view(s, d, "fx_passes")))
    right = "SELECT o_orderkey AS case_id, min(CAST(o_custkey % 97 AS {})) AS truth FROM {} GROUP BY o_orderkey"
    r.add("w4_prefix_selection", duck("fx_candidates", sql=f"""WITH c AS ({CANDS.format('fx_candidates')}), p AS (SELECT DISTINCT case_id, pass FROM c WHERE pass <= 5), b AS (SELECT p.case_id, p.pass, max_by(value, {{'s': score, 'v': value}}) AS value FROM p JOIN c ON c.case_id = p.case_id AND c.pass <= p.pass GROUP BY ALL),
        t AS (SELECT b.*, coalesce(value = truth, false) AS good FROM b LEFT JOIN ({right.format('VARCHAR', 'orders')}) r ON r.case_id = b.case_id)
        SELECT case_id, pass, value, coalesce(lag(value) OVER w <> value, false) AS changed, good AND NOT coalesce(bool_or(good) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS newly_correct FROM t WINDOW w AS (PARTITION BY case_id ORDER BY pass)"""))(
        lambda s, d: lg.prefix_selection(s.sql(CANDS.format("{c}"), c=view(s, d, "fx_candidates")), s.sql(right.format("STRING", "{o}"), o=view(s, d, "orders")))
    )
    hist = "SELECT log_key, CASE WHEN log_key % 10 = 0 AND sequence > 2 THEN sequence + 1 ELSE sequence END AS sequence, CASE WHEN log_key % 7 = 0 THEN 'same' ELSE entry_id END AS entry_id FROM {}"
    r.add("w5_history_issues", duck("fx_history", sql=f"WITH h AS ({hist.format('fx_history')}), n AS (SELECT *, row_number() OVER (PARTITION BY log_key ORDER BY sequence, entry_id) AS due, count(*) OVER (PARTITION BY log_key, entry_id) AS n FROM h) SELECT log_key, sequence, CASE WHEN sequence <> due THEN 'sequence' ELSE 'repeated_id' END AS issue FROM n WHERE sequence <> due OR n > 1"))(lambda s, d: lg.history_issues(s.sql(hist.format("{h}"), h=view(s, d, "fx_history"))))
    r.add("w6_append_log", duck("fx_history", sql="""WITH old AS (SELECT * FROM fx_history WHERE sequence <= 3), new AS (SELECT DISTINCT log_key, entry_id FROM fx_history WHERE sequence >= 3 AND (log_key, entry_id) NOT IN (SELECT log_key, entry_id FROM old))
        SELECT log_key, coalesce((SELECT max(sequence) FROM old o WHERE o.log_key = new.log_key), 0) + row_number() OVER (PARTITION BY log_key ORDER BY entry_id) AS sequence, entry_id FROM new"""))(lambda s, d: lg.append_log(view(s, d, "fx_history").filter("sequence <= 3"), view(s, d, "fx_history").filter("sequence >= 3").select("log_key", "entry_id")))  # fmt: skip
    legal = ", ".join(f"('{a}', '{b}')" for a, b in lg.TRANSITIONS)
    r.add("w7_status_transitions", duck("fx_events", sql=f"WITH e AS (SELECT *, lag(action) OVER w AS before, epoch_us(recorded_at) - epoch_us(lag(recorded_at) OVER w) AS dwell_us FROM fx_events WINDOW w AS (PARTITION BY submission_id ORDER BY recorded_at, event_id)) SELECT event_id, submission_id, before, action, before IS NULL OR (before, action) IN ({legal}) AS legal, dwell_us FROM e"))(lambda s, d: lg.status_transitions(view(s, d, "fx_events")))
    r.add("w8_version_chain_issues", f"""WITH x AS ({DECS.format('events')}), y AS (SELECT *, lag(version_after) OVER (PARTITION BY submission_id ORDER BY version_after, decision_id) AS last, count(*) OVER (PARTITION BY submission_id, revision_number) AS n FROM x),
        z AS (SELECT decision_id, CASE WHEN version_after <> version_before + 1 THEN 'step' WHEN last IS NOT NULL AND version_before <> last THEN 'gap' WHEN n > 1 THEN 'decided_twice' END AS issue FROM y) SELECT * FROM z WHERE issue IS NOT NULL""")(lambda s, d: lg.version_chain_issues(s.sql(DECS.format("{e}"), e=view(s, d, "events"))))  # fmt: skip
    r.add("w9_monotonic_growth", f"WITH x AS ({RUNS.format('events')}), y AS (SELECT *, measure - lag(measure) OVER (PARTITION BY run_id ORDER BY sequence) AS step FROM x) SELECT run_id, count(*) AS n, count(*) >= 3 AND coalesce(bool_and(step >= 0), false) AND coalesce(bool_or(step > 0), false) AS grows FROM y GROUP BY 1")(lambda s, d: lg.monotonic_growth(s.sql(RUNS.format("{e}"), e=view(s, d, "events"))))
    r.add("t2_top_candidates", duck("fx_candidates", sql="SELECT case_id, field, candidate_id, priority, score FROM fx_candidates QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY priority, score DESC, candidate_id, field, value) <= 2"))(lambda s, d: lg.top_candidates(view(s, d, "fx_candidates"), 2).select("case_id", "field", "candidate_id", "priority", "score"))
    r.add("t4_pool_passes", duck("fx_passes", sql="SELECT event_id, case_id, 'base' AS pool FROM fx_passes WHERE pass_kind = 'view' UNION ALL SELECT event_id, case_id, 'extra' FROM fx_passes WHERE pass_kind = 'click'"))(lambda s, d: lg.pool_passes(view(s, d, "fx_passes").filter("pass_kind = 'view'"), view(s, d, "fx_passes").filter("pass_kind = 'click'")).select("event_id", "case_id", "pool"))
    r.add("t5_counterbalanced_order", "WITH k AS (SELECT doc_id AS case_id, row_number() OVER (ORDER BY md5('s|' || doc_id), doc_id) AS rank FROM documents) SELECT case_id, rank, 1 AS block, CASE WHEN rank % 2 = 1 THEN 'A' ELSE 'B' END AS mode FROM k UNION ALL SELECT case_id, rank, 2, CASE WHEN rank % 2 = 1 THEN 'B' ELSE 'A' END FROM k")(lambda s, d: lg.counterbalanced_order(view(s, d, "documents").withColumnRenamed("doc_id", "case_id"), "s"))
    r.add("st1_idempotent_ingest_batch", duck("fx_events", sql="SELECT event_id, idem_key, CASE WHEN row_number() OVER w = 1 THEN 'accepted' WHEN request_hash = first(request_hash) OVER w THEN 'replay' ELSE 'conflict' END AS outcome FROM fx_events WINDOW w AS (PARTITION BY idem_key ORDER BY recorded_at, event_id)"))(lambda s, d: lg.idempotent_ingest(view(s, d, "fx_events")))
    names = "SELECT log_key, sequence, entry_id, CASE WHEN log_key % 5 = 0 AND sequence % 3 = 2 THEN 'other' ELSE coalesce(lag(entry_id) OVER (PARTITION BY log_key ORDER BY sequence, entry_id), '') END AS names FROM {}"
    r.add("st3_append_head_batch", duck("fx_history", sql=f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY log_key ORDER BY sequence, entry_id) AS k FROM ({names.format('fx_history')})),
        w AS (SELECT log_key, k, sequence, entry_id, names = '' AS good, CASE WHEN names = '' THEN entry_id ELSE '' END AS head FROM n WHERE k = 1 UNION ALL SELECT n.log_key, n.k, n.sequence, n.entry_id, n.names = w.head, CASE WHEN n.names = w.head THEN n.entry_id ELSE w.head END FROM w JOIN n ON n.log_key = w.log_key AND n.k = w.k + 1)
        SELECT log_key, sequence, entry_id, CASE WHEN good THEN 'accepted' ELSE 'stale' END AS outcome, head FROM w""", recursive=True))(lambda s, d: lg.append_head(s.sql(names.format("{h}"), h=view(s, d, "fx_history"))))  # fmt: skip
    runs = "SELECT 'run-1' AS run_id, 'v1' AS version, DATE '1996-01-01' AS randomized_at, DATE '1997-06-01' AS exposed_at, DATE '1998-07-01' AS executed_at"
    declared = lambda s, d: s.sql(DECLARED.replace("VARCHAR", "STRING").format("{o}"), o=view(s, d, "orders"))
    listed = " UNION ALL ".join(f"SELECT case_id, '{k}' AS issue FROM j WHERE {c}" for k, c in DECLARATION_RULES.items())
    joined = f"d AS ({DECLARED.format('orders')}), j AS (SELECT d.*, r.version AS run_version, randomized_at, exposed_at, executed_at FROM d LEFT JOIN ({runs}) r ON r.run_id = d.run_id)"
    r.add("v3_manifest_issues", f"WITH {joined} {listed}")(lambda s, d: mf.manifest_issues(declared(s, d), s.sql(runs), "^run-", ["case-7"]))
    order = [k for k in DECLARATION_RULES if "before" in k]
    r.add("v4_timestamp_chain_issues", f"WITH {joined} " + " UNION ALL ".join(f"SELECT case_id, '{k}' AS issue FROM j WHERE {DECLARATION_RULES[k]}" for k in order))(lambda s, d: mf.timestamp_chain_issues(declared(s, d), s.sql(runs)))
    items = lambda s, d: dealt(view(s, d, "lineitem"), "l_orderkey")
    orders = lambda s, d: view(s, d, "orders").repartition(tasks(view(s, d, "lineitem")), "o_orderkey")  # as many as of items, which they meet
    found = "SELECT l_orderkey AS case_id, l_linenumber AS position, min(l_partkey) AS k FROM {} GROUP BY l_orderkey, l_linenumber"
    told = """SELECT case_id, position, CASE WHEN k % 17 = 0 THEN 'rule1' ELSE concat('rule', CAST(position AS VARCHAR)) END AS rule, CASE WHEN k % 19 = 0 THEN 'v2' ELSE 'v1' END AS rule_version, CASE WHEN k % 23 = 0 THEN 'q' ELSE 'p' END AS profile, '1' AS profile_version, CASE k % 4 WHEN 0 THEN 'brandName' WHEN 1 THEN 'alcoholStatement' WHEN 2 THEN 'colour' END AS ref_field,
      CASE WHEN k % 29 = 0 THEN 'other' ELSE 'same' END AS ref_digest, CASE WHEN case_id % 3 = 0 THEN 'NOT_OBSERVED' WHEN k % 31 = 0 THEN 'AMBIGUOUS' ELSE 'OBSERVED' END AS ref_state, CASE WHEN k % 5 = 0 THEN 1 END AS ref_alternate FROM {}"""
    ruled = "SELECT 1 AS position, 'rule1' AS rule, 'v1' AS rule_version UNION ALL SELECT 2, 'rule2', 'v1' UNION ALL SELECT 3, 'rule3', 'v1' UNION ALL SELECT 4, 'rule4', 'v1'"
    cases = "SELECT o_orderkey AS case_id, 'p' AS profile, '1' AS profile_version, 'same' AS digest, CASE WHEN o_orderkey % 3 = 0 THEN 'NOT_OBSERVED' ELSE 'OBSERVED' END AS brand_state, CASE WHEN o_orderkey % 3 = 0 THEN 'NOT_OBSERVED' ELSE 'OBSERVED' END AS alcohol_state FROM {} WHERE o_orderkey % 37 <> 0"
    known = "k % 4 IN (0, 1) AND r.case_id IS NOT NULL"
    broken = {"order": "position <= 4 AND k % 17 = 0 AND position <> 1", "version": "position <= 4 AND k % 19 = 0", "profile": "k % 23 = 0 AND r.case_id IS NOT NULL", "repeated": "nth > 1", "no_result": "r.case_id IS NULL", "unknown_field": "k % 4 = 2", "reference_digest": f"{known} AND k % 29 = 0", "reference_state": f"{known} AND t.case_id % 3 <> 0 AND k % 31 = 0", "alternate_of_nothing": f"{known} AND t.case_id % 3 = 0 AND k % 5 = 0"}
    r.add("v23_result_rules", f"""WITH n AS ({found.format('lineitem')}), r AS (SELECT DISTINCT case_id FROM ({cases.format('orders')})), t AS (SELECT *, row_number() OVER (PARTITION BY case_id, CASE WHEN k % 17 = 0 THEN 1 ELSE position END ORDER BY position) AS nth FROM n) """
        + " UNION ALL ".join(f"SELECT t.case_id, position, '{name}' AS issue FROM t LEFT JOIN r ON r.case_id = t.case_id WHERE {c}" for name, c in broken.items())
        + " UNION ALL SELECT r.case_id, NULL, 'count' FROM r LEFT JOIN (SELECT case_id, count(*) AS n FROM n GROUP BY 1) c ON c.case_id = r.case_id WHERE coalesce(c.n, 0) <> 4")(
        lambda s, d: mf.result_rule_issues(s.sql(told.replace("VARCHAR", "STRING").format("({n})").replace("({n})", "{n}"), n=s.sql(found.format("{l}"), l=items(s, d))), s.sql(ruled), s.sql(cases.format("{o}"), o=orders(s, d).dropDuplicates(["o_orderkey"])))
    )
    r.add("v5_burden_issues", duck("fx_entries", sql="SELECT case_id, total_burden, part_a + part_b AS parts FROM fx_entries WHERE total_burden < part_a + part_b"))(lambda s, d: ent(s, d).filter("total_burden < part_a + part_b").select("case_id", "total_burden", F.expr("part_a + part_b").alias("parts")))
    r.add("v9_duplicate_digests", duck("fx_entries", sql="SELECT digest, count(*) AS n, count(DISTINCT owner) AS owners, min(case_id) AS first_case FROM fx_entries GROUP BY 1 HAVING count(*) > 1"))(lambda s, d: lg.duplicate_digests(ent(s, d)))
    gaps = "SELECT l_partkey + CASE WHEN l_partkey % 37 = 5 THEN 1 ELSE 0 END AS id FROM {}"
    r.add("v10_id_range_gaps", f"WITH x AS ({gaps.format('lineitem')}), m AS (SELECT max(p_partkey) AS most FROM part) SELECT i AS id, 'missing' AS issue FROM (SELECT unnest(range(0, most + 11)) AS i FROM m) WHERE i NOT IN (SELECT id FROM x) UNION ALL SELECT id, 'repeated' FROM x GROUP BY id HAVING count(*) > 1")(
        lambda s, d: lg.id_range_gaps(s.sql(gaps.format("{l}"), l=view(s, d, "lineitem")), "id", 0, view(s, d, "part").agg(F.max("p_partkey")).first()[0] + 10)
    )
    r.add("v11_candidate_accounting", duck("fx_entries", sql="SELECT CASE WHEN category IS NULL THEN 'no_category' WHEN completed_at IS NULL THEN 'not_completed' WHEN has_issue THEN 'has_issue' ELSE 'primary' END AS state, count(*) AS n, count(DISTINCT owner) AS owners FROM fx_entries GROUP BY 1"))(lambda s, d: lg.candidate_accounting(ent(s, d)))
    r.add("v13_evidence_gate", duck("fx_traces", sql=" UNION ALL ".join(f"SELECT '{c}' AS gate, bool_and({e}) AS passed, count(*) FILTER (NOT ({e})) AS failures FROM fx_traces" for c, e in (("proposed", "proposed"), ("trusted", "trusted"), ("case_id", "case_id = 0")))))(lambda s, d: lg.evidence_gate(view(s, d, "fx_traces"), ["proposed", "trusted"], ["case_id"]))
    r.add("v14_category_coverage", duck("fx_entries", sql="SELECT v.category, count(e.case_id) AS n, count(e.case_id) >= 2000 AS met FROM (VALUES ('1-URGENT'), ('2-HIGH'), ('9-NONE')) v(category) LEFT JOIN fx_entries e ON e.category = v.category GROUP BY 1"))(lambda s, d: lg.category_coverage(ent(s, d), ["1-URGENT", "2-HIGH", "9-NONE"], 2000))
