"""Queries of the review jobs, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.fixtures import duck, view
from auditloom.operators import review as rv
from auditloom.registry import Registry

LATEST = "latest AS (SELECT submission_id, max(revision_number) AS revision_number, max_by(submitted_by, revision_number) AS submitted_by FROM fx_revisions GROUP BY 1)"
DECISIONS = "SELECT user_id AS submission_id, CAST(event_id % 5 + 1 AS INT) AS revision_number, CASE event_type WHEN 'error' THEN 'changes_requested' ELSE 'accepted' END AS decision, props AS note FROM {}"
STATES = "SELECT case_id, state, exact AS correct FROM {}"
AFTER = "SELECT case_id, CASE WHEN case_id % 4 = 0 THEN 'OBSERVED' ELSE state END AS state, normalized AS correct FROM {}"
NOW = "2026-01-01 00:00:00"


def register(r: Registry) -> None:
    decisions = lambda s, d: s.sql(DECISIONS.format("{events}"), events=view(s, d, "events"))
    dec = f"decisions AS ({DECISIONS.format('events')})"
    r.add("v1_queue_filter", duck("fx_submissions", sql="SELECT submission_id, creator_id FROM fx_submissions WHERE current_status = 'in_agent_review' AND NOT is_demo"))(lambda s, d: rv.queue_filter(view(s, d, "fx_submissions"), "in_review").select("submission_id", "creator_id"))
    r.add("j1_truth_join", "SELECT l.doc_id, l.quality, l.toxic, d.n_chars FROM labels l JOIN documents d USING (doc_id) WHERE d.doc_id % 7 <> 0")(lambda s, d: rv.strict_truth_join(view(s, d, "labels"), view(s, d, "documents").filter("doc_id % 7 <> 0"), "doc_id")[0].select("doc_id", "quality", "toxic", "n_chars"))
    r.add("j1_truth_missing", "SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 7 <> 0)")(lambda s, d: rv.strict_truth_join(view(s, d, "labels"), view(s, d, "documents").filter("doc_id % 7 <> 0"), "doc_id")[1].select("doc_id"))
    r.add("j2_review_queue", duck("fx_submissions", "fx_revisions", "fx_users", sql=f"""WITH {LATEST}, cut AS (SELECT * FROM fx_submissions WHERE current_status = 'waiting_for_agent_review' AND NOT is_demo ORDER BY created_at, submission_id LIMIT 25 OFFSET 25)
        SELECT c.submission_id, current_status, revision_number, coalesce(nullif(trim(name), ''), email, 'unknown') AS submitter, CAST(epoch(TIMESTAMP '{NOW}') - epoch(created_at) AS BIGINT) AS age_seconds FROM cut c JOIN latest USING (submission_id) LEFT JOIN fx_users u ON u.user_id = submitted_by"""))(
        lambda s, d: rv.review_queue(view(s, d, "fx_submissions"), view(s, d, "fx_revisions"), view(s, d, "fx_users"), "waiting", 2, 25, NOW)
    )
    r.add("j3_owner_list", duck("fx_submissions", "fx_revisions", sql=f"""WITH {LATEST}, {dec}, asked AS (SELECT submission_id, revision_number, max(note) AS change_request FROM decisions WHERE decision = 'changes_requested' GROUP BY ALL)
        SELECT creator_id, s.submission_id, current_status, l.revision_number, change_request FROM fx_submissions s LEFT JOIN latest l ON l.submission_id = s.submission_id LEFT JOIN asked a ON a.submission_id = s.submission_id AND a.revision_number = l.revision_number"""))(
        lambda s, d: rv.owner_list(view(s, d, "fx_submissions"), view(s, d, "fx_revisions"), decisions(s, d))
    )
    r.add("j4_submission_detail", duck("fx_submissions", "fx_revisions", sql=f"""WITH {dec}, h AS (SELECT submission_id, max(revision_number) AS latest, count(*) AS n, string_agg(CAST(submitted_by AS VARCHAR), ',' ORDER BY revision_number, submitted_by) AS submitters FROM fx_revisions GROUP BY 1), k AS (SELECT submission_id, count(*) AS n, max(revision_number) AS m FROM decisions GROUP BY 1)
        SELECT s.submission_id, latest, coalesce(h.n, 0) AS n_revisions, submitters, coalesce(k.n, 0) AS n_decisions, coalesce(m = latest, false) AS answered FROM fx_submissions s LEFT JOIN h USING (submission_id) LEFT JOIN k USING (submission_id)"""))(
        lambda s, d: rv.submission_detail(view(s, d, "fx_submissions"), view(s, d, "fx_revisions"), decisions(s, d))
    )
    diff = "diff AS (SELECT coalesce(e.case_id, a.case_id) AS case_id, CASE WHEN a.case_id IS NULL THEN 'missing' WHEN e.case_id IS NULL THEN 'unexpected' WHEN e.digest IS DISTINCT FROM a.digest OR e.byte_length IS DISTINCT FROM a.byte_length THEN 'changed' ELSE 'matched' END AS status FROM fx_expected e FULL JOIN fx_actual a ON e.case_id = a.case_id)"
    spark_diff = lambda s, d: rv.snapshot_diff(view(s, d, "fx_expected"), view(s, d, "fx_actual"), "case_id")
    r.add("j5_snapshot_diff", duck("fx_expected", "fx_actual", sql=f"WITH {diff} SELECT * FROM diff"))(spark_diff)
    r.add("j5_snapshot_verdict", duck("fx_expected", "fx_actual", sql=f"WITH {diff} SELECT count(*) FILTER (status = 'matched') AS matched, count(*) FILTER (status = 'missing') AS missing, count(*) FILTER (status = 'changed') AS changed, count(*) FILTER (status = 'unexpected') AS unexpected, CASE WHEN count(*) FILTER (status <> 'matched') = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM diff"))(lambda s, d: rv.snapshot_verdict(spark_diff(s, d)))
    r.add("j6_before_after", duck("fx_cases", sql=f"""WITH b AS ({STATES.format('fx_cases')}), a AS ({AFTER.format('fx_cases')})
        SELECT case_id, b.state AS state_before, b.correct AS correct_before, a.state AS state_after, a.correct AS correct_after, CASE WHEN a.correct AND NOT b.correct THEN 'IMPROVED' WHEN b.correct AND NOT a.correct THEN 'REGRESSED' ELSE 'CHANGED-STATE-ONLY' END AS verdict FROM b JOIN a USING (case_id) WHERE b.state <> a.state OR b.correct <> a.correct"""))(
        lambda s, d: rv.before_after(s.sql(STATES.format("{c}"), c=view(s, d, "fx_cases")), s.sql(AFTER.format("{c}"), c=view(s, d, "fx_cases")), "case_id")
    )
    r.add("j7_verify_inventory", duck("fx_expected", "fx_actual", sql="""WITH k AS (SELECT lower(digest) AS known, min(CASE WHEN case_id % 19 = 0 THEN byte_length + 1 ELSE byte_length END) AS size FROM fx_actual GROUP BY 1)
        SELECT case_id, CASE WHEN known IS NULL THEN 'digest_absent' ELSE 'size_differs' END AS issue FROM fx_expected e LEFT JOIN k ON lower(e.digest) = known WHERE known IS NULL OR size <> byte_length"""))(
        lambda s, d: rv.verify_inventory(view(s, d, "fx_expected"), view(s, d, "fx_actual").withColumn("byte_length", F.expr("CASE WHEN case_id % 19 = 0 THEN byte_length + 1 ELSE byte_length END")))
    )
    r.add("j8_multiset_diff", duck("fx_panels", sql="""WITH n AS (SELECT submission_id, role, checksum, count(*) FILTER (side = 'parent') AS p, count(*) FILTER (side = 'child') AS c FROM fx_panels GROUP BY ALL),
        parents AS (SELECT submission_id, role, checksum, row_number() OVER (PARTITION BY submission_id, role ORDER BY checksum) AS k FROM n, range(p - least(p, c)) x(i)),
        children AS (SELECT submission_id, role, checksum, row_number() OVER (PARTITION BY submission_id, role ORDER BY checksum) AS k FROM n, range(c - least(p, c)) x(i)),
        m AS (SELECT coalesce(p.submission_id, c.submission_id) AS submission_id, coalesce(p.role, c.role) AS role, p.checksum AS was, c.checksum AS now FROM parents p FULL JOIN children c ON p.submission_id = c.submission_id AND p.role = c.role AND p.k = c.k)
        SELECT submission_id, role, 'unchanged' AS change, checksum AS was, checksum AS now, least(p, c) AS n FROM n WHERE least(p, c) > 0
        UNION ALL SELECT submission_id, role, CASE WHEN was IS NULL THEN 'added' WHEN now IS NULL THEN 'removed' ELSE 'replaced' END, was, now, count(*) FROM m GROUP BY submission_id, role, was, now"""))(lambda s, d: rv.multiset_diff(view(s, d, "fx_panels")))  # fmt: skip
    ev = "SELECT submission_id, role AS category, max(checksum) AS decision, count(*) AS value FROM {} WHERE side = '{}' GROUP BY submission_id, role"
    r.add("j9_evidence_diff", duck("fx_panels", sql=f"""WITH p AS ({ev.format('fx_panels', 'parent')}), c AS ({ev.format('fx_panels', 'child')})
        SELECT coalesce(p.submission_id, c.submission_id) AS submission_id, coalesce(p.category, c.category) AS category, p.decision AS prior, p.value AS prior_value, c.decision AS new, c.value AS new_value, p.decision IS DISTINCT FROM c.decision OR p.value IS DISTINCT FROM c.value AS changed FROM p FULL JOIN c ON p.submission_id = c.submission_id AND p.category = c.category"""))(
        lambda s, d: rv.evidence_diff(s.sql(ev.format("{p}", "parent"), p=view(s, d, "fx_panels")), s.sql(ev.format("{p}", "child"), p=view(s, d, "fx_panels")), ["submission_id", "category"])
    )
    r.add("j10_revision_chain", duck("fx_revisions", sql=f"""WITH {dec}, k AS (SELECT submission_id, revision_number + 1 AS revision_number, max(decision) AS decision_on_parent FROM decisions GROUP BY ALL)
        SELECT v.submission_id, v.revision_number, v.submitted_by, p.submitted_by AS parent_by, decision_on_parent FROM fx_revisions v LEFT JOIN fx_revisions p ON p.submission_id = v.submission_id AND p.revision_number = v.revision_number - 1 LEFT JOIN k ON k.submission_id = v.submission_id AND k.revision_number = v.revision_number"""))(
        lambda s, d: rv.revision_chain(view(s, d, "fx_revisions"), decisions(s, d))
    )
    r.add("j23_resolve_references", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size % 9 <> 0)")(lambda s, d: rv.dangling(view(s, d, "lineitem"), view(s, d, "part").filter("p_size % 9 <> 0").withColumnRenamed("p_partkey", "l_partkey"), "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey"))
    r.add("j25_requirement_coverage", "SELECT p_partkey AS fact_key, EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'A') AS cited, coalesce((SELECT string_agg(DISTINCT l_linestatus || l_linenumber, ',' ORDER BY l_linestatus || l_linenumber) FROM lineitem WHERE l_partkey = p_partkey AND l_tax > 0.06), '') AS rules FROM part")(
        lambda s, d: rv.requirement_coverage(view(s, d, "part").select(F.col("p_partkey").alias("fact_key")), view(s, d, "lineitem").filter("l_returnflag = 'A'").select(F.col("l_orderkey").alias("requirement_id"), F.col("l_partkey").alias("fact_key")), view(s, d, "lineitem").filter("l_tax > 0.06").select(F.concat("l_linestatus", F.col("l_linenumber").cast("string")).alias("rule_id"), F.col("l_partkey").alias("fact_key")))
    )
    r.add("j26_duplicate_links", duck("fx_entries", sql="""SELECT e.case_id, e.duplicate_of, CASE WHEN e.duplicate_of = e.case_id THEN 'self' WHEN t.case_id IS NULL THEN 'unresolved' ELSE 'chained' END AS issue FROM fx_entries e LEFT JOIN fx_entries t ON t.case_id = e.duplicate_of
        WHERE e.duplicate_of IS NOT NULL AND (e.duplicate_of = e.case_id OR t.case_id IS NULL OR t.duplicate_of IS NOT NULL)"""))(lambda s, d: rv.duplicate_links(view(s, d, "fx_entries")))  # fmt: skip
    runs, changes = "SELECT user_id AS package_id, event_id AS seq FROM {} WHERE event_type = 'purchase'", "SELECT user_id AS package_id, event_id AS seq FROM {} WHERE event_type = 'error'"
    r.add("j28_stale_analysis", f"WITH a AS (SELECT package_id, max(seq) AS run FROM ({runs.format('events')}) GROUP BY 1), b AS (SELECT package_id, max(seq) AS change FROM ({changes.format('events')}) GROUP BY 1) SELECT package_id, run, change, coalesce(change > run, false) AS stale FROM a LEFT JOIN b USING (package_id)")(
        lambda s, d: rv.stale_analysis(s.sql(runs.format("{e}"), e=view(s, d, "events")), s.sql(changes.format("{e}"), e=view(s, d, "events")))
    )
    obs = "SELECT doc_id AS case_id, lang AS field, source AS value, {}(concat(source, '-1'), concat(source, '-2')) AS alternates FROM {}"
    conf = "SELECT event_id % 700 AS case_id, CASE event_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'de' ELSE 'fr' END AS field, event_id AS seq, CASE event_type WHEN 'view' THEN 'alternate' WHEN 'click' THEN 'corrected' WHEN 'error' THEN 'unreadable' ELSE 'machine' END AS action, CAST(event_id % 3 + 1 AS INT) AS pick, props AS corrected FROM {}"
    r.add("j29_effective_values", f"""WITH o AS ({obs.format('list_value', 'documents')}), c AS (SELECT case_id, field, max_by(action, seq) AS action, max_by(pick, seq) AS pick, max_by(corrected, seq) AS corrected FROM ({conf.format('events')}) GROUP BY ALL)
        SELECT o.case_id, o.field, coalesce(action, 'machine') AS source, CASE action WHEN 'alternate' THEN alternates[pick] WHEN 'corrected' THEN corrected WHEN 'unreadable' THEN NULL ELSE value END AS effective FROM o LEFT JOIN c ON o.case_id = c.case_id AND o.field = c.field""")(
        lambda s, d: rv.effective_values(s.sql(obs.format("array", "{t}"), t=view(s, d, "documents")), s.sql(conf.format("{t}"), t=view(s, d, "events")))
    )
    r.add("t1_page", duck("fx_submissions", sql="SELECT submission_id, created_at FROM fx_submissions ORDER BY created_at DESC, submission_id LIMIT 50 OFFSET 100"))(lambda s, d: rv.page(view(s, d, "fx_submissions").select("submission_id", "created_at"), [F.desc("created_at"), F.col("submission_id")], 3, 99))
    r.add("t3_set_compare", duck("fx_expected", "fx_actual", sql="SELECT count(*) FILTER (e.case_id = a.case_id) AS shared, count(*) FILTER (a.case_id IS NULL) AS only_left, count(*) FILTER (e.case_id IS NULL) AS only_right, round(count(*) FILTER (e.case_id = a.case_id) / count(*)::DOUBLE, 6) AS jaccard, count(*) FILTER (e.case_id = a.case_id) = count(*) AS same FROM fx_expected e FULL JOIN fx_actual a ON e.case_id = a.case_id"))(lambda s, d: rv.set_compare(view(s, d, "fx_expected"), view(s, d, "fx_actual"), "case_id"))
