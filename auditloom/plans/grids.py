"""Queries of the grid, funnel, trial and box jobs, with the same in SQL."""

from __future__ import annotations

from auditloom.fixtures import duck, view
from auditloom.operators import grids as g
from auditloom.operators import spatial as sp
from auditloom.registry import Registry

STAGES = ["proposed", "class_kept", "recovered", "assembled", "projected", "ranked", "trusted"]
SLICES = {"high": "similarity >= 25", "slow": "latency_ms > 300", "partial": "tokens_present BETWEEN 1 AND 3"}
BASE = "base AS (SELECT case_id, field, bool_or(correct) AS base, min(latency_ms) AS base_ms FROM fx_results WHERE scenario = 'baseline' GROUP BY ALL)"
BOX = "SELECT vec_id, case_id, role, (e0 + 1) * 0.3 AS x0, (e1 + 1) * 0.3 AS y0, (e0 + 1) * 0.3 + 0.05 + (e2 + 1) * 0.1 AS x1, (e1 + 1) * 0.3 + 0.05 + (e3 + 1) * 0.1 AS y1 FROM (SELECT vec_id, case_id, role, CAST(e0 AS DOUBLE) AS e0, CAST(e1 AS DOUBLE) AS e1, CAST(e2 AS DOUBLE) AS e2, CAST(e3 AS DOUBLE) AS e3 FROM {})"
BOX_DUCK = BOX.format("fx_boxes").replace("0.3", "0.3::DOUBLE").replace("0.05", "0.05::DOUBLE").replace("0.1", "0.1::DOUBLE")
PAIRS = """pairs AS (SELECT *, common / ta AS cov FROM (SELECT p.case_id, p.vec_id AS proposal, t.vec_id AS target, greatest(0, least(p.x1, t.x1) - greatest(p.x0, t.x0)) * greatest(0, least(p.y1, t.y1) - greatest(p.y0, t.y0)) AS common,
  (p.x1 - p.x0) * (p.y1 - p.y0) AS pa, (t.x1 - t.x0) * (t.y1 - t.y0) AS ta, (t.x0 + t.x1) / 2 BETWEEN p.x0 AND p.x1 AND (t.y0 + t.y1) / 2 BETWEEN p.y0 AND p.y1 AS centre FROM b p JOIN b t ON p.case_id = t.case_id AND p.role = 'proposal' AND t.role = 'target') WHERE common / ta >= 0.08 OR centre),
  ov AS (SELECT case_id, proposal, target, round(cov, 9) AS coverage, round(common / pa, 9) AS precision, round(common / (pa + ta - common), 9) AS iou, round(pa, 9) AS area FROM pairs)"""


def register(r: Registry) -> None:
    results = lambda s, d: view(s, d, "fx_results")
    traces = lambda s, d: view(s, d, "fx_traces")
    trials = lambda s, d: view(s, d, "fx_trials")
    boxes = lambda s, d: s.sql(BOX.format("{b}").replace("0.3", "0.3D").replace("0.05", "0.05D").replace("0.1 AS", "0.1D AS"), b=view(s, d, "fx_boxes"))
    res = lambda sql: duck("fx_results", sql=sql)
    r.add("a11_scenario_metrics", res("""WITH c AS (SELECT field, scenario, scale, count(*) AS n, count(*) FILTER (truth_present) AS present, count(*) FILTER (correct) AS correct, sum(tokens_present) AS tokens, avg(similarity) AS similarity, quantile_disc(latency_ms, 0.5) AS p50, quantile_disc(latency_ms, 0.95) AS p95 FROM fx_results GROUP BY ALL)
        SELECT f.field, s.scenario, k.scale, coalesce(n, 0) AS n, coalesce(present, 0) AS present, CASE WHEN n > 0 THEN round(correct / n::DOUBLE, 6) END AS correct_rate, CAST(coalesce(tokens, 0) AS BIGINT) AS tokens, round(similarity, 6) AS similarity, p50, p95
        FROM (SELECT DISTINCT field FROM fx_results) f CROSS JOIN (SELECT DISTINCT scenario FROM fx_results) s CROSS JOIN (SELECT DISTINCT scale FROM fx_results) k LEFT JOIN c ON c.field = f.field AND c.scenario = s.scenario AND c.scale = k.scale"""))(lambda s, d: g.scenario_metrics(results(s, d)))  # fmt: skip
    r.add("a12_contribution_metrics", res("SELECT field, scenario, scale, count(DISTINCT case_id) AS cases, count(*) FILTER (correct) AS correct, count(*) FILTER (tokens_present > 0) AS any_token, count(*) FILTER (tokens_present = tokens) AS all_tokens, round(avg(tokens_present), 6) AS mean_tokens FROM fx_results GROUP BY ALL"))(lambda s, d: g.contribution_metrics(results(s, d)))
    r.add("a13_recovery_ledger", res(f"WITH {BASE}, l AS (SELECT case_id, field, scenario, bool_or(correct) AS now FROM fx_results WHERE scenario <> 'baseline' GROUP BY ALL) SELECT scenario, field, case_id, count(*) OVER (PARTITION BY scenario, field) AS n FROM l JOIN base USING (case_id, field) WHERE now AND NOT base"))(lambda s, d: g.recovery_ledger(results(s, d)))
    r.add("a14_regression_summary", res(f"WITH {BASE} SELECT scenario, scale, count(*) AS n, count(DISTINCT case_id) AS cases FROM fx_results JOIN base USING (case_id, field) WHERE scenario <> 'baseline' AND base AND NOT correct GROUP BY GROUPING SETS ((scenario), (scenario, scale))"))(lambda s, d: g.regression_summary(results(s, d)))
    r.add("a15_scale_analysis", res("WITH p AS (SELECT case_id, field, scale, bool_or(correct) AS c FROM fx_results GROUP BY ALL) SELECT p.scale, count(*) FILTER (p.c AND NOT q.c) AS improved, count(*) FILTER (q.c AND NOT p.c) AS worsened, count(*) FILTER (p.c = q.c) AS unchanged FROM p JOIN p q ON p.case_id = q.case_id AND p.field = q.field AND q.scale = 1.5 AND p.scale <> 1.5 GROUP BY p.scale"))(lambda s, d: g.scale_analysis(results(s, d)))
    r.add("a16_latency_comparison", res(f"WITH {BASE}, l AS (SELECT case_id, field, scenario, min(latency_ms) AS extra FROM fx_results WHERE scenario <> 'baseline' GROUP BY ALL), m AS (SELECT scenario, count(*) AS n, quantile_disc(base_ms, 0.5) AS base, quantile_disc(extra, 0.5) AS extra, quantile_disc(base_ms + extra, 0.5) AS combined FROM l JOIN base USING (case_id, field) GROUP BY scenario) SELECT *, combined - base AS delta FROM m"))(lambda s, d: g.latency_comparison(results(s, d)))
    r.add("a17_challenge_slices", res(" UNION ALL ".join(f"SELECT '{k}' AS slice, field, scenario, count(*) AS n, count(*) FILTER (correct) AS correct FROM fx_results WHERE {c} GROUP BY ALL" for k, c in SLICES.items())))(lambda s, d: g.challenge_slices(results(s, d), SLICES))
    r.add("a18_annotation_coverage", res("SELECT field, count(*) FILTER (truth_present) AS present, count(*) FILTER (NOT truth_present) AS absent, count(DISTINCT case_id) AS cases, count(*) FILTER (similarity >= 40) AS sure FROM fx_results GROUP BY field"))(lambda s, d: g.annotation_coverage(results(s, d)))
    r.add("a19_best_scenario", res("SELECT case_id, field, outcome, similarity, scenario, scale FROM (SELECT *, CASE WHEN correct THEN 3 WHEN tokens_present = tokens THEN 2 WHEN tokens_present > 0 THEN 1 ELSE 0 END AS outcome FROM fx_results) QUALIFY row_number() OVER (PARTITION BY case_id, field ORDER BY outcome DESC, similarity DESC, latency_ms, scenario DESC, scale DESC) = 1"))(lambda s, d: g.best_scenario(results(s, d)))
    r.add("a27_repetition_summary", res("WITH h AS (SELECT case_id, field, repetition, bool_or(correct) AS hit, max(similarity) AS similarity FROM fx_results WHERE repetition <= 3 GROUP BY ALL) SELECT case_id, field, count(*) FILTER (hit) AS hits, bool_or(hit) AS any_hit, count(*) FILTER (hit) = 3 AS all_hit, min(similarity) AS low, CAST(median(similarity) AS DOUBLE) AS median, max(similarity) AS high FROM h GROUP BY ALL"))(lambda s, d: g.repetition_summary(results(s, d), 3))
    r.add("a29_arm_summary", res("WITH m AS (SELECT scenario AS arm, count(*) FILTER (truth_present) AS present, round(count(*) FILTER (truth_present AND correct) / (count(*) FILTER (truth_present))::DOUBLE, 6) AS recall, count(*) FILTER (failure_class = 'false-certainty') AS false_certainties, quantile_disc(latency_ms, 0.95) AS p95 FROM fx_results GROUP BY 1) SELECT *, CASE WHEN recall < 0.33 THEN 'reject' WHEN p95 > 480 THEN 'slow' ELSE 'accept' END AS decision FROM m"))(lambda s, d: g.arm_summary(results(s, d)))
    r.add("a31_code_counts", res("SELECT failure_class, count(*) AS n, count(DISTINCT case_id) AS cases FROM fx_results GROUP BY 1"))(lambda s, d: g.code_counts(results(s, d)))
    tr = lambda sql: duck("fx_traces", sql=sql)
    r.add("a21_survival_funnel", tr(" UNION ALL ".join(f"SELECT {i + 1} AS stage, '{n}' AS name, count(*) FILTER ({' AND '.join(STAGES[: i + 1])}) AS alive, count(*) AS of FROM fx_traces" for i, n in enumerate(STAGES))))(lambda s, d: g.survival_funnel(traces(s, d), STAGES))
    ends = "CASE " + " ".join(f"WHEN NOT {n} THEN 'lost_{n}'" for n in STAGES) + " ELSE 'survived' END"
    r.add("a22_terminal_category", tr(f"SELECT v.category, count(t.c) AS n FROM (VALUES {', '.join(f'({chr(39)}lost_{n}{chr(39)})' for n in STAGES)}, ('survived'), ('unknown')) v(category) LEFT JOIN (SELECT {ends} AS c FROM fx_traces) t ON t.c = v.category GROUP BY 1"))(lambda s, d: g.terminal_category(traces(s, d), STAGES))
    keys = ["field", "source", "class_a", "class_b", "proposed", "class_kept", "assembled"]
    r.add("a23_routing_matrix", tr(f"SELECT {', '.join(keys)}, count(*) AS n, count(*) FILTER (recovered) AS n_recovered, min(target_id) AS first_target FROM fx_traces GROUP BY {', '.join(keys)}"))(lambda s, d: g.routing_matrix(traces(s, d), keys))
    r.add("a25_class_crosstab", tr("SELECT class_a, class_b, count(*) AS n FROM fx_traces GROUP BY ALL"))(lambda s, d: g.class_crosstab(traces(s, d)))
    r.add("a26_proposal_sources", tr("SELECT source, count(DISTINCT target_id) FILTER (proposed) AS targets, count(*) FILTER (class_a <> class_b) AS conflicting FROM fx_traces GROUP BY 1"))(lambda s, d: g.proposal_sources(traces(s, d)))
    tl = lambda sql: duck("fx_trials", sql=sql)
    r.add("a34_contract_findings", tl("SELECT contract, count(*) AS n, count(*) FILTER (state = 'TIMELY_VALID_COMPLETION') AS timely, count(*) FILTER (state = 'LATE_VALID_COMPLETION') AS late, count(*) FILTER (state = 'HARD_NON_COMPLETION') AS hard, round(avg(latency_ms), 4) AS mean, round(stddev_pop(latency_ms), 4) AS stddev, round(median(latency_ms), 6) AS median, quantile_disc(latency_ms, 0.95) AS p95 FROM fx_trials GROUP BY 1"))(lambda s, d: g.contract_findings(trials(s, d)))
    r.add("a35_position_findings", tl("SELECT contract, position, count(*) AS n, count(*) FILTER (state <> 'HARD_NON_COMPLETION') AS completed FROM fx_trials GROUP BY ALL"))(lambda s, d: g.position_findings(trials(s, d)))
    block = """blocks AS (SELECT block, CASE WHEN ad IS NULL OR bd IS NULL THEN 'incomplete' WHEN ad AND bd THEN 'both' WHEN ad THEN 'only_a' WHEN bd THEN 'only_b' ELSE 'neither' END AS outcome, round(bm - am, 6) AS difference, round(CASE WHEN am <> 0 THEN (bm - am) / am * 100 END, 4) AS percent
        FROM (SELECT block, max(state <> 'HARD_NON_COMPLETION') FILTER (contract = 'A') AS ad, max(latency_ms) FILTER (contract = 'A') AS am, max(state <> 'HARD_NON_COMPLETION') FILTER (contract = 'A_PRIME') AS bd, max(latency_ms) FILTER (contract = 'A_PRIME') AS bm FROM fx_trials GROUP BY block))"""
    r.add("a36_block_comparisons", tl(f"WITH {block} SELECT * FROM blocks"))(lambda s, d: g.block_comparisons(trials(s, d)))
    r.add("a37_effect_decision", tl(f"WITH {block}, n AS (SELECT count(*) FILTER (outcome = 'only_b') AS for_b, count(*) FILTER (outcome = 'only_a') AS for_a, count(*) FILTER (outcome <> 'incomplete') AS complete FROM blocks) SELECT *, CASE WHEN complete < 10 THEN 'insufficient' WHEN for_b > 1.2 * for_a THEN 'supported' WHEN for_a > 1.2 * for_b THEN 'contradicted' ELSE 'none' END AS decision FROM n"))(lambda s, d: g.effect_decision(g.block_comparisons(trials(s, d))))
    r.add("a38_pairwise_latency", tl("SELECT count(*) AS pairs, count(*) FILTER (b.latency_ms > 1.5 * a.latency_ms) AS slower, count(*) FILTER (a.latency_ms > 1.5 * b.latency_ms) AS faster FROM fx_trials a JOIN fx_trials b ON a.block = b.block AND a.position = 1 AND b.position = 3"))(lambda s, d: g.pairwise_latency(trials(s, d)))
    audit = "SELECT * FROM {} WHERE sequence % 17 <> 0 UNION ALL SELECT * FROM {} WHERE sequence % 29 = 0"
    r.add("a39_schedule_audit", tl(f"WITH t AS ({audit.format('fx_trials', 'fx_trials')}), b AS (SELECT block, count(*) AS n, count(DISTINCT position) AS p, count(DISTINCT contract) AS c FROM t GROUP BY 1) SELECT * FROM (SELECT block, CASE WHEN p < 3 THEN 'missing' WHEN n > 3 THEN 'repeated' WHEN c < 3 THEN 'wrong_permutation' END AS issue FROM b) WHERE issue IS NOT NULL"))(lambda s, d: g.schedule_audit(s.sql(audit.format("{t}", "{t}"), t=trials(s, d))))
    r.add("a40_run_aggregate", tl("SELECT count(*) AS n, count(DISTINCT block) AS blocks, max(latency_ms) AS worst, count(*) FILTER (state = 'HARD_NON_COMPLETION') AS hard, bool_and(state <> 'HARD_NON_COMPLETION') AS clean FROM fx_trials"))(lambda s, d: g.run_aggregate(trials(s, d)))
    r.add("a41_inventory_summary", duck("fx_entries", sql="SELECT 'category' AS level, category AS key, count(*) AS n FROM fx_entries GROUP BY ALL UNION ALL SELECT 'status', status, count(*) FROM fx_entries GROUP BY ALL UNION ALL SELECT 'all', NULL, count(*) FROM fx_entries"))(lambda s, d: g.inventory_summary(view(s, d, "fx_entries")))
    bx = lambda sql: duck("fx_boxes", sql=f"WITH b AS ({BOX_DUCK}), {PAIRS} {sql}")
    r.add("a33_bounding_union", bx("SELECT case_id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM b GROUP BY 1"))(lambda s, d: g.bounding_union(boxes(s, d)))
    r.add("a32_union_area", bx(""", few AS (SELECT * FROM b), e AS (SELECT case_id, x0 AS x FROM few UNION SELECT case_id, x1 FROM few), sl AS (SELECT case_id, x, lead(x) OVER (PARTITION BY case_id ORDER BY x) AS xto FROM e),
        i AS (SELECT s.case_id, x, xto, y0, y1, max(y1) OVER (PARTITION BY s.case_id, x ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM sl s JOIN few ON few.case_id = s.case_id AND x0 <= x AND x1 >= xto WHERE xto IS NOT NULL)
        SELECT case_id, round(sum(greatest(0, y1 - greatest(y0, coalesce(upto, y0))) * (xto - x)), 9) AS area FROM i GROUP BY 1"""))(lambda s, d: sp.union_area(boxes(s, d)))  # fmt: skip
    r.add("j11_overlap_join", bx("SELECT * FROM ov"))(lambda s, d: g.overlap_join(boxes(s, d)))
    r.add("j12_best_proposal", bx(", z AS (SELECT *, round(10 * coverage + 5 * precision + 3 * iou - 0.25::DOUBLE * area, 7) AS score FROM ov) SELECT target, proposal, score, coverage >= 0.5 AS hit FROM z QUALIFY row_number() OVER (PARTITION BY target ORDER BY score DESC, proposal) = 1"))(lambda s, d: g.best_proposal(g.overlap_join(boxes(s, d), leading=g.ByScore)))
    r.add("w10_representative", bx("SELECT target, proposal, coverage FROM ov QUALIFY row_number() OVER (PARTITION BY target ORDER BY coverage DESC, area, proposal) = 1"))(lambda s, d: g.representatives(g.overlap_join(boxes(s, d), leading=g.ByCoverage)))
    r.add("a24_matching_views", bx(", o AS (SELECT case_id, proposal, max_by(target, {'c': coverage, 't': target}) AS t FROM ov GROUP BY ALL), k AS (SELECT case_id, count(DISTINCT t) AS strict_match FROM o GROUP BY 1) SELECT case_id, any_match, mean, best, strict_match FROM (SELECT case_id, count(DISTINCT target) AS any_match, round(avg(coverage), 6) AS mean, max(coverage) AS best FROM ov GROUP BY 1) JOIN k USING (case_id)"))(lambda s, d: g.matching_views(g.overlap_join(boxes(s, d))))
    r.add("x18_boxes_to_grid", bx('SELECT vec_id, "column", row FROM (SELECT vec_id, unnest(range(CAST(least(7, greatest(0, floor(x0 * 8))) AS INT), CAST(least(7, greatest(0, floor(x1 * 8))) AS INT) + 1))::INT AS "column", y0, y1 FROM b), LATERAL (SELECT unnest(range(CAST(least(5, greatest(0, floor(y0 * 6))) AS INT), CAST(least(5, greatest(0, floor(y1 * 6))) AS INT) + 1))::INT AS row)'))(lambda s, d: g.boxes_to_grid(boxes(s, d), 8, 6))
    r.add("x19_pad_regions", bx("SELECT vec_id, round(greatest(0, x0 - 0.04::DOUBLE), 9) AS x0, round(greatest(0, y0 - 0.04::DOUBLE), 9) AS y0, round(least(1, x1 + 0.04::DOUBLE), 9) AS x1, round(least(1, y1 + 0.04::DOUBLE), 9) AS y1 FROM b"))(lambda s, d: g.pad_regions(boxes(s, d)))
