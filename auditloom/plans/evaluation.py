"""Queries of the evaluation jobs, with the same in SQL."""

from __future__ import annotations

from auditloom.fixtures import duck, view
from auditloom.functions.scores import CLASSES
from auditloom.operators import evaluation as ev
from auditloom.registry import Registry

#: Conditions with their class and rank; a case has the class of its least rank.
BRAND = [
    (0, "false-certainty", "(NOT brand_present AND state <> 'NOT_OBSERVED' AND has_value) OR (brand_present AND state = 'OBSERVED' AND (ambiguous OR NOT (exact OR normalized)))"),
    (0, "correct", "(NOT brand_present AND NOT (state <> 'NOT_OBSERVED' AND has_value)) OR (brand_present AND NOT ambiguous AND (exact OR normalized) AND state <> 'AMBIGUOUS')"),
    (0, "correct-uncertainty", "brand_present AND ((ambiguous AND state IN ('AMBIGUOUS', 'LOW_CONFIDENCE')) OR (NOT ambiguous AND (exact OR normalized) AND state = 'AMBIGUOUS'))"), (0, "candidate-generation-failure", "brand_present AND ambiguous AND state = 'NOT_OBSERVED'"),
    (1, "candidate-ranking-failure", "top3"), (1, "candidate-ranking-failure", "in_candidate"), (2, "candidate-filtering-failure", "in_line"), (3, "region-coverage-failure", "(in_recovery_candidate OR in_recovery_line) AND NOT in_primary_candidate AND NOT in_primary_line"), (3, "region-coverage-failure", "in_recovery_ocr AND NOT in_primary_ocr"),
    (4, "line-reconstruction-failure", "in_ocr"), (5, "candidate-generation-failure", "state = 'NOT_OBSERVED'"), (6, "ocr-recognition-failure", "true"),
]
ALCOHOL = [
    (0, "correct", "NOT alcohol_present AND NOT detected"), (0, "correct", "alcohol_present AND detected AND parsed_ok"), (0, "false-certainty", "NOT alcohol_present AND detected"), (0, "parser-failure", "alcohol_present AND detected AND NOT parsed_ok"), (1, "parser-failure", "parser_rejected"), (2, "candidate-filtering-failure", "filter_rejected"),
    (3, "region-coverage-failure", "recovery_evidence AND NOT primary_evidence"), (4, "line-reconstruction-failure", "adjacent_evidence"), (5, "candidate-generation-failure", "same_line_evidence"), (6, "ocr-recognition-failure", "NOT number_in_ocr OR NOT marker_in_ocr"), (7, "candidate-generation-failure", "true"),
]


def _least(rules: list[tuple[int, str, str]], name: str) -> str:
    ranked = " UNION ALL ".join(f"SELECT case_id, {rank} AS rank, '{c}' AS class FROM fx_cases WHERE {where}" for rank, c, where in rules)
    return f"{name} AS (SELECT case_id, min_by(class, rank) AS {name} FROM ({ranked}) GROUP BY case_id)"


SCORES = f"WITH {_least(BRAND, 'brand_class')}, {_least(ALCOHOL, 'alcohol_class')}, scores AS (SELECT *, (state <> 'NOT_OBSERVED' AND has_value) AS seen FROM fx_cases JOIN brand_class USING (case_id) JOIN alcohol_class USING (case_id))"
SLICES = {"vertical": "orientation = 'vertical'", "rotated": "orientation = 'rotated-180'", "any_orientation": "orientation <> 'horizontal'", "english": "lang = 'en'", "none": "lang = 'xx'"}


def _share(part: str, whole: str, name: str) -> str:
    return f"CASE WHEN count(*) FILTER ({whole}) = 0 THEN 0.0::DOUBLE ELSE round(count(*) FILTER ({part}) / (count(*) FILTER ({whole}))::DOUBLE, 6) END AS {name}"


def _aggregate() -> str:
    sure, none, vague = "brand_present AND NOT ambiguous", "NOT brand_present", "brand_present AND ambiguous"
    rates = [
        (f"{sure} AND exact", sure, "exact_rate"), (f"{sure} AND normalized", sure, "normalized_rate"), (f"{sure} AND top3", sure, "top3_recall"), (f"{sure} AND top5", sure, "top5_recall"),
        (f"{sure} AND brand_class = 'correct'", sure, "confident_correct_rate"), (f"{sure} AND top5 AND brand_class <> 'correct'", sure, "deferred_rate"), (f"{sure} AND brand_class = 'correct-uncertainty'", sure, "needless_ambiguity_rate"),
        (f"{sure} AND brand_class = 'false-certainty'", sure, "false_certainty_rate"), (f"{sure} AND NOT seen", sure, "abstention_rate"), (f"{none} AND NOT seen", none, "correct_abstention_rate"), (f"{none} AND seen", none, "absent_brand_false_positives"),
        ("alcohol_present AND detected", "alcohol_present", "alcohol_recall"), ("alcohol_present AND parsed_ok", "alcohol_present", "alcohol_accuracy"), ("alcohol_present AND alcohol_class = 'parser-failure'", "alcohol_present", "parser_failure_rate"),
        ("NOT alcohol_present AND detected", "NOT alcohol_present", "absent_alcohol_false_positives"), ("alcohol_class = 'false-certainty'", "true", "alcohol_false_certainty_rate"), (f"{vague} AND brand_class IN ('correct', 'correct-uncertainty')", vague, "ambiguity_honesty"),
    ]
    counts = [f"count(*) FILTER ({c}) AS {n}" for c, n in ((sure, "determinate_brands"), (none, "absent_brands"), (vague, "ambiguous_brands"), ("alcohol_present", "present_alcohols"), ("NOT alcohol_present", "absent_alcohols"))]
    classes = [f"count(*) FILTER ({f}_class = '{c}') AS {f}_{c.replace('-', '_')}" for f in ("brand", "alcohol") for c in CLASSES]
    return f"{SCORES} SELECT lang, count(*) AS cases, {', '.join(counts)}, {', '.join(_share(*r) for r in rates)}, quantile_disc(latency_ms, 0.5) AS median_latency, quantile_disc(latency_ms, 0.95) AS p95_latency, {', '.join(classes)} FROM scores GROUP BY lang"


def register(r: Registry) -> None:
    scores = lambda s, d: ev.classify_failures(view(s, d, "fx_cases"))
    r.add("a1_eval_aggregate", duck("fx_cases", sql=_aggregate()))(lambda s, d: ev.eval_aggregate(scores(s, d), ["lang"]))
    r.add("a2_classify_failures", duck("fx_cases", sql=f"{SCORES} SELECT case_id, brand_class, alcohol_class FROM scores"))(lambda s, d: scores(s, d).select("case_id", "brand_class", "alcohol_class"))
    one = " UNION ALL ".join(f"SELECT '{k}' AS slice, count(*) AS cases, count(*) FILTER (detected) AS detected, count(*) FILTER (parsed_ok) AS accurate, {_share('detected', 'true', 'recall')}, {_share('parsed_ok', 'true', 'accuracy')} FROM fx_cases WHERE alcohol_present AND {c}" for k, c in SLICES.items())
    r.add("a3_slice_metrics", duck("fx_cases", sql=one))(lambda s, d: ev.slice_metrics(scores(s, d), SLICES))
    buckets = "(VALUES " + ", ".join(f"('{b}')" for b in ("ocr-recognition", "region-coverage", "orientation", "line-reconstruction", "candidate-generation", "candidate-filtering", "candidate-ranking", "parser", "unnecessary-ambiguity", "false-certainty", "correct-uncertainty", "correct-result")) + ") b(bucket)"
    r.add("a4_failure_distribution", duck("fx_cases", sql=f"""{SCORES}, tall AS (SELECT brand_class AS c, ambiguous AS a, orientation FROM scores UNION ALL SELECT alcohol_class, false, orientation FROM scores),
        named AS (SELECT CASE WHEN c = 'correct' THEN 'correct-result' WHEN c = 'correct-uncertainty' AND a THEN c WHEN c = 'correct-uncertainty' THEN 'unnecessary-ambiguity' WHEN c = 'region-coverage-failure' AND orientation <> 'horizontal' THEN 'orientation' ELSE replace(c, '-failure', '') END AS bucket FROM tall)
        SELECT b.bucket, count(n.bucket) AS n FROM {buckets} LEFT JOIN named n USING (bucket) GROUP BY b.bucket"""))(lambda s, d: ev.failure_distribution(scores(s, d)))  # fmt: skip
    r.add("a5_filter_subtypes", duck("fx_candidates", sql="SELECT field, reason AS subtype, count(*) AS n FROM fx_candidates WHERE NOT kept GROUP BY ALL"))(lambda s, d: ev.filter_subtypes(view(s, d, "fx_candidates")))
    r.add("a6_subtype_coverage", duck("fx_candidates", sql="SELECT field, count(*) AS filtered, count(reason) AS with_reason, count(*) AS in_buckets, count(*) = count(reason) AS agrees FROM fx_candidates WHERE NOT kept GROUP BY field"))(lambda s, d: ev.subtype_coverage(view(s, d, "fx_candidates")))
    r.add("a7_calibration_coverage", duck("fx_candidates", sql="SELECT coalesce(field, 'total') AS field, count(*) AS records, count(*) FILTER (selected) AS selected, count(*) FILTER (NOT selected) AS not_selected, count(*) FILTER (NOT kept) AS rejected, count(raw_confidence) AS with_confidence, count(*) - count(raw_confidence) AS without_confidence FROM fx_candidates GROUP BY ROLLUP (field)"))(lambda s, d: ev.calibration_coverage(view(s, d, "fx_candidates")))
    truth = "SELECT o_orderkey AS case_id, CAST(o_custkey % 97 AS {}) AS value FROM {}"
    r.add("a8_calibration_records", duck("fx_candidates", sql=f"WITH truth AS ({truth.format('VARCHAR', 'orders')}) SELECT c.case_id, field, candidate_id, priority, score, coalesce(raw_confidence, 0) / 100.0::DOUBLE AS confidence, raw_confidence IS NULL AS no_confidence, selected, coalesce(c.value = t.value, false) AS correct FROM fx_candidates c LEFT JOIN truth t USING (case_id)"))(
        lambda s, d: ev.calibration_records(view(s, d, "fx_candidates"), s.sql(truth.format("STRING", "{orders}"), orders=view(s, d, "orders")))
    )
    flags = ", ".join(f"count(*) FILTER ({f}) AS {f}" for f in ("new_tokens", "new_evidence", "accepted", "changed", "correct", "no_value"))
    r.add("a9_pass_contributions", duck("fx_passes", sql=f"WITH p AS (SELECT *, sum(execution_ms) OVER (PARTITION BY case_id ORDER BY pass_order) AS cost FROM fx_passes) SELECT pass_kind, count(*) AS passes, count(DISTINCT case_id) AS cases, {flags}, CAST(sum(execution_ms) AS BIGINT) AS total_ms, CAST(max(cost) AS BIGINT) AS max_cumulative_ms FROM p GROUP BY pass_kind"))(lambda s, d: ev.pass_contributions(view(s, d, "fx_passes")))
    r.add("a10_performance_breakdown", duck("fx_passes", sql="""WITH c AS (SELECT case_id, count(*) AS passes, CAST(sum(execution_ms) AS BIGINT) AS ms, count(*) FILTER (no_value) AS useless, count(*) FILTER (correct) AS recovered FROM fx_passes GROUP BY case_id)
        SELECT quantile_disc(passes, 0.5) AS median_passes, quantile_disc(passes, 0.95) AS p95_passes, count(*) FILTER (passes > 1) AS extra_cases, round(count(*) FILTER (passes > 1) / count(*)::DOUBLE, 6) AS extra_rate, quantile_disc(ms, 0.5) AS median_ms, quantile_disc(ms, 0.95) AS p95_ms,
          CAST(sum(useless) AS BIGINT) AS useless_passes, CASE WHEN sum(recovered) = 0 THEN 0.0::DOUBLE ELSE round(sum(ms) / sum(recovered)::DOUBLE, 6) END AS cost_per_recovered FROM c"""))(lambda s, d: ev.performance_breakdown(view(s, d, "fx_passes")))  # fmt: skip
    r.add("a42_diagnosis_tallies", duck("fx_cases", sql="SELECT 'size' AS dimension, CASE WHEN n_chars < 200 THEN 'short' WHEN n_chars < 2000 THEN 'medium' ELSE 'long' END AS bucket, count(*) AS n FROM fx_cases GROUP BY ALL UNION ALL SELECT 'state', state, count(*) FROM fx_cases GROUP BY ALL UNION ALL SELECT 'orientation', orientation, count(*) FROM fx_cases GROUP BY ALL"))(lambda s, d: ev.diagnosis_tallies(view(s, d, "fx_cases")))
    r.add("a43_build_metrics", duck("fx_cases", sql=f"{SCORES}, s AS (SELECT list(latency_ms ORDER BY latency_ms) AS l FROM scores) SELECT count(*) AS cases, count(*) FILTER (brand_class = 'correct') AS brand_correct, count(*) FILTER (alcohol_class = 'correct') AS alcohol_correct, {_share('brand_class = ' + repr('false-certainty'), 'true', 'brand_false_certainty')}, (SELECT l[CAST(least(floor(len(l) * 0.5), len(l) - 1) AS INT) + 1] FROM s) AS p50_floor, (SELECT l[CAST(least(floor(len(l) * 0.95), len(l) - 1) AS INT) + 1] FROM s) AS p95_floor FROM scores"))(lambda s, d: ev.build_metrics(scores(s, d)))
