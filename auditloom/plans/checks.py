"""Queries of the further checks and joins, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditloom.fixtures import duck, view
from auditloom.functions import vocabulary as vc
from auditloom.operators import checks as ck
from auditloom.operators import grids as g
from auditloom.operators import manifests as mf
from auditloom.operators import spatial as sp
from auditloom.plans.extraction import LINED, WORDS
from auditloom.plans.grids import BOX, BOX_DUCK, PAIRS
from auditloom.registry import Registry

#: Words of 16 to 32 pixels on a page of 1600 by 1600, from vectors.
WORD_BOX = "SELECT id, case_id, x0, y0, x0 + w AS x1, y0 + h AS y1 FROM (SELECT vec_id AS id, case_id, (CAST(e0 AS DOUBLE) + 1) * 800 AS x0, (CAST(e1 AS DOUBLE) + 1) * 800 AS y0, 20 + (CAST(e2 AS DOUBLE) + 1) * 20 AS w, 4 + (CAST(e3 AS DOUBLE) + 1) * 20 AS h FROM {})"
FIND = "SELECT l_orderkey * 10 + l_linenumber AS finding_id, CASE l_partkey % 3 WHEN 0 THEN 'executed' WHEN 1 THEN 'not_run_external_dependency' ELSE 'not_run_insufficient_evidence' END AS execution, CASE l_suppkey % 4 WHEN 0 THEN 'PASS' WHEN 1 THEN 'FAIL' WHEN 2 THEN 'not_run' ELSE 'NEEDS_REVIEW' END AS finding FROM {}"
RES = "SELECT l_orderkey AS case_id, l_linenumber AS position, min(CASE WHEN l_partkey % 11 = 0 THEN 'other' ELSE concat('rule', {c}) END) AS rule FROM {t} GROUP BY l_orderkey, l_linenumber"
STORE = "SELECT l_orderkey * 10 + l_linenumber AS id, concat(CASE WHEN l_partkey % 13 = 0 THEN 'old-' ELSE 'rev-' END, {c}, '/', md5({k}), CASE WHEN l_suppkey % 17 = 0 THEN 'x' ELSE '' END) AS storage_key, l_linenumber AS revision, md5({k}) AS checksum FROM {t}"
META = "SELECT p_partkey AS id, p_size AS bytes, p_type AS kind, p_brand AS checksum FROM {}"
ARTS = "SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN p_size + 1 ELSE p_size END AS bytes, CASE WHEN p_partkey % 7 = 0 THEN 'X' ELSE p_type END AS kind, p_brand AS checksum FROM {} WHERE p_partkey % 11 <> 0"
PRINTS = "SELECT s_suppkey AS run_id, s_nationkey % 3 AS a, s_nationkey % 5 AS b, CASE WHEN s_suppkey % 4 > 0 THEN s_suppkey % 2 END AS c FROM {}"
CODES = "SELECT l_orderkey AS case_id, l_linenumber AS repetition, l_returnflag AS code FROM {}"
CAUSE = "SELECT case_id, kept, score, candidate_id, candidate_id % 5 = 0 AS holds, candidate_id % 7 = 0 AS partial, reason FROM {}"
SEEN = "SELECT o_orderkey + 3 AS case_id, o_custkey % 2 = 0 AS holds FROM {}"
#: Fixtures of orders, and what each rule finds there.
FIXTURES = """SELECT CASE WHEN o_orderkey % 53 = 0 THEN o_orderkey - 1 ELSE o_orderkey END AS id, CASE o_orderkey % 5 WHEN 0 THEN 'candidate' WHEN 1 THEN 'wine_multi_artifact_candidate' WHEN 2 THEN 'category_sentinel' ELSE 'baseline' END AS role, CASE WHEN o_orderkey % 7 = 0 THEN 'beer' ELSE 'wine' END AS category, CASE WHEN o_orderkey % 11 < 2 THEN 'beer' END AS sentinel_category,
  CASE WHEN o_orderkey % 13 = 0 THEN 'unavailable' ELSE 'available' END AS availability, CASE WHEN o_orderkey % 26 = 0 OR o_orderkey % 17 = 0 THEN 'lost' END AS unavailable_reason, o_orderkey % 9 = 0 AS synthetic, CASE WHEN o_orderkey % 18 = 0 OR o_orderkey % 19 = 0 THEN 'lines' END AS evidence, o_orderkey % 4 = 0 AS from_picture, CASE WHEN o_orderkey % 23 <> 0 THEN 'dir' END AS directory,
  CASE WHEN o_orderkey % 6 <> 0 THEN concat('i', CAST(o_orderkey - CASE WHEN o_orderkey % 29 = 0 THEN 1 ELSE 0 END AS VARCHAR)) END AS image, CASE WHEN o_orderkey % 8 = 0 THEN 'm' END AS manifest, CASE WHEN o_orderkey % 3 = 0 THEN 'known' END AS expectations, CASE WHEN o_orderkey % 31 = 0 THEN o_orderkey WHEN o_orderkey % 37 = 0 THEN -1 WHEN o_orderkey % 41 = 0 THEN 1 END AS derived_from,
  CASE WHEN o_orderkey % 5 < 3 THEN 'shop' END AS source_stratum, CASE WHEN o_orderkey % 5 < 3 THEN 'own' END AS independence, CASE WHEN o_orderkey % 5 < 3 AND o_orderkey % 43 <> 0 THEN 'yes' END AS eligibility, CASE WHEN o_orderkey % 5 < 3 THEN CASE WHEN o_orderkey % 47 = 0 THEN 'done' ELSE 'unannotated' END END AS annotation, CASE WHEN o_orderkey % 5 < 3 THEN CASE WHEN o_orderkey % 59 = 0 THEN 'test' ELSE 'unassigned' END END AS split,
  CASE WHEN o_orderkey % 5 < 3 OR o_orderkey % 61 = 0 THEN 'day' END AS acquired_on, CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 67 = 0 THEN 'red' END AS colour, CASE WHEN o_orderkey % 5 = 0 THEN 'one' END AS multi_panel, CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 71 <> 0 THEN 'no' END AS decimal_comma FROM {}"""
_INVENTORY = "role <> 'baseline' AND "
FIXTURE_RULES = {
    "repeated_id": "nth_id > 1", "repeated_image": "image IS NOT NULL AND directory IS NOT NULL AND nth_path > 1", "reason_missing": "availability = 'unavailable' AND unavailable_reason IS NULL", "unavailable_real": "availability = 'unavailable' AND from_picture", "unavailable_assets": "availability = 'unavailable' AND (image IS NOT NULL OR manifest IS NOT NULL)", "reason_of_available": "availability = 'available' AND unavailable_reason IS NOT NULL",
    "synthetic_assets": "synthetic AND (image IS NOT NULL OR manifest IS NOT NULL)", "synthetic_real": "synthetic AND from_picture", "evidence_missing": "synthetic AND evidence IS NULL", "evidence_of_real": "NOT synthetic AND evidence IS NOT NULL", "real_incomplete": "from_picture AND (image IS NULL OR manifest IS NULL OR directory IS NULL)", "sentinel_wine": "role = 'category_sentinel' AND category = 'wine'",
    "sentinel_unnamed": "role = 'category_sentinel' AND sentinel_category IS NULL", "sentinel_differs": "role = 'category_sentinel' AND sentinel_category <> category", "category": "role <> 'category_sentinel' AND category <> 'wine'", "sentinel_of_other": "role <> 'category_sentinel' AND sentinel_category IS NOT NULL", "inventory_expectations": f"{_INVENTORY}expectations IS NOT NULL", "inventory_annotated": f"{_INVENTORY}annotation <> 'unannotated'",
    "inventory_assigned": f"{_INVENTORY}split <> 'unassigned'", "inventory_real": f"{_INVENTORY}from_picture", "inventory_synthetic": f"{_INVENTORY}(synthetic OR evidence IS NOT NULL)", "inventory_unavailable": f"{_INVENTORY}availability = 'unavailable'", "inventory_image": f"{_INVENTORY}(image IS NULL OR directory IS NULL)", "inventory_manifest": f"{_INVENTORY}manifest IS NOT NULL", "inventory_fields": f"{_INVENTORY}eligibility IS NULL",
    "wine_fields": "role = 'candidate' AND decimal_comma IS NULL", "wine_fields_of_other": f"{_INVENTORY}role <> 'candidate' AND colour IS NOT NULL", "expectations_missing": "role = 'baseline' AND expectations IS NULL", "inventory_fields_of_other": "role = 'baseline' AND (acquired_on IS NOT NULL OR colour IS NOT NULL)", "parent_unknown": "derived_from IS NOT NULL AND derived_from NOT IN (SELECT id FROM f)", "parent_itself": "derived_from = id",
}
#: Records of documents, and what each rule finds there.
RECORDS = """SELECT doc_id AS case_id, concat('p', CAST(doc_id - CASE WHEN doc_id % 31 = 0 AND doc_id > 0 THEN 1 ELSE 0 END AS VARCHAR), CASE WHEN doc_id % 2 = 0 THEN '.png' ELSE '.jpg' END) AS path, CASE WHEN doc_id % 2 = 0 OR doc_id % 17 = 0 THEN 'image/png' ELSE 'image/jpeg' END AS media_type, doc_id % 3 AS wide, 1 AS high,
  CASE WHEN doc_id % 13 = 0 THEN 'unknown' WHEN doc_id % 11 = 0 THEN 'square' ELSE CASE doc_id % 3 WHEN 0 THEN 'portrait' WHEN 1 THEN 'square' ELSE 'landscape' END END AS orientation, md5(CAST(doc_id % 97 AS VARCHAR)) AS sha256, CASE WHEN doc_id % 19 = 0 THEN 'usage-or-provenance-concern' ELSE 'fine' END AS usage,
  CASE doc_id % 8 WHEN 0 THEN 'excluded_usage_or_provenance_concern' WHEN 1 THEN 'excluded_uncertain_truth' WHEN 2 THEN 'excluded_unreadable' WHEN 3 THEN 'excluded_outside_current_scope' WHEN 4 THEN 'excluded_other' ELSE 'included' END AS status, CASE doc_id % 5 WHEN 0 THEN {array}('other') WHEN 1 THEN {array}('uncertain-usage-provenance') WHEN 2 THEN {array}('illegible-alcohol-text', 'other') WHEN 3 THEN {array}('unclear-crop-or-wraparound-context') ELSE {array}('small') END AS reasons,
  CASE doc_id % 7 WHEN 0 THEN {array}('out-of-scope-category') WHEN 1 THEN {array}('genuinely-ambiguous') WHEN 2 THEN {array}('missing-alcohol-statement') ELSE {array}('plain') END AS strata, CASE WHEN doc_id % 23 = 0 OR doc_id % 16 = 3 THEN 'beer' ELSE 'wine' END AS category, doc_id % 6 = 1 AS ambiguous, CASE WHEN doc_id % 10 = 2 THEN 'absent' ELSE 'present' END AS alcohol, 5 AS annotated_on, doc_id % 9 + 1 AS reviewed_on FROM {}"""
_HAS = lambda *values: " OR ".join(f"list_contains(reasons, '{v}')" for v in values)
RECORD_RULES = {
    "repeated_path": "nth_path > 1", "included_twice": "status = 'included' AND nth_digest > 1", "media_type": "(suffix(path, '.png') AND media_type = 'image/jpeg') OR (suffix(path, '.jpg') AND media_type = 'image/png')", "orientation": "orientation <> 'unknown' AND orientation <> CASE wide WHEN 0 THEN 'portrait' WHEN 1 THEN 'square' ELSE 'landscape' END", "usage": "(usage <> 'fine') <> (status = 'excluded_usage_or_provenance_concern')", "included_uncertain": f"status = 'included' AND ({_HAS('uncertain-usage-provenance')})", "not_wine": "status = 'included' AND category <> 'wine'",
    "scope": "status = 'excluded_outside_current_scope' AND (category = 'wine' OR NOT list_contains(strata, 'out-of-scope-category'))", "ambiguous": "status = 'included' AND ambiguous <> list_contains(strata, 'genuinely-ambiguous')", "alcohol": "status = 'included' AND (alcohol = 'absent') <> list_contains(strata, 'missing-alcohol-statement')", "reviewed_early": "status = 'included' AND reviewed_on < 5",
    "unstated_excluded_usage_or_provenance_concern": f"status = 'excluded_usage_or_provenance_concern' AND NOT ({_HAS('uncertain-usage-provenance')})", "unstated_excluded_uncertain_truth": f"status = 'excluded_uncertain_truth' AND NOT ({_HAS('uncertain-brand-identity', 'illegible-alcohol-text', 'conflicting-front-back-presentations', 'unclear-crop-or-wraparound-context', 'other')})",
    "unstated_excluded_unreadable": f"status = 'excluded_unreadable' AND NOT ({_HAS('illegible-alcohol-text', 'uncertain-brand-identity', 'other')})", "unstated_excluded_other": f"status = 'excluded_other' AND NOT ({_HAS('other')})",
}
#: Components of pictures of 800 x 600.
PARTS = "SELECT l_orderkey AS case_id, l_linenumber AS component, CAST(max(l_quantity) AS INT) % 9 + 1 AS words, CAST(l_linenumber * 90 + max(l_partkey) % 60 AS DOUBLE) AS x, CAST(max(l_suppkey) % 40 * 9 AS DOUBLE) AS y, CAST(100 + max(l_partkey) % 7 * 60 AS DOUBLE) AS width, CAST(60 + max(l_suppkey) % 6 * 60 AS DOUBLE) AS height FROM {} GROUP BY l_orderkey, l_linenumber"
#: Regions, with their reason and source, and the classes that they get.
REGIONS = [
    ("Bottled by Oak Hill", "producer-line", None, "producer_name_address:100 brand_bearing_display:45"), ("acme.wine", "domain-like", "ocr_pass_region", "domain:100 artifact:80 brand_bearing_display:55"), ("Pinot Noir 2019", "varietal-or-designation", None, "class_type:100 vintage:75 appellation:45"), ("Napa Valley", "location-or-appellation", None, "appellation:100 class_type:55"),
    ("13% by vol", "statement", None, "alcohol_statement:95 mandatory_disclosure:70"), ("Net contents 750 ml", "non-brand-keyword", None, "net_contents:85 mandatory_disclosure:80 unknown_text_region:45"), ("", None, None, "unknown_non_text_region:50"), ("Hello", None, None, "unknown_text_region:50"),
    ("Golden Fork", "candidate-plausible", "recovery_crop", "unknown_panel:80 brand_bearing_display:75 decorative_script:55 conflicting_classification:40 unknown_text_region:35"), ("GOVERNMENT WARNING: according to the surgeon general, women should not", None, None, "government_warning:100 mandatory_disclosure:85 decorative_prose:70"),
]


def nearest(docs):
    """The span nearest to the first three words of each text, letters alone, from the ninth word on."""
    words = F.transform(F.split(F.trim("text"), r"\s+"), lambda w: F.regexp_replace(w, "[^a-zA-Z]", ""))
    plain = docs.select(F.col("doc_id").alias("case_id"), words.alias("words")).filter(F.size("words") >= 3)
    return ck.nearest_span(plain.withColumn("truth", F.array_join(F.slice("words", 1, 3), " ")), start=8)


def expecting(docs):
    """The words of each text from the fourth on; its first three words, and the three from the fourth on run together, are expected."""
    w = docs.select(F.col("doc_id").alias("case_id"), F.split(F.trim("text"), r"\s+").alias("w"))
    joined = F.when(F.size("w") >= 6, F.array(F.array_join(F.slice("w", 4, 3), ""))).otherwise(F.array().cast("array<string>"))
    return w.select("case_id", F.slice("w", 4, 1 << 30).alias("words"), F.concat(F.slice("w", 1, 3), joined).alias("expected"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region for each part, by turns of REGIONS."""
    turn = lambda k: F.element_at(F.array(*[F.lit(x[k]).cast("string") for x in REGIONS]), (F.col("p_partkey") % len(REGIONS) + 1).cast("int"))
    return view(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), turn(0).alias("text"), turn(1).alias("reason"), turn(2).alias("source"))


def register(r: Registry) -> None:
    boxes = lambda s, d: s.sql(BOX.format("{b}").replace("0.3", "0.3D").replace("0.05", "0.05D").replace("0.1 AS", "0.1D AS"), b=view(s, d, "fx_boxes"))
    bx = lambda sql: duck("fx_boxes", sql=f"WITH b AS ({BOX_DUCK}), {PAIRS} {sql}")
    legal = ", ".join(f"('{a}', '{b}')" for a, b in ck.LEGAL)
    r.add("v8_finding_issues", f"WITH f AS ({FIND.format('lineitem')}) SELECT * FROM f WHERE (execution, finding) NOT IN ({legal})")(lambda s, d: ck.illegal_pairs(s.sql(FIND.format("{l}"), l=view(s, d, "lineitem")), ["finding_id"], ("execution", "finding"), ck.LEGAL))
    r.add("v12_accepted_scores", "SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_quantity < 10 THEN 'l_quantity' WHEN l_discount < 0.02 THEN 'l_discount' WHEN l_tax < 0.01 THEN 'l_tax' END AS short_of, NOT (l_quantity < 10 OR l_discount < 0.02 OR l_tax < 0.01) AS accepted FROM lineitem")(
        lambda s, d: ck.accepted_scores(view(s, d, "lineitem"), {"l_quantity": 10, "l_discount": 0.02, "l_tax": 0.01}).select(F.expr("l_orderkey * 10 + l_linenumber").alias("id"), "short_of", "accepted")
    )
    known = f"f AS ({FIXTURES.format('orders')}), e AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY role, image NULLS FIRST, manifest NULLS FIRST, derived_from NULLS FIRST) AS nth_id, row_number() OVER (PARTITION BY directory, image ORDER BY id, role, manifest NULLS FIRST, derived_from NULLS FIRST) AS nth_path FROM f)"
    r.add("v6_corpus_issues", f"WITH {known} " + " UNION ALL ".join(f"SELECT id, '{k}' AS issue FROM e WHERE {c}" for k, c in FIXTURE_RULES.items()))(lambda s, d: mf.corpus_issues(s.sql(FIXTURES.replace("VARCHAR", "STRING").format("{o}"), o=view(s, d, "orders"))))
    told = f"r AS ({RECORDS.replace('{array}', 'list_value').format('documents')}), x AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY case_id) AS nth_path, row_number() OVER (PARTITION BY sha256, status ORDER BY case_id) AS nth_digest FROM r)"
    r.add("v7_eval_manifest_issues", f"WITH {told} " + " UNION ALL ".join(f"SELECT case_id, '{k}' AS issue FROM x WHERE {c}" for k, c in RECORD_RULES.items()))(lambda s, d: mf.eval_manifest_issues(s.sql(RECORDS.replace("{array}", "array").replace("VARCHAR", "STRING").format("{d}"), d=view(s, d, "documents"))))
    r.add("v15_region_issues", bx("SELECT * FROM (SELECT vec_id, CASE WHEN case_id >= 7 THEN 'no_panel' WHEN vec_id % 6 <> 0 AND vec_id % 3 = 1 AND case_id % 2 = 0 THEN 'category' WHEN x0 < 0 OR y0 < 0 OR x1 > 1 OR y1 > 1 THEN 'outside' END AS issue FROM b) WHERE issue IS NOT NULL"))(
        lambda s, d: ck.region_issues(boxes(s, d).withColumn("category", F.concat(F.lit("c"), (F.col("vec_id") % 3).cast("string"))), boxes(s, d).filter("case_id < 7").select("case_id", F.explode(F.when(F.col("case_id") % 2 == 0, F.array(F.lit("c0"), F.lit("c2"))).otherwise(F.array(F.lit("c0"), F.lit("c1"), F.lit("c2")))).alias("category")))
    )
    child = "side = 'child' AND role IN ('A', 'N')"
    r.add("v16_preparation_complete", duck("fx_panels", sql=f"WITH p AS (SELECT *, substr(checksum, 1, 1) < '8' AS early FROM fx_panels) SELECT submission_id, count(DISTINCT role) FILTER ({child}) AS roles, count(DISTINCT role || early) FILTER ({child}) AS filled, count(DISTINCT role) FILTER ({child}) = 2 AND count(DISTINCT role || early) FILTER ({child}) = 4 AS complete FROM p GROUP BY 1"))(
        lambda s, d: ck.preparation_complete(view(s, d, "fx_panels").withColumn("category", F.when(F.substring("checksum", 1, 1) < "8", "early").otherwise("late")), ["A", "N"], ["early", "late"])
    )
    lint = "SELECT CAST(p_partkey - CASE WHEN p_partkey % 19 = 0 THEN 1 ELSE 0 END AS BIGINT) AS id, p_name AS name, concat(p_name, ' ', {}) AS title, CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN 'odd' ELSE 'open' END AS status FROM {}"
    titled = "CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE CAST(p_partkey AS {}) END"
    r.add("v19_record_set_lint", f"WITH x AS ({lint.format(titled.format('VARCHAR'), 'part')}), y AS (SELECT *, count(*) OVER (PARTITION BY name) AS n, count(*) OVER (PARTITION BY id) AS m FROM x) SELECT id, 'id_not_in_title' AS issue FROM y WHERE NOT contains(title, CAST(id AS VARCHAR)) UNION ALL SELECT id, 'repeated_name' FROM y WHERE n > 1 UNION ALL SELECT id, 'repeated_id' FROM y WHERE m > 1 UNION ALL SELECT id, 'no_status' FROM y WHERE status IS NULL UNION ALL SELECT id, 'unknown_status' FROM y WHERE status = 'odd'")(
        lambda s, d: ck.record_set_lint(s.sql(lint.format(titled.format("STRING"), "{p}"), p=view(s, d, "part")), ["open", "closed"])
    )
    keys = lambda t, c: STORE.format(c=f"CAST(l_linenumber AS {t})", k=f"CAST(l_partkey AS {t})", t=c)
    r.add("v20_panel_identity_issues", f"WITH x AS ({keys('VARCHAR', 'lineitem')}) SELECT id, CASE WHEN NOT prefix(storage_key, 'rev-' || revision || '/') THEN 'prefix' ELSE 'checksum' END AS issue FROM x WHERE NOT prefix(storage_key, 'rev-' || revision || '/') OR NOT suffix(storage_key, checksum)")(lambda s, d: ck.panel_identity_issues(s.sql(keys("STRING", "{l}"), l=view(s, d, "lineitem"))))
    r.add("v22_panel_metadata_issues", f"WITH p AS ({META.format('part')}), a AS ({ARTS.format('part')}), x AS (SELECT p.id, CASE WHEN a.id IS NULL THEN 'absent' WHEN p.bytes <> a.bytes THEN 'bytes' WHEN p.kind <> a.kind THEN 'kind' WHEN p.checksum <> a.checksum THEN 'checksum' END AS issue FROM p LEFT JOIN a ON a.id = p.id) SELECT * FROM x WHERE issue IS NOT NULL")(lambda s, d: ck.panel_metadata_issues(s.sql(META.format("{p}"), p=view(s, d, "part")), s.sql(ARTS.format("{p}"), p=view(s, d, "part"))))
    names = [f"rule{i}" for i in range(1, 6)]
    res = lambda t, c: RES.format(c=f"CAST(l_linenumber AS {t})", t=c)
    r.add("v23_result_issues", f"""WITH f AS ({res('VARCHAR', 'lineitem')}), w AS (SELECT i AS position, 'rule' || i AS want FROM range(1, 6) t(i)), grid AS (SELECT case_id, position, want FROM (SELECT DISTINCT case_id FROM f), w),
        x AS (SELECT coalesce(g.case_id, f.case_id) AS case_id, CAST(coalesce(g.position, f.position) AS INT) AS position, CASE WHEN rule IS NULL THEN 'missing' WHEN want IS NULL THEN 'extra' WHEN rule <> want THEN 'wrong_rule' END AS issue FROM grid g FULL JOIN f ON f.case_id = g.case_id AND f.position = g.position) SELECT * FROM x WHERE issue IS NOT NULL""")(
        lambda s, d: ck.result_issues(s.sql(res("STRING", "{l}"), l=view(s, d, "lineitem")), names)
    )
    r.add("v24_support_gates", duck("fx_trials", sql="WITH g AS (SELECT count(*) AS n, count(DISTINCT block) AS blocks, count(*) FILTER (state = 'HARD_NON_COMPLETION') AS hard, max(latency_ms) AS worst FROM fx_trials) SELECT *, CASE WHEN n < 100 THEN 'too_few' WHEN hard * 4 > n THEN 'unstable' WHEN worst > 1000 THEN 'too_slow' ELSE 'supported' END AS decision FROM g"))(lambda s, d: ck.support_gates(view(s, d, "fx_trials")))
    r.add("j13_region_coverage", bx(""", t AS (SELECT vec_id AS target, * FROM b WHERE role = 'target'), p AS (SELECT * FROM b WHERE role = 'proposal'), c AS (SELECT target, bool_or(greatest(0, least(t.x1, p.x1) - greatest(t.x0, p.x0)) * greatest(0, least(t.y1, p.y1) - greatest(t.y0, p.y0)) >= 0.9::DOUBLE * (t.x1 - t.x0) * (t.y1 - t.y0)) AS covered FROM t JOIN p USING (case_id) GROUP BY 1),
        w AS (SELECT target, count(*) AS n FROM t JOIN p ON p.case_id = t.case_id AND p.vec_id % 2 = 0 AND (p.x0 + p.x1) / 2 BETWEEN t.x0 AND t.x1 AND (p.y0 + p.y1) / 2 BETWEEN t.y0 AND t.y1 GROUP BY 1)
        SELECT t.target, coalesce(covered, false) AS covered, coalesce(n, 0) AS words, CASE WHEN covered AND n > 0 THEN 'read' WHEN covered THEN 'covered_unread' WHEN n > 0 THEN 'partly' ELSE 'missed' END AS category FROM t LEFT JOIN c USING (target) LEFT JOIN w USING (target)"""))(
        lambda s, d: ck.region_coverage(boxes(s, d).filter("role = 'target'").withColumnRenamed("vec_id", "target"), boxes(s, d).filter("role = 'proposal'"), boxes(s, d).filter("role = 'proposal' AND vec_id % 2 = 0"))
    )
    r.add("j14_containment_join", """WITH h AS (SELECT p_partkey AS id, s.n_nationkey AS pid, CASE WHEN contains(p_name, ph) THEN 2000 - abs(length(p_name) - length(ph)) ELSE 1000 - abs(length(p_name) - length(ph)) END AS score FROM part JOIN (SELECT n_nationkey, ['red', 'blue widget', 'ring', 'small ring x', 'green', 'bolt'][n_nationkey % 6 + 1] AS ph FROM nation) s ON contains(p_name, ph) OR contains(ph, p_name))
        SELECT id, pid, CAST(score AS BIGINT) AS score FROM h QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, pid) = 1""")(
        lambda s, d: ck.containment_join(view(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text")), view(s, d, "nation").select(F.col("n_nationkey").alias("pid"), F.element_at(F.array(*map(F.lit, ["red", "blue widget", "ring", "small ring x", "green", "bolt"])), F.col("n_nationkey") % 6 + 1).alias("phrase")))
    )
    r.add("j15_failure_cause", duck("fx_candidates", sql=f"WITH c AS ({CAUSE.format('fx_candidates')}), t AS (SELECT *, CASE WHEN holds AND NOT kept THEN 4 WHEN holds THEN 3 WHEN partial THEN 2 ELSE 0 END AS tier FROM c), b AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY tier DESC, score DESC, candidate_id DESC, reason DESC) = 1), l AS (SELECT case_id, bool_or(holds) AS line FROM ({SEEN.format('orders')}) GROUP BY 1) SELECT coalesce(b.case_id, l.case_id) AS case_id, CASE WHEN tier = 4 THEN 'rejected:' || reason WHEN tier = 3 THEN 'over_extended' WHEN tier = 2 THEN 'partial' WHEN line THEN 'line_only' ELSE 'not_seen' END AS cause, CASE WHEN tier > 0 THEN candidate_id END AS candidate_id FROM b FULL JOIN l ON l.case_id = b.case_id"))(
        lambda s, d: ck.failure_cause(s.sql(CAUSE.format("{c}"), c=view(s, d, "fx_candidates")), s.sql(SEEN.format("{o}"), o=view(s, d, "orders")))
    )
    tops = "SELECT case_id, text AS token FROM {} WHERE line = 0 AND ix < 3"
    r.add("j17_nearest_span", f"""WITH {WORDS}, {LINED}, k AS (SELECT case_id, ix, regexp_replace(text, '[^a-zA-Z]', '', 'g') AS text FROM lined), v AS (SELECT *, lead(text) OVER w AS t1, lead(text, 2) OVER w AS t2, lead(text, 3) OVER w AS t3 FROM k WINDOW w AS (PARTITION BY case_id ORDER BY ix)),
        s AS (SELECT case_id, text || ' ' || t1 AS span FROM v WHERE ix >= 8 AND t1 IS NOT NULL UNION SELECT case_id, text || ' ' || t1 || ' ' || t2 FROM v WHERE ix >= 8 AND t2 IS NOT NULL UNION SELECT case_id, text || ' ' || t1 || ' ' || t2 || ' ' || t3 FROM v WHERE ix >= 8 AND t3 IS NOT NULL), t AS (SELECT case_id, text || ' ' || t1 || ' ' || t2 AS truth FROM v WHERE ix = 0 AND t2 IS NOT NULL),
        d AS (SELECT s.case_id, span, damerau_levenshtein(lower(span), lower(truth)) AS d, length(truth) AS len FROM s JOIN t ON t.case_id = s.case_id), b AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY d, encode(span)) = 1)
        SELECT case_id, span, CAST(d AS INT) AS distance, CASE WHEN d <= 2 THEN 'near_miss' WHEN d * 2 <= len THEN 'partial' ELSE 'none' END AS kind FROM b""")(lambda s, d: nearest(view(s, d, "documents")))  # fmt: skip
    r.add("j21_category_readiness", bx(", c AS (SELECT case_id, target, bool_or(coverage >= 0.5 AND (proposal + target) % 3 > 0) AS clear FROM ov GROUP BY ALL) SELECT case_id, count(*) AS targets, count(*) FILTER (clear) AS clear, bool_and(clear) AS ready FROM c GROUP BY 1"))(lambda s, d: ck.category_readiness(g.overlap_join(boxes(s, d)).withColumn("agrees", F.expr("(proposal + target) % 3 > 0"))))
    r.add("j22_provenance_reconcile", duck("fx_expected", "fx_actual", sql="SELECT * FROM (SELECT e.case_id, CASE WHEN a.case_id IS NULL THEN 'ANALYZER_ABSENT' WHEN e.digest <> a.digest THEN 'ANALYZER_DIFFERS' WHEN e.case_id % 19 = 0 THEN 'RUN_ABSENT' END AS code FROM fx_expected e LEFT JOIN fx_actual a ON a.case_id = e.case_id) WHERE code IS NOT NULL"))(lambda s, d: ck.provenance_reconcile(view(s, d, "fx_expected"), view(s, d, "fx_actual"), view(s, d, "fx_actual").filter("case_id % 19 <> 0"), "case_id"))
    runs = lambda s, d: s.sql(PRINTS.format("{p}"), p=view(s, d, "supplier"))
    r.add("j24_pairwise_fingerprints", f"WITH p AS (SELECT min(run_id) AS id, count(*) AS n, a, b, c FROM ({PRINTS.format('supplier')}) GROUP BY a, b, c), q AS (SELECT x.id AS a, y.id AS b, x.n AS n_a, y.n AS n_b, (x.a IS DISTINCT FROM y.a)::INT + (x.b IS DISTINCT FROM y.b)::INT + (x.c IS DISTINCT FROM y.c)::INT AS differing FROM p x JOIN p y ON x.id < y.id) SELECT * FROM q WHERE differing < 3")(lambda s, d: ck.pairwise_fingerprints(runs(s, d), ["a", "b", "c"]))
    r.add("j24_fingerprint_classes", f"SELECT run_id, min(run_id) OVER (PARTITION BY a, b, c) AS class_id FROM ({PRINTS.format('supplier')})")(lambda s, d: ck.fingerprint_classes(runs(s, d), ["a", "b", "c"]).select("run_id", "class_id"))
    want = "SELECT case_id, text || lead(text) OVER w || lead(text, 2) OVER w AS token FROM {} WHERE ix BETWEEN 3 AND 5 WINDOW w AS (PARTITION BY case_id ORDER BY ix)"
    r.add("a20_token_coverage", f"""WITH {WORDS}, {LINED}, k AS (SELECT case_id, lower(text) AS t, lead(lower(text)) OVER w AS t1, lead(lower(text), 2) OVER w AS t2, lead(lower(text), 3) OVER w AS t3 FROM lined WHERE ix >= 3 WINDOW w AS (PARTITION BY case_id ORDER BY ix)), e AS (SELECT case_id, lower(token) AS token FROM ({tops.format('lined')} UNION ALL SELECT * FROM ({want.format('lined')}) WHERE token IS NOT NULL)),
        p AS (SELECT case_id, t AS token, 0 AS n FROM k UNION SELECT case_id, t || t1, 1 FROM k UNION SELECT case_id, t || t1 || t2, 1 FROM k UNION SELECT case_id, t || t1 || t2 || t3, 1 FROM k), h AS (SELECT case_id, token, min(n) AS n FROM p WHERE token IS NOT NULL GROUP BY ALL)
        SELECT e.case_id, count(*) AS expected, count(*) FILTER (n = 0) AS present, count(*) FILTER (n = 1) AS fragmented, count(*) FILTER (n IS NULL) AS missing FROM e LEFT JOIN h ON h.case_id = e.case_id AND h.token = e.token GROUP BY 1""")(
        lambda s, d: ck.token_coverage(expecting(view(s, d, "documents")))
    )
    pairs = "SELECT p_partkey AS id, p_name AS a, CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN concat(p_type, '  ', p_name) WHEN 2 THEN 'x' ELSE '' END AS b FROM {}"
    grams = "SELECT id, g, count(*) AS n FROM (SELECT id, unnest(CASE WHEN length({c}) < 2 THEN [{c}] ELSE list_transform(range(1, length({c})), lambda i: substr({c}, i, 2)) END) AS g FROM p WHERE {c} <> '') GROUP BY ALL"
    r.add("a20_bigram_similarity", f"WITH p AS (SELECT id, trim(regexp_replace(lower(a), '\\s+', ' ', 'g')) AS a, trim(regexp_replace(lower(b), '\\s+', ' ', 'g')) AS b FROM ({pairs.format('part')})), x AS ({grams.format(c='a')}), y AS ({grams.format(c='b')}), s AS (SELECT x.id, sum(least(x.n, y.n)) AS n FROM x JOIN y ON x.id = y.id AND x.g = y.g GROUP BY 1) SELECT p.id, round(CASE WHEN a = '' OR b = '' THEN 0 WHEN a = b THEN 1 ELSE 2 * coalesce(s.n, 0) / (greatest(1, length(a) - 1) + greatest(1, length(b) - 1))::DOUBLE END, 6) AS similarity FROM p LEFT JOIN s ON s.id = p.id")(
        lambda s, d: ck.bigram_similarity(s.sql(pairs.format("{p}"), p=view(s, d, "part")))
    )
    r.add("a28_code_agreement", f"WITH c AS (SELECT case_id, repetition, list_sort(list(DISTINCT code)) AS codes FROM ({CODES.format('lineitem')}) GROUP BY ALL) SELECT a.case_id, count(*) AS pairs, bool_and(a.codes = b.codes) AS exact, round(avg(len(list_intersect(a.codes, b.codes)) / len(list_distinct(list_concat(a.codes, b.codes)))::DOUBLE), 6) AS jaccard FROM c a JOIN c b ON a.case_id = b.case_id AND a.repetition < b.repetition GROUP BY 1")(lambda s, d: ck.code_agreement(s.sql(CODES.format("{l}"), l=view(s, d, "lineitem"))))
    turned = "SELECT orientation, CASE WHEN case_id % 7 = 0 THEN 'horizontal' ELSE orientation END AS annotated, CASE n_chars % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence, detected FROM {}"
    facts = "count(*) AS n, count(*) FILTER (detected) AS detected, round(count(*) FILTER (detected) / count(*)::DOUBLE, 6) AS recall, count(*) FILTER (orientation = annotated) AS agrees, round(count(*) FILTER (orientation = annotated) / count(*)::DOUBLE, 6) AS agreement FROM t GROUP BY 2"
    r.add("a30_orientation_breakdown", duck("fx_cases", sql=f"WITH t AS ({turned.format('fx_cases')}) SELECT 'orientation' AS level, orientation AS key, {facts} UNION ALL SELECT 'confidence', confidence, {facts}"))(lambda s, d: ck.orientation_breakdown(s.sql(turned.format("{c}"), c=view(s, d, "fx_cases"))))
    reach = "greatest(o.x0 - a.x1, a.x0 - o.x1) <= greatest(24, 2.5::DOUBLE * greatest(a.y1 - a.y0, o.y1 - o.y0)) AND greatest(o.y0 - a.y1, a.y0 - o.y1) <= greatest(24, 2 * greatest(a.y1 - a.y0, o.y1 - o.y0))"
    r.add("x14_word_components", duck("fx_boxes", sql=f"WITH w AS ({WORD_BOX.format('fx_boxes')}), e AS (SELECT a.id, o.id AS other FROM w a JOIN w o ON a.case_id = o.case_id AND {reach}), reach AS (SELECT id, other FROM e UNION SELECT reach.id, e.other FROM reach JOIN e ON e.id = reach.other) SELECT id, min(other) AS component FROM reach GROUP BY id", recursive=True))(
        lambda s, d: sp.word_components(s.sql(WORD_BOX.format("{b}"), b=view(s, d, "fx_boxes")))
    )
    parts = PARTS.format('lineitem')
    gaps = "greatest(o.x - b.x - b.width, b.x - o.x - o.width) > 96 OR greatest(o.y - b.y - b.height, b.y - o.y - o.height) > 72"
    focus = f"""c AS ({parts}), b AS (SELECT * FROM (SELECT *, sum(words) OVER (PARTITION BY case_id) AS total FROM c) QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY words DESC, width * height DESC, component) = 1), k AS (SELECT b.*, greatest(24, floor(width * 0.08::DOUBLE + 0.5)) AS px, greatest(24, floor(height * 0.08::DOUBLE + 0.5)) AS py FROM b WHERE total >= 4 AND width * height BETWEEN 0.08::DOUBLE * 480000 AND 0.82::DOUBLE * 480000
          AND EXISTS (SELECT 1 FROM c o WHERE o.case_id = b.case_id AND o.component <> b.component AND ({gaps}))), l AS (SELECT *, greatest(0, least(799, x - px)) AS x0, greatest(0, least(599, y - py)) AS y0, greatest(greatest(0, least(799, x - px)) + 1, least(800, x + width + px)) AS x1, greatest(greatest(0, least(599, y - py)) + 1, least(600, y + height + py)) AS y1 FROM k),
        focus AS (SELECT case_id, component, x0, y0, x1, y1, CASE WHEN greatest(x - x0, x1 - x - width) >= 0.12::DOUBLE * (x1 - x0) THEN CASE WHEN x1 - x - width >= x - x0 THEN 'right' ELSE 'left' END END AS edge FROM l WHERE x1 - x0 < 0.92::DOUBLE * 800 OR y1 - y0 < 0.92::DOUBLE * 600)"""
    focused = lambda s, d: ck.focus_regions(s.sql(PARTS.format("{l}"), l=view(s, d, "lineitem")), 800, 600)
    r.add("x15_focus_regions", f"WITH {focus} SELECT * FROM focus")(focused)
    needs = "SELECT o_orderkey AS case_id, bool_or(o_custkey % 3 = 0) AS needs_brand, bool_or(o_custkey % 2 = 0) AS needs_alcohol FROM {} GROUP BY o_orderkey"
    spots = "SELECT l_orderkey AS case_id, CAST(l_partkey % 800 AS DOUBLE) AS x0, CAST(l_partkey % 800 AS DOUBLE) + 10 AS x1 FROM {} WHERE l_orderkey % 5 <> 0"
    r.add("x16_plan_recovery", f"""WITH {focus}, n AS ({needs.format('orders')}), w AS (SELECT case_id, count(*) AS n, bool_or((x0 + x1) / 2 <= 160 OR (x0 + x1) / 2 >= 640) AS edges FROM ({spots.format('lineitem')}) GROUP BY 1),
        a AS (SELECT n.case_id, needs_brand, needs_alcohol, coalesce(w.n, 0) AS n, coalesce(edges, false) AS edges, f.x0, f.y0, f.x1, f.y1, edge, least(f.x1 - f.x0, greatest(72, floor((f.x1 - f.x0) * 0.22::DOUBLE + 0.5))) AS fw FROM n LEFT JOIN w ON w.case_id = n.case_id LEFT JOIN focus f ON f.case_id = n.case_id WHERE needs_brand OR needs_alcohol),
        p AS (SELECT case_id, 1 AS k, 'left-edge' AS pass_kind, 0.0::DOUBLE AS x0, 0.0::DOUBLE AS y0, 352.0::DOUBLE AS x1, 600.0::DOUBLE AS y1, '' AS more FROM a WHERE needs_alcohol UNION ALL SELECT case_id, 2, 'right-edge', 448, 0, 800, 600, '' FROM a WHERE needs_alcohol UNION ALL SELECT case_id, 3, 'focus', x0, y0, x1, y1, 'focus-crop-distinct' FROM a WHERE needs_alcohol AND x0 IS NOT NULL
          UNION ALL SELECT case_id, 4, 'focus-' || edge || '-edge', CASE edge WHEN 'left' THEN x0 ELSE x1 - fw END, y0, CASE edge WHEN 'left' THEN x0 + fw ELSE x1 END, y1, 'focus-crop-distinct,edge-text-heuristic' FROM a WHERE needs_alcohol AND edge IS NOT NULL UNION ALL SELECT case_id, 5, 'rotated-180', 0, 0, 800, 600, 'orientation-fallback' FROM a WHERE n <= 6),
        q AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY k) AS position FROM p)
        SELECT q.case_id, CAST(position AS INT) AS position, pass_kind, q.x0, q.y0, q.x1, q.y1, array_to_string(list_filter([CASE WHEN needs_brand THEN 'brand-not-observed' END, CASE WHEN needs_alcohol THEN 'alcohol-not-observed' END, CASE WHEN n < 18 THEN 'low-text-density' END, CASE WHEN edges AND NOT contains(more, 'edge-text') THEN 'edge-text-heuristic' END,
          CASE WHEN edges AND contains(more, 'edge-text') THEN 'edge-text-heuristic,focus-crop-distinct' WHEN more <> '' THEN more END], lambda x: x IS NOT NULL), ',') AS reasons FROM q JOIN a ON a.case_id = q.case_id WHERE position <= 4""")(
        lambda s, d: ck.plan_recovery(s.sql(needs.format("{o}"), o=view(s, d, "orders")), s.sql(spots.format("{l}"), l=view(s, d, "lineitem")), focused(s, d), 800, 600)
    )
    classes = [(i, k, c.split(":")[0], c.split(":")[1], next(f for f, v in vc.FAMILIES.items() if c.split(":")[0] in v.split())) for i, (*_, told) in enumerate(REGIONS) for k, c in enumerate(told.split(), 1)]
    r.add("x17_text_class_hypotheses", "SELECT p_partkey AS id, class, family, points, place FROM part JOIN (VALUES " + ", ".join(f"({i}, {k}, '{c}', {n}, '{f}')" for i, k, c, n, f in classes) + f") v(t, place, class, points, family) ON v.t = p_partkey % {len(REGIONS)}")(lambda s, d: ck.text_class_hypotheses(regions(s, d)))
