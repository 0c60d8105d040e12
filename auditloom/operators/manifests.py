"""Rules over declaration manifests and results: one row for each rule that a record breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.functions.statements import stated
from auditloom.functions.text import brand_base
from auditloom.operators.logs import issue_rows

# Media types, eligibility states, source types and value states of a declaration.
MEDIA = ["image/jpeg", "image/png", "image/webp"]
ELIGIBILITY = ["PRIMARY_BLIND_CANDIDATE", "PENDING", "EXCLUDED", "NON_BLIND_OPERATIONAL"]
SOURCES = ["REGISTRY", "OPERATOR", "ARCHIVE"]
VALUE_STATES = ["PRESENT", "ABSENT", "UNKNOWN"]
PARTS = ["search_ms", "transcription_ms", "verification_ms"]
TIMES = [*PARTS, "total_ms"]
LIFECYCLE = ["randomized_at", "exposed_at", "executed_at"]
DIGEST = "^[0-9a-f]{64}$"


def _blank(name: str) -> Column:
    return F.coalesce(F.trim(name) == "", F.lit(True))


def timestamp_rules() -> dict[str, Column]:
    """start <= completion <= recorded < each lifecycle time; a time that is null breaks nothing."""
    c = F.col
    rules = {"completed_before_start": c("completed_at") < c("started_at"), "recorded_before_completion": c("recorded_at") < c("completed_at")}
    for name in LIFECYCLE:
        rules |= {f"recorded_not_before_{name}": c("recorded_at") >= c(name), f"completed_not_before_{name}": c("completed_at") >= c(name)}
    return rules


def timestamp_chain_issues(entries: DataFrame, lifecycle: DataFrame) -> DataFrame:
    """Breaks of the order of an entry's times and its run's. entries: case_id, run_id, started_at, completed_at, recorded_at; lifecycle: run_id and LIFECYCLE, a row a run."""
    return issue_rows(entries.join(lifecycle, "run_id", "left"), "case_id", timestamp_rules())


def manifest_issues(entries: DataFrame, runs: DataFrame, forbidden: str, exposed: list[str]) -> DataFrame:
    """Every rule that an entry breaks.

    entries: case_id, version, run_id, image_ref, sha256, media_type, bytes, eligibility, brand_state, brand_text,
    brand_normal, alcohol_state, alcohol_text, alcohol_normal (basis points), the four TIMES, started_at, completed_at,
    recorded_at, accessed_at, source_type, source_ref, prior_identity, exclusion_reason, independence, method,
    recorder, recorder_role, digest, digest_found. runs: run_id, version and LIFECYCLE. forbidden: pattern of sources that
    must not be named; exposed: identities that were seen before.

    A primary candidate is held to more: all that tells where its declaration comes from has to be there and in order.
    """
    c = F.col
    e = stated(entries.withColumnRenamed("version", "entry_version"), "alcohol_text").join(runs.withColumn("_known", F.lit(True)), "run_id", "left")
    present = {x: c(f"{x}_state") == "PRESENT" for x in ("brand", "alcohol")}
    primary = c("eligibility") == "PRIMARY_BLIND_CANDIDATE"
    total = sum((c(p) for p in PARTS[1:]), c(PARTS[0]))
    alcohol_ok = c("kind").isin("direct", "range")
    whole = {
        "values": present["brand"] & present["alcohol"], "source_type": c("source_type").isNotNull(), "source_ref": ~_blank("source_ref"), "access_date": c("accessed_at").isNotNull(), "independence": ~_blank("independence"), "method": ~_blank("method"), "recorder": ~_blank("recorder") & ~_blank("recorder_role"),
        "recorded_at": c("recorded_at").isNotNull(), "started_at": c("started_at").isNotNull(), "completed_at": c("completed_at").isNotNull(), **{t: F.coalesce(c(t) >= 0, F.lit(False)) for t in TIMES},
    }
    order = timestamp_rules()
    ordered = ~F.coalesce(F.greatest(*[x.cast("int") for x in order.values()]) == 1, F.lit(False))
    traceable = c("source_type").isin(SOURCES) & ~c("source_ref").rlike(forbidden) & (c("total_ms") >= total) & ordered
    # what several rules ask for has a column of its own
    asked = {f"_has_{k}": ok for k, ok in whole.items()} | {"_traceable": traceable} | {f"_late_{k}": x for k, x in order.items()} | {"_total": total, "_digest": c("digest").rlike(DIGEST), "_base": brand_base(c("brand_text"))}
    e = e.withColumns(asked)
    order, total, whole, traceable, is_digest = {k: c(f"_late_{k}") for k in order}, c("_total"), {k: c(f"_has_{k}") for k in whole}, c("_traceable"), c("_digest")
    rules = {
        "version": ~c("entry_version").eqNullSafe(c("version")), "run": c("_known").isNull(), "case_id": ~c("case_id").cast("string").rlike(r"^\d{1,9}$"), "image_ref": _blank("image_ref"), "sha256": ~F.coalesce(c("sha256").rlike(DIGEST), F.lit(False)), "media_type": ~F.coalesce(c("media_type").isin(MEDIA), F.lit(False)), "bytes": ~F.coalesce(c("bytes") > 0, F.lit(False)), "eligibility": ~F.coalesce(c("eligibility").isin(ELIGIBILITY), F.lit(False)),
        "brand_state": ~F.coalesce(c("brand_state").isin(VALUE_STATES), F.lit(False)), "brand_text": present["brand"] == c("brand_text").isNull(), "brand_normal": present["brand"] & ~c("brand_normal").eqNullSafe(c("_base")),
        "alcohol_state": ~F.coalesce(c("alcohol_state").isin(VALUE_STATES), F.lit(False)), "alcohol_text": present["alcohol"] == c("alcohol_text").isNull(), "alcohol_syntax": present["alcohol"] & c("alcohol_text").isNotNull() & ~alcohol_ok, "alcohol_normal": present["alcohol"] & alcohol_ok & ~c("alcohol_normal").eqNullSafe(c("low")),
        **{f"{t}_negative": c(t) < 0 for t in TIMES}, "burden": c("total_ms") < total, **order, "source_type": ~c("source_type").isin(SOURCES), "source_forbidden": c("source_ref").rlike(forbidden), "exposed_primary": c("prior_identity").isin(exposed) & primary, "reason_missing": c("eligibility").isin("EXCLUDED", "NON_BLIND_OPERATIONAL") & _blank("exclusion_reason"),
        **{f"primary_{k}": primary & ~ok for k, ok in whole.items()}, "primary_incomplete": primary & ~F.coalesce(traceable & F.least(*[F.coalesce(x, F.lit(False)).cast("int") for x in whole.values()]).cast("boolean"), F.lit(False)),
        "digest": ~is_digest, "digest_differs": is_digest & (c("digest") != c("digest_found")),
    }
    return issue_rows(e, "case_id", rules)


def result_rule_issues(findings: DataFrame, manifest: DataFrame, results: DataFrame) -> DataFrame:
    """(case_id, position, issue) of findings that differ from the ordered rules of their result.

    findings: case_id, position, rule, rule_version, profile, profile_version, ref_field, ref_digest, ref_state, ref_alternate (one
    reference, null for none); manifest: position, rule, rule_version, a row a rule; results: case_id, profile, profile_version, digest,
    brand_state, alcohol_state. A case without findings counts by its results.
    """
    c = F.col
    want = manifest.select("position", c("rule").alias("_rule"), c("rule_version").alias("_version"))
    n = manifest.select("rule").count()  # rules of a profile: a few
    one = Window.partitionBy("case_id", "rule").orderBy("position")
    f = findings.withColumn("nth", F.row_number().over(one))
    r = results.select("case_id", *[c(x).alias(f"_{x}") for x in ("profile", "profile_version", "digest", "brand_state", "alcohol_state")])
    j = f.join(r, "case_id", "left").join(F.broadcast(want), "position", "left")
    state = F.when(c("ref_field") == "brandName", c("_brand_state")).when(c("ref_field") == "alcoholStatement", c("_alcohol_state"))
    rules = {
        "order": c("rule") != c("_rule"), "version": c("rule_version") != c("_version"), "profile": (c("profile") != c("_profile")) | (c("profile_version") != c("_profile_version")), "repeated": c("nth") > 1, "no_result": c("_profile").isNull(),
        "unknown_field": c("ref_field").isNotNull() & ~c("ref_field").isin("brandName", "alcoholStatement"), "reference_digest": state.isNotNull() & (c("ref_digest") != c("_digest")), "reference_state": state.isNotNull() & (c("ref_state") != state), "alternate_of_nothing": (state == "NOT_OBSERVED") & c("ref_alternate").isNotNull(),
    }
    rows = j.select("case_id", "position", F.explode(F.array_compact(F.array(*[F.when(x, F.lit(k)) for k, x in rules.items()]))).alias("issue"))
    counts = results.select("case_id").join(findings.groupBy("case_id").count(), "case_id", "left").filter(F.coalesce("count", F.lit(0)) != n)
    return rows.unionByName(counts.select("case_id", F.lit(None).cast("int").alias("position"), F.lit("count").alias("issue")))


# Roles of fixtures that are inventory, and the fields that only these have, all of them or approved candidates.
INVENTORY = ["candidate", "wine_multi_artifact_candidate", "category_sentinel"]
INVENTORY_FIELDS = ["source_stratum", "independence", "eligibility", "annotation", "split", "acquired_on"]
WINE_FIELDS = ["colour", "multi_panel", "decimal_comma"]


def corpus_issues(entries: DataFrame) -> DataFrame:
    """(id, issue) of each rule that a fixture of a corpus breaks.

    entries: id, role, category, sentinel_category, availability, unavailable_reason, synthetic (boolean), evidence, from_picture, directory, image, manifest, expectations, derived_from, INVENTORY_FIELDS, WINE_FIELDS. Ids and paths that
    repeat are told for every row but the first by row contents.
    """
    c = F.col
    away, sentinel, inventory = c("availability") == "unavailable", c("role") == "category_sentinel", c("role").isin(INVENTORY)
    assets = c("image").isNotNull() | c("manifest").isNotNull()
    any_of = lambda names: F.coalesce(*[c(x).cast("string") for x in names]).isNotNull()
    lacks = lambda names: F.greatest(*[c(x).isNull().cast("int") for x in names]) == 1
    order = ["role", "image", "manifest", "derived_from"]
    no_path = F.when(c("directory").isNull() | c("image").isNull(), c("id"))  # what has no path repeats none, so it needs no group of its own kind
    e = entries.withColumns({"nth_id": F.row_number().over(Window.partitionBy("id").orderBy(*order)), "nth_path": F.row_number().over(Window.partitionBy("directory", "image", no_path).orderBy("id", *order))})
    ids = entries.select(c("id").alias("_parent")).distinct()
    spread = F.xxhash64(F.coalesce(c("derived_from").cast("string"), c("id").cast("string")))  # rows without a parent would all meet in one task by their null
    e = e.join(ids, (c("derived_from") == c("_parent")) & (spread == F.xxhash64(c("_parent").cast("string"))), "left")
    rules = {
        "repeated_id": c("nth_id") > 1, "repeated_image": c("image").isNotNull() & c("directory").isNotNull() & (c("nth_path") > 1),
        "reason_missing": away & c("unavailable_reason").isNull(), "unavailable_real": away & c("from_picture"), "unavailable_assets": away & assets, "reason_of_available": ~away & c("unavailable_reason").isNotNull(),
        "synthetic_assets": c("synthetic") & assets, "synthetic_real": c("synthetic") & c("from_picture"), "evidence_missing": c("synthetic") & c("evidence").isNull(), "evidence_of_real": ~c("synthetic") & c("evidence").isNotNull(), "real_incomplete": c("from_picture") & lacks(["image", "manifest", "directory"]),
        "sentinel_wine": sentinel & (c("category") == "wine"), "sentinel_unnamed": sentinel & c("sentinel_category").isNull(), "sentinel_differs": sentinel & (c("sentinel_category") != c("category")), "category": ~sentinel & (c("category") != "wine"), "sentinel_of_other": ~sentinel & c("sentinel_category").isNotNull(),
        "inventory_expectations": inventory & c("expectations").isNotNull(), "inventory_annotated": inventory & ~c("annotation").eqNullSafe("unannotated"), "inventory_assigned": inventory & ~c("split").eqNullSafe("unassigned"), "inventory_real": inventory & c("from_picture"), "inventory_synthetic": inventory & (c("synthetic") | c("evidence").isNotNull()),
        "inventory_unavailable": inventory & (c("availability") != "available"), "inventory_image": inventory & lacks(["image", "directory"]), "inventory_manifest": inventory & c("manifest").isNotNull(), "inventory_fields": inventory & lacks(INVENTORY_FIELDS), "wine_fields": (c("role") == "candidate") & lacks(WINE_FIELDS), "wine_fields_of_other": inventory & (c("role") != "candidate") & any_of(WINE_FIELDS),
        "expectations_missing": ~inventory & c("expectations").isNull(), "inventory_fields_of_other": ~inventory & any_of(INVENTORY_FIELDS + WINE_FIELDS), "parent_unknown": c("derived_from").isNotNull() & c("_parent").isNull(), "parent_itself": c("derived_from") == c("id"),
    }
    return issue_rows(e, "id", rules)


# Reasons of a review that each exclusion has to state one of.
STATED = {
    "excluded_usage_or_provenance_concern": ["uncertain-usage-provenance"], "excluded_uncertain_truth": ["uncertain-brand-identity", "illegible-alcohol-text", "conflicting-front-back-presentations", "unclear-crop-or-wraparound-context", "other"],
    "excluded_unreadable": ["uncertain-brand-identity", "illegible-alcohol-text", "other"], "excluded_other": ["other"],
}


def eval_manifest_issues(records: DataFrame) -> DataFrame:
    """(case_id, issue) of each rule that a record of an evaluation breaks.

    records: case_id, path, media_type, wide, high, orientation, sha256, usage, status, reasons (array), strata (array), category,
    ambiguous, alcohol (present, absent), annotated_on, reviewed_on. Ids, paths and included digests that repeat are told for every
    row but the first.
    """
    c = F.col
    has = lambda column, value: F.coalesce(F.array_contains(column, value), F.lit(False))
    included, wine = c("status") == "included", c("category") == "wine"
    nth = lambda by: F.row_number().over(Window.partitionBy(*by).orderBy("case_id", "path"))
    r = records.withColumns({"nth_id": nth(["case_id"]), "nth_path": nth(["path"]), "nth_digest": nth(["sha256", "status"])})
    shape = F.when(c("wide") == c("high"), "square").when(c("wide") > c("high"), "landscape").otherwise("portrait")
    media = F.when(F.lower("path").endswith(".png"), "image/png").otherwise("image/jpeg")
    rules = {
        "repeated_id": c("nth_id") > 1, "repeated_path": c("nth_path") > 1, "included_twice": included & (c("nth_digest") > 1), "media_type": c("media_type") != media, "orientation": ~c("orientation").isin("unknown") & (c("orientation") != shape),
        "usage": (c("usage") == "usage-or-provenance-concern") != (c("status") == "excluded_usage_or_provenance_concern"), "included_uncertain": included & has("reasons", "uncertain-usage-provenance"), "not_wine": included & ~wine, "scope": (c("status") == "excluded_outside_current_scope") & (wine | ~has("strata", "out-of-scope-category")),
        "ambiguous": included & (c("ambiguous") != has("strata", "genuinely-ambiguous")), "alcohol": included & ((c("alcohol") == "absent") != has("strata", "missing-alcohol-statement")), "reviewed_early": included & (c("reviewed_on") < c("annotated_on")),
        **{f"unstated_{k}": (c("status") == k) & ~F.coalesce(F.arrays_overlap("reasons", F.array(*map(F.lit, told))), F.lit(False)) for k, told in STATED.items()},
    }
    return issue_rows(r, "case_id", rules)
