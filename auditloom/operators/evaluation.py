"""Evaluation: failure classes, aggregates and breakdowns of case scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditloom.functions.scores import CLASSES, alcohol_class, brand_class, nearest_rank, rate


def classify_failures(cases: DataFrame) -> DataFrame:
    """Adds brand_class and alcohol_class."""
    return cases.withColumns({"brand_class": brand_class(), "alcohol_class": alcohol_class()})


def eval_aggregate(scores: DataFrame, by: list[str]) -> DataFrame:
    """Counts, rates over their own denominators, class counts and latencies in one pass."""
    brand_seen = (F.col("state") != "NOT_OBSERVED") & F.col("has_value")
    sure = F.col("brand_present") & ~F.col("ambiguous")
    vague, none = F.col("brand_present") & F.col("ambiguous"), ~F.col("brand_present")
    stated = F.col("alcohol_present")
    n = {"determinate_brands": sure, "absent_brands": none, "ambiguous_brands": vague, "present_alcohols": stated, "absent_alcohols": ~stated}
    parts = {
        "exact_rate": (sure & F.col("exact"), sure), "normalized_rate": (sure & F.col("normalized"), sure), "top3_recall": (sure & F.col("top3"), sure), "top5_recall": (sure & F.col("top5"), sure),
        "confident_correct_rate": (sure & (F.col("brand_class") == "correct"), sure), "deferred_rate": (sure & F.col("top5") & (F.col("brand_class") != "correct"), sure),
        "needless_ambiguity_rate": (sure & (F.col("brand_class") == "correct-uncertainty"), sure), "false_certainty_rate": (sure & (F.col("brand_class") == "false-certainty"), sure),
        "abstention_rate": (sure & ~brand_seen, sure), "correct_abstention_rate": (none & ~brand_seen, none), "absent_brand_false_positives": (none & brand_seen, none),
        "alcohol_recall": (stated & F.col("detected"), stated), "alcohol_accuracy": (stated & F.col("parsed_ok"), stated), "parser_failure_rate": (stated & (F.col("alcohol_class") == "parser-failure"), stated),
        "absent_alcohol_false_positives": (~stated & F.col("detected"), ~stated), "alcohol_false_certainty_rate": (F.col("alcohol_class") == "false-certainty", F.lit(True)),
        "ambiguity_honesty": (vague & F.col("brand_class").isin("correct", "correct-uncertainty"), vague),
    }
    counts = [F.count_if(c).alias(k) for k, c in n.items()]
    rates = [rate(F.count_if(a), F.count_if(b)).alias(k) for k, (a, b) in parts.items()]
    classes = [F.count_if(F.col(f"{f}_class") == c).alias(f"{f}_{c.replace('-', '_')}") for f in ("brand", "alcohol") for c in CLASSES]
    return scores.groupBy(*by).agg(F.count("*").alias("cases"), *counts, *rates, nearest_rank("latency_ms", 0.5).alias("median_latency"), nearest_rank("latency_ms", 0.95).alias("p95_latency"), *classes)


def slice_metrics(scores: DataFrame, slices: dict[str, str]) -> DataFrame:
    """Recall and accuracy of present alcohols in slices that may overlap; empty slices are kept. slices: name to SQL condition."""
    spark = scores.sparkSession
    names = spark.createDataFrame([(k,) for k in slices], "slice string")
    member = F.explode(F.array_compact(F.array(*[F.when(F.expr(c), F.lit(k)) for k, c in slices.items()])))
    found = scores.filter("alcohol_present").select(member.alias("slice"), "detected", "parsed_ok").groupBy("slice").agg(F.count("*").alias("cases"), F.count_if("detected").alias("detected"), F.count_if("parsed_ok").alias("accurate"))
    filled = names.join(found, "slice", "left").fillna(0)
    return filled.select("slice", "cases", "detected", "accurate", rate(F.col("detected"), F.col("cases")).alias("recall"), rate(F.col("accurate"), F.col("cases")).alias("accuracy"))


def failure_distribution(scores: DataFrame) -> DataFrame:
    """Both fields' classes in twelve buckets, empty ones too; oriented cases have a bucket of their own."""
    buckets = ["ocr-recognition", "region-coverage", "orientation", "line-reconstruction", "candidate-generation", "candidate-filtering", "candidate-ranking", "parser", "unnecessary-ambiguity", "false-certainty", "correct-uncertainty", "correct-result"]
    both = scores.select(F.explode(F.array(F.struct(F.col("brand_class").alias("c"), F.col("ambiguous").alias("a")), F.struct(F.col("alcohol_class").alias("c"), F.lit(False).alias("a")))).alias("x"), "orientation").select("x.c", "x.a", "orientation")
    c = F.col("c")
    bucket = (
        F.when(c == "correct", "correct-result").when(c == "correct-uncertainty", F.when(F.col("a"), "correct-uncertainty").otherwise("unnecessary-ambiguity"))
        .when((c == "region-coverage-failure") & (F.col("orientation") != "horizontal"), "orientation").otherwise(F.regexp_replace(c, "-failure$", ""))
    )
    names = scores.sparkSession.createDataFrame([(b,) for b in buckets], "bucket string")
    return names.join(both.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")), "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def filter_subtypes(candidates: DataFrame) -> DataFrame:
    """Filtered candidates by field and reason, most frequent first."""
    return candidates.filter(~F.col("kept")).groupBy("field", F.col("reason").alias("subtype")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "field", "subtype")


def subtype_coverage(candidates: DataFrame) -> DataFrame:
    """Three counts of filtered candidates that must agree: all, those with a reason, and the sum of the reason buckets."""
    gone = candidates.filter(~F.col("kept"))
    by = gone.groupBy("field", "reason").agg(F.count("*").alias("n")).groupBy("field").agg(F.sum("n").alias("in_buckets"))
    all_ = gone.groupBy("field").agg(F.count("*").alias("filtered"), F.count("reason").alias("with_reason"))
    return all_.join(by, "field").withColumn("agrees", (F.col("filtered") == F.col("with_reason")) & (F.col("filtered") == F.col("in_buckets")))


def calibration_coverage(candidates: DataFrame) -> DataFrame:
    """Candidate counts by field and over all."""
    grouped = candidates.rollup("field").agg(F.count("*").alias("records"), F.count_if("selected").alias("selected"), F.count_if(~F.col("selected")).alias("not_selected"), F.count_if(~F.col("kept")).alias("rejected"), F.count("raw_confidence").alias("with_confidence"), F.count_if(F.col("raw_confidence").isNull()).alias("without_confidence"))
    return grouped.withColumn("field", F.coalesce("field", F.lit("total")))


def calibration_records(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """A feature and correctness row for each candidate; truth: case_id, value."""
    joined = candidates.join(truth.withColumnRenamed("value", "truth"), "case_id", "left")
    return joined.select("case_id", "field", "candidate_id", "priority", "score", (F.coalesce(F.col("raw_confidence"), F.lit(0)) / 100).alias("confidence"), F.col("raw_confidence").isNull().alias("no_confidence"), "selected", F.coalesce(F.col("value") == F.col("truth"), F.lit(False)).alias("correct"))


def pass_contributions(passes: DataFrame) -> DataFrame:
    """What each kind of pass added: passes, cases, flags, time and the highest running cost."""
    running = Window.partitionBy("case_id").orderBy("pass_order").rowsBetween(Window.unboundedPreceding, 0)
    flags = ["new_tokens", "new_evidence", "accepted", "changed", "correct", "no_value"]
    return passes.withColumn("cost", F.sum("execution_ms").over(running)).groupBy("pass_kind").agg(F.count("*").alias("passes"), F.countDistinct("case_id").alias("cases"), *[F.count_if(f).alias(f) for f in flags], F.sum("execution_ms").alias("total_ms"), F.max("cost").alias("max_cumulative_ms"))


def performance_breakdown(passes: DataFrame) -> DataFrame:
    """Nearest-rank percentiles of passes and time over cases, and the cost of a recovered field."""
    cases = passes.groupBy("case_id").agg(F.count("*").alias("passes"), F.sum("execution_ms").alias("ms"), F.count_if(F.col("no_value")).alias("useless"), F.count_if("correct").alias("recovered"))
    return cases.agg(
        nearest_rank("passes", 0.5).alias("median_passes"), nearest_rank("passes", 0.95).alias("p95_passes"), F.count_if(F.col("passes") > 1).alias("extra_cases"), rate(F.count_if(F.col("passes") > 1), F.count("*")).alias("extra_rate"),
        nearest_rank("ms", 0.5).alias("median_ms"), nearest_rank("ms", 0.95).alias("p95_ms"), F.sum("useless").alias("useless_passes"), rate(F.sum("ms"), F.sum("recovered")).alias("cost_per_recovered"),
    )


def build_metrics(scores: DataFrame) -> DataFrame:
    """One row of a run's headline numbers; percentiles here are the element at floor(n * p) of the sorted values."""
    total = scores.count()
    # ranks by value counts: the sorted order is never brought into one task
    by_value = scores.groupBy("latency_ms").agg(F.count("*").alias("n"))
    upto = by_value.withColumn("upto", F.sum("n").over(Window.orderBy("latency_ms").rowsBetween(Window.unboundedPreceding, 0)))
    at = lambda p: F.min(F.when(F.col("upto") > min(int(total * p), max(total - 1, 0)), F.col("latency_ms")))
    heads = scores.agg(F.count("*").alias("cases"), F.count_if(F.col("brand_class") == "correct").alias("brand_correct"), F.count_if(F.col("alcohol_class") == "correct").alias("alcohol_correct"), rate(F.count_if(F.col("brand_class") == "false-certainty"), F.count("*")).alias("brand_false_certainty"))
    return heads.crossJoin(upto.agg(at(0.5).alias("p50_floor"), at(0.95).alias("p95_floor")))  # one row by one row


def diagnosis_tallies(cases: DataFrame) -> DataFrame:
    """Tallies of cases by bucketed size, state and orientation."""
    size = F.when(F.col("n_chars") < 200, "short").when(F.col("n_chars") < 2000, "medium").otherwise("long")
    tall = cases.select(F.explode(F.array(F.struct(F.lit("size").alias("dimension"), size.alias("bucket")), F.struct(F.lit("state").alias("dimension"), F.col("state").alias("bucket")), F.struct(F.lit("orientation").alias("dimension"), F.col("orientation").alias("bucket")))).alias("x"))
    return tall.groupBy("x.dimension", "x.bucket").agg(F.count("*").alias("n"))
