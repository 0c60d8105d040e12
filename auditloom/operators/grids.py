"""Benchmark grids, funnels, trial logs and boxes: grouped counts with zero-filled vocabularies."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.operators.spatial import Leading, leading_met, met

from auditloom.functions.scores import nearest_rank, rate


def scenario_metrics(results: DataFrame) -> DataFrame:
    """Field x scenario x scale grid; cells without rows are kept, with null rates."""
    grid = results.select("field").distinct().crossJoin(results.select("scenario").distinct()).crossJoin(results.select("scale").distinct())  # three small vocabularies
    cells = results.groupBy("field", "scenario", "scale").agg(
        F.count("*").alias("n"), F.count_if("truth_present").alias("present"), F.count_if("correct").alias("correct"), F.sum("tokens_present").alias("tokens"), F.avg("similarity").alias("similarity"), nearest_rank("latency_ms", 0.5).alias("p50"), nearest_rank("latency_ms", 0.95).alias("p95")
    )
    joined = grid.join(cells, ["field", "scenario", "scale"], "left")
    n = F.coalesce("n", F.lit(0))
    return joined.select("field", "scenario", "scale", n.cast("long").alias("n"), F.coalesce("present", F.lit(0)).cast("long").alias("present"), rate(F.col("correct"), n, None).alias("correct_rate"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"), F.round("similarity", 6).alias("similarity"), "p50", "p95")


def contribution_metrics(results: DataFrame) -> DataFrame:
    """Flag counts and mean tokens by field, scenario and scale."""
    return results.groupBy("field", "scenario", "scale").agg(F.countDistinct("case_id").alias("cases"), F.count_if("correct").alias("correct"), F.count_if(F.col("tokens_present") > 0).alias("any_token"), F.count_if(F.col("tokens_present") == F.col("tokens")).alias("all_tokens"), F.round(F.avg("tokens_present"), 6).alias("mean_tokens"))


def recovery_ledger(results: DataFrame) -> DataFrame:
    """(scenario, field, case_id, n) of each case and field that the baseline got wrong and a scenario got right; n: how many the scenario and field have."""
    base = results.filter("scenario = 'baseline'").groupBy("case_id", "field").agg(F.bool_or("correct").alias("base"))
    later = results.filter("scenario <> 'baseline'").groupBy("case_id", "field", "scenario").agg(F.bool_or("correct").alias("now"))
    won = later.join(base, ["case_id", "field"]).filter("now AND NOT base")
    return won.join(won.groupBy("scenario", "field").agg(F.count("*").alias("n")), ["scenario", "field"]).select("scenario", "field", "case_id", "n")


def regression_summary(results: DataFrame) -> DataFrame:
    """What got worse than the baseline, by scenario and by scenario and scale (scale null: all scales)."""
    base = results.filter("scenario = 'baseline'").groupBy("case_id", "field").agg(F.bool_or("correct").alias("base"))
    worse = results.filter("scenario <> 'baseline'").join(base, ["case_id", "field"]).filter("base AND NOT correct")
    return worse.groupingSets([["scenario"], ["scenario", "scale"]], "scenario", "scale").agg(F.count("*").alias("n"), F.countDistinct("case_id").alias("cases"))


def scale_analysis(results: DataFrame, reference: float = 1.5) -> DataFrame:
    """Each scale against the reference scale: improved, worsened, unchanged cases."""
    per = results.groupBy("case_id", "field", "scale").agg(F.bool_or("correct").alias("correct"))
    ref = per.filter(F.col("scale") == reference).select("case_id", "field", F.col("correct").alias("ref"))
    both = per.filter(F.col("scale") != reference).join(ref, ["case_id", "field"])
    return both.groupBy("scale").agg(F.count_if(F.col("correct") & ~F.col("ref")).alias("improved"), F.count_if(~F.col("correct") & F.col("ref")).alias("worsened"), F.count_if(F.col("correct") == F.col("ref")).alias("unchanged"))


def latency_comparison(results: DataFrame) -> DataFrame:
    """Matched medians of baseline, added and combined latency by scenario."""
    base = results.filter("scenario = 'baseline'").groupBy("case_id", "field").agg(F.min("latency_ms").alias("base"))
    later = results.filter("scenario <> 'baseline'").groupBy("case_id", "field", "scenario").agg(F.min("latency_ms").alias("extra"))
    both = later.join(base, ["case_id", "field"]).withColumn("both", F.col("base") + F.col("extra"))
    m = both.groupBy("scenario").agg(F.count("*").alias("n"), nearest_rank("base", 0.5).alias("base"), nearest_rank("extra", 0.5).alias("extra"), nearest_rank("`both`", 0.5).alias("combined"))
    return m.withColumn("delta", F.col("combined") - F.col("base"))


def challenge_slices(results: DataFrame, slices: dict[str, str]) -> DataFrame:
    """Correct counts by slice, field and scenario; a row may be in several slices."""
    member = F.explode(F.array_compact(F.array(*[F.when(F.expr(c), F.lit(k)) for k, c in slices.items()])))
    return results.withColumn("slice", member).groupBy("slice", "field", "scenario").agg(F.count("*").alias("n"), F.count_if("correct").alias("correct"))


def annotation_coverage(results: DataFrame) -> DataFrame:
    """Present and absent truths and cases by field."""
    return results.groupBy("field").agg(F.count_if("truth_present").alias("present"), F.count_if(~F.col("truth_present")).alias("absent"), F.countDistinct("case_id").alias("cases"), F.count_if(F.col("similarity") >= 40).alias("sure"))


def best_scenario(results: DataFrame) -> DataFrame:
    """The scenario of the best outcome for each case and field; ties by similarity, then least latency, scenario, scale."""
    score = F.when(F.col("correct"), 3).when(F.col("tokens_present") == F.col("tokens"), 2).when(F.col("tokens_present") > 0, 1).otherwise(0)
    rank = F.struct(score.alias("outcome"), "similarity", (-F.col("latency_ms")).alias("speed"), "scenario", "scale")
    return results.groupBy("case_id", "field").agg(F.max(rank).alias("b")).select("case_id", "field", "b.outcome", "b.similarity", "b.scenario", "b.scale")


def survival_funnel(traces: DataFrame, stages: list[str]) -> DataFrame:
    """How many traces are left after each stage; a trace lost at a stage never comes back."""
    alive, parts = F.lit(True), []
    for i, s in enumerate(stages):
        alive = alive & F.col(s)
        parts.append(F.struct(F.lit(i + 1).alias("stage"), F.lit(s).alias("name"), alive.cast("long").alias("alive")))
    return traces.select(F.explode(F.array(*parts)).alias("x")).groupBy("x.stage", "x.name").agg(F.sum("x.alive").alias("alive"), F.count("*").alias("of"))


def terminal_category(traces: DataFrame, stages: list[str]) -> DataFrame:
    """Where traces end: the first stage that fails, or survived; empty categories too."""
    end = F.coalesce(*[F.when(~F.col(s), F.lit(f"lost_{s}")) for s in stages], F.lit("survived"))
    names = traces.sparkSession.createDataFrame([(f"lost_{s}",) for s in stages] + [("survived",), ("unknown",)], "category string")
    return names.join(traces.groupBy(end.alias("category")).agg(F.count("*").alias("n")), "category", "left").select("category", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def routing_matrix(traces: DataFrame, keys: list[str]) -> DataFrame:
    """Traces and recovered ones by all keys."""
    return traces.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if("recovered").alias("n_recovered"), F.min("target_id").alias("first_target"))


def class_crosstab(traces: DataFrame) -> DataFrame:
    """Two classifications side by side."""
    return traces.groupBy("class_a", "class_b").agg(F.count("*").alias("n"))


def proposal_sources(traces: DataFrame) -> DataFrame:
    """Targets that each source reached, and its proposals with conflicting classes."""
    return traces.groupBy("source").agg(F.countDistinct(F.when(F.col("proposed"), F.col("target_id"))).alias("targets"), F.count_if(F.col("class_a") != F.col("class_b")).alias("conflicting"))


def repetition_summary(results: DataFrame, repetitions: int) -> DataFrame:
    """For each case and field: hits over all repetitions (a missing one is a miss), any, all, and similarity extremes with the true median."""
    hits = results.groupBy("case_id", "field", "repetition").agg(F.bool_or("correct").alias("hit"), F.max("similarity").alias("similarity"))
    return hits.filter(F.col("repetition") <= repetitions).groupBy("case_id", "field").agg(F.count_if("hit").alias("hits"), F.bool_or("hit").alias("any_hit"), ((F.count_if("hit")) == repetitions).alias("all_hit"), F.min("similarity").alias("low"), F.expr("percentile(similarity, 0.5)").alias("median"), F.max("similarity").alias("high"))


def arm_summary(results: DataFrame) -> DataFrame:
    """Recall, failures and a decision for each scenario."""
    m = results.groupBy(F.col("scenario").alias("arm")).agg(F.count_if(F.col("truth_present")).alias("present"), rate(F.count_if(F.col("truth_present") & F.col("correct")), F.count_if("truth_present")).alias("recall"), F.count_if(F.col("failure_class") == "false-certainty").alias("false_certainties"), nearest_rank("latency_ms", 0.95).alias("p95"))
    return m.withColumn("decision", F.when(F.col("recall") < 0.33, "reject").when(F.col("p95") > 480, "slow").otherwise("accept"))


def code_counts(results: DataFrame) -> DataFrame:
    """Rows and cases by failure class."""
    return results.groupBy("failure_class").agg(F.count("*").alias("n"), F.countDistinct("case_id").alias("cases"))


def contract_findings(trials: DataFrame) -> DataFrame:
    """States and latency statistics by contract."""
    n = lambda s: F.count_if(F.col("state") == s)
    return trials.groupBy("contract").agg(F.count("*").alias("n"), n("TIMELY_VALID_COMPLETION").alias("timely"), n("LATE_VALID_COMPLETION").alias("late"), n("HARD_NON_COMPLETION").alias("hard"), F.round(F.avg("latency_ms"), 4).alias("mean"), F.round(F.stddev_pop("latency_ms"), 4).alias("stddev"), F.round(F.expr("percentile(latency_ms, 0.5)"), 6).alias("median"), nearest_rank("latency_ms", 0.95).alias("p95"))


def position_findings(trials: DataFrame) -> DataFrame:
    """Contract x position grid of trials and completions."""
    return trials.groupBy("contract", "position").agg(F.count("*").alias("n"), F.count_if(F.col("state") != "HARD_NON_COMPLETION").alias("completed"))


def block_comparisons(trials: DataFrame) -> DataFrame:
    """A against A' in each block: outcome, difference and percentage of latency."""
    done = F.col("state") != "HARD_NON_COMPLETION"
    p = trials.groupBy("block").agg(*[F.max(F.when(F.col("contract") == c, x)).alias(f"{n}_{k}") for c, n in (("A", "a"), ("A_PRIME", "b")) for k, x in (("done", done), ("ms", F.col("latency_ms")))])
    outcome = F.when(F.col("a_done").isNull() | F.col("b_done").isNull(), "incomplete").when(F.col("a_done") & F.col("b_done"), "both").when(F.col("a_done"), "only_a").when(F.col("b_done"), "only_b").otherwise("neither")
    return p.select("block", outcome.alias("outcome"), F.round(F.col("b_ms") - F.col("a_ms"), 6).alias("difference"), F.round(F.when(F.col("a_ms") != 0, (F.col("b_ms") - F.col("a_ms")) / F.col("a_ms") * 100), 4).alias("percent"))


def effect_decision(blocks: DataFrame, least: int = 10) -> DataFrame:
    """One row: whether the blocks support an effect of B, contradict it, show none, or are too few."""
    n = blocks.agg(F.count_if(F.col("outcome") == "only_b").alias("for_b"), F.count_if(F.col("outcome") == "only_a").alias("for_a"), F.count_if(F.col("outcome") != "incomplete").alias("complete"))
    return n.withColumn("decision", F.when(F.col("complete") < least, "insufficient").when(F.col("for_b") > 1.2 * F.col("for_a"), "supported").when(F.col("for_a") > 1.2 * F.col("for_b"), "contradicted").otherwise("none"))


def pairwise_latency(trials: DataFrame, ratio: float = 1.5) -> DataFrame:
    """Latency at positions 1 and 3 of each block: how many blocks shift by the ratio either way."""
    one, three = trials.filter("position = 1").select("block", F.col("latency_ms").alias("first")), trials.filter("position = 3").select("block", F.col("latency_ms").alias("last"))
    both = one.join(three, "block")
    return both.agg(F.count("*").alias("pairs"), F.count_if(F.col("last") > ratio * F.col("first")).alias("slower"), F.count_if(F.col("first") > ratio * F.col("last")).alias("faster"))


def schedule_audit(trials: DataFrame) -> DataFrame:
    """Blocks that lack a position, repeat a contract or are out of order."""
    w = Window.partitionBy("block").orderBy("position")
    at = trials.withColumn("late", F.lag("sequence").over(w) > F.col("sequence"))
    b = at.groupBy("block").agg(F.count("*").alias("n"), F.countDistinct("position").alias("positions"), F.countDistinct("contract").alias("contracts"), F.coalesce(F.bool_or("late"), F.lit(False)).alias("late"))
    issue = F.when(F.col("positions") < 3, "missing").when(F.col("n") > 3, "repeated").when(F.col("contracts") < 3, "wrong_permutation").when(F.col("late"), "out_of_order")
    return b.select("block", issue.alias("issue")).filter("issue IS NOT NULL")


def run_aggregate(trials: DataFrame) -> DataFrame:
    """Counts and maxima over all trials, and whether every block got through."""
    return trials.agg(F.count("*").alias("n"), F.countDistinct("block").alias("blocks"), F.max("latency_ms").alias("worst"), F.count_if(F.col("state") == "HARD_NON_COMPLETION").alias("hard"), F.bool_and(F.col("state") != "HARD_NON_COMPLETION").alias("clean"))


def inventory_summary(entries: DataFrame) -> DataFrame:
    """Entries by category, by status and overall, told apart by `level`."""
    g = entries.groupingSets([["category"], ["status"], []], "category", "status").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    return g.select(F.when(F.col("g") == 1, "category").when(F.col("g") == 2, "status").otherwise("all").alias("level"), F.coalesce("category", "status").alias("key"), "n")


def bounding_union(boxes: DataFrame) -> DataFrame:
    """The box around each case's boxes."""
    return boxes.groupBy("case_id").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def rounded(x: Column, places: int) -> Column:
    """Doubles as SQL engines round them in binary: the product, to the next whole number with halves away from zero, divided again. Spark rounds the shortest decimal, which differs at halves."""
    y = x * F.lit(10.0**places)
    whole = F.when(F.abs(y - F.rint(y)) == 0.5, y + F.signum(y) * 0.5).otherwise(F.rint(y))
    return F.when(F.abs(y) < F.lit(float("inf")), whole / F.lit(10.0**places)).otherwise(x)


def rounded_array(x: np.ndarray, places: int) -> np.ndarray:
    """The same for arrays."""
    with np.errstate(invalid="ignore", over="ignore"):
        y = x * 10.0**places
        whole = np.rint(y)
        return np.where(np.isfinite(y), np.where(np.abs(y - whole) == 0.5, y + np.sign(y) * 0.5, whole) / 10.0**places, x)


class ByCoverage(Leading):
    """Proposals of a target by coverage, then smaller area, then id."""

    slack = 1.1e-9

    def __init__(self, right: list[np.ndarray], least: float) -> None:
        super().__init__(right)
        self.least = least

    def near(self, left: tuple[np.ndarray, ...], right: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        _, x0, y0, x1, y1 = left
        _, u0, v0, u1, v1 = (c[:, None] for c in right)
        wide, high = np.minimum(x1, u1) - np.maximum(x0, u0), np.minimum(y1, v1) - np.maximum(y0, v0)
        cx, cy = (u0 + u1) / 2, (v0 + v1) / 2
        common = np.maximum(0.0, wide) * np.maximum(0.0, high)
        area, other = (x1 - x0) * (y1 - y0), (u1 - u0) * (v1 - v0)
        with np.errstate(divide="ignore", invalid="ignore"):
            coverage = common / other
            counts = (wide >= 0) & (high >= 0) & ((coverage >= self.least) | (cx >= x0) & (cx <= x1) & (cy >= y0) & (cy <= y1))
            found = self.good(coverage, common, area, other)
        good = np.where(counts, found[0], -np.inf)
        good[np.isnan(good)] = np.inf  # boxes without area: not ours to leave out
        return good, *found[1:]

    def good(self, coverage: np.ndarray, common: np.ndarray, area: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, ...]:
        return coverage, coverage

    def exact(self, left: tuple[np.ndarray, ...], *found: np.ndarray) -> np.ndarray:
        return np.nan_to_num(rounded_array(found[0], 9), nan=np.inf, posinf=np.inf, neginf=-np.inf)

    def ties(self, left: tuple[np.ndarray, ...]) -> np.ndarray:
        _, x0, y0, x1, y1 = left
        return rounded_array((x1 - x0) * (y1 - y0), 9)


class ByScore(ByCoverage):
    """Proposals of a target by the weighted overlap of `best_proposal`, then id."""

    slack = 1.3e-7

    def good(self, coverage: np.ndarray, common: np.ndarray, area: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, ...]:
        precision, iou = common / area, common / (area + other - common)
        return 10 * coverage + 5 * precision + 3 * iou - 0.25 * area, coverage, precision, iou

    def exact(self, left: tuple[np.ndarray, ...], *found: np.ndarray) -> np.ndarray:
        _, x0, y0, x1, y1 = left
        coverage, precision, iou = (rounded_array(x, 9) for x in found)
        score = 10 * coverage + 5 * precision + 3 * iou - 0.25 * rounded_array((x1 - x0) * (y1 - y0), 9)
        return np.nan_to_num(rounded_array(score, 7), nan=np.inf, posinf=np.inf, neginf=-np.inf)

    def ties(self, left: tuple[np.ndarray, ...]) -> np.ndarray:
        return np.zeros(len(left[0]))


def overlap_join(boxes: DataFrame, least: float = 0.08, leading: type[ByCoverage] | None = None) -> DataFrame:
    """Pairs of a case's proposals and targets with enough of the target covered, or its centre inside.

    `leading` leaves out pairs that aren't the first of their target in its order, before there is a row for any of them; some that aren't can stay.
    """
    sides = ("x0", "y0", "x1", "y1")
    p, t = (boxes.filter(F.col("role") == role).select("case_id", "vec_id", *sides) for role in ("proposal", "target"))
    wide = F.greatest(F.lit(0.0), F.least("l.x1", "r.x1") - F.greatest("l.x0", "r.x0"))
    high = F.greatest(F.lit(0.0), F.least("l.y1", "r.y1") - F.greatest("l.y0", "r.y0"))
    area = lambda b: (F.col(f"{b}.x1") - F.col(f"{b}.x0")) * (F.col(f"{b}.y1") - F.col(f"{b}.y0"))
    cx, cy = (F.col("r.x0") + F.col("r.x1")) / 2, (F.col("r.y0") + F.col("r.y1")) / 2
    centre = (cx >= F.col("l.x0")) & (cx <= F.col("l.x1")) & (cy >= F.col("l.y0")) & (cy <= F.col("l.y1"))
    pairs = met(p, t, ["case_id"]) if leading is None else leading_met(p, t, ["case_id"], "vec_id", partial(leading, least=least))
    both = pairs.withColumn("common", wide * high).withColumn("coverage", F.col("common") / area("r")).filter((F.col("coverage") >= least) | centre)
    return both.select("case_id", F.col("l.vec_id").alias("proposal"), F.col("r.vec_id").alias("target"), rounded(F.col("coverage"), 9).alias("coverage"), rounded(F.col("common") / area("l"), 9).alias("precision"), rounded(F.col("common") / (area("l") + area("r") - F.col("common")), 9).alias("iou"), rounded(area("l"), 9).alias("area"))


def leading(rows: DataFrame, key: list[str], order: list[tuple[str, str]]) -> DataFrame:
    """Rows without those that a row of their own batch and key comes before, by (column, ascending or descending), nulls last. So rows of one key shrink where they are made, before any sort or shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = batch.take(pc.sort_indices(batch, sort_keys=[*((k, "ascending") for k in key), *order]))
                new = np.zeros(found.num_rows, bool)
                new[0] = True
                for k in key:
                    column = found.column(k)
                    new[1:] |= pc.fill_null(pc.not_equal(column[1:], column[:-1]), True).to_numpy(zero_copy_only=False)
                yield found.filter(pa.array(new))

    return rows.mapInArrow(run, rows.schema)


def best_proposal(pairs: DataFrame) -> DataFrame:
    """The proposal of the best weighted overlap for each target."""
    score = rounded(10 * F.col("coverage") + 5 * F.col("precision") + 3 * F.col("iou") - 0.25 * F.col("area"), 7)
    few = leading(pairs.select("target", "proposal", "coverage", score.alias("score")), ["target"], [("score", "descending"), ("proposal", "ascending")])
    return few.groupBy("target").agg(F.max(F.struct("score", (-F.col("proposal")).alias("p"), "coverage")).alias("b")).select("target", (-F.col("b.p")).alias("proposal"), "b.score", (F.col("b.coverage") >= 0.5).alias("hit"))


def representatives(pairs: DataFrame) -> DataFrame:
    """Best proposal by coverage, then smaller area, then id."""
    few = leading(pairs.select("target", "proposal", "coverage", "area"), ["target"], [("coverage", "descending"), ("area", "ascending"), ("proposal", "ascending")])
    w = Window.partitionBy("target").orderBy(F.desc("coverage"), "area", "proposal")
    return few.withColumn("k", F.row_number().over(w)).filter("k = 1").select("target", "proposal", "coverage")


def matching_views(pairs: DataFrame) -> DataFrame:
    """Any match against a single representative: one row a case."""
    any_ = pairs.groupBy("case_id").agg(F.countDistinct("target").alias("any_match"), F.round(F.avg("coverage"), 6).alias("mean"), F.max("coverage").alias("best"))
    few = leading(pairs.select("case_id", "proposal", "coverage", "target"), ["case_id", "proposal"], [("coverage", "descending"), ("target", "descending")])
    once = few.groupBy("case_id", "proposal").agg(F.max(F.struct("coverage", "target")).alias("b")).groupBy("case_id").agg(F.countDistinct("b.target").alias("strict_match"))
    return any_.join(once, "case_id")


def boxes_to_grid(boxes: DataFrame, columns: int, rows: int) -> DataFrame:
    """One row for each cell that a box touches."""
    at = lambda c, n: F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor(F.col(c) * n))).cast("int")
    spread = boxes.withColumn("column", F.explode(F.sequence(at("x0", columns), at("x1", columns)))).withColumn("row", F.explode(F.sequence(at("y0", rows), at("y1", rows))))
    return spread.select("vec_id", "column", "row")


def pad_regions(boxes: DataFrame, ratio: float = 0.04) -> DataFrame:
    """Boxes with a halo, clamped to the frame."""
    return boxes.select("vec_id", *[F.round(F.greatest(F.lit(0.0), F.col(c) - ratio), 9).alias(c) for c in ("x0", "y0")], *[F.round(F.least(F.lit(1.0), F.col(c) + ratio), 9).alias(c) for c in ("x1", "y1")])
