"""Append-only logs and ordered tables: windows, chains, ranks and stable orders."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from auditloom.sources.tables import shared_dir

# Which status may follow which.
TRANSITIONS = [("claim", "release"), ("claim", "internally_accepted"), ("claim", "changes_requested"), ("release", "claim"), ("changes_requested", "waiting_for_agent_review"), ("waiting_for_agent_review", "claim")]


def truth_rank(observations: DataFrame, k: int = 3) -> DataFrame:
    """Place of the right answer among value and alternates (from 1; null: not there). observations: case_id, value, alternates, truth."""
    ranked = F.concat(F.array("value"), F.coalesce("alternates", F.array().cast("array<string>")))
    at = F.array_position(ranked, F.col("truth"))
    return observations.select("case_id", F.when(at > 0, at).cast("long").alias("rank"), (F.coalesce(at, F.lit(0)).between(1, k)).alias("in_top"))


def first_seen_tokens(words: DataFrame) -> DataFrame:
    """Tokens that each pass of a case is the first to bring. words: case_id, pass_order, token."""
    first = words.groupBy("case_id", "token").agg(F.min("pass_order").alias("pass_order"))
    return first.groupBy("case_id", "pass_order").agg(F.count("*").alias("new_tokens"))


def cumulative_cost(passes: DataFrame) -> DataFrame:
    """Running cost of each case by pass order."""
    w = Window.partitionBy("case_id").orderBy("pass_order").rowsBetween(Window.unboundedPreceding, 0)
    return passes.select("case_id", "pass_order", F.sum("execution_ms").over(w).alias("cost"))


def prefix_selection(candidates: DataFrame, truth: DataFrame, most: int = 5) -> DataFrame:
    """The best candidate after each prefix of passes, whether it changed, and whether the case is right for the first time. candidates: case_id, pass, value, score; truth: case_id, truth (a row a case)."""
    w = Window.partitionBy("case_id").orderBy("pass")
    best = candidates.filter(F.col("pass") <= most).groupBy("case_id", "pass").agg(F.max(F.struct("score", "value")).alias("b"))
    upto = best.withColumn("b", F.max("b").over(w.rowsBetween(Window.unboundedPreceding, 0))).join(truth, "case_id", "left")
    right = upto.withColumn("right", F.coalesce(F.col("b.value") == F.col("truth"), F.lit(False))).withColumn("before", F.coalesce(F.max("right").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)))
    return right.select("case_id", "pass", F.col("b.value").alias("value"), F.coalesce(F.lag("b.value").over(w) != F.col("b.value"), F.lit(False)).alias("changed"), (F.col("right") & ~F.col("before")).alias("newly_correct"))


def history_issues(log: DataFrame) -> DataFrame:
    """Entries whose sequence has a gap or repeat, or whose id repeats in its log."""
    w = Window.partitionBy("log_key").orderBy("sequence", "entry_id")
    ids = log.groupBy("log_key", "entry_id").agg(F.count("*").alias("n"))
    numbered = log.withColumn("due", F.row_number().over(w)).join(ids, ["log_key", "entry_id"])
    issue = F.when(F.col("sequence") != F.col("due"), "sequence").when(F.col("n") > 1, "repeated_id")
    return numbered.select("log_key", "sequence", issue.alias("issue")).filter("issue IS NOT NULL")


def append_log(log: DataFrame, new: DataFrame) -> DataFrame:
    """The new entries with the sequence numbers that follow their log's; entries whose id is there already are left out."""
    last = log.groupBy("log_key").agg(F.max("sequence").alias("last"))
    fresh = new.join(log.select("log_key", "entry_id"), ["log_key", "entry_id"], "left_anti").dropDuplicates(["log_key", "entry_id"])
    n = F.row_number().over(Window.partitionBy("log_key").orderBy("entry_id"))
    return fresh.join(last, "log_key", "left").select("log_key", (F.coalesce("last", F.lit(0)) + n).cast("long").alias("sequence"), "entry_id")


def status_transitions(events: DataFrame) -> DataFrame:
    """Each event with the status before, whether it may follow, and the seconds between."""
    w = Window.partitionBy("submission_id").orderBy("recorded_at", "event_id")
    legal = events.sparkSession.createDataFrame([(*t, True) for t in TRANSITIONS], "before string, action string, legal boolean")
    at = events.withColumn("before", F.lag("action").over(w)).withColumn("dwell", (F.unix_micros(F.col("recorded_at").cast("timestamp")) - F.unix_micros(F.lag("recorded_at").over(w).cast("timestamp"))))
    return at.join(F.broadcast(legal), ["before", "action"], "left").select("event_id", "submission_id", "before", "action", (F.col("before").isNull() | F.coalesce("legal", F.lit(False))).alias("legal"), F.col("dwell").alias("dwell_us"))


def version_chain_issues(decisions: DataFrame) -> DataFrame:
    """Decisions that don't continue the version before, or decide a revision twice. decisions: submission_id, revision_number, version_before, version_after, decision_id."""
    w = Window.partitionBy("submission_id").orderBy("version_after", "decision_id")
    twice = decisions.groupBy("submission_id", "revision_number").agg(F.count("*").alias("n"))
    at = decisions.withColumn("last", F.lag("version_after").over(w)).join(twice, ["submission_id", "revision_number"])
    issue = F.when(F.col("version_after") != F.col("version_before") + 1, "step").when(F.col("last").isNotNull() & (F.col("version_before") != F.col("last")), "gap").when(F.col("n") > 1, "decided_twice")
    return at.select("decision_id", issue.alias("issue")).filter("issue IS NOT NULL")


def monotonic_growth(runs: DataFrame, least: int = 3) -> DataFrame:
    """Runs whose measure never falls, rises once at least, and has enough values. runs: run_id, sequence, measure."""
    w = Window.partitionBy("run_id").orderBy("sequence")
    step = F.col("measure") - F.lag("measure").over(w)
    return runs.withColumn("step", step).groupBy("run_id").agg(F.count("*").alias("n"), ((F.count("*") >= least) & F.coalesce(F.bool_and(F.col("step") >= 0), F.lit(False)) & F.coalesce(F.bool_or(F.col("step") > 0), F.lit(False))).alias("grows"))


def top_candidates(candidates: DataFrame, n: int = 24) -> DataFrame:
    """At most n candidates of each case, by priority, score and id."""
    w = Window.partitionBy("case_id").orderBy("priority", F.desc("score"), "candidate_id", "field", "value")
    return candidates.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= n)


def pool_passes(base: DataFrame, extra: DataFrame) -> DataFrame:
    """Baseline passes followed by extra ones."""
    return base.withColumn("pool", F.lit("base")).unionByName(extra.withColumn("pool", F.lit("extra")))


def global_ranks(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds rank (from 1) in the order of some columns over the whole table.

    Rows are dealt by ranges of the order, as many as their size asks for; each range is numbered by itself and starts behind
    the rows of all ranges before it, of which only the numbers meet in one place. Ties are broken by all other columns.
    """
    shared_dir(rows.sparkSession)
    every = [*order, *(c for c in rows.columns if c not in order)]
    dealt = rows.repartitionByRange(*every).withColumn("_range", F.spark_partition_id()).checkpoint()
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.select(F.col("_range").alias("_at"), F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*every))
    return dealt.withColumn("_own", inside).join(F.broadcast(before), F.col("_range") == F.col("_at")).withColumn("rank", F.col("_before") + F.col("_own")).select(*rows.columns, "rank")  # a row for each range


def counterbalanced_order(cases: DataFrame, seed: str) -> DataFrame:
    """Two blocks in which every case stands once, in opposite modes; half of the cases start in mode A. cases: case_id, unique. The random order is that of a digest."""
    ranked = global_ranks(cases.select("case_id", F.md5(F.concat_ws("|", F.lit(seed), F.col("case_id").cast("string"))).alias("h")), ["h"])
    mode = lambda flip: F.when((F.col("rank") % 2 == 1) != F.lit(flip), "A").otherwise("B")
    return ranked.select("case_id", "rank", F.explode(F.array(F.struct(F.lit(1).alias("block"), mode(False).alias("mode")), F.struct(F.lit(2).alias("block"), mode(True).alias("mode")))).alias("x")).select("case_id", "rank", "x.block", "x.mode")


def idempotent_ingest(events: DataFrame) -> DataFrame:
    """The batch twin of the stream: each event is accepted, a replay (same key and hash as the key's first) or a conflict."""
    w = Window.partitionBy("idem_key").orderBy("recorded_at", "event_id")
    first = F.first("request_hash").over(w.rowsBetween(Window.unboundedPreceding, 0))
    outcome = F.when(F.row_number().over(w) == 1, "accepted").when(F.col("request_hash") == first, "replay").otherwise("conflict")
    return events.select("event_id", "idem_key", outcome.alias("outcome"))


def carried(rows: DataFrame, key: str, order: list[str], columns: list[str], start: tuple, step: Callable[[tuple, tuple], tuple[tuple, tuple]], new: str) -> DataFrame:
    """Rows of each key in order, with what a step says of each: a state is carried from row to row, and none but it is held, however many rows a key has.

    step: (state, values of `columns`) to (state, values of the new columns); new: their names and types. Adds the new columns.
    """
    ordered = rows.repartition(F.xxhash64(key)).sortWithinPartitions(key, *order)  # hashed: see extraction.group_lines
    schema = T.StructType([*ordered.schema.fields, *T.StructType.fromDDL(new).fields])
    kinds, names = [to_arrow_type(f.dataType) for f in T.StructType.fromDDL(new).fields], [f.name for f in schema.fields]
    at, key_at = [ordered.columns.index(c) for c in columns], ordered.columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, now, state = False, None, start
        for batch in batches:
            out = []
            for k, *values in zip(batch.column(key_at).to_pylist(), *(batch.column(i).to_pylist() for i in at)):
                if not begun or k != now:
                    begun, now, state = True, k, start
                state, told = step(state, tuple(values))
                out.append(told)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * len(kinds), kinds))], names=names)

    return ordered.mapInArrow(run, schema)


def append_head(log: DataFrame) -> DataFrame:
    """The batch twin of the stream: an append stands (outcome accepted) if it names the entry that is its log's head, and then is the head; else it is stale. log: log_key, sequence, entry_id, names."""

    def step(state: tuple, row: tuple) -> tuple[tuple, tuple]:
        (head,), (entry, names) = state, row
        good = names == head
        head = entry if good else head
        return (head,), ("accepted" if good else "stale", head)

    return carried(log, "log_key", ["sequence", "entry_id"], ["entry_id", "names"], ("",), step, "outcome string, head string").select("log_key", "sequence", "entry_id", "outcome", "head")


def review_state(events: DataFrame) -> DataFrame:
    """The batch twin of the stream: (event_id, submission_id, outcome, status, version) of each action on a submission."""
    told = carried(events, "submission_id", ["recorded_at", "event_id"], ["action"], REVIEW_START, review_step, "outcome string, status string, version long")
    return told.select("event_id", "submission_id", "outcome", "status", "version")


#: Status, version and whether a submission is claimed, before its first action.
REVIEW_START = ("waiting_for_agent_review", 0, False)


def review_step(state: tuple, row: tuple) -> tuple[tuple, tuple]:
    """What an action makes of a submission.

    A claim needs a waiting submission that nobody holds; release and decisions need a claim; asking for changes ends in
    changes_requested until the submission waits again.
    """
    (status, version, held), (action,) = state, row
    if status == "internally_accepted":
        outcome = "closed"
    elif action == "claim":
        outcome = "already_claimed" if held else "accepted" if status == "waiting_for_agent_review" else "not_waiting"
    elif action == "waiting_for_agent_review":
        outcome = "accepted" if status == "changes_requested" else "not_requested"
    else:
        outcome = "accepted" if held else "not_claimed"
    if outcome == "accepted":
        status, version, held = {"claim": "in_agent_review", "release": "waiting_for_agent_review"}.get(action, action), version + 1, action == "claim"
    return (status, version, held), (outcome, status, version)


def issue_rows(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """One row (key, issue) for each rule that a row breaks; nulls break nothing."""
    return rows.select(key, F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))).alias("issue"))


def duplicate_digests(entries: DataFrame) -> DataFrame:
    """Digests with several rows, and their owners."""
    return entries.groupBy("digest").agg(F.count("*").alias("n"), F.countDistinct("owner").alias("owners"), F.min("case_id").alias("first_case")).filter("n > 1")


def id_range_gaps(rows: DataFrame, key: str, first: int, last: int) -> DataFrame:
    """Missing and repeated ids of a range."""
    want = rows.sparkSession.range(first, last + 1).withColumnRenamed("id", key)
    missing = want.join(rows.select(key), key, "left_anti").select(key, F.lit("missing").alias("issue"))
    return missing.unionByName(rows.groupBy(key).count().filter("count > 1").select(key, F.lit("repeated").alias("issue")))


def category_coverage(entries: DataFrame, required: list[str], each: int) -> DataFrame:
    """Entries of each required category, zero too, and whether there are as many as asked for."""
    want = entries.sparkSession.createDataFrame([(c,) for c in required], "category string")
    return want.join(entries.groupBy("category").agg(F.count("*").alias("n")), "category", "left").select("category", F.coalesce("n", F.lit(0)).cast("long").alias("n"), (F.coalesce("n", F.lit(0)) >= each).alias("met"))


def candidate_accounting(entries: DataFrame) -> DataFrame:
    """Complete, pending and excluded entries, and the reason for each exclusion."""
    reason = F.when(F.col("category").isNull(), "no_category").when(F.col("completed_at").isNull(), "not_completed").when(F.col("has_issue"), "has_issue").otherwise("primary")
    return entries.groupBy(reason.alias("state")).agg(F.count("*").alias("n"), F.countDistinct("owner").alias("owners"))


def evidence_gate(facts: DataFrame, flags: list[str], counters: list[str]) -> DataFrame:
    """Flags that aren't all true and counters that aren't zero, over all rows."""
    parts = [F.struct(F.lit(c).alias("gate"), F.col(c).alias("ok")) for c in flags] + [F.struct(F.lit(c).alias("gate"), (F.col(c) == 0).alias("ok")) for c in counters]
    return facts.select(F.explode(F.array(*parts)).alias("x")).groupBy("x.gate").agg(F.bool_and("x.ok").alias("passed"), F.count_if(~F.col("x.ok")).alias("failures"))
