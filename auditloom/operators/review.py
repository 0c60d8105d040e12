"""Review tables: queues, revision diffs, snapshots and reconciliation joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.operators.dealing import dealt

# The statuses of each queue.
QUEUES = {"waiting": ["waiting_for_agent_review"], "in_review": ["in_agent_review"], "changes": ["changes_requested"], "done": ["internally_accepted"]}


def queue_filter(submissions: DataFrame, queue: str, demo: bool = False) -> DataFrame:
    """Submissions of a queue; an unknown queue is the waiting one; demo rows on request alone."""
    found = submissions.filter(F.col("current_status").isin(QUEUES.get(queue, QUEUES["waiting"])))
    return found if demo else found.filter(~F.col("is_demo"))


def latest_revision(revisions: DataFrame) -> DataFrame:
    """The revision of the highest number of each submission; one aggregate, no sort."""
    last = F.max_by(F.struct("revision_number", "submitted_by", "submitted_at"), "revision_number")
    return revisions.groupBy("submission_id").agg(last.alias("r")).select("submission_id", "r.*")


def strict_truth_join(truth: DataFrame, scores: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Truth with its score, and the truth rows that have none."""
    return truth.join(scores, key), truth.join(scores, key, "left_anti")


def page(rows: DataFrame, order: list[Column], number: int, size: int = 25, most: int = 50) -> DataFrame:
    """A page of at most `most` rows, numbered from 1. The order must end in a unique column."""
    size = max(1, min(size, most))
    return rows.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def page_after(rows: DataFrame, order: list[tuple[str, bool]], last: list[Column] | None, size: int = 25, most: int = 50) -> DataFrame:
    """The page of at most `most` rows that comes behind a row. order: columns and whether they ascend, the last one unique and none of them null; last: that row's values, None for the first page.

    What comes before is left out by a predicate on the columns, which reaches the scan, so a page far behind costs no more than the first.
    """
    behind = F.lit(False)
    for i, (c, up) in enumerate(order if last else []):
        same = F.lit(True)
        for (b, _), v in zip(order[:i], last):
            same &= F.col(b) == v
        behind |= same & ((F.col(c) > last[i]) if up else (F.col(c) < last[i]))
    found = rows.filter(behind) if last else rows
    if last:  # implied by the rest, and simple enough for the scan
        c, up = order[0]
        found = found.filter((F.col(c) >= last[0]) if up else (F.col(c) <= last[0]))
    return found.orderBy(*[F.asc(c) if up else F.desc(c) for c, up in order]).limit(max(1, min(size, most)))


def review_queue(submissions: DataFrame, revisions: DataFrame, users: DataFrame, queue: str, number: int, size: int, now: str) -> DataFrame:
    """A page of a queue, oldest first, with the latest revision and who sent it. The page is cut before the join, so a submission without a revision leaves it short."""
    cut = page(queue_filter(submissions, queue), [F.col("created_at"), F.col("submission_id")], number, size)
    asked = revisions.join(F.broadcast(cut.select("submission_id")), "submission_id", "left_semi")  # a page is at most 50 rows
    who = F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.col("email"), F.lit("unknown"))
    joined = cut.join(latest_revision(asked), "submission_id").join(users, F.col("submitted_by") == F.col("user_id"), "left")
    return joined.select("submission_id", "current_status", "revision_number", who.alias("submitter"), (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("created_at")).alias("age_seconds"))


def owner_list(submissions: DataFrame, revisions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Every owner's submissions with the latest revision and the change request for just that revision. decisions: submission_id, revision_number, decision, note."""
    asked = decisions.filter("decision = 'changes_requested'").groupBy("submission_id", "revision_number").agg(F.max("note").alias("change_request"))
    return submissions.join(latest_revision(revisions), "submission_id", "left").join(asked, ["submission_id", "revision_number"], "left").select("creator_id", "submission_id", "current_status", "revision_number", "change_request")


def submission_detail(submissions: DataFrame, revisions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Each submission with its history: revisions in order, number of decisions, whether the latest revision is decided."""
    history = revisions.groupBy("submission_id").agg(F.sort_array(F.collect_list(F.struct("revision_number", "submitted_by"))).alias("history"), F.max("revision_number").alias("latest"))
    decided = decisions.groupBy("submission_id").agg(F.count("*").alias("n_decisions"), F.max("revision_number").alias("last_decided"))
    joined = submissions.join(history, "submission_id", "left").join(decided, "submission_id", "left")
    return joined.select("submission_id", "latest", F.size(F.coalesce("history", F.array().cast("array<struct<revision_number:int,submitted_by:bigint>>"))).cast("long").alias("n_revisions"), F.array_join(F.transform("history", lambda x: x["submitted_by"].cast("string")), ",").alias("submitters"), F.coalesce("n_decisions", F.lit(0)).cast("long").alias("n_decisions"), F.coalesce(F.col("last_decided") == F.col("latest"), F.lit(False)).alias("answered"))


def snapshot_diff(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Rows that are missing, changed or unexpected."""
    e, a = expected.select(key, F.struct("digest", "byte_length").alias("e")), actual.select(key, F.struct("digest", "byte_length").alias("a"))
    status = F.when(F.col("a").isNull(), "missing").when(F.col("e").isNull(), "unexpected").when(~F.col("e").eqNullSafe(F.col("a")), "changed").otherwise("matched")
    return e.join(a, key, "full").select(key, status.alias("status"))


def snapshot_verdict(diff: DataFrame) -> DataFrame:
    """Counts of a diff and PASS where everything matches."""
    n = lambda s: F.count_if(F.col("status") == s)
    return diff.agg(n("matched").alias("matched"), n("missing").alias("missing"), n("changed").alias("changed"), n("unexpected").alias("unexpected"), F.when(F.count_if(F.col("status") != "matched") == 0, "PASS").otherwise("FAIL").alias("verdict"))


def before_after(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows whose state or correctness changed, with a verdict. Columns: key, state, correct."""
    b, n = base.select(key, F.col("state").alias("state_before"), F.col("correct").alias("correct_before")), new.select(key, F.col("state").alias("state_after"), F.col("correct").alias("correct_after"))
    verdict = F.when(F.col("correct_after") & ~F.col("correct_before"), "IMPROVED").when(~F.col("correct_after") & F.col("correct_before"), "REGRESSED").otherwise("CHANGED-STATE-ONLY")
    return b.join(n, key).filter((F.col("state_before") != F.col("state_after")) | (F.col("correct_before") != F.col("correct_after"))).withColumn("verdict", verdict)


def verify_inventory(entries: DataFrame, inventory: DataFrame) -> DataFrame:
    """Entries whose digest is not in the inventory or has another size there. Both: digest, byte_length."""
    known = inventory.groupBy(F.lower("digest").alias("known")).agg(F.min("byte_length").alias("size"))
    issue = F.when(F.col("known").isNull(), "digest_absent").when(F.col("size") != F.col("byte_length"), "size_differs")
    return entries.join(known, F.lower("digest") == F.col("known"), "left").select("case_id", issue.alias("issue")).filter("issue IS NOT NULL")


def multiset_diff(panels: DataFrame) -> DataFrame:
    """How the child's panels of a role came from the parent's: unchanged, replaced, added or removed, with counts.

    Equal checksums are matched one to one. What is left on both sides is paired in checksum order: running counts of both
    sides cut a role into ranges, and each range has the parent's and the child's checksum that reach over it, so no panel is
    unrolled and nothing is joined. A role's rows meet once.
    """
    keys = ["submission_id", "role"]
    n = dealt(panels, *keys).groupBy(*keys, "checksum").agg(F.count_if(F.col("side") == "parent").alias("p"), F.count_if(F.col("side") == "child").alias("c"))
    order = Window.partitionBy(*keys).orderBy("checksum").rowsBetween(Window.unboundedPreceding, 0)
    same, told = F.least("p", "c"), F.struct("checksum")
    ends = n.withColumns({"x": F.sum(F.col("p") - same).over(order), "y": F.sum(F.col("c") - same).over(order)})
    part = lambda when, left, end, was, now: F.when(when, F.struct(F.lit(left).alias("left"), end.alias("n"), was.alias("was"), now.alias("now")))
    none = F.lit(None).cast(n.select(told.alias("t")).schema["t"].dataType)
    parts = F.array_compact(F.array(part(same > 0, False, same, told, told), part(F.col("p") > F.col("c"), True, F.col("x"), told, none), part(F.col("c") > F.col("p"), True, F.col("y"), none, told)))
    rows = ends.select(*keys, F.explode(parts).alias("e")).select(*keys, "e.*")
    # from the last end to the first; of two equal ends the one that comes later has the range, the other an empty one
    back = Window.partitionBy(*keys, "left").orderBy(F.desc("n"))
    over = back.rowsBetween(Window.unboundedPreceding, 0)
    ranged = rows.withColumns({"_start": F.lead("n", 1, 0).over(back), "_was": F.last("was", True).over(over), "_now": F.last("now", True).over(over)})
    reach = lambda side: F.when(F.col("left"), F.col(f"_{side}")).otherwise(F.col(side))
    change = F.when(~F.col("left"), "unchanged").when(F.col("_now").isNull(), "removed").when(F.col("_was").isNull(), "added").otherwise("replaced")
    return ranged.select(*keys, change.alias("change"), reach("was")["checksum"].alias("was"), reach("now")["checksum"].alias("now"), F.when(F.col("left"), F.col("n") - F.col("_start")).otherwise(F.col("n")).alias("n")).filter("n > 0")


def evidence_diff(parent: DataFrame, child: DataFrame, key: list[str]) -> DataFrame:
    """Decision and value of each category before and after. Columns: key, decision, value."""
    p, c = parent.select(*key, F.col("decision").alias("prior"), F.col("value").alias("prior_value")), child.select(*key, F.col("decision").alias("new"), F.col("value").alias("new_value"))
    return p.join(c, key, "full").withColumn("changed", ~(F.col("prior").eqNullSafe(F.col("new")) & F.col("prior_value").eqNullSafe(F.col("new_value"))))


def revision_chain(revisions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Each revision with its parent and the decision that led from one to the other."""
    parent = revisions.select("submission_id", (F.col("revision_number") + 1).alias("revision_number"), F.col("submitted_by").alias("parent_by"))
    last = decisions.groupBy("submission_id", (F.col("revision_number") + 1).alias("revision_number")).agg(F.max("decision").alias("decision_on_parent"))
    return revisions.join(parent, ["submission_id", "revision_number"], "left").join(last, ["submission_id", "revision_number"], "left").select("submission_id", "revision_number", "submitted_by", "parent_by", "decision_on_parent")


def dangling(references: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """References without a target."""
    return references.join(targets, key, "left_anti")


def requirement_coverage(facts: DataFrame, requirements: DataFrame, rules: DataFrame) -> DataFrame:
    """For each fact: is it cited by a requirement, and by which rules is it checked. facts: fact_key; requirements: requirement_id, fact_key; rules: rule_id, fact_key."""
    cited = requirements.groupBy("fact_key").agg(F.count("*").alias("n_cited"))
    checked = rules.groupBy("fact_key").agg(F.array_join(F.array_sort(F.collect_set("rule_id")), ",").alias("rules"))
    return facts.join(cited, "fact_key", "left").join(checked, "fact_key", "left").select("fact_key", F.col("n_cited").isNotNull().alias("cited"), F.coalesce("rules", F.lit("")).alias("rules"))


def duplicate_links(entries: DataFrame) -> DataFrame:
    """What is wrong with pointers to duplicates: no target, self, or a target that is a duplicate itself."""
    to = entries.select(F.col("case_id").alias("_id"), F.col("duplicate_of").alias("_of"))
    issue = F.when(F.col("duplicate_of") == F.col("case_id"), "self").when(F.col("_id").isNull(), "unresolved").when(F.col("_of").isNotNull(), "chained")
    return entries.filter("duplicate_of IS NOT NULL").join(to, F.col("duplicate_of") == F.col("_id"), "left").select("case_id", "duplicate_of", issue.alias("issue")).filter("issue IS NOT NULL")


def stale_analysis(runs: DataFrame, changes: DataFrame) -> DataFrame:
    """Whether anything changed after a package's latest run. runs, changes: package_id, seq."""
    last = runs.groupBy("package_id").agg(F.max("seq").alias("run"))
    changed = changes.groupBy("package_id").agg(F.max("seq").alias("change"))
    return last.join(changed, "package_id", "left").select("package_id", "run", "change", F.coalesce(F.col("change") > F.col("run"), F.lit(False)).alias("stale"))


def effective_values(observations: DataFrame, confirmations: DataFrame) -> DataFrame:
    """The value that counts for each field: the latest confirmation's, else the machine's. confirmations: case_id, field, seq, action, pick, corrected."""
    last = confirmations.groupBy("case_id", "field").agg(F.max_by(F.struct("action", "pick", "corrected"), "seq").alias("c"))
    value = F.when(F.col("c.action") == "alternate", F.try_element_at("alternates", F.col("c.pick"))).when(F.col("c.action") == "corrected", F.col("c.corrected")).when(F.col("c.action").isin("not_visible", "unreadable"), F.lit(None)).otherwise(F.col("value"))
    return observations.join(last, ["case_id", "field"], "left").select("case_id", "field", F.coalesce("c.action", F.lit("machine")).alias("source"), value.alias("effective"))


def set_compare(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Sizes of two key sets, what each holds alone, and their Jaccard similarity."""
    both = a.select(key, F.lit(1).alias("l")).union(b.select(key, F.lit(2).alias("l"))).groupBy(key).agg(F.bit_or("l").alias("side"))
    n = lambda s: F.count_if(F.col("side") == s)
    return both.agg(n(3).alias("shared"), n(1).alias("only_left"), n(2).alias("only_right"), F.round(n(3) / F.count("*"), 6).alias("jaccard"), (n(3) == F.count("*")).alias("same"))
