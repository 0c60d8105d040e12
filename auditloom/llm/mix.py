"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.llm.common import cut, fresh

#: Rows that one bucket of the shuffled order holds about; its running sums are one task's work.
BUCKET_ROWS = 1_000
#: Buckets of a block.
BLOCK = 4096


def words(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Adds target (double) to a table of source, size.

    Sources by code point, null last, get the weights in turn and share `share` times all sizes by them. A target stops
    at `most` times its source's size; what is left over goes to the others by weight, until none is above. The fixed
    point is a water level: with sources by size / weight, the first k are full and the rest get level * weight, for the
    smallest k where nobody is above. One row a source goes through the unpartitioned windows here, never a document.
    """
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    n = len(weights)
    turn = (F.row_number().over(ranked) - 1) % n
    by_weight = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    filled = Window.orderBy(F.col("size") / F.col("weight"), F.col("source").isNull(), F.encode("source", "utf-8")).rowsBetween(Window.unboundedPreceding, -1)
    level = (
        by_weight.withColumn("budget", F.sum("size").over(every) * F.lit(float(share)))
        .withColumn("full", F.coalesce(F.sum(F.col("size") * F.lit(float(most))).over(filled), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(filled), F.lit(0.0)))
        .withColumn("level", (F.col("budget") - F.col("full")) / F.col("open"))
        .withColumn("fits", F.col("level") * F.col("weight") <= F.col("size") * F.lit(float(most)))
        .withColumn("level", F.max(F.when(F.col("fits"), F.col("level"))).over(every))
    )
    cap = F.col("size") * F.lit(float(most))
    return level.select("source", "size", F.coalesce(F.least(cap, F.col("level") * F.col("weight")), cap).alias("target"))


def starts(sums: DataFrame, by: list[str]) -> DataFrame:
    """Adds _before to sums (by, bucket, _amount): what the buckets before a bucket hold within `by`.

    Blocks of BLOCK buckets bound the rows that one window holds: one window is over the buckets of a block, one over the blocks.
    """
    upto = lambda *c: Window.partitionBy(*c).rowsBetween(Window.unboundedPreceding, -1)
    blocks = sums.withColumn("_block", F.floor(F.col("bucket") / F.lit(BLOCK)))
    whole = blocks.groupBy(*by, "_block").agg(F.sum("_amount").alias("_sum"))
    first = whole.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_block").alias("_at"), F.coalesce(F.sum("_sum").over(upto(*by).orderBy("_block")), F.lit(0)).alias("_start"))
    same = F.col("_block") == F.col("_at")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    inside = F.coalesce(F.sum("_amount").over(upto(*by, "_block").orderBy("bucket")), F.lit(0))
    return blocks.withColumn("_in", inside).join(first, same).withColumn("_before", F.col("_in") + F.col("_start")).select(*by, "bucket", "_before")


def running(rows: DataFrame, by: list[str], key: str, amount: str, out: str) -> DataFrame:
    """Adds the running sum of amount within `by`, in order of bucket and then of the columns key and row.

    A group is never held together: sums of each bucket, what comes before each bucket, and running sums inside it.
    """
    total = starts(rows.groupBy(*by, "bucket").agg(F.sum(amount).alias("_amount")), by)
    offsets = total.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("bucket").alias("_bucket"), "_before")
    inside = Window.partitionBy(*by, "bucket").orderBy(key, "row").rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("_own", F.sum(amount).over(inside))
    same = F.col("bucket") == F.col("_bucket")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return summed.join(offsets, same).withColumn(out, F.col("_own") + F.col("_before")).drop("_own", "_before", "_bucket", *[f"_{c}" for c in by])


def mix(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, seed: str = "mix", key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Adds size, source_size, target and taken (words that the mix takes, repeats counted) to each row.

    Every source's documents are put in a random order that the seed fixes, as often as a target may need them
    (ceil(most) rounds). A copy's virtual finish time is the source's words so far, this copy included, divided by the
    source's target; copies are sorted globally by it and taken until the next would go over the total budget. So each
    source's words come near its target, and no document is taken more than `most` times.

    Null and empty texts have size 0 and are never taken. A null source is a source of its own. Rows that repeat a key
    are documents of their own; ties in the order go by text and then by chance of the read order, where rows are equal
    in all that counts. New columns replace columns of the same names.
    """
    new = ["size", "source_size", "target", "taken"]
    kept = [c for c in docs.columns if c.lower() not in new]
    id_name, k, s, r = fresh([*kept, *new], "_row", "_k", "_s", "_r")
    # rows of one key come apart by their texts
    shuffled = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text), F.lit("")))))
    base = docs.select(
        F.col(key).alias("key"), F.col(source).alias("source"), words(F.col(text)).alias("size"), shuffled.alias("hash"),
        F.xxhash64(key, text).alias("row"),
    )
    # Rows equal in key and text stand together with their count; each is taken as often as the others.
    slim = cut(base.groupBy("key", "source", "size", "hash", "row").agg(F.count("*").alias("n")))
    sizes = slim.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("size"))
    goal = cut(targets(sizes, weights, share, most))
    facts = goal.agg(F.sum("target")).first()
    n_rows = slim.count()
    budget = facts[0] or 0.0
    buckets = max(1, math.ceil(n_rows / BUCKET_ROWS))
    # The first 8 hexadecimal digits place a row in one of `buckets` equal ranges of the shuffled order.
    part = F.floor(F.conv(F.substring("hash", 1, 8), 16, 10).cast("long") * F.lit(buckets) / F.lit(1 << 32)).cast("long")
    rows = slim.withColumn("bucket", part).withColumn("amount", F.col("size") * F.col("n"))
    ordered = running(rows, ["source"], "hash", "amount", "so_far")
    full = goal.select(F.col("source").alias("_source"), F.col("size").alias("source_size"), "target")
    placed = ordered.join(F.broadcast(full) if _few(goal) else full, F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "bucket")
    rounds = math.ceil(most)
    copies = (
        placed.filter("size > 0").withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
        .withColumn("finish", (F.col("round") * F.col("source_size") + F.col("so_far")) / F.col("target"))
        .filter(F.col("finish") <= 1.5)  # every source meets its target at time 1
    )
    taken = truncated(copies, budget, buckets).groupBy("key", "source", "row").agg(F.sum("size").alias("taken"))
    result = placed.join(taken.select(F.col("key").alias("_k"), F.col("source").alias("_s"), F.col("row").alias("_r"), "taken"), F.col("key").eqNullSafe(F.col("_k")) & F.col("source").eqNullSafe(F.col("_s")) & (F.col("row") == F.col("_r")), "left")
    result = result.select("key", "source", "row", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    own = docs.select(*kept, F.xxhash64(key, text).alias(id_name))
    right = cut(result.select(F.col("key").alias(k), F.col("source").alias(s), F.col("row").alias(r), *new))
    return own.join(right, F.col(key).eqNullSafe(F.col(k)) & F.col(source).eqNullSafe(F.col(s)) & (F.col(id_name) == F.col(r))).select(*kept, *new)


def _few(goal: DataFrame, most: int = 10_000) -> bool:
    """Whether the table of sources is small enough to be sent to every task."""
    return goal.count() <= most


def truncated(copies: DataFrame, budget: float, buckets: int) -> DataFrame:
    """The copies, in order of finish time, up to the total budget; the running sum is taken by buckets of the time."""
    n = 64 * buckets
    at = copies.withColumn("bucket", F.least(F.floor(F.col("finish") * F.lit(n)), F.lit(2 * n)).cast("long"))
    sums = at.groupBy("bucket").agg(F.sum(F.col("amount")).alias("_amount")).withColumn("all", F.lit(0))
    offsets = starts(sums, ["all"]).select(F.col("bucket").alias("_bucket"), "_before")
    inside = Window.partitionBy("bucket").orderBy("finish", "hash", "row", "round").rowsBetween(Window.unboundedPreceding, 0)
    summed = at.join(offsets.filter(F.col("_before") < F.lit(budget)), F.col("bucket") == F.col("_bucket")).withColumn("_own", F.sum("amount").over(inside))
    return summed.filter(F.col("_own") + F.col("_before") <= F.lit(budget)).drop("_own", "_before", "_bucket", "bucket")
