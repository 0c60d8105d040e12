"""Further checks and joins: legal states, region and panel checks, provenance, coverage, nearest texts, components."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.functions import clues
from auditloom.functions import vocabulary as vc
from auditloom.operators.spatial import met

# Findings that may stand with an execution status.
LEGAL = [("executed", "PASS"), ("executed", "WARN"), ("executed", "FAIL"), ("executed", "NEEDS_REVIEW"), ("not_run_insufficient_evidence", "not_run"), ("not_run_external_dependency", "not_run")]


def illegal_pairs(rows: DataFrame, key: list[str], columns: tuple[str, str], legal: list[tuple[str, str]]) -> DataFrame:
    """Rows whose two states may not stand together."""
    fine = rows.sparkSession.createDataFrame(legal, f"{columns[0]} string, {columns[1]} string")
    return rows.join(F.broadcast(fine), list(columns), "left_anti").select(*key, *columns)


def accepted_scores(scores: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """Whether a record reaches every threshold, and the first dimension that doesn't."""
    short = F.coalesce(*[F.when(F.coalesce(F.col(c) < v, F.lit(True)), F.lit(c)) for c, v in thresholds.items()])
    return scores.withColumn("short_of", short).withColumn("accepted", short.isNull())


def region_issues(regions: DataFrame, panels: DataFrame) -> DataFrame:
    """The first thing wrong with each region: its panel, its category, or its box in the frame. regions: vec_id, case_id, category, x0, y0, x1, y1; panels: case_id, category."""
    known = panels.groupBy(F.col("case_id").alias("_case")).agg(F.collect_set("category").alias("_categories"))  # a few categories a panel
    j = regions.join(known, F.col("case_id") == F.col("_case"), "left")
    issue = F.when(F.col("_case").isNull(), "no_panel").when(~F.array_contains("_categories", F.col("category")), "category").when((F.col("x0") < 0) | (F.col("y0") < 0) | (F.col("x1") > 1) | (F.col("y1") > 1), "outside").when((F.col("x1") <= F.col("x0")) | (F.col("y1") <= F.col("y0")), "empty")
    return j.select("vec_id", issue.alias("issue")).filter("issue IS NOT NULL")


def preparation_complete(panels: DataFrame, roles: list[str], categories: list[str]) -> DataFrame:
    """Whether a submission has every role on its child side, and every category in each of these roles. panels: submission_id, side, role, category."""
    mine = (F.col("side") == "child") & F.col("role").isin(roles)
    n, pairs = F.countDistinct(F.when(mine, F.col("role"))), F.countDistinct(F.when(mine & F.col("category").isin(categories), F.concat_ws("|", "role", "category")))
    return panels.groupBy("submission_id").agg(n.alias("roles"), pairs.alias("filled"), ((n == len(roles)) & (pairs == len(roles) * len(categories))).alias("complete"))


def record_set_lint(docs: DataFrame, statuses: list[str]) -> DataFrame:
    """(id, issue) of records: an id that isn't in the title, a name that repeats, an id that repeats, a status that is missing or unknown. docs: id, name, title, status."""
    names, ids = Window.partitionBy("name"), Window.partitionBy("id")
    j = docs.withColumn("_names", F.count("*").over(names)).withColumn("_ids", F.count("*").over(ids))
    rules = {"id_not_in_title": ~F.col("title").contains(F.col("id").cast("string")), "repeated_name": F.col("_names") > 1, "repeated_id": F.col("_ids") > 1, "no_status": F.col("status").isNull() | (F.trim("status") == ""), "unknown_status": ~F.col("status").isin(statuses) & (F.trim("status") != "")}
    return j.select("id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))).alias("issue"))


def panel_identity_issues(panels: DataFrame) -> DataFrame:
    """Storage keys that lack their revision's prefix or their checksum at the end. panels: id, storage_key, revision, checksum."""
    issue = F.when(~F.col("storage_key").startswith(F.concat(F.lit("rev-"), F.col("revision").cast("string"), F.lit("/"))), "prefix").when(~F.col("storage_key").endswith(F.col("checksum")), "checksum")
    return panels.select("id", issue.alias("issue")).filter("issue IS NOT NULL")


def panel_metadata_issues(panels: DataFrame, artifacts: DataFrame) -> DataFrame:
    """The first difference between what a panel declares and its artifact. Both: id, bytes, kind, checksum."""
    a = artifacts.select("id", *[F.col(c).alias(f"_{c}") for c in ("bytes", "kind", "checksum")])
    issue = F.when(F.col("_bytes").isNull(), "absent").when(F.col("bytes") != F.col("_bytes"), "bytes").when(F.col("kind") != F.col("_kind"), "kind").when(F.col("checksum") != F.col("_checksum"), "checksum")
    return panels.join(a, "id", "left").select("id", issue.alias("issue")).filter("issue IS NOT NULL")


def result_issues(findings: DataFrame, rules: list[str]) -> DataFrame:
    """Cases whose findings don't follow the rules' order: a position that lacks its rule, has another, or is one too many. findings: case_id, position, rule."""
    want = findings.sparkSession.createDataFrame([(i + 1, r) for i, r in enumerate(rules)], "position int, want string")
    grid = findings.select("case_id").distinct().crossJoin(F.broadcast(want))  # a row for each case and rule
    j = grid.join(findings, ["case_id", "position"], "full")
    issue = F.when(F.col("rule").isNull(), "missing").when(F.col("want").isNull(), "extra").when(F.col("rule") != F.col("want"), "wrong_rule")
    return j.select("case_id", "position", issue.alias("issue")).filter("issue IS NOT NULL")


def support_gates(trials: DataFrame) -> DataFrame:
    """Gates over all runs and the decision that follows from them in fixed order."""
    g = trials.agg(F.count("*").alias("n"), F.countDistinct("block").alias("blocks"), F.count_if(F.col("state") == "HARD_NON_COMPLETION").alias("hard"), F.max("latency_ms").alias("worst"))
    return g.withColumn("decision", F.when(F.col("n") < 100, "too_few").when(F.col("hard") * 4 > F.col("n"), "unstable").when(F.col("worst") > 1000, "too_slow").otherwise("supported"))


def region_coverage(boxes: DataFrame, passes: DataFrame, words: DataFrame) -> DataFrame:
    """For each target whether a pass covers 0.9 of it, and how many words' centres lie in it. All in one frame: case_id, x0, y0, x1, y1; boxes: target.

    A pass that covers 0.9 of a target covers its centre, so passes meet targets by their centres, as words do.
    """
    sides = ("x0", "y0", "x1", "y1")
    middle = lambda a, b: F.col(a) + (F.col(b) - F.col(a)) / 2
    point = lambda x, y: {"x0": x, "x1": x, "y0": y, "y1": y}
    t = boxes.select("target", "case_id", *sides)
    centres = t.select("target", "case_id", F.struct(*sides).alias("t"), *[c.alias(k) for k, c in point(middle("x0", "x1"), middle("y0", "y1")).items()])
    p = met(centres, passes.select("case_id", *sides), ["case_id"]).select("l.target", "l.t", "r")
    wide = F.greatest(F.lit(0.0), F.least("t.x1", "r.x1") - F.greatest("t.x0", "r.x0"))
    high = F.greatest(F.lit(0.0), F.least("t.y1", "r.y1") - F.greatest("t.y0", "r.y0"))
    covered = p.groupBy("target").agg(F.bool_or(wide * high >= 0.9 * F.expr("t.x1 - t.x0") * F.expr("t.y1 - t.y0")).alias("covered"))
    points = words.select("case_id", *[c.alias(k) for k, c in point((F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2).items()])
    inside = met(points, t, ["case_id"]).groupBy("r.target").agg(F.count("*").alias("words"))
    j = boxes.select("target").join(covered, "target", "left").join(inside, "target", "left")
    n = F.coalesce("words", F.lit(0)).cast("long")
    return j.select("target", F.coalesce("covered", F.lit(False)).alias("covered"), n.alias("words"), F.when(F.coalesce("covered", F.lit(False)) & (n > 0), "read").when(F.coalesce("covered", F.lit(False)), "covered_unread").when(n > 0, "partly").otherwise("missed").alias("category"))


def containment_join(texts: DataFrame, phrases: DataFrame, size: int = 6) -> DataFrame:
    """The best phrase for each text: text contains phrase (2000 less the difference in length) or phrase contains text (1000 less it). texts: id, text; phrases: pid, phrase.

    The shorter of two that contain each other is looked for by its first `size` characters, or all it has, among the runs of as
    many characters of the other; then the whole is compared. Empty texts and phrases are contained in nothing.
    """

    def contained(inner: DataFrame, outer: DataFrame) -> DataFrame:
        """(outer's o, inner's i) where o contains i. Both: one string column named so, and k."""
        n = F.least(F.lit(size), F.length("i"))
        heads = inner.filter("i <> ''").select(F.col("k").alias("ik"), "i", n.alias("n"), F.substring(F.col("i"), F.lit(1), n).alias("g"))
        lengths = heads.select("n").distinct()  # `size` rows at most
        runs = outer.filter("o <> ''").join(F.broadcast(lengths), F.length("o") >= F.col("n")).select(F.col("k").alias("ok"), "o", "n", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("o") - F.col("n") + 1), lambda a: F.substring(F.col("o"), a, F.col("n"))))).alias("g"))
        return runs.join(heads, ["n", "g"]).filter(F.expr("contains(o, i)"))

    t, p = texts.select(F.col("id").alias("k"), "text"), phrases.select(F.col("pid").alias("k"), "phrase")
    delta = F.abs(F.length("o") - F.length("i"))
    holds = contained(p.withColumnRenamed("phrase", "i"), t.withColumnRenamed("text", "o")).select(F.col("ok").alias("id"), F.col("ik").alias("pid"), (2000 - delta).alias("score"))
    held = contained(t.withColumnRenamed("text", "i"), p.withColumnRenamed("phrase", "o")).filter("i <> o").select(F.col("ik").alias("id"), F.col("ok").alias("pid"), (1000 - delta).alias("score"))
    best = holds.unionByName(held).groupBy("id").agg(F.max(F.struct("score", (-F.col("pid")).alias("p"))).alias("b"))
    return best.select("id", (-F.col("b.p")).alias("pid"), F.col("b.score").cast("long").alias("score"))


def failure_cause(candidates: DataFrame, lines: DataFrame) -> DataFrame:
    """What became of the right answer of each case, and with which candidate: the best rejected candidate that holds it, else the best kept one that holds more than it, else the best that holds a part, else a line.

    candidates: case_id, kept, score, candidate_id, holds (the whole answer), partial (some of it), reason; lines: case_id, holds.
    Of one tier, the best score counts, then the greatest candidate_id. Cases that only lines know have a row too.
    """
    tier = F.when(F.col("holds") & ~F.col("kept"), 4).when(F.col("holds"), 3).when(F.col("partial"), 2).otherwise(0)
    best = candidates.groupBy("case_id").agg(F.max(F.struct(tier.alias("tier"), "score", "candidate_id", "reason")).alias("b"))
    seen = lines.groupBy("case_id").agg(F.bool_or("holds").alias("line"))
    j = best.join(seen, "case_id", "full")
    t = F.coalesce("b.tier", F.lit(0))
    cause = F.when(t == 4, F.concat(F.lit("rejected:"), F.coalesce("b.reason", F.lit("unknown")))).when(t == 3, "over_extended").when(t == 2, "partial").when(F.coalesce("line", F.lit(False)), "line_only").otherwise("not_seen")
    return j.select("case_id", cause.alias("cause"), F.when(t > 0, F.col("b.candidate_id")).alias("candidate_id"))


def edit_distance(a: str, b: str) -> int:
    """Insertions, deletions, replacements and swaps of neighbours that make b of a."""
    far = len(a) + len(b)
    table = [[far] * (len(b) + 2)] + [[far, *range(len(b) + 1)]]
    seen: dict[str, int] = {}
    for i, x in enumerate(a, 1):
        row, swap = [far, i], 0
        for j, y in enumerate(b, 1):
            k, l = seen.get(y, 0), swap
            if x == y:
                swap = j
            row.append(min(table[i][j] + (x != y), row[j] + 1, table[i][j + 1] + 1, table[k][l] + (i - k - 1) + 1 + (j - l - 1)))
        table.append(row)
        seen[x] = i
    return table[-1][-1]


def prefix_distances(text: np.ndarray, starts: np.ndarray, sizes: np.ndarray, goals: np.ndarray, wides: np.ndarray) -> np.ndarray:
    """edit_distance to a goal of each part text[start : start + length], by length and start; length up to the start's size.

    text: characters as numbers; sizes: descending; goals: by character and start, wides: how many of these count.
    A swap is worth its price only where the two characters are neighbours in the text or in the goal: else replacing is as
    cheap. So a cell looks at what is least among the goal's columns before it, and among the text's rows before it.
    """
    n, wide, most = len(starts), len(goals), int(sizes.max(initial=0))
    longest = most + wide + max(most, wide) + 2  # the most that is counted up to
    kind = np.int8 if longest < 127 else np.int16 if longest < 32767 else np.int32
    far = kind(most + wide + 2)
    column, each = np.arange(wide + 1, dtype=kind)[:, None], np.arange(n)
    out = np.full((most + 1, n), far, kind)
    out[0] = wides
    before = np.repeat(column, n, 1)
    old = last = None
    upper = np.full((wide, n), far, kind)  # by column: the least that a swap with a row before costs, less the row that it ends in
    for i in range(1, most + 1):
        m = n - int(np.searchsorted(sizes[::-1], i))  # starts whose text is so long
        if m < before.shape[1]:
            before, upper, goals = before[:, :m], upper[:, :m], goals[:, :m]
            old, last = (None, None) if old is None else (old[:, :m], last[:, :m])
        other = text[starts[:m] + (i - 1)] != goals
        bar = np.where(other, far, -far)  # what is no swap counts as far
        row = np.empty((wide + 1, m), kind)
        row[0] = i
        np.add(before[:-1], other, out=row[1:])
        np.minimum(row[1:], before[1:] + kind(1), out=row[1:])
        if old is not None and wide > 1:
            left = np.maximum(old[:-1] - column[1:], bar)
            for j in range(1, wide):
                np.minimum(left[j], left[j - 1], out=left[j])
            np.minimum(row[2:], np.maximum(left[:-1] + column[2:], last[1:]), out=row[2:])
            np.minimum(row[2:], np.maximum(upper[1:] + kind(i), bar[:-1]), out=row[2:])
        for j in range(1, wide + 1):
            np.minimum(row[j], row[j - 1] + kind(1), out=row[j])
        if wide > 1:
            np.minimum(upper[1:], np.maximum(before[:-2] - kind(i), bar[1:]), out=upper[1:])
        old, before, last = before, row, bar
        out[i, :m] = row[wides[:m], each[:m]]
    return out


#: Starts of spans whose tables are filled at once, and cells of these tables, at most.
STARTS, CELLS = 4096, 1 << 24


def nearest_of(cases: list[tuple[list[str], str]]) -> list[tuple[str, int] | None]:
    """For each case (words, truth) the run of words nearest to its truth, of as many words, one fewer or one more, and how far it is; of equal ones the least. The longest run from a word on tells of the shorter ones."""
    low = [[w.lower() for w in words] for words, _ in cases]
    goals = [truth.lower() for _, truth in cases]
    codes = lambda t: np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4")
    text = codes("\n".join(map(" ".join, low)))
    table = np.zeros((max(map(len, goals)), len(cases)), "<u4")
    for i, g in enumerate(goals):
        table[: len(g), i] = codes(g)
    kind = np.uint8 if max(text.max(initial=0), table.max(initial=0)) < 256 else np.uint32
    text, table, wides = text.astype(kind), table.astype(kind), np.array([*map(len, goals)])
    parts, begin = [], 0
    for i, ((_, truth), words) in enumerate(zip(cases, low)):
        ends = begin + np.cumsum([len(w) + 1 for w in words]) - 1
        starts, n, k = np.concatenate([[begin], ends[:-1] + 1]), len(words), len(truth.split(" "))
        # by number of words: the length of the span from each start on, -1 if the words don't suffice
        sizes = [np.concatenate([ends[c - 1 :] - starts[: n - c + 1], np.full(c - 1, -1)]) if 0 < c <= n else np.full(n, -1) for c in (k - 1, k, k + 1)]
        if n:
            parts.append((np.full(n, i), np.arange(n), starts, *sizes))
            begin = ends[-1] + 1
        else:
            begin += 1
    found: list[tuple[int, str] | None] = [None] * len(cases)
    if not parts:
        return found
    case, word, starts, *sizes = map(np.concatenate, zip(*parts))
    sizes = np.stack(sizes)
    # no distance is above the longer length, and none is below the difference of lengths: what is longer than the truth by more than the best bound can't be nearest
    upper = np.full(len(cases), 1 << 30)
    np.minimum.at(upper, case, np.where(sizes >= 0, np.maximum(sizes, wides[case]), 1 << 30).min(0))
    sizes = np.where(sizes - wides[case] > upper[case], -1, sizes)
    most = sizes.max(0)
    order = np.argsort(-most, kind="stable")
    order = order[most[order] >= 0]
    while len(order):
        n = max(1, min(STARTS, CELLS // (int(most[order[0]]) + len(table) + 2)))
        at, order = order[:n], order[n:]
        far = prefix_distances(text, starts[at], most[at], table[:, case[at]], wides[case[at]])
        size, of = sizes[:, at], case[at]
        d = np.where(size >= 0, far[size.clip(0), np.arange(len(at))].astype(np.int32), 1 << 30)
        least = np.full(len(cases), 1 << 29, np.int32)
        np.minimum.at(least, of, d.min(0))
        for q, j in zip(*np.nonzero(d == least[of])):
            i, w = of[j], word[at[j]]
            k = len(cases[i][1].split(" ")) - 1 + q
            span = int(d[q, j]), " ".join(cases[i][0][w : w + k])
            found[i] = span if found[i] is None else min(found[i], span)
    return [f and (f[1], f[0]) for f in found]


def nearest_span(cases: DataFrame, start: int = 0) -> DataFrame:
    """(case_id, span, distance, kind): the span nearest to each case's truth by edit distance, swaps of neighbours being one edit, the least span of equal ones.

    cases: case_id, truth, words (array), one row a case. Spans are the runs of words from place `start` on that have as many words as the
    truth, one fewer or one more; case doesn't count. Cases without truth or span have no row. A case is measured where it stands: no span is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, truths, words = (c.to_pylist() for c in batch.columns)
            rows, held, n = [], [], 0
            order = sorted(range(len(ids)), key=lambda i: len(truths[i]))  # truths of like lengths together
            for at in order:
                held.append(at)
                n += len(words[at])
                if n >= STARTS or at == order[-1]:
                    rows += [(ids[i], *b, len(truths[i])) for i, b in zip(held, nearest_of([(words[i][start:], truths[i]) for i in held])) if b]
                    held, n = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, (batch.schema.field(0).type, pa.string(), pa.int32(), pa.int32()))], names=["case_id", "span", "distance", "len"])

    given = cases.select("case_id", "truth", "words").filter("truth IS NOT NULL AND words IS NOT NULL")
    found = given.mapInArrow(run, T.StructType([given.schema["case_id"], T.StructField("span", T.StringType()), T.StructField("distance", T.IntegerType()), T.StructField("len", T.IntegerType())]))
    return found.select("case_id", "span", "distance", F.when(F.col("distance") <= 2, "near_miss").when(F.col("distance") * 2 <= F.col("len"), "partial").otherwise("none").alias("kind"))


def category_readiness(pairs: DataFrame) -> DataFrame:
    """A target is clear if a proposal covers half of it with an agreeing value; a case is ready if all its targets are. pairs: case_id, target, coverage, agrees."""
    clear = pairs.groupBy("case_id", "target").agg(F.bool_or((F.col("coverage") >= 0.5) & F.col("agrees")).alias("clear"))
    return clear.groupBy("case_id").agg(F.count("*").alias("targets"), F.count_if("clear").alias("clear"), F.bool_and("clear").alias("ready"))


def provenance_reconcile(a: DataFrame, b: DataFrame, c: DataFrame, key: str) -> DataFrame:
    """The first layer whose digest differs from the one before it."""
    j = a.select(key, F.col("digest").alias("da")).join(b.select(key, F.col("digest").alias("db")), key, "left").join(c.select(key, F.col("digest").alias("dc")), key, "left")
    code = F.when(F.col("db").isNull(), "ANALYZER_ABSENT").when(F.col("da") != F.col("db"), "ANALYZER_DIFFERS").when(F.col("dc").isNull(), "RUN_ABSENT").when(F.col("db") != F.col("dc"), "RUN_DIFFERS")
    return j.select(key, code.alias("code")).filter("code IS NOT NULL")


def fingerprint_classes(prints: DataFrame, columns: list[str]) -> DataFrame:
    """Membership: (run_id, class_id) with the least run of equal digests as their class."""
    return prints.withColumn("class_id", F.min("run_id").over(Window.partitionBy(*columns))).select("run_id", "class_id", *columns)


def pairwise_fingerprints(prints: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, n_a, n_b, differing): pairs of classes that share a digest, their runs, and how many digests differ. prints: run_id and columns.

    Runs with equal digests are one class (fingerprint_classes tells which run is in which), so copies make no pairs.
    Classes meet through the digests that they share, each pair in the first of these; classes that share none differ in all.
    """
    classes = prints.groupBy(*columns).agg(F.min("run_id").alias("run_id"), F.count("*").alias("n"))
    l, r = classes.select(F.col("run_id").alias("a"), F.col("n").alias("n_a"), *[F.col(c).alias(f"l{c}") for c in columns]), classes.select(F.col("run_id").alias("b"), F.col("n").alias("n_b"), *[F.col(c).alias(f"r{c}") for c in columns])
    same = [F.col(f"l{c}").eqNullSafe(F.col(f"r{c}")) for c in columns]
    differ = sum((F.when(x, 0).otherwise(1) for x in same), F.lit(0))
    found = None
    for i in range(len(columns)):
        first = same[i] & (F.col("a") < F.col("b"))
        for x in same[:i]:
            first &= ~x
        part = l.join(r, first).select("a", "b", "n_a", "n_b", differ.cast("int").alias("differing"))
        found = part if found is None else found.unionByName(part)
    return found


def token_coverage(cases: DataFrame) -> DataFrame:
    """Expected tokens that a case has whole, as two to four neighbours run together, or not at all. cases: case_id, words (array), expected (array), one row a case; case doesn't count, null tokens are nowhere.

    Each case is counted where it stands: no run of words is shuffled. Cases that expect nothing have no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for words, expected in zip(*(c.to_pylist() for c in batch.columns[1:])):
                low, n = [w.lower() for w in words or ()], [0, 0, 0, 0]
                whole, told = set(low), {}
                open_ = {t.lower() for t in expected if t is not None} - whole
                if open_:
                    for k in (2, 3, 4):
                        told.update((t, k) for t in open_.intersection(map("".join, zip(*(low[i:] for i in range(k))))) if t not in told)
                for t in expected:
                    t = t and t.lower()
                    n[0 if t in whole else 1 if t in told else 2] += 1
                out.append((len(expected), *n[:3]))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in zip(*out)]] if out else [batch.column(0), *[pa.array([], pa.int64())] * 4], names=["case_id", "expected", "present", "fragmented", "missing"])

    asked = cases.select("case_id", "words", "expected").filter(F.size("expected") > 0)
    return asked.mapInArrow(run, T.StructType([asked.schema["case_id"], *[T.StructField(c, T.LongType()) for c in ("expected", "present", "fragmented", "missing")]]))


def _shared(a: pd.Series, b: pd.Series) -> pd.Series:
    pairs = lambda t: Counter(map("".join, zip(t, t[1:])) if len(t) > 1 else [t])
    return pd.Series([sum((pairs(x) & pairs(y)).values()) for x, y in zip(a, b)], dtype="int64")


def bigram_similarity(pairs: DataFrame) -> DataFrame:
    """(id, similarity): twice the pairs of neighbouring characters that two texts share, with their counts, over all that they have. pairs: id, a, b.

    Texts count without white space around and between words but one space; equal ones are 1, an empty one is 0, and a single character is a pair of its own.
    Nothing is shuffled.
    """
    norm = lambda c: F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " "))
    p = pairs.select("id", norm(F.col("a")).alias("a"), norm(F.col("b")).alias("b"))
    shared = F.pandas_udf(_shared, T.LongType())("a", "b")
    size = lambda c: F.greatest(F.lit(1), F.length(c) - 1)
    p = p.withColumn("shared", shared)
    value = F.when((F.col("a") == "") | (F.col("b") == ""), 0.0).when(F.col("a") == F.col("b"), 1.0).otherwise(2 * F.col("shared") / (size(F.col("a")) + size(F.col("b"))))
    return p.select("id", F.round(value, 6).alias("similarity"))


def code_agreement(runs: DataFrame) -> DataFrame:
    """Agreement of the code sets of each case's repetitions: all equal, and the mean Jaccard similarity of pairs. runs: case_id, repetition, code; repetitions are few."""
    sets = runs.groupBy("case_id", "repetition").agg(F.array_sort(F.collect_set("code")).alias("codes"))
    a, b = sets.select("case_id", F.col("repetition").alias("i"), F.col("codes").alias("x")), sets.select("case_id", F.col("repetition").alias("j"), F.col("codes").alias("y"))
    pairs = a.join(b, "case_id").filter("i < j")
    return pairs.groupBy("case_id").agg(F.count("*").alias("pairs"), F.bool_and(F.col("x") == F.col("y")).alias("exact"), F.round(F.avg(F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y"))), 6).alias("jaccard"))


def orientation_breakdown(targets: DataFrame) -> DataFrame:
    """(level, key, n, detected, recall, agrees, agreement): recall and agreement by orientation, and by how sure the annotation is. targets: orientation, annotated, confidence (high, medium, low), detected; agreement is that of orientation and annotated."""
    n, hit, same = F.count("*"), F.count_if("detected"), F.count_if(F.col("orientation") == F.col("annotated"))
    g = targets.groupingSets([["orientation"], ["confidence"]], "orientation", "confidence").agg(n.alias("n"), hit.alias("detected"), F.round(hit / n, 6).alias("recall"), same.alias("agrees"), F.round(same / n, 6).alias("agreement"), F.grouping("orientation").alias("g"))
    return g.select(F.when(F.col("g") == 0, "orientation").otherwise("confidence").alias("level"), F.when(F.col("g") == 0, F.col("orientation")).otherwise(F.col("confidence")).alias("key"), "n", "detected", "recall", "agrees", "agreement")


# Words below which a picture has little text and below which it may be upside down; passes beside the first; widths of side strips of the whole picture and of a focus, and their least width.
SPARSE, FEW, MORE_PASSES, SIDE, FOCUS_SIDE, STRIP = 18, 6, 4, 0.44, 0.22, 72
# Least words of a picture for a focus, its area's least and greatest share, its padding's share and least width, gap to another component and greatest crop as shares of the picture.
FOCUS_WORDS, FOCUS_AREA, FOCUS_PAD, FOCUS_GAP, FOCUS_MOST = 4, (0.08, 0.82), (0.08, 24), 0.12, 0.92


def focus_regions(components: DataFrame, wide: int, high: int) -> DataFrame:
    """(case_id, component, x0, y0, x1, y1, edge) of cases whose largest component is worth a look of its own, as a padded crop of a picture of wide x high.

    components: case_id, component, words, x, y, width, height. The component with the most words, then area, then the least id has
    to cover neither too little nor too much, with another far from it in x or y; and its crop must be less than the picture.
    edge: the side with the larger margin if one is wide enough for a strip, else null.
    """
    w = Window.partitionBy("case_id")
    r = components.withColumn("area", F.col("width") * F.col("height")).withColumn("k", F.row_number().over(w.orderBy(F.desc("words"), F.desc("area"), "component"))).withColumn("all", F.sum("words").over(w))
    b = F.first(F.struct("x", "y", "width", "height")).over(w.orderBy("k"))
    gap = lambda a, n: F.greatest(F.col(a) - F.col(f"b.{a}") - F.col(f"b.{n}"), F.col(f"b.{a}") - F.col(a) - F.col(n))
    far = (gap("x", "width") > FOCUS_GAP * wide) | (gap("y", "height") > FOCUS_GAP * high)
    told = r.withColumn("b", b).withColumn("far", F.max(F.when(F.col("k") > 1, far).otherwise(F.lit(False))).over(w)).filter((F.col("k") == 1) & F.col("far") & (F.col("all") >= FOCUS_WORDS) & F.col("area").between(FOCUS_AREA[0] * wide * high, FOCUS_AREA[1] * wide * high))
    pad = lambda n: F.greatest(F.lit(FOCUS_PAD[1]), F.floor(F.col(n) * FOCUS_PAD[0] + 0.5))
    clamp = lambda c, low, most: F.greatest(low, F.least(F.lit(most), c)).cast("double")
    crop = told.withColumns({"x0": clamp(F.col("x") - pad("width"), F.lit(0), wide - 1), "y0": clamp(F.col("y") - pad("height"), F.lit(0), high - 1)})
    crop = crop.withColumns({"x1": clamp(F.col("x") + F.col("width") + pad("width"), F.col("x0") + 1, wide), "y1": clamp(F.col("y") + F.col("height") + pad("height"), F.col("y0") + 1, high)})
    left, right, n = F.col("x") - F.col("x0"), F.col("x1") - F.col("x") - F.col("width"), F.col("x1") - F.col("x0")
    edge = F.when(F.greatest(left, right) >= FOCUS_GAP * n, F.when(right >= left, "right").otherwise("left"))
    return crop.filter((n < FOCUS_MOST * wide) | (F.col("y1") - F.col("y0") < FOCUS_MOST * high)).select("case_id", "component", "x0", "y0", "x1", "y1", edge.alias("edge"))


def plan_recovery(cases: DataFrame, words: DataFrame, focus: DataFrame, wide: int, high: int) -> DataFrame:
    """(case_id, position, pass_kind, x0, y0, x1, y1, reasons): the passes over parts of a picture that a case needs, MORE_PASSES at most.

    cases: case_id, needs_brand, needs_alcohol; words: case_id, x0, x1; focus: of focus_regions. A missing statement is looked for at both
    sides, then in the focus and at its edge; a picture with hardly a word is turned.
    """
    mid = (F.col("x0") + F.col("x1")) / 2
    seen = words.groupBy("case_id").agg(F.count("*").alias("n"), F.bool_or((mid <= 0.2 * wide) | (mid >= 0.8 * wide)).alias("edges"))
    f = focus.select("case_id", F.struct("x0", "y0", "x1", "y1").alias("f"), "edge")
    c = cases.filter("needs_brand OR needs_alcohol").join(seen, "case_id", "left").join(f, "case_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    why = F.array(F.when(F.col("needs_brand"), "brand-not-observed"), F.when(F.col("needs_alcohol"), "alcohol-not-observed"), F.when(F.col("n") < SPARSE, "low-text-density"), F.when(F.col("edges"), "edge-text-heuristic"))
    num = lambda x: (F.lit(x) if isinstance(x, (int, float)) else x).cast("double")
    box = lambda name, x0, y0, x1, y1, *more: F.struct(F.lit(name).alias("kind"), num(x0).alias("x0"), num(y0).alias("y0"), num(x1).alias("x1"), num(y1).alias("y1"), F.array(*map(F.lit, more)).cast("array<string>").alias("more"))
    strip = lambda n, share: F.least(n, F.greatest(F.lit(float(STRIP)), F.floor(n * share + 0.5)))
    side, fw = strip(F.lit(float(wide)), SIDE), strip(F.col("f.x1") - F.col("f.x0"), FOCUS_SIDE)
    lost, has = F.col("needs_alcohol"), F.col("needs_alcohol") & F.col("f").isNotNull()
    plan = [
        F.when(lost, box("left-edge", 0, 0, side, high)), F.when(lost, box("right-edge", F.lit(wide) - side, 0, wide, high)), F.when(has, box("focus", F.col("f.x0"), F.col("f.y0"), F.col("f.x1"), F.col("f.y1"), "focus-crop-distinct")),
        F.when(has & (F.col("edge") == "left"), box("focus-left-edge", F.col("f.x0"), F.col("f.y0"), F.col("f.x0") + fw, F.col("f.y1"), "focus-crop-distinct", "edge-text-heuristic")), F.when(has & (F.col("edge") == "right"), box("focus-right-edge", F.col("f.x1") - fw, F.col("f.y0"), F.col("f.x1"), F.col("f.y1"), "focus-crop-distinct", "edge-text-heuristic")),
        F.when(F.col("n") <= FEW, box("rotated-180", 0, 0, wide, high, "orientation-fallback")),
    ]
    out = c.select("case_id", F.array_compact(why).alias("why"), F.posexplode(F.slice(F.array_compact(F.array(*plan)), 1, MORE_PASSES)).alias("position", "p"))
    return out.select("case_id", (F.col("position") + 1).alias("position"), F.col("p.kind").alias("pass_kind"), *[f"p.{x}" for x in ("x0", "y0", "x1", "y1")], F.array_join(F.array_distinct(F.concat("why", "p.more")), ",").alias("reasons"))


def text_class_hypotheses(regions: DataFrame) -> DataFrame:
    """(id, class, family, points, place): the classes that each region may be, the most points of a class, in order of points and name.

    regions: id, text, reason (of filter_name_lines, or 'statement' for a candidate of the alcohol field; null: none), source (null,
    'ocr_pass_region' or 'recovery_crop'). A region without any clue is unknown. Where the first two are within 10 points and of
    different families, a conflict is one more class.
    """
    text = F.lower(F.trim(F.coalesce("text", F.lit(""))))
    found = [F.when(F.col("source") == k, F.struct(F.lit(c).alias("class"), F.lit(p).alias("points"))) for k, (c, p) in vc.SOURCE_CLUES.items()]
    found += [F.when(F.col("reason").isin(k.split()), F.struct(F.lit(c).alias("class"), F.lit(p).alias("points"))) for k, told in vc.REASON_CLUES.items() for c, p in told.items()]
    for name, hit in clues.tests(text).items():
        found += [F.when(hit, F.struct(F.lit(c).alias("class"), F.lit(p).alias("points"))) for c, p in vc.TEXT_CLUES[name].items()]
    nothing = F.array(F.struct(F.when(text != "", "unknown_text_region").otherwise("unknown_non_text_region").alias("class"), F.lit(50).alias("points")))
    every = regions.select("id", F.array_compact(F.array(*found)).alias("h"), nothing.alias("none")).select("id", F.explode(F.when(F.size("h") > 0, F.col("h")).otherwise(F.col("none"))).alias("h"))
    family = F.create_map(*[F.lit(x) for f, classes in vc.FAMILIES.items() for c in classes.split() for x in (c, f)])
    most = every.groupBy("id", F.col("h.class").alias("class")).agg(F.max("h.points").alias("points")).withColumn("family", F.element_at(family, F.col("class")))
    w = Window.partitionBy("id").orderBy(F.desc("points"), "class")
    ranked = most.withColumn("place", F.row_number().over(w)).withColumn("next", F.lead(F.struct("points", "family")).over(w))
    clash = ranked.filter((F.col("place") == 1) & (F.col("points") - F.col("next.points") <= 10) & (F.col("family") != F.col("next.family"))).select("id", F.lit("conflicting_classification").alias("class"), F.lit(40).alias("points"), F.lit("unknown").alias("family"))
    return most.unionByName(clash).withColumn("place", F.row_number().over(w)).select("id", "class", "family", "points", "place")
