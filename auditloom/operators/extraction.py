"""Extraction: words to lines, windows, candidates, selections and findings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.functions import names as nm
from auditloom.functions import text as tx
from auditloom.functions import vocabulary as vc
from auditloom.functions.markdown import findings
from auditloom.functions.statements import basis_points, matched, stated
from auditloom.operators.rules import Profile, Rule, evaluated


def words_of(docs: DataFrame, *more: str) -> DataFrame:
    """A word table: one row for each token of a document with a box on a page of eight words a line, and more columns of the document."""
    w = docs.select(F.col("doc_id").alias("case_id"), *more, F.posexplode(F.split(F.trim("text"), r"\s+")).alias("word_ix", "text"))
    n, ix = F.length("text"), F.col("word_ix")
    x0, y0 = 40 * (ix % 8), 28 * F.floor(ix / 8) + (n + ix) % 7
    return w.select("case_id", *more, "word_ix", "text", x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), (x0 + 8 * n).cast("double").alias("x1"), (y0 + 16 + ix % 5).cast("double").alias("y1"), F.when(ix % 17 != 0, 40 + (7 * n + 13 * ix) % 61).cast("int").alias("raw_confidence"))


def map_word_geometry(words: DataFrame, passes: DataFrame) -> DataFrame:
    """Word boxes in the frame of the whole picture: scale, turn and crop undone, clamped; boxes outside go. passes: case_id and PASS, one row a case."""
    return in_frame(words.join(passes, "case_id"))


#: Columns that tell how a pass saw its picture.
PASS = ["rotate", "scale", "crop_x", "crop_y", "w", "h"]


def in_frame(j: DataFrame) -> DataFrame:
    """What map_word_geometry returns, for words that have the columns PASS of their case; nothing is shuffled."""
    u = {c: F.col(c) / F.col("scale") for c in ("x0", "y0", "x1", "y1")}
    pw, ph = F.col("w") / F.col("scale"), F.col("h") / F.col("scale")
    turn = lambda a, b, c, d: F.when(F.col("rotate") == 90, a).when(F.col("rotate") == 180, b).when(F.col("rotate") == 270, c).otherwise(d)
    x0, y0 = turn(u["y0"], pw - u["x1"], ph - u["y1"], u["x0"]), turn(pw - u["x1"], ph - u["y1"], u["x0"], u["y0"])
    x1, y1 = turn(u["y1"], pw - u["x0"], ph - u["y0"], u["x1"]), turn(pw - u["x0"], ph - u["y0"], u["x1"], u["y1"])
    clamp = lambda v, most: F.round(F.greatest(F.lit(0.0), F.least(v, most.cast("double"))), 4)
    moved = j.select("case_id", "word_ix", clamp(x0 + F.col("crop_x"), F.col("w")).alias("x0"), clamp(y0 + F.col("crop_y"), F.col("h")).alias("y0"), clamp(x1 + F.col("crop_x"), F.col("w")).alias("x1"), clamp(y1 + F.col("crop_y"), F.col("h")).alias("y1"))
    return moved.filter("x1 > x0 AND y1 > y0")


def group_lines(words: DataFrame, tolerance: float = 20.0) -> DataFrame:
    """Adds line: in order of centre, left edge and number, a word joins the line whose first word's centre is within the tolerance, else it begins one.

    Words come sorted, so only the last line can be near enough; one pass over the sorted rows of each task does it.
    """
    ordered = words.withColumn("centre", (F.col("y0") + F.col("y1")) / 2).repartition(F.xxhash64("case_id")).sortWithinPartitions("case_id", "centre", "x0", "word_ix")  # hashed, as an exchange by the column itself is left out behind a join on it, which adaptive planning may spread
    columns = [c for c in ordered.columns if c != "line"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        case, start, line = None, 0.0, -1
        for batch in batches:
            out = []
            for c, y in zip(batch.column(columns.index("case_id")).to_pylist(), batch.column(columns.index("centre")).to_pylist()):
                if c != case or line < 0:
                    case, start, line = c, y, 0
                elif y - start > tolerance:
                    start, line = y, line + 1
                out.append(line)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=[*columns, "line"])

    return ordered.select(*columns).mapInArrow(run, ordered.select(*columns).schema.add("line", "long"))


def line_windows(words: DataFrame, signal: str, marker: str, most: int = 7) -> DataFrame:
    """Spans of 2 to `most` neighbouring words of a line that hold both a signal and a marker. words: case_id, line, ix, text."""
    w = Window.partitionBy("case_id", "line").orderBy("ix").rowsBetween(0, most - 1)
    ahead = words.withColumn("ahead", F.collect_list("text").over(w))
    # cheap test first: the longest span must hold both
    whole = F.array_join("ahead", " ")
    near = ahead.filter(whole.rlike(signal) & whole.rlike(marker) & (F.size("ahead") > 1))
    spans = near.select("case_id", "line", "ix", F.explode(F.transform(F.sequence(F.lit(2), F.size("ahead")), lambda n: F.struct(n.alias("n"), F.array_join(F.slice("ahead", F.lit(1), n), " ").alias("span")))).alias("s"))
    return spans.select("case_id", "line", "ix", "s.n", "s.span").filter(F.col("span").rlike(signal) & F.col("span").rlike(marker))


def adjacent_lines(words: DataFrame) -> DataFrame:
    """Lines with the next one where gap and offset are small enough to read them as one."""
    lines = words.groupBy("case_id", "line").agg(F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))
    w = Window.partitionBy("case_id").orderBy("line")
    n = lines.select("case_id", "line", "y0", "y1", "x0", "x1", *[F.lead(c).over(w).alias(f"n{c}") for c in ("line", "y0", "y1", "x0", "x1")]).filter("nline IS NOT NULL")
    height = ((F.col("y1") - F.col("y0")) + (F.col("ny1") - F.col("ny0"))) / 2
    offset = F.abs((F.col("x0") + F.col("x1")) - (F.col("nx0") + F.col("nx1"))) / 2 / F.greatest(F.col("x1") - F.col("x0"), F.col("nx1") - F.col("nx0"))
    return n.filter((F.col("ny0") - F.col("y1") <= 1.8 * height) & (offset <= 0.9)).select("case_id", "line", F.col("nline").alias("next_line"))


def match_statements(texts: DataFrame) -> DataFrame:
    """Adds kind, low and high (basis points), reason and operations to each statement as it was read from a picture."""
    return matched(texts, "statement")


def select_statement(candidates: DataFrame) -> DataFrame:
    """The best value of each case and its state. candidates: case_id, value, score (0 to 1).

    Equal values count once, with their best score; a rival within 0.2 of the best makes the case ambiguous, a best below 0.6 makes it unsure.
    """
    best = candidates.groupBy("case_id", "value").agg(F.max("score").alias("score"), F.count("*").alias("support"))
    w = Window.partitionBy("case_id").orderBy(F.desc("score"), "value")
    ranked = best.withColumn("k", F.row_number().over(w)).withColumn("rival", F.lead("score").over(w)).filter("k = 1")
    state = F.when(F.col("rival") >= F.col("score") - 0.2, "AMBIGUOUS").when(F.col("score") < 0.6, "LOW_CONFIDENCE").otherwise("OBSERVED")
    return ranked.select("case_id", "value", "score", "support", state.alias("state"))


def filter_name_lines(lines: DataFrame) -> DataFrame:
    """Adds value (the line as a name could be written) and reason: why it is no name, or which kind of candidate. lines: text."""
    return lines.withColumn("value", nm.cleaned(F.col("text"))).withColumn("reason", nm.line_reason(F.col("text"), F.col("value")))


#: Columns of a name candidate: case_id, id, value, words (array of text, confidence), line (of a merge the upper one), merged,
#: positive, evidence (0 to 1), x, y, width, height, passes (array), and where it is a merge alignment and proximity.


def trim_windows(candidates: DataFrame, most: int = vc.NAME_WORDS) -> DataFrame:
    """(case_id, id, first, n, span): runs of 1 to `most` words, shorter than the line, of positive lines of which more than a quarter looks like no name. A run begins and ends with a word that has a letter or digit."""
    whole = candidates.filter(F.col("positive")).withColumn("residual", nm.residual(F.col("words"))).filter("residual > 0.25").withColumn("k", F.size("words"))
    starts = whole.select("case_id", "id", "words", "k", F.explode(F.sequence(F.lit(1), F.col("k"))).alias("first"))
    runs = starts.select("case_id", "id", "words", "k", "first", F.explode(F.sequence(F.lit(1), F.least(F.lit(most), F.col("k") - F.col("first") + 1))).alias("n")).filter("n < k")
    text = F.transform(F.slice("words", F.col("first"), F.col("n")), lambda w: w["text"])
    told = runs.select("case_id", "id", "first", "n", text.alias("t"))
    return told.filter(F.element_at("t", 1).rlike("[A-Za-z0-9]") & F.element_at("t", -1).rlike("[A-Za-z0-9]")).select("case_id", "id", "first", "n", F.array_join("t", " ").alias("span"))


def merge_adjacent_seeds(candidates: DataFrame, top: int = 3, passes: str = "pass_id") -> DataFrame:
    """(case_id, pass, line, upper, lower, value, alignment, proximity): pairs of the best seeds of a line and of the next line of one pass.

    Seeds with one key count once, with their best score. One of a pair is positive, they stand over each other
    (alignment 0.3 or more) and near (proximity above 0), and have six words and three tokens with letters at most.
    """
    informative = F.size(F.filter(nm.tokens(F.col("value")), lambda t: F.length(t) >= 3))
    seeds = candidates.withColumn("seed", F.when(F.col("positive"), 2).otherwise(0) + informative + F.col("evidence") + F.col("height") / 100)
    same = Window.partitionBy("case_id", passes, "line", nm.key(F.col("value"))).orderBy(F.desc("seed"), "id")
    w = Window.partitionBy("case_id", passes, "line").orderBy(F.desc("seed"), "id")
    best = seeds.withColumn("_k", F.row_number().over(same)).filter("_k = 1").withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= top)
    keep = ["id", "words", "positive", "x", "y", "width", "height"]
    upper = best.select("case_id", passes, "line", F.struct(*keep).alias("a"))
    lower = best.select("case_id", passes, (F.col("line") - 1).alias("line"), F.struct(*keep).alias("b"))
    over = F.greatest(F.lit(0.0), F.least(F.expr("a.x + a.width"), F.expr("b.x + b.width")) - F.greatest("a.x", "b.x")) / F.greatest(F.lit(1.0), F.least("a.width", "b.width"))
    offset = F.abs(F.expr("a.x + a.width / 2 - b.x - b.width / 2")) / F.greatest("a.width", "b.width", F.lit(1.0))
    gap = F.greatest(F.lit(0.0), F.expr("b.y - a.y - a.height")) / (1.5 * F.greatest(F.lit(1.0), F.expr("(a.height + b.height) / 2")))
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    words = F.concat("a.words", "b.words")
    pairs = upper.join(lower, ["case_id", passes, "line"]).filter("a.positive OR b.positive").withColumns({"alignment": clip(F.greatest(over, 1 - offset)), "proximity": clip(1 - gap), "value": nm.cleaned(F.array_join(F.transform(words, lambda t: t["text"]), " ")), "n_words": F.size(words)})
    fit = (F.col("alignment") >= 0.3) & (F.col("proximity") > 0) & (F.col("n_words") <= vc.NAME_WORDS + 2) & (F.size(nm.lettered(F.col("value"))) <= 3)
    return pairs.filter(fit).select("case_id", passes, "line", F.col("a.id").alias("upper"), F.col("b.id").alias("lower"), "value", F.round("alignment", 6).alias("alignment"), F.round("proximity", 6).alias("proximity"))


def score_candidates(candidates: DataFrame, wide: int = 800, high: int = 600) -> DataFrame:
    """Adds the eleven factors of each candidate and their weighted sum, total. Heights and areas count by the most of the case; wide, high: the picture's size."""
    case = Window.partitionBy("case_id")
    off = F.abs(F.col("x") + F.col("width") / 2 - wide / 2) / (wide / 2) + F.abs(F.col("y") + F.col("height") / 2 - high / 2) / (high / 2)
    own = nm.word_factors(F.col("value"), F.col("words"), F.col("positive")) | {
        "evidence": F.col("evidence"), "centrality": F.greatest(F.lit(0.0), 1 - off / 2), "alignment": F.coalesce("alignment", F.lit(1.0)), "proximity": F.coalesce("proximity", F.lit(1.0)),
    }
    area = F.greatest(F.lit(1.0), F.col("width") * F.col("height"))
    of_case = {"prominence": F.coalesce(F.col("height") / F.nullif(F.max("height").over(case), F.lit(0)), F.lit(0.0)), "area": F.col("_size") / F.max("_size").over(case)}
    # factors are whole millionths and weights whole hundredths, so their sum is exact whatever the order
    whole = lambda factors: {f"_{k}": F.floor(c * 1_000_000 + 0.5).cast("long") for k, c in factors.items()}
    added = lambda names: sum((F.col(f"_{k}") * F.lit(round(100 * vc.WEIGHTS[k])) for k in names if k in vc.WEIGHTS), F.lit(0).cast("long"))
    # what a candidate's own columns give is worked out before cases meet, so that its words needn't go along
    told = candidates.withColumns(whole(own) | {"_size": area}).withColumn("_own", added(own)).withColumns(whole(of_case))
    total = (F.col("_own") + added(of_case)) / F.lit(100_000_000.0)
    return told.withColumn("total", total).withColumns({f"f_{k}": F.col(f"_{k}") / F.lit(1_000_000.0) for k in [*own, *of_case]}).drop(*[f"_{k}" for k in [*own, *of_case]], "_size", "_own")


def select_name(scored: DataFrame) -> DataFrame:
    """The choice of each case: (case_id, id, value, total, passes, rivals, state, reason).

    Of the candidates of a line the best total stays, and of those with one key, with the passes of all. Candidates that stand
    clearly above the floor of the case's best height come first, by total; the others follow by height. A choice is
    OBSERVED if it is positive and its evidence reaches 0.6; a rival, that is another name of at least 0.8 of its height,
    or any other name beside weak evidence, makes it AMBIGUOUS, and so does a choice that nothing marks as a name.
    """
    best_of = lambda *by: Window.partitionBy("case_id", *by).orderBy(F.desc("total"), F.desc("evidence"), "id")
    named = scored.withColumn("key", nm.key(F.col("value"))).withColumn("top", F.max("height").over(Window.partitionBy("case_id")))
    family = named.withColumn("_k", F.row_number().over(best_of("line", "merged"))).filter("_k = 1")
    # windows that can share an order stand behind each other, so that rows are sorted once for both
    support = F.array_sort(F.array_distinct(F.flatten(F.collect_list("passes").over(Window.partitionBy("case_id", "key")))))
    one = family.withColumn("_k", F.row_number().over(best_of("key"))).withColumn("support", support).filter("_k = 1")
    first = F.col("height") > vc.FLOOR * F.col("top") + vc.BUFFER
    order = [F.desc(first), F.desc(F.when(first, F.col("total")).otherwise(F.col("height"))), F.desc(F.when(first, F.col("height")).otherwise(F.col("evidence"))), F.desc(F.when(first, F.col("evidence")).otherwise(F.col("total"))), F.col("key")]
    w = Window.partitionBy("case_id").orderBy(*order)
    ranked = one.withColumns({"_k": F.row_number().over(w), "_best": F.first(F.struct("key", "height")).over(w)})
    other = ranked.withColumn("other", (F.col("_k") > 1) & ~nm.corroborate(F.col("key"), F.col("_best.key")))
    told = other.groupBy("case_id").agg(F.min(F.when(F.col("_k") == 1, F.struct("id", "value", "total", "support", "evidence", "positive"))).alias("b"), F.count_if(F.col("other") & (F.col("height") >= vc.RIVAL * F.col("_best.height"))).alias("rivals"), F.count_if("other").alias("others"))
    contested = (F.col("rivals") > 0) | ((F.col("b.evidence") < vc.UNSURE) & (F.col("others") > 0))
    sure = F.col("b.positive") & (F.col("b.evidence") >= vc.UNSURE)
    reason = F.when(contested, "competing_candidates").when(~sure, "single_unconfirmed_candidate")
    return told.select("case_id", "b.id", "b.value", "b.total", F.array_join("b.support", ",").alias("passes"), "rivals", F.when(contested | ~sure, "AMBIGUOUS").otherwise("OBSERVED").alias("state"), reason.alias("reason"))


def merge_support(candidates: DataFrame) -> DataFrame:
    """The passes that support each value of a case, in order."""
    return candidates.groupBy("case_id", "value").agg(F.array_join(F.transform(F.array_sort(F.collect_set("priority")), lambda x: x.cast("string")), ",").alias("passes"), F.max("score").alias("score"))


def confidence_summary(words: DataFrame, by: list[str]) -> DataFrame:
    """Mean, least and highest confidence, words without one, and the mean clipped to 0 to 1."""
    return words.groupBy(*by).agg(F.count("*").alias("words"), F.round(F.avg("raw_confidence"), 4).alias("mean"), F.min("raw_confidence").alias("low"), F.max("raw_confidence").alias("high"), F.count_if(F.col("raw_confidence").isNull()).alias("missing"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.avg("raw_confidence") / 100)), 6).alias("score"))


def quantity_summary(texts: DataFrame) -> DataFrame:
    """All quantities in millilitres by group; n counts texts, found quantities. texts: grp, text."""
    all_ = texts.select("grp", F.explode_outer(F.when(F.size(tx.quantities(F.col("text"))) > 0, tx.quantities(F.col("text")))).alias("ml"))
    found = all_.groupBy("grp").agg(F.count("ml").alias("found"), F.min("ml").alias("low"), F.max("ml").alias("high"), F.round(F.avg("ml"), 4).alias("mean"))
    return texts.groupBy("grp").agg(F.count("*").alias("n")).join(found, "grp").select("grp", "n", "found", "low", "high", "mean")


def key_groups(texts: DataFrame, key: Column) -> DataFrame:
    """Rows whose keys agree: variants and their number."""
    return texts.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.countDistinct("text").alias("variants"), F.min("text").alias("sample"))


def declared_vs_observed(pairs: DataFrame) -> DataFrame:
    """How a declared and an observed text compare. pairs: id, declared, observed."""
    a, b = tx.canonical(F.col("declared")), tx.canonical(F.col("observed"))
    return pairs.select("id", F.when(F.col("declared") == F.col("observed"), "exact").when(a == b, "equivalent").otherwise("different").alias("equivalence"), tx.similarity(a, b).alias("similarity"))


def evaluate_rules(cases: DataFrame, profile: Profile | None = None) -> DataFrame:
    """One finding for each case and rule of a profile, that of wine labels if none is given. cases: case_id, sufficient, and what the profile's rules and its preparation read (the given one: state, statement, declared, brand, declared_brand)."""
    return evaluated(cases, profile or wine_profile())


def wine_profile() -> Profile:
    """The rules for wine labels; those that need evidence from elsewhere never run."""
    seen = (F.col("state") != "NOT_OBSERVED") & F.col("statement").isNotNull()
    unsure = F.col("state") == "AMBIGUOUS"
    blank = F.col("declared").isNull() | (F.trim("declared") == "")
    syntax = F.when(~seen | unsure, "NEEDS_REVIEW").when(F.col("kind").isin("direct", "range"), "PASS").otherwise("FAIL")
    compare = F.when(blank | ~seen | unsure | (F.col("kind") != "direct") | F.col("points").isNull(), "NEEDS_REVIEW").when(F.col("points") == F.col("low"), "PASS").otherwise("FAIL")
    no_brand = F.col("brand").isNull() | F.col("declared_brand").isNull() | (F.trim("declared_brand") == "") | unsure
    alike = (F.col("_brand") == F.col("_declared_brand")) | (F.col("_brand_key") == F.col("_declared_brand_key"))
    brand = F.when(no_brand, "NEEDS_REVIEW").when(alike, "PASS").otherwise("FAIL")

    def prepare(cases: DataFrame) -> DataFrame:
        # each step is a projection of its own, so that what several others read is worked out once a case
        told = stated(cases, "statement").withColumn("_points", F.regexp_replace(F.trim("declared"), r"\s*%$", "")).withColumn("points", basis_points(F.col("_points")))
        return tx.with_brand_keys(told, "brand", "declared_brand")

    elsewhere = [Rule(x, "1", "external-evidence-dependent") for x in ("actual-tolerance", "omission-eligibility", "class-boundary")]
    return Profile("wine", "1", [Rule("alcohol-syntax", "1", "syntax-validation", syntax), Rule("brand-name", "1", "canonical-text-comparison", brand), Rule("alcohol-declared", "1", "numeric-agreement", compare), *elsewhere], prepare)


def evidence_sufficiency(cases: DataFrame) -> DataFrame:
    """Whether a case's evidence suffices for each check, and why. cases: case_id, state, has_value, processed, same_digest."""
    common = F.when(~F.col("same_digest"), "DERIVATIVE_HASH_MISMATCH").when(~F.col("processed"), "ARTIFACT_REGION_NOT_PROCESSED")
    unseen = F.col("state") == "NOT_OBSERVED"
    brand = F.coalesce(common, F.when(unseen, "BRAND_NOT_OBSERVED").when(~F.col("has_value"), "BRAND_VALUE_EMPTY").otherwise("BRAND_OBSERVATION_PRESENT"))
    alcohol = F.coalesce(common, F.when(unseen, "ALCOHOL_NOT_OBSERVED_BUT_PROCESSED").when(~F.col("has_value"), "ALCOHOL_VALUE_EMPTY").otherwise("ALCOHOL_OBSERVATION_PRESENT"))
    fine = ["BRAND_OBSERVATION_PRESENT", "ALCOHOL_OBSERVATION_PRESENT", "ALCOHOL_NOT_OBSERVED_BUT_PROCESSED"]
    both = F.explode(F.array(F.struct(F.lit("brand").alias("check"), brand.alias("reason")), F.struct(F.lit("alcohol").alias("check"), alcohol.alias("reason"))))
    return cases.select("case_id", both.alias("x")).select("case_id", "x.check", "x.reason", F.col("x.reason").isin(fine).alias("sufficient"))


#: Bits of the filter that tells where an anchor may begin, at most; bytes of texts whose places are hashed at once; the multiplier of the hash, and what undoes it.
FILTER, PIECE, TURN = 27, 1 << 18, 0x9E3779B97F4A7C15
BACK = pow(TURN, -1, 1 << 64)


def _place(h: np.ndarray, bits: int, k: int) -> np.ndarray:
    """The first (k 0) or second (k 1) bit of a filter of 2 ** bits that stands for a hash."""
    return (h * np.uint64(BACK) if k else h) >> np.uint64(64 - bits)


def _anchored(passages: DataFrame, size: int) -> DataFrame:
    """Adds n and h: of how many bytes a passage's anchor is, and its hash. An anchor is the passage's first bytes, the largest power of two that it has, up to `size`; none of an empty one."""
    sizes = [1 << k for k in range(size.bit_length())]
    length = F.coalesce(F.greatest(F.lit(0), *[F.when(F.octet_length("passage") >= k, k) for k in sizes]), F.lit(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = []
            for text, n in zip(batch.column("passage").to_pylist(), batch.column("n").to_pylist()):
                h = sum(b * pow(TURN, k, 1 << 64) for k, b in enumerate(text.encode()[:n])) % (1 << 64)
                told.append(h - (1 << 64) if h >> 63 else h)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(told, pa.int64())], names=[*batch.schema.names, "h"])

    rows = passages.select("item_id", "passage", length.alias("n"))
    return rows.mapInArrow(run, rows.select("*").schema.add("h", "long"))


def _filter(anchors: DataFrame, n: int) -> tuple[int, np.ndarray]:
    """A bit filter of n anchors: how many bits, and the bits by bytes; 2 ** FILTER bits at most, whatever n is."""
    bits = min(FILTER, max(20, (n << 10).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0).to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([_place(h, bits, k) for k in (0, 1)]).astype(np.int64) + 1)], names=["p"])

    blocks = anchors.select("h").mapInArrow(run, "p long").groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m"))
    out = np.zeros((1 << bits) // 8, np.uint8)
    for b, m in blocks.collect():  # 2 ** bits / 32768 rows of 4 kB at most
        out[(b - 1) * 4096 : b * 4096] = np.frombuffer(m, np.uint8)
    return bits, out


def contamination(docs: DataFrame, passages: DataFrame, size: int = 64) -> DataFrame:
    """(doc_id, item_id) of documents that contain a passage, white space apart: an index of the passages' anchors, then the exact test.

    Every place of a document is hashed, as many bytes as anchors have, by differences of running sums; what the filter of
    anchors lets through meets the anchors by a join. Texts are shuffled only where an anchor stands in them.
    """
    norm = lambda c: F.trim(F.regexp_replace(c, r"[\t\n\f\r ]+", " "))
    anchors = _anchored(passages.select("item_id", norm("text").alias("passage")).filter("passage IS NOT NULL"), size)
    counts = {r["n"]: r["count"] for r in anchors.groupBy("n").count().collect()}  # a row a power of two
    sizes = sorted(n for n in counts if n)
    most = max(sizes, default=1)
    shared = docs.sparkSession.sparkContext.broadcast(_filter(anchors.filter("n > 0"), sum(counts[n] for n in sizes)))
    d = docs.select("doc_id", norm("text").alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, known = shared.value
        powers, undone = (np.cumprod(np.r_[np.uint64(1), np.full(PIECE + most - 1, x, np.uint64)]) for x in (TURN, BACK))
        for batch in batches:
            texts = batch.column("body")
            wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
            at = np.frombuffer(texts.buffers()[1], wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            found = [np.empty((3, 0), np.int64)]
            if 0 in counts:
                whole = np.flatnonzero(texts.is_valid().to_numpy(zero_copy_only=False))
                found.append(np.stack((whole, np.zeros_like(whole), np.zeros_like(whole))))
            for start in range(at[0], at[-1], PIECE) if sizes else ():
                piece = data[start : min(start + PIECE + most - 1, at[-1])]
                sums = np.r_[np.uint64(0), np.cumsum(piece * powers[: len(piece)])]
                for n in sizes:
                    ends = min(PIECE, len(piece) - n + 1)
                    if ends <= 0:
                        continue
                    h = (sums[n : n + ends] - sums[:ends]) * undone[:ends]
                    here = np.arange(ends)
                    for k in (0, 1):  # the second bit only where the first is set
                        place = _place(h[here] if k else h, bits, k)
                        here = here[(known[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1]
                    row = np.searchsorted(at, start + here, "right") - 1
                    inside = start + here + n <= at[row + 1]  # no anchor goes over the end of its text
                    found.append(np.unique(np.stack((row[inside], np.full(inside.sum(), n), h[here[inside]].view(np.int64))), axis=1))
            rows = np.unique(np.concatenate(found, axis=1), axis=1)
            for k in range(0, rows.shape[1], 256):
                row, n, h = rows[:, k : k + 256]
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(row)).columns, pa.array(n.astype(np.int32)), pa.array(np.ascontiguousarray(h))], names=[*batch.schema.names, "n", "h"])

    hits = d.mapInArrow(run, d.select("*").schema.add("n", "integer").add("h", "long"))
    return hits.join(anchors, ["n", "h"]).filter(F.expr("contains(body, passage)")).select("doc_id", "item_id")


def broken_links(pages: DataFrame) -> DataFrame:
    """Links of pages that lead to no page: paths that none of the urls has, with how many pages name them."""
    links = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("link"))
    paths = pages.select(F.regexp_extract("url", r"^https?://[^/]+(/[^?#]*)", 1).alias("link")).distinct()
    return links.join(paths, "link", "left_anti").groupBy("link").agg(F.countDistinct("page_id").alias("pages"))


def document_lint(docs: DataFrame) -> DataFrame:
    """(doc_id, line, code) of all that is wrong with a Markdown text: an unclosed fence, how it ends, headings, tables, links and the title. Row by row; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, *f) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for f in findings(t)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 3, (pa.int64(), pa.int32(), pa.string()))], names=["doc_id", "line", "code"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, line int, code string")


def duplicate_lines(docs: DataFrame) -> DataFrame:
    """Lines that stand in a text more than once, by their slug."""
    slug = F.regexp_replace(F.trim(F.regexp_replace(F.lower("line"), r"[^a-z0-9 ]", "")), " +", "-")
    lines = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", slug.alias("slug")).filter("slug <> ''")
    return lines.groupBy("doc_id", "slug").agg(F.count("*").alias("n")).filter("n > 1")
