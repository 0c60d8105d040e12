"""Texts against other texts: what a run repeats of earlier runs, longest common parts, accent-free keys, lines that only some classes have."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that show a text to compare itself with another one.
COMPARING = ["PREVIOUS", "BEFORE", "COMPARE", "COMPARISON"]


# Characters whose upper case is several characters, each with the one that takes its place where every character stays one (or itself).
SPELT = {c: c.title() if len(c.title()) == 1 else c for c in map(chr, range(0x149, 0x110000)) if len(c.upper()) > 1}
# Letters that got capitals only with Unicode 16: they stay.
NEWER = {c: c for c in ["ƛ", "ɤ", "\u1c8a", "\ua7cd", "\ua7db", *map(chr, range(0x10D70, 0x10D86))]}


def upper(text: Column) -> Column:
    """Upper case character by character, as SQL engines without full case mapping have it: ß becomes ẞ, not SS, so it isn't taken for ss."""
    apart, changed = "".join(SPELT | NEWER), {k: v for k, v in SPELT.items() if k != v}
    # the range before the list keeps common characters from being looked for in all of it
    is_apart, others = f"[\u0149-\U0010ffff&&[{apart}]]", f"[^{apart}]+"
    one = lambda x: F.when(x.rlike(is_apart), F.translate(x, "".join(changed), "".join(changed.values()))).otherwise(F.upper(x))
    each = lambda t: F.when(t.rlike(is_apart), F.array_join(F.transform(F.regexp_extract_all(t, F.lit(f"(?s){others}|."), 0), one), "")).otherwise(F.upper(t))
    return F.transform(F.array(F.replace(text, F.lit("ß"), F.lit("ẞ"))), each)[0]


def folded(text: Column) -> Column:
    """Upper case, character by character, with single spaces; '' for null. A vertical tab is no white space here."""
    return upper(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\n\f\r]+", " ")))


def _grams(text: Column, n: Column) -> Column:
    """All runs of n characters of a text, each once; none if it is shorter."""
    runs = F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda at: F.substring(text, at, n))
    return F.when(F.length(text) >= n, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def run_signals(runs: DataFrame, size: int = 5) -> DataFrame:
    """(log, sequence, run_id, kind, token, first_sequence): what a run's text holds of what earlier runs of its log brought with them.

    runs: log, sequence, run_id, text, tokens (array of kind, token). A token is one that any run of the log with a smaller
    sequence brought first; it counts, once for each kind, if it is part of the text (case and white space apart) and the run didn't
    bring it itself. Kind `comparison` has words that speak of a comparison. Null texts and tokens hold and are nothing;
    rows that share log, sequence and run_id share their tokens, and their texts are looked through one by one.

    An index of first sequences by token takes the place of a look at all earlier runs. A token meets texts by the rarest of its runs
    of `size` characters (of all it has, if it is shorter), so a run that all texts have is looked for only if a token has no other.
    All sides come out of explodes, whose size Spark takes for that of the table before; the hint keeps them from being broadcast.
    """
    key = ["log", "sequence", "run_id"]
    texts = runs.select(*key, folded(F.col("text")).alias("body")).filter("body <> ''").distinct()
    brought = runs.select(*key, F.explode("tokens").alias("t")).select(*key, "t.kind", folded(F.col("t.token")).alias("token")).filter("token <> ''").distinct()
    first = brought.groupBy("log", "kind", "token").agg(F.min("sequence").alias("first_sequence"))
    n = F.least(F.lit(size), F.length("token"))
    parts = first.select("log", "token").distinct().select("log", "token", n.alias("n"), F.explode(_grams(F.col("token"), n)).alias("g"))
    lengths = sorted(r["n"] for r in parts.select("n").distinct().collect())  # `size` numbers at most
    if not lengths:
        lengths = [size]
    # a look ahead from each place takes time linear in the text, a substring at each place takes the square of it
    of_length = lambda x: F.transform(F.array_distinct(F.regexp_extract_all("body", F.lit(f"(?s)(?=(.{{{x}}}))"), 1)), lambda g: F.struct(F.lit(x).alias("n"), g.alias("g")))
    each = F.flatten(F.array(*map(of_length, lengths)))
    grams = texts.select(*key, F.xxhash64("body").alias("text_id"), F.explode(each).alias("x")).select(*key, "text_id", "x.n", "x.g")
    often = grams.groupBy("log", "n", "g").agg(F.count("*").alias("texts"))
    # all of a token's runs are in some text, or the token is in none
    rarest = parts.join(often.hint("merge"), ["log", "n", "g"], "left").groupBy("log", "token").agg(F.min(F.struct("texts", "n", "g")).alias("a"), F.count_if(F.col("texts").isNull()).alias("unseen")).filter("unseen = 0")
    anchors = rarest.select("log", "token", "a.n", "a.g").join(first.hint("merge"), ["log", "token"])
    met = grams.join(anchors.hint("merge"), ["log", "n", "g"]).filter(F.col("sequence") > F.col("first_sequence")).select(*key, "text_id", "kind", "token", "first_sequence")
    held = met.join(texts.withColumn("text_id", F.xxhash64("body")).hint("merge"), [*key, "text_id"]).filter(F.expr("contains(body, token)")).select(*key, "kind", "token", "first_sequence").distinct()
    foreign = held.join(brought.hint("merge"), [*key, "kind", "token"], "left_anti")
    words = F.array_intersect(F.array(*map(F.lit, COMPARING)), F.regexp_extract_all("body", F.lit(r"[A-Z0-9_]+"), 0))
    compared = texts.select(*key, F.lit("comparison").alias("kind"), F.explode(words).alias("token"), F.lit(None).cast(first.schema["first_sequence"].dataType).alias("first_sequence")).distinct()
    return foreign.select(*key, "kind", "token", "first_sequence").unionByName(compared)


class Automaton:
    """The suffix automaton of a text: a state for each set of places where a part of it ends. Built and read in time linear in the lengths."""

    def __init__(self, text: str) -> None:
        self.text, self.longest, self.link, self.next, self.end = text, [0], [-1], [{}], [0]
        last = 0
        for at, c in enumerate(text, 1):
            new = self._state(at, {}, at)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p < 0:
                self.link[new] = 0
            else:
                q = self.next[p][c]
                if self.longest[q] == self.longest[p] + 1:
                    self.link[new] = q
                else:  # q also ends longer parts: the shorter ones get a state of their own
                    part = self._state(self.longest[p] + 1, dict(self.next[q]), self.end[q])
                    self.link[part] = self.link[q]
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = part
                        p = self.link[p]
                    self.link[q] = self.link[new] = part
            last = new

    def _state(self, longest: int, following: dict[str, int], end: int) -> int:
        self.longest.append(longest)
        self.link.append(0)
        self.next.append(following)
        self.end.append(end)
        return len(self.longest) - 1

    def common(self, other: str) -> tuple[int, int]:
        """Length of the longest part that other also has, and where in the automaton's text its first occurrence starts; of equals the first in the text."""
        state = length = best = at = 0
        for c in other:
            while state and c not in self.next[state]:
                state = self.link[state]
                length = self.longest[state]
            if c in self.next[state]:
                state, length = self.next[state][c], length + 1
            # a state's end is the first place where its parts end
            if length and (length, -(self.end[state] - length)) > (best, -at):
                best, at = length, self.end[state] - length
        return best, at


#: Characters of a truth whose parts are looked for one by one.
SHORT = 128


def common_part(truth: str, text: str, least: int) -> tuple[int, int]:
    """Length of the longest part of at least so many characters that both have, and where it first starts in the truth; (0, 0) if there is none."""
    best, at = least - 1, -1
    for i in range(len(truth) - least + 1):
        while i + best < len(truth) and truth[i : i + best + 1] in text:
            best, at = best + 1, i
    return (best, at) if at >= 0 else (0, 0)


def common_parts(lines: DataFrame, truths: DataFrame, size: int = 5) -> DataFrame:
    """(case_id, truth_length, line, part, length): the longest part that a case's truth has in common with one of its lines.

    lines: case_id, line, text; truths: case_id, truth, one row a case. Case counts as it is written. Of equal lengths the
    smallest line counts, then the part that comes first in the truth. Parts of fewer than `size` characters (or than the truth
    has) are no parts. A case without one has a null line, part '' and length 0. Null texts hold nothing, a null truth is ''.

    Lines go to their case's truth as they are. Parts of a short truth are looked for in a line by the search for strings, which skips
    most of it; a long truth becomes an automaton.
    """
    t = truths.select("case_id", F.coalesce("truth", F.lit("")).alias("truth"))
    texts = lines.select("case_id", "line", "text").filter("text <> ''")
    pairs = texts.join(t.filter("truth <> ''").hint("merge"), "case_id").select("case_id", "line", "text", "truth")
    found = pairs.select("case_id", "line").schema.add("at", T.IntegerType()).add("length", T.IntegerType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Automaton | None = None  # of the truth before, as lines of a case often stand together
        for batch in batches:
            keep, out = [], []
            for i, (text, truth) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                if len(truth) <= SHORT:
                    part = common_part(truth, text, min(size, len(truth)))
                else:
                    if known is None or known.text != truth:
                        known = Automaton(truth)
                    part = known.common(text)
                if part[0] >= min(size, len(truth)):
                    keep.append(i)
                    out.append(part)
            length, at = zip(*out) if out else ((), ())
            ids = [c.take(pa.array(keep, pa.int64())) for c in batch.columns[:2]]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(at, pa.int32()), pa.array(length, pa.int32())], names=["case_id", "line", "at", "length"])

    best = pairs.mapInArrow(run, found).groupBy("case_id").agg(F.min(F.struct((-F.col("length")).alias("l"), "line", "at")).alias("b"))
    joined = t.join(best, "case_id", "left")
    length = F.coalesce(-F.col("b.l"), F.lit(0))
    return joined.select("case_id", F.length("truth").alias("truth_length"), F.col("b.line").alias("line"), F.when(length > 0, F.substring("truth", F.col("b.at") + 1, length)).otherwise("").alias("part"), length.cast("int").alias("length"))


@F.pandas_udf(T.StringType())
def compact(text: pd.Series) -> pd.Series:
    """A key without accents, case and anything but a-z and 0-9; null stays null."""

    def one(t):
        if t is None:
            return None
        plain = "".join(c for c in unicodedata.normalize("NFD", t) if not "̀" <= c <= "ͯ").lower()
        return "".join(c for c in plain if "a" <= c <= "z" or "0" <= c <= "9")

    return text.map(one, na_action="ignore").astype(object)


def class_lines(prints: DataFrame, texts: DataFrame, columns: list[str]) -> DataFrame:
    """(component, class_id, digest, line, classes, others): lines that not all classes of a component have.

    prints: run_id and a digest for each of the columns; texts: component (a column's name), digest, text, one text for each digest. Runs of
    equal digests are one class. A line counts for a class once, trimmed; `classes` is in how many classes of the component it
    stands, `others` in how many it doesn't. So what is unique to one side of any two classes is what the first
    has and the second lacks, null digests have no lines, and no class meets another: lines are counted, and classes are counted once for each digest.
    """
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("component"), F.col(c).alias("digest")) for c in columns]))
    classes = prints.groupBy(*columns).agg(F.min("run_id").alias("class_id")).select("class_id", each.alias("x")).select("class_id", "x.component", "x.digest").filter("digest IS NOT NULL")
    n = classes.groupBy("component", "digest").agg(F.count("*").alias("n"))
    all_ = n.groupBy("component").agg(F.sum("n").alias("all"))
    lines = texts.select("component", "digest", F.explode(F.array_distinct(F.transform(F.split("text", "\n"), lambda x: F.trim(x)))).alias("line")).filter("line <> ''")
    counted = lines.join(n, ["component", "digest"])
    spread = counted.groupBy("component", "line").agg(F.sum("n").alias("classes")).join(all_, "component").filter(F.col("classes") < F.col("all"))
    some = spread.select("component", "line", "classes", (F.col("all") - F.col("classes")).alias("others"))
    return some.join(lines, ["component", "line"]).join(classes, ["component", "digest"]).select("component", "class_id", "digest", "line", "classes", "others")


def key_variants(texts: DataFrame, key: Column, top: int = 5) -> DataFrame:
    """(key, n, variants, samples): rows whose keys agree, how many and how many different texts, and the `top` most frequent of these. texts: text. Rows without a key are left out.

    Equal texts are counted first, so a key that a third of all rows have is no more than its different texts.
    """
    once = texts.groupBy("text").agg(F.count("*").alias("n")).withColumn("key", key).filter("key IS NOT NULL AND key <> ''")
    w = Window.partitionBy("key").orderBy(F.desc("n"), "text")
    most = once.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= top).groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda x: x["text"]), "|").alias("samples"))
    sums = once.groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("variants"))
    return sums.join(most, "key").select("key", "n", "variants", "samples")
