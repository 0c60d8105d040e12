"""Alcohol statements: a text becomes a row of tokens, and the order of its tokens tells what it states.

Each token is one letter of the text's shape: N number, P percent sign, L alcohol, A alc, B by, V volume, S slash, T to or dash,
X proof. What is no such token stays in the shape as it is, so that such a text has a shape that nothing allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBER = r"\d+(?:[.,]\d+)?"
VOLUME = ["BV", "ASV", "ABV"]
#: Shapes of whole statements: one value, or a lower and an upper one.
DIRECT = [f"NP{v}" for v in VOLUME] + [f"{a}N{p}{v}" for a in "AL" for p in ("", "P") for v in ("BV", "V")]
RANGE = [f"{a}N{p}TNP{v}" for a in ("", "A", "L") for p in ("", "P") for v in VOLUME]
#: Shapes that a window read from a picture may have, and why each is accepted.
ACCEPTED = {
    **{f"{a}N{p}TNPBV": "explicit-percent-by-volume" for a in ("", "A", "L") for p in ("", "P")}, "NPBV": "explicit-percent-by-volume",
    **dict.fromkeys(["NPASV", "NPABV", *(f"{a}{x}" for a in "AL" for x in ("NPBV", "PNBV", "NPV"))], "explicit-percent-alc-vol"), **dict.fromkeys([f"{a}N{v}" for a in "AL" for v in ("BV", "V")], "explicit-percentless-alcohol-by-volume"),
}
# How marker words are spelled, by what a picture may make of them once 0, 1 and i are read as o and l; and words that stand for two.
MARKERS = {"alc": "alc", "vol": "vol", "volume": "volume"}
DOUBLES = {"abv": "by vol", "byvol": "by vol", "byvolume": "by volume"}
#: What letters of a token are, beside those that are read as digits.
SHAPES = {"%": "P", "alcohol": "L", "alc": "A", "volume": "V", "vol": "V", "by": "B", "/": "S", "through": "T", "to": "T", "-": "T", "–": "T", "—": "T", "proof": "X"}


def plain(text: Column) -> Column:
    """Lower case with single spaces; null is empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+", " "))


def shape(norm: Column) -> Column:
    """The letters of a text's tokens. A point right behind a marker belongs to it; a word that goes on from a number is a number and a question mark."""
    found = F.regexp_extract_all(norm, F.lit(r"\d+[.,]\d+(?!\w)|[\p{L}\p{N}_]+\.?|\S"), 0)
    known = F.create_map(*[F.lit(x) for pair in SHAPES.items() for x in pair])
    digits = lambda t: F.translate(t, "0123456789", "")
    letter = lambda t: F.coalesce(F.try_element_at(known, t), F.when(t.rlike(r"^(?=[.,]?\d)\d*[.,]?\d*$"), "N").when(digits(t) != t, F.concat(F.lit("N"), digits(t), F.lit("?"))).otherwise(t))
    base = lambda t: F.when(F.length(t) > 1, F.rtrim(t, F.lit("."))).otherwise(t)
    pointed = lambda x: F.when((x["b"] != x["t"]) & ~letter(x["b"]).isin("A", "V"), ".").otherwise("")
    based = F.transform(found, lambda t: F.struct(t.alias("t"), base(t).alias("b")))  # a token's base is read several times
    return F.array_join(F.transform(based, lambda x: F.concat(letter(x["b"]), pointed(x))), "")


def number(norm: Column, n: int) -> Column:
    """The n-th number of a text, null if there are fewer."""
    return F.try_element_at(F.regexp_extract_all(norm, F.lit(NUMBER), 0), F.lit(n))


def basis_points(text: Column) -> Column:
    """A decimal text as hundredths of a percent; null if it has more than two decimals or is above 100."""
    points = (F.regexp_replace(text, ",", ".").cast("decimal(11,2)") * 100).cast("int")
    return F.when(text.rlike(r"^\d{1,5}(?:[.,]\d{1,2})?$") & (points <= 10000), points)


def stated(rows: DataFrame, text: str) -> DataFrame:
    """Adds kind (direct, range, proof or malformed), low and high in basis points of whole statements, read strictly."""
    norm, low, high = F.col("_norm"), F.col("_low"), F.col("_high")
    r = rows.withColumn("_norm", plain(F.col(text)))
    r = r.withColumns({"_shape": shape(norm), "_low": basis_points(number(norm, 1)), "_high": basis_points(number(norm, 2))})
    kind = F.when(F.col("_shape").contains("X"), "proof").when(F.col("_shape").isin(RANGE) & (low <= high), "range").when(F.col("_shape").isin(DIRECT) & low.isNotNull(), "direct").otherwise("malformed")
    r = r.withColumn("kind", kind)
    found = F.col("kind").isin("direct", "range")
    return r.withColumn("low", F.when(found, low)).withColumn("high", F.when(F.col("kind") == "range", high).when(found, low)).drop("_norm", "_shape", "_low", "_high")


def repaired(text: Column) -> Column:
    """A text (of `plain`) read from a picture, token by token, with letters that stand for digits in numbers, and markers, put right.

    A token of digits and the letters o, i and l is a number if it has a digit or if a percent sign, or the rest of a number, follows.
    """
    tokens = F.regexp_extract_all(text, F.lit("[a-z0-9]+|[^a-z0-9]"), 0)
    folded = lambda t: F.translate(t, "01i", "oll")
    digits = lambda t: F.translate(t, "oil", "011")
    alike = lambda t: F.translate(t, "0123456789oil", "") == ""
    digit = lambda t: F.translate(t, "0123456789", "") != t
    ends = lambda t: t.isNull() | t.isin(".", ",", "%", " ")
    markers, doubles = (F.create_map(*[F.lit(x) for pair in d.items() for x in pair]) for d in (MARKERS, DOUBLES))

    def read(t: Column, at: Column) -> Column:
        ahead = lambda n: F.try_element_at(tokens, at + n + 1)
        before = F.when(at > 0, F.element_at(tokens, F.greatest(at, F.lit(1))))
        percent = F.coalesce(ahead(1) == "%", F.lit(False))
        goes_on = F.coalesce(ahead(1).isin(".", ",") & alike(ahead(2)) & (digit(ahead(2)) | F.coalesce(ahead(3) == "%", F.lit(False))), F.lit(False))
        rest = F.substring(t, 4, 99)
        glued = F.startswith(folded(t), F.lit("alc")) & (F.length(t) > 3) & alike(rest) & ends(ahead(1))
        point = (t == ".") & F.coalesce(folded(before) == "alc", F.lit(False)) & F.coalesce(alike(ahead(1)), F.lit(False)) & ends(ahead(2))
        return (
            F.when(t == " ", t)
            .when(alike(t), F.when(digit(t) | percent | goes_on, digits(t)).otherwise(t))
            .when(t == "%", F.when(F.coalesce((ahead(1) == "by") | F.array_contains(F.map_keys(doubles), ahead(1)), F.lit(False)), "% ").otherwise(t))
            .when(point, " ")
            .when(glued, F.concat(F.lit("alc "), F.when(digit(rest) | percent, digits(rest)).otherwise(rest)))
            .otherwise(F.coalesce(F.try_element_at(doubles, t), F.try_element_at(markers, folded(t)), t))
        )

    joined = F.array_join(F.transform(tokens, read), "")
    return F.regexp_replace(joined, r"(\d) ?[.,] ?(?=\d\d?\b)", "$1.")  # one point between the parts of a decimal


def read_number(text: Column) -> Column:
    """Basis points of a number of one or two digits with up to two decimals; three digits alone lack their point."""
    return F.when(text.rlike(r"^\d{1,2}(?:\.\d{1,2})?$"), basis_points(text)).when(text.rlike(r"^\d{3}$"), text.cast("int") * 10)


def matched(rows: DataFrame, text: str) -> DataFrame:
    """Adds kind (direct, range or rejected), low, high, reason and operations (what had to be put right) of windows read from a picture.

    reason tells why a window is accepted or rejected. A window without a number, a proof statement alone, and one
    without a volume marker are rejected before its order is looked at.
    """
    norm, low, high, s = F.col("_norm"), F.col("_low"), F.col("_high"), F.col("_shape")
    r = rows.withColumn("_plain", plain(F.col(text))).withColumn("_norm", repaired(F.col("_plain")))
    r = r.withColumns({"_shape": shape(norm), "_first": number(norm, 1), "_second": number(norm, 2)})
    r = r.withColumns({"_low": read_number(F.col("_first")), "_high": read_number(F.col("_second"))})
    accepted = F.create_map(*[F.lit(x) for pair in ACCEPTED.items() for x in pair])
    is_range = s.contains("T")
    fits = s.isin(*ACCEPTED) & low.isNotNull() & (~is_range | (low <= high))
    reason = (
        F.when(~s.contains("N"), "no-supported-number")
        .when(~s.contains("V"), F.when(s.contains("X"), "proof-only").otherwise("missing-volume-marker"))
        .when(fits, F.try_element_at(accepted, s))
        .when(s.contains("X"), "proof-only")
        .when(~s.contains("P") & ~s.rlike("[AL]"), "missing-explicit-alcohol-marker")
        .when(~s.contains("BV") & ~s.rlike("[AL]"), "bare-volume-marker-too-weak")
        .otherwise("unsupported-pattern")
    )
    r = r.withColumn("reason", reason).withColumn("kind", F.when(~F.coalesce(fits, F.lit(False)), "rejected").when(is_range, "range").otherwise("direct"))
    done = F.array_compact(F.array(
        F.when(norm != F.col("_plain"), "text-repaired"), F.when(s.isin("APNBV", "LPNBV"), "percent-before-number-reordered"), F.when(F.col("_first").rlike(r"^\d{3}$"), "implicit-decimal-recovery"),
    ))
    ok = F.col("kind") != "rejected"
    return r.withColumn("low", F.when(ok, low)).withColumn("high", F.when(F.col("kind") == "range", high).when(ok, F.col("low"))).withColumn("operations", F.when(ok, F.array_join(done, ","))).drop("_plain", "_norm", "_shape", "_first", "_second", "_low", "_high")
