"""Column expressions over lines that may hold a name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditloom.functions import vocabulary as v


def cleaned(raw: Column) -> Column:
    """A line with the characters that a name can have, and single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(raw, r"[^A-Za-z0-9 ,.;&'-]", ""), r"\s+", " "))


def tokens(value: Column) -> Column:
    """Letters and digits of each word in lower case; words without any are left out."""
    return F.filter(F.split(F.regexp_replace(F.lower(value), r"[^a-z0-9 ]", ""), " "), lambda t: t != "")


def lettered(value: Column) -> Column:
    """Tokens with a letter."""
    return F.filter(tokens(value), lambda t: t.rlike("[a-z]"))


def key(value: Column) -> Column:
    """What values of one name have in common: letters and digits in lower case."""
    return F.regexp_replace(F.lower(value), "[^a-z0-9]", "")


def corroborate(a: Column, b: Column) -> Column:
    """Whether one of two keys holds the other."""
    return (a != "") & (b != "") & (a.contains(b) | b.contains(a))


def positive(value: Column) -> Column:
    """A possessive or a word that marks a name."""
    return F.lower(value).rlike(r"[a-z]['’]s\b") | F.arrays_overlap(tokens(value), F.array(*map(F.lit, v.DESIGNATORS)))


def only(value: Column, words: list[str]) -> Column:
    """Whether all lettered tokens that are no connectors are among the words, and there is one."""
    told = F.array_except(lettered(value), F.array(*map(F.lit, v.CONNECTORS)))
    return (F.size(told) > 0) & (F.size(F.array_except(told, F.array(*map(F.lit, words)))) == 0)


def line_reason(raw: Column, value: Column) -> Column:
    """Why a line is no name, the first reason that holds, or candidate-positive or candidate-plausible."""
    bare = F.transform(F.split(raw, r"\s+"), lambda w: F.regexp_replace(w, "[^A-Za-z]", ""))
    lowered = F.transform(bare, F.lower)
    maker = F.arrays_overlap(lowered, F.array(*map(F.lit, v.MAKERS))) & F.array_contains(lowered, "by")
    statement = F.lower(raw).rlike(r"\b(?:" + "|".join(v.STATEMENT_WORDS) + r")\b") | F.regexp_replace(F.lower(value), "[^a-z]", "").rlike("|".join(v.STATEMENT_PARTS))
    domain = F.lower(value).rlike(r"^(?:https?://|www\.)") | F.exists(F.split(F.lower(value), " "), lambda w: w.rlike(r"^[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,}$"))
    alpha = lettered(value)
    place = F.lower(value).isin(v.PLACES) | ((F.size(alpha) >= 2) & F.try_element_at(alpha, F.lit(-1)).isin(v.COUNTRIES) & value.rlike("[-,]"))
    fragment = (F.length(F.array_join(alpha, "")) < 4) | F.forall(alpha, lambda t: F.length(t) <= 2)
    written = F.filter(F.transform(F.split(raw, r"\s+"), lambda w: F.regexp_replace(w, "[^A-Za-z'-]", "")), lambda w: w != "")
    small = lambda w: (w == F.lower(w)) & ~F.lower(w).isin(v.CONNECTORS)
    n_small, first = F.size(F.filter(written, small)), F.try_element_at(written, F.lit(1))
    sentence = (F.trim(raw).rlike(r"[.,;:!?]$") & ~positive(value)) | ((first == F.lower(first)) & (n_small >= 1)) | (n_small >= 2)
    reasons = {
        "producer-line": maker, "no-letters-or-too-short": (F.length(value) < 2) | ~value.rlike("[A-Za-z]"), "non-brand-keyword": statement, "too-many-words": F.size(F.split(value, " ")) > v.NAME_WORDS, "domain-like": domain,
        "varietal-or-designation": only(value, v.VARIETAL), "generic-product-language": only(value, v.VARIETAL + v.GENERIC), "location-or-appellation": place, "low-information-fragment": fragment, "sentence-fragment": sentence, "candidate-positive": positive(value),
    }
    return F.coalesce(*[F.when(c, F.lit(k)) for k, c in reasons.items()], F.lit("candidate-plausible"))


def residual(words: Column) -> Column:
    """Share of words that look like no part of a name. words: array of (text, confidence 0 to 1)."""

    def odd(w: Column, i: Column) -> Column:
        bare = F.regexp_replace(w["text"], "[^A-Za-z]", "")
        n = F.length(bare)
        year = (i > 0) & F.regexp_replace(w["text"], "[^0-9]", "").rlike(r"^(?:19|20)\d{2}$")
        small = w["text"].rlike("[a-z]") & (w["text"] == F.lower(w["text"])) & ~w["text"].isin(v.CONNECTORS) & (w["confidence"] < 0.8)
        return F.when(year | ~w["text"].rlike("[A-Za-z0-9]") | ((n > 0) & (n <= 2)) | ((n == 3) & (w["confidence"] < 0.5)) | small, 1.0).otherwise(0.0)

    marks = F.transform(words, odd)
    return F.when(F.size(words) == 0, 0.0).otherwise(F.aggregate(marks, F.lit(0.0), lambda a, x: a + x) / F.size(words))


def word_factors(value: Column, words: Column, is_positive: Column) -> dict[str, Column]:
    """The factors of a candidate that its own words give."""
    alpha = lettered(value)
    informative = F.size(F.filter(tokens(value), lambda t: F.length(t) >= 3))
    structure = (informative + F.when(F.size(alpha) > 1, 1).otherwise(0) + F.when(is_positive, 1).otherwise(0)) / 4
    short = F.size(F.filter(alpha, lambda t: F.length(t) <= 2))
    return {
        "positive": F.when(is_positive, 1.0).otherwise(0.0), "meaningful": F.least(F.lit(1.0), F.length(F.array_join(alpha, "")) / 14), "structure": F.least(F.lit(1.0), structure),
        "low_information": F.when(F.size(alpha) == 0, 1.0).otherwise(F.least(F.lit(1.0), short / F.size(alpha))), "residual": residual(words),
    }
