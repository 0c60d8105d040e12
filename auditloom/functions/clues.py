"""What the words of a text tell about its region: tests on its tokens, by name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditloom.functions import vocabulary as v


def words(text: Column) -> Column:
    """Runs of letters, digits and underscores, in text order."""
    return F.filter(F.split(text, "[^a-z0-9_]+"), lambda t: t != "")


def has_any(tokens: Column, listed: list[str]) -> Column:
    return F.arrays_overlap(tokens, F.array(*map(F.lit, listed)))


def has_phrase(spaced: Column, phrases: list[str]) -> Column:
    """Whether whole words stand side by side with nothing but a space between them. spaced: of `spelled`."""
    return F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(spaced, F.concat(F.lit(" "), p, F.lit(" "))))


def spelled(text: Column) -> Column:
    """A text whose words have spaces around them; any other character but white space is a bar of its own."""
    return F.concat(F.lit(" "), F.regexp_replace(F.regexp_replace(text, r"[^a-z0-9_\s]", " | "), r"\s+", " "), F.lit(" "))


def maker_before_by(tokens: Column) -> Column:
    """A word for making, and `by` somewhere behind it."""
    firsts = F.filter(F.array(*[F.array_position(tokens, w) for w in v.MAKER_WORDS]), lambda at: at > 0)
    last = F.size(tokens) - F.array_position(F.reverse(tokens), "by") + 1
    return F.array_contains(tokens, "by") & F.coalesce(F.array_min(firsts) < last, F.lit(False))


def web_address(text: Column) -> Column:
    """A scheme, a host that starts with www, or a name with a known ending."""
    hosts = F.split(text, r"[^a-z0-9.-]+")
    named = lambda host: F.exists(
        F.transform(F.split(host, r"\."), lambda part, at: F.when((at > 0) & (F.translate(F.element_at(F.split(host, r"\."), F.greatest(at, F.lit(1))), "-", "") != ""), F.element_at(F.split(part, "-"), 1)).otherwise("")),
        lambda end: end.isin(v.DOMAINS),
    )
    www = lambda host: (host == "www.") | host.startswith("www.") | F.contains(host, F.lit("-www.")) | F.contains(host, F.lit(".www."))
    return F.contains(text, F.lit("http://")) | F.contains(text, F.lit("https://")) | F.exists(hosts, www) | F.exists(hosts, named)


def year(tokens: Column) -> Column:
    """A number of four digits between 1900 and 2099."""
    return F.exists(tokens, lambda t: (F.length(t) == 4) & (F.translate(t, "0123456789", "") == "") & t.between("1900", "2099"))


def contents(spaced: Column) -> Column:
    """A number with a unit of volume, together or side by side."""
    parts = F.split(spaced, " ")
    digits = lambda t: (t != "") & (F.translate(t, "0123456789", "") == "")
    unit = lambda t: t.isin(v.CONTENT_UNITS)
    amount = lambda t: F.rtrim(t, F.lit("lmc"))
    one = lambda t: digits(amount(t)) & unit(F.substring(t, F.length(amount(t)) + 1, F.length(t)))
    two = F.exists(F.arrays_zip(F.slice(parts, F.lit(1), F.size(parts) - 1).alias("a"), F.slice(parts, F.lit(2), F.size(parts) - 1).alias("b")), lambda x: digits(x["a"]) & unit(x["b"]))
    return F.exists(parts, one) | two


def tests(text: Column) -> dict[str, Column]:
    """What a text (lower case) has, by the names of TEXT_CLUES."""
    tokens, spaced = words(text), spelled(text)
    joined = F.regexp_replace(text, r"\s+", " ")
    lines = F.split(text, "[\\n\\r\u2028\u2029]")
    marked = lambda line: F.contains(line, F.lit("%")) | F.contains(line, F.lit("alcohol")) | has_any(words(line), v.VOLUME_WORDS)
    return {
        "warning": F.exists(F.array(*map(F.lit, v.WARNING_PHRASES)), lambda p: F.contains(joined, p)),
        "strength": F.exists(lines, lambda line: marked(line) & (F.translate(line, "0123456789", "") != line)),
        "maker": F.exists(lines, lambda line: maker_before_by(words(line))),
        "address": web_address(text),
        "type": has_any(tokens, v.TYPE_WORDS) | has_phrase(spaced, v.TYPE_PHRASES),
        "place": has_any(tokens, v.PLACE_WORDS),
        "year": year(tokens),
        "contents": has_phrase(spaced, v.CONTENT_PHRASES) | contents(spaced),
        "long": F.size(F.split(text, r"\s+")) >= 8,
    }
