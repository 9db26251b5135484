"""Literal text search on columns: counting, spans, previews, kinds of characters."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def literal(term: Column) -> Column:
    """A Java pattern that matches the term itself, whatever it holds."""
    return F.concat(F.lit(r"\Q"), F.replace(term, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def folded(text: Column, term: Column, ignore_case: bool) -> tuple[Column, Column]:
    """What to search in and for. Case is ignored only where lower-casing changes neither length."""
    if not ignore_case:
        return text, term
    safe = (F.char_length(F.lower(text)) == F.char_length(text)) & (F.char_length(F.lower(term)) == F.char_length(term))
    return F.when(safe, F.lower(text)).otherwise(text), F.when(safe, F.lower(term)).otherwise(term)


def flat(lines: Column | str) -> Column:
    """The lines without anything between them, so that a hit may cross a line end."""
    return F.array_join(_col(lines), "")


def count_hits(text: Column, term: Column, ignore_case: bool = False) -> Column:
    """Hits of the term, left to right without overlap."""
    hay, needle = folded(text, term, ignore_case)
    size = F.char_length(needle)
    return F.when(size > 0, (F.char_length(hay) - F.char_length(F.replace(hay, needle, F.lit("")))) / size).otherwise(0).cast("long")


def let(value: Column, body) -> Column:
    """body(v) with v bound to the value, so that it is computed once however often v stands in lambdas."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def running_sums(values: Column) -> Column:
    """Sums of an array of int up to each element, by doubling: as many passes over it as its length has binary digits."""
    for k in range(31):
        values = let(values, partial(_reached, 1 << k))
    return values


def _reached(back: int, sums: Column) -> Column:
    return F.when(F.size(sums) > back, F.transform(sums, lambda x, i: x + F.coalesce(F.get(sums, i - back), F.lit(0)))).otherwise(sums)


def find_spans(text: Column, term: Column, ignore_case: bool = False) -> Column:
    """array<struct<a,b>> of the hits: code points from a up to b."""
    hay, needle = folded(text, term, ignore_case)
    size = F.char_length(needle)
    # A piece and the hit after it, laid end to end.
    pieces = let(F.split(hay, literal(needle), -1), lambda p: F.transform(F.slice(p, F.lit(1), F.size(p) - 1), lambda x: F.char_length(x) + size))
    found = F.transform(running_sums(pieces), lambda b: F.struct((b - size).alias("a"), b.alias("b")))
    return F.when((size > 0) & hay.contains(needle), found).otherwise(F.array().cast("array<struct<a:int,b:int>>"))


def merge_spans(spans: Column | str) -> Column:
    """The union of spans (a, b) that overlap or touch, by a, null last.

    As for running maxima, a null b reaches nowhere: a span after ends that are all null is its own. One with a null a goes with the spans before it.
    """
    # Nulls of a struct come first in an order, so that each is led by whether it is null.
    ordered = F.array_sort(F.transform(_col(spans), lambda s: F.struct(s["a"].isNull().alias("no_a"), s["a"].cast("long").alias("a"), s["b"].isNull().alias("no_b"), s["b"].cast("long").alias("b"))))
    none = F.struct(F.array().cast("array<struct<a:bigint,b:bigint>>").alias("out"), F.lit(None).cast("long").alias("reach"))

    def step(acc: Column, s: Column) -> Column:
        out, last = acc["out"], F.try_element_at(acc["out"], F.lit(-1))
        joins = acc["reach"].isNotNull() & F.coalesce(s["a"] <= acc["reach"], F.lit(True))
        grown = F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], s["b"]).alias("b"))))
        merged = F.when(joins, grown).otherwise(F.concat(out, F.array(F.struct(s["a"].alias("a"), s["b"].alias("b")))))
        return F.struct(merged.alias("out"), F.greatest(acc["reach"], s["b"]).alias("reach"))

    return F.aggregate(ordered, none, step, lambda acc: acc["out"])


def preview(text: Column, a: Column, b: Column, around: int = 18) -> Column:
    """The hit with some characters to either side and marks where text is cut off."""
    low, high = F.greatest(a - around, F.lit(0)), F.least(b + around, F.char_length(text))
    return F.concat(F.when(low > 0, "…").otherwise(""), F.substring(text, low + 1, high - low), F.when(high < F.char_length(text), "…").otherwise(""))


#: What stands for characters that mean something in HTML (fixed values).
ESCAPES = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&#39;"}


def escaped(text: Column) -> Column:
    for char, entity in ESCAPES.items():
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def marked(text: Column | str, term: str, ignore_case: bool = False) -> Column:
    """The text as HTML with every hit of the term in <mark>; control characters 1 and 2 go."""
    plain = F.translate(_col(text), "\x01\x02", "")
    if not term:
        return escaped(plain)
    pattern = ("(?iu)" if ignore_case else "") + r"\Q" + term.replace(r"\E", r"\E\\E\Q") + r"\E"
    framed = escaped(F.regexp_replace(plain, pattern, "\x01$0\x02"))
    return F.replace(F.replace(framed, F.lit("\x01"), F.lit("<mark>")), F.lit("\x02"), F.lit("</mark>"))


def normalised(text: Column | str) -> Column:
    """Runs of white space as one blank, trimmed, in lower case."""
    return F.lower(F.trim(F.regexp_replace(_col(text), r"\s+", " ")))


def split_lines(text: Column | str) -> Column:
    """Lines ended by CRLF, CR or LF."""
    return F.split(_col(text), "\r\n|\r|\n", -1)


#: Ranges of characters that are set one em wide (fixed values).
WIDE = (
    r"[\x{1100}-\x{115F}\x{2E80}-\x{A4CF}\x{AC00}-\x{D7A3}\x{F900}-\x{FAFF}"
    r"\x{FE30}-\x{FE6F}\x{FF00}-\x{FF60}\x{FFE0}-\x{FFE6}\x{1F300}-\x{1FAFF}]"
)


def is_wide(char: Column | str) -> Column:
    return _col(char).rlike(WIDE)


def has_non_latin(text: Column | str) -> Column:
    return _col(text).rlike(r"[^\x{0}-\x{FF}]")
