"""All matches of a pattern with their places, in SQL functions alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<start:int,end:int,found:string>>"
BLOCK = 256


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def match_spans(text: Column, pattern: str | Column, keep: str | None = None) -> Column:
    """Leftmost non-overlapping matches as an array of (start, end, found); code points, end exclusive.

    ``split`` returns what lies between the matches and ``regexp_extract_all`` the
    matches, so the places follow from the lengths: first inside blocks of BLOCK matches, then
    block by block, so that a text of many matches doesn't copy one growing array again
    and again. The pattern must not match the empty string. ``keep``: a pattern that a match
    must have in itself to stay.
    """
    expression = F.lit(pattern) if isinstance(pattern, str) else pattern
    none = F.array().cast(SPANS)
    begin = F.struct(F.lit(0).alias("at"), none.alias("spans"))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["found"])
        span = F.struct(start.alias("start"), end.alias("end"), x["found"].alias("found"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    def placed(steps: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(1), F.size(steps), F.lit(BLOCK)), lambda b: F.aggregate(F.slice(steps, b, BLOCK), begin, add))
        starts = lambda bs: F.aggregate(bs, F.array(F.lit(0)), lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + b["at"])))
        moved = lambda b, by: F.transform(b["spans"], lambda s: F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end"), s["found"].alias("found")))
        return bound(blocks, lambda bs: F.flatten(F.zip_with(bs, F.slice(starts(bs), 1, F.size(bs)), moved)))

    def zipped(found: Column) -> Column:
        return F.arrays_zip(F.slice(F.split(text, expression, -1), 1, F.size(found)).alias("gap"), found.alias("found"))

    spans = bound(F.regexp_extract_all(text, expression, F.lit(0)), lambda found: F.when(F.size(found) > 0, bound(zipped(found), placed)).otherwise(none))
    if keep:
        spans = F.filter(spans, lambda s: s["found"].rlike(keep))
    return F.when(text.rlike(pattern) if isinstance(pattern, str) else F.lit(True), spans).otherwise(none)
