"""Matches of a pattern with their places, by DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:bigint,end:bigint,text:string>"


def let(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.transform(F.array(value), use)[0]


def running(values: Column) -> Column:
    """Sums of an array of numbers up to each of them, itself included.

    An array that grows by one element is copied each time, so sums are made in blocks of about the square root of
    the length, and the blocks' own sums are added: an array of n costs n times that root and not n squared.
    """
    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("sums"))

    def upto(a: Column) -> Column:
        return F.aggregate(a, begin, lambda acc, v: let(acc["at"] + v, lambda at: F.struct(at.alias("at"), F.concat(acc["sums"], F.array(at)).alias("sums"))))["sums"]

    def blocked(a: Column) -> Column:
        step = F.ceil(F.sqrt(F.size(a))).cast("int")
        parts = F.transform(F.sequence(F.lit(1), F.size(a), step), lambda at: upto(F.slice(a, at, step)))
        whole = lambda p: let(upto(F.transform(p, lambda x: F.element_at(x, -1))), lambda ends: F.flatten(F.transform(p, lambda x, i: F.transform(x, lambda v: v + F.when(i > 0, F.get(ends, i - 1)).otherwise(0)))))
        return let(parts, whole)

    longs = F.transform(values, lambda v: v.cast("bigint"))
    return let(longs, lambda a: F.when(F.size(a) < 16, upto(a)).otherwise(blocked(a)))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, text>>: leftmost, non-overlapping matches, places in code points, end exclusive.

    What lies between the matches has their places: its lengths are added up along with theirs.
    """
    between = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(hits: Column) -> Column:
        ends = running(F.zip_with(F.slice(between, 1, F.size(hits)), hits, lambda gap, hit: F.char_length(gap) + F.char_length(hit)))
        return let(ends, lambda e: F.transform(hits, lambda hit, i: F.struct((F.get(e, i) - F.char_length(hit)).alias("start"), F.get(e, i).alias("end"), hit.alias("text"))))

    return F.when(text.rlike(pattern), let(found, placed)).otherwise(F.array().cast(f"array<{SPAN}>"))


def rewrite(text: Column, pattern: str, change) -> Column:
    """The text with change(match) in each match's place."""
    between = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    changed = F.concat(F.transform(found, change), F.array(F.lit("")))
    return F.when(text.rlike(pattern), F.array_join(F.flatten(F.zip_with(between, changed, lambda a, b: F.array(a, b))), "")).otherwise(text)
