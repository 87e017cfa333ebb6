"""Matches of patterns with their places, in Spark's own expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def offsets(lengths: Column) -> Column:
    """Exclusive running sums of an array of long, by blocks of about its root's size, so long arrays cost n^1.5 and not n^2."""
    n = F.size(lengths)
    b = F.greatest(F.lit(1), F.ceil(F.sqrt(n)).cast("int"))
    add = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    count = F.ceil(n / b).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda k: F.slice(lengths, k * b + 1, b))
    sums = F.transform(blocks, add)
    base = F.transform(sums, lambda _, k: add(F.slice(sums, F.lit(1), k)))
    return F.flatten(F.zip_with(blocks, base, lambda x, s: F.transform(x, lambda _, i: s + add(F.slice(x, F.lit(1), i)))))


def matches(text: Column, pattern: str) -> Column:
    """All leftmost matches that do not overlap."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def around(text: Column, pattern: str, found: Column) -> Column:
    """The texts between matches, one more than these; only computed where there are some."""
    return F.when(F.size(found) > 0, F.split(text, pattern, -1))


def starts(found: Column, between: Column) -> Column:
    """Code point offsets of the matches."""
    long = lambda a: F.transform(a, lambda x: F.char_length(x).cast("long"))
    steps = F.zip_with(long(F.slice(between, F.lit(1), F.size(found))), long(found), lambda p, m: p + m)
    return F.when(F.size(found) > 0, F.zip_with(offsets(steps), F.slice(between, F.lit(1), F.size(found)), lambda a, p: a + F.char_length(p)))


def apart(docs: DataFrame, **columns: Column) -> DataFrame:
    """The rows of docs as one struct `__own`, beside new columns: no name of docs can clash with a working column."""
    return docs.select(F.struct(*(docs[f"`{c}`"].alias(c) for c in docs.columns)).alias("__own"), *(v.alias(k) for k, v in columns.items()))


def together(step: DataFrame, docs: DataFrame, name: str, value: Column) -> DataFrame:
    """The columns of docs and `name`; a column of docs that has this name gives way.

    The optimiser takes the result as one that must not be written out again in what follows (the partition's number is
    unknown to it): a filter or explode on it works on rows, not on a copy of all steps within each step. So filters on columns
    of docs are not pushed below the scan either; apply those to docs."""
    kept = F.when(F.spark_partition_id() >= 0, value)
    return step.select(*(F.col("__own")[c].alias(c) for c in docs.columns if c != name), kept.alias(name))
