"""Interval predicates and range joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overlapping(events: DataFrame, lo: Column, hi: Column, start: Column, end: Column) -> DataFrame:
    """Events whose closed interval meets [lo, hi]; a missing end is the start."""
    return events.filter((F.coalesce(end, start) >= lo) & (start <= hi))


def of_types(events: DataFrame, types: str | None, column: str = "type") -> DataFrame:
    """A comma-separated list of types; empty means all."""
    return events.filter(F.col(column).isin(*types.split(","))) if types else events


def range_join(points: DataFrame, at: str, spans: DataFrame, lo: str, hi: str, width: float, how: str = "inner") -> DataFrame:
    """Points in closed spans by an equi-join on buckets of ``width``: a span is listed in each bucket it covers.

    No cross join: a point meets only the spans of its own bucket. Choose the width near a typical span.
    """
    bucket = lambda c: F.floor(F.col(c) / width)
    p = points.withColumn("__b", bucket(at))
    s = spans.withColumn("__b", F.explode(F.sequence(bucket(lo), bucket(hi))))
    return p.join(s, (p["__b"] == s["__b"]) & (p[at] >= s[lo]) & (p[at] <= s[hi]), how).drop("__b")


def nearest_join(left: DataFrame, right: DataFrame, key: str, l_at: str, r_at: str, width: float) -> DataFrame:
    """For each left row the right row of its key with the nearest position, the lower of two as near, within ``width``."""
    lb, rb = F.floor(F.col(l_at) / width), F.floor(F.col(r_at) / width)
    l = left.withColumn("__b", F.explode(F.array(lb - 1, lb, lb + 1)))
    r = right.withColumn("__b", rb)
    joined = l.join(r, [key, "__b"]).withColumn("gap", F.abs(F.col(l_at) - F.col(r_at))).filter(F.col("gap") <= width)
    best = F.min_by(F.struct(*[F.col(c) for c in right.columns if c != key]), F.struct("gap", r_at))
    return joined.groupBy(key, *[c for c in left.columns if c != key]).agg(F.min("gap").alias("gap"), best.alias("m")).select(key, *[c for c in left.columns if c != key], "gap", "m.*")
