"""Scored substring search over several corpora, evidence lookup, relationships and corrections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.functions.text import score


def words_of(query: str) -> list[str]:
    """Words of a query as ``functions.text.tokens`` splits them; the query is a driver-side string."""
    import re

    return [w for w in re.findall(r"[a-z0-9_]+", query.lower()) if len(w) > 1]


def hits(corpus: DataFrame, kind: str, item: Column, f: Column, text: Column, query: str, detail: Column | None = None) -> DataFrame:
    """(score, kind, item, f[, detail]) of the rows that hold a word of the query."""
    shown = [] if detail is None else [detail.alias("detail")]
    return corpus.select(score(text, words_of(query)).alias("score"), F.lit(kind).alias("kind"), item.cast("string").alias("item"), f.cast("bigint").alias("f"), *shown).filter("score > 0")


def ranked(parts: list[DataFrame], limit: int = 50, count: bool = False) -> DataFrame:
    """The best hits of all corpora, by score, frame, then the order of the corpora: a top-k, not a sort of all hits. With count, how many hits there are beside each."""
    numbered = reduce(DataFrame.unionByName, [p.withColumn("ord", F.lit(i)) for i, p in enumerate(parts)])
    order = [F.desc("score"), F.coalesce("f", F.lit(0).cast("bigint")), "ord", "item"]
    best = numbered.orderBy(*order).limit(limit)
    if count:
        best = best.join(F.broadcast(numbered.agg(F.count(F.lit(1)).alias("count")))).orderBy(*order)
    return best.drop("ord")


def evidence(rows: DataFrame, events: DataFrame, annotation: str) -> DataFrame:
    """``<path>@<f>`` resolves to the path's latest value at f, anything else to an event id; no row if not found.

    rows: (session, path, f, v); events: (id, type, f, detail).
    """
    if "@" in annotation:
        path, _, f = annotation.rpartition("@")
        at = rows.filter((F.col("path") == path) & (F.col("f") <= int(f)))
        found = at.groupBy("session", "path").agg(F.max_by("v", "f").alias("v"), F.max("f").alias("observed_f"))
        return found.select("session", F.concat(F.lit(annotation)).alias("id"), F.concat("path", F.lit("="), F.col("v").cast("string"), F.lit(f" at f{f}")).alias("claim"), "observed_f")
    return events.filter(F.col("id") == annotation).select("session", "id", F.concat_ws(" ", "type", "detail").alias("claim"), F.col("f").alias("observed_f"))


def relationships(pairs: DataFrame, src: Column, rel: str, dst: Column, at: Column) -> DataFrame:
    """Edge table (src, rel, dst, start, end, seen) from observations of pairs."""
    return pairs.select(src.alias("src"), F.lit(rel).alias("rel"), dst.alias("dst"), at.alias("at")).groupBy("src", "rel", "dst").agg(F.min("at").alias("start"), F.max("at").alias("end"), F.count(F.lit(1)).alias("seen"))


def corrected(rows: DataFrame, *keys: str) -> DataFrame:
    """Latest version of each value: corrections supersede, history stays in the input."""
    return rows.groupBy(*keys).agg(F.max_by("v", F.struct("version", "f")).alias("v"), F.max("version").alias("version"))
