"""Exact dedup by skew-safe combining, in DataFrame operations only.

Three stages, each grouping by the digest *and* the full folded text, so equality is always that of
content:

1. local: Spark's map-side aggregation leaves one row for each distinct text of a task;
2. salted: those rows meet by (digest, salt, text), the salt being the task's number modulo ``salts``,
   so a text held by a third of all rows reaches a reducer as at most ``tasks / salts`` rows;
3. global: the salt winners meet by (digest, text), at most ``salts`` rows for a text.

No group is ever collected: the state of a text is two numbers. Every row then looks its group up by the digest;
groups with more than a thousandth of all rows, a thousand of them at most, are broadcast for that and not
shuffled. Should two texts share a digest, which the groups show since they are told apart by content, the rows of
these digests look up by content.

Defined results: a null text counts as empty, so null and empty texts form one group; of equal texts the
largest id stays (null ids lose to any other; a group with null ids only keeps null); rows that repeat an
id and its text count towards ``group_size`` and share the verdict; an empty table gives no rows; columns
other than the id and text are never read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from chronolith.llm.common import fold_ascii, fresh, look_up, materialise, table, text_or_empty

SALTS = 16


def _ordered(kind: DataType) -> bool:
    """Whether values of the type can be compared."""
    if isinstance(kind, StructType):
        return all(_ordered(f.dataType) for f in kind.fields)
    if isinstance(kind, ArrayType):
        return _ordered(kind.elementType)
    return not isinstance(kind, MapType | VariantType)


def _digest(body: Column) -> Column:
    return F.unhex(F.sha2(body, 256))


def text_groups(docs: DataFrame, carry: Column, body: Column, salts: int = SALTS, digest: Callable[[Column], Column] = _digest) -> DataFrame:
    """(digest, body, winner, group_size), one row for each distinct body; winner is the largest carry."""
    local = (
        docs.select(carry.alias("winner"), body.alias("body"))
        .withColumn("digest", digest(F.col("body")))
        .withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    )
    salted = local.groupBy("digest", "salt", "body").agg(
        F.max("winner").alias("winner"), F.count(F.lit(1)).alias("group_size")
    )
    return salted.groupBy("digest", "body").agg(
        F.max("winner").alias("winner"), F.sum("group_size").alias("group_size")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest: Callable[[Column], Column] = _digest) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    body = fold_ascii(text_or_empty(F.col(text_col)))
    bodies = text_groups(docs, F.col(id_col), body, salts, digest)
    groups = materialise(bodies.select("digest", F.col("winner").alias("keep_id"), "group_size"), "dedup-groups")
    shared = materialise(groups.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("digest"), "dedup-shared")
    rows = docs.select(F.col(id_col).alias("doc_id"), body.alias("body")).withColumn("digest", digest(F.col("body")))
    sha = F.sha2("body", 256) if digest is not _digest else F.lower(F.hex("digest"))
    if shared.isEmpty():
        met = look_up(rows.select("doc_id", "digest", sha.alias("text_sha256")), groups, "digest", "group_size")
    else:
        alone = look_up(rows.select("doc_id", "digest", sha.alias("text_sha256")).join(shared, "digest", "left_anti"), materialise(groups.join(shared, "digest", "left_anti"), "dedup-alone"), "digest", "group_size")
        both = bodies.join(shared, "digest", "left_semi").select("digest", "body", F.col("winner").alias("keep_id"), "group_size")
        met = alone.unionByName(rows.join(both, ["digest", "body"]).select("doc_id", "digest", sha.alias("text_sha256"), "keep_id", "group_size"))
    return met.select(F.col("doc_id").alias(id_col), "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows that stay, one for each distinct folded text, with all their columns as they were.

    Whole rows are the carried value, so no join brings them back and repeated ids leave one row.
    """
    order = [id_col] + [c for c in docs.columns if c != id_col]
    # rows with a column that has no order (a map, a variant) are told apart by a digest, and a join brings the winners back
    if all(_ordered(f.dataType) for f in docs.schema):
        groups = text_groups(docs, F.struct(*[F.col(f"`{c}`") for c in order]), fold_ascii(text_or_empty(F.col(text_col))), salts)
        return groups.select(*[F.col("winner").getField(c).alias(c) for c in docs.columns])
    key = fresh("__row_key", docs.columns)
    marked = docs.withColumn(key, F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in order])), 256))
    groups = text_groups(marked, F.struct(F.col(f"`{id_col}`").alias("id"), F.col(key).alias("key")), fold_ascii(text_or_empty(F.col(text_col))), salts)
    best = groups.select(F.col("winner.key").alias(key))
    place = fresh("__place", [*docs.columns, key])
    kept = marked.join(best, key, "left_semi").withColumn(place, F.row_number().over(Window.partitionBy(key).orderBy(F.lit(0)))).filter(F.col(place) == 1)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body
           FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM d WINDOW w AS (PARTITION BY body)
"""
