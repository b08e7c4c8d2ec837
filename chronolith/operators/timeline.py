"""Timelines, runs, presence and as-of lookups: windows by session (and path), one shuffle each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by(*keys: str, order: str | Column = "f") -> Window:
    return Window.partitionBy(*keys).orderBy(order)


def up_to(w: Window) -> Window:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def first_last(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min("f").alias("first_f"), F.max("f").alias("last_f"), F.count(F.lit(1)).alias("n"))


def runs(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """Gaps and islands: maximal runs of one value, as (keys, value, f_start, f_end, length)."""
    w, wv = by(*keys), by(*keys, value)
    island = F.row_number().over(w) - F.row_number().over(wv)
    return rows.withColumn("island", island).groupBy(*keys, value, "island").agg(F.min("f").alias("f_start"), F.max("f").alias("f_end"), F.count(F.lit(1)).alias("length")).drop("island")


def presence(rows: DataFrame, gap: int) -> DataFrame:
    """Closed intervals in which a path is seen with no gap of more than ``gap`` frames."""
    w = by("session", "path")
    opens = F.coalesce(F.col("f") - F.lag("f").over(w) > gap, F.lit(True)).cast("int")
    return rows.withColumn("opens", opens).withColumn("k", F.sum("opens").over(up_to(w))).groupBy("session", "path", "k").agg(F.min("f").alias("f_start"), F.max("f").alias("f_end"), F.count(F.lit(1)).alias("seen"))


def presence_changes(rows: DataFrame, frames: DataFrame) -> DataFrame:
    """Per path the frames at which it comes (true) or goes (false), over the session's frames."""
    ids = rows.select("session", "path").distinct()
    scaffold = frames.select("session", "f").distinct().join(ids, "session")
    seen = scaffold.join(rows.select("session", "path", "f", F.lit(True).alias("there")).distinct(), ["session", "path", "f"], "left").withColumn("there", F.coalesce("there", F.lit(False)))
    before = F.coalesce(F.lag("there").over(by("session", "path")), F.lit(False))
    return seen.withColumn("before", before).filter("there <> before").drop("before")


def visible_intervals(present: DataFrame, visible: DataFrame, frames: int) -> DataFrame:
    """Closed intervals where both change timelines (session, path, f, v boolean) hold; an open one ends with the last frame if still present, else at the last change."""
    points = present.select("session", "path", "f", F.struct("v").alias("p"), F.lit(None).cast("struct<v:boolean>").alias("s")).unionByName(
        visible.select("session", "path", "f", F.lit(None).cast("struct<v:boolean>").alias("p"), F.struct("v").alias("s"))
    ).groupBy("session", "path", "f").agg(F.max("p").alias("p"), F.max("s").alias("s"))
    w = up_to(by("session", "path"))
    on = F.coalesce(F.last("p", True).over(w)["v"], F.lit(False)) & F.coalesce(F.last("s", True).over(w)["v"], F.lit(True))
    held = points.withColumn("on", on).withColumn("present", F.coalesce(F.last("p", True).over(w)["v"], F.lit(False)))
    edges = held.withColumn("was", F.coalesce(F.lag("on").over(by("session", "path")), F.lit(False))).withColumn("ends", F.max("f").over(Window.partitionBy("session", "path")))
    edges = edges.withColumn("held", F.last("present").over(by("session", "path").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    turns = edges.filter("on <> was").withColumn("next", F.lead("f").over(by("session", "path")))
    return turns.filter("on").select("session", "path", F.col("f").alias("f_start"), F.coalesce(F.col("next") - 1, F.when(F.col("held"), F.lit(frames - 1)).otherwise(F.col("ends"))).alias("f_end"))


def as_of(rows: DataFrame, value: Column, name: str, *keys: str, strict: bool = False) -> DataFrame:
    """The latest non-null value at or before (strict: before) each row."""
    w = by(*keys)
    frame = w.rowsBetween(Window.unboundedPreceding, -1) if strict else up_to(w)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(frame))


def as_of_join(left: DataFrame, right: DataFrame, value: str, *keys: str) -> DataFrame:
    """For each left row the right value with the greatest f at or before its own: a union and one window, no range join."""
    both = left.select(*keys, "f", F.struct(*[F.col(c) for c in left.columns]).alias("l"), F.lit(None).cast(right.schema[value].dataType).alias("r"), F.lit(1).alias("side")).unionByName(
        right.select(*keys, "f", F.lit(None).cast(left.select(F.struct(*left.columns).alias("x")).schema[0].dataType).alias("l"), F.col(value).alias("r"), F.lit(0).alias("side"))
    )
    w = up_to(Window.partitionBy(*keys).orderBy("f", "side"))
    return both.withColumn("r", F.last("r", ignorenulls=True).over(w)).filter("side = 1").select("l.*", F.col("r").alias(value))


def nearest(rows: DataFrame, mark: Column, name: str, *keys: str) -> DataFrame:
    """The nearest marked frame of the session before or after each row; the earlier of two as near."""
    at = F.when(mark, F.col("f"))
    before = F.last(at, True).over(up_to(by(*keys)))
    after = F.first(at, True).over(by(*keys).rowsBetween(0, Window.unboundedFollowing))
    pick = F.when(before.isNull(), after).when(after.isNull(), before).when(F.col("f") - before <= after - F.col("f"), before).otherwise(after)
    return rows.withColumn(name, pick)


def interpolated(rows: DataFrame, value: Column, name: str, *keys: str) -> DataFrame:
    """Linear between the known values around a row; the nearest known value outside them."""
    known = F.when(value.isNotNull(), F.struct(F.col("f").alias("f"), value.alias("v")))
    a = F.last(known, True).over(up_to(by(*keys)))
    b = F.first(known, True).over(by(*keys).rowsBetween(0, Window.unboundedFollowing))
    out = rows.withColumn("__a", a).withColumn("__b", b)
    line = F.expr("__a.v + (__b.v - __a.v) * (f - __a.f) / (__b.f - __a.f)")
    held = F.coalesce(F.expr("CASE WHEN __a.f = __b.f THEN __a.v END"), line, F.col("__a.v"), F.col("__b.v"))
    return out.withColumn(name, held).drop("__a", "__b")


def gap_filled(rows: DataFrame, key: str, step: str, first: Column, last: Column, slot: Column, value: Column) -> DataFrame:
    """A row for every slot between a key's first and last one, values carried forward."""
    spans = rows.groupBy(key).agg(first.alias("a"), last.alias("b"))
    slots = spans.select(key, F.explode(F.sequence("a", "b", F.expr(step))).alias("slot"))
    seen = rows.groupBy(key, slot.alias("slot")).agg(value.alias("v"))
    w = up_to(by(key, order="slot"))
    return slots.join(seen, [key, "slot"], "left").withColumn("filled", F.col("v").isNull()).withColumn("v", F.last("v", True).over(w))


def kth(rows: DataFrame, k: int, *keys: str) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(by(*keys))).filter(F.col("__n") == k).drop("__n")


def first_match(rows: DataFrame, where: Column, *keys: str) -> DataFrame:
    """First row with the predicate: an aggregate, so nothing is sorted."""
    return rows.groupBy(*keys).agg(F.min(F.when(where, F.col("f"))).alias("f"), F.min_by("v", F.when(where, F.col("f"))).alias("v")).filter("f IS NOT NULL")


def reappearances(rows: DataFrame, gap: int) -> DataFrame:
    """(session, path, gone_f, back_f): a path that stays away for more than ``gap`` frames and comes back."""
    return rows.withColumn("gone_f", F.lag("f").over(by("session", "path"))).filter(F.col("f") - F.col("gone_f") > gap).select("session", "path", "gone_f", F.col("f").alias("back_f"))


def stable_points(rows: DataFrame, value: str, around: int, start: int, step: int, *keys: str) -> DataFrame:
    """Smallest f >= start on the step with a single value within ``around`` rows on both sides."""
    w = by(*keys).rowsBetween(-around, around)
    flat = rows.withColumn("__lo", F.min(value).over(w)).withColumn("__hi", F.max(value).over(w)).withColumn("__n", F.count(F.lit(1)).over(w))
    return flat.filter(f"__lo = __hi AND __n = {2 * around + 1} AND f >= {start} AND (f - {start}) % {step} = 0").groupBy(*keys).agg(F.min("f").alias("f"), F.min_by(value, "f").alias(value))


def compact_states(state: DataFrame) -> DataFrame:
    """(session, text): ``path=v`` pairs in order of path."""
    pair = F.concat_ws("=", F.concat_ws("/", "path") if dict(state.dtypes)["path"].startswith("array") else F.col("path"), F.col("v").cast("string"))
    return state.groupBy("session").agg(F.array_join(F.array_sort(F.collect_list(pair)), " ").alias("text"))


def entity_history(changes: DataFrame, events: DataFrame, session, entity: str) -> DataFrame:
    """Timelines of one entity and the events that name it, in order of f: filters reach both scans."""
    tl = changes.filter((F.col("session") == session) & (F.col("path") == entity)).select("f", F.lit("value").alias("kind"), F.col("v").cast("string").alias("detail"))
    ev = events.filter((F.col("session") == session) & (F.col("entity") == entity)).select("f", F.lit("event").alias("kind"), F.col("detail").cast("string"))
    return tl.unionByName(ev)
