"""Encoding state as leaf operations and reading it back.

An operation row is (session, snap_f, f, path array, op, v) with op ``set``, ``del`` or ``obj``. Folding
merge patches in order amounts, leaf by leaf, to the latest operation unless an ancestor was set or deleted
at or after it; so reconstruction is a grouped ``max_by`` and an anti-join, distributed over sessions and
paths, and needs nothing older than the nearest snapshot.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from chronolith.config import DEFAULT


def by_path() -> Window:
    return Window.partitionBy("session", "path").orderBy("f")


def changed(rows: DataFrame) -> DataFrame:
    """Rows whose value differs from the one before on their path (null-safe); the first of a path always does."""
    w = by_path()
    return rows.withColumn("prev", F.lag("v").over(w)).withColumn("nth", F.row_number().over(w)).filter((F.col("nth") == 1) | ~F.col("v").eqNullSafe(F.col("prev"))).drop("nth")


def state_at(rows: DataFrame, n: int) -> DataFrame:
    """(session, path, v, since): every path's latest value at frame n."""
    return rows.filter(F.col("f") <= n).groupBy("session", "path").agg(F.max_by("v", "f").alias("v"), F.max("f").alias("since"))


def dense(rows: DataFrame) -> DataFrame:
    """(session, f, path, v) at every frame of the session, carried forward from the path's first value."""
    frames = rows.select("session", "f").distinct()
    paths = rows.groupBy("session", "path").agg(F.min("f").alias("first"))
    scaffold = frames.join(paths, "session").filter("f >= first").drop("first")
    w = by_path().rowsBetween(Window.unboundedPreceding, 0)
    return scaffold.join(rows.select("session", "path", "f", F.struct("v").alias("s")), ["session", "path", "f"], "left").select("session", "f", "path", F.last("s", ignorenulls=True).over(w)["v"].alias("v"))


def encode(rows: DataFrame, every: int = DEFAULT.snapshot_every) -> DataFrame:
    """Sparse rows -> operations: full state at every frame divisible by ``every``, changes between.

    A value holds until the next one of its path, so each row yields its own change and the snapshots it holds at:
    one window by (session, path), no union and no join.
    """
    w, last = by_path(), F.max("f").over(Window.partitionBy("session"))
    held = rows.select("session", "path", F.col("f").cast("bigint").alias("f"), "v", last.cast("bigint").alias("last"))
    held = held.withColumn("until", F.coalesce(F.lead("f").over(w) - 1, F.col("last"))).withColumn("was", F.lag(F.struct("v")).over(w))
    mark = F.ceil(F.col("f") / every).cast("bigint") * every
    moved = (F.col("f") % every != 0) & (F.col("was").isNull() | ~F.col("v").eqNullSafe(F.col("was")["v"]))
    none = F.array().cast("array<bigint>")
    at = F.concat(F.when(moved, F.array("f")).otherwise(none), F.when(mark <= F.col("until"), F.sequence(mark, F.col("until"), F.lit(every).cast("bigint"))).otherwise(none))
    return _ops(held.withColumn("at", F.explode(at)).select("session", F.col("at").alias("f"), F.array("path").alias("path"), F.lit("set").alias("op"), "v"), every)


def encode_dense(rows: DataFrame, every: int = DEFAULT.snapshot_every) -> DataFrame:
    """Dense rows, each frame holding all paths that exist in it, -> operations, with a ``del`` where a path is gone in the next frame."""
    by_frame = Window.partitionBy("session").orderBy("f")
    frames = rows.select("session", F.col("f").cast("bigint").alias("f")).distinct().withColumn("before", F.lag("f").over(by_frame)).withColumn("after", F.lead("f").over(by_frame))
    w = by_path()
    seen = rows.select("session", "path", F.col("f").cast("bigint").alias("f"), "v").join(frames, ["session", "f"])
    seen = seen.withColumn("was", F.lag(F.struct("f", "v")).over(w)).withColumn("next", F.lead("f").over(w))
    stays = F.col("was")["f"].eqNullSafe(F.col("before")) & F.col("was").isNotNull()
    written = (F.col("f") % every == 0) | ~(stays & F.col("v").eqNullSafe(F.col("was")["v"]))
    gone = F.col("after").isNotNull() & ~F.col("next").eqNullSafe(F.col("after")) & (F.col("after") % every != 0)
    put = F.when(written, F.struct(F.col("f").alias("f"), F.lit("set").alias("op"), F.col("v").alias("v")))
    cut = F.when(gone, F.struct(F.col("after").alias("f"), F.lit("del").alias("op"), F.lit(None).cast(rows.schema["v"].dataType).alias("v")))
    return _ops(seen.select("session", F.array("path").alias("path"), F.explode(F.array_compact(F.array(put, cut))).alias("x")).select("session", "x.f", "path", "x.op", "x.v"), every)


def _ops(rows: DataFrame, every: int) -> DataFrame:
    return rows.select("session", (F.floor(F.col("f") / every) * every).alias("snap_f"), "f", "path", "op", "v")


def snapshots(frames: DataFrame) -> DataFrame:
    """The directory of a stream, from frames (session, f, kind[, json]): (session, snap_f, empty), a row for every snapshot.

    A stream that begins with a change has an empty state there. Reads look the nearest snapshot up here, so one
    without members, which leaves no operation, is found like any other.
    """
    body = F.coalesce("json", F.lit("{}")) if "json" in frames.columns else F.lit(None).cast("string")
    first = F.row_number().over(Window.partitionBy("session").orderBy("f")) == 1
    marked = frames.withColumn("__first", first).filter(F.col("__first") | (F.col("kind") == "snapshot"))
    empty = (F.col("kind") != "snapshot") | (F.trim(body) == "{}")
    return marked.select("session", F.col("f").cast("bigint").alias("snap_f"), empty.alias("empty"))


def nearest_snapshots(directory: DataFrame, frames: list[int]) -> DataFrame:
    """(session, n, snap_f): of every session the last snapshot at or before each frame asked for."""
    asked = directory.withColumn("n", F.explode(F.array(*[F.lit(int(n)).cast("bigint") for n in frames])))
    return asked.filter("snap_f <= n").groupBy("session", "n").agg(F.max("snap_f").alias("snap_f"))


def reconstruct_at(ops: DataFrame, frames: list[int], nested: bool = True, directory: DataFrame | None = None) -> DataFrame:
    """(session, n, path, v) at each of some frames, in one pass. Operations before a frame's snapshot take no part.

    With a directory (``snapshots``) the snapshots are found first: their least and greatest number bound the scan of
    the operations from both sides as literals, and an equi-join leaves each session those of its own snapshot. Without
    one, the newest snapshot is the newest that has an operation, and all operations before the frame are read.
    With ``nested`` false no path is another's ancestor and the check for cut ancestors is left out.
    """
    if directory is None:
        seen = ops.withColumn("n", F.explode(F.array(*[F.lit(int(n)).cast("bigint") for n in frames]))).filter("f <= n AND snap_f <= n")
        return fold(seen, "session", "n", nested=nested)
    wanted = nearest_snapshots(directory, frames)
    low, high, sessions = wanted.agg(F.min("snap_f"), F.max("snap_f"), F.count_distinct("session")).first()
    if low is None:
        return ops.limit(0).select("session", F.lit(0).cast("bigint").alias("n"), "path", "v")
    near = ops.filter(F.col("snap_f").between(low, high) & (F.col("f") <= max(map(int, frames))) & (F.col("f") >= low))
    if sessions == 1 and low == high:
        seen = near.join(F.broadcast(wanted.select("session", "n")), "session").filter("f <= n")
    else:
        seen = near.join(wanted, ["session", "snap_f"]).filter("f <= n")
    return fold(seen, "session", "n", nested=nested, one_snapshot=True)


def reconstruct(ops: DataFrame, n: int, nested: bool = True, directory: DataFrame | None = None) -> DataFrame:
    """(session, path, v) at frame n; the bounds on ``snap_f`` and ``f`` are literals that reach the scan."""
    return reconstruct_at(ops.filter((F.col("snap_f") <= n) & (F.col("f") <= n)), [n], nested, directory).drop("n")


def reconstruct_known(ops: DataFrame, at: list[tuple[int, int]], nested: bool = True) -> DataFrame:
    """(session, n, path, v) of one session at frames whose snapshots are known: (frame, snapshot) pairs, all of them literals of the scan."""
    pairs = F.array(*[F.struct(F.lit(int(n)).cast("bigint").alias("n"), F.lit(int(s)).cast("bigint").alias("s")) for n, s in at])
    near = ops.filter(F.col("snap_f").isin(*{int(s) for _, s in at}) & F.col("f").between(min(s for _, s in at), max(n for n, _ in at)))
    own = F.transform(F.filter(pairs, lambda p: (p["s"] == F.col("snap_f")) & (F.col("f") <= p["n"])), lambda p: p["n"])
    return fold(near.withColumn("n", F.explode(own)), "session", "n", nested=nested, one_snapshot=True)


def fold(ops: DataFrame, *keys: str, nested: bool = True, one_snapshot: bool = False) -> DataFrame:
    """Latest operation of each path since the newest snapshot, without paths under an ancestor that was set or deleted at or after it.

    One aggregate by path holds the latest operation and the latest cut; what is older than the newest snapshot
    falls out by a window over what that leaves, unless all operations are known to follow one snapshot. With a column
    ``version`` a later version goes before all earlier ones, whatever their frames, and each has a newest snapshot of its own.
    """
    keys = keys or ("session",)
    versions = ["version"] if "version" in ops.columns else []
    at = F.struct(*versions, "snap_f", "f")
    latest = ops.groupBy(*keys, "path", *versions).agg(
        F.max_by(F.struct("op", "v"), at).alias("r"), F.max(at).alias("at"), F.max(F.when(F.col("op").isin("set", "del"), at)).alias("cut")
    )
    if not one_snapshot:
        latest = latest.withColumn("newest", F.max("at.snap_f").over(Window.partitionBy(*keys, *versions))).filter("at.snap_f = newest").drop("newest")
    if versions:
        latest = latest.groupBy(*keys, "path").agg(F.max_by("r", "at").alias("r"), F.max("at").alias("at"), F.max("cut").alias("cut"))
    kept = latest.filter("r.op = 'set'").select(*keys, "path", "at", F.col("r.v").alias("v"))
    if not nested:
        return kept.drop("at")
    deep = kept.filter(F.size("path") > 1)
    above = deep.select(*keys, F.col("path").alias("leaf"), "at", F.explode(F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.slice("path", F.lit(1), i))).alias("path"))
    dead = above.join(latest.select(*keys, "path", "cut"), [*keys, "path"]).filter("cut >= at").select(*keys, F.col("leaf").alias("path")).distinct()
    return kept.join(dead, [*keys, "path"], "left_anti").select(*keys, "path", "v")


def known_at(ops: DataFrame, n: int, version: int, nested: bool = True) -> DataFrame:
    """(session, path, v) at frame n as it was known when ``version`` was the last: operations (session, version, snap_f, f, path, op, v).

    Version 0 is what was recorded; a correction is an operation of a later version, which holds from its frame on
    against all earlier versions, sets or removes a path (with all below it), and takes part in reads from then on.
    """
    seen = ops.filter((F.col("version") <= version) & (F.col("snap_f") <= n) & (F.col("f") <= n))
    return fold(seen, nested=nested)


def changes_between(rows: DataFrame, f0: int, f1: int) -> DataFrame:
    """Changed rows with f in the closed range; the filter stays above the window since lag looks before f0."""
    return changed(rows).filter(F.col("f").between(f0, f1))


def depth(text: Column) -> Column:
    """How many objects or lists of a JSON text lie within each other at most: brackets are counted, strings left out."""
    marks = F.regexp_replace(F.regexp_replace(text, r'"(?:[^"\\]|\\.)*+"', ""), r"[^{}\[\]]", "")
    step = lambda acc, c: F.struct((acc["now"] + F.when(c.isin("{", "["), 1).otherwise(-1)).alias("now"), F.greatest(acc["most"], acc["now"] + 1).alias("most"))
    return F.aggregate(F.filter(F.split(marks, ""), lambda c: c != ""), F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step, lambda acc: F.least(acc["most"], F.length(marks)))


def patch_ops(patches: DataFrame, text: Column) -> DataFrame:
    """Merge patches (session, snap_f, f, json) -> operations. Nested objects open into leaves, null deletes; an object keeps an ``obj`` row, which displaces a scalar and leaves an object's members alone.

    Each row opens its own VARIANT as often as its text is deep, whatever that depth: one scan, no Python. A patch
    that is no object has no operations.
    """
    item = "array<struct<path:array<string>,op:string,node:variant>>"

    def opened(x: Column) -> Column:
        one = lambda op: F.array(F.struct(x["path"].alias("path"), F.lit(op).alias("op"), x["node"].alias("node")))
        is_object = F.schema_of_variant(x["node"]).startswith("OBJECT")
        members = F.transform(F.map_entries(x["node"].try_cast("map<string,variant>")), lambda e: F.struct(F.concat(x["path"], F.array(e["key"])).alias("path"), F.lit(None).cast("string").alias("op"), e["value"].alias("node")))
        return F.when(x["op"].isNotNull(), F.array(x)).when(is_object, F.concat(one("obj"), members)).when(F.is_variant_null(x["node"]), one("del")).otherwise(one("set")).cast(item)

    root = F.array(F.struct(F.array().cast("array<string>").alias("path"), F.lit(None).cast("string").alias("op"), F.parse_json(text).alias("node"))).cast(item)
    levels = F.sequence(F.lit(0), depth(text))
    all_of = F.aggregate(levels, root, lambda acc, _: F.flatten(F.transform(acc, opened)).cast(item))
    rows = patches.select("session", "snap_f", F.col("f").cast("bigint").alias("f"), F.explode(all_of).alias("x")).filter("size(x.path) > 0")
    return rows.select("session", "snap_f", "f", "x.path", "x.op", F.when(F.col("x.op") == "set", F.to_json("x.node")).alias("v"))


def _patch(old: dict, new: dict) -> dict:
    """The merge patch from old to new: gone members null; a field that holds a null, which no patch can set, is written whole."""
    found: dict = dict.fromkeys(old.keys() - new.keys())
    for name, value in new.items():
        had = old.get(name)
        if name in old and had == value:
            continue
        within = isinstance(had, dict) and isinstance(value, dict) and not ({"v", "source"} <= value.keys() and None in value.values())
        found[name] = _patch(had, value) if within else value
    return found


@F.pandas_udf(StringType())
def merge_patch_between(old: pd.Series, new: pd.Series) -> pd.Series:
    """Merge patches between two columns of JSON objects, compact; null counts as an empty object."""
    return pd.Series([json.dumps(_patch(json.loads(a or "{}"), json.loads(b or "{}")), separators=(",", ":")) for a, b in zip(old, new, strict=True)])


def stream_of(states: DataFrame, every: int = DEFAULT.snapshot_every) -> DataFrame:
    """Whole states (session, f, json) -> frames (session, f, kind, snap_f, json) of snapshots and merge patches, as a writer stores them."""
    w = Window.partitionBy("session").orderBy("f")
    marked = states.withColumn("old", F.lag("json").over(w)).withColumn("kind", F.when((F.col("f") % every == 0) | F.col("old").isNull(), "snapshot").otherwise("delta"))
    snap = F.last(F.when(F.col("kind") == "snapshot", F.col("f")), True).over(w)
    kept = F.when(F.col("kind") == "snapshot", F.col("json")).otherwise(merge_patch_between("old", "json"))
    return marked.withColumn("snap_f", snap).select("session", "f", "kind", "snap_f", kept.alias("json"))


def compression(dense_rows: DataFrame, ops: DataFrame) -> DataFrame:
    """Bytes of per-frame JSON against bytes of the operations."""
    one = dense_rows.agg(F.sum(F.octet_length(F.to_json(F.struct("session", "f", "path", "v")))).alias("dense_bytes"))
    two = ops.agg(F.sum(F.octet_length(F.to_json(F.struct("session", "f", F.col("path")[0].alias("path"), "v")))).alias("stored_bytes"))
    return one.join(two).withColumn("ratio", F.round(F.col("dense_bytes") / F.col("stored_bytes"), 4))
