"""Detection rules over signals: transients, cuts, votes, hysteresis, modes, decay.

These are the stateless forms, windows only. Where the exact rule depends on what it has emitted before,
the sequential kernel of the same name is in ``operators.track``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolith.config import DEFAULT
from chronolith.functions.signal import decayed


def transients(rows: DataFrame, jump: float, back: float, *keys: str) -> DataFrame:
    """Spikes of one or two frames: v leaves the previous level by ``jump`` and is within ``back`` of it one or two frames later."""
    w = Window.partitionBy(*keys).orderBy("f")
    ref, one, two = F.lag("v").over(w), F.lead("v", 1).over(w), F.lead("v", 2).over(w)
    out = rows.withColumn("ref", ref).withColumn("one", one).withColumn("two", two)
    near = lambda c: F.abs(F.col(c) - F.col("ref")) < back
    length = F.when(near("one"), 1).when(near("two"), 2)
    return out.filter(F.abs(F.col("v") - F.col("ref")) >= jump).withColumn("length", length).filter("length IS NOT NULL").drop("one", "two")


def level_shifts(rows: DataFrame, jump: float, *keys: str) -> DataFrame:
    """Changes that hold: v and the two frames after it all differ from the previous level by ``jump`` or more (no cooldown)."""
    w = Window.partitionBy(*keys).orderBy("f")
    out = rows.withColumn("ref", F.lag("v").over(w)).withColumn("one", F.lead("v", 1).over(w)).withColumn("two", F.lead("v", 2).over(w))
    far = lambda c: F.abs(F.col(c) - F.col("ref")) >= jump
    return out.filter(far("v") & far("one") & far("two")).drop("one", "two")


def majority(rows: DataFrame, value: str, votes: int = DEFAULT.votes, window: int = DEFAULT.vote_window, *keys: str) -> DataFrame:
    """The value that holds at least ``votes`` of the last ``window`` reads, null where none does."""
    w = Window.partitionBy(*keys).orderBy("f").rowsBetween(1 - window, 0)
    reads = rows.withColumn("__reads", F.collect_list(value).over(w))
    count = lambda x: F.size(F.filter("__reads", lambda y: y == x))
    winners = F.filter(F.array_distinct("__reads"), lambda x: count(x) >= votes)
    return reads.withColumn("vote", F.get(F.array_sort(winners), 0)).drop("__reads")


def implausible(value: Column, old: Column) -> Column:
    """A jump that a misread explains better than the scene does."""
    return (value != old) & (F.abs(value - old) > F.greatest(F.lit(1000.0), 10 * F.abs(old)))


def gaps(rows: DataFrame, at: Column, hide: float, remove: float, *keys: str) -> DataFrame:
    """State after each sighting by the time to the next one: kept, hidden or removed."""
    w = Window.partitionBy(*keys).orderBy("f")
    gap = F.lead(at).over(w) - at
    return rows.withColumn("gap", gap).withColumn("fate", F.when(F.col("gap") >= remove, "removed").when(F.col("gap") >= hide, "hidden").otherwise("kept"))


def region_mode(cut: Column, flash: Column, residual: Column, is_text: Column, explained: Column) -> Column:
    """Mode of a region without budget: F cut, V in a flash or text cell, C quiet, R unexplained and large, P explained, else V."""
    t = DEFAULT
    return (
        F.when(cut, "F").when(flash, "V").when(residual < t.copy_residual, "C").when(is_text, "V")
        .when((residual > t.big_residual) & ~explained, "R").when(explained, "P").otherwise("V")
    )


def provenance(frames_since: Column, hidden: Column) -> Column:
    return F.when(hidden, "inferred").when(frames_since == 0, "observed").otherwise("propagated")


def confidences(rows: DataFrame, anchor: Column, base: float, *keys: str, rate: float = DEFAULT.decay_propagated) -> DataFrame:
    """Confidence and provenance of every row from the last anchor at or before it."""
    w = Window.partitionBy(*keys).orderBy("f").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("anchor_f", F.last(F.when(anchor, F.col("f")), True).over(w)).filter("anchor_f IS NOT NULL")
    since = F.col("f") - F.col("anchor_f")
    return out.withColumn("conf", F.round(decayed(base, rate, since), 6)).withColumn("source", provenance(since, F.lit(False)))


def backdated(changes: DataFrame, flashes: DataFrame, after: int = 2) -> DataFrame:
    """Changes (session, f) that come within ``after`` frames of a flash's end, dated to its start, inferred, .75; others stay observed at .9."""
    near = flashes.select("session", F.col("f_start").alias("flash_f"), F.explode(F.sequence(F.col("f_start"), F.col("f_end") + after)).alias("f"))
    hit = near.groupBy("session", "f").agg(F.min("flash_f").alias("flash_f"))
    out = changes.join(hit, ["session", "f"], "left")
    under = F.col("flash_f").isNotNull()
    return out.withColumn("f_eff", F.coalesce("flash_f", "f")).withColumn("source", F.when(under, "inferred").otherwise("observed")).withColumn("conf", F.when(under, 0.75).otherwise(0.9)).drop("flash_f")


def in_time(results: DataFrame, within: int) -> DataFrame:
    """results (session, asked_f, done_f): kept if done within so many frames; one that comes later, or never, is dropped and counted."""
    return results.withColumn("kept", F.coalesce(F.col("done_f") - F.col("asked_f") <= within, F.lit(False)))


def once_by_checksum(rows: DataFrame, payload: Column, order: str) -> DataFrame:
    """One row for each distinct payload, the least by ``order``: what a costly reader is asked; results join back by checksum."""
    keyed = rows.withColumn("checksum", F.md5(payload))
    return keyed.groupBy("checksum").agg(F.min(order).alias(order), F.count(F.lit(1)).alias("copies"))


def confirmed(tracks: DataFrame, hits: int = DEFAULT.confirm_hits, move: float = DEFAULT.confirm_move) -> DataFrame:
    """Tentative tracks (session, path, f, x, y) with enough sightings and displacement."""
    first = F.min_by(F.struct("x", "y"), "f")
    far = F.max(F.hypot(F.col("x") - F.col("x0"), F.col("y") - F.col("y0")))
    start = tracks.groupBy("session", "path").agg(first.alias("s")).select("session", "path", F.col("s.x").alias("x0"), F.col("s.y").alias("y0"))
    return tracks.join(start, ["session", "path"]).groupBy("session", "path").agg(F.count(F.lit(1)).alias("hits"), far.alias("moved"), F.min("f").alias("f_start")).filter((F.col("hits") >= hits) & (F.col("moved") >= move))
