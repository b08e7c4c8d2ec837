"""Fields, a value with where it comes from, and the timelines of their values, from operations on leaves."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolith.config import DEFAULT
from chronolith.operators import intervals, timeline, track

#: Members of a field, and the column that each becomes.
MEMBERS = {"v": "v", "conf": "conf", "source": "source", "f": "f_obs", "bbox": "bbox", "crop": "crop"}
TIMELINE = "session string, path string, f bigint, v string, conf double, source string, f_obs bigint, bbox string, crop string"


def _typed(rows: DataFrame, *keys: str) -> DataFrame:
    """JSON texts of the members -> typed columns; v and bbox stay JSON."""
    text = lambda c: F.from_json(F.concat(F.lit("["), F.col(c), F.lit("]")), "array<string>")[0]
    return rows.select(*keys, "v", F.col("conf").try_cast("double").alias("conf"), text("source").alias("source"), F.col("f_obs").try_cast("bigint").alias("f_obs"), "bbox", text("crop").alias("crop"))


def field_rows(ops: DataFrame) -> DataFrame:
    """(session, field array, f, v, conf, source, f_obs, bbox, crop): fields as they are after each frame that touches them."""
    leaf = F.element_at("path", -1)
    own = ops.filter((F.size("path") > 1) & leaf.isin(*MEMBERS) & F.col("op").isin("set", "del"))
    own = own.select("session", F.slice("path", F.lit(1), F.size("path") - 1).alias("field"), "f", leaf.alias("leaf"), F.struct(F.when(F.col("op") == "set", F.col("v")).alias("v")).alias("s"))
    wide = own.groupBy("session", "field", "f").agg(*[F.max(F.when(F.col("leaf") == k, F.col("s"))).alias(c) for k, c in MEMBERS.items()])
    w = Window.partitionBy("session", "field").orderBy("f").rowsBetween(Window.unboundedPreceding, 0)
    held = wide.select("session", "field", "f", *[F.last(c, True).over(w)["v"].alias(c) for c in MEMBERS.values()])
    return _typed(held.filter("v IS NOT NULL"), "session", "field", "f")


def fields_at(state: DataFrame, *keys: str) -> DataFrame:
    """State leaves (keys, path array, v) -> one row a field: (keys, field, v, conf, source, f_obs, bbox, crop)."""
    leaf = F.element_at("path", -1)
    own = state.filter((F.size("path") > 1) & leaf.isin(*MEMBERS)).withColumn("leaf", leaf).withColumn("field", F.slice("path", F.lit(1), F.size("path") - 1))
    wide = own.groupBy(*keys, "field").agg(*[F.max(F.when(F.col("leaf") == k, F.col("v"))).alias(c) for k, c in MEMBERS.items()])
    return _typed(wide.filter("v IS NOT NULL"), *keys, "field")


def presence(ops: DataFrame, frames: DataFrame) -> DataFrame:
    """(session, id, f, v): the frames at which an entity comes (true) or goes (false). A snapshot that lacks it ends it, as a delete does."""
    under = ops.filter((F.get("path", F.lit(0)) == "entities") & (F.size("path") > 1))
    gone = (F.size("path") == 2) & (F.col("op") != "obj")
    touched = under.groupBy("session", F.col("path")[1].alias("id"), "f").agg((~F.min(gone)).alias("v"))
    cuts = ops.filter((F.size("path") == 1) & (F.get("path", F.lit(0)) == "entities") & F.col("op").isin("set", "del")).select("session", "f")
    resets = frames.filter("kind = 'snapshot'").select("session", "f").union(cuts).distinct().select("session", F.lit(None).cast("string").alias("id"), "f", F.lit(None).cast("boolean").alias("v"))
    # only the first reset after a touch can end an entity: seen from the back, the last reset before it, those of its own frame left out
    back = Window.partitionBy("session").orderBy(F.desc("f"), F.col("id").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = touched.select("session", "id", "f", "v").union(resets).withColumn("reset", F.last(F.when(F.col("id").isNull(), F.col("f")), True).over(back)).filter("id IS NOT NULL")
    both = both.withColumn("next", F.lead("f").over(Window.partitionBy("session", "id").orderBy("f")))
    ended = F.when(F.col("reset").isNotNull() & (F.col("next").isNull() | (F.col("next") > F.col("reset"))), F.struct(F.col("reset").alias("f"), F.lit(False).alias("v")))
    seen = both.select("session", "id", F.explode(F.array_compact(F.array(F.struct("f", "v"), ended))).alias("x")).select("session", "id", "x.f", "x.v")
    before = F.coalesce(F.lag("v").over(Window.partitionBy("session", "id").orderBy("f")), F.lit(False))
    return seen.withColumn("was", before).filter("v <> was").drop("was")


def spans(present: DataFrame, frames: DataFrame) -> DataFrame:
    """(session, id, first_f, last_f): the closed intervals in which an entity is there; a frame before the next event ends them."""
    last = frames.groupBy("session").agg(F.max("f").alias("end"))
    nxt = F.lead("f").over(Window.partitionBy("session", "id").orderBy("f"))
    return present.withColumn("next", nxt).filter("v").join(last, "session").select("session", "id", F.col("f").alias("first_f"), F.coalesce(F.col("next") - 1, F.col("end")).alias("last_f"))


def visible_spans(values: DataFrame, present: DataFrame, frames: DataFrame) -> DataFrame:
    """(session, id, f_start, f_end): closed intervals in which an entity is there and visible; one without a visible field is.

    values: timelines (session, path, f, v); the last open interval ends with the last frame if the entity is still there.
    """
    seen = values.filter(F.col("path").rlike("^entities/[^/]+/visible$")).select("session", F.split("path", "/")[1].alias("path"), "f", (F.col("v") == "true").alias("v"))
    there = present.select("session", F.col("id").alias("path"), "f", "v")
    ends = frames.groupBy("session").agg((F.max("f") + 1).alias("n"))
    open_ends = timeline.visible_intervals(there, seen, -1)  # marks an open interval of a present entity by -2
    return open_ends.join(ends, "session").select("session", F.col("path").alias("id"), "f_start", F.when(F.col("f_end") == -2, F.col("n") - 1).otherwise(F.col("f_end")).alias("f_end"))


def visible_counts(visible: DataFrame, frames: DataFrame) -> DataFrame:
    """(session, f, n): how many entities are visible, from each frame at which that changes on. Both ends of every interval count."""
    first = frames.groupBy("session").agg(F.min("f").alias("f"), F.max("f").alias("end"))
    steps = visible.select("session", F.col("f_start").alias("f"), F.lit(1).alias("d")).union(visible.select("session", F.col("f_end") + 1, F.lit(-1)))
    steps = steps.union(first.select("session", "f", F.lit(0))).groupBy("session", "f").agg(F.sum("d").alias("d")).join(first.select("session", "end"), "session").filter("f <= end")
    w = Window.partitionBy("session").orderBy("f")
    counted = steps.withColumn("n", F.sum("d").over(w)).withColumn("was", F.lag(F.sum("d").over(w)).over(w))
    return counted.filter("was IS NULL OR n <> was").select("session", "f", "n")


def timelines(ops: DataFrame, frames: DataFrame, kept: list[DataFrame] | None = None) -> DataFrame:
    """Value changes of all fields under ``group/key[/attribute]``, with ``present`` and a sampled ``bbox`` of every entity and the count of visible ones.

    Two tables are used several times: where the caller gives a list, they are cached and put there, for the caller to release.
    """
    hold = lambda df: df if kept is None else (kept.append(df.cache()) or df)
    path = F.array_join("field", "/")
    group, size = F.col("field")[0], F.size("field")
    shape = ((group.isin("hud", "text") & (size == 2)) | (path == "scene/label")) | ((group == "entities") & (size == 3))
    rows = hold(field_rows(ops).filter(shape))
    w = Window.partitionBy("session", "field").orderBy("f")
    plain = rows.filter((group != "entities") | (F.element_at("field", -1) != "bbox")).withColumn("was", F.lag("v").over(w)).filter("was IS NULL OR v <> was")
    columns = [c.split()[0] for c in TIMELINE.split(", ")]
    values = plain.withColumn("path", path).select(*columns)
    there = hold(presence(ops, frames))
    own = lambda name, v, f, conf, source: [name.alias("path"), f.alias("f"), v.alias("v"), F.lit(conf).cast("double").alias("conf"), F.lit(source).alias("source"), f.alias("f_obs"), F.lit(None).cast("string").alias("bbox"), F.lit(None).cast("string").alias("crop")]
    present = there.select("session", *own(F.concat(F.lit("entities/"), "id", F.lit("/present")), F.col("v").cast("string"), F.col("f"), 1.0, "observed"))
    counts = visible_counts(visible_spans(values, there, frames), frames)
    derived = counts.select("session", *own(F.lit("derived/visible_entity_count"), F.col("n").cast("string"), F.col("f"), None, "inferred"))
    # a box at the first frame that has one, then at every frame that is a sampling gap after the last one listed
    boxes = rows.filter((group == "entities") & (F.element_at("field", -1) == "bbox")).withColumn("path", path)
    held = boxes.select("session", F.col("field")[1].alias("id"), "path", "f").join(spans(there, frames), ["session", "id"]).filter("f BETWEEN first_f AND last_f")
    shown = held.groupBy("session", "path", "id", "last_f").agg(F.min("f").alias("a"))
    # frames meet the spans whose stretches of ten gaps they lie in, not all spans of their session
    stretch = lambda c: F.floor(F.col(c) / (10 * DEFAULT.bbox_sample_gap))
    spread = shown.withColumn("__b", F.explode(F.sequence(stretch("a"), stretch("last_f"))))
    frames_of = spread.join(frames.select("session", "f", stretch("f").alias("__b")), ["session", "__b"]).filter("f BETWEEN a AND last_f").select("session", "path", "f")
    sampled = track.spaced(frames_of, DEFAULT.bbox_sample_gap)
    value = F.struct("v", "conf", "source", "f_obs", "crop")
    listed = timeline.as_of_join(sampled, boxes.select("session", "path", "f", value.alias("x")), "x", "session", "path")
    bbox = listed.select("session", "path", "f", "x.v", "x.conf", "x.source", "x.f_obs", F.lit(None).cast("string").alias("bbox"), "x.crop")
    return reduce(DataFrame.unionByName, [values, present, derived, bbox])


def windows(frames: DataFrame, values: DataFrame, ops: DataFrame, events: DataFrame, fps: float, seconds: int = 10) -> DataFrame:
    """The tumbling summary: window, t_start_s, f_start, f_end, scene, entities_seen, events, hud_end, text_end, modes, vlm_frames, highlights.

    Objects with names for keys are JSON texts. Values at a window's end are those of the last change at or before it.
    """
    number = lambda f: F.floor(f / F.lit(fps) / seconds)
    one = frames.withColumn("window", number(F.col("f")))
    base = one.groupBy("session", "window").agg(F.min("f").alias("f_start"), F.max("f").alias("f_end"), F.count_if("vlm").alias("vlm_frames"))
    letters = one.select("session", "window", F.explode(F.split(F.coalesce("modes", F.lit("")), "")).alias("k")).filter("k <> ''")
    counted = lambda rows, name: rows.groupBy("session", "window", "k").agg(F.count(F.lit(1)).alias("n")).groupBy("session", "window").agg(_object("k", "n").alias(name))
    # the last value of each path by window, carried over windows that change nothing
    last = values.filter(F.col("path").rlike("^(hud|text)/[^/]+$|^scene/label$")).withColumn("window", number(F.col("f"))).groupBy("session", "path", "window").agg(F.max_by("v", "f").alias("v"))
    grid = base.select("session", "window").join(last.select("session", "path").distinct(), "session").join(last, ["session", "path", "window"], "left")
    carried = grid.withColumn("v", F.last("v", True).over(Window.partitionBy("session", "path").orderBy("window"))).filter("v IS NOT NULL").withColumn("group", F.split("path", "/")[0]).withColumn("k", F.split("path", "/")[1])
    ends = carried.groupBy("session", "window").agg(
        _object("k", "v", F.col("group") == "hud").alias("hud_end"), _object("k", "v", F.col("group") == "text").alias("text_end"), F.max(F.when(F.col("group") == "scene", F.col("v"))).alias("scene")
    )
    there = spans(presence(ops, frames), frames)
    seen = there.withColumn("window", F.explode(F.sequence(number(F.col("first_f")), number(F.col("last_f"))))).groupBy("session", "window").agg(F.array_sort(F.collect_set("id")).alias("entities_seen"))
    bounds = base.select("session", "window", F.col("f_start").alias("a"), F.col("f_end").alias("b"))
    found = events.withColumn("window", number(F.col("f_start"))).join(bounds, ["session", "window"]).filter("f_start BETWEEN a AND b").withColumn("k", F.col("type"))
    change = F.concat(F.lit(" "), F.coalesce("entity", F.lit("")), F.lit(" "), F.coalesce(F.to_json("from"), F.lit("")), F.lit("→"), F.coalesce(F.to_json("to"), F.lit("")))
    said = F.concat(F.format_string("f%d %s", "f_start", "type"), F.when(F.col("type").isin("ui_value_changed", "text_changed"), change).otherwise(""))
    first = F.row_number().over(Window.partitionBy("session", "window").orderBy("f_start", "id"))
    high = found.filter("type <> 'confidence_warning'").withColumn("r", first).filter("r <= 20").groupBy("session", "window").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", said.alias("x")))), lambda s: s["x"]).alias("highlights"))
    parts = [base, ends, seen, counted(found, "events"), counted(letters, "modes"), high]
    out = reduce(lambda a, b: a.join(b, ["session", "window"], "left"), parts)
    none = F.array().cast("array<string>")
    return out.select(
        "session", "window", (F.col("window") * seconds).alias("t_start_s"), "f_start", "f_end", "scene", F.coalesce("entities_seen", none).alias("entities_seen"),
        *[F.coalesce(c, F.lit("{}")).alias(c) for c in ("events", "hud_end", "text_end", "modes")], "vlm_frames", F.coalesce("highlights", none).alias("highlights"),
    )


#: Members of a summary window's document, in order; the second kind are JSON already.
WINDOW_MEMBERS = ("window", "t_start_s", "f_start", "f_end", "scene", "entities_seen", "events", "hud_end", "text_end", "modes", "vlm_frames", "highlights")
JSON_MEMBERS = {"scene", "events", "hud_end", "text_end", "modes"}


def window_document() -> Column:
    """A summary window as the document has it: all its members by name, nulls too, and nothing of where it is stored."""
    value = lambda c: F.col(c) if c in JSON_MEMBERS else F.to_json(c) if c in ("entities_seen", "highlights") else F.col(c).cast("string")
    return F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{c}":'), F.coalesce(value(c), F.lit("null"))) for c in WINDOW_MEMBERS]), F.lit("}"))


def _object(key: str, value: str, where: Column | None = None) -> Column:
    """A JSON object of a group's keys and values, keys in order; values are JSON already."""
    pair = F.concat(F.to_json(F.array(key)).substr(F.lit(2), F.length(F.to_json(F.array(key))) - 2), F.lit(":"), F.col(value).cast("string"))
    listed = F.array_sort(F.collect_list(pair if where is None else F.when(where, pair)))
    return F.concat(F.lit("{"), F.array_join(listed, ","), F.lit("}"))


def in_range(events: DataFrame, f0: int, f1: int) -> DataFrame:
    return intervals.overlapping(events, F.lit(f0), F.lit(f1), F.coalesce("f_start", F.lit(0)), F.coalesce("f_end", "f_start", F.lit(0)))
