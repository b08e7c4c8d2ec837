"""Entity boxes and annotation records: lists by frame, interpolation, exclusion, merging, word lines."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def box_list(rows: DataFrame) -> DataFrame:
    """rows (session, f, id, box array, visible, source) -> (session, f, boxes): boxes of four numbers in order of id; a hidden one is inferred."""
    good = rows.filter(F.size("box") == 4)
    one = F.struct("id", "box", F.coalesce("visible", F.lit(True)).alias("visible"), F.when(F.coalesce("visible", F.lit(True)), F.col("source")).otherwise("inferred").alias("source"))
    return good.groupBy("session", "f").agg(F.array_sort(F.collect_list(one)).alias("boxes"))


def interpolated_boxes(records: DataFrame, at: DataFrame) -> DataFrame:
    """records (session, t, id, x, y, w, h), at (session, t) -> every box of the record at or before t, moved linearly towards
    the same id of the next record; held if that lacks it; before the first record its boxes, after the last its boxes.

    Both sides meet in one window over record times, then an equi-join on (session, record, id).
    """
    times = records.select("session", "t").distinct()
    both = times.select("session", "t", F.col("t").alias("rec"), F.lit(0).alias("q")).unionByName(at.select("session", "t", F.lit(None).cast("double").alias("rec"), F.lit(1).alias("q")))
    w = Window.partitionBy("session").orderBy("t", "q")
    placed = both.withColumn("a", F.last("rec", True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("b", F.first("rec", True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    asked = placed.filter("q = 1").select("session", F.col("t").alias("at"), F.coalesce("a", "b").alias("a"), F.when(F.col("a").isNotNull(), F.col("b")).alias("b"))
    box = F.struct(*[F.col(c).cast("double").alias(c) for c in "xywh"])
    first = records.groupBy("session", F.col("t").alias("a"), "id").agg(F.first(box).alias("p"))
    then = records.groupBy("session", F.col("t").alias("b"), "id").agg(F.first(box).alias("n"))
    joined = asked.join(first, ["session", "a"]).join(then, ["session", "b", "id"], "left")
    share = F.coalesce((F.col("at") - F.col("a")) / (F.col("b") - F.col("a")), F.lit(0.0))
    mixed = [(F.col(f"p.{c}") + (F.coalesce(F.col(f"n.{c}"), F.col(f"p.{c}")) - F.col(f"p.{c}")) * share).alias(c) for c in "xywh"]
    return joined.select("session", F.col("at").alias("t"), "id", *mixed)


def outside_known(points: DataFrame, known: DataFrame, cols: int = 8, rows: int = 6) -> DataFrame:
    """Points (session, px, py) that lie in no known box (session, x, y, w, h): an anti-join on the grid cells that boxes cover."""
    from chronolith.functions.geometry import cells

    cell = F.floor(F.least(F.col("py"), F.lit(0.999999)) * rows).cast("int") * cols + F.floor(F.least(F.col("px"), F.lit(0.999999)) * cols).cast("int")
    spread = known.withColumn("cell", F.explode(cells(F.col("x"), F.col("y"), F.col("w"), F.col("h"), cols, rows)))
    p, k = points.withColumn("cell", cell).alias("p"), spread.alias("k")
    inside = F.expr("p.session = k.session AND p.cell = k.cell AND px BETWEEN k.x AND k.x + k.w AND py BETWEEN k.y AND k.y + k.h")
    return p.join(k, inside, "left_anti").drop("cell")


def merged_records(records: DataFrame) -> DataFrame:
    """Annotation records as a writer appends them: of repeated (session, t, frame) the last, in order of time."""
    value = F.struct(*[F.col(c) for c in records.columns if c not in ("session", "t", "frame")])
    return records.groupBy("session", "t", "frame").agg(F.max_by(value, "seq").alias("r")).select("session", "t", "frame", "r.*").orderBy("session", "t", "frame")


def grid_filled(rows: DataFrame, value: Column) -> DataFrame:
    """A row for every frame between a session's first and last; missing ones take the frame before."""
    span = rows.groupBy("session").agg(F.min("f").alias("a"), F.max("f").alias("b")).select("session", F.explode(F.sequence("a", "b")).alias("f"))
    w = Window.partitionBy("session").orderBy("f").rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.select("session", "f", F.struct(value.alias("v")).alias("s"))
    return span.join(seen, ["session", "f"], "left").select("session", "f", F.col("s").isNull().alias("filled"), F.last("s", True).over(w)["v"].alias("v"))


def word_lines(words: DataFrame, least: float = 40.0) -> DataFrame:
    """words (page, x, y, w, h, text[, conf]) -> lines (page, line, text, x, y, w, h).

    Words of a confidence below ``least``, blank ones and second readings of a word in the same 8-pixel cell are left
    out. From top to bottom a word joins the first line whose height has its middle and whose end is less than three
    heights (of the taller) before it, else opens one; a line's words are joined from left to right.
    """
    sure = F.col("conf") >= least if "conf" in words.columns else F.lit(True)
    cell = [F.floor(F.col(c) / 8) for c in "xy"]
    read = words.filter(sure & (F.trim("text") != "")).withColumn("text", F.trim("text"))
    first = F.row_number().over(Window.partitionBy("page", "text", *cell).orderBy("y", "x", "w", "h"))
    read = read.withColumn("__nth", first).filter("__nth = 1").select("page", "x", "y", "w", "h", "text")

    read = read.withColumn("place", F.row_number().over(Window.partitionBy("page").orderBy("y", "x", "text")).cast("bigint"))

    def placed(p: pd.DataFrame) -> pd.DataFrame:
        """The line of each word; the lines so far are three arrays, asked all at once whether they take a word."""
        p = p.sort_values("place", kind="stable")
        x, y, w, h = (p[c].to_numpy(float) for c in "xywh")
        n, lines, number = len(p), 0, np.zeros(len(p), np.int64)
        top, bottom, end = np.full(n, np.inf), np.full(n, -np.inf), np.full(n, -np.inf)
        for i in range(n):
            at = slice(0, lines)
            level = np.abs(y[i] + h[i] / 2 - (top[at] + bottom[at]) / 2) <= (bottom[at] - top[at]) / 2
            takes = level & (x[i] - end[at] < 3 * np.maximum(h[i], bottom[at] - top[at]))
            number[i] = k = int(takes.argmax()) if takes.any() else lines
            lines = max(lines, k + 1)
            top[k], bottom[k], end[k] = min(top[k], y[i]), max(bottom[k], y[i] + h[i]), max(end[k], x[i] + w[i])
        return p.assign(line=number)

    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in read.schema]
    words_in = read.groupBy("page").applyInPandas(placed, ", ".join([*kinds, "line bigint"]))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "place", "text"))), lambda v: v["text"]), " ")
    low = words_in.groupBy("page", "line").agg(said.alias("text"), *[F.min(c).cast("double").alias(c) for c in "xy"], F.max(F.col("x") + F.col("w")).alias("x1"), F.max(F.col("y") + F.col("h")).alias("y1"))
    return low.select("page", "line", "text", "x", "y", (F.col("x1") - F.col("x")).cast("double").alias("w"), (F.col("y1") - F.col("y")).cast("double").alias("h"))


def agreed(readings: DataFrame, least: int = 2) -> DataFrame:
    """(key, text) of several readers -> the most common text, if at least ``least`` agree; ties take the lesser text."""
    counts = readings.filter("text IS NOT NULL").groupBy("key", "text").agg(F.count(F.lit(1)).alias("n"))
    ranked = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("n"), "text"))
    return counts.withColumn("r", ranked).filter((F.col("r") == 1) & (F.col("n") >= least)).drop("r")
