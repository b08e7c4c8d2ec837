"""Rules on pixels as rows (session, [f,] x, y, v): adaptive tiles, and the search for steady text and values.

Nothing here holds an image: neighbours are windows along rows and columns, sums over boxes come from an integral
image of two running windows, tiles from sums that are rolled up level by level. All is partitioned by session and
line or tile, so the pixels of a session are spread over tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolith.functions.geometry import iou, morton


def tile_levels(pixels: DataFrame, levels: int, *keys: str) -> list[DataFrame]:
    """Sums of every tile, from the whole picture (level 0) down to single places (``levels``): (keys, tile, n, s, q).

    Only the lowest level reads pixels; each level above adds up the four children of a tile. A tile's number is its
    Morton code, so the parent's is that without the last two bits.
    """
    at = [pixels.groupBy(*keys, morton(F.col("x"), F.col("y"), levels).alias("tile")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("v").cast("double").alias("s"), F.sum(F.col("v") * F.col("v")).cast("double").alias("q"))]
    for _ in range(levels):
        at.append(at[-1].groupBy(*keys, F.shiftright("tile", 2).alias("tile")).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")))
    return at[::-1]


def detail() -> Column:
    """Variance of a tile's values."""
    return F.col("q") / F.col("n") - (F.col("s") / F.col("n")) * (F.col("s") / F.col("n"))


def quadtree(pixels: DataFrame, levels: int, limit: float, *keys: str) -> DataFrame:
    """pixels (keys, x, y, v) with x and y below 2**levels -> (keys, level, tile, n, mean, detail): the leaves of an adaptive quadtree.

    A tile whose detail is above the limit is split into its four quarters, down to single places; the others are
    leaves. Tiles without pixels are left out.
    """
    leaves, open_ = [], None
    for k, rows in enumerate(tile_levels(pixels, levels, *keys)):
        here = rows.withColumn("detail", detail())
        if open_ is not None:
            here = here.withColumn("__up", F.shiftright("tile", 2)).join(open_, [*keys, "__up"]).drop("__up")
        deeper = F.col("detail") > limit if k < levels else F.lit(False)
        leaves.append(here.filter(~deeper).select(*keys, F.lit(k).alias("level"), "tile", "n", (F.col("s") / F.col("n")).alias("mean"), "detail"))
        open_ = here.filter(deeper).select(*keys, F.col("tile").alias("__up"))
    return reduce(DataFrame.unionByName, leaves)


def steady_edges(frames: DataFrame, within: float = 12.0, share: float = 0.75, contrast: float = 40.0) -> DataFrame:
    """frames (session, f, x, y, v) -> (session, x, y, m, stable, edge): what a place shows over time.

    m is its median; it is stable if at least ``share`` of the frames lie ``within`` of that; it is an edge if the
    medians of the places to the left and above differ from its own by more than ``contrast`` in all.
    """
    place = frames.groupBy("session", "x", "y").agg(F.percentile("v", F.lit(0.5)).alias("m"), F.collect_list(F.col("v").cast("double")).alias("vs"))
    near = F.size(F.filter("vs", lambda v: F.abs(v - F.col("m")) < within)) / F.size("vs")
    seen = place.select("session", "x", "y", "m", (near >= share).alias("stable"))
    left, above = Window.partitionBy("session", "y").orderBy("x"), Window.partitionBy("session", "x").orderBy("y")
    step = lambda w: F.abs(F.col("m") - F.coalesce(F.lag("m").over(w), F.col("m")))
    return seen.withColumn("dx", step(left)).withColumn("dy", step(above)).select("session", "x", "y", "m", "stable", (F.col("dx") + F.col("dy") > contrast).alias("edge"))


def integral(rows: DataFrame, value: Column) -> DataFrame:
    """(session, x, y, i): the sum of the value over all places up to and with (x, y), by a running sum along each row and one along each column."""
    across = Window.partitionBy("session", "y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("session", "x").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("session", "x", "y", value.cast("bigint").alias("__v")).withColumn("__r", F.sum("__v").over(across)).select("session", "x", "y", F.sum("__r").over(down).alias("i"))


def box_sums(sums: DataFrame, boxes: list[tuple[int, int]]) -> DataFrame:
    """(session, x, y, w, h, total) of every box of those sizes inside the picture, from its integral image.

    A corner of the image stands at up to four corners of boxes: each place sends its sum there with a sign, and the
    boxes that got all their corners add them up. (x, y) is the upper left place of a box.
    """
    corner = lambda dx, dy, sign, w, h: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), F.lit(w).alias("w"), F.lit(h).alias("h"), (F.col("i") * sign).alias("part"), F.lit(sign).alias("sign"))
    sent = F.array(*[c for w, h in boxes for c in (corner(1 - w, 1 - h, 1, w, h), corner(1, 1 - h, -1, w, h), corner(1 - w, 1, -1, w, h), corner(1, 1, 1, w, h))])
    # the far corner is there for every box; the others may lie outside, where sums are zero
    far = F.max((F.col("sign") == 1) & F.col("last"))
    spread = sums.select("session", F.explode(F.transform(sent, lambda c, k: F.struct(c["x"], c["y"], c["w"], c["h"], c["part"], (k % 4 == 0).alias("last"), c["sign"]))).alias("c")).select("session", "c.*")
    low = sums.groupBy("session").agg(F.min("x").alias("x0"), F.min("y").alias("y0"))
    found = spread.groupBy("session", "x", "y", "w", "h").agg(F.sum("part").alias("total"), far.alias("whole")).filter("whole")
    return found.join(low, "session").filter("x >= x0 AND y >= y0").select("session", "x", "y", "w", "h", "total")


def strongest(boxes: DataFrame, score: str, top: int = 16, overlap: float = 0.2, reach: int = 64) -> DataFrame:
    """Boxes that no better one of their session covers by more than ``overlap`` (intersection over union), the best ``top`` of each.

    Boxes meet in the squares of side ``reach`` that they touch; of equal score the first by place is better.
    """
    cell = lambda at, size: F.sequence(F.floor(F.col(at) / reach), F.floor((F.col(at) + F.col(size) - 1) / reach))
    columns = ["x", "y", "w", "h", score]
    keyed = boxes.withColumn("__cx", F.explode(cell("x", "w"))).withColumn("__cy", F.explode(cell("y", "h")))
    other = keyed.select("session", "__cx", "__cy", *[F.col(c).alias(f"o_{c}") for c in columns])
    a, b = [F.col(c).cast("double") for c in ("x", "y", "w", "h")], [F.col(f"o_{c}").cast("double") for c in ("x", "y", "w", "h")]
    better = F.struct(F.col(f"o_{score}"), -F.col("o_y"), -F.col("o_x"), F.col("o_w"), F.col("o_h")) > F.struct(F.col(score), -F.col("y"), -F.col("x"), F.col("w"), F.col("h"))
    beaten = keyed.join(other, ["session", "__cx", "__cy"]).filter(better & (iou(*a, *b) > overlap)).select("session", *columns).distinct()
    kept = boxes.join(beaten, ["session", *columns], "left_anti")
    best = F.row_number().over(Window.partitionBy("session").orderBy(F.desc(score), "y", "x", "w", "h"))
    return kept.withColumn("rank", best).filter(F.col("rank") <= top)


def steady_boxes(frames: DataFrame, sizes: list[tuple[int, int]], least: float = 0.5, fill: float = 0.15, top: int = 16) -> DataFrame:
    """frames (session, f, x, y, v) -> (session, x, y, w, h, score, rank): boxes that may hold text or a value.

    In at least half (``least``) of such a box's places nothing changes over time, while edges fill at least ``fill`` of
    it; its score is their share, and of boxes that cover each other the best stays.
    """
    places = steady_edges(frames)
    still = box_sums(integral(places, F.col("stable").cast("int")), sizes).withColumnRenamed("total", "still")
    edges = box_sums(integral(places, (F.col("stable") & F.col("edge")).cast("int")), sizes).withColumnRenamed("total", "edges")
    area = F.col("w") * F.col("h")
    both = still.join(edges, ["session", "x", "y", "w", "h"]).filter((F.col("still") >= area * least) & (F.col("edges") >= area * fill))
    return strongest(both.select("session", "x", "y", "w", "h", (F.col("edges") / area).alias("score")), "score", top)


def blob_boxes(blobs: DataFrame, width: int, height: int, least: int = 6, most: float = 0.5) -> DataFrame:
    """blobs (session, f, area, x, y, w, h in pixels) -> those that can be a thing: of ``least`` pixels or more, in a box of under half of the frame."""
    return blobs.filter((F.col("area") >= least) & (F.col("w") * F.col("h") < most * width * height))


def not_empty(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows whose texts, arrays and maps all hold something; blanks hold nothing."""
    kinds = dict(rows.dtypes)

    def holds(c: str) -> Column:
        if kinds[c] == "string":
            return F.trim(F.col(c)) != ""
        return F.size(c) > 0 if kinds[c].startswith(("array", "map")) else F.col(c).isNotNull()

    return rows.filter(reduce(lambda a, b: a & b, [F.coalesce(holds(c), F.lit(False)) for c in columns]))
