"""Boxes and the region grid, as Column expressions over [x, y, w, h] in 0..1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronolith.config import DEFAULT


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def iou(ax: Column, ay: Column, aw: Column, ah: Column, bx: Column, by: Column, bw: Column, bh: Column) -> Column:
    inter = overlap(ax, ax + aw, bx, bx + bw) * overlap(ay, ay + ah, by, by + bh)
    union = aw * ah + bw * bh - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def cells(x: Column, y: Column, w: Column, h: Column, cols: int = DEFAULT.grid_cols, rows: int = DEFAULT.grid_rows) -> Column:
    """Grid indexes that a box covers, row-major, bounds clamped and inclusive."""
    clamp = lambda v, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(v * n).cast("int")))
    across = F.sequence(clamp(x, cols), clamp(x + w, cols))
    down = F.sequence(clamp(y, rows), clamp(y + h, rows))
    return F.flatten(F.transform(down, lambda r: F.transform(across, lambda c: r * cols + c)))


def region_box(region: Column, width: int, height: int, cols: int = DEFAULT.grid_cols, rows: int = DEFAULT.grid_rows) -> Column:
    """``all`` | ``x,y,w,h`` (of 0..1 or pixels) | grid index | ``r<row>c<col>`` as pixels (x, y, w, h)."""
    box = lambda x, y, w, h: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), w.cast("int").alias("w"), h.cast("int").alias("h"))
    rc = F.regexp_extract(region, r"^r(\d+)c(\d+)$", 1) != ""
    index = region.rlike(r"^\d+$")
    row = F.when(rc, F.regexp_extract(region, r"^r(\d+)c", 1).try_cast("int")).otherwise(F.floor(region.try_cast("int") / cols))
    col = F.when(rc, F.regexp_extract(region, r"c(\d+)$", 1).try_cast("int")).otherwise(region.try_cast("int") % cols)
    part = F.transform(F.split(region, ","), lambda v: v.try_cast("double"))
    p = [F.get(part, i) for i in range(4)]
    unit = F.array_max(part) <= 1.0
    return (
        F.when(region.isNull() | region.isin("", "all"), box(F.lit(0), F.lit(0), F.lit(width), F.lit(height)))
        .when(rc | index, box(F.floor(col * width / cols), F.floor(row * height / rows), F.lit(width // cols), F.lit(height // rows)))
        .when(unit, box(p[0] * width, p[1] * height, F.greatest(F.lit(1), (p[2] * width).cast("int")), F.greatest(F.lit(1), (p[3] * height).cast("int"))))
        .otherwise(box(*p))
    )


def pixel_box(x: Column, y: Column, w: Column, h: Column, width: int, height: int) -> Column:
    """A box of 0..1 as clamped pixel bounds, at least one pixel wide and high."""
    x0 = F.greatest(F.lit(0), F.least(F.lit(width - 1), (x * width).cast("int")))
    y0 = F.greatest(F.lit(0), F.least(F.lit(height - 1), (y * height).cast("int")))
    x1 = F.greatest(x0 + 1, F.least(F.lit(width), ((x + w) * width).cast("int")))
    y1 = F.greatest(y0 + 1, F.least(F.lit(height), ((y + h) * height).cast("int")))
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def morton(x: Column, y: Column, bits: int = 8) -> Column:
    """Z-order code of a quadtree tile."""
    code = F.lit(0).cast("bigint")
    for i in range(bits):
        code = code.bitwiseOR(F.shiftleft(F.shiftright(x.cast("bigint"), i).bitwiseAND(F.lit(1)), 2 * i))
        code = code.bitwiseOR(F.shiftleft(F.shiftright(y.cast("bigint"), i).bitwiseAND(F.lit(1)), 2 * i + 1))
    return code
