"""Pixel rules: planted boxes are found, moving ones not; box sums and suppression against plain loops."""

import random

from pyspark.sql import functions as F

from chronolith.operators import pixels


def picture(f, rng):
    """64 by 40: noise that changes, a steady striped box at (8, 6), another at (40, 24), and a striped box that moves."""
    v = {(x, y): rng.randint(0, 255) for x in range(64) for y in range(40)}
    for x0, y0, w, h in ((8, 6, 12, 5), (40, 24, 12, 5)):
        v |= {(x, y): 230 * (x % 2) for x in range(x0, x0 + w) for y in range(y0, y0 + h)}
    v |= {(x, y): 230 * ((x - f) % 2) for x in range(20 + f, 32 + f) for y in range(14, 19)}
    return [("s", f, x, y, float(c)) for (x, y), c in v.items()]


def test_steady_boxes_are_found_and_moving_ones_are_not(spark):
    rng = random.Random(1)
    rows = [r for f in range(10) for r in picture(f, rng)]
    frames = spark.createDataFrame(rows, "session string, f int, x int, y int, v double")
    found = pixels.steady_boxes(frames, [(12, 5), (8, 4)]).collect()
    best = sorted((r["x"], r["y"], r["w"], r["h"]) for r in found if r["rank"] <= 2)
    assert len(best) == 2 and all(abs(a[0] - b[0]) <= 1 and abs(a[1] - b[1]) <= 1 for a, b in zip(best, [(8, 6), (40, 24)], strict=True))
    assert not [r for r in found if 14 <= r["y"] + r["h"] / 2 < 19 and r["x"] >= 20]


def test_suppression_by_loop(spark):
    rng = random.Random(2)
    boxes = [("s" if i % 2 else "t", rng.randint(0, 90), rng.randint(0, 90), rng.choice((6, 12)), rng.choice((4, 8)), rng.randint(1, 30) / 10) for i in range(150)]
    boxes = list(dict.fromkeys(boxes))

    def iou(a, b):
        w, h = (max(0, min(a[i] + a[i + 2], b[i] + b[i + 2]) - max(a[i], b[i])) for i in (1, 2))
        return w * h / (a[3] * a[4] + b[3] * b[4] - w * h)

    rank = lambda b: (b[5], -b[2], -b[1], b[3], b[4])
    want = {b for b in boxes if not any(o[0] == b[0] and rank(o) > rank(b) and iou(o, b) > 0.2 for o in boxes)}
    df = spark.createDataFrame(boxes, "session string, x int, y int, w int, h int, score double")
    got = {tuple(r[c] for c in ("session", "x", "y", "w", "h", "score")) for r in pixels.strongest(df, "score", 1000, reach=16).collect()}
    assert got == want
    assert pixels.strongest(df, "score", 3).groupBy("session").agg(F.max("rank").alias("n")).filter("n <> 3").count() == 0
