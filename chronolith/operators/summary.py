"""Histograms, ratios, tumbling summaries and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mode_histogram(rows: DataFrame, modes: str = "modes") -> DataFrame:
    """Counts of the letters of all mode strings: map-side sums, then one row a letter."""
    return rows.select(F.explode(F.split(modes, "")).alias("mode")).filter("mode <> ''").groupBy("mode").agg(F.count(F.lit(1)).alias("n"))


def joint_histogram(pixels: DataFrame, *keys: str, levels: int = 4) -> DataFrame:
    """pixels (keys, r, g, b) -> (keys, n, hist): the counts of the joint colour bins, levels ** 3 of them for 0..255, as a map of those
    that occur. Values beyond 255 have bins of their own, and nulls count in n alone. Bins are counted before the shuffle."""
    part = lambda c: F.expr(f"floor({c}) * {levels} div 256")
    binned = pixels.select(*keys, ((part("r") * levels + part("g")) * levels + part("b")).alias("bin"))
    counted = binned.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("k"))
    entry = F.when(F.col("bin").isNotNull(), F.struct("bin", "k"))
    return counted.groupBy(*keys).agg(F.sum("k").alias("n"), F.map_from_entries(F.collect_list(entry)).alias("hist"))


def region_residuals(pixels: DataFrame) -> DataFrame:
    """pixels (session, f, region, pixel, r, g, b) -> (session, f, region, residual): the mean over a region of the summed colour change since the frame before."""
    w = Window.partitionBy("session", "region", "pixel").orderBy("f")
    change = sum((F.abs(F.col(c) - F.lag(c).over(w)) for c in "rgb"), F.lit(0))
    return pixels.withColumn("change", change).filter("change IS NOT NULL").groupBy("session", "f", "region").agg(F.avg("change").alias("residual"))


def skip_ratio(histogram: DataFrame, skipped: tuple[str, ...] = ("C", "P", "V")) -> DataFrame:
    kept = F.sum(F.when(F.col("mode").isin(*skipped), F.col("n")).otherwise(0))
    return histogram.agg(kept.cast("bigint").alias("skipped"), F.sum("n").cast("bigint").alias("total"), F.round(kept / F.sum("n"), 4).alias("ratio"))


def counts_by(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def tumbling(rows: DataFrame, window: Column, value: str, at: str, kind: str, *keys: str) -> DataFrame:
    """Per window: rows, distinct kinds, the last value, kinds in order."""
    return rows.withColumn("window", window).groupBy(*keys, "window").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(kind).alias("kinds"), F.max_by(value, at).alias("last_value"),
        F.array_join(F.array_sort(F.collect_set(kind)), ",").alias("seen"),
    )


def highlights(rows: DataFrame, window: Column, at: str, item: Column, most: int = 20, *keys: str) -> DataFrame:
    """The first ``most`` items of each window, joined in order. The rank filter is pushed below the shuffle by Spark."""
    ranked = rows.withColumn("window", window).withColumn("r", F.row_number().over(Window.partitionBy(*keys, "window").orderBy(at))).filter(F.col("r") <= most)
    ordered = F.array_sort(F.collect_list(F.struct("r", item.alias("x"))))
    return ranked.groupBy(*keys, "window").agg(F.array_join(F.transform(ordered, lambda s: s["x"].cast("string")), ",").alias("items"))


def mean_by(rows: DataFrame, value: str, *keys: str, digits: int = 4) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), digits).alias("mean"))


def missing_fields(rows: DataFrame, required: tuple[str, ...], allowed: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """How many rows lack each required field or hold a value outside the allowed ones: one pass, one row a field."""
    bad = {c: F.col(c).isNull() | (~F.col(c).isin(*allowed[c]) if allowed and c in allowed else F.lit(False)) for c in required}
    sums = rows.agg(*[F.count_if(b).alias(c) for c, b in bad.items()])
    return sums.unpivot([], list(required), "field", "missing")


def evenly_sampled(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """``n`` rows at even distances, floor(i * count / n), and the last row; all rows where there are at most n."""
    w = Window.partitionBy(*keys)
    out = rows.withColumn("__c", F.count(F.lit(1)).over(w)).withColumn("__i", F.row_number().over(w.orderBy("f")) - 1)
    slot = F.floor((F.col("__i") * n + n - 1) / F.col("__c"))
    picked = (F.col("__c") <= n) | (F.col("__i") == F.col("__c") - 1) | ((slot < n) & (F.floor(slot * F.col("__c") / n) == F.col("__i")))
    return out.filter(picked).drop("__c", "__i")


def sampled(rows: DataFrame, key: Column, n: int) -> DataFrame:
    """A reproducible sample of n rows: the least hashes."""
    return rows.orderBy(F.xxhash64(key), key).limit(n)


def one_each_then_fill(rows: DataFrame, kind: str, at: str, n: int) -> DataFrame:
    """One example of every kind, then more in order, up to n."""
    nth = F.row_number().over(Window.partitionBy(kind).orderBy(at))
    return rows.withColumn("__nth", nth).orderBy((F.col("__nth") > 1), at).limit(n).drop("__nth")


def sampled_seconds(runs: DataFrame, fps: int) -> DataFrame:
    """Runs [f_start, f_end] that a sampler of one frame a second sees: those that hold a multiple of fps."""
    return runs.filter(F.floor(F.col("f_end") / fps) * fps >= F.col("f_start"))
