"""Numeric and array functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_l1(a: Column, b: Column) -> Column:
    """Half the L1 distance of two histograms."""
    return 0.5 * F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)


def counts_half_l1(a: Column, n: Column, b: Column, m: Column) -> Column:
    """Half the L1 distance of two histograms given as maps of counts and their totals. Counts are compared crosswise as integers, so
    the order of bins leaves no trace."""
    apart = F.map_zip_with(a, b, lambda _, x, y: F.abs(F.coalesce(x, F.lit(0)) * m - F.coalesce(y, F.lit(0)) * n))
    return F.aggregate(F.map_values(apart), F.lit(0).cast("bigint"), lambda s, x: s + x) / (2 * n * m)


def l1(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def decayed(conf: Column | float, rate: float, frames: Column) -> Column:
    """Confidence after so many frames without an observation."""
    return (F.lit(conf) if isinstance(conf, float) else conf) * F.pow(F.lit(rate), frames)


def fold_bits(bits: Column) -> Column:
    """An array of bits, the most significant first, as a number."""
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, b: a * 2 + b)


def smoothed(values: Column, keep: float) -> Column:
    """Exponential smoothing over an ordered array: the last value of s = keep * s + (1 - keep) * x."""
    return F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.get(values, 0), lambda s, x: s * keep + x * (1 - keep))


def importance(signals: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted sum of change signals; weights carry their own sign."""
    return sum((F.coalesce(signals[k], F.lit(0.0)) * w for k, w in sorted(weights.items()) if k in signals), F.lit(0.0))


def frame_to_ms(f: Column, fps: float) -> Column:
    return F.round(f * 1000.0 / fps, 2)


def ms_to_frame(ms: Column, fps: float) -> Column:
    return F.floor(ms * fps / 1000.0)
