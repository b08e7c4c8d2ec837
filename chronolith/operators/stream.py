"""The stream view: any keyed and ordered table as rows (session, f, path, v)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stream_view(df: DataFrame, session: Column, order: list[Column], path: Column, value: Column, *extra: Column) -> DataFrame:
    """f is a row's place in its session, from 0. One shuffle by session; every later window by session reuses it."""
    numbered = df.select(session.alias("session"), path.alias("path"), value.alias("v"), *extra, F.struct(*order).alias("__order"))
    return numbered.withColumn("f", (F.row_number().over(Window.partitionBy("session").orderBy("__order")) - 1).cast("bigint")).drop("__order")


def last_wins(rows: DataFrame, order: Column) -> DataFrame:
    """Of rows that repeat (session, f) the last by ``order``."""
    value = F.struct(*[F.col(c) for c in rows.columns if c not in ("session", "f")])
    return rows.groupBy("session", "f").agg(F.max_by(value, order).alias("r")).select("session", "f", "r.*")


def clamp_frame(rows: DataFrame, n: int) -> DataFrame:
    """(session, f): the frame that stands for n: n within the session's bounds, else the nearest bound; a missing frame means the greatest before it."""
    return rows.groupBy("session").agg(F.coalesce(F.max(F.when(F.col("f") <= n, F.col("f"))), F.min("f")).alias("f"))
