"""Structured Streaming forms: windows with late data, topics, change feeds with state, growing files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def growing_files(spark: SparkSession, path: str, schema: str, fmt: str = "json", files_per_trigger: int = 100) -> DataFrame:
    """A folder that a writer appends files to; ``trigger(availableNow=True)`` reads to its present end and stops."""
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_trigger).load(path)


def event_time(rows: DataFrame, at: str, late: str) -> DataFrame:
    """A watermark on a TIMESTAMP column: rows later than it are dropped, state before it is freed."""
    return rows.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)


def tumbling_summary(rows: DataFrame, at: str, size: str, late: str, kind: str, value: str) -> DataFrame:
    """Per window and kind: rows and the sum of values in hundredths, an exact integer whatever the order of addition."""
    cents = F.sum(F.round(F.col(value) * 100).cast("bigint"))
    return event_time(rows, at, late).groupBy(F.window(at, size), kind).agg(F.count(F.lit(1)).alias("n"), cents.alias("cents")).select(F.col("window.start").alias("start"), kind, "n", "cents")


def sessions(rows: DataFrame, at: str, gap: str, late: str, key: str) -> DataFrame:
    return event_time(rows, at, late).groupBy(F.session_window(at, gap), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def topic(events: DataFrame, *types: str) -> DataFrame:
    """One subscription: the events of some types."""
    return events.filter(F.col("type").isin(*types))


def change_feed(rows: DataFrame, session: str = "session", path: str = "path", order: str = "f", value: str = "v") -> DataFrame:
    """Changed values only, by session and path, over micro-batches: the last value is the state.

    Rows of a batch are put in order; a row at or before the last frame emitted is late and dropped.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last_f, last_v = state.get if state.exists else (-1, None)
        out = []
        for f, v in sorted((f, v) for b in batches for f, v in zip(b[order].tolist(), b[value].tolist(), strict=True)):
            if f <= last_f:
                continue
            if last_v is None or v != last_v:
                out.append((*key, f, v))
                last_v = v
            last_f = f
        state.update((last_f, last_v))
        yield pd.DataFrame(out, columns=["session", "path", "f", "v"])

    kinds = dict(rows.dtypes)
    schema = f"session {kinds[session]}, path {kinds[path]}, f bigint, v double"
    return rows.groupBy(session, path).applyInPandasWithState(step, schema, "f bigint, v double", "append", GroupStateTimeout.NoTimeout)


def latest_state(rows: DataFrame, session: str = "session", path: str = "path") -> DataFrame:
    """The working state as an updating aggregate: latest value by session and path."""
    return rows.groupBy(session, path).agg(F.max_by("v", "f").alias("v"), F.max("f").alias("f"))


def guarded_labels(labels: DataFrame, scenes: DataFrame, at: str, within: str) -> DataFrame:
    """Late labels joined to the scene they were asked about; one whose scene has passed finds no partner and is dropped."""
    l, s = event_time(labels, at, within).alias("l"), event_time(scenes, at, within).alias("s")
    near = (F.col(f"l.{at}") >= F.col(f"s.{at}")) & (F.col(f"l.{at}") <= F.col(f"s.{at}") + F.expr(f"interval {within}"))
    return l.join(s, (F.col("l.scene_id") == F.col("s.scene_id")) & near).select("l.*")


def in_time(results: DataFrame, asked: str, done: str, within: str) -> DataFrame:
    """Results of slow models that came within a time of being asked for; late ones are dropped and counted in the query's
    progress as ``late``."""
    age = F.col(done).cast("timestamp") - F.col(asked).cast("timestamp")
    on_time = F.coalesce(age <= F.expr(f"interval {within}"), F.lit(False))
    return results.withColumn("__kept", on_time).observe("results", F.count_if(~F.col("__kept")).alias("late"), F.count(F.lit(1)).alias("all")).filter("__kept").drop("__kept")


def polled(spark: SparkSession, path: str, schema: str, fmt: str = "json", every: str = "2 seconds"):
    """A growing folder read again every so often: (stream, the trigger to write it with)."""
    return growing_files(spark, path, schema, fmt), {"processingTime": every}


def to_tables(stream: DataFrame, path: str, checkpoint: str, at_once: bool = True):
    """Append a feed to Parquet, exactly once by its checkpoint."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if at_once else writer).start()


def fan_out(stream: DataFrame, topics: dict[str, Column], base: str, checkpoint: str):
    """Each micro-batch written once to every topic whose predicate it meets."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        for name, where in topics.items():
            batch.filter(where).write.mode("overwrite").parquet(f"{base}/{name}/epoch={epoch}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
