"""Reading and writing sessions: JSON lines of snapshots and merge patches, events, summary and meta documents."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EVENT_SCHEMA = (
    "id string, type string, f_start bigint, f_end bigint, t_ms double, entity string, `from` variant, `to` variant, "
    "duration_frames int, color array<int>, region int, confidence double, source string, "
    "evidence struct<f:bigint,bbox:array<double>,crop:string>"
)
#: Rows of a Parquet page: pages are what a read by snapshot skips.
PAGE_ROWS = 1000
STREAM_SCHEMA = "session string, f bigint, t_ms double, kind string, snap_f bigint, modes string, vlm boolean, json string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, parsed, path) of non-blank lines; parsed is null where the JSON is malformed. A missing file has no lines."""
    try:
        raw = spark.read.text(path)
    except AnalysisException:
        raw = spark.createDataFrame([], "value string")
    return raw.filter(F.trim("value") != "").select(F.col("value").alias("line"), F.try_parse_json("value").alias("parsed"))


def read_jsonl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The good lines as VARIANT (column ``parsed``) and one row with the number of malformed ones."""
    lines = _lines(spark, path)
    return lines.filter("parsed IS NOT NULL").select("parsed"), lines.agg(F.count_if(F.col("parsed").isNull()).alias("malformed"))


def _get(name: str, kind: str) -> Column:
    return F.try_variant_get("parsed", f"$.{name}", kind)


def read_stream(spark: SparkSession, path: str, session: str) -> DataFrame:
    """Frames of one session, the last of repeated ones, with the snapshot that each builds on."""
    rows = read_jsonl(spark, path)[0].withColumn("at", F.monotonically_increasing_id())
    picked = rows.select(
        _get("f", "bigint").alias("f"), "at", _get("t_ms", "double").alias("t_ms"), _get("kind", "string").alias("kind"), _get("modes", "string").alias("modes"),
        _get("vlm", "boolean").alias("vlm"), F.to_json(F.coalesce(_get("state", "variant"), _get("delta", "variant"))).alias("json"),
    )
    one = picked.groupBy("f").agg(F.max_by(F.struct("t_ms", "kind", "modes", "vlm", "json"), "at").alias("r")).select(F.lit(session).alias("session"), "f", "r.*")
    w = Window.partitionBy("session").orderBy("f")
    snap = F.coalesce(F.last(F.when(F.col("kind") == "snapshot", F.col("f")), True).over(w), F.first("f").over(w))
    return one.withColumn("snap_f", snap).select("session", "f", "t_ms", "kind", "snap_f", "modes", "vlm", "json")


def read_events(spark: SparkSession, path: str, session: str) -> DataFrame:
    lines = _lines(spark, path).filter("parsed IS NOT NULL")
    return lines.select(F.from_json("line", EVENT_SCHEMA).alias("e"), "line").select(F.lit(session).alias("session"), "e.*", "line")


def _at(spark: SparkSession, path: str):
    """(Hadoop path, its file system)."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _at(spark, path)
    return fs.exists(at)


def stamp(spark: SparkSession, folder: str, names: tuple[str, ...]) -> tuple:
    """(name, time, size) of those files and tables that are there: what a cache of them depends on."""
    found = []
    for name in names:
        at, fs = _at(spark, f"{folder}/{name}")
        if fs.exists(at):
            found.append((name, fs.getFileStatus(at).getModificationTime(), fs.getContentSummary(at).getLength()))
    return tuple(found)


def write_document(spark: SparkSession, body: dict, path: str) -> None:
    """A document of one session as a JSON file, replacing what is there."""
    at, fs = _at(spark, path)
    out = fs.create(at, True)
    out.write(bytearray(json.dumps(body, indent=1).encode()))
    out.close()


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document spread over lines; no row where it is missing or malformed."""
    try:
        return spark.read.schema(schema + ", _corrupt_record string").option("multiLine", True).json(path).filter("_corrupt_record IS NULL").drop("_corrupt_record")
    except AnalysisException:
        return spark.createDataFrame([], schema)


def write_stream(frames: DataFrame, path: str) -> None:
    """One JSON line a frame, in order of frame within the session's partition."""
    body = F.concat(
        F.lit('{"f":'), F.col("f").cast("string"), F.lit(',"t_ms":'), F.coalesce(F.col("t_ms").cast("string"), F.lit("null")), F.lit(',"kind":"'), F.col("kind"),
        F.lit('","modes":"'), F.coalesce("modes", F.lit("")), F.lit('","'), F.when(F.col("kind") == "snapshot", "state").otherwise("delta"), F.lit('":'), F.coalesce("json", F.lit("{}")),
        F.lit(',"vlm":'), F.coalesce(F.col("vlm").cast("string"), F.lit("false")), F.lit("}"),
    )
    frames.repartition("session").sortWithinPartitions("session", "f").select("session", body.alias("value")).write.mode("overwrite").partitionBy("session").text(path)


def write_tables(rows: DataFrame, path: str, order: list[str] | tuple[str, ...] = ("snap_f", "f")) -> None:
    """Rows as Parquet by session, sorted (operations by snapshot), so a state read prunes to the pages of one snapshot."""
    sorted_ = rows.repartition("session").sortWithinPartitions("session", *order)
    sorted_.write.mode("overwrite").option("parquet.page.row.count.limit", PAGE_ROWS).partitionBy("session").parquet(path)


def write_events(events: DataFrame, path: str) -> None:
    events.orderBy("session", "f_start", "id").write.mode("overwrite").json(path)
