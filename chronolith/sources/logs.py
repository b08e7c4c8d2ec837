"""Application logs of ``<ISO time> <event> k=v k=v`` lines and ``STAGE name k=v`` lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.functions.text import key_values


def parse(line: Column) -> Column:
    rest = F.regexp_extract(line, r"^\S+\s+\S+\s*(.*)$", 1)
    return F.struct(F.regexp_extract(line, r"^(\S+)", 1).alias("first"), F.regexp_extract(line, r"^\S+\s+(\S+)", 1).alias("event"), key_values(rest).alias("fields"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path).select(parse(F.col("value")).alias("p"))
    return rows.select(F.to_timestamp("p.first").alias("ts"), "p.event", "p.fields").filter("ts IS NOT NULL")


def read_stages(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path).filter(F.col("value").startswith("STAGE ")).select(parse(F.col("value")).alias("p"))
    return rows.select(F.col("p.event").alias("stage"), "p.fields")


def format_line(ts: Column, event: Column, fields: Column) -> Column:
    """A log line with keys in order."""
    pairs = F.transform(F.array_sort(F.map_entries(fields)), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return F.concat_ws(" ", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"), event, F.array_join(pairs, " "))
