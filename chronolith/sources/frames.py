"""Frames as rows. Decoding is a provider's work; these are the rules around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def background(frames: DataFrame, n: int, step: int) -> DataFrame:
    """Median of every region over about n sampled frames; a session with fewer than three of these has none."""
    picked = frames.filter((F.col("f") % step == 0) & (F.col("f") < n * step))
    spread = picked.select("session", F.posexplode("regions").alias("region", "v")).groupBy("session", "region").agg(F.median("v").alias("background"), F.count(F.lit(1)).alias("n"))
    return spread.filter("n >= 3").drop("n")


def crop_path(f: Column, name: Column) -> Column:
    return F.concat(F.lit("evidence/f"), f.cast("string"), F.lit("_"), name, F.lit(".jpg"))


def evidence_exists(wanted: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """wanted (crop) with ``exists``: the folder is listed by Spark, contents are not read."""
    there = spark.read.format("binaryFile").load(folder).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.lit(True).alias("exists"))
    return wanted.withColumn("name", F.regexp_extract("crop", r"([^/]+)$", 1)).join(there, "name", "left").withColumn("exists", F.coalesce("exists", F.lit(False))).drop("name")


def evidence_wanted(wanted: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """The crops that are yet to be cut, each once: those that exist are skipped."""
    return evidence_exists(wanted.dropDuplicates(["crop"]), spark, folder).filter("NOT exists").drop("exists")
