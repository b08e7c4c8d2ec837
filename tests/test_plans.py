"""Plans are what they are meant to be: pruned, pushed down, without Python."""

import re

import pytest
from pyspark.sql import functions as F

from chronolith.operators import state
from chronolith.plans import catalogue
from tests.conftest import DATA


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def rows_scanned(df) -> int:
    """Rows that the file scans of a plan gave out when it ran."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    found = [leaves.apply(i) for i in range(leaves.size())]
    return sum(x.metrics().apply("numOutputRows").value() for x in found if "FileScan" in x.toString() or "Scan parquet" in x.toString())


def test_a_read_of_a_late_frame_reads_one_snapshot(spark, tmp_path):
    """6,000 frames of 20 paths with a snapshot every 300: at frame 5,900 only the pages of its snapshot are read."""
    from chronolith.sources import session as files

    rows = spark.range(6000 * 20).select(F.lit("s").alias("session"), (F.col("id") / 20).cast("bigint").alias("f"), F.concat(F.lit("p"), F.col("id") % 20).alias("path"), F.col("id").alias("v"))
    ops = state.encode(rows, 300)
    files.write_tables(ops, str(tmp_path / "ops"))
    frames = spark.range(6000).select(F.lit("s").alias("session"), F.col("id").alias("f"), F.when(F.col("id") % 300 == 0, "snapshot").otherwise("delta").alias("kind"))
    files.write_tables(state.snapshots(frames), str(tmp_path / "snapshots"), ("snap_f",))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        stored, directory = spark.read.parquet(str(tmp_path / "ops")), spark.read.parquet(str(tmp_path / "snapshots"))
        got = state.reconstruct(stored, 5900, nested=False, directory=directory)
        scanned = rows_scanned(got)
        assert {(r["path"][0], r["v"]) for r in got.collect()} == {(f"p{i}", 5900 * 20 + i) for i in range(20)}
        assert scanned < 300 * 20 + 3 * files.PAGE_ROWS + 20, scanned
        assert rows_scanned(state.reconstruct(stored, 5900, nested=False)) > 100_000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_scans_read_only_what_they_need(spark):
    assert re.findall(r"ReadSchema: struct<(.*?)>", plan(catalogue.QUERIES["event_counts"](spark, DATA))) == ["event_type:string"]
    assert "GreaterThan(o_totalprice" in plan(catalogue.QUERIES["semi_anti_join"](spark, DATA))


def test_top_k_does_not_sort_everything(spark):
    assert "TakeOrderedAndProject" in plan(catalogue.QUERIES["search_union"](spark, DATA))
    assert "WindowGroupLimit" in plan(catalogue.QUERIES["topk_orders"](spark, DATA))


def test_one_shuffle_for_windows_by_session(spark):
    for name in ("asof_last_purchase", "transient_spikes", "confidence_decay", "interpolated_value"):
        assert plan(catalogue.QUERIES[name](spark, DATA)).count("Exchange") == 1, name


#: Rules whose next step depends on what they emitted before: kernels, which recursive SQL can check.
KERNELS = {"dead_band", "spaced_samples", "emitted_boxes", "budgeted_grants", "capped_grants"}


@pytest.mark.parametrize("name", sorted(set(catalogue.ORACLE_SQL) - KERNELS))
def test_no_python_in_relational_queries(spark, name):
    p = plan(catalogue.QUERIES[name](spark, DATA))
    assert not re.search("Python|Pandas|Arrow", p) and "CartesianProduct" not in p
