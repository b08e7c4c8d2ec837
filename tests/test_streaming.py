import json

from pyspark.sql import functions as F

from chronolith.streaming import feeds

SCHEMA = "session string, path string, f bigint, v double, ts timestamp"


def drained(query):
    query.awaitTermination(120)
    assert query.exception() is None


def put(folder, name, rows):
    (folder / name).write_text("\n".join(json.dumps(dict(zip(("session", "path", "f", "v", "ts"), r, strict=True))) for r in rows))


def test_change_feed_over_two_batches_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    put(src, "a.json", [("s", "p", f, v, f"2024-01-01T00:00:{f:02d}Z") for f, v in enumerate([1.0, 1.0, 2.0])])
    run = lambda: drained(feeds.to_tables(feeds.change_feed(feeds.growing_files(spark, str(src), SCHEMA)), str(tmp_path / "out"), str(tmp_path / "cp")))
    run()
    put(src, "b.json", [("s", "p", f, v, f"2024-01-01T00:00:{f:02d}Z") for f, v in ((1, 9.0), (3, 2.0), (4, 3.0))])
    run()
    got = sorted((r["f"], r["v"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(0, 1.0), (2, 2.0), (4, 3.0)]  # frame 1 came late and is dropped


def test_tumbling_summary_equals_batch(spark, tmp_path):
    from chronolith.plans.catalogue import t
    from tests.conftest import DATA

    src = tmp_path / "in"
    e = t(spark, DATA, "events").select(F.col("user_id").cast("string").alias("session"), F.col("event_type").alias("path"), F.col("event_id").alias("f"), F.col("value").alias("v"), F.col("ts").cast("timestamp").alias("ts"))
    e.coalesce(1).write.json(str(src))
    stream = feeds.tumbling_summary(feeds.growing_files(spark, str(src), SCHEMA), "ts", "6 hours", "10 minutes", "path", "v")
    drained(stream.writeStream.format("memory").queryName("tumbled").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start())
    key = lambda rows: sorted((str(r["start"]), r["path"], r["n"], r["cents"]) for r in rows)
    assert key(spark.table("tumbled").collect()) == key(feeds.tumbling_summary(e, "ts", "6 hours", "10 minutes", "path", "v").collect())


def test_topics_fan_out(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    put(src, "a.json", [("s", p, i, 1.0, "2024-01-01T00:00:00Z") for i, p in enumerate(["flash", "text_changed", "flash"])])
    stream = feeds.growing_files(spark, str(src), SCHEMA)
    drained(feeds.fan_out(stream, {"flash": F.col("path") == "flash", "all": F.lit(True)}, str(tmp_path / "topics"), str(tmp_path / "cp")))
    assert spark.read.parquet(str(tmp_path / "topics/flash")).count() == 2 and spark.read.parquet(str(tmp_path / "topics/all")).count() == 3


def test_sessions_and_latest_state(spark):
    rows = spark.createDataFrame([("s", "p", f, float(f), f"2024-01-01 00:{m:02d}:00") for f, m in enumerate((0, 1, 30, 31))], "session string, path string, f bigint, v double, at string").withColumn("ts", F.to_timestamp("at"))
    assert feeds.sessions(rows, "ts", "5 minutes", "1 minute", "session").count() == 2
    assert feeds.latest_state(rows).first()["v"] == 3.0


def test_late_results_are_dropped_and_counted(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    made = [(0, 10), (0, 45), (5, 20), (5, None)]
    (src / "a.json").write_text("\n".join(json.dumps({"asked": f"2024-01-01T00:00:{a:02d}Z", "done": None if b is None else f"2024-01-01T00:00:{b:02d}Z"}) for a, b in made))
    stream, trigger = feeds.polled(spark, str(src), "asked timestamp, done timestamp", every="1 second")
    assert trigger == {"processingTime": "1 second"}
    query = feeds.to_tables(feeds.in_time(stream, "asked", "done", "30 seconds"), str(tmp_path / "out"), str(tmp_path / "cp"))
    drained(query)
    seen = [p["observedMetrics"]["results"] for p in map(lambda p: json.loads(p.json), query.recentProgress) if p.get("observedMetrics")]
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    assert sum(m["late"] for m in seen) == 2 and sum(m["all"] for m in seen) == 4


def test_labels_of_a_scene_that_has_passed_are_dropped(spark, tmp_path):
    for name, rows in (("scenes", [("s1", 0), ("s2", 20)]), ("labels", [("s1", 5), ("s2", 25), ("s1", 50), ("s9", 5)])):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.json").write_text("\n".join(json.dumps({"scene_id": s, "ts": f"2024-01-01T00:00:{t:02d}Z"}) for s, t in rows))
    read = lambda name: feeds.growing_files(spark, str(tmp_path / name), "scene_id string, ts timestamp")
    drained(feeds.to_tables(feeds.guarded_labels(read("labels"), read("scenes"), "ts", "10 seconds"), str(tmp_path / "out"), str(tmp_path / "cp")))
    got = sorted((r["scene_id"], r["ts"].second) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("s1", 5), ("s2", 25)]
