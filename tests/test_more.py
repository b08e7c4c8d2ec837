import json
import threading
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from chronolith.functions import tables
from chronolith.operators import boxes, track
from tests.test_session import folder  # noqa: F401


def test_flash_kernel(spark):
    level = [10, 10, 60, 10, 10, 60, 60, 10, 10, 60, 60, 60, 60, 60]
    df = spark.createDataFrame([("s", i, [float(v)] * 4) for i, v in enumerate(level)], "session string, f bigint, regions array<double>")
    assert sorted((r["f_start"], r["f_end"]) for r in track.flashes(df).collect()) == [(2, 2), (5, 6)]  # the last rise holds: no flash


def test_flashes_of_the_synthetic_source_and_the_sampling_control(spark):
    from chronolith.operators import summary
    from tests import synthetic_frames as frames

    frames.register(spark)
    found = track.flashes(spark.read.format("synthetic_frames").option("frames", 1000).load())
    assert sorted(r["f_start"] for r in found.collect()) == list(range(97, 1000, 97))
    assert summary.sampled_seconds(found, 60).count() == 0  # one frame a second sees none of them


def test_sample_points():
    assert track.sample_points(3.0, [0.2, 1.5, 1.7, 2.9]) == [(0.0, "interval"), (1.0, "interval"), (1.5, "scene_change"), (2.0, "interval"), (2.9, "scene_change")]
    assert track.sample_points(0.0, []) == []
    assert track.sample_points(2.2, [0.1, 1.12, 1.13]) == [(0.0, "scene_change"), (1.0, "scene_change"), (2.0, "interval")]


def test_reidentification(spark):
    s = "session string, id bigint, color array<double>, area double, x double, y double"
    lost = spark.createDataFrame([("s", 1, [10.0, 10.0], 1.0, 0.1, 0.1), ("s", 2, [200.0, 0.0], 1.0, 0.1, 0.1)], s)
    seen = spark.createDataFrame([("s", 7, [12.0, 9.0], 1.2, 0.2, 0.1), ("s", 8, [12.0, 9.0], 9.0, 0.2, 0.1)], s)
    assert [tuple(r) for r in track.reidentified(lost, seen).collect()] == [("s", 7, 1)]


def test_boxes_between_records(spark):
    rec = spark.createDataFrame([("s", 0.0, "a", 0.0, 0.0, 0.1, 0.1), ("s", 0.0, "b", 0.5, 0.5, 0.1, 0.1), ("s", 10.0, "a", 1.0, 0.0, 0.1, 0.1)], "session string, t double, id string, x double, y double, w double, h double")
    at = spark.createDataFrame([("s", t) for t in (-1.0, 2.5, 10.0, 99.0)], "session string, t double")
    got = {(r["t"], r["id"]): r["x"] for r in boxes.interpolated_boxes(rec, at).collect()}
    assert got == {(-1.0, "a"): 0.0, (-1.0, "b"): 0.5, (2.5, "a"): 0.25, (2.5, "b"): 0.5, (10.0, "a"): 1.0, (99.0, "a"): 1.0}


def test_box_lists_points_and_grid(spark):
    rows = spark.createDataFrame([("s", 0, "b", [0.0] * 4, None, "observed"), ("s", 0, "a", [0.0] * 4, False, "observed"), ("s", 0, "c", [0.0], True, "observed")], "session string, f bigint, id string, box array<double>, visible boolean, source string")
    assert [(b["id"], b["source"]) for b in boxes.box_list(rows).first()["boxes"]] == [("a", "inferred"), ("b", "observed")]
    pts = spark.createDataFrame([("s", 0.15, 0.15), ("s", 0.9, 0.9)], "session string, px double, py double")
    known = spark.createDataFrame([("s", 0.1, 0.1, 0.3, 0.3)], "session string, x double, y double, w double, h double")
    assert [r["px"] for r in boxes.outside_known(pts, known).collect()] == [0.9]
    filled = boxes.grid_filled(spark.createDataFrame([("s", 0, "x"), ("s", 3, "y")], "session string, f bigint, m string"), F.col("m")).orderBy("f").collect()
    assert [(r["v"], r["filled"]) for r in filled] == [("x", False), ("x", True), ("x", True), ("y", False)]
    recs = spark.createDataFrame([("s", 2.0, 1, 0, "old"), ("s", 2.0, 1, 5, "new"), ("s", 1.0, 0, 9, "first")], "session string, t double, frame int, seq int, scene string")
    assert [r["scene"] for r in boxes.merged_records(recs).collect()] == ["first", "new"]


def test_word_lines_and_agreement(spark):
    w = spark.createDataFrame([(0, 0.0, 0.0, 3.0, 1.0, "HEALTH"), (0, 4.0, 0.1, 1.0, 1.0, "87"), (0, 0.0, 5.0, 2.0, 1.0, "AMMO"), (0, 50.0, 0.0, 2.0, 1.0, "far")], "page int, x double, y double, w double, h double, text string")
    assert sorted(r["text"] for r in boxes.word_lines(w).collect()) == ["AMMO", "HEALTH 87", "far"]
    reads = spark.createDataFrame([("k", "87"), ("k", "87"), ("k", "81"), ("j", "a"), ("j", None)], "key string, text string")
    assert [tuple(r)[:2] for r in boxes.agreed(reads).collect()] == [("k", "87")]


def test_table_functions(spark):
    tables.register(spark)
    assert [r[0] for r in spark.sql("SELECT * FROM frame_references('frames 10-20', 60, 4580)").collect()] == [10, 20]
    assert spark.sql("SELECT * FROM query_intents('how much ammo') WHERE wanted").count() == 1
    assert spark.sql("SELECT * FROM sample_points(2.0, array(0.5))").count() == 3


def test_http_facade(spark, folder):  # noqa: F811
    from chronolith import server

    http = server.serve(spark, 0)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{http.server_port}"
    get = lambda path: json.loads(urllib.request.urlopen(base + path).read())
    assert get("/health")["ok"] and get("/")["ops"][-1] == "ask"
    assert get(f"/get_events?session={folder}&start=0&end=9")["count"] == 3
    for path, code in (("/nope?session=x", 404), ("/get_state", 400)):
        with pytest.raises(urllib.error.HTTPError) as e:
            get(path)
        assert e.value.code == code
    body = json.dumps({"session": folder, "question": "health?"}).encode()
    assert "answer" in json.loads(urllib.request.urlopen(urllib.request.Request(base + "/ask", body)).read())
    http.shutdown()
