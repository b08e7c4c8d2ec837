import random

import numpy as np
from pyspark.sql import functions as F

from chronolith.functions import geometry, signal, text
from chronolith.operators import metrics, summary, timeline, track


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_text(spark):
    L = F.lit
    assert one(spark, text.hud_key(L("HEALTH: 87")), text.hud_value(L("HEALTH: 87"))) == ("health", 87)
    assert one(spark, text.hud_key(L("HP 9")), text.hud_value(L("HP 9"))) == ("health", 9)
    assert one(spark, text.hud_value(L("AMMO o")), text.hud_value(L("SCORE |-120")), text.hud_value(L("nothing 5"))) == (0, -120, None)
    assert one(spark, text.currency(L("$1,250")), text.currency(L("+$25")), text.plain_number(L("95")), text.plain_number(L("a95"))) == (1250, None, 95, None)
    assert one(spark, text.score(L("the Other THE"), ["the", "the"]), text.token_estimate(L("x" * 7))) == (6, 3)
    assert one(spark, text.source_tag(L("propagated"), L(0.731)), text.source_tag(L("odd"), F.lit(None).cast("double"))) == ("PROP 0.73", "odd")
    assert one(spark, text.slug(L("Hello, Big World!")), text.strip_markdown(L("a [b](c) `d`"))) == ("hello-big-world", "a b d")
    assert one(spark, text.number(L("7")), text.number(L("x")), text.graded_number(L("about 42 frames"), L(40), 2)) == (1.0, 0.5, True)
    assert one(spark, text.reply_json(L('sure: {"scene": "cave"} ok'), "scene string")["scene"]) == ("cave",)
    assert one(spark, text.contains_all(L("Reach the Gate"), ["gate", "reach"])) == (True,)


def test_geometry_and_signal(spark):
    L = F.lit
    assert one(spark, geometry.iou(*[L(x) for x in (0.0, 0.0, 0.5, 0.5, 0.25, 0.0, 0.5, 0.5)]))[0] == 1 / 3
    assert one(spark, geometry.cells(L(0.0), L(0.0), L(0.13), L(0.1)))[0] == [0, 1]
    r = one(spark, *[geometry.region_box(L(x), 640, 480) for x in ("all", "9", "r1c1", "0.5,0.5,0.1,0.1", "10,20,30,40")])
    assert [tuple(x) for x in r] == [(0, 0, 640, 480), (80, 80, 80, 80), (80, 80, 80, 80), (320, 240, 64, 48), (10, 20, 30, 40)]
    assert one(spark, signal.fold_bits(F.array(L(1), L(0), L(1))), signal.half_l1(F.array(L(1.0), L(0.0)), F.array(L(0.0), L(1.0))), geometry.morton(L(3), L(0))) == (5, 1.0, 5)
    assert abs(one(spark, signal.smoothed(F.array(L(1.0), L(2.0), L(4.0)), 0.5))[0] - 2.75) < 1e-12


def test_pixel_boxes_are_clamped(spark):
    boxes = [one(spark, geometry.pixel_box(*[F.lit(v) for v in b], 640, 480))[0] for b in ((0.0, 0.0, 1.0, 1.0), (0.5, 0.5, 0.25, 0.25), (0.9, 0.9, 0.5, 0.5), (-0.1, 0.0, 0.05, 0.5))]
    assert [tuple(b) for b in boxes] == [(0, 0, 640, 480), (320, 240, 480, 360), (576, 432, 640, 480), (0, 0, 1, 240)]


def test_grading_and_rules_of_headings(spark):
    L = F.lit
    assert one(spark, text.graded_choice(L("after, I think"), ["before", "after"], L("after")), text.graded_choice(L(None).cast("string"), ["a"], L("a"))) == (True, False)
    assert one(spark, text.contains_all(L("From 'Reach the gate!' to Defend-the-core"), ["Reach the gate", "defend the core"])) == (True,)
    assert one(spark, text.plain_number(L("$95")), text.plain_number(L("+95")), text.plain_number(L(" <95> ")), text.currency(L("$ 35"))) == (None, None, 95, 35)
    assert one(spark, text.hud_value(L("ammo: 4 hp: 9")), text.hud_value(L("score 3 ammo 7")), text.hud_value(L("SCORE: -5"))) == (9, 7, -5)


def rows(spark, values, schema="session string, path string, f bigint, v double"):
    return spark.createDataFrame([("s", "p", i, float(v)) for i, v in enumerate(values)], schema)


def test_transients_of_one_and_two_frames(spark):
    from chronolith.operators import events

    got = events.transients(rows(spark, [0, 0, 90, 0, 0, 90, 90, 0, 0, 90, 90, 90, 0]), 50, 10, "session").orderBy("f").collect()
    # of three frames none is a transient; the last frames of a run of two or three return to a level that is not theirs
    assert [(r["f"], r["length"]) for r in got if r["ref"] == 0.0] == [(2, 1), (5, 2)]


def test_votes_are_dated_to_the_first_winning_read(spark):
    got = track.voted_changes(rows(spark, [60, 60, 60, 60, 35, 85, 85, 85, 85]), 20.0).orderBy("f0").collect()
    assert [(r["f0"], r["v"]) for r in got] == [(0, 60.0), (5, 85.0)]


def test_greedy_matching_is_one_to_one(spark):
    box = lambda i, x: (0, i, x, 0.0, 0.4, 0.4)
    schema = "f bigint, id bigint, x double, y double, w double, h double"
    t, e = spark.createDataFrame([box(1, 0.0), box(2, 0.1)], schema), spark.createDataFrame([box(9, 0.05)], schema)
    assert metrics.greedy_matches(metrics.candidate_pairs(t, e)).count() == 1


def test_dead_band_and_spacing_follow_the_last_emitted(spark):
    assert [r["f"] for r in track.dead_band(rows(spark, [0, 0.4, 0.8, 1.2, 1.6]), 1.0).collect()] == [0, 3]
    assert [r["f"] for r in track.spaced(rows(spark, range(8)), 3).collect()] == [0, 3, 6]


def test_tracker_confirms_moves_and_removes(spark):
    found = [("s", f, 0.1 + 0.01 * f, 0.5, 0.05, 0.05) for f in range(20)] + [("s", f, 0.9, 0.9, 0.01, 0.01) for f in (60, 300)]
    got = track.tracked(spark.createDataFrame(found, "session string, f bigint, x double, y double, w double, h double"), 60.0).collect()
    assert {r["track"] for r in got} == {1} and {r["state"] for r in got} == {"seen", "hidden", "removed"}


def test_blobs():
    m = np.zeros((10, 10), bool)
    m[1:4, 1:4] = True
    m[4, 4] = True  # touches by a corner
    m[8, 8] = True  # too small
    assert track.blobs(m) == [(10, 1, 1, 4, 4)]


def test_even_sampling_gives_thirteen(spark):
    for n, want in ((5, 5), (12, 12), (13, 13), (100, 13)):
        assert summary.evenly_sampled(rows(spark, range(n)), 12, "session").count() == want


def test_visible_intervals(spark):
    tl = lambda xs: spark.createDataFrame([("s", "e", f, v) for f, v in xs], "session string, path string, f bigint, v boolean")
    got = timeline.visible_intervals(tl([(0, True), (50, False), (60, True)]), tl([(10, False), (20, True)]), 100).orderBy("f_start").collect()
    assert [(r["f_start"], r["f_end"]) for r in got] == [(0, 9), (20, 49), (60, 99)]


def test_monotone_repair_and_budget(spark):
    counter = lambda xs: [r["v"] for r in track.monotone_repaired(spark.createDataFrame([("s", i, v) for i, v in enumerate(xs)], "session string, f bigint, v bigint")).orderBy("f").collect()]
    assert counter([1, 2, 90, 4, 5]) == [1, 2, 2, 4, 5] and counter([1, 2, 90, 40, 41]) == [1, 2, 90, 40, 41] and counter([5, 3, 3, 6]) == [5, 3, 3, 6]
    want = spark.createDataFrame([("s", f, True) for f in range(100)], "session string, f bigint, wanted boolean")
    assert track.budgeted(want, 0.03, 8).filter("granted").count() == 11


def test_synthetic_frames_and_logs(spark, tmp_path):
    from chronolith.sources import frames as rules
    from chronolith.sources import logs
    from tests import synthetic_frames as frames

    frames.register(spark)
    df = spark.read.format("synthetic_frames").option("frames", 400).load()
    assert df.count() == 400
    assert rules.background(df, 25, 7).filter("background > 2").count() == 0
    (tmp_path / "app.log").write_text("2024-05-01T10:00:00Z start a=1 b=two words\nSTAGE store bytes=42 f=3\n")
    r = logs.read_log(spark, str(tmp_path / "app.log")).first()
    assert r["event"] == "start" and r["fields"] == {"a": "1", "b": "two"}
    assert logs.read_stages(spark, str(tmp_path / "app.log")).first()["fields"]["bytes"] == "42"


def test_random_runs_agree_with_a_loop(spark):
    rnd = random.Random(1)
    v = [rnd.randint(0, 2) for _ in range(60)]
    want, a = [], 0
    for i in range(1, 61):
        if i == 60 or v[i] != v[a]:
            want.append((a, i - 1, float(v[a])))
            a = i
    got = timeline.runs(rows(spark, v), "v", "session").orderBy("f_start").collect()
    assert [(r["f_start"], r["f_end"], r["v"]) for r in got] == want
