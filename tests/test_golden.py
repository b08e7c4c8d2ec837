"""Goal proofs on the deterministic game: completeness, reconstruction, exact-frame events, a negative control, known answers."""

import pytest
from pyspark.sql import functions as F

from chronolith.functions.signal import decayed
from chronolith.operators import metrics, state, summary, timeline, track
from tests import testgame


@pytest.fixture(scope="module")
def game(spark):
    return testgame.truth(spark).cache()


@pytest.fixture(scope="module")
def rows(game):
    return testgame.leaves(game).cache()


def test_timeline_is_complete(game):
    r = game.agg(F.count(F.lit(1)), F.min("f"), F.max("f"), F.count_distinct("f")).first()
    assert tuple(r) == (4201, 0, 4200, 4201)


def test_reconstruction_equals_dense_replay_at_sampled_frames(game, rows):
    ops = state.encode(rows, 300)
    frames = [r["f"] for r in summary.sampled(game.filter("f % 300 <> 0").select("f"), F.col("f"), 20).collect()]
    want = rows.filter(F.col("f").isin(frames)).select("session", F.col("f").alias("n"), "path", "v")
    got = state.reconstruct_at(ops, frames, nested=False).select("session", "n", F.col("path")[0].alias("path"), "v")
    assert tuple(metrics.difference(want, got).first()) == (0, 0) and got.count() == 20 * 6
    assert state.compression(rows, ops).first()["ratio"] >= 10


def test_every_flash_at_its_exact_frames_and_none_for_a_slow_sampler(game):
    found = track.flashes(testgame.signal(game))
    assert sorted((r["f_start"], r["f_end"]) for r in found.collect()) == [(s, s + n - 1) for s, n in testgame.FLASHES]
    assert summary.sampled_seconds(found, 60).count() == 0


def test_value_changes_at_their_exact_frames(rows):
    changes = state.changed(rows).filter("f > 0")
    health = changes.filter("path = 'health'").orderBy("f").collect()
    assert [(r["f"], r["v"]) for r in health] == [(s, str(93 - 7 * i)) for i, (s, _) in enumerate(testgame.FLASHES)]
    assert [r["f"] for r in changes.filter("path = 'ammo'").orderBy("f").collect()] == testgame.shots()
    truth = rows.filter("f > 0 AND path = 'ammo'").select("f", "v").join(changes.filter("path = 'ammo'").select("f"), "f")
    assert tuple(metrics.exact_matches(truth, changes.filter("path = 'ammo'"), "f", "v").first()) == (len(testgame.shots()),) * 2


def test_known_answers(game, rows):
    of = lambda path: rows.filter(F.col("path") == path)
    assert timeline.first_match(of("enemies"), F.col("v").cast("int") >= 4, "session").first()["f"] == 1500
    fourth = timeline.kth(state.changed(of("ammo")).filter("f > 0"), 4, "session", "path").first()
    assert (fourth["f"], fourth["v"]) == (testgame.shots()[3], "26")
    texts = [r["v"] for r in state.changed(of("objective")).orderBy("f").collect()]
    assert texts == ["Reach the gate", "Defend the core"]
    runs = timeline.runs(game.select("session", "f", F.col("flash")), "flash", "session").filter("flash")
    assert runs.count() == 10 and runs.agg(F.min(F.when(F.col("length") == 1, F.col("f_start")))).first()[0] == 317
    assert timeline.stable_points(of("score"), "v", 5, 2398, 3, "session").first()["f"] > 2400
    scenes = timeline.runs(of("scene"), "v", "session").orderBy("f_start").collect()
    assert [(r["v"], r["f_start"], r["f_end"]) for r in scenes] == [("level1", 0, 2999), ("loading", 3000, 3059), ("level2", 3060, 4199), ("gameover", 4200, 4200)]


def test_confidence_never_rises_without_an_observation(spark, game):
    out = game.filter("f < 300").select("f", decayed(0.9, 0.995, F.col("f")).alias("conf")).orderBy("f").collect()
    assert all(a["conf"] > b["conf"] for a, b in zip(out, out[1:], strict=False))
