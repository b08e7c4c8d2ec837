"""Stateful rules on streams: any cutting into micro-batches gives the rows of the batch form."""

import json
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from chronolith.operators import machines, track
from chronolith.plans import catalogue
from chronolith.streaming import feeds, stateful
from tests.conftest import DATA


@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def in_batches(spark, tmp_path, build, schema, batches):
    """The rows of a query over a folder, to which a file is added for each batch; the query restarts every time."""
    src = tmp_path / "in"
    src.mkdir()
    for i, rows in enumerate(batches):
        (src / f"{i:03d}.json").write_text("\n".join(json.dumps(r) for r in rows) + "\n")
        query = feeds.to_tables(build(feeds.growing_files(spark, str(src), schema)), str(tmp_path / "out"), str(tmp_path / "cp"))
        assert query.awaitTermination(180) and query.exception() is None
    return spark.read.parquet(str(tmp_path / "out"))


def rounded(rows):
    return Counter(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows)


def cut(rows, sizes):
    out, at = [], 0
    for n in sizes:
        out.append(rows[at : at + n])
        at += n
    return [*out, rows[at:]]


def regions(rows):
    return rows.select("session", "f", F.lit(0).alias("region"), (F.col("v") / 4).alias("residual"), (F.col("path") == "view").alias("explained"), (F.col("path") == "error").alias("is_text"), (F.col("v") > 480).alias("cut"), F.lit(False).alias("flash"), F.lit(False).alias("fresh"))


RULES = {
    "breaks": (lambda r: r.select("session", "f", F.array(F.col("v") / 4, F.col("v") / 4).alias("regions"), F.array((F.col("v") < 250).cast("double"), (F.col("v") >= 250).cast("double")).alias("hist")), machines.Breaks, machines.BREAKS, track.breaks),
    "schedule": (regions, machines.Schedule, machines.SCHEDULE, track.scheduled),
    "tracks": (lambda r: r.select("session", "f", (F.col("f") / 400 + 0.1).alias("x"), F.lit(0.2).alias("y"), F.lit(0.1).alias("w"), (0.1 + F.col("v") / 9000).alias("h")), machines.Track, machines.TRACK, track.tracked),
    "second_reads": (lambda r: r.select("session", "f", *[F.floor(F.col("v") / d).cast("double").alias(c) for c, d in (("v", 125), ("second", 130), ("third", 125))]), machines.Confirm, machines.CONFIRM, None),
}


@pytest.mark.parametrize("name", RULES)
def test_machines_over_micro_batches(spark, tmp_path, name):
    shape, machine, rest, batch = RULES[name]
    table = shape(catalogue.sv(spark, DATA).filter("session < 4"))
    rows = [json.loads(x) for x in table.orderBy("f", "session").toJSON().collect()]
    ends = [{"session": s, "f": None} for s in {r["session"] for r in rows}]
    want = batch(table) if batch else machines.folded(table, ["session"], machine, machines.schema_of(table, ["session"], rest))
    late = [{**rows[0]}]
    got = in_batches(spark, tmp_path, lambda stream: stateful.machine_stream(stream, ["session"], machine, rest), table.schema, [*cut(rows, (1, 50, 3)), late, ends])
    found = got.filter("late = 0").drop("late")
    assert rounded(found.collect()) == rounded(want.select(*found.columns).collect()) and found.count() > 0
    assert [(r["session"], r["late"]) for r in got.filter("late > 0").collect()] == [(rows[0]["session"], 1)]


def feed_rows(seed):
    """Frames of two sessions with observations of the frame before or of their own, neighbours swapped."""
    rng, rows = random.Random(seed), []
    for s in "ab":
        of = []
        for f in range(30):
            of.append((f, {"session": s, "kind": "frame", "f": f}))
            for p in "pq":
                if rng.random() < 0.3:
                    g = max(0, f - rng.randint(0, 1))
                    of.append((f + 0.5, {"session": s, "kind": "seen", "f": g, "path": p, "v": f"{g:02d}{p}"}))
        rows += of
    keyed = sorted(rows, key=lambda x: x[0])
    frames = {}
    for at, r in keyed:  # frames swap with their neighbours
        frames.setdefault(int(at) // 2, []).append(r)
    out = []
    for k in sorted(frames):
        part = frames[k]
        rng.shuffle(part)
        out += part
    return out


@pytest.mark.parametrize("sizes", [(200,), (7, 1, 30, 2)])
def test_a_shuffled_feed_leaves_in_order(spark, tmp_path, sizes):
    rows = feed_rows(3)
    ends = [{"session": s, "kind": "end"} for s in "ab"]
    got = in_batches(spark, tmp_path, stateful.reordered, stateful.FEED, [*cut(rows, sizes), ends])
    want = stateful.as_batch(spark.createDataFrame([tuple(r.get(k) for k in ("session", "kind", "f", "path", "v")) for r in rows], stateful.FEED))
    found = got.filter("kind IN ('frame', 'value')")
    assert rounded(found.collect()) == rounded(want.select(*found.columns).collect()) and got.filter("kind LIKE 'late%'").count() == 0


def test_what_comes_after_release_is_told(spark, tmp_path):
    row = lambda kind, f, path=None, v=None: {"session": "a", "kind": kind, "f": f, "path": path, "v": v}
    batches = [[row("frame", f) for f in range(10)], [row("seen", 2, "p", "old"), row("frame", 1)], [row("frame", f) for f in range(10, 13)], [{"session": "a", "kind": "end"}]]
    got = in_batches(spark, tmp_path, stateful.reordered, stateful.FEED, batches)
    assert sorted((r["kind"], r["f"]) for r in got.filter("kind LIKE 'late%'").collect()) == [("late_frame", 1), ("late_seen", 2)]
    # frames 0 to 6 had left; the old observation holds from the first frame that was still there
    assert {r["f"]: r["v"] for r in got.filter("kind = 'value'").collect()} == dict.fromkeys(range(7, 13), "old")
    assert sorted(r["f"] for r in got.filter("kind = 'frame'").collect()) == list(range(13))


def released(rows, behind=3, most=900):
    out, buffer = [], stateful.Buffer(-1, set(), {}, set(), behind, most)
    for kind, f, *rest in rows:
        out += [*buffer.take(kind, f, *(rest or (None, None))), *buffer.release(False)]
    return [x[:2] for x in out if x[1] != "value"], buffer


def test_open_requests_hold_frames_back_up_to_a_limit():
    frames = [("frame", f) for f in range(12)]
    out, buffer = released([("asked", 5, "p", None), *frames])
    assert [f for f, _ in out] == [0, 1]  # frame 2 is within three of the request
    out = [*buffer.take("seen", 5, "p", "x"), *buffer.release(False)]
    assert [x[0] for x in out if x[1] == "frame"] == [2, 3, 4, 5, 6, 7, 8] and [x[:4] for x in out if x[1] == "value"] == [(f, "value", "p", "x") for f in (5, 6, 7, 8)]
    out, buffer = released([("asked", 0, "p", None), *frames], most=6)
    assert [f for f, _ in out] == list(range(7)) and len(buffer.held) == 5


def test_observations_kept_are_bounded():
    _, buffer = released([x for f in range(400) for x in (("frame", f), ("seen", f, "p", str(f)), ("seen", max(0, f - 1), "q", str(f)))])
    assert len(buffer.held) <= 4 and len(buffer.seen) <= 12


def test_an_idle_session_is_let_go_by_a_timer(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text("\n".join(json.dumps({"session": "a", "kind": "frame", "f": f}) for f in range(5)))
    stream = stateful.reordered(feeds.growing_files(spark, str(src), stateful.FEED), idle=1.0)
    query = stream.writeStream.format("memory").queryName("let_go").trigger(processingTime="500 milliseconds").option("checkpointLocation", str(tmp_path / "cp")).start()
    began = time.monotonic()
    while spark.table("let_go").count() < 5 and time.monotonic() - began < 120:
        assert query.exception() is None
        time.sleep(0.5)
    query.stop()
    assert [r["f"] for r in spark.table("let_go").orderBy("f").collect()] == list(range(5))


def test_a_capture_grid_keeps_time():
    """Steady ticks write one slot each; a stall of over twelve is left out, a smaller one is caught up by eight a tick."""
    grid, at = machines.Grid(60.0, 12, 8), 0
    ticks = [k / 60 for k in range(5)] + [None, 14.5 / 60, 15.2 / 60, 15.3 / 60, 40.5 / 60, 41.5 / 60]
    got = []
    for f, t in enumerate(ticks):
        grid = machines.taken_up(grid.laid_down())  # laid down between any two ticks
        got += grid.push(f, [{"t": t}])
    assert [x[1:] for x in got] == [(0, 1, 0), (1, 1, 0), (2, 1, 0), (3, 1, 0), (4, 1, 0), (5, 8, 0), (13, 3, 0), (16, 0, 0), (40, 1, 24), (41, 1, 0)]
    for _, first, n, left_out in got:  # no slot twice, none unaccounted for
        assert first == at + left_out
        at = first + n
    assert grid.end() == [] and machines.Grid(60.0, 12, 8).push(0, [{"t": None}]) == []
