"""Queries that SQL has no form for, against plain loops over the same rows."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolith.config import DEFAULT, Thresholds
from chronolith.operators import metrics, track
from chronolith.plans import catalogue
from tests.conftest import DATA


@pytest.fixture(scope="module")
def stream(spark):
    """(session, path, f, v, event_id), in order of session and frame."""
    return [tuple(r) for r in catalogue.sv(spark, DATA, "event_id").select("session", "path", "f", "v", "event_id").orderBy("session", "f").collect()]


def grouped(rows, *at):
    out = defaultdict(list)
    for r in rows:
        out[tuple(r[i] for i in at)].append(r)
    return out


def result(spark, name, *columns):
    got = catalogue.QUERIES[name](spark, DATA)
    return Counter(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in got.select(*(columns or got.columns)).collect())


def test_every_query_has_an_oracle_or_a_loop():
    here = {n.removeprefix("test_") for n in globals() if n.startswith("test_")}
    assert set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL) <= here


def test_greedy_matching(spark):
    pairs = metrics.candidate_pairs(*catalogue.boxes(spark, DATA)).collect()
    want = Counter()
    for f, rows in grouped([tuple(r) for r in pairs], 0).items():
        free = {("t", r[1]) for r in rows} | {("e", r[2]) for r in rows}
        for _, t, e, iou in sorted(rows, key=lambda r: (-r[3], r[1], r[2])):
            if {("t", t), ("e", e)} <= free:
                free -= {("t", t), ("e", e)}
                want[(*f, t, e, round(iou, 6))] += 1
    assert result(spark, "greedy_matching", "f", "tid", "eid", "iou") == want


def test_voted_changes(spark, stream):
    """A read counts unless implausible or, with no vote open, what is accepted; four of the last seven within 120 frames, six frames apart."""
    want = Counter()
    for (s, p), rows in grouped(stream, 0, 1).items():
        accepted, votes = None, []
        for _, _, f, v, _ in rows:
            v = math.floor(v / 250) * 250.0
            if accepted is not None and ((v != accepted and abs(v - accepted) > max(1000, 10 * abs(accepted))) or (v == accepted and not votes)):
                continue
            votes.append((f, v))
            votes = [x for x in votes[-7:] if f - x[0] <= 120]
            tally = Counter(x[1] for x in votes).most_common(1)[0]
            frames = [x[0] for x in votes if x[1] == tally[0]]
            if tally[1] < 4:
                continue
            if tally[0] == accepted:
                votes = []
            elif frames[-1] - frames[0] >= 6:
                want[s, p, frames[0], tally[0], accepted] += 1
                accepted, votes = tally[0], []
    assert sum(want.values()) > 0 and result(spark, "voted_changes", "session", "path", "f0", "v", "prev") == want


def test_confirmed_reads(spark, stream):
    want = Counter()
    for (s, p), rows in grouped(stream, 0, 1).items():
        old = None
        for _, _, f, v, k in rows:
            first = math.floor(v / 125)
            second = first + 1 if k % 5 == 0 else first if k % 5 > 1 else None
            third = first + k % 2
            if first == old:
                continue
            if old is None or second == first:
                new = first
            elif second is not None and second != old and second == third:
                new = second
            else:
                continue
            want[s, p, f, float(new), None if old is None else float(old)] += 1
            old = new
    assert result(spark, "confirmed_reads", "session", "path", "f", "v", "prev") == want


def test_reads_wanted(spark, stream):
    want = Counter()
    for (s,), rows in grouped(stream, 0).items():
        looked, seen = {}, set()
        for _, p, f, v, _ in rows:
            if p in looked and abs(v / 10 - looked[p]) <= 5.0:
                continue
            looked[p] = v / 10
            if (p, math.floor(v / 50)) not in seen and len(seen) < 12:
                seen.add((p, math.floor(v / 50)))
                want[s, p, f] += 1
    assert result(spark, "reads_wanted", "session", "path", "f") == want


def loop_breaks(levels, hists):
    """Flashes and cuts of one session, a frame at a time."""
    found, ref, last, dark_until = [], levels[0], 0, -1
    href = hists[0]
    far = lambda x: (sum(abs(a - b) > 30 for a, b in zip(x, ref, strict=True)) / len(x), abs(sum(x) - sum(ref)) / len(x))  # noqa: B023, E731
    near = lambda x: far(x)[0] < 0.15 and far(x)[1] < 4  # noqa: B023, E731
    for i in range(1, len(levels)):
        if i <= dark_until:
            continue
        share, shift = far(levels[i])
        if share >= 0.45 or shift >= 12:
            for k in (1, 2):
                if i + k < len(levels) and near(levels[i + k]):
                    dark_until = i + k - 1
                    found.append(("flash", i, dark_until, 0.9 if share >= 0.45 else 0.7))
                    break
            if i <= dark_until:
                continue
            away = lambda h: h is None or 0.5 * sum(abs(a - b) for a, b in zip(h, href, strict=True)) >= 0.3  # noqa: B023, E731
            if i + 2 < len(levels) and all(far(levels[i + k])[0] >= 0.6 for k in range(3)) and i - last > 30 and away(hists[i]) and away(hists[i + 2]):
                found.append(("cut", i, i, 0.8))
                last = i
        ref, href = levels[i], hists[i]
    return found


def test_flash_kernel(spark, stream):
    want = Counter((s, *x[1:]) for (s,), rows in grouped(stream, 0).items() for x in loop_breaks([[r[3] / 4] for r in rows], [None] * len(rows)) if x[0] == "flash")
    assert sum(want.values()) > 0 and result(spark, "flash_kernel", "session", "f_start", "f_end", "conf") == want


def test_scene_cuts(spark, stream):
    hist = lambda v: [float(v < 250), float(v >= 250)]
    want = Counter((s, *x) for (s,), rows in grouped(stream, 0).items() for x in loop_breaks([[r[3] / 4] * 2 for r in rows], [hist(r[3]) for r in rows]))
    assert {k[1] for k in want} == {"flash", "cut"} and result(spark, "scene_cuts", "session", "kind", "f_start", "f_end", "conf") == want


def loop_modes(rows, share=0.03, extra=8):
    """rows {f: {region: (residual, explained, is_text, cut, flash, fresh)}} -> (f, region, mode, conf, warning), by the rules one after the other."""
    conf, warned, out, reads = defaultdict(lambda: 1.0), {}, [], 0
    for n, (f, regions) in enumerate(sorted(rows.items())):
        may, asked, modes = reads < share * len(regions) * (n + 1) + extra, [], {}
        for k, (r, explained, is_text, cut, flash, fresh) in sorted(regions.items()):
            modes[k] = "C"
            if cut:
                modes[k], conf[k] = "F", 1.0
            elif flash:
                modes[k] = "V" if r > 6 else "C"
            elif r < 6:
                conf[k] *= 0.998
                if conf[k] < 0.55:
                    asked.append(k)
            elif is_text:
                modes[k] = "V"
            elif fresh or (r > 45 and not explained):
                asked.append(k)
            elif explained:
                modes[k] = "P"
                conf[k] *= 0.995
                if conf[k] < 0.55:
                    asked.append(k)
            else:
                modes[k], conf[k] = "V", max(conf[k], 0.8)
        warnings = set()
        for k in asked:
            if may:
                modes[k], conf[k] = "R", 0.95
                reads += 1
            else:
                modes[k] = "V"
                conf[k] *= 0.995
                if conf[k] < 0.3 and f - warned.get(k, -(10**9)) > 600:
                    warned[k] = f
                    warnings.add(k)
        out += [(f, k, modes[k], round(conf[k], 6), k in warnings) for k in regions]
    return out


def test_region_scheduler(spark, stream):
    want = Counter()
    for (s,), rows in grouped(stream, 0).items():
        for x in loop_modes({f: {0: (v / 4, p == "view", p == "error", v > 480, False, False)} for _, p, f, v, _ in rows}):
            want[(s, *x)] += 1
    assert result(spark, "region_scheduler", "session", "f", "region", "mode", "conf", "warning") == want


def test_scheduler_of_many_regions_with_flashes_and_warnings(spark):
    rng = np.random.default_rng(7)
    rows = {f: {k: (float(rng.choice([1, 3, 20, 90])), bool(rng.random() < 0.3), bool(rng.random() < 0.05), f in (0, 300), f % 50 == 7, bool(rng.random() < 0.02)) for k in range(6)} for f in range(700)}
    for f in rows:
        rows[f][5] = (90.0, False, False, f in (0, 300), False, False)  # asks at every frame: confidence wears down to a warning
    df = spark.createDataFrame([("s", f, k, *x) for f, ks in rows.items() for k, x in ks.items()], "session string, f bigint, region int, residual double, explained boolean, is_text boolean, cut boolean, flash boolean, fresh boolean")
    for t in (DEFAULT, Thresholds(budget_share=0.001, budget_extra=2)):  # the second leaves few reads
        got = Counter((r["f"], r["region"], r["mode"], round(r["conf"], 6), r["warning"]) for r in track.scheduled(df, t).collect())
        want = Counter(loop_modes(rows, t.budget_share, t.budget_extra))
        assert got == want and {k[2] for k in want} == set("CPVRF")
    assert sum(k[4] for k in want) > 0


def test_reidentified_tracks(spark):
    e = [(r["label"], r["vec_id"], np.array(r["embedding"], float)) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    want, taken = Counter(), set()
    for s, i, x in sorted((r for r in e if r[1] % 100), key=lambda r: (str(r[0]), r[1])):
        near = sorted((float(np.abs(x - y).sum()), j) for t, j, y in e if t == s and j % 100 == 0 and (s, j) not in taken and np.abs(x - y).sum() < 60)
        if near:
            taken.add((s, near[0][1]))
            want[s, i, near[0][1]] += 1
    assert result(spark, "reidentified_tracks", "session", "seen_id", "lost_id") == want


def test_text_lines(spark):
    e = spark.read.parquet(f"{DATA}/events.parquet").collect()
    pages = grouped([(r["user_id"], r["event_id"] % 7 * 3.0, r["value"] / 5, r["event_type"]) for r in e], 0)
    want = Counter()
    for (page,), words in pages.items():
        seen, lines = set(), []
        for _, y, x, w in sorted(words, key=lambda r: (r[1], r[2], r[3])):
            cell = (w, x // 8, y // 8)
            if cell in seen:
                continue
            seen.add(cell)
            for line in lines:
                if line[0] <= y + 1 <= line[1] and x - line[2] < 3 * max(2.0, line[1] - line[0]):
                    line[3].append((x, w))
                    line[:3] = min(line[0], y), max(line[1], y + 2), max(line[2], x + 4)
                    break
            else:
                lines.append([y, y + 2.0, x + 4.0, [(x, w)]])
        for i, line in enumerate(lines):
            want[page, i, " ".join(w for _, w in sorted(line[3], key=lambda z: z[0]))] += 1
    assert result(spark, "text_lines", "page", "line", "text") == want


def test_tracked_boxes(spark, stream):
    """One detection a frame: the nearest track by predicted centre within the gate, new ones tentative, 15 frames to removal."""
    want = Counter()
    for (s,), rows in grouped(stream, 0).items():
        tracks, named = [], 0
        for _, _, f, v, _ in rows:
            x = v / 5000 + f / 500
            c = x + 0.025
            near = sorted((abs(c - (k["c"] + k["v"] * (f - k["f"]))), i) for i, k in enumerate(tracks))
            gate = max(0.05, 1.5 * math.hypot(0.05, 0.05))
            hit = next((i for d, i in near if d <= gate), None)
            if hit is not None:
                k = tracks[hit]
                k["v"] = 0.6 * k["v"] + 0.4 * (c - k["c"]) / max(1, f - k["f"])
                k.update(c=c, x=x, f=f, n=k["n"] + 1, hidden=False)
                if not k["id"] and k["n"] >= 10 and abs(c - k["c0"]) >= 0.012:
                    named += 1
                    k["id"] = named
                if k["id"]:
                    want[s, f, k["id"], round(x, 6), "seen"] += 1
            for k in list(tracks):
                if f - k["f"] >= 15:
                    tracks.remove(k)
                    if k["id"]:
                        want[s, f, k["id"], round(k["x"], 6), "removed"] += 1
                elif f - k["f"] >= 4 and not k["hidden"]:
                    k["hidden"] = True
                    if k["id"]:
                        want[s, f, k["id"], round(k["x"], 6), "hidden"] += 1
            if hit is None:
                tracks.append({"id": 0, "c": c, "c0": c, "v": 0.0, "x": x, "f": f, "n": 1, "hidden": False})
    assert sum(want.values()) > 0 and result(spark, "tracked_boxes", "session", "f", "track", "x", "state") == want


def test_partly_hidden_tracks(spark):
    rows = [("s", f, 0.1 + 0.01 * f, 0.5, 0.05, 0.05 if f < 15 else 0.02) for f in range(18)]
    got = track.tracked(spark.createDataFrame(rows, "session string, f bigint, x double, y double, w double, h double"), 60.0).collect()
    assert {r["f"]: r["state"] for r in got} == {f: "seen" if f < 15 else "partial" for f in range(9, 18)}


def test_waiting_budget(spark, stream):
    want = Counter()
    for (s,), rows in grouped(stream, 0).items():
        open_, waited, left = {}, 0.0, 3.0
        for _, p, f, v, k in rows:
            for asked_id in list(open_):
                asked, ready = open_[asked_id]
                clock = f / 2.0 + waited
                done = ready is not None and ready <= clock
                if not done and f - asked > 6 and left > 0:
                    need = float("inf") if ready is None else ready - clock
                    spent = min(2.0, left, need)
                    waited += spent
                    left -= spent
                    done = ready is not None and need <= spent
                if done:
                    want[s, asked_id, asked, f, True, round(waited, 6)] += 1
                    del open_[asked_id]
            if p == "purchase" and v > 100:
                open_[str(k)] = (f, f / 2 + v / 40 if k % 7 else None)
        for asked_id, (asked, _) in open_.items():
            want[s, asked_id, asked, None, False, round(waited, 6)] += 1
    assert {k[4] for k in want} == {True, False} and result(spark, "waiting_budget", "session", "id", "asked_f", "f", "kept", "waited_s") == want
