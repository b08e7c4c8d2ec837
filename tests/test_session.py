import json

import pytest
from pyspark.sql import functions as F

from chronolith import api
from chronolith.operators import context
from chronolith.sources import session as files


def field(v, f):
    return {"v": v, "conf": 0.9, "source": "observed", "f": f, "bbox": [0, 0, 1, 1], "crop": None}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("clip.session")
    lines = [
        {"f": 0, "t_ms": 0.0, "kind": "snapshot", "modes": "C" * 48, "state": {"hud": {"health": field(100, 0)}, "entities": {"e1": {"label": field("enemy", 0), "visible": field(True, 0)}}}, "vlm": True},
        {"f": 1, "t_ms": 16.67, "kind": "delta", "modes": "C" * 48, "delta": {}, "vlm": False},
        {"f": 2, "t_ms": 33.33, "kind": "delta", "modes": "C" * 48, "delta": {"hud": {"health": field(93, 2)}}, "vlm": False},
        {"f": 5, "t_ms": 83.33, "kind": "delta", "modes": "C" * 48, "delta": {"entities": {"e1": None}}, "vlm": False},
        {"f": 6, "t_ms": 100.0, "kind": "snapshot", "modes": "C" * 48, "state": {"hud": {"health": field(93, 2)}}, "vlm": False},
        {"f": 7, "t_ms": 116.67, "kind": "delta", "modes": "C" * 48, "delta": {"hud": {"health": field(86, 7)}}, "vlm": False},
    ]
    (d / "stream.jsonl").write_text("\n".join(map(json.dumps, lines)) + '\n\n{"f": 8, "kind"\n')
    events = [
        {"id": f"ev{n}", "type": t, "f_start": f, "f_end": f, "t_ms": f * 16.67, "entity": e, "from": a, "to": b, "confidence": 0.85, "source": "observed", "evidence": {"f": f, "bbox": [0, 0, 1, 1], "crop": f"evidence/f{f}.jpg"}}
        for n, t, f, e, a, b in ((1, "ui_value_changed", 2, "hud.health", 100, 93), (2, "entity_removed", 5, "e1", None, None), (10, "ui_value_changed", 7, "hud.health", 93, 86))
    ]
    (d / "events.jsonl").write_text("\n".join(map(json.dumps, events)))
    (d / "meta.json").write_text(json.dumps({"fps": 60.0, "nb_frames": 8}, indent=1))
    return str(d)


@pytest.fixture(scope="module")
def clip(spark, folder):
    return api.load(spark, folder)


def leaf(df):
    return {"/".join(r["path"]): r["v"] for r in df.collect()}


def test_reader_counts_malformed_lines(spark, folder):
    good, bad = files.read_jsonl(spark, f"{folder}/stream.jsonl")
    assert good.count() == 6 and bad.first()[0] == 1
    assert files.read_jsonl(spark, f"{folder}/none.jsonl")[0].count() == 0


def test_get_state(clip):
    assert leaf(api.get_state(clip, 1))["hud/health/v"] == "100"
    s = leaf(api.get_state(clip, 4))
    assert s["hud/health/v"] == "93" and s["entities/e1/label/v"] == '"enemy"'
    assert not any(k.startswith("entities") for k in leaf(api.get_state(clip, 5)))
    assert leaf(api.get_state(clip, 999))["hud/health/v"] == "86"


def test_changes_history_events(clip):
    got = [(r["f"], r["kind"]) for r in api.get_changes(clip, 1, 6).filter("kind <> 'event'").orderBy("f").collect()]
    assert got == [(2, "delta"), (5, "delta"), (6, "snapshot")]
    doc = api.call(clip, "get_changes", {"f0": "1", "f1": "6"})[1]
    assert [c["f"] for c in doc["changes"]] == [2, 5, 6] and [e["id"] for e in doc["events"]] == ["ev1", "ev2"]
    assert doc["changes"][0]["delta"]["hud"]["health"]["v"] == 93 and doc["changes"][2] == {"f": 6, "kind": "snapshot"}
    doc = api.call(clip, "get_entity_history", {"entity": "e1"})[1]
    assert (doc["first_f"], doc["last_f"]) == (0, 4) and [e["id"] for e in doc["events"]] == ["ev2"]
    assert doc["history"]["label"] == [{"f": 0, "v": "enemy", "conf": 0.9, "source": "observed", "f_obs": 0, "bbox": [0, 0, 1, 1], "crop": None}]
    assert [(x["f"], x["v"]) for x in doc["history"]["present"]] == [(0, True), (5, False)]
    assert [r["id"] for r in api.get_events(clip, type="ui_value_changed").collect()] == ["ev1", "ev10"]
    assert [r["id"] for r in api.get_events(clip, 3, 6).collect()] == ["ev2"]
    doc = api.call(clip, "get_events", {"filter": "entity_removed"})[1]
    assert doc["count"] == 1 and doc["events"][0]["evidence"]["crop"] == "evidence/f5.jpg"


def test_search_and_evidence(clip, folder):
    hits = api.search_semantics(clip, "health").collect()
    assert {h["kind"] for h in hits} == {"event", "field", "summary"} and hits[0]["score"] >= hits[-1]["score"]
    assert {h["count"] for h in hits} == {len(hits)} and api.search_semantics(clip, "health", 2).collect()[0]["count"] == len(hits)
    # events name it once; the path holds it once for each of three values; the window's end and its two highlights
    assert sum(h["score"] for h in hits if h["kind"] == "field") == 3
    assert api.search_semantics(clip, "zebra").count() == 0 and api.call(clip, "search_semantics", {"q": "zebra"})[1]["count"] == 0
    doc = api.call(clip, "get_evidence", {"id": "hud/health@4"})[1]
    assert doc["claim"] == "hud/health=93 at f4" and doc["field"]["v"] == 93 and doc["evidence"]["f"] == 2 and not doc["evidence"]["exists"]
    doc = api.call(clip, "get_evidence", {"id": "ev2"})[1]
    assert doc["evidence"]["f"] == 5 and doc["evidence"]["crop_abs"] == f"{folder}/evidence/f5.jpg" and doc["claim"].startswith("f5 t=0.08s entity_removed entity=e1 None->None [obs 0.85]")
    assert not doc["evidence"]["exists"]
    for missing in ("nothing", "hud/none@3", "entities/e1/label@6"):
        assert api.call(clip, "get_evidence", {"id": missing})[1] == {"id": missing, "error": "not found"}


def test_evidence_that_is_there(spark, folder):
    from pathlib import Path

    (Path(folder) / "evidence").mkdir()
    (Path(folder) / "evidence" / "f2.jpg").write_bytes(b"jpeg")
    assert api.call(api.load(spark, folder), "get_evidence", {"id": "ev1"})[1]["evidence"]["exists"]


def test_context_and_ask(clip):
    c = api.compile_context(clip, "What was the health at frame 4?", 400)
    assert c["frames"] == [4] and c["tokens"] <= 400 and c["focus"] == {"hud": True, "flash": False} or c["focus"] == {"hud": True}
    assert "[f4 t=0.07s] health=93(obs 0.90) visible_entities=1: e1@None(obs)" in c["context"]
    assert "hud.health value timeline (value holds until next entry): f0=100 f2=93 f7=86" in c["context"]
    assert 'e1 ("enemy"): first f0 last f4; visible intervals: f0-f4' in c["context"]
    assert "visible entity count timeline (count holds until next entry): f0=1 f5=0" in c["context"]
    assert "f2 t=0.03s ui_value_changed entity=hud.health 100->93 [obs 0.85] id=ev1" in c["context"]
    assert [e["id"] for e in c["evidence"]] == ["ev1", "ev10"]
    assert api.ask(clip, "health?")["answer"] == "unknown"
    assert api.call(clip, "nope", {})[0] == 404 and api.call(clip, "get_state", {})[0] == 400
    assert api.call(clip, "get_events", {"start": "3", "end": "6"})[0] == 200
    assert api.reanalyze(clip, 0, 7).count() == 6
    doc = api.call(clip, "reanalyze", {"f0": "0", "f1": "7", "region": "0.5,0.5,0.25,0.25"})[1]
    assert doc["observations"][0]["text"]["bbox"] == [0.5, 0.5, 0.25, 0.25] and doc["observations"][0]["text"]["conf"] == 0.3


def test_tables_answer_as_lines_do(spark, clip, folder, tmp_path):
    made = api.ingest(spark, folder, str(tmp_path / "clip"))
    assert made.fps == 60.0 and made.n_frames == 8
    for op, params in (
        ("get_state", {"f": "4"}), ("get_changes", {"f0": "0", "f1": "9"}), ("get_entity_history", {"entity": "e1"}), ("get_events", {}),
        ("search_semantics", {"q": "health enemy"}), ("get_evidence", {"id": "hud/health@7"}), ("compile_context", {"q": "all at frame 5"}),
    ):
        one, two = (json.loads(json.dumps(api.call(s, op, dict(params)), default=str).replace(str(tmp_path / "clip"), folder)) for s in (clip, made))
        if op == "compile_context":
            one, two = (x[1]["context"].split("\n", 2)[2] for x in (one, two))
        assert one == two, op
    plan = api.get_state(made, 7)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(snap_f,6)" in plan
    doc = json.loads((tmp_path / "clip" / "summary.json").read_text())
    w = doc["windows"][0]
    assert (w["f_start"], w["f_end"], w["hud_end"], w["entities_seen"], w["vlm_frames"]) == (0, 8 - 1, {"health": 86}, ["e1"], 1)
    assert w["events"] == {"ui_value_changed": 2, "entity_removed": 1} and w["modes"] == {"C": 48 * 6}
    assert w["highlights"] == ["f2 ui_value_changed hud.health 100→93", "f5 entity_removed", "f7 ui_value_changed hud.health 93→86"]
    assert doc["session"]["frames"] == 6 and doc["session"]["entities_total"] == 1 and doc["session"]["skip_vlm_ratio"] == 1.0
    assert json.loads((tmp_path / "clip" / "meta.json").read_text())["nb_frames"] == 8


def made_states(rnd, frames):
    """States of a made-up session: values that change, entities that come, hide, go and come back."""
    hud, there, box = {"ammo": 30}, {"e1"}, {}
    for f in range(frames):
        if rnd.random() < 0.2:
            hud[rnd.choice(["ammo", "health", "score"])] = rnd.randint(0, 5)
        if rnd.random() < 0.1:
            there ^= {rnd.choice(["e1", "e2", "e3"])}
        for e in there:
            box[e] = [round(rnd.random(), 2) for _ in range(4)] if rnd.random() < 0.3 or e not in box else box[e]
        yield f, {
            "scene": {"id": f"s{f // 50}", "label": field(f"level {f // 50}", f // 50 * 50)},
            "hud": {k: field(v, f) for k, v in hud.items()}, "text": {"goal": field("Reach the gate" if f < 70 else "Defend", f // 70 * 70)},
            "entities": {e: {"label": field("enemy", 0), "visible": field(rnd.random() < 0.8, f), "bbox": field(box[e], f)} for e in sorted(there)},
        }


def dense_timelines(states):
    """Value changes by the definition: every state is looked at."""
    out, present = {}, {}

    def note(path, f, v, gap=None):
        tl = out.setdefault(path, [])
        if not tl or (f - tl[-1][0] >= gap if gap else tl[-1][1] != v):
            tl.append((f, v))

    for f, s in states:
        for k, x in s["hud"].items():
            note(f"hud/{k}", f, x["v"])
        for k, x in s["text"].items():
            note(f"text/{k}", f, x["v"])
        note("scene/label", f, s["scene"]["label"]["v"])
        for e, x in s["entities"].items():
            note(f"entities/{e}/label", f, x["label"]["v"])
            note(f"entities/{e}/visible", f, x["visible"]["v"])
            note(f"entities/{e}/bbox", f, x["bbox"]["v"], 30)
            present.setdefault(e, 0)
        note("derived/visible_entity_count", f, sum(x["visible"]["v"] for x in s["entities"].values()))
        for e in present:
            note(f"entities/{e}/present", f, e in s["entities"])
    return out


def test_timelines_against_dense_replay(spark, tmp_path):
    import random

    from chronolith.operators import state

    states = list(made_states(random.Random(21), 160))
    df = spark.createDataFrame([("made", f, json.dumps(s)) for f, s in states], "session string, f bigint, json string")
    d = tmp_path / "made.session"
    d.mkdir()
    rows = state.stream_of(df, 60).orderBy("f").collect()
    (d / "stream.jsonl").write_text("\n".join(json.dumps({"f": r["f"], "t_ms": r["f"] * 50.0, "kind": r["kind"], "modes": "C" * 48, ("state" if r["kind"] == "snapshot" else "delta"): json.loads(r["json"]), "vlm": False}) for r in rows))
    (d / "meta.json").write_text(json.dumps({"fps": 20.0}))
    s = api.load(spark, str(d))
    got = {}
    for r in s.timelines.orderBy("path", "f").collect():
        got.setdefault(r["path"], []).append((r["f"], json.loads(r["v"])))
    assert got == dense_timelines(states)
    for f in (0, 33, 59, 60, 119, 159):
        assert api.call(s, "get_state", {"f": f})[1] == json.loads(json.dumps(dict(states)[f]), object_hook=lambda x: {k: v for k, v in x.items() if v is not None})
    want = {e: [f for f, x in states if e in x["entities"]] for e in ("e1", "e2", "e3")}
    for e, fs in want.items():
        doc = api.call(s, "get_entity_history", {"entity": e})[1]
        assert (doc["first_f"], doc["last_f"]) == (min(fs, default=None), max(fs, default=None))
    ends = {r["window"]: (json.loads(r["hud_end"]), r["entities_seen"], json.loads(r["scene"])) for r in s.windows.collect()}
    for w in range(1):
        last = dict(states)[min(159, 200 * w + 199)]
        assert ends[w] == ({k: x["v"] for k, x in last["hud"].items()}, sorted(e for e, fs in want.items() if fs), last["scene"]["label"]["v"])
    text = api.compile_context(s, "everything at frame 100", 3000)
    assert text["tokens"] <= 3000 and "derived" not in text["context"] and "[f100 t=5.00s]" in text["context"]


def test_round_trip_of_stream(spark, clip, tmp_path):
    files.write_stream(clip.frames, str(tmp_path / "out"))
    name = next((tmp_path / "out").glob("session=*"))
    again = files.read_stream(spark, str(name), "x")
    same = lambda df: sorted((r["f"], r["kind"], r["json"]) for r in df.collect())
    assert same(again) == same(clip.frames)
    files.write_tables(clip.ops, str(tmp_path / "ops"))
    assert spark.read.parquet(str(tmp_path / "ops")).filter(F.col("snap_f") == 6).count() > 0


def test_intents_times_and_budget():
    assert context.intents("is it white?")["flash"]  # "hit" within "white", as a substring
    assert all(context.intents("xyz").values())
    assert context.frame_references("frames 10-20 and 1:05.5, 3.5 seconds, s5, frame #120", 60, 4580) == [10, 20, 120, 210, 3930]
    assert context.frame_references("frame 99999", 60, 100) == [99]
    text = context.laid_out([(1, "B", ["x" * 5000]), (0, "A", ["short"])], 400)
    assert text.startswith("## A\nshort\n## B\n") and context.TRIMMED in text and context.CUT in text
    assert context.estimate(text) <= 400


def test_layout_against_a_greedy_loop():
    """Line by line: what fits is taken, what does not is cut where 200 characters remain, and ends its section."""
    import random

    rnd = random.Random(4)
    for _ in range(300):
        sections = [(rnd.randint(0, 3), "T" * rnd.randint(1, 30), ["y" * rnd.choice([3, 40, 400, 900]) for _ in range(rnd.randint(0, 6))]) for _ in range(5)]
        budget = rnd.randint(20, 900)
        room, want = context.limit_of(budget), []
        for p in range(4):
            for q, title, lines in sections:
                if q != p or len(title) + 4 > room:
                    continue
                want.append("## " + title)
                room -= len(title) + 4
                for line in lines:
                    if len(line) + 1 <= room:
                        want.append(line)
                        room -= len(line) + 1
                    else:
                        if room - 20 > 200:
                            want.append(line[: room - 20] + context.TRIMMED)
                            room -= room - 20 + 12
                        want.append(context.CUT)
                        room -= 40
                        break
        assert context.laid_out(sections, budget) == "\n".join(want)


def test_an_empty_snapshot_is_a_state(spark, tmp_path):
    d = tmp_path / "gaps.session"
    d.mkdir()
    lines = [
        {"f": 3, "t_ms": 0.0, "kind": "delta", "modes": "", "delta": {"hud": {"early": field(1, 3)}}, "vlm": False},
        {"f": 4, "t_ms": 0.0, "kind": "snapshot", "modes": "", "state": {"hud": {"health": field(100, 4)}}, "vlm": False},
        {"f": 300, "t_ms": 0.0, "kind": "snapshot", "modes": "", "state": {}, "vlm": False},
        {"f": 310, "t_ms": 0.0, "kind": "delta", "modes": "", "delta": {"hud": {"ammo": field(3, 310)}}, "vlm": False},
    ]
    (d / "stream.jsonl").write_text("\n".join(map(json.dumps, lines)))
    (d / "events.jsonl").write_text("")
    for s in (api.load(spark, str(d)), api.ingest(spark, str(d), str(tmp_path / "tables"))):
        assert leaf(api.get_state(s, 3))["hud/early/v"] == "1"
        assert leaf(api.get_state(s, 299))["hud/health/v"] == "100" and "hud/early/v" not in leaf(api.get_state(s, 299))
        assert leaf(api.get_state(s, 305)) == {}
        assert set(leaf(api.get_state(s, 310))) == {f"hud/ammo/{k}" for k in ("v", "conf", "source", "f", "bbox")} and api.call(s, "get_evidence", {"id": "hud/health@310"})[1]["error"]
        assert [(r["snap_f"], r["empty"]) for r in s.snapshots.orderBy("snap_f").collect()] == [(3, True), (4, False), (300, True)]


@pytest.mark.parametrize(("query", "budgets"), [("which health, enemies and texts were there at frame 4?", (150, 4000)), ("ammo", (400,))])
def test_contexts_of_held_lines_and_of_spark_are_the_same(clip, query, budgets, monkeypatch):
    for budget in budgets:
        held = api.compile_context(clip, query, budget)
        assert clip.held["ready"]
        monkeypatch.setattr(api, "ready", lambda s: None)
        assert api.compile_context(clip, query, budget) == held
        monkeypatch.undo()


def test_long_lines_are_not_held(clip, monkeypatch):
    was = clip.held.pop("ready", None)
    monkeypatch.setattr(api, "READY_CHARS", 10)
    assert api.ready(clip) is None and "health" in api.compile_context(clip, "health")["context"]
    clip.held["ready"] = was
