"""The eight public operations on a session, and their registry.

A ``Session`` is a few DataFrames: frames, operations (session, snap_f, f, path, op, v as JSON text), timelines of
values, events and summary windows. Operations return DataFrames; ``compile_context`` and ``ask`` end in a string
made from what a token budget can hold. ``call`` and ``document`` shape results as a service answers them.

A session directory holds JSON lines, or the Parquet tables that ``ingest`` writes from them; lines are turned into such
tables in the scratch folder when they are loaded. Point reads prune to the pages of one snapshot.
"""

from __future__ import annotations

import atexit
import json
import re
import shutil
import tempfile
import uuid
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolith import providers
from chronolith.functions import geometry
from chronolith.functions.text import shown, source_tag
from chronolith.operators import context, fields, intervals, search, state
from chronolith.operators.summary import evenly_sampled
from chronolith.sources import session as files

#: Tables of an ingested session. Schemas are stated, since a table without rows has no file to tell it.
SCHEMAS = {
    "frames": files.STREAM_SCHEMA, "snapshots": "session string, snap_f bigint, empty boolean", "ops": "session string, snap_f bigint, f bigint, path array<string>, op string, v string",
    "timelines": fields.TIMELINE, "events": f"session string, {files.EVENT_SCHEMA}, line string",
    "windows": "session string, window bigint, t_start_s bigint, f_start bigint, f_end bigint, scene string, entities_seen array<string>, events string, hud_end string, text_end string, modes string, vlm_frames bigint, highlights array<string>",
}
TABLES = tuple(SCHEMAS)


@dataclass
class Session:
    name: str
    path: str
    frames: DataFrame
    ops: DataFrame
    events: DataFrame
    timelines: DataFrame
    windows: DataFrame
    snapshots: DataFrame
    fps: float = 30.0
    first: int = 0
    last: int = -1
    width: int = 0
    height: int = 0
    held: dict = field(default_factory=dict, repr=False)

    @property
    def spark(self) -> SparkSession:
        return self.frames.sparkSession

    @property
    def n_frames(self) -> int:
        return self.last + 1


_SESSIONS: dict[str, tuple[tuple, Session]] = {}


def load(spark: SparkSession, path: str, fps: float | None = None) -> Session:
    """A session directory. Kept by path while sizes and times of its files stay what they are: no file is read for that."""
    path = path.rstrip("/")
    stamp = files.stamp(spark, path, ("stream.jsonl", "events.jsonl", "meta.json", *TABLES))
    if path in _SESSIONS and _SESSIONS[path][0] == (stamp, fps):
        return _SESSIONS[path][1]
    made = (_from_tables if files.exists(spark, f"{path}/ops") else _from_lines)(spark, path, fps)
    _SESSIONS[path] = (stamp, fps), made
    return made


def _facts(spark: SparkSession, path: str, frames: DataFrame, fps: float | None) -> dict:
    meta = files.read_document(spark, f"{path}/meta.json", "fps double, width int, height int").first()
    ends = frames.agg(F.min("f"), F.max("f")).first()
    known = meta.asDict() if meta else {}
    return {"fps": fps or known.get("fps") or 30.0, "width": known.get("width") or 0, "height": known.get("height") or 0, "first": ends[0] or 0, "last": -1 if ends[1] is None else ends[1]}


def _scratch(spark: SparkSession) -> str:
    """A new folder that all executors see: under ``spark.checkpoint.dir``; only in local mode, where that is unset, a temporary one."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        return f"{shared.rstrip('/')}/session-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="chronolith-session-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return f"{folder}/tables"


def _write_tables(spark: SparkSession, source: str, out: str, fps: float | None) -> None:
    """JSON lines of a session -> its tables. Each is read back before the next is made from it, so no plan holds the work of another."""
    name = source.split("/")[-1]

    def stored(table: str, rows: DataFrame) -> DataFrame:
        files.write_tables(rows, f"{out}/{table}", [c for c in ("snap_f", "f", "f_start", "window") if c in rows.columns][:2])
        return _table(spark, out, table)

    frames = stored("frames", files.read_stream(spark, f"{source}/stream.jsonl", name))
    stored("snapshots", state.snapshots(frames))
    ops = stored("ops", state.patch_ops(frames, F.col("json")))
    parts: list[DataFrame] = []
    values = stored("timelines", fields.timelines(ops, frames, parts))
    for df in parts:
        df.unpersist()
    events = stored("events", files.read_events(spark, f"{source}/events.jsonl", name))
    stored("windows", fields.windows(frames, values, ops, events, _facts(spark, source, frames, fps)["fps"]))


def _table(spark: SparkSession, path: str, table: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[table]).parquet(f"{path}/{table}")


def _from_lines(spark: SparkSession, path: str, fps: float | None) -> Session:
    """A session of JSON lines is read from tables in the scratch folder, written once."""
    out = _scratch(spark)
    _write_tables(spark, path, out, fps)
    return _from_tables(spark, out, fps, path)


def _from_tables(spark: SparkSession, tables: str, fps: float | None, path: str | None = None) -> Session:
    path = path or tables
    frames, directory, ops, values, events, windows = (_table(spark, tables, t) for t in TABLES)
    return Session(path.split("/")[-1], path, frames, ops, events, values, windows, directory, **_facts(spark, path, frames, fps))


def ingest(spark: SparkSession, source: str, out: str, fps: float | None = None) -> Session:
    """JSON lines of a session -> Parquet tables, ``summary.json`` and ``meta.json`` in ``out``, replacing what is there."""
    source = source.rstrip("/")
    _write_tables(spark, source, out, fps)
    s = _from_tables(spark, out, fps, source)
    files.write_document(spark, summary(s), f"{out}/summary.json")
    stored = sum(size for *_, size in files.stamp(spark, out, TABLES))
    meta = {"fps": s.fps, "nb_frames": s.n_frames, "frames": s.frames.count(), "width": s.width, "height": s.height, "snapshot_every": state.DEFAULT.snapshot_every, "stored_bytes": stored}
    files.write_document(spark, meta, f"{out}/meta.json")
    return load(spark, out, fps)


def summary(s: Session) -> dict:
    """The summary document: its windows and the session's totals."""
    windows = [_plain(r) for r in s.windows.orderBy("window").toJSON().toLocalIterator()]
    modes = [(m, n) for w in windows for m, n in w["modes"].items()]
    total, kinds = {}, {}
    for m, n in modes:
        total[m] = total.get(m, 0) + n
    for w in windows:
        for k, n in w["events"].items():
            kinds[k] = kinds.get(k, 0) + n
    facts = s.frames.agg(F.count(F.lit(1)).alias("n"), F.count_if("vlm").alias("vlm")).first()
    entities = s.timelines.filter(F.col("path").rlike("^entities/")).select(F.split("path", "/")[1]).distinct().count()
    skipped = sum(total.get(m, 0) for m in "CPV")
    return {"windows": windows, "session": {
        "frames": facts["n"], "duration_s": round(facts["n"] / s.fps, 2), "entities_total": entities, "events": kinds, "mode_hist": total,
        "skip_vlm_ratio": round(skipped / max(1, sum(total.values())), 4), "vlm_frames": facts["vlm"], "final_hud": windows[-1]["hud_end"] if windows else {},
    }}


def _plain(row: str) -> dict:
    """A window's row with its JSON texts opened."""
    found = json.loads(row)
    return {k: json.loads(v) if k in ("events", "hud_end", "text_end", "modes", "scene") and isinstance(v, str) else v for k, v in found.items() if k != "session"} | ({} if "scene" in found else {"scene": None})


#: A session's snapshots are held on the driver where they are no more than this.
HELD_SNAPSHOTS = 100_000
#: So are the lines of contexts, where these are few and short; and as many lines of states as are asked for most lately.
READY_LINES, READY_CHARS, HELD_STATES = 5_000, 20_000, 256


def state_rows(s: Session, ops: DataFrame, frames: list[int], latest: bool = False) -> DataFrame:
    """(session, n, path, v) at the frames, which lie within the session. The snapshots they build on are looked up without a job where they are held.

    With ``latest``, of one frame: (path, op, v, at, cut), the last operation of each path, its frame, and that of the last set or delete.
    """
    if "snapshots" not in s.held:
        found = s.snapshots.select("snap_f").limit(HELD_SNAPSHOTS + 1).collect()
        s.held["snapshots"] = sorted(r["snap_f"] for r in found) if len(found) <= HELD_SNAPSHOTS else None
    known = s.held["snapshots"]
    if latest:
        n = frames[0]
        snap = known[max(0, bisect_right(known, n) - 1)] if known else s.snapshots.filter(F.col("snap_f") <= n).agg(F.max("snap_f")).first()[0]
        near = ops.filter((F.col("snap_f") == (0 if snap is None else snap)) & (F.col("f") <= n))
        last = F.max_by(F.struct("op", "v"), "f")
        return near.groupBy("path").agg(last.alias("r"), F.max("f").alias("at"), F.max(F.when(F.col("op").isin("set", "del"), F.col("f"))).alias("cut")).select("path", "r.op", "r.v", "at", "cut")
    if not known:
        return state.reconstruct_at(ops, frames, directory=s.snapshots)
    return state.reconstruct_known(ops, [(n, known[max(0, bisect_right(known, n) - 1)]) for n in frames])


def clamped(s: Session, f: int) -> int:
    return max(s.first, min(int(f), s.last))


def get_state(s: Session, f: int) -> DataFrame:
    """(session, path array, v) at the frame, held within the session."""
    return state_rows(s, s.ops, [clamped(s, f)]).drop("n")


def get_changes(s: Session, f0: int, f1: int) -> DataFrame:
    """(f, kind, delta, event): snapshots as markers only, deltas that are not empty, and the events that meet the range."""
    rows = s.frames.filter(F.col("f").between(int(f0), int(f1)))
    kept = rows.filter((F.col("kind") == "snapshot") | (F.coalesce("json", F.lit("{}")) != "{}"))
    none = F.lit(None).cast("string")
    changes = kept.select("f", "kind", F.when(F.col("kind") != "snapshot", F.col("json")).alias("delta"), none.alias("event"))
    return changes.unionByName(get_events(s, f0, f1).select(F.col("f_start").alias("f"), F.lit("event").alias("kind"), none.alias("delta"), F.col("line").alias("event")))


def get_entity_history(s: Session, entity_id: str) -> DataFrame:
    """(kind, attr, f, v, conf, source, f_obs, bbox, crop, event): the timelines of the entity, one row ``span`` with its first and last frame, its events."""
    own = s.timelines.filter(F.col("path").startswith(f"entities/{entity_id}/"))
    rows = own.select(F.lit("value").alias("kind"), F.expr(f"substr(path, {len(entity_id) + 11})").alias("attr"), "f", "v", "conf", "source", "f_obs", "bbox", "crop")
    there = fields.spans(own.filter(F.col("path").endswith("/present")).select("session", F.lit(entity_id).alias("id"), "f", (F.col("v") == "true").alias("v")), s.frames)
    whole = there.agg(F.min("first_f").alias("f"), F.max("last_f").alias("f_obs")).filter("f IS NOT NULL").withColumn("kind", F.lit("span"))
    events = s.events.filter(F.col("entity") == entity_id).select(F.lit("event").alias("kind"), F.col("f_start").alias("f"), F.col("line").alias("event"))
    return rows.unionByName(whole, allowMissingColumns=True).unionByName(events, allowMissingColumns=True)


def get_events(s: Session, f0: int | None = None, f1: int | None = None, type: str | None = None) -> DataFrame:
    lo, hi = -1 if f0 in (None, "") else int(f0), 10**12 if f1 in (None, "") else int(f1)
    return intervals.of_types(fields.in_range(s.events, lo, hi), type).orderBy("f_start", "id")


def search_semantics(s: Session, query: str, limit: int = 50) -> DataFrame:
    """(score, kind, item, f, detail, count): the best hits among events, values and summary windows, and how many hits there are."""
    parts = [
        search.hits(s.events, "event", F.col("id"), F.col("f_start"), F.col("line"), query, F.col("line")),
        search.hits(s.timelines, "field", F.col("path"), F.col("f"), F.concat_ws(" ", "path", "v"), query, F.to_json(F.struct("path", "f", "v", "conf", "source", "crop"))),
        search.hits(s.windows, "summary", F.col("window"), F.lit(None), fields.window_document(), query, fields.window_document()),
    ]
    return search.ranked(parts, int(limit), count=True)


def get_evidence(s: Session, annotation_id: str) -> DataFrame:
    """One row (id, claim, field, evidence, source, confidence, error): an event's id, or ``<path>@<f>``; error where neither is found."""
    shape = "struct<f:bigint,bbox:array<double>,crop:string,crop_abs:string,exists:boolean>"
    event = event_lines(s).filter(F.col("id") == annotation_id).select(
        "id", F.col("line").alias("claim"), F.lit(None).cast("string").alias("field"), _evidence(s, F.col("crop_f"), F.col("bbox"), F.col("crop")).cast(shape).alias("evidence"),
        "source", F.col("confidence").cast("double").alias("confidence"),
    )
    known = ready(s)
    found = [] if known and all(id != annotation_id for *_, id in known["events"]) else event.take(1)
    path, _, f = annotation_id.rpartition("@")
    row = found[0].asDict(recursive=True) if found else None
    if row is None and path and f.isdigit() and (node := _field_at(s, path.split("/"), clamped(s, int(f)))):
        v = node["v"]
        place = {"f": node["f"], "bbox": json.loads(node["bbox"] or "null"), "crop": node["crop"], "crop_abs": f"{s.path}/{node['crop']}" if node["crop"] else None, "exists": False}
        claim = f"{path}={json.loads(v) if v.startswith('\"') else v} at f{f}"
        row = {"id": annotation_id, "claim": claim, "field": json.dumps(node, separators=(",", ":"), ensure_ascii=False), "evidence": place, "source": node["source"], "confidence": node["conf"]}
    if row is None:
        row = {"id": annotation_id, "error": "not found"}
    if (row.get("evidence") or {}).get("crop"):
        row["evidence"]["exists"] = files.exists(s.spark, row["evidence"]["crop_abs"])
    kinds = f"id string, claim string, field string, evidence {shape}, source string, confidence double, error string"
    return s.spark.range(0, 1, 1, 1).select(F.from_json(F.lit(json.dumps(row)), kinds).alias("r")).select("r.*")


def _field_at(s: Session, path: list[str], n: int) -> dict | None:
    """The members of one field in the state at a frame (v and bbox as JSON texts), or None: one aggregate over the operations on
    its members and on what they are under, a dozen paths at most."""
    members = [[*path, m] for m in fields.MEMBERS]
    above = [path[:k] for k in range(1, len(path) + 1)]
    same = reduce(lambda a, b: a | b, [F.col("path") == F.array(*[F.lit(x) for x in p]) for p in [*members, *above]])
    latest = state_rows(s, s.ops.filter(same), [n], latest=True)
    seen = {tuple(r["path"]): r for r in latest.collect()}
    cut = max((r["cut"] for k in above if (r := seen.get(tuple(k))) and r["cut"] is not None), default=-1)
    value = {m: r["v"] for m, p in zip(fields.MEMBERS, members, strict=True) if (r := seen.get(tuple(p))) and r["op"] == "set" and r["at"] > cut}
    if value.get("v") is None:
        return None
    opened = {m: json.loads(value[m]) if value.get(m) is not None else None for m in ("conf", "source", "f", "crop")}
    return {"v": value["v"], "conf": opened["conf"], "source": opened["source"], "f": opened["f"], "bbox": value.get("bbox"), "crop": opened["crop"]}


def _evidence(s: Session, f: Column, bbox: Column, crop: Column) -> Column:
    return F.struct(f.alias("f"), bbox.alias("bbox"), crop.alias("crop"), F.concat(F.lit(f"{s.path}/"), crop).alias("crop_abs"), F.lit(False).alias("exists"))


def event_lines(s: Session) -> DataFrame:
    """(f_start, id, type, line, crop, crop_f, bbox, source, confidence) of every event. Recorded times win over computed ones."""
    e = s.events.drop("line").join(s.frames.select(F.col("f").alias("f_start"), F.col("t_ms").alias("at_ms")), "f_start", "left")
    end = F.coalesce("f_end", "f_start")
    span = F.when(end == F.col("f_start"), F.format_string("f%d", "f_start")).otherwise(F.format_string("f%d-f%d", F.col("f_start"), end))
    t = F.coalesce("t_ms", "at_ms", F.col("f_start") * 1000.0 / s.fps, F.lit(0.0)) / 1000
    change = F.when(F.col("from").isNotNull() | F.col("to").isNotNull(), F.concat(shown(F.to_json("from")), F.lit("->"), shown(F.to_json("to"))))
    parts = [span, F.format_string("t=%.2fs", t), F.col("type"), F.when(F.col("entity").isNotNull(), F.concat(F.lit("entity="), F.col("entity"))), change, F.concat(F.lit("["), source_tag(F.col("source"), F.col("confidence")), F.lit("]")), F.concat(F.lit("id="), F.col("id"))]
    return e.select("f_start", "id", "type", F.concat_ws(" ", *parts).alias("line"), F.col("evidence.crop").alias("crop"), F.coalesce("evidence.f", "f_start").alias("crop_f"), F.col("evidence.bbox").alias("bbox"), "source", "confidence")


def compact_states(s: Session, frames: list[int]) -> DataFrame:
    """(n, line): display, texts and visible entities of the state at each frame, with tags of where they come from."""
    at = [clamped(s, f) for f in frames] or [s.first]
    rows = fields.fields_at(state_rows(s, s.ops, at), "n")
    group, key, tag = F.col("field")[0], F.col("field")[1], source_tag(F.col("source"), F.col("conf"))
    said = F.concat(F.when(group == "text", "text.").otherwise(""), key, F.lit("="), shown(F.col("v")), F.lit("("), tag, F.lit(")"))
    listed = lambda g: F.array_sort(F.collect_list(F.when((group == g) & (F.size("field") == 2), F.struct(key.alias("k"), said.alias("said")))))
    plain = rows.groupBy("n").agg(listed("hud").alias("hud"), listed("text").alias("text"))
    attr = lambda name, what: F.max(F.when(F.col("field")[2] == name, what))
    things = rows.filter((group == "entities") & (F.size("field") == 3)).groupBy("n", key.alias("id")).agg(
        attr("visible", F.col("v")).alias("visible"), attr("bbox", F.col("v")).alias("bbox"), F.coalesce(attr("visible", F.col("source")), attr("bbox", F.col("source"))).alias("source")
    ).filter("coalesce(visible, 'true') <> 'false'")
    one = F.concat("id", F.lit("@"), shown(F.coalesce("bbox", F.lit("null"))), F.lit("("), source_tag(F.col("source"), F.lit(None).cast("double")), F.lit(")"))
    seen = things.groupBy("n").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", one.alias("said")))), lambda x: x["said"]).alias("seen"))
    asked = s.spark.createDataFrame([(n,) for n in sorted(set(at))], "n bigint").join(s.frames.select(F.col("f").alias("n"), "t_ms"), "n", "left")
    none = F.array().cast("array<string>")
    said_of = lambda c: F.coalesce(F.transform(c, lambda x: x["said"]), none)
    time = F.format_string("[f%d t=%.2fs]", F.col("n"), F.coalesce("t_ms", F.col("n") * 1000.0 / s.fps) / 1000)
    visible = F.concat(F.lit("visible_entities="), F.size(F.coalesce("seen", none)).cast("string"), F.lit(": "), F.array_join(F.coalesce("seen", none), " "))
    return asked.join(plain, "n", "left").join(seen, "n", "left").select("n", F.array_join(F.concat(F.array(time), said_of("hud"), said_of("text"), F.array(visible)), " ").alias("line"))


def context_lines(s: Session, query: str, want: dict[str, bool], frames: list[int]) -> tuple[list[tuple[int, str]], DataFrame]:
    """((priority, title) of every section, rows (section, place, line)): all that a context may say, not yet cut to a budget."""
    titles: list[tuple[int, str]] = []
    parts: list[DataFrame] = []

    def section(priority: int, title: str, rows: DataFrame, *order: str | Column) -> None:
        parts.append(rows.select(F.lit(len(titles)).alias("section"), F.struct(*[F.col(c) if isinstance(c, str) else c for c in order]).cast("string").alias("place"), "line"))
        titles.append((priority, title))

    rank = lambda kind: 1 if want[kind] else 3
    if frames:
        section(0, context.STATES, compact_states(s, frames[:6]), _wide("n"))
    if want["hud"] or frames:
        named = _hud_lines(s).withColumn("asked", F.lit((query or "").lower()).contains(F.lower("name")))
        chosen = named.join(F.broadcast(named.agg(F.coalesce(F.max("asked"), F.lit(False)).alias("some")))).filter("asked OR NOT some")
        section(rank("hud"), context.HUD, chosen, "name")
    if want["text"] or frames:
        section(rank("text"), context.TEXTS, _text_lines(s), "path")
    if want["entities"] or frames:
        section(rank("entities"), context.ENTITIES, _entity_lines(s), _wide("first_f"), "id")
    e = event_lines(s)
    first = [t for kind in ("flash", "hud", "text", "entities") if want[kind] for t in context.TYPES[kind]]
    counts = e.groupBy("type").agg(F.count(F.lit(1)).alias("n")).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "type", F.col("n").cast("string")))), ", ").alias("line"))
    section(1, context.COUNTS, counts.withColumn("f", F.lit(0)), "f")
    section(1, context.EVENTS.format(types="/".join(first)), e.filter(F.col("type").isin(*first)), _wide("f_start"), "id")
    section(4, context.OTHERS, e.filter(~F.col("type").isin(*first)), _wide("f_start"), "id")
    lines = parts[0]
    for p in parts[1:]:
        lines = lines.unionByName(p)
    return titles, lines


def _wide(c: str) -> Column:
    return F.lpad(F.col(c).cast("string"), 12, "0")


def _seen_at() -> Column:
    return F.when(F.col("f_obs") <= F.col("f"), F.col("f_obs")).otherwise(F.col("f")).cast("string")


def _in_order(item: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("f", item.alias("item")))), lambda x: x["item"]), " ")


def _hud_lines(s: Session) -> DataFrame:
    """(name, line) of every value of the display."""
    own = s.timelines.filter(F.col("path").startswith("hud/")).withColumn("name", F.expr("substr(path, 5)"))
    unsure = F.when(F.col("source").eqNullSafe(F.lit("observed")), "").otherwise(F.concat(F.lit("("), source_tag(F.col("source"), F.col("conf")), F.lit(")")))
    named = own.groupBy("name").agg(_in_order(F.concat(F.lit("f"), _seen_at(), F.lit("="), shown(F.col("v")), unsure)).alias("items"))
    return named.select("name", F.concat(F.lit("hud."), "name", F.lit(context.HUD_LINE), "items").alias("line"))


def _text_lines(s: Session) -> DataFrame:
    """(path, line) of every text and of the scene."""
    own = s.timelines.filter(F.col("path").rlike("^(text|scene)/"))
    tag = F.concat(F.lit("["), source_tag(F.col("source"), F.col("conf")), F.lit("]"))
    lines = own.groupBy("path").agg(_in_order(F.concat(F.lit("f"), _seen_at(), F.lit("="), shown(F.col("v")), tag)).alias("items"))
    return lines.select("path", F.concat(F.replace(F.col("path"), F.lit("/"), F.lit(".")), F.lit(": "), "items").alias("line"))


def _entity_lines(s: Session) -> DataFrame:
    """(first_f, id, line): every entity with its intervals, after a first line of how many are visible when."""
    part = F.split("path", "/")
    own = s.timelines.filter(F.col("path").startswith("entities/")).withColumn("id", F.get(part, 1)).withColumn("attr", F.get(part, 2))
    present = own.filter("attr = 'present'").select("session", "id", "f", (F.col("v") == "true").alias("v"))
    bounds = fields.spans(present, s.frames).groupBy("id").agg(F.min("first_f").alias("first_f"), F.max("last_f").alias("last_f"))
    visible = fields.visible_spans(s.timelines, present, s.frames)
    nth = F.row_number().over(Window.partitionBy("id").orderBy("f_start"))
    spans = visible.withColumn("r", nth).groupBy("id").agg(
        F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("f_start", "f_end"))), 1, 20), lambda x: F.format_string("f%d-f%d", x["f_start"], x["f_end"])), " ").alias("iv"), F.max("r").alias("n_iv")
    )
    early = lambda attr: F.min_by(F.when(F.col("attr") == attr, F.col("v")), F.when(F.col("attr") == attr, F.col("f")))
    unseen = F.array_sort(F.collect_list(F.when((F.col("attr") == "visible") & (F.col("source") != "observed"), F.col("f"))))
    named = own.groupBy("id").agg(F.coalesce(early("label"), early("type"), F.lit('""')).alias("label"), F.transform(F.slice(unseen, 1, 8), lambda f: F.format_string("f%d", f)).alias("prop"))
    all_of = named.join(bounds, "id").join(spans, "id", "left")
    shape = F.concat(F.coalesce(F.col("iv"), F.lit("none")), F.when(F.col("n_iv") > 20, " ...").otherwise(""))
    line = F.concat("id", F.lit(" ("), shown(F.col("label")), F.lit("): first f"), F.col("first_f").cast("string"), F.lit(" last f"), F.col("last_f").cast("string"), F.lit("; visible intervals: "), shape,
                    F.when(F.size("prop") > 0, F.concat(F.lit("; visibility PROP/INFER at "), F.array_join("prop", " "))).otherwise(""))
    counts = s.timelines.filter("path = 'derived/visible_entity_count'").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("f", "v"))), lambda x: F.format_string("f%d=%s", x["f"], x["v"])), " ").alias("items"), F.count(F.lit(1)).alias("n"))
    head = counts.filter(F.col("n") > 0).select(F.lit(-1).cast("bigint").alias("first_f"), F.lit("").alias("id"), F.concat(F.lit(context.COUNT_LINE), "items").alias("line"))
    some = all_of.limit(1).select(F.lit(1).alias("some"))
    return head.join(some).drop("some").unionByName(all_of.select("first_f", "id", line.alias("line")))


def ready(s: Session) -> dict[str, list] | None:
    """All that contexts of a session may say whatever is asked, made by one query on first use, where it is little: lists of
    (key, line) of the display, texts, entities and (type, line, id) of events, in order, and the crops behind them. None where
    it is more than ``READY_LINES`` lines or has one of more than ``READY_CHARS`` characters; contexts are then cut in Spark."""
    if "ready" not in s.held:
        none = F.lit(None).cast("string")
        part = lambda kind, rows, key, place, line="line", id=none: rows.select(F.lit(kind).alias("kind"), key.alias("key"), F.concat_ws("/", *place).alias("place"), F.substring(line, 1, READY_CHARS + 1).alias("line"), id.alias("id"))
        crops = _crops(s).withColumn("line", F.to_json(F.struct("f", "crop", "id")))
        parts = [
            part("hud", _hud_lines(s), F.col("name"), [F.col("name")]), part("text", _text_lines(s), F.col("path"), [F.col("path")]), part("entities", _entity_lines(s), F.col("id"), [_wide("first_f"), F.col("id")]),
            part("events", event_lines(s), F.col("type"), [_wide("f_start"), F.col("id")], id=F.col("id")), part("crops", crops, F.col("type"), [F.col("ord")]),
        ]
        rows = reduce(DataFrame.unionByName, parts).limit(READY_LINES + 1).collect()
        found: dict[str, list] = {k: [] for k in ("hud", "text", "entities", "events", "crops")}
        for r in sorted(rows, key=lambda r: r["place"]):
            found[r["kind"]].append((r["key"], r["line"], r["id"]))
        s.held["ready"] = found if len(rows) <= READY_LINES and all(len(r["line"]) <= READY_CHARS for r in rows) else None
    return s.held["ready"]


def _states_said(s: Session, frames: list[int]) -> list[str]:
    """The lines of ``compact_states``, of which those asked for lately are held."""
    said = s.held.setdefault("states", {})
    at = sorted({clamped(s, f) for f in frames})
    if missing := [n for n in at if n not in said]:
        said |= {r["n"]: r["line"] for r in compact_states(s, missing).collect()}
    for n in at:
        said[n] = said.pop(n)  # the latest come last
    lines = [said[n] for n in at]
    while len(said) > HELD_STATES:
        said.pop(next(iter(said)))
    return lines


def _sections(s: Session, known: dict[str, list], query: str, want: dict[str, bool], frames: list[int]) -> list[tuple[int, str, list[str]]]:
    """What ``context_lines`` gives, from lines that are held."""
    out = [(0, context.STATES, _states_said(s, frames[:6]))] if frames else []
    lines = lambda kind: [line for _, line, _ in known[kind]]
    rank = lambda kind: 1 if want[kind] else 3
    if want["hud"] or frames:
        asked = [line for name, line, _ in known["hud"] if name.lower() in (query or "").lower()]
        out.append((rank("hud"), context.HUD, asked or lines("hud")))
    if want["text"] or frames:
        out.append((rank("text"), context.TEXTS, lines("text")))
    if want["entities"] or frames:
        out.append((rank("entities"), context.ENTITIES, lines("entities")))
    first = [t for kind in ("flash", "hud", "text", "entities") if want[kind] for t in context.TYPES[kind]]
    counts = Counter(kind for kind, *_ in known["events"])
    out.append((1, context.COUNTS, [", ".join(sorted(f"{k}={n}" for k, n in counts.items()))]))
    out.append((1, context.EVENTS.format(types="/".join(first)), [line for kind, line, _ in known["events"] if kind in first]))
    out.append((4, context.OTHERS, [line for kind, line, _ in known["events"] if kind not in first]))
    return [x for x in out if x[2] or x[1] in (context.HUD, context.COUNTS)]


def compile_context(s: Session, query: str, token_budget: int = 4000) -> dict:
    """What the query needs to know of the session, as text within a budget of estimated tokens.

    The lines of a session with little to say are held on the driver (``ready``); of any other only lines that the budget can hold get there.
    """
    budget = int(token_budget)
    want, frames = context.intents(query), context.frame_references(query, s.fps, s.n_frames)
    if known := ready(s):
        sections, evidence = _sections(s, known, query, want, frames), _held_evidence(known, want, bool(frames))
    else:
        titles, lines = context_lines(s, query, want, frames)
        by_section: dict[int, list[str]] = {}
        for r in context.usable(lines, context.limit_of(budget)).orderBy("section", "place").collect():
            by_section.setdefault(r["section"], []).append(r["line"])
        sections = [(p, title, by_section.get(i, [])) for i, (p, title) in enumerate(titles) if i in by_section or title in (context.HUD, context.COUNTS)]
        evidence = [_bare(r.asDict()) for r in _evidence_rows(s, want, bool(frames)).collect()]
    head = [context.ABOUT.format(name=s.name, last=s.n_frames - 1, fps=s.fps), context.TAGS]
    text = context.laid_out([(0, "HEADER", head), *sections], budget)
    return {
        "context": text, "tokens": context.estimate(text), "token_budget": budget, "evidence": evidence,
        "focus": {k: v for k, v in want.items() if v}, "frames": frames,
    }


def _bare(row: dict) -> dict:
    return {k: v for k, v in row.items() if v is not None or k != "id"}


#: Crops that a context names as evidence.
MOST_EVIDENCE = 20


def _crops(s: Session) -> DataFrame:
    """(f, crop, id, type, ord): crops behind texts (without a type), then behind events."""
    none = F.lit(None).cast("string")
    texts = s.timelines.filter(F.col("path").rlike("^(text|scene)/") & F.col("crop").isNotNull())
    order = F.concat_ws("/", F.lit("0"), "path", F.lpad(F.col("f").cast("string"), 12, "0")), F.concat_ws("/", F.lit("1"), F.lpad(F.col("f_start").cast("string"), 12, "0"), "id")
    seen = event_lines(s).filter(F.col("crop").isNotNull())
    return texts.select("f", "crop", none.alias("id"), none.alias("type"), order[0].alias("ord")).union(seen.select(F.col("crop_f"), "crop", "id", "type", order[1]))


def _evidence_rows(s: Session, want: dict[str, bool], frames: bool) -> DataFrame:
    """(f, crop, id): crops behind texts, if wanted, then behind wanted events; the first of each frame and crop."""
    first = [t for kind, types in context.TYPES.items() if want[kind] for t in types]
    chosen = _crops(s).filter((F.col("type").isNull() & F.lit(want["text"] or frames)) | F.col("type").isin(*first))
    return context.first_of_each(chosen, ("f", "crop"), "ord", MOST_EVIDENCE).select("f", "crop", "id")


def _held_evidence(known: dict[str, list], want: dict[str, bool], frames: bool) -> list[dict]:
    first = {t for kind, types in context.TYPES.items() if want[kind] for t in types}
    out: dict[tuple, dict] = {}
    for kind, line, _ in known["crops"]:
        if (want["text"] or frames) if kind is None else kind in first:
            row = json.loads(line)
            out.setdefault((row["f"], row["crop"]), _bare({"f": row["f"], "crop": row["crop"], "id": row.get("id")}))
    return list(out.values())[:MOST_EVIDENCE]


def reanalyze(s: Session, f0: int, f1: int, region: str | None = None, fidelity: str = "high") -> DataFrame:
    """(f, text, conf, bbox, fidelity, method): the range's frames, all or twelve and the last, read again by the OCR provider in the region's pixels."""
    picked = s.frames.filter(F.col("f").between(int(f0), int(f1))).select("session", "f")
    width, height = s.width or 1000, s.height or 1000  # unknown sizes: thousandths
    box = geometry.region_box(F.lit(region if region not in ("", None) else "all"), width, height)
    at = evenly_sampled(picked, 12, "session").withColumn("box", box)
    asked = F.concat_ws(":", F.col("f").cast("string"), *[F.col(f"box.{c}").cast("string") for c in "xywh"], F.lit(fidelity))
    read = at.withColumn("text", providers.text_udf("ocr")(asked))
    shape = F.array(*[F.col(f"box.{c}") / n for c, n in zip("xywh", (width, height, width, height), strict=True)])
    return read.select("f", "text", F.when(F.length("text") > 0, 0.9).otherwise(0.3).alias("conf"), shape.alias("bbox"), F.lit(fidelity).alias("fidelity"), F.lit("ocr_provider").alias("method"))


def ask(s: Session, question: str, token_budget: int = 4000) -> dict:
    compiled = compile_context(s, question, token_budget)
    full = providers.provider("llm")(f"{compiled['context']}\n\nQUESTION: {question}")
    answer = re.search(r"ANSWER:\s*(.+)", full)
    cited = [{"f": int(x), "crop": None} for x in reversed(re.findall(r"\bf(?:rame)?\s*(\d+)", full))]
    by_frame = {e["f"]: e for e in reversed([*cited, *compiled["evidence"]])}
    order = dict.fromkeys(e["f"] for e in [*cited, *compiled["evidence"]])
    return {"answer": (answer[1] if answer else full.strip().split("\n")[0]).strip(), "full": full, "context_tokens": compiled["tokens"], "evidence": [by_frame[f] for f in order][:10]}


OPS: dict[str, Callable] = {
    "get_state": get_state, "get_changes": get_changes, "get_entity_history": get_entity_history, "get_events": get_events,
    "search_semantics": search_semantics, "get_evidence": get_evidence, "compile_context": compile_context, "reanalyze": reanalyze,
}
#: Parameters of each operation, and other names they answer to.
PARAMS: dict[str, tuple[str, ...]] = {
    "get_state": ("f",), "get_changes": ("f0", "f1"), "get_entity_history": ("entity_id",), "get_events": ("f0", "f1", "type"),
    "search_semantics": ("query",), "get_evidence": ("annotation_id",), "compile_context": ("query", "token_budget"), "reanalyze": ("f0", "f1", "region", "fidelity"),
}
#: Parameters that were added to those.
ADDED = {"search_semantics": ("limit",)}
ALIASES = {"frame": "f", "start": "f0", "end": "f1", "q": "query", "id": "annotation_id", "entity": "entity_id", "budget": "token_budget", "filter": "type"}


def document(op: str, out: DataFrame | dict, params: dict) -> dict:
    """An operation's rows in the shape that a service answers with; rows come to the driver one partition at a time."""
    if isinstance(out, dict):
        return out
    rows = [json.loads(r) for r in out.toJSON().toLocalIterator()]
    opened = lambda x: json.loads(x) if isinstance(x, str) else x
    match op:
        case "get_state":
            root: dict = {}
            for r in rows:
                node = root
                for k in r["path"][:-1]:
                    node = node.setdefault(k, {})
                node[r["path"][-1]] = opened(r["v"])
            return root
        case "get_changes":
            seen = sorted((r for r in rows if r["kind"] != "event"), key=lambda r: r["f"])
            changes = [{"f": r["f"], "kind": "snapshot"} if r["kind"] == "snapshot" else {"f": r["f"], "delta": opened(r["delta"])} for r in seen]
            return {"f0": int(params["f0"]), "f1": int(params["f1"]), "changes": changes, "events": [opened(r["event"]) for r in rows if r["kind"] == "event"]}
        case "get_entity_history":
            history: dict[str, list] = {}
            for r in sorted((r for r in rows if r["kind"] == "value"), key=lambda r: r["f"]):
                history.setdefault(r["attr"], []).append({k: opened(r.get(k)) if k in ("v", "bbox") else r.get(k) for k in ("f", "v", "conf", "source", "f_obs", "bbox", "crop")})
            span = next((r for r in rows if r["kind"] == "span"), {})
            return {"entity_id": params["entity_id"], "first_f": span.get("f"), "last_f": span.get("f_obs"), "history": history, "events": [opened(r["event"]) for r in rows if r["kind"] == "event"]}
        case "get_events":
            return {"count": len(rows), "events": [opened(r["line"]) for r in rows]}
        case "search_semantics":
            kinds = {"event": lambda r, x: {"f": r.get("f"), "id": r["item"], "event": x}, "field": lambda r, x: x | {"v": opened(x.get("v"))}, "summary": lambda r, x: {"window": x}}
            return {"query": params["query"], "count": rows[0]["count"] if rows else 0, "hits": [{"score": r["score"], "kind": r["kind"], **kinds[r["kind"]](r, opened(r["detail"]))} for r in rows]}
        case "get_evidence":
            r = rows[0]
            if "error" in r:
                return {"id": r["id"], "error": r["error"]}
            if "field" not in r:
                return r
            node = opened(r["field"])
            return {"id": r["id"], "claim": r["claim"], "field": node | {k: opened(node.get(k)) for k in ("v", "bbox")}, "evidence": r.get("evidence")}
        case "reanalyze":
            field_of = lambda r: {"v": r["text"], "conf": r["conf"], "source": "observed", "f": r["f"], "bbox": r["bbox"], "crop": None}
            seen = [{"f": r["f"], "text": field_of(r), "fidelity": r["fidelity"], "method": r["method"]} for r in sorted(rows, key=lambda r: r["f"])]
            return {"f0": int(params["f0"]), "f1": int(params["f1"]), "region": params.get("region"), "fidelity": params.get("fidelity", "high"), "observations": seen}
    return {"rows": rows}


def call(s: Session, op: str, params: dict[str, str]) -> tuple[int, object]:
    """As a service would answer: 404 for an unknown operation, 400 for a missing parameter, else 200 and a document."""
    if op not in OPS:
        return 404, {"error": f"unknown op {op}"}
    named = {ALIASES.get(k, k): v for k, v in params.items()}
    given = {k: named[k] for k in PARAMS[op] + ADDED.get(op, ()) if k in named}
    try:
        out = OPS[op](s, **given)
    except TypeError as e:
        return 400, {"error": str(e)}
    return 200, document(op, out, given)
