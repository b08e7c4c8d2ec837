"""SQL table functions and user-defined functions to register on a session."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from chronolith.operators import context


@udtf(returnType="frame: bigint")
class FrameReferences:
    """``SELECT * FROM frame_references('frames 10-20', 60, 4580)``"""

    def eval(self, query: str, fps: float, frames: int):
        for f in context.frame_references(query, float(fps), frames):
            yield (f,)


@udtf(returnType="kind: string, wanted: boolean")
class Intents:
    def eval(self, query: str):
        yield from context.intents(query).items()


@udtf(returnType="seconds: double, trigger: string")
class SamplePoints:
    def eval(self, duration: float, changes: list):
        from chronolith.operators.track import sample_points

        yield from sample_points(float(duration), [float(c) for c in changes or []])


#: Views that the operations in SQL read, by the member of a session that each shows.
VIEWS = {"session_frames": "frames", "session_snapshots": "snapshots", "session_ops": "ops", "session_timelines": "timelines", "session_events": "events", "session_windows": "windows"}

#: The snapshot of a frame is the one whose frames it lies among. Parameters may only stand in conditions; what is known of a
#: session when it is registered ($N: the frame, held within the session; $GAP: its longest stretch without a snapshot) bounds the
#: scan of the operations from both sides by what becomes literals.
_STATE = """WITH latest AS (SELECT path, max_by(struct(op, v), f) AS r, max(f) AS at, max(CASE WHEN op IN ('set', 'del') THEN f END) AS cut
 FROM session_ops JOIN session_snapshots USING (session, snap_f) WHERE session = of_session AND snap_f <= $N AND snap_f >= $N - $GAP AND f <= $N AND f >= $N - $GAP AND until_f >= $N GROUP BY path),
kept AS (SELECT path, at, r.v AS v FROM latest WHERE r.op = 'set'),
above AS (SELECT path AS leaf, at, explode(transform(sequence(1, size(path) - 1), i -> slice(path, 1, i))) AS path FROM kept WHERE size(path) > 1),
dead AS (SELECT DISTINCT leaf FROM above JOIN latest USING (path) WHERE cut >= above.at)
SELECT path, v FROM kept LEFT ANTI JOIN dead ON kept.path = dead.leaf"""
_EVENTS = """SELECT f_start, coalesce(f_end, f_start) AS f_end, id, type, entity, line FROM session_events WHERE session = of_session
AND coalesce(f_end, f_start, 0) >= from_frame AND coalesce(f_start, 0) <= to_frame AND (coalesce(types, '') = '' OR array_contains(split(types, ','), type))"""
_COUNTS = "aggregate(filter(regexp_extract_all(lower(query), '[a-z0-9_]+', 0), w -> length(w) > 1), 0L, (n, w) -> n + (octet_length(lower({0})) - octet_length(replace(lower({0}), w, ''))) div octet_length(w))"
_FIELD = "concat_ws(' ', path, v)"
#: name -> (parameters, columns, query). ``compile_context`` and ``reanalyze`` end in a text and in a model's answers, so they are not SQL.
OPERATIONS = {
    "get_state": ("of_session STRING, at_frame BIGINT", "path ARRAY<STRING>, v STRING", _STATE),
    "get_changes": (
        "of_session STRING, from_frame BIGINT, to_frame BIGINT", "f BIGINT, kind STRING, delta STRING",
        """SELECT f, kind, CASE WHEN kind <> 'snapshot' THEN json END FROM session_frames WHERE session = of_session AND f BETWEEN from_frame AND to_frame AND (kind = 'snapshot' OR coalesce(json, '{}') <> '{}')""",
    ),
    "get_events": ("of_session STRING, from_frame BIGINT, to_frame BIGINT, types STRING DEFAULT ''", "f_start BIGINT, f_end BIGINT, id STRING, type STRING, entity STRING, line STRING", _EVENTS),
    "get_entity_history": (
        "of_session STRING, entity_id STRING", "kind STRING, attr STRING, f BIGINT, v STRING, conf DOUBLE, source STRING, event STRING",
        """SELECT 'value', substr(path, length(entity_id) + 11), f, v, conf, source, CAST(NULL AS STRING) FROM session_timelines WHERE session = of_session AND startswith(path, concat('entities/', entity_id, '/'))
UNION ALL SELECT 'event', NULL, f_start, NULL, NULL, NULL, line FROM session_events WHERE session = of_session AND entity = entity_id""",
    ),
    "search_semantics": (
        "of_session STRING, query STRING", "score BIGINT, kind STRING, item STRING, f BIGINT",
        f"""SELECT score, kind, item, f FROM (SELECT {_COUNTS.format('line')} AS score, 'event' AS kind, id AS item, f_start AS f FROM session_events WHERE session = of_session
UNION ALL SELECT {_COUNTS.format(_FIELD)}, 'field', path, f FROM session_timelines WHERE session = of_session
UNION ALL SELECT {_COUNTS.format('document')}, 'summary', CAST(window AS STRING), NULL FROM session_windows WHERE session = of_session) WHERE score > 0""",
    ),
    "get_evidence": (
        "of_session STRING, annotation_id STRING", "id STRING, claim STRING, f BIGINT, crop STRING, source STRING, confidence DOUBLE",
        """SELECT id, concat_ws(' ', type, entity), coalesce(evidence.f, f_start), evidence.crop, source, confidence FROM session_events WHERE session = of_session AND id = annotation_id
UNION ALL SELECT annotation_id, concat(path, '=', v), coalesce(f_obs, f), crop, source, conf FROM (SELECT *, row_number() OVER (ORDER BY f DESC) AS nth FROM session_timelines
WHERE session = of_session AND path = regexp_extract(annotation_id, '^(.*)@[0-9]+$', 1) AND f <= try_cast(regexp_extract(annotation_id, '@([0-9]+)$', 1) AS BIGINT)) WHERE nth = 1""",
    ),
}


def register_sessions(spark: SparkSession, *sessions) -> None:
    """The operations as SQL table functions over these sessions (``api.Session``): ``SELECT * FROM get_state('clip', 120)``.

    They are plain queries over temporary views, so a filter on a session, a path or a frame around them is pushed
    to the scans of the sessions' tables like any other.
    """
    from functools import reduce

    from pyspark.sql import DataFrame, Window
    from pyspark.sql import functions as F

    from chronolith.operators import fields

    for view, member in VIEWS.items():
        parts = [getattr(s, member) for s in sessions]
        if member == "snapshots":  # with the last frame of each
            parts = [p.select("session", "snap_f", F.coalesce(F.lead("snap_f").over(Window.partitionBy("session").orderBy("snap_f")) - 1, F.lit(s.last)).alias("until_f")) for p, s in zip(parts, sessions, strict=True)]
            gaps = [p.agg(F.coalesce(F.max(F.col("until_f") - F.col("snap_f")), F.lit(0))).first()[0] for p in parts]
        if member == "windows":
            parts = [p.withColumn("document", fields.window_document()) for p in parts]
        # a session is known by its name, whatever the folder that its tables lie in
        reduce(DataFrame.unionByName, [p.withColumn("session", F.lit(s.name)) for p, s in zip(parts, sessions, strict=True)]).createOrReplaceTempView(view)
    quoted = [s.name.replace("\\", "\\\\").replace("'", "\\'") for s in sessions]
    of = lambda values: "CASE of_session " + " ".join(f"WHEN '{q}' THEN {v}L" for q, v in zip(quoted, values, strict=True)) + " END"
    n, gap = f"greatest(least(at_frame, {of([s.last for s in sessions])}), {of([s.first for s in sessions])})", of(gaps)
    for name, (parameters, columns, body) in OPERATIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE ({columns}) RETURN {body.replace('$N', n).replace('$GAP', gap)}")


def register(spark: SparkSession) -> None:
    spark.udtf.register("frame_references", FrameReferences)
    spark.udtf.register("query_intents", Intents)
    spark.udtf.register("sample_points", SamplePoints)
