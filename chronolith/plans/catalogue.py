"""Named queries over the driver's tables, each with the SQL that must agree.

The events table stands for a stream (session = user, path = event type, v = value, f = place in the
session), orders with their lines for intervals and mode strings, documents and conversations for text,
embeddings for signatures.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolith.functions import geometry, signal, text
from chronolith.operators import context, events, fields, intervals, metrics, pixels as px, search, state, stream, summary, timeline, track

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

SV = """sv AS (SELECT user_id AS session, event_type AS path, value AS v, ts, event_id,
 row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS f FROM events)"""
#: Snapshot cadence here: sessions have some dozen rows, not thousands.
EVERY = 10


def query(oracle: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLE_SQL[fn.__name__] = oracle.replace("$SV", SV)
        return fn

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def sv(spark: SparkSession, d: str, *extra: str) -> DataFrame:
    e = t(spark, d, "events")
    return stream.stream_view(e, F.col("user_id"), [F.col("ts"), F.col("event_id")], F.col("event_type"), F.col("value"), *[F.col(c) for c in extra])


# --- state ------------------------------------------------------------------------------------------------

STATE_25 = "WITH $SV SELECT session, path, arg_max(v, f) AS v, max(f) AS since FROM sv WHERE f <= 25 GROUP BY ALL"


@query(STATE_25)
def state_at_frame(spark, d):
    return state.state_at(sv(spark, d), 25)


@query("WITH $SV SELECT session, path, arg_max(v, f) AS v FROM sv WHERE f <= 27 GROUP BY ALL")
def state_from_snapshot(spark, d):
    got = state.reconstruct(state.encode(sv(spark, d), EVERY), 27, nested=False)
    return got.select("session", F.col("path")[0].alias("path"), "v")


DENSE = """d AS (SELECT x.session, x.f, p.path, last_value(s.v IGNORE NULLS) OVER (PARTITION BY x.session, p.path ORDER BY x.f) AS v
 FROM (SELECT session, f FROM sv) x JOIN (SELECT session, path, min(f) AS first FROM sv GROUP BY ALL) p ON x.session = p.session AND x.f >= p.first
 LEFT JOIN sv s ON s.session = x.session AND s.f = x.f AND s.path = p.path)"""


@query(f"WITH $SV, {DENSE} SELECT session, path, count(*) AS frames, sum(cast(round(v * 100) AS BIGINT))::BIGINT AS cents FROM d GROUP BY ALL")
def dense_state(spark, d):
    rows = state.dense(sv(spark, d))
    return rows.groupBy("session", "path").agg(F.count(F.lit(1)).alias("frames"), F.sum(F.round(F.col("v") * 100).cast("bigint")).alias("cents"))


@query("WITH $SV SELECT 0::BIGINT AS n_missing, 0::BIGINT AS n_extra, count(*) AS rows FROM (SELECT DISTINCT session, path, f FROM sv WHERE f <= 40)")
def snapshot_delta_roundtrip(spark, d):
    rows, frames = sv(spark, d), [7, 10, 25, 40]
    want = rows.withColumn("n", F.explode(F.array(*[F.lit(n).cast("bigint") for n in frames]))).filter("f <= n").groupBy("session", "n", "path").agg(F.max_by("v", "f").alias("v"))
    got = state.reconstruct_at(state.encode(rows, EVERY), frames, nested=False).select("session", "n", F.col("path")[0].alias("path"), "v")
    rows40 = rows.filter("f <= 40").select("session", "path", "f").distinct().agg(F.count(F.lit(1)).alias("rows"))
    return metrics.difference(want, got).join(rows40)


CHANGED = "c AS (SELECT *, lag(v) OVER w AS prev, row_number() OVER w AS nth FROM sv WINDOW w AS (PARTITION BY session, path ORDER BY f)), ch AS (SELECT session, path, v, f, prev FROM c WHERE nth = 1 OR v IS DISTINCT FROM prev)"


@query(f"WITH $SV, {CHANGED} SELECT session, path, v, f, prev FROM ch WHERE f BETWEEN 10 AND 20")
def changes_between(spark, d):
    return state.changes_between(sv(spark, d), 10, 20).select("session", "path", "v", "f", "prev")


@query(f"WITH $SV, {CHANGED} SELECT session, path, v, f, prev FROM ch")
def value_timeline(spark, d):
    return state.changed(sv(spark, d)).select("session", "path", "v", "f", "prev")


@query("WITH $SV SELECT session, path, min(f) AS first_f, max(f) AS last_f, count(*) AS n FROM sv GROUP BY ALL")
def entity_first_last(spark, d):
    return timeline.first_last(sv(spark, d), "session", "path")


@query(f"WITH $SV, {CHANGED} SELECT f, 'value' AS kind, v::VARCHAR AS detail FROM ch WHERE session = 7 AND path = 'click' UNION ALL SELECT f, 'event', event_id::VARCHAR FROM sv WHERE session = 7 AND path = 'click'")
def entity_history(spark, d):
    rows = sv(spark, d, "event_id")
    ev = rows.select("session", F.col("path").alias("entity"), "f", F.col("event_id").alias("detail"))
    return timeline.entity_history(state.changed(rows), ev, 7, "click")


PRESENT = "po AS (SELECT *, coalesce((f - lag(f) OVER (PARTITION BY session, path ORDER BY f) > 6)::INT, 1) AS o FROM sv), pk AS (SELECT *, sum(o) OVER (PARTITION BY session, path ORDER BY f) AS k FROM po), pi AS (SELECT session, path, min(f) AS f_start, max(f) AS f_end FROM pk GROUP BY session, path, k)"


@query(f"""WITH $SV, {PRESENT}, n AS (SELECT sv.session, sv.f, count(pi.path) AS n FROM sv LEFT JOIN pi ON pi.session = sv.session AND sv.f BETWEEN pi.f_start AND pi.f_end GROUP BY sv.session, sv.f),
c AS (SELECT *, lag(n) OVER (PARTITION BY session ORDER BY f) AS was FROM n) SELECT session, f, n AS visible FROM c WHERE was IS NULL OR n <> was""")
def visible_count_timeline(spark, d):
    rows = sv(spark, d)
    return fields.visible_counts(timeline.presence(rows, 6), rows).withColumnRenamed("n", "visible")


@query("WITH $SV, s AS (SELECT *, coalesce((f - lag(f) OVER (PARTITION BY session, path ORDER BY f) > 6)::INT, 1) AS o FROM sv), k AS (SELECT *, sum(o) OVER (PARTITION BY session, path ORDER BY f) AS k FROM s) SELECT session, path, min(f) AS f_start, max(f) AS f_end, count(*) AS seen FROM k GROUP BY session, path, k")
def presence_intervals(spark, d):
    return timeline.presence(sv(spark, d), 6).drop("k")


@query("WITH $SV, s AS (SELECT *, f - row_number() OVER (PARTITION BY session, path ORDER BY f) AS k FROM sv) SELECT session, path, min(f) AS f_start, max(f) AS f_end, count(*) AS length FROM s GROUP BY session, path, k")
def event_runs(spark, d):
    return timeline.runs(sv(spark, d), "path", "session")


@query("""WITH $SV, p AS (SELECT session, f, path, path = 'click' AS there FROM sv), c AS (SELECT session, f, there, coalesce(lag(there) OVER (PARTITION BY session ORDER BY f), FALSE) AS was FROM p)
SELECT session, 'click' AS path, f, there FROM c WHERE there <> was""")
def presence_changes(spark, d):
    rows = sv(spark, d)
    return timeline.presence_changes(rows.filter("path = 'click'"), rows)


VIS = """i AS (SELECT *, lead(f) OVER (PARTITION BY session ORDER BY f) AS nx FROM (SELECT *, coalesce(lag(ok) OVER (PARTITION BY session ORDER BY f), FALSE) AS was FROM
 (SELECT session, f, path <> 'error' AND value_ok AS ok FROM (SELECT *, v >= 100 AS value_ok FROM sv))) WHERE ok <> was)"""


@query(f"WITH $SV, {VIS} SELECT session, f AS f_start, coalesce(nx - 1, 99) AS f_end FROM i WHERE ok")
def visible_intervals(spark, d):
    rows = sv(spark, d)
    flag = lambda c: rows.select("session", F.lit("entity").alias("path"), "f", c.alias("v"))
    # present at every frame but errors, and so at the last one or not; an open interval of a present entity ends at frame 99
    out = timeline.visible_intervals(flag(F.lit(True)), flag((F.col("path") != "error") & (F.col("v") >= 100)), 100)
    return out.select("session", "f_start", F.col("f_end").cast("bigint").alias("f_end"))


# --- lookups along time -----------------------------------------------------------------------------------


@query("WITH $SV SELECT session, f, last_value(CASE WHEN path = 'purchase' THEN v END IGNORE NULLS) OVER (PARTITION BY session ORDER BY f) AS last_purchase FROM sv")
def asof_last_purchase(spark, d):
    return timeline.as_of(sv(spark, d), F.when(F.col("path") == "purchase", F.col("v")), "last_purchase", "session").select("session", "f", "last_purchase")


@query("WITH $SV SELECT session, f, last_value(CASE WHEN path = 'purchase' THEN v END IGNORE NULLS) OVER (PARTITION BY session ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM sv")
def strictly_before(spark, d):
    return timeline.as_of(sv(spark, d), F.when(F.col("path") == "purchase", F.col("v")), "earlier", "session", strict=True).select("session", "f", "earlier")


@query("WITH $SV SELECT l.session, l.f, r.v AS signup FROM (SELECT session, f FROM sv WHERE path = 'click') l ASOF LEFT JOIN (SELECT session, f, v FROM sv WHERE path = 'signup') r ON l.session = r.session AND l.f >= r.f")
def asof_join(spark, d):
    rows = sv(spark, d)
    right = rows.filter("path = 'signup'").select("session", "f", F.col("v").alias("signup"))
    return timeline.as_of_join(rows.filter("path = 'click'").select("session", "f"), right, "signup", "session")


@query("""WITH $SV, m AS (SELECT session, f AS g FROM sv WHERE path = 'signup')
SELECT sv.session, sv.f, arg_min(g, abs(g - sv.f) * 1000 + g) AS nearest FROM sv LEFT JOIN m ON m.session = sv.session GROUP BY sv.session, sv.f""")
def nearest_event(spark, d):
    return timeline.nearest(sv(spark, d), F.col("path") == "signup", "nearest", "session").select("session", "f", "nearest")


@query("""WITH $SV, k AS (SELECT session, f, CASE WHEN path = 'view' THEN v END AS x FROM sv), b AS (SELECT *,
 last_value(CASE WHEN x IS NOT NULL THEN f END IGNORE NULLS) OVER p AS af, last_value(x IGNORE NULLS) OVER p AS av,
 first_value(CASE WHEN x IS NOT NULL THEN f END IGNORE NULLS) OVER n AS bf, first_value(x IGNORE NULLS) OVER n AS bv FROM k
 WINDOW p AS (PARTITION BY session ORDER BY f), n AS (PARTITION BY session ORDER BY f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT session, f, round(CASE WHEN af = bf THEN av WHEN af IS NULL THEN bv WHEN bf IS NULL THEN av ELSE av + (bv - av) * (f - af) / (bf - af) END, 8) AS x FROM b""")
def interpolated_value(spark, d):
    out = timeline.interpolated(sv(spark, d), F.when(F.col("path") == "view", F.col("v")), "x", "session")
    return out.select("session", "f", F.round("x", 8).alias("x"))


@query("""WITH h AS (SELECT user_id, date_trunc('day', ts) AS slot, count(*) AS v FROM events GROUP BY ALL), s AS (SELECT user_id, unnest(generate_series(min(slot), max(slot), INTERVAL 1 DAY)) AS slot FROM h GROUP BY user_id)
SELECT s.user_id, s.slot::TIMESTAMP AS slot, h.v IS NULL AS filled, last_value(h.v IGNORE NULLS) OVER (PARTITION BY s.user_id ORDER BY s.slot) AS v FROM s LEFT JOIN h ON h.user_id = s.user_id AND h.slot = s.slot""")
def gap_fill_daily(spark, d):
    rows = t(spark, d, "events").withColumn("day", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    return timeline.gap_filled(rows, "user_id", "interval 1 day", F.min("day"), F.max("day"), F.col("day"), F.count(F.lit(1)))


@query(f"WITH $SV, {CHANGED}, r AS (SELECT *, row_number() OVER (PARTITION BY session, path ORDER BY f) AS n FROM ch) SELECT session, path, f, v FROM r WHERE n = 4")
def kth_change(spark, d):
    return timeline.kth(state.changed(sv(spark, d)), 4, "session", "path").select("session", "path", "f", "v")


@query("WITH $SV SELECT session, min(f) AS f, arg_min(v, f) AS v FROM sv WHERE v > 300 AND path = 'purchase' GROUP BY session")
def first_match(spark, d):
    return timeline.first_match(sv(spark, d), (F.col("v") > 300) & (F.col("path") == "purchase"), "session")


@query("WITH $SV, g AS (SELECT session, path, f, lag(f) OVER (PARTITION BY session, path ORDER BY f) AS gone_f FROM sv) SELECT session, path, gone_f, f AS back_f FROM g WHERE f - gone_f > 12")
def reappearance(spark, d):
    return timeline.reappearances(sv(spark, d), 12)


STABLE = "s AS (SELECT session, f, floor(v / 250)::BIGINT AS level FROM sv), w AS (SELECT *, min(level) OVER x AS lo, max(level) OVER x AS hi, count(*) OVER x AS n FROM s WINDOW x AS (PARTITION BY session ORDER BY f ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))"


@query(f"WITH $SV, {STABLE} SELECT session, min(f) AS f, arg_min(level, f) AS level FROM w WHERE lo = hi AND n = 5 AND f >= 6 AND (f - 6) % 3 = 0 GROUP BY session")
def stable_point(spark, d):
    rows = sv(spark, d).select("session", "f", F.floor(F.col("v") / 250).alias("level"))
    return timeline.stable_points(rows, "level", 2, 6, 3, "session")


@query("SELECT event_id, round(event_id * 1000.0 / 60, 2) AS t_ms, floor(event_id * 1000.0 / 60 * 60 / 1000.0 + 0.001)::BIGINT AS frame FROM events")
def frame_clock(spark, d):
    e = t(spark, d, "events")
    return e.select("event_id", signal.frame_to_ms(F.col("event_id"), 60.0).alias("t_ms"), signal.ms_to_frame(F.col("event_id") * 1000.0 / 60 + 0.001 * 1000 / 60, 60.0).alias("frame"))


# --- intervals and joins ----------------------------------------------------------------------------------

ORDER_SPANS = "o AS (SELECT o_orderkey AS id, o_orderstatus AS type, o_orderdate AS a, max(l_shipdate) AS b FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)"


def order_spans(spark, d):
    last = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("b"))
    o = t(spark, d, "orders")
    return o.join(last, o["o_orderkey"] == last["l_orderkey"], "left").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("type"), F.col("o_orderdate").alias("a"), "b")


@query(f"WITH {ORDER_SPANS} SELECT id, type, a, b FROM o WHERE coalesce(b, a) >= TIMESTAMP '1996-03-01' AND a <= TIMESTAMP '1996-03-31' AND type IN ('F', 'P')")
def events_overlapping(spark, d):
    found = intervals.overlapping(order_spans(spark, d), F.expr("timestamp_ntz'1996-03-01'"), F.expr("timestamp_ntz'1996-03-31'"), F.col("a"), F.col("b"))
    return intervals.of_types(found, "F,P")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY ALL")
def event_counts(spark, d):
    return summary.counts_by(t(spark, d, "events"), "event_type")


@query("WITH $SV, w AS (SELECT range AS w, range * 15 AS lo, range * 15 + 9 AS hi FROM range(6)) SELECT w, session, count(*) AS n FROM sv JOIN w ON f BETWEEN lo AND hi GROUP BY ALL")
def range_join(spark, d):
    w = spark.range(6).select(F.col("id").alias("w"), (F.col("id") * 15).alias("lo"), (F.col("id") * 15 + 9).alias("hi"))
    return intervals.range_join(sv(spark, d).select("session", "f"), "f", w, "lo", "hi", 15).groupBy("w", "session").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH $SV, a AS (SELECT session, f FROM sv WHERE path = 'error'), b AS (SELECT session, f AS g, v FROM sv WHERE path = 'purchase')
SELECT session, f, min(abs(f - g)) AS gap, arg_min(g, abs(f - g) * 1000 + g) AS g, arg_min(v, abs(f - g) * 1000 + g) AS v FROM a JOIN b USING (session) WHERE abs(f - g) <= 8 GROUP BY session, f""")
def nearest_join(spark, d):
    rows = sv(spark, d)
    left = rows.filter("path = 'error'").select("session", "f")
    return intervals.nearest_join(left, rows.filter("path = 'purchase'").select("session", F.col("f").alias("g"), "v"), "session", "f", "g", 8)


@query("SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000) AND c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) GROUP BY ALL")
def semi_anti_join(spark, d):
    c, o, n = t(spark, d, "customer"), t(spark, d, "orders"), t(spark, d, "nation")
    rich = o.filter("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    far = n.filter("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    return c.join(rich, "c_custkey", "left_semi").join(far, "c_nationkey", "left_anti").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


# --- aggregates -------------------------------------------------------------------------------------------

MODES = "m AS (SELECT l_orderkey, string_agg(CASE WHEN l_returnflag = 'R' THEN 'R' WHEN l_linestatus = 'O' THEN 'C' WHEN l_returnflag = 'A' THEN 'P' ELSE 'V' END, '') AS modes FROM lineitem GROUP BY l_orderkey)"


def mode_strings(spark, d):
    flag = F.when(F.col("l_returnflag") == "R", "R").when(F.col("l_linestatus") == "O", "C").when(F.col("l_returnflag") == "A", "P").otherwise("V")
    return t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list(flag)), "").alias("modes"))


@query(f"WITH {MODES} SELECT mode, count(*) AS n FROM (SELECT unnest(string_split(modes, '')) AS mode FROM m) WHERE mode <> '' GROUP BY mode")
def mode_histogram(spark, d):
    return summary.mode_histogram(mode_strings(spark, d))


@query(f"WITH {MODES}, h AS (SELECT unnest(string_split(modes, '')) AS mode FROM m) SELECT count(*) FILTER (mode IN ('C', 'P', 'V')) AS skipped, count(*) AS total, round(count(*) FILTER (mode IN ('C', 'P', 'V')) / count(*), 4) AS ratio FROM h WHERE mode <> ''")
def skip_ratio(spark, d):
    return summary.skip_ratio(summary.mode_histogram(mode_strings(spark, d)))


@query("SELECT time_bucket(INTERVAL '6 hours', ts) AS start, count(*) AS n, count(DISTINCT event_type) AS kinds, arg_max(value, ts) AS last_value, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS seen FROM events GROUP BY 1")
def tumbling_summary(spark, d):
    e = t(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    out = summary.tumbling(e, F.window("at", "6 hours"), "value", "at", "event_type")
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n", "kinds", "last_value", "seen")


@query("WITH $SV, r AS (SELECT session, f // 10 AS w, f, event_id, row_number() OVER (PARTITION BY session, f // 10 ORDER BY f) AS r FROM sv WHERE path <> 'error') SELECT session, w AS \"window\", string_agg(event_id::VARCHAR, ',' ORDER BY f) AS items FROM r WHERE r <= 5 GROUP BY ALL")
def window_highlights(spark, d):
    rows = sv(spark, d, "event_id").filter("path <> 'error'")
    return summary.highlights(rows, F.expr("f div 10"), "f", F.col("event_id"), 5, "session")


@query("SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean FROM events GROUP BY ALL")
def mean_conf_by_source(spark, d):
    return summary.mean_by(t(spark, d, "events"), "value", "event_type")


@query("SELECT 'event_type' AS field, count(*) FILTER (event_type IS NULL OR event_type NOT IN ('click', 'view', 'purchase')) AS missing FROM events UNION ALL SELECT 'value', count(*) FILTER (value IS NULL) FROM events UNION ALL SELECT 'props', count(*) FILTER (props IS NULL) FROM events")
def provenance_missing(spark, d):
    return summary.missing_fields(t(spark, d, "events"), ("event_type", "value", "props"), {"event_type": ("click", "view", "purchase")})


@query(f"""WITH $SV, {CHANGED}, {DENSE}, a AS (SELECT count(*) AS dense_rows FROM d), b AS (SELECT count(*) AS change_rows FROM ch)
SELECT dense_rows, change_rows, round(dense_rows / change_rows, 4) AS ratio FROM a, b""")
def compression_ratio(spark, d):
    rows = sv(spark, d)
    a, b = state.dense(rows).agg(F.count(F.lit(1)).alias("dense_rows")), state.changed(rows).agg(F.count(F.lit(1)).alias("change_rows"))
    return a.join(b).withColumn("ratio", F.round(F.col("dense_rows") / F.col("change_rows"), 4))


@query("SELECT p_brand, round(quantile_cont(p_retailprice, 0.8), 4) AS p80, round(median(p_retailprice), 4) AS middle FROM part GROUP BY p_brand")
def percentile_area(spark, d):
    return t(spark, d, "part").groupBy("p_brand").agg(F.round(F.percentile("p_retailprice", 0.8), 4).alias("p80"), F.round(F.median("p_retailprice"), 4).alias("middle"))


HIST = "b AS (SELECT user_id, least(7, floor(value / 62.5)::INT) AS bin, count(*) AS n FROM events GROUP BY ALL), h AS (SELECT u.user_id, list(coalesce(b.n, 0)::DOUBLE / u.total ORDER BY r.bin) AS hist FROM (SELECT user_id, count(*) AS total FROM events GROUP BY 1) u CROSS JOIN (SELECT range::INT AS bin FROM range(8)) r LEFT JOIN b ON b.user_id = u.user_id AND b.bin = r.bin GROUP BY u.user_id)"


@query(f"WITH {HIST} SELECT x.user_id, round(0.5 * list_sum(list_transform(list_zip(x.hist, y.hist), lambda z: abs(z[1] - z[2]))), 6) AS distance FROM h x JOIN h y ON y.user_id = x.user_id + 1")
def hist64_distance(spark, d):
    binned = t(spark, d, "events").groupBy("user_id").agg(*[F.count_if(F.least(F.lit(7), F.floor(F.col("value") / 62.5).cast("int")) == i).alias(f"b{i}") for i in range(8)], F.count(F.lit(1)).alias("n"))
    h = binned.select("user_id", F.array(*[F.col(f"b{i}") / F.col("n") for i in range(8)]).alias("hist"))
    nxt = h.select((F.col("user_id") - 1).alias("user_id"), F.col("hist").alias("other"))
    # scaled before it is rounded, as in the SQL: Spark rounds the decimal that a double prints as, which differs near ties
    return h.join(nxt, "user_id").select("user_id", (F.round(signal.half_l1(F.col("hist"), F.col("other")) * 1e6) / 1e6).alias("distance"))


# --- detection --------------------------------------------------------------------------------------------


@query("""WITH $SV, w AS (SELECT session, f, v, lag(v) OVER x AS ref, lead(v, 1) OVER x AS one, lead(v, 2) OVER x AS two FROM sv WINDOW x AS (PARTITION BY session ORDER BY f))
SELECT session, f, v, ref, CASE WHEN abs(one - ref) < 60 THEN 1 ELSE 2 END AS length FROM w WHERE abs(v - ref) >= 200 AND (abs(one - ref) < 60 OR abs(two - ref) < 60)""")
def transient_spikes(spark, d):
    return events.transients(sv(spark, d), 200, 60, "session").select("session", "f", "v", "ref", "length")


@query("""WITH $SV, w AS (SELECT session, f, v, lag(v) OVER x AS ref, lead(v, 1) OVER x AS one, lead(v, 2) OVER x AS two FROM sv WINDOW x AS (PARTITION BY session ORDER BY f))
SELECT session, f, v, ref FROM w WHERE abs(v - ref) >= 150 AND abs(one - ref) >= 150 AND abs(two - ref) >= 150""")
def level_shift_cuts(spark, d):
    return events.level_shifts(sv(spark, d), 150, "session").select("session", "f", "v", "ref")


@query("SELECT event_id, CASE WHEN value > 480 THEN 'F' WHEN event_type = 'error' THEN 'V' WHEN value < 6 THEN 'C' WHEN event_type = 'signup' THEN 'V' WHEN value > 45 AND event_type <> 'view' THEN 'R' WHEN event_type = 'view' THEN 'P' ELSE 'V' END AS mode FROM events")
def region_schedule(spark, d):
    kind = F.col("event_type")
    return t(spark, d, "events").select("event_id", events.region_mode(F.col("value") > 480, kind == "error", F.col("value"), kind == "signup", kind == "view").alias("mode"))


@query("""WITH $SV, a AS (SELECT session, f, last_value(CASE WHEN path = 'view' THEN f END IGNORE NULLS) OVER (PARTITION BY session ORDER BY f) AS anchor_f FROM sv)
SELECT session, f, anchor_f, round(0.9 * pow(0.995, f - anchor_f), 6) AS conf, CASE WHEN f = anchor_f THEN 'observed' ELSE 'propagated' END AS source FROM a WHERE anchor_f IS NOT NULL""")
def confidence_decay(spark, d):
    return events.confidences(sv(spark, d), F.col("path") == "view", 0.9, "session").select("session", "f", "anchor_f", "conf", "source")


@query("""WITH $SV, l AS (SELECT session, f, list(path) OVER (PARTITION BY session ORDER BY f ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS reads FROM sv)
SELECT session, f, list_sort(list_filter(list_distinct(reads), lambda x: len(list_filter(reads, lambda y: y = x)) >= 4))[1] AS vote FROM l""")
def vote_last7(spark, d):
    return events.majority(sv(spark, d), "path", 4, 7, "session").select("session", "f", "vote")


@query("WITH $SV, w AS (SELECT session, path, f, v, lag(v) OVER (PARTITION BY session, path ORDER BY f) AS old FROM sv) SELECT session, path, f, v * 100 AS v, old FROM w WHERE v * 100 <> old AND abs(v * 100 - old) > greatest(1000, 10 * abs(old))")
def plausible_jump(spark, d):
    rows = sv(spark, d).withColumn("old", F.lag("v").over(Window.partitionBy("session", "path").orderBy("f"))).withColumn("v", F.col("v") * 100)
    return rows.filter(events.implausible(F.col("v"), F.col("old"))).select("session", "path", "f", "v", "old")


@query("WITH $SV, w AS (SELECT session, path, f, lead(f) OVER (PARTITION BY session, path ORDER BY f) - f AS gap FROM sv) SELECT session, path, f, gap, CASE WHEN gap >= 15 THEN 'removed' WHEN gap >= 4 THEN 'hidden' ELSE 'kept' END AS fate FROM w")
def hysteresis_gaps(spark, d):
    return events.gaps(sv(spark, d), F.col("f"), 4, 15, "session", "path").select("session", "path", "f", "gap", "fate")


@query("WITH $SV, s AS (SELECT *, f - row_number() OVER (PARTITION BY session, path ORDER BY f) AS k FROM sv), r AS (SELECT session, path, min(f) AS f_start, max(f) AS f_end, count(*) AS length FROM s GROUP BY session, path, k) SELECT * FROM r WHERE f_end // 5 * 5 >= f_start")
def one_fps_baseline(spark, d):
    return summary.sampled_seconds(timeline.runs(sv(spark, d), "path", "session"), 5)


@query("""WITH $SV, c AS (SELECT session, f, row_number() OVER (PARTITION BY session ORDER BY f) - 1 AS i, count(*) OVER (PARTITION BY session) AS c FROM sv)
SELECT session, f FROM c WHERE c <= 12 OR i = c - 1 OR i IN (SELECT floor(k * c / 12)::BIGINT FROM (SELECT range AS k FROM range(12)))""".replace("i IN (SELECT floor(k * c / 12)::BIGINT FROM (SELECT range AS k FROM range(12)))", "list_contains(list_transform(range(12), lambda k: (k * c) // 12), i)"))
def evenly_sampled(spark, d):
    return summary.evenly_sampled(sv(spark, d).select("session", "f"), 12, "session")


@query("SELECT checksum, min(doc_id) AS doc_id, count(*) AS copies FROM (SELECT md5(text) AS checksum, doc_id FROM documents) GROUP BY 1")
def dedupe_by_checksum(spark, d):
    return events.once_by_checksum(t(spark, d, "documents"), F.col("text"), "doc_id")


@query("""WITH $SV, fl AS (SELECT session, f - 1 AS f_start, f AS f_end FROM sv WHERE path = 'error' AND f > 0), c AS (SELECT session, f FROM sv WHERE path = 'purchase'),
j AS (SELECT c.session, c.f, min(fl.f_start) AS s FROM c LEFT JOIN fl ON fl.session = c.session AND c.f BETWEEN fl.f_start AND fl.f_end + 2 GROUP BY ALL)
SELECT session, f, coalesce(s, f) AS f_eff, CASE WHEN s IS NULL THEN 'observed' ELSE 'inferred' END AS source, CASE WHEN s IS NULL THEN 0.9 ELSE 0.75 END::DOUBLE AS conf FROM j""")
def backdated_changes(spark, d):
    rows = sv(spark, d)
    flashes = rows.filter("path = 'error' AND f > 0").select("session", (F.col("f") - 1).alias("f_start"), F.col("f").alias("f_end"))
    return events.backdated(rows.filter("path = 'purchase'").select("session", "f"), flashes)


@query("""WITH $SV, p AS (SELECT session, path, f, v / 500 AS x, (event_id % 100) / 100 AS y FROM sv), s AS (SELECT session, path, arg_min(x, f) AS x0, arg_min(y, f) AS y0 FROM p GROUP BY ALL)
SELECT session, path, count(*) AS hits, round(max(sqrt((x - x0) * (x - x0) + (y - y0) * (y - y0))), 6) AS moved, min(f) AS f_start FROM p JOIN s USING (session, path) GROUP BY ALL HAVING count(*) >= 10""")
def confirmed_tracks(spark, d):
    rows = sv(spark, d, "event_id").select("session", "path", "f", (F.col("v") / 500).alias("x"), (F.col("event_id") % 100 / 100).alias("y"))
    return events.confirmed(rows).withColumn("moved", F.round("moved", 6))


# --- text -------------------------------------------------------------------------------------------------

COUNT = lambda col, w: f"((length({col}) - length(replace({col}, '{w}', ''))) // {len(w)})"
WORDS = ("license", "the", "token", "the")
SCORE = lambda col: "(" + " + ".join(COUNT(f"lower({col})", w) for w in WORDS) + ")"


@query(f"SELECT {SCORE('text')} AS score, 'document' AS kind, doc_id::VARCHAR AS item, doc_id AS f FROM documents WHERE {SCORE('text')} > 0 ORDER BY 1 DESC, doc_id LIMIT 50")
def search_documents(spark, d):
    return search.ranked([search.hits(t(spark, d, "documents"), "document", F.col("doc_id"), F.col("doc_id"), F.col("text"), "license the token, THE!")])


@query(f"""WITH h AS (SELECT {SCORE('text')} AS score, 'document' AS kind, doc_id::VARCHAR AS item, doc_id AS f, 0 AS ord FROM documents
UNION ALL SELECT {SCORE('text')}, 'conversation', conv_id || '/' || turn, turn, 1 FROM conversations UNION ALL SELECT {SCORE('event_type')}, 'event', event_id::VARCHAR, event_id, 2 FROM events)
SELECT score, kind, item, f FROM h WHERE score > 0 ORDER BY score DESC, f, ord, item LIMIT 50""")
def search_union(spark, d):
    q = "license the token the"
    c, e = t(spark, d, "conversations"), t(spark, d, "events")
    return search.ranked([
        search.hits(t(spark, d, "documents"), "document", F.col("doc_id"), F.col("doc_id"), F.col("text"), q),
        search.hits(c, "conversation", F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")), F.col("turn"), F.col("text"), q),
        search.hits(e, "event", F.col("event_id"), F.col("event_id"), F.col("event_type"), q),
    ])


@query("WITH $SV SELECT session, 'click@30' AS id, 'click=' || arg_max(v, f)::VARCHAR || ' at f30' AS claim, max(f) AS observed_f FROM sv WHERE path = 'click' AND f <= 30 GROUP BY session")
def evidence_lookup(spark, d):
    rows = sv(spark, d, "event_id")
    ev = rows.select("session", F.col("event_id").cast("string").alias("id"), F.col("path").alias("type"), "f", F.col("v").cast("string").alias("detail"))
    return search.evidence(rows, ev, "click@30")


@query("""WITH n AS (SELECT event_id, event_id % 4 AS k, floor(value)::BIGINT AS a, event_id % 13 AS b FROM events)
SELECT event_id, CASE k WHEN 1 THEN 'ammo' WHEN 3 THEN 'lives' ELSE 'health' END AS key, CASE k WHEN 1 THEN b WHEN 3 THEN NULL ELSE a END AS val,
 CASE k WHEN 0 THEN 'health=' || a WHEN 1 THEN 'score=' || (-a) || ',ammo=' || b WHEN 2 THEN 'ammo=' || b || ',health=' || a ELSE 'gold=0' END AS pairs FROM n""")
def parse_hud_text(spark, d):
    a, b, k = F.floor("value").cast("string"), (F.col("event_id") % 13).cast("string"), F.col("event_id") % 4
    line = F.when(k == 0, F.concat(F.lit("HP: "), a)).when(k == 1, F.concat(F.lit("SCORE |-"), a, F.lit(" ammo "), b)).when(k == 2, F.concat(F.lit("ammo: "), b, F.lit(" hp: "), a)).otherwise(F.concat(F.lit("Lives of one "), a, F.lit(" gold o")))
    lines = t(spark, d, "events").select("event_id", line.alias("line"))
    # a score of -0 is 0
    pairs = F.array_join(F.transform(text.hud_pairs(F.col("line")), lambda p: F.concat_ws("=", p["key"], p["value"].cast("string"))), ",")
    return lines.select("event_id", text.hud_key(F.col("line")).alias("key"), text.hud_value(F.col("line")).alias("val"), pairs.alias("pairs"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 1 THEN NULL ELSE floor(value * 100)::BIGINT END AS amount, CASE WHEN floor(value) >= 10 THEN floor(value)::BIGINT END AS number FROM events""")
def parse_currency(spark, d):
    # $1,234 and $ 1,234 count; +$25 (a change, not a total) does not; <95> is a number, $95 and 7 are none
    sign = F.when(F.col("event_id") % 4 == 1, "+$").when(F.col("event_id") % 4 == 2, "gold $ ").otherwise("gold $")
    money = F.concat(sign, F.format_number(F.floor(F.col("value") * 100), 0))
    plain = F.concat(F.lit(" <"), F.floor("value").cast("string"), F.lit("> "))
    return t(spark, d, "events").select("event_id", text.currency(money).alias("amount"), text.plain_number(plain).alias("number"))


@query("SELECT event_id, event_type AS type, (event_id % 13)::VARCHAR AS n FROM events")
def log_kv_parse(spark, d):
    from chronolith.sources import logs

    line = F.concat(F.lit("2024-01-01T00:00:00Z stage type="), F.col("event_type"), F.lit(" n="), (F.col("event_id") % 13).cast("string"))
    p = t(spark, d, "events").select("event_id", logs.parse(line).alias("p"))
    return p.select("event_id", F.col("p.fields")["type"].alias("type"), F.col("p.fields")["n"].alias("n"))


@query("SELECT doc_id, (floor(length(text) / 3.5) + 1)::BIGINT AS tokens FROM documents")
def token_estimate(spark, d):
    return t(spark, d, "documents").select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


@query("WITH r AS (SELECT conv_id, turn, sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS used FROM conversations) SELECT conv_id, turn, used FROM r WHERE used <= 600")
def context_budget_fill(spark, d):
    return context.filled(t(spark, d, "conversations"), F.col("text"), 600, "conv_id", order="turn").select("conv_id", "turn", "used")


@query("SELECT doc_id, coalesce(len(list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda w: length(w) > 1)), 0)::INT AS n FROM documents")
def tokenised_words(spark, d):
    return t(spark, d, "documents").select("doc_id", F.size(text.tokens(F.col("text"))).alias("n"))


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS norm, left(sha256(p_name), 16) AS digest, regexp_extract(p_brand, '(-?[0-9]+)', 1)::BIGINT AS num FROM part")
def graded_text(spark, d):
    p = t(spark, d, "part")
    return p.select("p_partkey", text.normalise_text(F.col("p_name")).alias("norm"), text.digest16(F.col("p_name")).alias("digest"), text.first_integer(F.col("p_brand")).alias("num"))


# --- signatures, boxes, graphs ----------------------------------------------------------------------------


@query("""WITH a AS (SELECT * FROM embeddings WHERE vec_id % 100 = 0),
p AS (SELECT a.vec_id, b.vec_id AS other, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: abs(z[1]::DOUBLE - z[2]::DOUBLE))) AS dist FROM a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id)
SELECT vec_id, arg_min(other, dist) AS other, round(min(dist), 4) AS dist FROM p GROUP BY vec_id""")
def embedding_l1_reid(spark, d):
    e = t(spark, d, "embeddings")
    lost = e.filter("vec_id % 100 = 0")
    seen = e.select(F.col("vec_id").alias("other"), F.col("embedding").alias("sig"), "label")
    pairs = lost.join(seen, "label").filter("other <> vec_id").withColumn("dist", signal.l1(F.col("embedding"), F.col("sig")))
    return pairs.groupBy("vec_id").agg(F.min_by("other", "dist").alias("other"), F.round(F.min("dist"), 4).alias("dist"))


#: Forty events make a frame; the first twenty are truth, the others found.
BOXES = """b AS (SELECT event_id // 40 AS f, event_id % 40 AS id, (value / 700) AS x, ((event_id * 37) % 100) / 140.0::DOUBLE AS y, 0.25::DOUBLE AS w, 0.3::DOUBLE AS h FROM events),
pr AS (SELECT a.f, a.id AS tid, c.id AS eid, greatest(0, least(a.x + a.w, c.x + c.w) - greatest(a.x, c.x)) * greatest(0, least(a.y + a.h, c.y + c.h) - greatest(a.y, c.y)) AS i
 FROM b a JOIN b c ON a.f = c.f WHERE a.id < 20 AND c.id >= 20), io AS (SELECT f, tid, eid, i / (0.15 - i) AS iou FROM pr)"""


def boxes(spark, d):
    e = t(spark, d, "events")
    b = e.select(F.expr("event_id div 40").alias("f"), (F.col("event_id") % 40).alias("id"), (F.col("value") / 700).alias("x"), (F.col("event_id") * 37 % 100 / 140.0).alias("y"), F.lit(0.25).alias("w"), F.lit(0.3).alias("h"))
    return b.filter("id < 20"), b.filter("id >= 20")


@query(f"WITH {BOXES} SELECT f, tid, eid, round(iou, 6) AS iou FROM io WHERE iou >= 0.3")
def iou_pairs(spark, d):
    return metrics.candidate_pairs(*boxes(spark, d)).withColumn("iou", F.round("iou", 6))


@query()
def greedy_matching(spark, d):
    return metrics.greedy_matches(metrics.candidate_pairs(*boxes(spark, d)))


@query(f"WITH {BOXES}, r AS (SELECT f, tid, arg_max(eid, iou * 1000 - eid * 1e-9) AS eid FROM io WHERE iou >= 0.3 GROUP BY f, tid), l AS (SELECT *, lag(eid) OVER (PARTITION BY tid ORDER BY f) AS p FROM r) SELECT tid, count(*) AS matches, count(*) FILTER (p <> eid) AS switches FROM l GROUP BY tid")
def identity_switches(spark, d):
    return metrics.identity_switches(metrics.best_matches(metrics.candidate_pairs(*boxes(spark, d))))


@query("WITH b AS (SELECT event_id, least(7, greatest(0, floor(value / 700 * 8)))::INT AS c0, least(7, greatest(0, floor((value / 700 + 0.25) * 8)))::INT AS c1 FROM events) SELECT event_id, list_transform(range(c0, c1 + 1), lambda c: c + 8)::INT[] AS cells FROM b".replace("::INT[] AS cells", "::VARCHAR AS cells"))
def grid_cells(spark, d):
    e = t(spark, d, "events")
    cells = geometry.cells(F.col("value") / 700, F.lit(0.2), F.lit(0.25), F.lit(0.1))
    return e.select("event_id", F.concat(F.lit("["), F.array_join(cells.cast("array<string>"), ", "), F.lit("]")).alias("cells"))


@query("SELECT event_id, list_reduce(list_prepend(0::BIGINT, list_transform(range(15, -1, -1), lambda i: ((event_id >> i) & 1)::BIGINT)), lambda a, b: a * 2 + b) AS code FROM events")
def barcode_fold(spark, d):
    bits = F.array(*[F.shiftright("event_id", i).bitwiseAND(F.lit(1)) for i in range(15, -1, -1)])
    return t(spark, d, "events").select("event_id", signal.fold_bits(bits).alias("code"))


@query("SELECT o_custkey AS src, 'bought' AS rel, l_partkey AS dst, min(l_shipdate) AS start, max(l_shipdate) AS \"end\", count(*) AS seen FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey, l_partkey")
def relationship_edges(spark, d):
    o, l = t(spark, d, "orders"), t(spark, d, "lineitem")
    pairs = l.select("l_orderkey", "l_partkey", "l_shipdate").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return search.relationships(pairs, F.col("o_custkey"), "bought", F.col("l_partkey"), F.col("l_shipdate"))


@query("WITH $SV, c AS (SELECT session, path, v, f, event_id % 3 AS version FROM sv) SELECT session, path, arg_max(v, version * 100000 + f) AS v, max(version) AS version FROM c GROUP BY ALL")
def corrections_latest(spark, d):
    rows = sv(spark, d, "event_id").withColumn("version", F.col("event_id") % 3)
    return search.corrected(rows, "session", "path")


@query("SELECT event_id, round(0.6 * value / 500 + 0.3 * (event_type = 'error')::INT - 0.1 * (event_id % 10) / 10, 6) AS importance FROM events")
def importance_score(spark, d):
    e = t(spark, d, "events")
    s = {"change": F.col("value") / 500, "event": (F.col("event_type") == "error").cast("double"), "age": F.col("event_id") % 10 / 10}
    return e.select("event_id", F.round(signal.importance(s, {"change": 0.6, "event": 0.3, "age": -0.1}), 6).alias("importance"))


@query("WITH e AS (SELECT count(*) AS truths FROM events WHERE event_type = 'purchase'), h AS (SELECT count(*) AS hits FROM events WHERE event_type = 'purchase' AND floor(value)::VARCHAR IN (SELECT floor(value)::VARCHAR FROM events WHERE event_type = 'view')) SELECT truths, hits FROM e, h")
def exact_value_matches(spark, d):
    e = t(spark, d, "events").withColumn("level", F.floor("value"))
    return metrics.exact_matches(e.filter("event_type = 'purchase'"), e.filter("event_type = 'view'"), "level")


# --- sequential kernels (not expressible in SQL) -----------------------------------------------------------


#: The rows of each path, numbered, for recursive queries that walk from one to the next.
WALK = "o AS (SELECT session, path, f, v, row_number() OVER (PARTITION BY session, path ORDER BY f) AS n FROM sv)"


@query(f"""WITH RECURSIVE $SV, {WALK}, r AS (SELECT session, path, f, v, n, v AS last, TRUE AS emit FROM o WHERE n = 1 UNION ALL
SELECT o.session, o.path, o.f, o.v, o.n, CASE WHEN abs(o.v - r.last) >= 120 THEN o.v ELSE r.last END, abs(o.v - r.last) >= 120 FROM r JOIN o ON o.session = r.session AND o.path = r.path AND o.n = r.n + 1)
SELECT session, path, f, v FROM r WHERE emit""")
def dead_band(spark, d):
    return track.dead_band(sv(spark, d), 120.0)


@query(f"""WITH RECURSIVE $SV, {WALK}, r AS (SELECT session, path, f, n, f AS last, TRUE AS emit FROM o WHERE n = 1 UNION ALL
SELECT o.session, o.path, o.f, o.n, CASE WHEN o.f - r.last >= 9 THEN o.f ELSE r.last END, o.f - r.last >= 9 FROM r JOIN o ON o.session = r.session AND o.path = r.path AND o.n = r.n + 1)
SELECT session, path, f FROM r WHERE emit""")
def spaced_samples(spark, d):
    return track.spaced(sv(spark, d), 9)


@query(f"""WITH RECURSIVE $SV, {WALK}, m AS (SELECT *, f // 20 AS anchor, CASE WHEN f % 7 = 0 THEN 'observed' ELSE 'propagated' END AS source FROM o),
r AS (SELECT session, path, f, n, v AS last, anchor, source, TRUE AS emit FROM m WHERE n = 1 UNION ALL
SELECT m.session, m.path, m.f, m.n, CASE WHEN abs(m.v - r.last) >= 120 OR m.anchor <> r.anchor OR m.source <> r.source THEN m.v ELSE r.last END,
 CASE WHEN abs(m.v - r.last) >= 120 OR m.anchor <> r.anchor OR m.source <> r.source THEN m.anchor ELSE r.anchor END, CASE WHEN abs(m.v - r.last) >= 120 OR m.anchor <> r.anchor OR m.source <> r.source THEN m.source ELSE r.source END,
 abs(m.v - r.last) >= 120 OR m.anchor <> r.anchor OR m.source <> r.source FROM r JOIN m ON m.session = r.session AND m.path = r.path AND m.n = r.n + 1)
SELECT session, path, f, source, anchor AS anchor_f FROM r WHERE emit""")
def emitted_boxes(spark, d):
    rows = sv(spark, d).select("session", "path", "f", F.array("v", F.lit(1.0)).alias("box"), F.when(F.col("f") % 7 == 0, "observed").otherwise("propagated").alias("source"), F.expr("f div 20").alias("anchor_f"))
    return track.emitted_boxes(rows, 120.0).drop("box")


GRANTS = """WITH RECURSIVE $SV, o AS (SELECT session, f, v > 250 AS wanted, row_number() OVER (PARTITION BY session ORDER BY f) AS n FROM sv), r AS (
SELECT session, f, n, wanted, wanted AND 1 <= 0.1::DOUBLE + 2 AND 0 < {cap} AS granted, (wanted AND 1 <= 0.1::DOUBLE + 2 AND 0 < {cap})::INT AS so_far FROM o WHERE n = 1 UNION ALL
SELECT o.session, o.f, o.n, o.wanted, o.wanted AND r.so_far + 1 <= 0.1::DOUBLE * o.n + 2 AND r.so_far < {cap}, r.so_far + (o.wanted AND r.so_far + 1 <= 0.1::DOUBLE * o.n + 2 AND r.so_far < {cap})::INT
FROM r JOIN o ON o.session = r.session AND o.n = r.n + 1) SELECT session, f, wanted, granted FROM r"""


@query(GRANTS.format(cap=10**6))
def budgeted_grants(spark, d):
    return track.budgeted(sv(spark, d).withColumn("wanted", F.col("v") > 250), 0.1, 2)


@query(GRANTS.format(cap=3))
def capped_grants(spark, d):
    return track.budgeted(sv(spark, d).withColumn("wanted", F.col("v") > 250), 0.1, 2, track.model_cap(80))


@query()
def voted_changes(spark, d):
    return track.voted_changes(sv(spark, d).withColumn("v", F.floor(F.col("v") / 250) * 250.0), 60.0)


@query()
def tracked_boxes(spark, d):
    rows = sv(spark, d).select("session", "f", (F.col("v") / 5000 + F.col("f") / 500).alias("x"), F.lit(0.4).alias("y"), F.lit(0.05).alias("w"), F.lit(0.05).alias("h"))
    return track.tracked(rows, 5.0)


# --- inherited from Spark -----------------------------------------------------------------------------------

CENTS = "sum(cast(round(l_extendedprice * 100) AS BIGINT))::BIGINT AS cents"


@query(f"SELECT l_returnflag, l_linestatus, {CENTS}, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_sales(spark, d):
    return t(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("cents"), F.count(F.lit(1)).alias("n"))


@query("SELECT r_name, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def rollup_sales(spark, d):
    c, n, r = t(spark, d, "customer"), t(spark, d, "nation"), t(spark, d, "region")
    joined = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return joined.rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n FROM ((SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def set_ops(spark, d):
    o, c = t(spark, d, "orders"), t(spark, d, "customer")
    key = lambda s: o.filter(F.col("o_orderstatus") == s).select("o_custkey")
    return key("F").subtract(key("P")).intersect(c.filter("c_acctbal > 0").select("c_custkey")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def topk_orders(spark, d):
    r = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return t(spark, d, "orders").withColumn("r", r).filter("r <= 3").select("o_custkey", "o_orderkey", "o_totalprice")


@query(f"""SELECT n_name, {CENTS} FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey
WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' GROUP BY n_name""")
def local_supplier_volume(spark, d):
    c, o, l, s, n = (t(spark, d, x) for x in ("customer", "orders", "lineitem", "supplier", "nation"))
    o = o.filter("o_orderdate >= timestamp_ntz'1996-01-01' AND o_orderdate < timestamp_ntz'1997-01-01'")
    j = l.join(o, l["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"]).join(s, (l["l_suppkey"] == s["s_suppkey"]) & (c["c_nationkey"] == s["s_nationkey"])).join(n, s["s_nationkey"] == n["n_nationkey"])
    return j.groupBy("n_name").agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("cents"))


# --- more of the inventory ----------------------------------------------------------------------------------


@query("WITH n AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) > 1 AS later FROM events) SELECT event_id, event_type FROM n ORDER BY later, event_id LIMIT 8")
def one_example_each(spark, d):
    return summary.one_each_then_fill(t(spark, d, "events").select("event_id", "event_type"), "event_type", "event_id", 8)


@query("""WITH $SV, k AS (SELECT session, f, v FROM sv WHERE path <> 'error'), g AS (SELECT session, unnest(range(min(f), max(f) + 1)) AS f FROM k GROUP BY session)
SELECT g.session, g.f, k.v IS NULL AS filled, last_value(k.v IGNORE NULLS) OVER (PARTITION BY g.session ORDER BY g.f) AS v FROM g LEFT JOIN k ON k.session = g.session AND k.f = g.f""")
def frame_grid_fill(spark, d):
    from chronolith.operators import boxes as b

    return b.grid_filled(sv(spark, d).filter("path <> 'error'"), F.col("v"))


@query("SELECT conv_id AS session, turn AS t, 0 AS frame, arg_max(text, length(text) * 1000 + turn) AS text FROM conversations GROUP BY conv_id, turn")
def annotation_merge(spark, d):
    from chronolith.operators import boxes as b

    c = t(spark, d, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("t"), F.lit(0).alias("frame"), (F.length("text") * 1000 + F.col("turn")).alias("seq"), "text")
    return b.merged_records(c).select("session", "t", "frame", "text")


@query("WITH c AS (SELECT user_id AS key, event_type AS text, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, text) AS r FROM c) SELECT key, text, n FROM r WHERE r = 1 AND n >= 2")
def agreed_reading(spark, d):
    from chronolith.operators import boxes as b

    return b.agreed(t(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("text")))


@query("""WITH $SV, rec AS (SELECT session, f::DOUBLE AS t, path AS id, v AS x, v / 2 AS y FROM sv WHERE f % 3 = 0), q AS (SELECT DISTINCT session, f::DOUBLE AS at FROM sv),
tm AS (SELECT q.session, q.at, max(CASE WHEN rec.t <= q.at THEN rec.t END) AS a, min(CASE WHEN rec.t > q.at THEN rec.t END) AS b FROM q JOIN rec USING (session) GROUP BY ALL)
SELECT tm.session, tm.at AS t, p.id, round(p.x + coalesce(n.x - p.x, 0) * coalesce((tm.at - tm.a) / (tm.b - tm.a), 0), 6) AS x, round(p.y + coalesce(n.y - p.y, 0) * coalesce((tm.at - tm.a) / (tm.b - tm.a), 0), 6) AS y
FROM tm JOIN rec p ON p.session = tm.session AND p.t = tm.a LEFT JOIN rec n ON n.session = tm.session AND n.t = tm.b AND n.id = p.id""")
def interpolated_boxes(spark, d):
    from chronolith.operators import boxes as b

    rows = sv(spark, d).withColumn("t", F.col("f").cast("double"))
    rec = rows.filter("f % 3 = 0").select("session", "t", F.col("path").alias("id"), F.col("v").alias("x"), (F.col("v") / 2).alias("y"), F.lit(1.0).alias("w"), F.lit(1.0).alias("h"))
    out = b.interpolated_boxes(rec, rows.select("session", "t"))
    return out.select("session", "t", "id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("""WITH p AS (SELECT event_id, user_id AS session, value / 500 AS px, (event_id * 37 % 100) / 100 AS py FROM events), k AS (SELECT session, px AS x, py AS y FROM p WHERE event_id % 5 = 0)
SELECT event_id FROM p WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.session = p.session AND p.px BETWEEN k.x AND k.x + 0.2 AND p.py BETWEEN k.y AND k.y + 0.2)""")
def points_outside_boxes(spark, d):
    from chronolith.operators import boxes as b

    p = t(spark, d, "events").select("event_id", F.col("user_id").alias("session"), (F.col("value") / 500).alias("px"), (F.col("event_id") * 37 % 100 / 100).alias("py"))
    known = p.filter("event_id % 5 = 0").select("session", F.col("px").alias("x"), F.col("py").alias("y"), F.lit(0.2).alias("w"), F.lit(0.2).alias("h"))
    return b.outside_known(p, known).select("event_id")


@query("WITH $SV, s AS (SELECT session, path, arg_max(v, f) AS v FROM sv WHERE f <= 30 GROUP BY ALL) SELECT session, string_agg(path || '=' || floor(v)::BIGINT, ' ' ORDER BY path) AS text FROM s GROUP BY session")
def compact_state(spark, d):
    at = state.state_at(sv(spark, d), 30).withColumn("v", F.floor("v"))
    return timeline.compact_states(at)


@query("SELECT event_id, ((event_id % 8) * 80)::INT AS x, ((event_id % 6) * 80)::INT AS y, 80 AS w, 80 AS h FROM events")
def region_address(spark, d):
    e = t(spark, d, "events").select("event_id", F.format_string("r%dc%d", F.col("event_id") % 6, F.col("event_id") % 8).alias("region"))
    return e.select("event_id", geometry.region_box(F.col("region"), 640, 480).alias("b")).select("event_id", "b.*")


@query("SELECT event_id, list_sum(list_transform(range(8), lambda i: ((((event_id % 256) >> i) & 1) << (2 * i)) | (((((event_id // 256) % 256) >> i) & 1) << (2 * i + 1))))::BIGINT AS code FROM events")
def morton_tiles(spark, d):
    return t(spark, d, "events").select("event_id", geometry.morton(F.col("event_id") % 256, F.expr("event_id div 256 % 256")).alias("code"))


@query("WITH $SV SELECT session, count(*) AS frames, count(DISTINCT path) AS entities, max(f) AS last_f, arg_max(path, f) AS last_path FROM sv GROUP BY session")
def session_totals(spark, d):
    return sv(spark, d).groupBy("session").agg(F.count(F.lit(1)).alias("frames"), F.count_distinct("path").alias("entities"), F.max("f").alias("last_f"), F.max_by("path", "f").alias("last_path"))


@query("""WITH $SV, w AS (SELECT session, f // 10 AS win, list_sort(list(DISTINCT path)) AS ids FROM sv GROUP BY ALL), l AS (SELECT *, lag(ids) OVER (PARTITION BY session ORDER BY win) AS before FROM w)
SELECT session, win, coalesce(array_to_string(list_filter(before, lambda x: NOT list_contains(ids, x)), ','), '') AS gone, array_to_string(list_filter(ids, lambda x: before IS NULL OR NOT list_contains(before, x)), ',') AS came FROM l""")
def id_set_changes(spark, d):
    w = sv(spark, d).groupBy("session", F.expr("f div 10").alias("win")).agg(F.array_sort(F.collect_set("path")).alias("ids"))
    before = F.lag("ids").over(Window.partitionBy("session").orderBy("win"))
    none = F.array().cast("array<string>")
    out = w.withColumn("before", F.coalesce(before, none))
    return out.select("session", "win", F.array_join(F.array_except("before", "ids"), ",").alias("gone"), F.array_join(F.array_except("ids", "before"), ",").alias("came"))


@query("WITH $SV, h AS (SELECT session, path, f, v, lag(path) OVER (PARTITION BY session ORDER BY f) AS was FROM sv) SELECT 'scene_changed' AS type, session, f, path AS entity, coalesce(was, '') AS detail FROM h WHERE path <> was UNION ALL SELECT 'spike', session, f, path, v::VARCHAR FROM h WHERE v > 450")
def event_topics(spark, d):
    rows = sv(spark, d).withColumn("was", F.lag("path").over(Window.partitionBy("session").orderBy("f")))
    cut = rows.filter("path <> was").select(F.lit("scene_changed").alias("type"), "session", "f", F.col("path").alias("entity"), F.coalesce("was", F.lit("")).alias("detail"))
    return cut.unionByName(rows.filter("v > 450").select(F.lit("spike").alias("type"), "session", "f", F.col("path").alias("entity"), F.col("v").cast("string").alias("detail")))


@query()
def flash_kernel(spark, d):
    return track.flashes(sv(spark, d).select("session", "f", F.array(F.col("v") / 4).alias("regions")))


@query()
def region_scheduler(spark, d):
    rows = sv(spark, d).select("session", "f", F.lit(0).alias("region"), (F.col("v") / 4).alias("residual"), (F.col("path") == "view").alias("explained"), (F.col("path") == "error").alias("is_text"), (F.col("v") > 480).alias("cut"))
    return track.scheduled(rows)


@query()
def reidentified_tracks(spark, d):
    e = t(spark, d, "embeddings").select(F.col("label").alias("session"), F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("color"), F.lit(1.0).alias("area"), F.lit(0.5).alias("x"), F.lit(0.5).alias("y"))
    return track.reidentified(e.filter("id % 100 = 0"), e.filter("id % 100 <> 0"))


@query()
def text_lines(spark, d):
    from chronolith.operators import boxes as b

    e = t(spark, d, "events").select(F.col("user_id").alias("page"), (F.col("value") / 5).alias("x"), (F.col("event_id") % 7 * 3.0).alias("y"), F.lit(4.0).alias("w"), F.lit(2.0).alias("h"), F.col("event_type").alias("text"))
    return b.word_lines(e)


# --- fields, patches, pixels and other rules ------------------------------------------------------------------


@query("""WITH $SV, x AS (SELECT f.n, sv.session, sv.path, max(sv.f) AS f, arg_max(sv.v, sv.f) AS v FROM sv JOIN (VALUES (7), (10), (25), (33), (40)) f(n) ON sv.f <= f.n GROUP BY ALL),
e AS (SELECT session, max(f) AS last FROM sv GROUP BY session) SELECT x.session, x.n::BIGINT AS n, path, v FROM x JOIN e ON e.session = x.session WHERE least(x.n, e.last) - x.f <= 6""")
def state_with_removals(spark, d):
    """Paths are gone seven frames after their last value: dense states are encoded with deletes and read back."""
    rows = sv(spark, d)
    w = Window.partitionBy("session", "path").orderBy("f")
    until = F.least(F.coalesce(F.lead("f").over(w) - 1, F.col("end")), F.col("f") + 6, F.col("end"))
    held = rows.withColumn("end", F.max("f").over(Window.partitionBy("session"))).withColumn("until", until)
    there = held.select("session", "path", F.explode(F.sequence("f", "until")).alias("f"), "v")
    return state.reconstruct_at(state.encode_dense(there, EVERY), [7, 10, 25, 33, 40], nested=False).select("session", "n", F.col("path")[0].alias("path"), "v")


@query("""WITH $SV, l AS (SELECT session, max(CASE WHEN path = 'click' THEN f END) AS c, arg_max(v, f) FILTER (path = 'click') AS v, max(CASE WHEN path = 'view' THEN f END) AS w, arg_max(v, f) FILTER (path = 'view') AS x, max(CASE WHEN path = 'error' THEN f END) AS e FROM sv GROUP BY session)
SELECT session, 'a/b/c/d/e/f/g/h' AS path, v FROM l WHERE c > coalesce(e, -1) UNION ALL SELECT session, 'a/b/x', x FROM l WHERE w > coalesce(e, -1)""")
def nested_patch_state(spark, d):
    """Merge patches eight levels deep; an error removes all below a/b."""
    rows = sv(spark, d)
    leaf = F.col("v").cast("string")
    patch = (
        F.when(F.col("path") == "click", F.concat(F.lit('{"a":{"b":{"c":{"d":{"e":{"f":{"g":{"h":'), leaf, F.lit("}}}}}}}}")))
        .when(F.col("path") == "view", F.concat(F.lit('{"a":{"b":{"x":'), leaf, F.lit("}}}"))).when(F.col("path") == "error", F.lit('{"a":{"b":null}}')).otherwise(F.lit("{}"))
    )
    ops = state.patch_ops(rows.select("session", F.lit(0).cast("bigint").alias("snap_f"), "f", patch.alias("json")), F.col("json"))
    return state.fold(ops).select("session", F.array_join("path", "/").alias("path"), F.col("v").cast("double").alias("v"))


IRREGULAR = "fr AS (SELECT *, path = 'signup' OR f = 0 AS snap, path = 'signup' AND v < 250 AS empty FROM sv)"


@query(f"""WITH $SV, {IRREGULAR}, a AS (SELECT f.n, fr.session, max(fr.f) AS s FROM fr JOIN (VALUES (7), (25), (40), (60)) f(n) ON fr.f <= f.n WHERE fr.snap GROUP BY ALL)
SELECT a.session, a.n::BIGINT AS n, path, arg_max(v, f) AS v FROM a JOIN fr ON fr.session = a.session AND fr.f BETWEEN a.s AND a.n WHERE NOT fr.empty GROUP BY ALL""")
def irregular_snapshots(spark, d):
    """Snapshots wherever a signup is, some of them empty: the nearest is looked up in the directory of each session."""
    rows = sv(spark, d)
    member = F.concat(F.lit('{"'), "path", F.lit('":'), F.col("v").cast("string"), F.lit("}"))
    snap = (F.col("path") == "signup") | (F.col("f") == 0)
    frames = rows.select("session", "f", F.when(snap, "snapshot").otherwise("delta").alias("kind"), F.when((F.col("path") == "signup") & (F.col("v") < 250), "{}").otherwise(member).alias("json"))
    last = F.last(F.when(F.col("kind") == "snapshot", F.col("f")), True).over(Window.partitionBy("session").orderBy("f"))
    ops = state.patch_ops(frames.withColumn("snap_f", last), F.col("json"))
    got = state.reconstruct_at(ops, [7, 25, 40, 60], nested=False, directory=state.snapshots(frames))
    return got.select("session", "n", F.col("path")[0].alias("path"), F.col("v").cast("double").alias("v"))


VERSIONS = """ops AS (SELECT session, 0 AS version, f, path, 'set' AS op, v FROM sv UNION ALL
SELECT session, 1, f, path, CASE WHEN v < 60 THEN 'del' ELSE 'set' END, -v FROM sv WHERE event_id % 11 = 0 UNION ALL SELECT session, 2, f, path, 'set', v + 1000 FROM sv WHERE event_id % 29 = 0)"""


@query(f"""WITH $SV, {VERSIONS}, r AS (SELECT k.version AS known, ops.session, ops.path, arg_max(struct_pack(op := op, v := v), struct_pack(a := ops.version, b := f)) AS r FROM ops JOIN (VALUES (0), (1), (2)) k(version) ON ops.version <= k.version WHERE f <= 40 GROUP BY ALL)
SELECT known, session, path, r.v AS v FROM r WHERE r.op = 'set'""")
def corrected_state(spark, d):
    """States at frame 40 as they were known after none, one and two rounds of corrections, some of which remove a path."""
    rows = sv(spark, d, "event_id")
    ops = lambda version, op, v, where: rows.filter(where).select("session", F.lit(version).alias("version"), (F.floor(F.col("f") / 1000) * 1000).alias("snap_f"), "f", F.array("path").alias("path"), op.alias("op"), v.alias("v"))
    one = F.when(F.col("v") < 60, "del").otherwise("set")
    both = ops(0, F.lit("set"), F.col("v"), "true").union(ops(1, one, -F.col("v"), "event_id % 11 = 0")).union(ops(2, F.lit("set"), F.col("v") + 1000, "event_id % 29 = 0"))
    parts = [state.known_at(both, 40, k).select(F.lit(k).alias("known"), "session", F.col("path")[0].alias("path"), "v") for k in range(3)]
    return parts[0].union(parts[1]).union(parts[2])


@query("SELECT event_id, event_id % 3 <> 1 AS is_field FROM events")
def field_shape(spark, d):
    k = F.col("event_id") % 3
    node = F.when(k == 0, '{"v": null, "source": "observed"}').when(k == 1, '{"v": 5, "conf": 1}').otherwise('{"source": "inferred", "v": [1, 2]}')
    return t(spark, d, "events").select("event_id", text.is_field(F.parse_json(node)).alias("is_field"))


@query("SELECT event_id, round_even(event_id / 8.0, 2)::DOUBLE AS x FROM events")
def half_even_rounding(spark, d):
    return t(spark, d, "events").select("event_id", text.half_even(F.col("event_id") / 8.0, 2).alias("x"))


PIXELS = "px AS (SELECT event_id, user_id, floor(value / 2)::BIGINT AS r, (event_id * 37) % 256 AS g, (event_id * 91) % 256 AS b FROM events)"


def pixels(spark, d):
    return t(spark, d, "events").select("event_id", "user_id", F.floor(F.col("value") / 2).alias("r"), (F.col("event_id") * 37 % 256).alias("g"), (F.col("event_id") * 91 % 256).alias("b"))


@query(f"""WITH {PIXELS}, b AS (SELECT user_id, (r // 64) * 16 + (g // 64) * 4 + b // 64 AS bin, count(*) AS n FROM px GROUP BY ALL), s AS (SELECT user_id, bin, n / sum(n) OVER (PARTITION BY user_id) AS p FROM b),
k AS (SELECT user_id, bin FROM s UNION SELECT user_id - 1, bin FROM s), q AS (SELECT k.user_id, 0.5 * sum(abs(coalesce(x.p, 0) - coalesce(y.p, 0))) AS distance FROM k LEFT JOIN s x ON x.user_id = k.user_id AND x.bin = k.bin LEFT JOIN s y ON y.user_id = k.user_id + 1 AND y.bin = k.bin GROUP BY k.user_id)
SELECT user_id, round(distance, 6) AS distance FROM q WHERE user_id IN (SELECT user_id FROM px) AND user_id + 1 IN (SELECT user_id FROM px)""")
def joint_histogram_distance(spark, d):
    h = summary.joint_histogram(pixels(spark, d), "user_id")
    nxt = h.select((F.col("user_id") - 1).alias("user_id"), F.col("hist").alias("other"), F.col("n").alias("m"))
    return h.join(nxt, "user_id").select("user_id", F.round(signal.counts_half_l1(*[F.col(c) for c in ("hist", "n", "other", "m")]), 6).alias("distance"))


@query(f"""WITH {PIXELS}, p AS (SELECT event_id // 48 AS f, (event_id % 48) // 6 AS region, event_id % 48 AS pixel, r, g, b FROM px),
c AS (SELECT f, region, abs(r - lag(r) OVER w) + abs(g - lag(g) OVER w) + abs(b - lag(b) OVER w) AS change FROM p WINDOW w AS (PARTITION BY region, pixel ORDER BY f))
SELECT f, region, round(avg(change), 6) AS residual FROM c WHERE change IS NOT NULL GROUP BY f, region""")
def region_residual(spark, d):
    e = F.col("event_id")
    p = pixels(spark, d).select(F.lit(0).alias("session"), F.expr("event_id div 48").alias("f"), F.expr("event_id % 48 div 6").alias("region"), (e % 48).alias("pixel"), "r", "g", "b")
    return summary.region_residuals(p).select("f", "region", F.round("residual", 6).alias("residual"))


TILE_BITS = " | ".join(f"(((x >> {i}) & 1) << {2 * i}) | (((y >> {i}) & 1) << {2 * i + 1})" for i in range(4))


@query(f"""WITH RECURSIVE p AS (SELECT user_id % 3 AS session, (event_id * 37 // 5) % 16 AS x, (event_id * 91 // 7) % 16 AS y, CASE WHEN (event_id * 37 // 5) % 16 < 8 THEN floor(value / 100) ELSE floor(value) END AS v FROM events),
leaf AS (SELECT session, {TILE_BITS} AS code, v FROM p),
st AS (SELECT session, level, code >> (2 * (4 - level)) AS tile, count(*) AS n, sum(v)::DOUBLE AS s, sum(v * v)::DOUBLE AS q FROM leaf, (SELECT unnest(range(5)) AS level) GROUP BY ALL),
d AS (SELECT *, q / n - (s / n) * (s / n) AS detail FROM st),
r AS (SELECT * FROM d WHERE level = 0 UNION ALL SELECT d.* FROM r JOIN d ON d.session = r.session AND d.level = r.level + 1 AND d.tile >> 2 = r.tile WHERE r.detail > 9000)
SELECT session, level::INT AS level, tile::BIGINT AS tile, n, round(s / n, 6) AS mean, round(detail, 4) AS detail FROM r WHERE detail <= 9000 OR level = 4""")
def adaptive_tiles(spark, d):
    """Pictures of 16 by 16 places, smooth on the left: tiles split while their variance is above a limit."""
    e = F.col("event_id")
    x, y = F.expr("event_id * 37 div 5 % 16"), F.expr("event_id * 91 div 7 % 16")
    pictures = t(spark, d, "events").select((F.col("user_id") % 3).alias("session"), x.alias("x"), y.alias("y"), F.when(x < 8, F.floor(F.col("value") / 100)).otherwise(F.floor("value")).cast("double").alias("v"), e)
    out = px.quadtree(pictures, 4, 9000.0, "session")
    return out.select("session", "level", "tile", "n", F.round("mean", 6).alias("mean"), F.round("detail", 4).alias("detail"))


PLACES = "fr AS (SELECT event_id // 256 % 2 AS session, event_id % 16 AS x, event_id // 16 % 16 AS y, CASE WHEN event_id % 16 < 8 THEN (event_id % 2) * 90 ELSE floor(value) END::DOUBLE AS v FROM events)"


@query(f"""WITH {PLACES}, m AS (SELECT session, x, y, quantile_cont(v, 0.5) AS m, list(v) AS vs FROM fr GROUP BY ALL),
s AS (SELECT session, x, y, m, len(list_filter(vs, lambda v: abs(v - m) < 12)) / len(vs) >= 0.75 AS stable FROM m),
e AS (SELECT *, abs(m - coalesce(lag(m) OVER (PARTITION BY session, y ORDER BY x), m)) + abs(m - coalesce(lag(m) OVER (PARTITION BY session, x ORDER BY y), m)) > 40 AS edge FROM s),
z AS (SELECT w, h FROM (VALUES (3, 2), (5, 3)) z(w, h)), b AS (SELECT a.session, a.x, a.y, w, h, c.stable, c.stable AND c.edge AS e2 FROM (SELECT DISTINCT session, x, y FROM e) a, z JOIN e c ON true WHERE c.session = a.session AND c.x BETWEEN a.x AND a.x + w - 1 AND c.y BETWEEN a.y AND a.y + h - 1)
SELECT session, x, y, w, h, sum(stable::INT)::BIGINT AS still, sum(e2::INT)::BIGINT AS edges FROM b GROUP BY ALL HAVING x + w <= 16 AND y + h <= 16""")
def steady_box_sums(spark, d):
    """How many steady places, and steady edges, lie in every box of two sizes."""
    e = F.col("event_id")
    x, y = e % 16, F.expr("event_id div 16 % 16")
    frames = t(spark, d, "events").select(F.expr("event_id div 256 % 2").alias("session"), F.expr("event_id div 512").alias("f"), x.alias("x"), y.alias("y"), F.when(x < 8, x % 2 * 90).otherwise(F.floor("value")).cast("double").alias("v"))
    places, sizes = px.steady_edges(frames), [(3, 2), (5, 3)]
    still = px.box_sums(px.integral(places, F.col("stable").cast("int")), sizes).withColumnRenamed("total", "still")
    edges = px.box_sums(px.integral(places, (F.col("stable") & F.col("edge")).cast("int")), sizes).withColumnRenamed("total", "edges")
    return still.join(edges, ["session", "x", "y", "w", "h"])


@query("""WITH d AS (SELECT session, x.f, x.path, last_value(s.v IGNORE NULLS) OVER (PARTITION BY x.session, x.path ORDER BY x.f) AS v, s.v IS NOT NULL AS own FROM
 (SELECT a.session, a.f, p.path FROM sv a JOIN (SELECT session, path, min(f) AS first FROM sv GROUP BY ALL) p USING (session) WHERE a.f >= first) x LEFT JOIN sv s USING (session, f, path))
SELECT session, sum(octet_length(encode(session::VARCHAR)) + octet_length(encode(f::VARCHAR)) + octet_length(encode(path)) + octet_length(encode((v * 100)::BIGINT::VARCHAR)) + 4)::BIGINT AS dense_bytes,
 sum(CASE WHEN own THEN octet_length(encode(session::VARCHAR)) + octet_length(encode(f::VARCHAR)) + octet_length(encode(path)) + octet_length(encode((v * 100)::BIGINT::VARCHAR)) + 4 ELSE 0 END)::BIGINT AS stored_bytes FROM d GROUP BY session""".replace("WITH d", "WITH $SV, d"))
def compression_bytes(spark, d):
    """Bytes of lines ``session,f,path,cents`` of the dense states against those of the rows alone."""
    rows = sv(spark, d)
    size = F.octet_length(F.concat(F.concat_ws(",", "session", "f", "path", F.round(F.col("v") * 100).cast("bigint").cast("string")), F.lit("\n")))
    dense = state.dense(rows).withColumn("v", F.col("v")).groupBy("session").agg(F.sum(size).alias("dense_bytes"))
    return dense.join(rows.groupBy("session").agg(F.sum(size).alias("stored_bytes")), "session")


@query("SELECT event_id, props FROM events WHERE trim(coalesce(CASE WHEN event_id % 3 = 0 THEN ' ' ELSE props END, '')) <> '' AND event_id % 4 > 0")
def non_empty_rows(spark, d):
    e = t(spark, d, "events").withColumn("text", F.when(F.col("event_id") % 3 == 0, " ").otherwise(F.col("props"))).withColumn("items", F.filter(F.array(F.col("event_id") % 4), lambda k: k > 0))
    return px.not_empty(e, "text", "items").select("event_id", "props")


@query("SELECT event_id, user_id AS area FROM events WHERE user_id >= 6 AND (event_id % 60) * (event_id % 37) < 0.5 * 50 * 40")
def blob_filters(spark, d):
    e = F.col("event_id")
    rows = t(spark, d, "events").select(e, F.col("user_id").alias("area"), (e % 60).alias("w"), (e % 37).alias("h"))
    return px.blob_boxes(rows, 50, 40).select("event_id", "area")


@query("""WITH c AS (SELECT role, floor(length(text) / 3.5)::BIGINT + 1 AS n FROM conversations)
SELECT role, count(*) AS contexts, max(n) AS max_tokens, round(avg(n), 4) AS mean_tokens, round(avg(n) / max(n), 4) AS ratio FROM c GROUP BY role""")
def context_statistics(spark, d):
    return context.statistics(t(spark, d, "conversations"), F.col("text"), "role")


@query("""WITH l AS (SELECT p_partkey % 50 AS doc, p_partkey AS n, CASE WHEN p_partkey % 10 = 3 THEN '```' WHEN p_partkey % 2 = 0 THEN '## *' || p_brand || '* [of](x) ' || p_partkey % 3 ELSE p_name END AS line FROM part),
i AS (SELECT *, line = '```' AS fence, sum((line = '```')::INT) OVER (PARTITION BY doc ORDER BY n) % 2 AS inside FROM l),
h AS (SELECT doc, n, substr(line, 4) AS title, replace(lower(regexp_replace(replace(replace(substr(line, 4), '*', ''), '[of](x)', 'of'), '[^A-Za-z0-9 _-]', '', 'g')), ' ', '-') AS base FROM i WHERE NOT fence AND inside = 0 AND line LIKE '## %')
SELECT doc, n, title, base || CASE WHEN row_number() OVER w > 1 THEN '-' || (row_number() OVER w - 1) ELSE '' END AS id FROM h WINDOW w AS (PARTITION BY doc, base ORDER BY n)""")
def heading_ids(spark, d):
    k = F.col("p_partkey")
    line = F.when(k % 10 == 3, "```").when(k % 2 == 0, F.concat(F.lit("## *"), "p_brand", F.lit("* [of](x) "), (k % 3).cast("string"))).otherwise(F.col("p_name"))
    return text.heading_ids(t(spark, d, "part").select((k % 50).alias("doc"), k.alias("n"), line.alias("line")))


@query("SELECT event_id, event_type IN ('click', 'view') AS graded FROM events WHERE event_type <> 'signup'")
def graded_choices(spark, d):
    kind = F.col("event_type")
    said = F.when(kind == "click", "Before the flash").when(kind == "view", "It was after that").when(kind == "purchase", "It was after, not before")
    truth = F.when(kind == "view", "after").otherwise("before")
    return t(spark, d, "events").filter("event_type <> 'signup'").select("event_id", text.graded_choice(said, ["after", "before"], truth).alias("graded"))


@query("WITH $SV SELECT session, f FROM sv WHERE path = 'purchase' AND v > 400")
def model_frames(spark, d):
    """The frames that called the costly model."""
    return sv(spark, d).withColumn("vlm", (F.col("path") == "purchase") & (F.col("v") > 400)).filter("vlm").select("session", "f")


@query("WITH $SV, r AS (SELECT session, f, event_id % 50 AS age, v > 490 AS lost FROM sv) SELECT session, count(*) FILTER (NOT lost AND age <= 30) AS kept, count(*) FILTER (lost OR age > 30) AS late FROM r GROUP BY session")
def late_results(spark, d):
    rows = sv(spark, d, "event_id").select("session", F.col("f").alias("asked_f"), F.when(F.col("v") <= 490, F.col("f") + F.col("event_id") % 50).alias("done_f"))
    return events.in_time(rows, 30).groupBy("session").agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("late"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'player.life=' || floor(value)::BIGINT || ',player.rounds=' || event_id % 13 WHEN 'view' THEN 'car.speed=' || floor(value)::BIGINT ELSE '' END AS fields FROM events")
def adapter_fields(spark, d):
    from chronolith.functions.adapters import Adapter, adapted

    games = (Adapter("click", {"player.life": r"HP (\d+)", "player.rounds": r"(\d+) rounds", "player.rank": r"rank (\d+)"}), Adapter("view", {"car.speed": r"(\d+) km/h"}))
    shown = F.concat(F.lit("HP "), F.floor("value").cast("string"), F.lit(" | "), (F.col("event_id") % 13).cast("string"), F.lit(" rounds | "), F.floor("value").cast("string"), F.lit(" km/h"))
    found = adapted(shown, F.col("event_type"), games)
    return t(spark, d, "events").select("event_id", F.array_join(F.transform(found, lambda x: F.concat_ws("=", x["field"], x["value"])), ",").alias("fields"))


@query()
def waiting_budget(spark, d):
    """Purchases ask a model that answers after a while, some never; three seconds of waiting a session."""
    from chronolith.operators import machines

    asks = (F.col("path") == "purchase") & (F.col("v") > 100)
    ready = F.when(F.col("event_id") % 7 != 0, F.col("f") / 2 + F.col("v") / 40)
    rows = sv(spark, d, "event_id").select("session", "f", F.when(asks, F.col("event_id")).alias("id"), F.when(asks, ready).alias("ready_s"))
    return machines.waited(rows, 2.0, 6, 2.0, 3.0)


@query()
def confirmed_reads(spark, d):
    level = lambda c: F.floor(F.col(c) / 125)
    rows = sv(spark, d, "event_id").select("session", "path", "f", level("v").alias("v"), F.when(F.col("event_id") % 5 == 0, level("v") + 1).when(F.col("event_id") % 5 > 1, level("v")).alias("second"), (level("v") + F.col("event_id") % 2).alias("third"))
    return track.confirmed_reads(rows)


@query()
def reads_wanted(spark, d):
    rows = sv(spark, d).select("session", "path", "f", (F.col("v") / 10).alias("level"), F.md5(F.floor(F.col("v") / 50).cast("string")).alias("checksum"))
    return track.reads_wanted(rows, 80, 5.0, 12)


@query()
def scene_cuts(spark, d):
    rows = sv(spark, d).select("session", "f", F.array(F.col("v") / 4, F.col("v") / 4).alias("regions"), F.array((F.col("v") < 250).cast("double"), (F.col("v") >= 250).cast("double")).alias("hist"))
    return track.breaks(rows)


@query("""WITH RECURSIVE e AS (SELECT user_id AS session, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS f, epoch_us(ts) / 1e6 AS t FROM events),
d AS (SELECT session, f, floor((t - min(t) OVER (PARTITION BY session)) * 0.00025::DOUBLE)::BIGINT + 1 AS due FROM e),
g AS (SELECT session, f, 0::BIGINT AS first, 1::BIGINT AS n, 0::BIGINT AS left_out FROM d WHERE f = 1
UNION ALL SELECT d.session, d.f, CASE WHEN due - g.first - g.n > 12 THEN due - 1 ELSE g.first + g.n END,
CASE WHEN due - g.first - g.n > 12 THEN 1 ELSE least(greatest(due - g.first - g.n, 0), 8) END,
CASE WHEN due - g.first - g.n > 12 THEN due - 1 - g.first - g.n ELSE 0 END FROM g JOIN d ON d.session = g.session AND d.f = g.f + 1)
SELECT session, f, first, n, left_out FROM g""")
def capture_grid(spark, d):
    """Events of a user as ticks, slots of 4,000 seconds."""
    from chronolith.operators import machines

    f = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    since = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)") / 1e6
    return machines.gridded(t(spark, d, "events").select(F.col("user_id").alias("session"), f.alias("f"), since.alias("t")), 0.00025)
