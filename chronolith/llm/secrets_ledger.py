"""Secret scans over an incremental blob ledger, in DataFrame operations only.

Every text is addressed by the SHA-256 of its content. The ledger, a table that lasts, holds one row for each (blob,
rule, rule version) ever scanned, with the spans found. A scan of a table of versions

1. addresses all rows;
2. joins the distinct blobs with the ledger, so that each unseen (blob, rule-version) pair is scanned
   once, however many paths or copies show the blob, and appends what it found (``update``);
3. joins all findings, old and new, back to every path by address.

The query takes the table as a history in order of ids: its older half is scanned first, then what came later, and what
the ledger has seen by then is not scanned again.

Spans are code-point offsets, end exclusive, of leftmost non-overlapping matches. Spark gives the matches
(``regexp_extract_all``) and the text between them (``split``) but no offsets; running sums of both
lengths are the offsets, in time that grows with their number. A blob that very many paths show is met by them
where it is broadcast (a thousand such blobs at most), so no task gets all of its paths.

Defined results: null text counts as empty; no findings give counts of 0, an empty span string and the
digest of the empty string; repeated rows each get the findings of their blob; rows without an id are the latest of
the history and keep their null; a text may be of any length; an empty table gives no rows; a pair that two scans
at a time appended counts once; only the id and text columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm.common import exists, let, look_up, materialise, raw, scratch_path, sums_before, table, text_or_empty


@dataclass(frozen=True)
class Rule:
    kind: str
    version: int
    pattern: str
    #: A text without a match of this holds no finding; it is the cheap test that comes first.
    sign: str
    base: bool = True
    #: Group whose length must reach least; others are dropped after matching.
    group: int = 0
    least: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


_NAME = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]%s)"""
#: Base rules as the contract gives them; a run of hex or access characters is maximal, so its least length can stand in the pattern.
RULES = (
    Rule("assign", 1, _NAME % "+", _NAME % "{8}", group=2, least=8),
    Rule("access", 1, r"AKIA[A-Z0-9]{12,}", r"AKIA[A-Z0-9]{12}"),
    Rule("hex", 1, r"[0-9a-f]{32,}", r"[0-9a-f]{32}"),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "-----BEGIN ", base=False),
    Rule("forge", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", r"gh[pousr]_[A-Za-z0-9]{36}", base=False),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ", base=False),
    Rule("chat", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}", r"xox[abprs]-[A-Za-z0-9-]{10}", base=False),
)
SPANS = "array<struct<start:bigint,end:bigint>>"
LEDGER = f"blob binary, rule string, version int, spans {SPANS}"


def spans_of(text: str, rule: Rule) -> Column:
    """Spans of the rule's matches in the column that are long enough; an empty array without any."""
    p = raw(rule.pattern)
    hits = f"regexp_extract_all({text}, {p}, 0)"
    shown = f"regexp_extract_all({text}, {p}, {rule.group})" if rule.group else hits
    lengths = f"zip_with({hits}, {shown}, (h, g) -> struct(cast(length(h) AS bigint) AS len, length(g) >= {rule.least} AS kept))"
    steps = f"zip_with(transform(split({text}, {p}, -1), g -> cast(length(g) AS bigint)), {lengths}, (gap, h) -> struct(gap AS gap, h.len AS len, h.kept AS kept))"
    before = sums_before("transform(steps, s -> s.gap + coalesce(s.len, 0L))")
    placed = f"zip_with(steps, {before}, (s, at) -> struct(at + s.gap AS `start`, at + s.gap + s.len AS `end`, coalesce(s.kept, false) AS kept))"
    kept = f"transform(filter({placed}, s -> s.kept), s -> struct(s.`start` AS `start`, s.`end` AS `end`))"
    return F.expr(f"CASE WHEN {text} RLIKE {raw(rule.sign)} THEN {let(steps, 'steps', kept)} ELSE cast(array() AS {SPANS}) END")


def addressed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    body = text_or_empty(F.col(text_col))
    return docs.select(F.col(id_col).alias("path"), F.unhex(F.sha2(body, 256)).alias("blob"), body.alias("body"))


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows (blob, rule, version, spans) for the pairs of distinct blobs and rule versions not in the ledger."""
    blobs = versions.groupBy("blob", "body").agg(F.lit(1).alias("one")).select("blob", "body")
    active = F.array(*[F.lit(r.key) for r in rules])
    if ledger is None:
        todo = blobs.withColumn("todo", active)
    else:
        seen = ledger.groupBy("blob").agg(F.collect_set(F.concat_ws("@", "rule", F.col("version").cast("string"))).alias("seen"))
        todo = blobs.join(seen, "blob", "left").withColumn("todo", F.array_except(active, F.coalesce("seen", F.array().cast("array<string>"))))
    scanned = F.array(*[
        F.when(
            F.array_contains("todo", r.key),
            F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version"), spans_of("body", r).alias("spans")),
        )
        for r in rules
    ])
    return (
        todo.filter(F.size("todo") > 0)
        .select("blob", F.explode(F.filter(scanned, lambda x: x.isNotNull())).alias("x"))
        .select("blob", "x.rule", "x.version", "x.spans")
    )


def update(path: str, versions: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what the ledger at the path has not seen, append it there and return the ledger; a path that is not there is an empty one.

    Run again after a failure it scans what had not been committed, so nothing is lost and nothing stands there twice.
    """
    spark = versions.sparkSession
    before = spark.read.schema(LEDGER).parquet(path) if exists(spark, path) else None
    scan_unseen(versions, before, rules).write.mode("append").parquet(path)
    return spark.read.schema(LEDGER).parquet(path)


def history(versions: DataFrame, steps: int = 2) -> list[DataFrame]:
    """The versions in that many parts of about equal size by path, the older ones first; each row is in one of them."""
    at = F.col("path").cast("double")
    cuts = sorted(set(versions.select(at.alias("at")).stat.approxQuantile("at", [i / steps for i in range(1, steps)], 0.01)))
    place = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < at)) if cuts else F.lit(0)
    place = F.when(at.isNull(), len(cuts)).otherwise(place)
    return [versions.filter(place == i) for i in range(len(cuts) + 1)]


def findings_by_path(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per path and version: path, hits = array of (start, k, kind, end, base) in order of start, then of the rules."""
    order = F.create_map(*[x for k, r in enumerate(rules) for x in (F.lit(r.key), F.lit(k))])
    base = F.create_map(*[x for r in rules for x in (F.lit(r.kind), F.lit(r.base))])
    hits = (
        ledger.filter(F.size("spans") > 0)
        .withColumn("k", order[F.concat_ws("@", "rule", F.col("version").cast("string"))])
        .filter(F.col("k").isNotNull())
        .select("blob", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.col("k").alias("k"), F.col("rule").alias("kind"), s["end"].alias("end"), base[F.col("rule")].alias("base"))).alias("of"))
        .groupBy("blob")
        .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("of")))).alias("hits"))
    )
    shown = versions.groupBy("blob").agg(F.count(F.lit(1)).alias("paths"))
    found = materialise(hits.join(shown, "blob"), "secret-hits")
    return look_up(versions.select("path", "blob"), found, "blob", "paths").drop("paths")


def op6_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = addressed(table(spark, sf_dir, "documents"), "doc_id", "text")
    path = scratch_path(spark, "secret-ledger")
    for part in history(versions):
        ledger = update(path, part)
    shown = materialise(versions.select("path", "blob"), "secret-paths")
    hits = F.coalesce("hits", F.array().cast("array<struct<start:bigint,k:int,kind:string,end:bigint,base:boolean>>"))
    joined = lambda of: F.array_join(F.transform(of, lambda h: F.concat_ws(":", h["kind"], h["start"].cast("string"), h["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("hits", lambda h: h["kind"] == kind)).cast("long")
    return findings_by_path(shown, ledger).withColumn("hits", hits).select(
        F.col("path").alias("doc_id"),
        count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(joined(F.filter("hits", lambda h: h["base"])), 256).alias("base_sha256"),
        joined(F.col("hits")).alias("spans"),
    )


def _oracle() -> str:
    """The same findings by plain SQL over all documents: offsets from the matches and the text between them."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    parts = [
        f"SELECT doc_id, {k} AS k, '{r.kind}' AS kind, {str(r.base).lower()} AS base, {r.least} AS least, string_split_regex(t, {quoted(r.pattern)}) AS gaps, "
        f"regexp_extract_all(t, {quoted(r.pattern)}) AS hits, regexp_extract_all(t, {quoted(r.pattern)}, {r.group}) AS shown FROM d WHERE regexp_matches(t, {quoted(r.sign)})"
        for k, r in enumerate(RULES)
    ]
    length = lambda col: f"coalesce(list_sum(list_transform({col}, lambda x: length(x))), 0)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({' UNION ALL '.join(parts)}),
e AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM m),
s AS (SELECT doc_id, k, kind, base, ({length('gaps[1:i]')} + {length('hits[1:i - 1]')})::BIGINT AS a, length(hits[i]) AS n FROM e WHERE length(shown[i]) >= least),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
      coalesce(string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, k) FILTER (base), '') AS based,
      string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, k) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(based, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""


ORACLE = _oracle()
