"""Mixing sources to target weights with a time-varying curriculum, in DataFrame operations only.

Targets: the sources share all words of the corpus by weight; a target stops at ``max_repeats`` times its
source's size and the excess goes to the others by weight (water filling, solved in closed form: sources
are capped in ascending order of cap / weight while their cap lies below the water level).

Curriculum: the weight of a source runs linearly over training time t in [0, 1] from ``w0`` to ``w1``
times its mean. Its integral, the cumulative demand ``W(t) = w0 t + (w1 - w0) t^2 / 2`` over ``W(1)``, says
which share of the source's target is due by t. Documents of a source queue up in the order of an md5 of
their id; copy k of a document covers the words from ``k * source_size + words before it``. A copy is taken
while its middle lies within the target, and its training position is the t at which the demand reaches
that middle: the root of a quadratic. Positions are then sorted by range.

Words before a document come from prefix sums in two levels: sums of (source, md5 prefix) cells, running
sums of the cells, running sums within a cell. A cell holds 1/4096 of a source, so no task sees a whole
source however hot it is; the table of cells is shuffled, not collected.

The sources themselves are ranked and summed in ranges of the order asked for, so their number is no matter.

Defined results: null text has size 0; null source is a source of its own, the last; documents of size 0
are taken once within the target and move nothing; repeated rows queue up one after the other; an empty
table gives no rows; ``curriculum`` reads no columns besides id, text and source, ``mixed_documents`` carries the
others, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolith.llm.common import fresh, materialise, table, text_or_empty

WORD = r"[^\x20\x09-\x0D]+"
MAX_REPEATS = 3
CELL_DIGITS = 3
#: Weight and schedule of a source by its rank modulo 3.
WEIGHTS = (1.0, 2.0, 3.0)
SCHEDULES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))


def _by_rank(values: tuple, rank) -> F.Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.pmod(rank, F.lit(len(values))) + 1).cast("int"))


def summed_before(rows: DataFrame, order: list[str], **sums: Column) -> DataFrame:
    """rows with the running sums before each, in an order that tells all rows apart: sorted ranges, and the sums of the ranges before.

    Only the ranges' sums, a row for each shuffle partition, go through one task.
    """
    ranged = materialise(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "mixing-ranges")
    ranges = ranged.groupBy("__range").agg(*[F.sum(v).alias(f"__{k}") for k, v in sums.items()])
    earlier = Window.partitionBy(F.lit(0)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    begins = ranges.select("__range", *[F.coalesce(F.sum(f"__{k}").over(earlier), F.lit(0)).alias(f"__{k}") for k in sums])
    within = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.join(F.broadcast(begins), "__range")
    return placed.select(*rows.columns, *[(F.col(f"__{k}") + F.coalesce(F.sum(v).over(within), F.lit(0))).alias(k) for k, v in sums.items()])


def source_targets(sources: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """sources: (skey, source_size), one row a source. Adds weight, w0, w1 and target."""
    ranked = (
        summed_before(sources, ["skey"], rank=F.lit(1))
        .withColumn("weight", _by_rank(WEIGHTS, F.col("rank")))
        .withColumn("w0", _by_rank(tuple(s[0] for s in SCHEDULES), F.col("rank")))
        .withColumn("w1", _by_rank(tuple(s[1] for s in SCHEDULES), F.col("rank")))
        .withColumn("cap", (F.col("source_size") * max_repeats).cast("double"))
        .withColumn("full", F.col("cap") / F.col("weight"))
    )
    stepped = materialise(summed_before(ranked, ["full", "skey"], capped=F.col("cap"), weighed=F.col("weight")), "mixing-levels")
    size, weight = stepped.agg(F.sum("source_size").cast("double"), F.sum("weight")).first()
    #: Levels rise over the capped sources and fall after the first that is not capped: the highest holds.
    water = stepped.agg(F.max((F.lit(size or 0.0) - F.col("capped")) / (F.lit(weight or 1.0) - F.col("weighed")))).first()[0]
    return stepped.withColumn("target", F.least(F.col("cap"), F.lit(water).cast("double") * F.col("weight"))).drop("rank", "cap", "full", "capped", "weighed")


def curriculum(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_repeats: int = MAX_REPEATS, key: Column | None = None) -> DataFrame:
    """One row per document: id (key, if given), size, source_size, target, copies, taken, positions (array, one a copy), sorted by first position."""
    sized = materialise(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.when(F.col(source_col).isNull(), F.lit("~")).otherwise(F.concat(F.lit("="), F.col(source_col))).alias("skey"),
            F.regexp_count(text_or_empty(F.col(text_col)), F.lit(WORD)).cast("long").alias("size"),
            F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("h"),
            *([key.alias("key")] if key is not None else []),
        ),
        "mixing-sizes",
    ).withColumn("cell", F.substring("h", 1, CELL_DIGITS))
    cells = sized.groupBy("skey", "cell").agg(F.sum("size").alias("cell_size"))
    targets = source_targets(cells.groupBy("skey").agg(F.sum("cell_size").alias("source_size")), max_repeats)
    by_cell = Window.partitionBy("skey").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.withColumn("cell_start", F.coalesce(F.sum("cell_size").over(by_cell), F.lit(0))).drop("cell_size").join(targets, "skey")
    within = Window.partitionBy("skey", "cell").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    queued = sized.withColumn("upto", F.sum("size").over(within)).join(starts, ["skey", "cell"])
    middle = F.col("cell_start") + F.col("upto") - F.col("size") / 2
    due = F.transform(F.sequence(F.lit(0), F.lit(max_repeats - 1)), lambda k: k * F.col("source_size") + F.col("middle"))
    #: t with w0 t + (w1 - w0) t^2 / 2 = u (w0 + w1) / 2
    slope, base = F.col("w1") - F.col("w0"), F.col("w0")

    def inverted(u: F.Column) -> F.Column:
        need = u * (F.col("w0") + F.col("w1")) / 2
        return 2 * need / (base + F.sqrt(base * base + 2 * slope * need))

    return (
        queued.withColumn("middle", middle)
        .withColumn("due", F.filter(due, lambda x: x <= F.col("target")))
        .withColumn("due", F.when(F.col("size") == 0, F.slice("due", 1, 1)).otherwise(F.col("due")))
        .withColumn("copies", F.size("due").cast("long"))
        .withColumn("positions", F.transform("due", lambda x: F.when(F.col("target") > 0, inverted(x / F.col("target"))).otherwise(F.lit(0.0))))
        .select(
            F.col("doc_id").alias(id_col), *(["key"] if key is not None else []), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"),
            "copies", "positions",
        )
        .orderBy(F.coalesce(F.try_element_at("positions", F.lit(1)), F.lit(2.0)), id_col)
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_repeats: int = MAX_REPEATS) -> DataFrame:
    """The rows the mix takes, each as often as it is taken, with all their columns, sorted by training position.

    Rows are told apart by a digest of all their columns; rows that are equal throughout each keep their own copies.
    """
    key, position = fresh("__row_key", docs.columns), fresh("__position", docs.columns)
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text_col)]
    digest = F.sha2(F.concat_ws("\x00", F.coalesce(F.col(id_col).cast("string"), F.lit("\x01")), F.coalesce(F.col(text_col), F.lit("\x01")), F.to_json(F.struct(F.lit(0), *others))), 256)
    copies = curriculum(docs, id_col, text_col, source_col, max_repeats, digest).select(F.col("key").alias(key), F.explode("positions").alias(position))
    # rows that are equal throughout are one row here, and each of their copies a row of the other side
    rows = docs.withColumn(key, digest).dropDuplicates([key])
    return rows.join(copies, key).orderBy(position, key).select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = curriculum(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", F.round(F.try_element_at("positions", F.lit(1)), 6).alias("position"))


ORACLE = r"""
WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '~' ELSE '=' || source END AS skey,
                  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  md5(doc_id::VARCHAR) AS h FROM documents),
s AS (SELECT skey, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY skey) - 1) % 3 AS r FROM d GROUP BY skey),
c AS (SELECT *, (r + 1)::DOUBLE AS weight, [1.5, 1.0, 0.5][r + 1]::DOUBLE AS w0, [0.5, 1.0, 1.5][r + 1]::DOUBLE AS w1,
             (3 * source_size)::DOUBLE AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS lv
      FROM c WINDOW b AS (ORDER BY cap / weight, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, least(cap, max(lv) OVER () * weight) AS target FROM l),
q AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.w0, t.w1,
             sum(d.size) OVER (PARTITION BY d.skey ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT - d.size / 2 AS middle
      FROM d JOIN t USING (skey)),
k AS (SELECT *, (middle <= target)::BIGINT + (size > 0 AND middle + source_size <= target)::BIGINT + (size > 0 AND middle + 2 * source_size <= target)::BIGINT AS copies,
             CASE WHEN target > 0 THEN middle / target ELSE 0 END * (w0 + w1) / 2 AS need FROM q)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies,
       CASE WHEN copies > 0 THEN round(2 * need / (w0 + sqrt(w0 * w0 + 2 * (w1 - w0) * need)), 6) END AS position
FROM k
"""
