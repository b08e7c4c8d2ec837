"""What the corpus operators share: table access, shared scratch space, ASCII folding."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; only where that is unset, in local mode, a temporary one."""
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir") or spark.conf.get("chronolith.scratch.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="chronolith-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.conf.set("chronolith.scratch.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    """(Hadoop path, its file system): shared folders may be in any store that Spark reaches."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _file_system(spark, path)
    return fs.exists(at)


def materialise(df: DataFrame, label: str, spent: tuple[DataFrame, ...] = ()) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors, computes once.

    Tables named ``spent`` are ones this function made, which nothing needs once the new one is there: they are deleted.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made._scratch = path
    discard(*spent)
    return made


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` made and whose readers have all run; others are left alone."""
    for t in tables:
        if path := t.__dict__.pop("_scratch", None):
            at, fs = _file_system(t.sparkSession, path)
            fs.delete(at, True)


def share_file(spark: SparkSession, name: str, parts: Iterable[bytes]) -> str:
    """Write a file to the shared folder and have it sent to every worker machine once; returns its name for ``SparkFiles``."""
    name = f"{uuid.uuid4().hex}-{name}"
    at, fs = _file_system(spark, f"{shared_dir(spark)}/{name}")
    out = fs.create(at)
    for data in parts:
        for a in range(0, len(data), 1 << 20):
            out.write(bytearray(data[a : a + (1 << 20)]))
    out.close()
    spark.sparkContext.addFile(at.toString())
    return name


def chosen_by_hash(share: float | Column, *columns: str) -> Column:
    """Whether a row belongs to the share of rows with the least hashes of these columns; as true of a share of 1e-15 as of one half."""
    part = F.xxhash64(*columns).bitwiseAND(F.lit((1 << 63) - 1)).cast("double") / F.lit(2.0**63)
    return part <= (share if isinstance(share, Column) else F.lit(float(share)))


#: A key is hot that has more than one in HOT_SHARE of all rows, so there are at most HOT_SHARE hot keys.
HOT_SHARE = 1000
#: A hot key's values of more bytes than this as JSON are not broadcast; its rows are dealt out over ``SPREAD`` copies of them.
WIDE_BYTES, SPREAD = 1 << 16, 64


def look_up(rows: DataFrame, found: DataFrame, key: str, weight: str) -> DataFrame:
    """rows left-joined with found (one row a key; ``weight`` is the number of rows of the key), safe from skew.

    Hot keys, ``HOT_SHARE`` of them at most, are broadcast, with their values where these are small (``WIDE_BYTES``); rows
    that have met theirs there get a key of their own that finds nothing, so the shuffled join deals them out evenly. A hot
    key of large values is met in that join, where ``SPREAD`` copies of it each take a part of its rows.
    """
    values = [c for c in found.columns if c != key]
    total = found.agg(F.sum(weight)).first()[0] or 0
    value, is_hot = F.struct(*values), F.col(weight) > total / HOT_SHARE
    wide = F.octet_length(F.to_json(value)) > WIDE_BYTES
    hot = found.filter(is_hot).select(F.col(key).alias("__key"), F.when(~wide, value).alias("__hot"), wide.alias("__wide"))
    zero = F.array(F.lit(0).cast("bigint"))
    copies = F.when(~is_hot, zero).when(wide, F.sequence(F.lit(0).cast("bigint"), F.lit(SPREAD - 1).cast("bigint"))).otherwise(F.slice(zero, 1, 0))
    cold = found.select(F.col(key).alias("__key"), value.alias("__cold"), F.explode(copies).alias("__zero"))
    kind = rows.schema[key].dataType
    met = rows.join(F.broadcast(hot), F.col(key) == F.col("__key"), "left").drop("__key")
    # rows that still look for a key have the number of a copy beside it, all others a null and a number that spreads them
    number = F.monotonically_increasing_id()
    spread = F.when(F.col("__wide"), F.pmod(number, F.lit(SPREAD))).when(F.col("__hot").isNull() & F.col(key).isNotNull(), F.lit(0)).otherwise(number + 1)
    met = met.withColumn("__spread", spread).withColumn("__at", F.when(F.col("__hot").isNull(), F.col(key)).otherwise(F.lit(None).cast(kind)))
    joined = met.join(cold, (F.col("__at") == F.col("__key")) & (F.col("__spread") == F.col("__zero")), "left")
    value = F.coalesce("__hot", "__cold")
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns], *[value[v].alias(v) for v in values])


def fresh(name: str, taken: Iterable[str]) -> str:
    """The name, or with as many underscores before it as keep it apart from those taken, whatever their case."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name = "_" + name
    return name


def let(value: str, name: str, then: str) -> str:
    """SQL of ``then`` in which ``name`` stands for the value, worked out once however often it is used there."""
    return f"transform(array({value}), {name} -> {then})[0]"


def sums_before(values: str, block: int = 64, levels: int = 2) -> str:
    """SQL of the sum of the elements before each one of an array of bigint. Blocks of ``block`` are summed first, and their
    sums treated alike, so the work is in proportion to the length. As text, it is parsed at once, not built node by node."""

    def plain(x: str, begin: str) -> str:
        return f"aggregate({x}, struct({begin} AS at, cast(array() AS array<bigint>) AS done), (acc, v) -> struct(acc.at + v AS at, concat(acc.done, array(acc.at)) AS done), acc -> acc.done)"

    def blocked(x: str, left: int) -> str:
        if not left:
            return plain(x, "0L")
        p, b = f"parts{left}", f"begins{left}"
        parts = f"transform(filter(sequence(0, size({x}) div {block}), i -> i * {block} < size({x})), i -> slice({x}, i * {block} + 1, {block}))"
        sums = f"transform({p}, part -> aggregate(part, 0L, (acc, v) -> acc + v))"
        begins = let(blocked(f"sums{left}", left - 1), b, f"flatten(zip_with({p}, {b}, (part, begin) -> {plain('part', 'begin')}))")
        return f"CASE WHEN size({x}) <= {block} THEN {plain(x, '0L')} ELSE {let(parts, p, let(sums, f'sums{left}', begins))} END"

    return let(values, "values_", blocked("values_", levels))


def raw(pattern: str) -> str:
    """A regular expression as an SQL literal."""
    return "r'" + pattern.replace("'", r"\x27") + "'"


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def fold_ascii(text: Column) -> Column:
    """Lower-case A-Z only. All-ASCII text takes the vectorised ``lower``; the rest maps letter by letter."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def row_key(id_col: str, text_col: str) -> Column:
    """Digest of a row's id and text; null and empty ids differ, null and empty texts do not."""
    return F.sha2(F.concat_ws("\x00", F.coalesce(F.col(id_col).cast("string"), F.lit("\x01")), text_or_empty(F.col(text_col))), 256)


def small_arrow_batches(spark: SparkSession, rows: int = 1000, size: str = "32m") -> None:
    """Batches for Python workers of at most so many rows and bytes: texts may be long, and a batch lies in memory whole."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
