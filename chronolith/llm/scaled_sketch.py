"""Document fingerprints by a threshold-scaled sketch.

A sketch retains every 5-word shingle hash below a fixed fraction of the hash range (``1 / FRACTION``), so
it grows with the document, sketches of parts merge by union, and |A & B| / |A| estimates how much of A is
contained in B however unequal the two are. As text a fingerprint is ``shingles-sum:hashes``: the number of
distinct shingles, the sum of all their hashes modulo 2**64 (both hexadecimal), and the retained 48-bit
hashes in order, big-endian, 8 base64 characters each. The sum tells texts apart whose sketches are empty.

Each document is compared with the one that follows in descending id (after the last comes the first). The
rows are dealt into ranges of ids whose bounds come from quantiles; each range also receives the first row
of the next one, so a neighbour is always the next row of the same sorted range. An id that many rows share, or the
null of rows without one, is cut into ranges of its own by a hash of the text. One shuffle of the texts, no join of
texts, no global window.

Defined results: null text counts as empty; a text of fewer than five words is one shingle, of no words
none; likeness is 1 for equal texts, and where the first sketch is empty 1 or 0 by whether number and sum
are equal; null ids come last in the order; equal ids follow in order of a hash of the text (rows of one id and one
text are alike, and share a range however many they are); a single row
is its own neighbour; an empty table gives no rows; columns besides the id and text are not read.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolith.llm import kernels as K
from chronolith.llm.common import small_arrow_batches, table, text_or_empty

WORDS, FRACTION, BITS = 5, 4, 48
KNOTS = 256
STEP = np.uint64(0xA24BAED4963EE407)


class Sketches:
    """Sketches of some texts: retained hashes (sorted, by text), bounds, numbers and sums of all shingles."""

    def __init__(self, texts: list[str], words: int = WORDS, fraction: int = FRACTION):
        parts: list[np.ndarray] = []
        self.count, self.total = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.uint64)
        sizes = np.zeros(len(texts), np.int64)
        for a, b in K.batches(texts):
            cps, bounds = K.code_points([t.lower() for t in texts[a:b]])
            if not len(cps):
                continue
            starts, ends, by_text = K.words(cps, bounds)
            n = np.diff(by_text)
            w = K.slice_hashes(cps, starts, ends)
            text = np.repeat(np.arange(b - a), n)
            # the shingle of the words i .. i + words - 1 within the text, or of all words of a shorter text
            left = np.repeat(by_text[1:], n) - np.arange(len(w))
            size = np.minimum(n, words)[text]
            opens = np.flatnonzero(left >= size)
            h = np.zeros(len(opens), np.uint64)
            for j in range(words):
                inside = size[opens] > j
                at = opens[inside] + j
                h[inside] = (h[inside] + w[at]) * STEP
            h = K.mixed(h + size[opens].astype(np.uint64))
            order = np.lexsort((h, text[opens]))
            of, h = text[opens][order], h[order]
            fresh = np.ones(len(h), bool)
            fresh[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
            of, h = of[fresh], h[fresh]
            self.count[a:b] = np.bincount(of, minlength=b - a)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h)])
            edges = np.searchsorted(of, np.arange(b - a + 1))
            self.total[a:b] = sums[edges[1:]] - sums[edges[:-1]]
            short = h >> np.uint64(64 - BITS)
            low = short < np.uint64((1 << BITS) // fraction)
            parts.append(short[low])
            sizes[a:b] = np.bincount(of[low], minlength=b - a)
        self.hashes = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        self.bounds = np.concatenate([[0], np.cumsum(sizes)])

    def strings(self) -> list[str]:
        raw = self.hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - BITS // 8 :].tobytes()
        step = BITS // 8
        b = self.bounds.tolist()
        return [f"{n:x}-{t:016x}:{base64.b64encode(raw[step * b[i] : step * b[i + 1]]).decode()}" for i, (n, t) in enumerate(zip(self.count.tolist(), self.total.tolist(), strict=True))]

    def keys(self, rows: np.ndarray) -> np.ndarray:
        """Retained hashes of the given rows, each under its place in ``rows``."""
        sizes = self.bounds[rows + 1] - self.bounds[rows]
        flat, at = K.gathered(self.hashes, self.bounds[rows], sizes)
        return (np.repeat(np.arange(len(rows)), np.diff(at)).astype(np.uint64) << np.uint64(BITS)) | flat


def containment(a: Sketches, rows_a: np.ndarray, b: Sketches, rows_b: np.ndarray) -> np.ndarray:
    """Estimated share of each text of ``a`` that is in its partner of ``b``."""
    ka, kb = a.keys(rows_a), b.keys(rows_b)
    both = np.intersect1d(ka, kb, assume_unique=True)
    shared = np.bincount((both >> np.uint64(BITS)).astype(np.int64), minlength=len(rows_a))
    size = a.bounds[rows_a + 1] - a.bounds[rows_a]
    same = (a.count[rows_a] == b.count[rows_b]) & (a.total[rows_a] == b.total[rows_b])
    return np.where(same, 1.0, np.where(size > 0, shared / np.maximum(1, size), 0.0))


def parse(fingerprint: str) -> tuple[int, int, list[int]]:
    head, _, tail = fingerprint.partition(":")
    n, total = head.split("-")
    raw, step = base64.b64decode(tail), BITS // 8
    return int(n, 16), int(total, 16), [int.from_bytes(raw[i : i + step]) for i in range(0, len(raw), step)]


def merge(a: str, b: str) -> list[int]:
    """Retained hashes of the union of two documents."""
    return sorted(set(parse(a)[2]) | set(parse(b)[2]))


def ranges(docs: DataFrame, id_col: str, parts: int) -> Column:
    """Number of the range, 0 for the largest ids: the quantiles' piecewise linear distribution cut into equal parts."""
    knots = sorted(set(docs.select(F.col(id_col).cast("double").alias("x")).stat.approxQuantile("x", [i / KNOTS for i in range(KNOTS + 1)], 1 / (4 * KNOTS))))
    if len(knots) < 2:
        return F.lit(0)
    x = F.col(id_col).cast("double")
    at = F.array(*[F.lit(k) for k in knots])
    i = F.least(F.greatest(F.size(F.filter(at, lambda k: k <= x)), F.lit(1)), F.lit(len(knots) - 1))
    low, high = F.element_at(at, i), F.element_at(at, i + 1)
    share = (i - 1 + F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - low) / (high - low)))) / (len(knots) - 1)
    return F.coalesce(F.greatest(F.lit(0), parts - 1 - F.floor(share * parts)).cast("int"), F.lit(parts - 1))


def by_text(placed: DataFrame, parts: int) -> tuple[Column, Column]:
    """What orders rows within a range number (zone, slice): an id of more than two ranges' rows is a zone, cut into slices.

    At most half as many ids as there are ranges can be such, and their slices together are at most as many as the ranges.
    """
    total = placed.count()
    counts = placed.groupBy("id").count().filter((F.col("count") > 1) & (F.col("count") > 2 * total / parts))
    heavy = {r["id"]: math.ceil(r["count"] * parts / total) for r in counts.collect()}
    if not heavy:
        return F.lit(0), F.lit(0)
    of = F.array(*[F.struct(F.lit(x).cast("bigint").alias("id"), F.lit(k).alias("slices")) for x, k in heavy.items()])
    above = F.when(F.col("id").isNull(), len(heavy)).otherwise(F.size(F.filter(of, lambda h: h["id"] > F.col("id"))))
    slices = F.get(F.filter(of, lambda h: h["id"].eqNullSafe(F.col("id"))), F.lit(0))["slices"]
    share = F.xxhash64("text").cast("double") / 2.0**64 + 0.5
    cut = F.least(F.floor(share * slices), slices - 1)
    return 2 * above + slices.isNotNull().cast("int"), F.coalesce(cut, F.lit(0))


def with_neighbours(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(part, guest, id, text), sorted: the rows of each range, then as guest the first of the range that follows."""
    spark = docs.sparkSession
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    plain = docs.select(ranges(docs, id_col, parts).cast("bigint").alias("range"), F.col(id_col).cast("bigint").alias("id"), text_or_empty(F.col(text_col)).alias("text"))
    zone, cut = by_text(plain, parts)
    # range, then zone, then slice, as one number; there are fewer than parts + 2 zones and parts + 1 slices
    part = (F.col("range") * (parts + 2) + zone) * (parts + 1) + cut
    placed = plain.select(part.alias("part"), "id", "text", F.struct(F.col("id").isNull().alias("none"), F.bitwise_not("id").alias("down"), F.xxhash64("text").alias("hash")).alias("place"))
    ring = Window.partitionBy(F.lit(0)).orderBy("part")
    heads = placed.groupBy("part").agg(F.min("place").alias("head"))
    heads = heads.select("part", "head", F.coalesce(F.lag("part").over(ring), F.max("part").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("host"))
    on = (placed["part"] == heads["part"]) & placed["place"].eqNullSafe(heads["head"])
    home = F.struct(placed["part"].alias("part"), F.lit(False).alias("guest"))
    visit = F.struct(heads["host"].alias("part"), F.lit(True).alias("guest"))
    # one row a range, zone and slice: at most four times ``parts`` rows are broadcast
    spread = placed.join(F.broadcast(heads), on, "left").select("id", "text", F.explode(F.when(heads["host"].isNotNull(), F.array(home, visit)).otherwise(F.array(home))).alias("p"))
    rows = spread.select("p.part", "p.guest", "id", "text")
    return rows.repartition("part").sortWithinPartitions("part", "guest", F.desc_nulls_last("id"), F.xxhash64("text"))


def fingerprint_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        for batch in batches:
            part, guest, ids, texts = (c.to_pylist() for c in batch.columns)
            if last:
                part, guest, ids, texts = ([x, *xs] for x, xs in zip(last, (part, guest, ids, texts), strict=True))
            last = (part[-1], guest[-1], ids[-1], texts[-1])
            for a, b in K.batches(texts):
                # a batch's last row needs the one that follows it
                rows = [i for i in range(a, min(b, len(texts) - 1)) if not guest[i] and part[i] == part[i + 1]]
                if not rows:
                    continue
                own = list(range(a, min(b + 1, len(texts))))
                plain = Sketches([texts[i] for i in own])
                edited = [texts[i][: len(texts[i]) - len(texts[i]) // 2] + texts[i + 1][: len(texts[i]) // 2] for i in rows]
                changed = Sketches(edited)
                here = np.array(rows) - a
                strings, new = plain.strings(), changed.strings()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[i] for i in rows], pa.int64()), pa.array([len(texts[i]) for i in rows], pa.int64()),
                        pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited], pa.string()),
                        pa.array([strings[i] for i in here.tolist()], pa.string()), pa.array(new, pa.string()),
                        pa.array(containment(plain, here, changed, np.arange(len(rows))), pa.float64()),
                        pa.array(containment(plain, here, plain, here + 1), pa.float64()),
                    ],
                    ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    small_arrow_batches(docs.sparkSession)
    return with_neighbours(docs, id_col, text_col).mapInArrow(
        run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    ).withColumnRenamed("doc_id", id_col)


def op2_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_pairs(table(spark, sf_dir, "documents"))
