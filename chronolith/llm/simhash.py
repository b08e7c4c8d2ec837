"""SimHash near-dedup by a byte-position inverted index with count filtering.

Fingerprint: 64 bits over the XXH64 hashes of 4-word shingles. Two fingerprints that differ in at most
four bits differ in at most four of their eight bytes, so at least four bytes agree in place. The index
posts every distinct fingerprint under each choice of four byte positions with their values (70 composite
postings): a pair shares a composite posting exactly when its tally of shared positional bytes reaches the
guaranteed minimum, so the index does the count filtering without listing the pairs of the 2048 single-byte
postings, whose number grows with the square of the corpus. Candidates are verified by popcount.

Equal fingerprints are one class before the index, so copies are never paired. Within a posting only the
edges of a spanning forest of its verified links leave: members that are linked already are not paired
again, and a posting of one dense group costs about its size. A posting of more than ``SPLIT`` members is filtered
once more by its half bytes, so many unlinked members are not compared with each other. No link between different
components of a posting is lost, so reachability over all postings is exact. A task streams its sorted postings;
what it holds of one posting is eight bytes a distinct fingerprint. Rows look their component up with hot
fingerprints, a thousand at most, broadcast.

Defined results: null or empty text and text of blanks has fingerprint zero and is linked like any other;
fewer than four words are one shingle; repeated rows and copies share a fingerprint and a component; null
ids do not become a component's id unless all of its ids are null; an empty table gives no rows; the labels read
no columns but the id and text, and ``keep_one`` carries the others, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm import kernels as K
from chronolith.llm.common import fresh, look_up, materialise, row_key, small_arrow_batches, table
from chronolith.llm.components import components

SHINGLE, SEED = 4, 42
#: Bits that may differ, and byte positions that must then agree.
MAX_BITS = 4
SHARED_BYTES = 8 - MAX_BITS
CHOICES = tuple(combinations(range(8), SHARED_BYTES))
#: Members from which on a posting is split further.
SPLIT = 2048
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def fingerprints(texts: list[str | None], shingle: int = SHINGLE) -> np.ndarray:
    """The 64-bit fingerprint of each text."""
    out = np.zeros(len(texts), np.uint64)
    texts = [(t or "").translate(ASCII_LOWER) if not (t or "").isascii() else (t or "").lower() for t in texts]
    weight = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for a, b in K.batches(texts, 1 << 20):
        hashes: list[int] = []
        sizes = []
        for t in texts[a:b]:
            data = t.encode("utf-8", "surrogatepass")
            pieces = data.split()  # bytes split on 0x20 and 0x09-0x0D
            joined = b" ".join(pieces)
            ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1)
            starts = [0, *ends[:-1].tolist()]
            n = max(1, len(pieces) - shingle + 1) if pieces else 0
            stops = (ends[shingle - 1 :] - 1).tolist() if len(pieces) >= shingle else [len(joined)] * n
            digest = xxhash.xxh64_intdigest
            hashes += [digest(joined[x:y], SEED) for x, y in zip(starts, stops, strict=False)]
            sizes.append(n)
        size = np.array(sizes, np.int64)
        live = np.flatnonzero(size)
        if len(live):
            bits = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            first = np.cumsum(size) - size
            ones = np.add.reduceat(bits, first[live], axis=0, dtype=np.int32)
            out[a + live] = ((2 * ones > size[live, None]) * weight).sum(1, dtype=np.uint64)
    return out


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: Column | None = None) -> DataFrame:
    """(doc_id, fp bigint[, extra]): the fingerprint's bits as a signed long."""
    chosen = [F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *([extra.alias("extra")] if extra is not None else [])]
    frame = docs.select(*chosen)
    kinds = [f"doc_id {frame.schema[0].dataType.simpleString()}", "fp bigint", *(["extra " + frame.schema[2].dataType.simpleString()] if extra is not None else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = pa.array(fingerprints(batch.column(1).to_pylist()).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), fp, *batch.columns[2:]], ["doc_id", "fp", *(["extra"] * (len(kinds) - 2))])

    small_arrow_batches(docs.sparkSession)
    return frame.mapInArrow(run, ", ".join(kinds))


def shared_bytes(x: np.ndarray) -> np.ndarray:
    """Tally of equal bytes in place, from the exclusive or of two fingerprints."""
    return (np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8) == 0).sum(1)


def linked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a ^ b
    return (shared_bytes(x) >= SHARED_BYTES) & (np.bitwise_count(x) <= MAX_BITS)


def forest(members: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges of a spanning forest of the links among distinct members; each is compared with those not yet reached."""
    rest = members
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop()
            hit = linked(rest, x)
            if hit.any():
                found = rest[hit]
                yield np.full(len(found), x, np.uint64), found
                front += list(found)
                rest = rest[~hit]


def split_forest(members: np.ndarray, choice: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """As ``forest``, of a large posting of that choice: the same count filter once more, on half bytes.

    Its members agree in the chosen bytes, so two linked ones differ in at most four of the eight half bytes of the
    others and meet under some choice of four of these. What meets there agrees in 48 bits, and among the values of
    the other 16 no more than a few hundred can be pairwise unlinked, so its forest is cheap.
    """
    data = np.ascontiguousarray(members).view(np.uint8).reshape(-1, 8)
    rest = data[:, [p for p in range(8) if p not in CHOICES[choice]]]
    half = np.concatenate([rest & 15, rest >> 4], 1).astype(np.int64)
    sets = K.Sets(len(members))
    for places in CHOICES:
        key = half[:, places] @ np.array([1, 1 << 4, 1 << 8, 1 << 12])
        order = np.argsort(key, kind="stable")
        cut = np.flatnonzero(np.diff(key[order])) + 1
        for part in np.split(order, cut):
            if len(part) < 2 or (len(part) > 2 and len({sets.root(i) for i in part.tolist()}) == 1):
                continue
            place = dict(zip(members[part].tolist(), part.tolist(), strict=True))
            for a, b in forest(members[part]):
                new = [k for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)) if sets.join(place[x], place[y])]
                if new:
                    yield a[new], b[new]


def _first_choice(x: np.ndarray) -> np.ndarray:
    """Number of the first composite posting that a pair shares, from its exclusive or."""
    same = np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8) == 0
    code = (np.where(same & (np.cumsum(same, 1) <= SHARED_BYTES), 1, 0) << np.arange(8)).sum(1)
    table = np.full(256, -1, np.int64)
    for i, c in enumerate(CHOICES):
        table[sum(1 << p for p in c)] = i
    return table[code]


def posting_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (choice, bytes, fp) rows -> edges. Postings of two are checked all at once, larger ones by forest."""

    def edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["u", "v"])

    held: list[tuple[np.ndarray, np.ndarray]] = []

    def closed(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(first, len(key)))
        two = first[size == 2]
        if len(two):
            a, b = fp[two], fp[two + 1]
            good = linked(a, b)
            a, b, choice = a[good], b[good], key[two][good] >> 32
            once = _first_choice(a ^ b) == choice
            if once.any():
                yield edges(a[once], b[once])
        for s, n in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            found = forest(fp[s : s + n]) if n <= SPLIT else split_forest(fp[s : s + n], int(key[s] >> 32))
            for a, b in found:
                yield edges(a, np.ascontiguousarray(b))

    for batch in batches:
        key = batch.column(0).to_numpy(zero_copy_only=False)
        fp = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        if not len(key):
            continue
        if held and held[-1][0][-1] == key[0] and key[-1] == key[0]:
            held.append((key, fp))
            continue
        if held:
            key, fp = np.concatenate([*(k for k, _ in held), key]), np.concatenate([*(f for _, f in held), fp])
        cut = int(np.searchsorted(key, key[-1]))
        held = [(key[cut:], fp[cut:])]
        if cut:
            yield from closed(key[:cut], fp[:cut])
    if held:
        yield from closed(np.concatenate([k for k, _ in held]), np.concatenate([f for _, f in held]))


def link_edges(classes: DataFrame) -> DataFrame:
    """Distinct fingerprints (fp) -> edges (u, v) whose components are those of all links."""
    byte = lambda p: F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255))

    def posting(i: int, chosen: tuple[int, ...]) -> Column:
        key = F.lit(i << 32)
        for k, p in enumerate(chosen):
            key = key.bitwiseOR(F.shiftleft(byte(p), 8 * k))
        return key

    posted = classes.select(F.explode(F.array(*[posting(i, c) for i, c in enumerate(CHOICES)])).alias("key"), "fp")
    return posted.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(posting_edges, "u bigint, v bigint")


def component_ids(prints: DataFrame, rep: Column) -> DataFrame:
    """prints (fp, ...) -> (fp, n, component): its rows, and the least ``rep`` over all rows reachable."""
    classes = materialise(prints.groupBy("fp").agg(F.min(rep).alias("rep"), F.count(F.lit(1)).alias("n")), "simhash-classes")
    roots = components(link_edges(classes.select("fp")))
    labelled = materialise(classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "n", "rep", "root"), "simhash-roots", (classes,))
    least = materialise(labelled.filter("root IS NOT NULL").groupBy("root").agg(F.min("rep").alias("least"), F.count(F.lit(1)).alias("prints")), "simhash-least")
    return look_up(labelled, least, "root", "prints").select("fp", "n", F.when(F.col("root").isNull(), F.col("rep")).otherwise(F.col("least")).alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id (smallest id reachable)."""
    prints = materialise(fingerprint_documents(docs, id_col, text_col), "simhash-prints")
    named = materialise(component_ids(prints, F.col("doc_id")), "simhash-components")
    return look_up(prints, named, "fp", "n").select(
        F.col("doc_id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id")
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, one of each component (that of the smallest id, of equal ids the least key), with all their columns."""
    key, name = row_key(id_col, text_col), fresh("__row_key", docs.columns)
    prints = materialise(fingerprint_documents(docs, id_col, text_col, key), "simhash-prints")
    named = component_ids(prints, F.struct(F.col("doc_id").isNull(), "doc_id", "extra"))
    best = named.select(F.col("component.extra").alias(name)).distinct()
    return docs.withColumn(name, key).join(best, name, "left_semi").dropDuplicates([name]).drop(name)


def op10_simhash_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
