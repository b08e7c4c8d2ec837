"""SimHash near-dedup by similarity: fingerprints choose candidates, exact shingle sets decide.

Texts are linked when the Jaccard similarity of their sets of 5-word shingles (as 64-bit XXH64 values) is 0.8 or
more. Estimates only choose what is compared; a link is made by the sets alone.

Of b bits (bit = sign of the summed hash bits over the distinct shingles) two texts whose angle is a differ in
b a / pi on average; with the sizes of both sets, cos a gives the shared shingles and these the similarity. Texts
of SHORT or more shingles get 512 bits, whose estimate has a standard error of up to about 0.04: those with a
partner at an estimate of 0.68 or more are candidates. Candidates alone get 2048 bits (error about 0.02), of
which the 512 are the first, and their sets. First a spanning forest of the pairs estimated at 0.8 or more is
compared exactly, then of the pairs at 0.7 or more, five errors below 0.8, the best between any two groups that
are left, and at last every one between groups that still are two.

At a similarity of 0.8 a byte agrees in place with a chance of 0.27. The first 32 bytes make the index, in two
halves of 16. The minimum number of matches is 5 of 32: five agreeing bytes put three in one half, so pairs
with three agreeing bytes of one half are tallied and those with five or more are verified on all bits. A
fingerprint is posted once under each (position, value) that may come first of the three; the other two are
found inside the posting, so 28 rows leave a fingerprint and not 1120. A pair at 0.8 reaches five matches with
a chance of 0.96, at 0.85 of 0.99.

Of fewer shingles the estimate is biased. Such texts, with all of up to 5/4 as many shingles that they can be
linked to, are matched without fingerprints: of two sets at 0.8 the n // 5 + 1 rarest shingles of each meet, so
these are posted and the sets compared inside the posting. No link is lost there.

Copies (equal shingle sets) are one class before the index. A posting gives a spanning forest of its links only,
at most one edge less than members, so dense groups cost about their size and no reachability is lost.

A posting has 1/256 of the distinct fingerprints or, of a group of near copies, most of the group. One of more than
PART members is posted once more under the second of the three places; what is still larger then is dealt out in
parts of about PART members, and a task takes one part or the pair of two, of which only links across are given. So a
task holds at most about two parts, however large a group is, and every pair of members still meets in one task. The
postings of short texts are dealt out alike.

Defined results: null and empty texts and texts of blanks have no shingle and are copies of each other, like
nothing else; fewer than five words are one shingle; of a group the row of the smallest id stays (null ids
last, of equal ids the least digest of id and text), once where rows repeat; an empty table gives no rows;
other columns are carried, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.llm import kernels as K
from chronolith.llm.common import discard, fresh, materialise, row_key, small_arrow_batches
from chronolith.llm.components import components

SHINGLE, SIMILARITY, CANDIDATE, COMPARED = 5, 0.8, 0.68, 0.7
#: Shingles from which on fingerprints choose the candidates, and the most that a text linked to a shorter one can have.
SHORT = 64
PARTNER = (SHORT - 1) * 5 // 4
WORDS, WIDE = 8, 32  # of 64 bits
INDEXED, HALVES, TOGETHER, LEAST = 32, 2, 3, 5
HALF = INDEXED // HALVES
#: Positions that can come first of TOGETHER positions of their half.
FIRSTS = tuple(h * HALF + i for h in range(HALVES) for i in range(HALF - TOGETHER + 1))
#: Members of a posting that a task takes at a time, by fingerprints and by whole sets.
PART, SET_PART = 1 << 17, 1 << 16
#: A posting's number: place and byte, then second place and byte (0: none), then the two parts of BITS bits each.
BITS = 17
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
#: Shingles whose bits are spread out at a time, and rows that a byte can count.
CHUNK, RUN = 1 << 15, 255
STEPS = np.arange(1, WIDE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> set[int]:
    """XXH64 of the distinct shingles of the folded text."""
    pieces = (text or "").translate(ASCII_LOWER).encode("utf-8", "surrogatepass").split()
    if not pieces:
        return set()
    joined = b" ".join(pieces)
    ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1)
    if len(pieces) < shingle:
        return {xxhash.xxh64_intdigest(joined)}
    starts = [0, *ends[: len(pieces) - shingle].tolist()]
    digest = xxhash.xxh64_intdigest
    return {digest(joined[x:y]) for x, y in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)}


def fingerprints(texts: list[str | None], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(texts, words) fingerprints, the narrower the start of the wider, and the numbers of distinct shingles."""
    return set_prints([shingle_hashes(t) for t in texts], words)


def set_prints(found: list[set[int]], words: int) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(s) for s in found], np.int64)
    owner = np.repeat(np.arange(len(found)), size)
    hashes = np.fromiter((h for s in found for h in s), np.uint64, int(size.sum()))
    ones = np.zeros((len(found), 64 * words), np.int32)
    chunk = CHUNK * WORDS // words
    for a in range(0, len(hashes), chunk):
        own = owner[a : a + chunk]
        spread = K.mixed(hashes[a : a + chunk, None] + STEPS[:words])
        bits = np.unpackbits(spread.view(np.uint8), axis=1, bitorder="little")
        first = np.zeros(len(own), bool)
        first[::RUN] = True
        first[1:] |= own[1:] != own[:-1]
        at = np.flatnonzero(first)
        np.add.at(ones, own[at], np.add.reduceat(bits, at, axis=0, dtype=np.uint8).astype(np.int32))
    packed = np.packbits(2 * ones > size[:, None], axis=1, bitorder="little")
    return packed.view(np.uint64).reshape(len(found), words), size


def similarity(bits: np.ndarray, a: np.ndarray, b: np.ndarray, words: int = WORDS) -> np.ndarray:
    """Estimated Jaccard similarity of sets of sizes a and b whose fingerprints differ in so many bits."""
    shared = np.minimum(np.cos(np.pi * bits / (64 * words)) * np.sqrt(a * b), np.minimum(a, b))
    return shared / (a + b - shared)


def linked(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, least: float = SIMILARITY) -> np.ndarray:
    """Tally the shared positional bytes, then verify those that reach the minimum."""
    first = np.ascontiguousarray(x[..., : INDEXED // 8] ^ y[..., : INDEXED // 8])
    good = (first.view(np.uint8).reshape(len(first), -1) == 0).sum(1) >= LEAST
    at = np.flatnonzero(good)
    apart = (x[at] if x.ndim == 2 else x) ^ (y[at] if y.ndim == 2 else y)
    good[at] = similarity(np.bitwise_count(apart).sum(1), nx[at] if nx.ndim else nx, ny[at], apart.shape[1]) >= least
    return good


def _places(position: int, second: int) -> Iterator[tuple[int, int]]:
    """The two places that can follow the first one; the next is ``second`` unless that is 0."""
    last = position - position % HALF + HALF
    return ((q, r) for q, r in combinations(range(position + 1, last), TOGETHER - 1) if second in (0, q))


def posting_forest(position: int, value: np.ndarray, fp: np.ndarray, size: np.ndarray, least: float = SIMILARITY, second: int = 0, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges (row, row) of a spanning forest of the links in the postings (position, value) of these rows.

    With ``side``, those that the forests of both sides, which other tasks give, are short of.
    """
    data = fp.view(np.uint8).reshape(len(fp), -1)
    sets, edges = K.Sets(len(fp)), []
    group = value.astype(np.int64) << 16

    def join(pairs: Iterator[tuple[int, int]], given: bool) -> None:
        new = [(i, j) for i, j in pairs if sets.join(i, j)]
        if given:
            edges.extend(new)

    def grow(rows: np.ndarray, given: bool) -> None:
        for q, r in _places(position, second):
            key = group[rows] | (data[rows, q].astype(np.int64) << 8) | data[rows, r]
            order = np.argsort(key, kind="stable")
            key, order = key[order], rows[order]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            count = np.diff(np.append(first, len(key)))
            two = first[count == 2]
            if len(two):
                i, j = order[two], order[two + 1]
                good = linked(fp[i], fp[j], size[i], size[j], least)
                join(zip(i[good].tolist(), j[good].tolist(), strict=True), given)
            for s, n in zip(first[count > 2].tolist(), count[count > 2].tolist(), strict=True):
                rest = order[s : s + n]
                roots = {sets.root(i) for i in rest.tolist()}
                if len(roots) == 1:
                    continue
                front: list[int] = []
                while len(rest):
                    if not front:
                        front, rest = [int(rest[0])], rest[1:]
                        continue
                    x = front.pop()
                    hit = linked(fp[rest], fp[x], size[x], size[rest], least)
                    join(((x, j) for j in rest[hit].tolist()), given)
                    front += rest[hit].tolist()
                    rest = rest[~hit]

    if side is not None:
        grow(np.flatnonzero(~side), False)
        grow(np.flatnonzero(side), False)
    grow(np.arange(len(fp)), True)
    return edges


def posting_pairs(position: int, value: np.ndarray, fp: np.ndarray, size: np.ndarray, label: np.ndarray, least: float, best: bool = False, second: int = 0, side: np.ndarray | None = None) -> np.ndarray:
    """All linked pairs (row, row) of different labels (and sides), each only in the first posting and places that it meets in; best: one for two labels."""
    data = fp.view(np.uint8).reshape(len(fp), -1)
    group, start, found = value.astype(np.int64) << 16, position - position % HALF, []
    for q, r in _places(position, second):
        key = group | (data[:, q].astype(np.int64) << 8) | data[:, r]
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        count = np.diff(np.append(first, len(key)))
        two = first[count == 2]
        pairs = [np.stack([order[two], order[two + 1]], 1)]
        for s, n in zip(first[count > 2].tolist(), count[count > 2].tolist(), strict=True):
            rest = order[s : s + n]
            _, name, members = np.unique(label[rest], return_inverse=True, return_counts=True)
            # Pairs with both ends in the largest group are none; any other has an end outside it.
            outside = name != members.argmax()
            for x in np.flatnonzero(outside).tolist():
                other = rest[~outside | (np.arange(n) > x)]
                pairs.append(np.stack([np.full(len(other), rest[x]), other], 1))
        for part in pairs:
            if side is not None:
                part = part[side[part[:, 0]] != side[part[:, 1]]]
            i, j = part[label[part[:, 0]] != label[part[:, 1]]].T
            same = data[i, :INDEXED] == data[j, :INDEXED]
            between = [c for c in range(start, r) if c not in (position, q)]
            new = ~same[:, between].any(1)
            for h in range(0, start, HALF):
                new &= same[:, h : h + HALF].sum(1) < TOGETHER
            i, j = i[new], j[new]
            if not len(i):
                continue
            good = linked(fp[i], fp[j], size[i], size[j], least)
            found.append(np.stack([i[good], j[good]], 1))
    pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
    if best and len(pairs):
        i, j = pairs.T
        estimate = similarity(np.bitwise_count(fp[i] ^ fp[j]).sum(1), size[i], size[j], fp.shape[1])
        low, high = np.minimum(label[i], label[j]), np.maximum(label[i], label[j])
        order = np.lexsort((-estimate, high, low))
        low, high = low[order], high[order]
        pairs = pairs[order[np.append(True, (low[1:] != low[:-1]) | (high[1:] != high[:-1]))]]
    return pairs


def similar_sets(shared: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of sizes a and b that share so many have a Jaccard similarity of 4/5 or more, in whole numbers."""
    return 5 * shared >= 4 * (a + b - shared)


def set_forest(flat: np.ndarray, bounds: np.ndarray, size: np.ndarray, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges (row, row) of a spanning forest of the exact links of sets, row i holding flat[bounds[i]:bounds[i + 1]] of size[i] shingles.

    With ``side``, those that the forests of both sides, which other tasks give, are short of.
    """
    sets, edges = K.Sets(len(size)), []
    distinct, names = np.unique(flat, return_inverse=True)
    mark, length = np.zeros(len(distinct), bool), np.diff(bounds)

    def grow(rest: np.ndarray, given: bool) -> None:
        held, starts = K.gathered(names, bounds[rest], length[rest])
        front: list[int] = []
        while len(rest):
            if front:
                x = front.pop()
                own = names[bounds[x] : bounds[x + 1]]
                mark[own] = True
                hit = similar_sets(np.add.reduceat(mark[held], starts[:-1], dtype=np.int64), size[x], size[rest])
                mark[own] = False
                new = [(x, j) for j in rest[hit].tolist() if sets.join(x, j)]
                if given:
                    edges.extend(new)
                front += rest[hit].tolist()
            else:
                front, hit = [int(rest[0])], np.arange(len(rest)) == 0
            if hit.any():
                rest = rest[~hit]
                held, starts = K.gathered(names, bounds[rest], length[rest])

    if side is not None:
        grow(np.flatnonzero(~side), False)
        grow(np.flatnonzero(side), False)
    grow(np.arange(len(size)), True)
    return edges


def _whole_postings(batches: Iterator[pa.RecordBatch], rows: int = 1 << 15) -> Iterator[pa.Table]:
    """Rows sorted by their first column, gathered to tables that cut no posting in two."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows and held[0].column(0)[0].as_py() != batch.column(0)[-1].as_py():
            t = pa.Table.from_batches(held)
            p = t.column(0).to_numpy()
            whole = int(np.searchsorted(p, p[-1]))
            yield t.slice(0, whole)
            held = t.slice(whole).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _edges(batches: Iterator[pa.RecordBatch], words: int = WORDS, least: float = SIMILARITY, best: bool = False) -> Iterator[pa.RecordBatch]:
    """Sorted (posting, node, n, fp, side) rows -> edges (u, v) of nodes; with a sixth column, label, those of ``posting_pairs``."""
    for t in _whole_postings(batches):
        posting, node, n, side, *label = (t.column(i).to_numpy() for i in range(t.num_columns) if i != 3)
        packed = t.column(3).combine_chunks()
        first = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset]
        fp = np.frombuffer(packed.buffers()[2], np.uint64, words * len(packed), int(first)).reshape(-1, words)
        place, value = posting >> 2 * BITS + 24, posting >> 2 * BITS + 16 & 255
        # Postings that are not split are taken together by place.
        together = np.where(posting & (1 << 2 * BITS + 16) - 1 == 0, place, posting)
        cut = np.flatnonzero(np.append(True, together[1:] != together[:-1]))
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(posting)], strict=True):
            rows, key = (int(place[a]), value[a:b], fp[a:b], n[a:b].astype(np.float64)), int(posting[a])
            across = key >> BITS & (1 << BITS) - 1 != key & (1 << BITS) - 1
            more = {"second": key >> 2 * BITS + 8 & 255, "side": side[a:b] if across else None}
            edges = posting_pairs(*rows, label[0][a:b], least, best, **more) if label else posting_forest(*rows, least, **more)
            edges = np.array(edges, np.int64).reshape(-1, 2) + a
            if len(edges):
                yield pa.RecordBatch.from_arrays([pa.array(node[edges[:, 0]]), pa.array(node[edges[:, 1]])], ["u", "v"])


def _set_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (posting, node, n, shingles, side) rows -> edges (u, v) of nodes whose sets are linked; odd postings are pairs of parts."""
    for t in _whole_postings(batches):
        posting, node, n, side = (t.column(i).to_numpy() for i in (0, 1, 2, 4))
        held = t.column(3).combine_chunks()
        bounds = np.concatenate([[0], np.cumsum(held.value_lengths().to_numpy())])
        flat = held.flatten().to_numpy()
        cut = np.flatnonzero(np.append(True, posting[1:] != posting[:-1]))
        edges = []
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(posting)], strict=True):
            if b - a > 1:
                across = side[a:b] if posting[a] & 1 else None
                edges += [(i + a, j + a) for i, j in set_forest(flat[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], n[a:b], across)]
        if edges:
            u, v = np.array(edges).T
            yield pa.RecordBatch.from_arrays([pa.array(node[u]), pa.array(node[v])], ["u", "v"])


def fingerprint_rows(docs: DataFrame, text_col: str, rep: Column, words: int = WORDS, most: int | None = PARTNER) -> DataFrame:
    """(rep, fp binary, n, digest, shingles): one row a document; shingles is empty beyond ``most`` of them."""
    frame = docs.select(rep.alias("rep"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in K.batches([t or "" for t in texts], 1 << 19):
                found = [shingle_hashes(t) for t in texts[a:b]]
                fp, size = set_prints(found, words)
                digest = np.array([sum(s) & (1 << 64) - 1 for s in found], np.uint64).view(np.int64)
                kept = [s if most is None or len(s) <= most else () for s in found]
                bounds = np.concatenate([[0], np.cumsum([len(s) for s in kept])]).astype(np.int32)
                flat = np.fromiter((h for s in kept for h in s), np.uint64, int(bounds[-1])).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([x.tobytes() for x in fp], pa.binary()), pa.array(size), pa.array(digest), pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat))],
                    ["rep", "fp", "n", "digest", "shingles"],
                )

    small_arrow_batches(docs.sparkSession)
    return frame.mapInArrow(run, f"rep {frame.schema[0].dataType.simpleString()}, fp binary, n bigint, digest bigint, shingles array<bigint>")


def in_parts(posted: DataFrame, part: int) -> DataFrame:
    """posted (posting, node, ...) with columns low, high, side: a row for each pair of parts that its own part is in.

    The large postings are a table on disk, which Spark broadcasts where its size is below the threshold.
    """
    large = posted.groupBy("posting").agg(F.count(F.lit(1)).alias("members")).filter(F.col("members") > part)
    large = materialise(large.select(F.col("posting").alias("of"), F.ceil(F.col("members") / part).cast("int").alias("parts")), "similar-large")
    dealt = posted.join(large, F.col("posting") == F.col("of"), "left").withColumn("own", F.expr("int(pmod(xxhash64(node), coalesce(parts, 1)))"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    ends = dealt.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
    return ends.withColumn("side", F.expr("own > other")).drop("of", "parts", "own", "other")


def link_edges(prints: DataFrame, words: int, least: float, best: bool = False) -> DataFrame:
    """(node, n, fp) -> edges (u, v) whose components are those of all estimated links that the index reaches; with label, those of ``posting_pairs``."""
    byte = lambda p: F.conv(F.hex(F.substring("fp", p + 1, 1)), 16, 10).cast("bigint")
    posting = lambda p: F.shiftleft(F.lit(p << 8).cast("bigint").bitwiseOR(byte(p)), 16)
    columns = ["node", "n", "fp", *(c for c in prints.columns if c == "label")]
    posted = prints.filter(F.col("n") >= SHORT).select(F.explode(F.array(*[posting(p) for p in FIRSTS])).alias("posting"), *columns)
    # At most len(FIRSTS) * 256 rows.
    large = posted.groupBy("posting").agg(F.count(F.lit(1)).alias("members")).filter(F.col("members") > PART)
    large = materialise(large.select(F.col("posting").alias("of")), "similar-large")
    posted = posted.join(F.broadcast(large), F.col("posting") == F.col("of"), "left")
    whole = posted.filter("of IS NULL").drop("of").withColumns({"low": F.lit(0), "high": F.lit(0), "side": F.lit(False)})
    seconds = F.expr(f"int(posting >> 24) - int(posting >> 24) % {HALF} + {HALF - TOGETHER + 1}")
    split = posted.filter("of IS NOT NULL").drop("of").withColumn("second", F.explode(F.sequence(F.expr("int(posting >> 24) + 1"), seconds)))
    value = F.conv(F.hex(F.expr("substring(fp, second + 1, 1)")), 16, 10).cast("bigint")
    split = split.withColumn("posting", F.col("posting").bitwiseOR(F.shiftleft(F.col("second").cast("bigint"), 8)).bitwiseOR(value)).drop("second")
    dealt = whole.unionByName(in_parts(split, PART)).withColumn("posting", F.expr(f"(posting << {2 * BITS}) | (bigint(low) << {BITS}) | high")).drop("low", "high")
    dealt = dealt.select("posting", "node", "n", "fp", "side", *columns[3:])
    small_arrow_batches(prints.sparkSession)
    # In order of the nodes the postings of a group agree on the ends of their edges.
    return dealt.repartition("posting").sortWithinPartitions("posting", "node").mapInArrow(partial(_edges, words=words, least=least, best=best), "u bigint, v bigint")


def short_edges(classes: DataFrame) -> DataFrame:
    """(node, n, shingles) -> edges (u, v) of a spanning forest, in each posting, of the exact links of texts of up to PARTNER shingles.

    A shingle of one text alone shares nothing: it counts in n and in the prefix, but is not carried.
    """
    sets = classes.filter(F.col("n").between(1, PARTNER)).select("node", "n", F.explode("shingles").alias("h"))
    common = sets.groupBy("h").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1")
    held = sets.join(common, "h").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("texts", "h"))).alias("held"))
    held = held.select("node", "n", F.col("held")["h"].alias("held")).withColumn("prefix", F.expr("int(n div 5 + 1 - (n - size(held)))"))
    held = materialise(held.filter("prefix > 0"), "similar-short")
    posted = held.select(F.explode(F.slice("held", F.lit(1), F.col("prefix"))).alias("posting"), "node", "n", "held")
    # Postings that share a number are compared as one; odd numbers are for pairs of two parts.
    number = F.expr("(xxhash64(posting, low, high) << 1) | int(low < high)")
    dealt = in_parts(posted, SET_PART).withColumn("posting", number).select("posting", "node", "n", "held", "side")
    small_arrow_batches(classes.sparkSession)
    return dealt.repartition("posting").sortWithinPartitions("posting", "node").mapInArrow(_set_edges, "u bigint, v bigint")


def compared(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """The edges (u, v) whose shingle sets, of (node, n, shingles), are linked.

    A node with very many edges is the smaller end as a rule: it is joined last, when rows are large enough for AQE to split.
    """
    pairs = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    for end in ("v", "u"):
        pairs = pairs.join(sets.select(F.col("node").alias(end), F.col("n").alias(f"n_{end}"), F.col("shingles").alias(f"of_{end}")), end)
    shared = F.size(F.array_intersect("of_u", "of_v"))
    return pairs.filter(similar_sets(shared, F.col("n_u"), F.col("n_v"))).select("u", "v")


def wide_prints(docs: DataFrame, text_col: str, rep: Column, candidates: DataFrame) -> DataFrame:
    """candidates (node, rep) -> (node, n, fp, shingles) with wide fingerprints and whole sets; only their texts are read on.

    Texts pass a semi-join with the candidates' 32-bit hashes first: that table is on disk, so Spark broadcasts
    it where its size is below the threshold and shuffles otherwise. The join by ``rep`` then is exact.
    """
    hashes = materialise(candidates.select(F.hash("rep").alias("__hash")), "similar-hashes")
    texts = docs.select(rep.alias("rep"), F.col(text_col).alias("text"))
    texts = texts.join(hashes, F.hash("rep") == F.col("__hash"), "left_semi")
    prints = fingerprint_rows(texts, "text", F.col("rep"), WIDE, None)
    return candidates.join(prints, "rep").dropDuplicates(["node"]).select("node", "n", "fp", "shingles")


def representatives(docs: DataFrame, text_col: str, rep: Column) -> DataFrame:
    """(node, rep, root): the classes of equal shingle sets with their least rep; root is shared by all that can be reached."""
    prints = fingerprint_rows(docs, text_col, rep)
    copies = prints.groupBy("fp", "n", "digest").agg(F.min("rep").alias("rep"), F.first("shingles").alias("shingles"))
    classes = materialise(copies.withColumn("node", F.monotonically_increasing_id()), "similar-classes")
    near = link_edges(classes, WORDS, CANDIDATE).select(F.explode(F.array("u", "v")).alias("node")).distinct()
    candidates = materialise(classes.join(near, "node", "left_semi").select("node", "rep"), "similar-candidates")
    wide = materialise(wide_prints(docs, text_col, rep, candidates), "similar-wide")
    forest = materialise(link_edges(wide, WIDE, SIMILARITY), "similar-forest")
    groups = materialise(components(compared(forest, wide).union(short_edges(classes))), "similar-groups", (forest,))
    for best in (True, False):
        labelled = wide.join(groups, "node", "left").select("node", "n", "fp", F.coalesce("root", "node").alias("label"))
        pairs = materialise(link_edges(labelled, WIDE, COMPARED, best), "similar-pairs")
        so_far = groups.select(F.col("node").alias("u"), F.col("root").alias("v"))
        groups = materialise(components(so_far.union(compared(pairs, wide))), "similar-groups", (pairs, groups))
    discard(wide, candidates)
    roots = groups.withColumnRenamed("node", "of")
    return classes.join(roots, F.col("node") == F.col("of"), "left").select("node", "rep", F.coalesce("root", "node").alias("root"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, one of each group, with all their columns."""
    key, name = row_key(id_col, text_col), fresh("__row_key", docs.columns)
    rep = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), key.alias("key"))
    best = representatives(docs, text_col, rep).groupBy("root").agg(F.min("rep").alias("rep")).select(F.col("rep.key").alias(name))
    return docs.withColumn(name, key).join(best, name, "left_semi").dropDuplicates([name]).drop(name)
