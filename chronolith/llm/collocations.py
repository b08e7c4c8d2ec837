"""Phrase collocation mining with depth-limited count tries.

A shard is what one task holds of a language before it must be emptied (``SHARD_WORDS`` words). Its count trie has
depth 3: one node for each word, pair and triple of neighbours within a piece, with its number of occurrences. The
trie is serialised sorted, in preorder, as runs of about ``CHUNK`` nodes: a run has its words in order, the nodes as
three columns of word numbers, and their counts. Runs are written to the shared folder. Prefix ranges are then cut
from the heads of the runs, so that each has about ``RANGE_NODES`` nodes; a range may begin inside the subtree of a
frequent word or pair, whose own nodes go to every range that begins below them. Every task merges the runs of its
ranges: word numbers are put on one scale, and a sort that makes use of runs in order merges the k runs. A walk
of the merged trie gives the counts of the left parts (a node's ancestors). Only nodes of at least ``min_count``
leave the merge. Right parts come by suffix links: the node without its first word, whose own link leads to the last
word alone; a link crosses ranges, so it is an equi-join of tables of frequent nodes.

Bounds: a task holds one shard's word numbers, or one range's runs in compressed form and ``MERGE_NODES`` decoded
nodes (a range beyond that is merged in halves). The driver holds at most ``RANGES`` cuts; they are sent to all tasks,
their words cut to ``CUT_BYTES`` bytes each (a shortened word is a bound as good).

Defined results: null and empty texts hold no words; a null lang is ``und``; rows that repeat count each time; no
columns but lang and text are read, so clashing names do no harm; ties in score are broken by count and phrase, so
ranks are unique; an empty table gives no rows.
"""

from __future__ import annotations

import struct
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolith.llm import kernels as K
from chronolith.llm.common import UPPER, materialise, small_arrow_batches, table

BLANKS, BREAKS = " \t", ".,;:!?\n\x0b\x0c\r"
DEPTH, BITS = 3, 21
MASK = (1 << BITS) - 1
SHARD_WORDS, SHARD_VOCABULARY = 1_200_000, 500_000
CHUNK, RANGE_NODES, MERGE_NODES, RANGES, CUT_BYTES = 1 << 16, 750_000, 2_000_000, 1 << 16, 64
#: Code points of texts that are taken apart at once.
BATCH_CHARS = 1 << 19
MIN_COUNT, DOMINATED, TOP = 10, 50, 2000
UNKNOWN = "und"
RUN = "lang string, nodes bigint, head array<binary>, run binary"

Words = tuple[bytes, ...]
#: A sorted trie: words in order, keys (numbers of up to three words from 1 on, 0 for none, packed) in preorder, counts.
Trie = tuple[list[bytes], np.ndarray, np.ndarray]


def pack(a: np.ndarray | int, b: np.ndarray | int = 0, c: np.ndarray | int = 0) -> np.ndarray | int:
    return (a << (2 * BITS)) | (b << BITS) | c


def unpack(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return keys >> (2 * BITS), (keys >> BITS) & MASK, keys & MASK


def renumbered(keys: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Keys with each word number replaced by number[it]; order is kept if the new numbers rise."""
    return pack(*(number[x] for x in unpack(keys)))


class Shard:
    """The words of one language that a task has read, until the trie is built."""

    def __init__(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.ids: list[np.ndarray] = []
        self.tied: list[np.ndarray] = []
        self.size = 0

    def add(self, words: list[bytes], inverse: np.ndarray, tied: np.ndarray) -> None:
        """Words in order of text, as places in a list of distinct ones; tied: the next word stands in the same piece."""
        numbers = self.numbers
        known = np.fromiter((numbers.setdefault(w, len(numbers) + 1) for w in words), np.int64, len(words))
        self.ids.append(known[inverse].astype(np.int32))
        self.tied.append(tied)
        self.size += len(inverse)

    def full(self, shard_words: int) -> bool:
        return self.size >= shard_words or len(self.numbers) >= SHARD_VOCABULARY

    def trie(self) -> Trie:
        words = sorted(self.numbers)
        rank = np.zeros(len(words) + 1, np.int64)
        rank[np.fromiter((self.numbers[w] for w in words), np.int64, len(words))] = np.arange(1, len(words) + 1)
        ids, tied = rank[np.concatenate(self.ids)], np.concatenate(self.tied)
        counts = np.bincount(ids, minlength=len(words) + 1)[1:]
        two = pack(ids[:-1], ids[1:])[tied[:-1]]
        three = (pack(ids[:-2], ids[1:-1]) | ids[2:])[tied[:-2] & tied[1:-1]] if len(ids) > 2 else two[:0]
        levels = [(pack(np.arange(1, len(words) + 1)), counts), np.unique(two, return_counts=True), np.unique(three, return_counts=True)]
        keys, counts = np.concatenate([k for k, _ in levels]), np.concatenate([c for _, c in levels])
        order = np.argsort(keys, kind="stable")
        return words, keys[order], counts[order]


def dump(trie: Trie) -> bytes:
    """A run: the words that its nodes use, and its columns, compressed."""
    words, keys, counts = trie
    used = np.zeros(len(words) + 1, bool)
    for x in unpack(keys):
        used[x] = True
    used[0] = True
    keys = renumbered(keys, np.cumsum(used) - 1)
    text = b"\n".join([words[i - 1] for i in np.flatnonzero(used)[1:].tolist()])
    body = text + b"".join(x.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes() for x in unpack(keys)) + counts.astype(np.uint64).view(np.uint8).reshape(-1, 8).T.tobytes()
    return struct.pack("<QQQ", len(body), len(text), len(keys)) + pa.compress(body, "zstd", asbytes=True)


def nodes_of(run: bytes) -> int:
    return struct.unpack_from("<Q", run, 16)[0]


def load(run: bytes) -> Trie:
    size, text, n = struct.unpack_from("<QQQ", run)
    body = pa.decompress(run[24:], size, "zstd", asbytes=True)
    columns = [np.frombuffer(body, np.uint8, 4 * n, text + 4 * n * i).reshape(4, n).T.copy().view(np.uint32).ravel().astype(np.int64) for i in range(DEPTH)]
    counts = np.frombuffer(body, np.uint8, 8 * n, text + 12 * n).reshape(8, n).T.copy().view(np.uint64).ravel().astype(np.int64)
    return body[:text].split(b"\n"), pack(*columns), counts


def phrase(words: list[bytes], key: int) -> Words:
    return tuple(words[i - 1] for i in (key >> (2 * BITS), (key >> BITS) & MASK, key & MASK) if i)


def chunks(trie: Trie, chunk: int) -> Iterator[tuple[Words, int, bytes]]:
    """The runs of a trie: first phrase, nodes, bytes."""
    words, keys, counts = trie
    for a in range(0, len(keys), chunk):
        part = words, keys[a : a + chunk], counts[a : a + chunk]
        yield phrase(words, int(keys[a])), len(part[1]), dump(part)


def place(words: list[bytes], cut: Words) -> int:
    """The least key over these words that is not before the cut."""
    numbers = []
    for w in cut:
        i = bisect_left(words, w)
        numbers.append(i + 1)
        if i == len(words) or words[i] != w:
            break  # everything from here on lies behind the cut, or the next word is larger already
    return pack(*numbers, *[0] * (DEPTH - len(numbers)))


def split(trie: Trie, cuts: list[Words]) -> Iterator[tuple[int, Trie]]:
    """(number of cuts at or before, part) of a trie. The ancestors of a cut go with the part behind it as well."""
    words, keys, counts = trie
    at = [0, *np.searchsorted(keys, np.array([place(words, c) for c in cuts], np.int64)).tolist(), len(keys)]
    for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
        extra = []
        for d in range(1, len(cuts[i - 1]) if i else 0):
            key = place(words, cuts[i - 1][:d])
            j = int(np.searchsorted(keys, key))
            if j < len(keys) and phrase(words, int(keys[j])) == cuts[i - 1][:d]:
                extra.append(j)
        if b > a or extra:
            chosen = np.concatenate([np.array(extra, np.int64), np.arange(a, b)])
            yield i, (words, keys[chosen], counts[chosen])


def merged(tries: list[Trie]) -> Trie:
    """One trie of k sorted ones: words on one scale, then a merge of the runs, then equal nodes in one."""
    words = sorted(set().union(*(t[0] for t in tries)))
    number = {w: i for i, w in enumerate(words, 1)}
    keys = np.concatenate([renumbered(k, np.fromiter((0, *(number[w] for w in ws)), np.int64, len(ws) + 1)) for ws, k, _ in tries])
    counts = np.concatenate([c for *_, c in tries])
    order = np.argsort(keys, kind="stable")  # merges what is in order already
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return words, keys[first], np.add.reduceat(counts, first) if len(first) else counts


def merged_range(runs: list[bytes], low: Words, min_count: int, most: int = MERGE_NODES) -> Iterator[tuple[Words, int, int, int]]:
    """(phrase, f, f of its first word, f of its first two) of a range's frequent nodes; () has the words counted in it."""
    total = sum(map(nodes_of, runs))
    if total > most and len(runs) > 1:
        words, keys, _ = load(max(runs, key=nodes_of))
        # the middle node of the longest run behind the lower bound halves the range
        after = keys[np.searchsorted(keys, place(words, low)) :] if low else keys
        middle = phrase(words, int(after[len(after) // 2])) if len(after) > 1 else low
        if middle > low:
            halves: list[list[bytes]] = [[], []]
            for run in runs:
                for i, part in split(load(run), [middle]):
                    halves[i].append(dump(part))
            if sum(map(nodes_of, halves[0])) < total and sum(map(nodes_of, halves[1])) < total:
                yield from merged_range(halves[0], low, min_count, most)
                yield from merged_range(halves[1], middle, min_count, most)
                return
    words, keys, f = merged([load(r) for r in runs])
    one, two, three = unpack(keys)
    own = keys >= place(words, low) if low else np.ones(len(keys), bool)
    yield (), int(f[own & (two == 0)].sum()), 0, 0
    # the walk: in preorder a node's ancestors are the last nodes of lesser depth before it
    index = np.arange(len(keys))
    left = f[np.maximum.accumulate(np.where(two == 0, index, 0))]
    pair = f[np.maximum.accumulate(np.where((two != 0) & (three == 0), index, 0))]
    for i in np.flatnonzero(own & (f >= min_count)).tolist():
        yield phrase(words, int(keys[i])), int(f[i]), int(left[i]) if two[i] else 0, int(pair[i]) if three[i] else 0


def shard_runs(batches: Iterator[pa.RecordBatch], shard_words: int = SHARD_WORDS, chunk: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> the runs of the tries of this task's shards."""
    shards: dict[str, Shard] = {}
    solid, broken = K.all_but(BLANKS + BREAKS), ~K.all_but(BREAKS)

    def runs(lang: str) -> Iterator[pa.RecordBatch]:
        for head, n, run in chunks(shards.pop(lang).trie(), chunk):
            yield pa.RecordBatch.from_pylist([{"lang": lang, "nodes": n, "head": list(head), "run": run}], schema=pa.schema([("lang", pa.string()), ("nodes", pa.int64()), ("head", pa.list_(pa.binary())), ("run", pa.binary())]))

    for batch in batches:
        by_lang: dict[str, list[str]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if text:
                by_lang.setdefault(lang, []).append(text)
        for lang, texts in by_lang.items():
            for a, b in K.batches(texts, BATCH_CHARS):
                cps, bounds = K.code_points(texts[a:b])
                cps = K.lower_ascii(cps)
                starts, ends, by_text = K.spans(solid[cps], bounds)
                if not len(starts):
                    continue
                piece = np.cumsum(broken[cps])[starts]
                tied = np.append(piece[1:] == piece[:-1], False)
                tied[by_text[1:][by_text[1:] > 0] - 1] = False
                first, inverse = K.distinct_slices(cps, starts, ends)
                words = [cps[s:e].tobytes().decode("utf-32-le").encode() for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
                shard = shards.setdefault(lang, Shard())
                shard.add(words, inverse, tied)
                if shard.full(shard_words):
                    yield from runs(lang)
            if sum(s.size for s in shards.values()) >= shard_words:
                yield from runs(max(shards, key=lambda x: shards[x].size))
    for lang in list(shards):
        yield from runs(lang)


def range_cuts(runs: DataFrame, range_nodes: int = RANGE_NODES) -> list[tuple[bytes, Words]]:
    """Bounds (lang, phrase) between prefix ranges, from the heads of the runs (of a fair part of these where there are very many)."""
    n, total = runs.agg(F.count(F.lit(1)), F.sum("nodes")).first()
    if not n:
        return []
    ranges = min(RANGES, max(1, total // range_nodes))
    share = min(1.0, 8 * RANGES / n)
    heads = runs.filter(F.xxhash64("run").bitwiseAND(F.lit((1 << 63) - 1)) <= F.lit(share * 2.0**63)) if share < 1 else runs
    rows = heads.select("lang", "nodes", F.expr(f"transform(head, w -> substring(w, 1, {CUT_BYTES}))").alias("head")).collect()
    step, held, cuts = sum(r["nodes"] for r in rows) / ranges, 0, []
    for lang, head, nodes in sorted((r["lang"].encode(), tuple(bytes(w) for w in r["head"]), r["nodes"]) for r in rows):
        if held >= step * (len(cuts) + 1) and (lang, head) > (cuts[-1] if cuts else (b"", ())):
            cuts.append((lang, head))
        held += nodes
    return cuts


def frequent_nodes(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", min_count: int = MIN_COUNT, *,
    shard_words: int = SHARD_WORDS, chunk: int = CHUNK, range_nodes: int = RANGE_NODES, merge_nodes: int = MERGE_NODES,
) -> DataFrame:
    """(lang, depth, phrase, suffix, f, l1, l2): nodes of the whole trie with f >= min_count, and rows of depth 0 with counts of words."""
    spark = docs.sparkSession
    small_arrow_batches(spark, 250, "8m")
    chosen = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).alias("text"))
    runs = materialise(chosen.mapInArrow(lambda batches: shard_runs(batches, shard_words, chunk), RUN), "collocation-runs")
    cuts = range_cuts(runs, range_nodes)
    sent = spark.sparkContext.broadcast(cuts)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = sent.value
        ancestors = sorted((lang, c[:d], i) for i, (lang, c) in enumerate(cuts, 1) for d in range(1, len(c)))
        for batch in batches:
            for lang, run in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                name = lang.encode()
                trie = load(run)
                words, keys, counts = trie
                low, high = (name, phrase(words, int(keys[0]))), (name, phrase(words, int(keys[-1])))
                a, b = bisect_right(cuts, low), bisect_right(cuts, high)
                parts: dict[int, list[Trie]] = {}
                for i, part in split(trie, [c for _, c in cuts[a:b]]):
                    parts.setdefault(a + i, []).append(part)
                # nodes here that are ancestors of a cut go to that cut's range as well
                for j in range(bisect_left(ancestors, (*low, 0)), bisect_right(ancestors, (*high, len(cuts)))):
                    _, node, i = ancestors[j]
                    if a < i <= b:
                        continue  # the split has seen to it
                    at = int(np.searchsorted(keys, place(words, node)))
                    if at < len(keys) and phrase(words, int(keys[at])) == node:
                        parts.setdefault(i, []).append((words, keys[at : at + 1], counts[at : at + 1]))
                for i, found in parts.items():
                    for part in found:
                        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([lang]), pa.array([dump(part)], pa.binary())], ["part", "lang", "run"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, held, now = sent.value, [], None

        def done() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            part, lang = now
            low = cuts[part - 1][1] if part and cuts[part - 1][0] == lang.encode() else ()
            rows = []
            for node, f, l1, l2 in merged_range(held, low, min_count, merge_nodes):
                rows.append((lang, len(node), b" ".join(node).decode(), b" ".join(node[1:]).decode(), f, l1, l2))
                if len(rows) == 10_000:
                    yield batch_of(rows)
                    rows = []
            if rows:
                yield batch_of(rows)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["lang", "depth", "phrase", "suffix", "f", "l1", "l2"])

        for batch in batches:
            for key, run in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), batch.column(2).to_pylist(), strict=True):
                if key != now:
                    yield from done()
                    held, now = [], key
                held.append(run)
        yield from done()

    dealt = runs.select("lang", "run").mapInArrow(deal, "part int, lang string, run binary")
    nodes = dealt.repartition("part").sortWithinPartitions("part", "lang").mapInArrow(merge, "lang string, depth int, phrase string, suffix string, f bigint, l1 bigint, l2 bigint")
    made = materialise(nodes, "collocation-nodes", (runs,))
    sent.unpersist()
    return made


def score(a: str, left: str, right: str) -> Column:
    """floor(1000000 a a / (left right)); exact while the counts stay below 10**15 (38 digits)."""
    wide = lambda x: f"cast({x} AS decimal(19,0))"
    top = f"cast(cast({wide(a)} * {wide(a)} AS decimal(31,0)) * 1000000BD AS decimal(38,0))"
    return F.expr(f"{top} div cast({wide(left)} * {wide(right)} AS decimal(38,0))")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", min_count: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of two or three words."""
    nodes = frequent_nodes(docs, lang_col, text_col, min_count)
    words = nodes.filter("depth = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    ones = nodes.filter("depth = 1").select(F.col("lang").alias("lang_"), F.col("phrase").alias("word"), F.col("f").alias("last"))
    pairs = nodes.filter("depth = 2").join(ones, (F.col("lang") == F.col("lang_")) & (F.col("suffix") == F.col("word"))).select("lang", "phrase", "f", "l1", "last")
    pairs = materialise(pairs, "collocation-pairs")  # suffix links of pairs: to their last words
    link = pairs.select(F.col("lang").alias("lang_"), F.col("phrase").alias("tail"), F.col("f").alias("rest"), "last")
    triples = nodes.filter("depth = 3").join(link, (F.col("lang") == F.col("lang_")) & (F.col("suffix") == F.col("tail")))
    triples = materialise(triples.select("lang", "phrase", "f", "l1", "l2", "rest", "last"), "collocation-triples")
    # a pair inside a triple that is half as frequent or more says nothing of its own
    inner = triples.select("lang", F.explode(F.expr("array(substring_index(phrase, ' ', 2), substring_index(phrase, ' ', -2))")).alias("inner"), "f")
    longer = inner.groupBy("lang", "inner").agg(F.max("f").alias("longer")).withColumnRenamed("lang", "lang_")
    kept = pairs.join(longer, (F.col("lang") == F.col("lang_")) & (F.col("phrase") == F.col("inner")), "left")
    kept = kept.filter(f"longer IS NULL OR cast(longer AS decimal(38,0)) * 100 < cast(f AS decimal(38,0)) * {DOMINATED}")
    two = kept.select("lang", "phrase", F.col("f").alias("a"), F.col("l1").alias("l"), F.col("last").alias("r"), score("f", "l1", "last").alias("score"))
    three = triples.withColumn("s1", score("f", "l1", "rest")).withColumn("s2", score("f", "l2", "last")).select(
        "lang", "phrase", F.col("f").alias("a"), F.expr("if(s1 <= s2, l1, l2)").alias("l"), F.expr("if(s1 <= s2, rest, last)").alias("r"), F.expr("least(s1, s2)").alias("score"))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # the best of each of many parts of a language first, so that no task ranks all of a language
    best = two.union(three).withColumn("__part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    best = best.withColumn("__place", F.row_number().over(Window.partitionBy("lang", "__part").orderBy(*order))).filter(F.col("__place") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return best.join(words, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocation_tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH pieces AS (
    SELECT coalesce(lang, '{UNKNOWN}') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
), lists AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
placed AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists WHERE len(w) > 0),
ones AS (SELECT lang, w[i] AS p, count(*) AS f FROM placed GROUP BY ALL),
twos AS (SELECT lang, w[i] AS p1, w[i + 1] AS p2, count(*) AS f FROM placed WHERE i + 1 <= len(w) GROUP BY ALL HAVING count(*) >= {MIN_COUNT}),
threes AS (SELECT lang, w[i] AS p1, w[i + 1] AS p2, w[i + 2] AS p3, count(*) AS f FROM placed WHERE i + 2 <= len(w) GROUP BY ALL HAVING count(*) >= {MIN_COUNT}),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM ones GROUP BY lang),
cuts AS (
    SELECT t.lang, p1 || ' ' || p2 AS phrase, 1 AS k, t.f AS a, x.f AS l, y.f AS r FROM twos t
        JOIN ones x ON x.lang = t.lang AND x.p = p1 JOIN ones y ON y.lang = t.lang AND y.p = p2
    UNION ALL SELECT t.lang, t.p1 || ' ' || t.p2 || ' ' || t.p3, 1, t.f, x.f, y.f FROM threes t
        JOIN ones x ON x.lang = t.lang AND x.p = t.p1 JOIN twos y ON y.lang = t.lang AND y.p1 = t.p2 AND y.p2 = t.p3
    UNION ALL SELECT t.lang, t.p1 || ' ' || t.p2 || ' ' || t.p3, 2, t.f, x.f, y.f FROM threes t
        JOIN twos x ON x.lang = t.lang AND x.p1 = t.p1 AND x.p2 = t.p2 JOIN ones y ON y.lang = t.lang AND y.p = t.p3
), scored AS (SELECT *, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score FROM cuts),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
    SELECT lang, phrase, max(f) AS longer FROM (
        SELECT lang, p1 || ' ' || p2 AS phrase, f FROM threes UNION ALL SELECT lang, p2 || ' ' || p3, f FROM threes) GROUP BY ALL
), kept AS (
    SELECT s.* FROM lowest s LEFT JOIN inside i ON i.lang = s.lang AND i.phrase = s.phrase AND len(string_split(s.phrase, ' ')) = 2
    WHERE i.longer IS NULL OR 100 * i.longer < {DOMINATED} * s.a
)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept k JOIN totals USING (lang) QUALIFY rank <= {TOP}
"""
