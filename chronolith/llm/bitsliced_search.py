"""Ranked lexical search on a bit-sliced impact index.

The impact of a term in a document is a whole number, fixed when the index is built. A segment has up to
``SEGMENT`` documents in order of id. For each of its terms it holds which documents have it, and the bits of their
impacts as slices: slice b has bit b of every posting, so a term with impacts of 30 bits has 30 bitmaps. A query's
scores are never computed one document at a time: the slices of its terms are added as bitmaps, 64 documents a machine
word, with carries from slice to slice. The best k come from the most significant slice down: while more than k
candidates have the bit, only these stay candidates; where fewer have it, they are in and the search goes on among
the others. What is left at the end is equal and is taken in order of id.

Steps: one pass counts each document's terms and keeps those the queries use (``postings``, written to the shared
folder); document frequencies and lengths are sums over it; segments are built from it and written as the index; the
search deals the index out by segment and leaves at most k rows a segment and query, which a window ranks. The index
has a row for every document that holds a term of the queries; other documents count in N and L and can't score.

Queries come in blocks, each with at most ``BLOCK_TERMS`` distinct terms and ``BLOCK_ITEMS`` queries, so what is sent to
all tasks (terms and weights of a block) and the sums that a task holds (``BLOCK_ITEMS`` x slices x ``SEGMENT`` / 8
bytes) are bounded whatever the number of queries. A query of more terms than a block has is a block of its own.

Defined results: null and empty texts have no terms and count in neither N nor L; a query without terms has no rows,
queries that share an id are one, of all their terms, and a null id is an id; rows of documents that repeat are ranked
each, null ids after all others at equal scores; only an id and a text are read, so clashing names do no harm; without
documents there are no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolith.llm import kernels as K
from chronolith.llm.common import UPPER, materialise, small_arrow_batches, table

#: ASCII characters that end a term: all but digits and letters.
STOPS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
SEGMENT = 1 << 15
BLOCK_TERMS, BLOCK_ITEMS = 1 << 15, 512
TOP = 50
POSTINGS = "doc_id bigint, n bigint, terms binary, tfs binary"
INDEX = "segment bigint, term int, size int, places binary, slices binary"
#: Number of the row of a segment that holds its ids.
IDS = -1


def terms_of(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms of the texts; of each occurrence its text and its place among those; terms a text."""
    cps, bounds = K.code_points(texts)
    cps = K.lower_ascii(cps)
    starts, ends, by_text = K.spans(K.all_but(STOPS)[cps], bounds)
    size = np.diff(by_text)
    if not len(starts):
        return [], starts, starts, size
    first, inverse = K.distinct_slices(cps, starts, ends)
    names = [cps[s:e].tobytes().decode("utf-32-le") for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
    return names, np.repeat(np.arange(len(texts)), size), inverse, size


def postings(docs: DataFrame, numbers: dict[str, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, terms, tfs): of every document its number of terms, and of the numbered terms those it holds, with counts."""
    sent = docs.sparkSession.sparkContext.broadcast(numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = sent.value
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in K.batches(texts):
                names, text, word, size = terms_of(texts[a:b])
                number = np.fromiter((numbers.get(w, -1) for w in names), np.int64, len(names))
                known = number[word] >= 0 if len(names) else np.zeros(0, bool)
                pair, tf = np.unique(text[known] * (1 << 32) + number[word[known]] if len(names) else np.zeros(0, np.int64), return_counts=True)
                at = np.searchsorted(pair >> 32, np.arange(b - a + 1))
                term, tf = (pair & 0xFFFFFFFF).astype(np.int32), tf.astype(np.int64)
                lists = [(term[x:y].tobytes(), tf[x:y].tobytes()) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(size.astype(np.int64)), pa.array([x for x, _ in lists], pa.binary()), pa.array([y for _, y in lists], pa.binary())], ["doc_id", "n", "terms", "tfs"])

    small_arrow_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col)).mapInArrow(run, POSTINGS)


def document_frequencies(posted: DataFrame, n_terms: int) -> np.ndarray:
    """Documents that hold each numbered term; each task sends one row a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_terms, np.int64)
        for batch in batches:
            found = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32)
            df += np.bincount(found, minlength=n_terms)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(df[some])], ["term", "df"])

    out = np.zeros(n_terms, np.int64)
    for r in posted.select("terms").mapInArrow(run, "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r["term"]] = r["df"]
    return out


def impacts(tf: np.ndarray, n: np.ndarray, weight: np.ndarray, n_docs: int, n_words: int) -> np.ndarray:
    """w * ((10**9 tf) div (1000 tf + 20 m)) with m = 100 - 50 + ((50 n N) div L), in whole numbers."""
    wide = object if len(n) and 50 * int(n.max()) * n_docs >= 1 << 63 else np.int64
    m = 50 + (n.astype(wide) * (50 * n_docs) // max(1, n_words)).astype(np.int64)
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


def sliced(values: np.ndarray) -> bytes:
    """Bit b of every value as a bitmap, least significant first."""
    bits = max(1, int(values.max()).bit_length())
    return np.packbits(((values[None, :] >> np.arange(bits)[:, None]) & 1).astype(np.uint8), axis=1, bitorder="little").tobytes()


def index_segments(batches: Iterator[pa.RecordBatch], weight: np.ndarray, n_docs: int, n_words: int, segment: int = SEGMENT) -> Iterator[pa.RecordBatch]:
    """Postings -> index rows: of a segment one row with its ids, then one a term with the places that hold it and the slices of their impacts."""
    base, made = TaskContext.get().partitionId() << 32, 0
    held: list[tuple] = []

    def build() -> Iterator[pa.RecordBatch]:
        held.sort(key=lambda r: (r[0] is None, r[0] or 0))
        size = np.fromiter((len(t) // 4 for *_, t, _ in held), np.int64, len(held))
        term = np.frombuffer(b"".join(t for *_, t, _ in held), np.int32).astype(np.int64)
        tf = np.frombuffer(b"".join(c for *_, c in held), np.int64)
        place = np.repeat(np.arange(len(held)), size)
        value = impacts(tf, np.fromiter((n for _, n, *_ in held), np.int64, len(held))[place], weight[term], n_docs, n_words)
        order = np.argsort(term, kind="stable")
        term, place, value = term[order], place[order], value[order]
        ids = pa.array([r[0] for r in held], pa.int64())
        valid = np.array([r[0] is not None for r in held])
        rows = [(base + made, IDS, len(held), np.packbits(valid, bitorder="little").tobytes(), ids.fill_null(0).to_numpy().tobytes())]
        cut = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else term
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(term)], strict=True):
            if value[a:b].max() > 0:
                rows.append((base + made, int(term[a]), b - a, place[a:b].astype(np.uint32).tobytes(), sliced(value[a:b])))
        for a in range(0, len(rows), 512):
            part = list(zip(*rows[a : a + 512], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(part, [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()], strict=True)], ["segment", "term", "size", "places", "slices"])

    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if row[2]:  # the others hold no term of the queries
                held.append(row)
                if len(held) == segment:
                    yield from build()
                    made += 1
                    held = []
    if held:
        yield from build()


def add_slices(total: list[np.ndarray], more: np.ndarray) -> None:
    """total += more, both as bitmaps of bits from the least significant up: a ripple of half and full adders."""
    carry = None
    for b in range(max(len(more), len(total))):
        if b == len(total):
            total.append(np.zeros_like(more[0]))
        x = total[b]
        if b < len(more):
            y = more[b]
            both = x & y
            x = x ^ y
            if carry is not None:
                both |= x & carry
                x ^= carry
            total[b], carry = x, both
        elif carry is None or not carry.any():
            return
        else:
            total[b], carry = x ^ carry, x & carry
    if carry is not None and carry.any():
        total.append(carry)


def best(total: list[np.ndarray], k: int) -> np.ndarray:
    """Places of the k largest sums above 0, equal ones by place, in order of place."""
    sure, open_ = np.zeros_like(total[0]), np.bitwise_or.reduce(total)
    for bits in reversed(total):
        if not open_.any():
            break
        with_bit = open_ & bits
        n = int(np.bitwise_count(sure | with_bit).sum())
        if n > k:
            open_ = with_bit
        else:
            sure, open_ = sure | with_bit, (open_ & ~bits if n < k else np.zeros_like(open_))
    at = lambda x: np.flatnonzero(np.unpackbits(x.view(np.uint8), bitorder="little"))
    found = at(sure)
    # candidates left at the end agree in every bit, so they may include sums of one value only
    return np.sort(np.concatenate([found, at(open_)[: k - len(found)]]))


def values_at(total: list[np.ndarray], places: np.ndarray) -> np.ndarray:
    word, bit = places >> 6, (places & 63).astype(np.uint64)
    out = np.zeros(len(places), np.int64)
    for b, bits in enumerate(total):
        out |= ((bits[word] >> bit) & np.uint64(1)).astype(np.int64) << b
    return out


def search_segments(batches: Iterator[pa.RecordBatch], users: dict[int, list[int]], k: int) -> Iterator[pa.RecordBatch]:
    """Index rows in order of segment and term -> (query, doc_id, score): each segment's best k of each query."""
    now, ids, valid, words = None, None, None, 0
    sums: dict[int, list[np.ndarray]] = {}

    def closed() -> Iterator[pa.RecordBatch]:
        for query, total in sorted(sums.items()):
            places = best(total, k)
            if len(places):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(places), query, np.int32)), pa.array(ids[places], mask=~valid[places]), pa.array(values_at(total, places))], ["query", "doc_id", "score"])
        sums.clear()

    for batch in batches:
        for segment, term, size, places, slices in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if segment != now:
                yield from closed()
                now = segment
            if term == IDS:
                ids, valid = np.frombuffer(slices, np.int64), np.unpackbits(np.frombuffer(places, np.uint8), count=size, bitorder="little").astype(bool)
                words = -(-size // 64)
                continue
            if term not in users:
                continue
            row = -(-size // 8)
            bits = np.unpackbits(np.frombuffer(slices, np.uint8).reshape(-1, row), axis=1, count=size, bitorder="little")
            spread = np.zeros((len(bits), 64 * words), np.uint8)
            spread[:, np.frombuffer(places, np.uint32)] = bits
            bitmaps = np.packbits(spread, axis=1, bitorder="little").view(np.uint64)
            for query in users[term]:
                if query in sums:
                    add_slices(sums[query], bitmaps)
                else:
                    sums[query] = list(bitmaps)
    yield from closed()


def query_blocks(queries: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[object, list[str]]]]:
    """Queries with their distinct terms, a block at a time; read one partition at a time, never whole."""
    terms = F.udf(lambda texts: sorted(set(terms_of([t or "" for t in texts])[0])), "array<string>")
    rows = queries.groupBy(F.col(id_col).alias("id")).agg(F.collect_set(text_col).alias("texts")).select("id", terms("texts").alias("terms"))
    block: list[tuple[object, list[str]]] = []
    names: set[str] = set()
    for r in rows.filter(F.size("terms") > 0).orderBy("id").toLocalIterator():
        more = names.union(r["terms"])
        if block and (len(more) > BLOCK_TERMS or len(block) == BLOCK_ITEMS):
            yield block
            block, more = [], set(r["terms"])
        block.append((r["id"], r["terms"]))
        names = more
    if block:
        yield block


class Index:
    """The segments of all documents for a set of terms: a table in the shared folder, and the numbers of the terms."""

    def __init__(self, docs: DataFrame, terms: list[str], id_col: str = "doc_id", text_col: str = "text", segment: int = SEGMENT) -> None:
        self.numbers = {t: i for i, t in enumerate(sorted(set(terms)))}
        posted = materialise(postings(docs, self.numbers, id_col, text_col), "search-postings")
        n_docs, n_words = posted.filter("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = document_frequencies(posted, len(self.numbers))
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) if d else 0 for d in df.tolist()], np.int64)
        rows = posted.mapInArrow(lambda batches: index_segments(batches, weight, n_docs, n_words, segment), INDEX)
        self.rows = materialise(rows, "search-index", (posted,))

    def search(self, queries: list[tuple[object, list[str]]], k: int = TOP) -> DataFrame:
        """(query, doc_id, score, rank): the best k documents of each query, by its place in the list."""
        users: dict[int, list[int]] = {}
        for i, (_, terms) in enumerate(queries):
            for t in set(terms):
                if t in self.numbers:
                    users.setdefault(self.numbers[t], []).append(i)
        small_arrow_batches(self.rows.sparkSession, rows=256)
        dealt = self.rows.repartition("segment").sortWithinPartitions("segment", "term")
        found = dealt.mapInArrow(lambda batches: search_segments(batches, users, k), "query int, doc_id bigint, score bigint")
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(docs: DataFrame, queries: DataFrame, k: int = TOP, query_id: str = "item_id", query_text: str = "text", id_col: str = "doc_id", text_col: str = "text", segment: int = SEGMENT) -> DataFrame:
    """(query id, rank, doc id, score): the best k documents of every query."""
    spark, out = docs.sparkSession, None
    kind = queries.schema[query_id].dataType
    for block in query_blocks(queries, query_id, query_text):
        index = Index(docs, [t for _, terms in block for t in terms], id_col, text_col, segment)
        names = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(block)], f"query int, `{query_id}` {kind.simpleString()}")
        found = index.search(block, k).join(F.broadcast(names), "query").select(f"`{query_id}`", "rank", F.col("doc_id").alias(id_col), "score")
        out = found if out is None else out.union(found)
    if out is None:
        empty = queries.limit(0).select(f"`{query_id}`", F.lit(0).alias("rank"), F.lit(0).cast("bigint").alias(id_col), F.lit(0).cast("bigint").alias("score"))
        return empty
    return out


def op13_bitsliced_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = f"""
WITH words AS (
    SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents
), sizes AS (SELECT row, doc_id, len(w)::BIGINT AS n FROM words WHERE len(w) > 0),
all_sizes AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM sizes),
items AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark
), counts AS (
    SELECT row, term, count(*)::BIGINT AS tf FROM (SELECT row, unnest(w) AS term FROM words) WHERE term IN (SELECT term FROM items) GROUP BY ALL
), weights AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*)::BIGINT AS df FROM counts GROUP BY term), all_sizes),
impact AS (
    SELECT c.row, doc_id, c.term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // total)))) AS impact
    FROM counts c JOIN weights USING (term) JOIN sizes USING (row), all_sizes
), scores AS (SELECT item_id, row, doc_id, sum(impact)::BIGINT AS score FROM items JOIN impact USING (term) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scores WHERE score > 0 QUALIFY rank <= {TOP}
"""
