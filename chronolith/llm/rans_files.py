"""Token-ID output in a file format of static range asymmetric numeral systems (rANS).

Documents are sorted by id over all partitions, tokenised, and written as files of about ``FILE_TOKENS``
ids. A file holds one frequency table, shared by its blocks, and independent blocks of about
``BLOCK_TOKENS`` ids, each ending with a document. A block interleaves ``LANES`` coder states: id i belongs
to lane i modulo ``LANES``, so all lanes step together in array operations. Every ``CHECKPOINT`` steps the
states and the place in the word stream are recorded: decoding may start there, and a reader decodes all the
stretches between checkpoints of a block side by side. Every block carries a CRC-32 of its bytes. The files travel as binary values of a Parquet table (part, seq, n_tokens, file):
Spark's committers then write them to any store, and a lost executor's files are written again or not at
all.

Coder: 64-bit states in [2**31, 2**63), 32-bit words, frequencies summing to 2**20.

Defined results: null and empty texts are documents of the end id alone; ids may be null (first) or repeat
(then in order of a hash of the text); a document longer than a block is a block of its own; an empty
table gives no files and no rows; columns other than the id and text are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolith.llm import kernels as K
from chronolith.llm.common import scratch_path, small_arrow_batches, table, text_or_empty
from chronolith.llm.lexicon_bpe import byte_symbols

MAGIC = b"RANSIDS1"
SCALE, LOW = 20, np.uint64(1 << 31)
LANES, CHECKPOINT = 512, 128
BLOCK_TOKENS, FILE_TOKENS = 1 << 17, 1 << 20
REMEMBERED = 1_200_000
END_ID = 0
U = np.uint64


def scaled_frequencies(counts: np.ndarray) -> np.ndarray:
    """Positive integers that sum to 2**SCALE, in proportion to the (positive) counts as near as may be."""
    total, want = int(counts.sum()), 1 << SCALE
    freq = np.maximum(1, counts.astype(np.int64) * want // total)
    order = np.argsort(-freq, kind="stable")
    over = int(freq.sum()) - want
    while over > 0:  # lower the largest, none below 1
        share = np.minimum(freq[order] - 1, -(-over * freq[order] // int(freq.sum())))
        cut = np.minimum(share, np.maximum(0, over - (np.cumsum(share) - share)))
        freq[order] -= cut
        over = int(freq.sum()) - want
    freq[order[0]] -= over
    return freq


def encode_block(ids: np.ndarray, freq: np.ndarray, start: np.ndarray) -> bytes:
    """ids as positions in the table -> header, checkpoints (states and word offsets), words."""
    n = len(ids)
    steps = -(-n // LANES)
    lanes = np.full(LANES, LOW, U)
    f, c = freq[ids].astype(U), start[ids].astype(U)
    out: list[np.ndarray] = []
    marks: list[np.ndarray] = []
    shift, half = U(SCALE), U(32)
    for s in range(steps - 1, -1, -1):
        a, b = s * LANES, min(n, (s + 1) * LANES)
        x, fs = lanes[: b - a], f[a:b]
        full = x >= (fs << U(31 - SCALE + 32))
        out.append((x[full] & U(0xFFFFFFFF)).astype(np.uint32))
        x = np.where(full, x >> half, x)
        q = x // fs
        lanes[: b - a] = (q << shift) + (x - q * fs) + c[a:b]
        if s % CHECKPOINT == 0:
            marks.append(lanes.copy())
    out.reverse()
    marks.reverse()
    at = np.concatenate([[0], np.cumsum([len(w) for w in out])]).astype(np.uint64)
    words = np.concatenate(out) if out else np.zeros(0, np.uint32)
    body = struct.pack("<QQ", n, len(words)) + at[0:steps:CHECKPOINT].tobytes() + b"".join(m.tobytes() for m in marks) + words.tobytes()
    return struct.pack("<QI", len(body), zlib.crc32(body)) + body


def decode_block(data: memoryview, freq: np.ndarray, start: np.ndarray, slots: np.ndarray, first: int = 0) -> np.ndarray:
    """Positions in the table from checkpoint ``first`` on; a broken block raises ValueError.

    All checkpoints start at once: a step decodes one id of every lane of every stretch between them.
    """
    size, crc = struct.unpack_from("<QI", data)
    body = data[12 : 12 + size]
    if len(body) != size or zlib.crc32(body) != crc:
        raise ValueError("a block fails its checksum")
    n, n_words = struct.unpack_from("<QQ", body)
    steps = -(-n // LANES)
    marks = -(-steps // CHECKPOINT)
    at = np.frombuffer(body, np.uint64, marks, 16)
    states = np.frombuffer(body, np.uint64, marks * LANES, 16 + 8 * marks).reshape(marks, LANES)
    words = np.frombuffer(body, np.uint32, n_words, 16 + 8 * marks + 8 * LANES * marks)
    if not n:
        return np.zeros(0, np.int64)
    stretch = CHECKPOINT * LANES
    lanes, w = states[first:].copy(), at[first:].astype(np.int64)
    out = np.empty((marks - first, stretch), np.int64)
    mask, shift = U((1 << SCALE) - 1), U(SCALE)
    freq, start = freq.astype(U), start.astype(U)
    whole = n - (marks - 1) * stretch  # ids of the last stretch
    for a in range(0, min(stretch, n - first * stretch), LANES):
        # the last stretch takes part while it has ids
        rows = marks - first - (a >= whole)
        x = lanes[:rows]
        low = x & mask
        ids = slots[low]
        out[:rows, a : a + LANES] = ids
        x = freq[ids] * (x >> shift) + low - start[ids]
        short = x < LOW
        if a < whole < a + LANES:
            short[rows - 1, whole - a :] = False
        taken = short.sum(1)
        place = np.repeat(w[:rows] - (np.cumsum(taken) - taken), taken) + np.arange(int(taken.sum()))
        x[short] = (x[short] << U(32)) | words[place]
        w[:rows] += taken
        lanes[:rows] = x
    return out.ravel()[: n - first * stretch]


def encode_file(doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> bytes:
    """The bytes of one file: header, table, document index, block directory, blocks."""
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    place = np.zeros(len(counts), np.int64)
    place[symbols] = np.arange(len(symbols))
    position = place[ids]
    freq = scaled_frequencies(counts[symbols])
    start = np.cumsum(freq) - freq
    packed = zlib.compress(np.diff(symbols, prepend=0).astype("<u4").tobytes() + freq.astype("<u4").tobytes(), 6)
    null = np.array([d is None for d in doc_ids], bool)
    index = zlib.compress(np.packbits(null).tobytes() + np.array([d or 0 for d in doc_ids], "<i8").tobytes() + sizes.astype("<u8").tobytes(), 1)
    ends = np.cumsum(sizes)
    blocks, a = [], 0
    while a < len(ids):
        b = int(ends[np.searchsorted(ends, min(a + BLOCK_TOKENS, len(ids)))])
        blocks.append(encode_block(position[a:b], freq, start))
        a = b
    head = struct.pack("<QQQQQ", len(doc_ids), len(symbols), len(packed), len(index), len(blocks))
    return MAGIC + head + packed + index + struct.pack(f"<{len(blocks)}Q", *map(len, blocks)) + b"".join(blocks)


def read_file(data: bytes) -> tuple[list[int | None], np.ndarray, Iterator[np.ndarray]]:
    """Document ids, their sizes, and the ids of one block after the other."""
    if data[:8] != MAGIC:
        raise ValueError("not a file of this format")
    n_docs, n_symbols, n_packed, n_index, n_blocks = struct.unpack_from("<QQQQQ", data, 8)
    at = 48
    packed = np.frombuffer(zlib.decompress(data[at : at + n_packed]), "<u4")
    symbols, freq = np.cumsum(packed[:n_symbols], dtype=np.int64), packed[n_symbols:].astype(np.int64)
    at += n_packed
    index = zlib.decompress(data[at : at + n_index])
    cut = (n_docs + 7) // 8
    null = np.unpackbits(np.frombuffer(index, np.uint8, cut), count=n_docs) > 0
    doc_ids = [None if x else d for d, x in zip(np.frombuffer(index, "<i8", n_docs, cut).tolist(), null, strict=True)]
    sizes = np.frombuffer(index, "<u8", n_docs, cut + 8 * n_docs).astype(np.int64)
    at += n_index
    lengths = struct.unpack_from(f"<{n_blocks}Q", data, at)
    at += 8 * n_blocks

    def blocks() -> Iterator[np.ndarray]:
        start, slots = np.cumsum(freq) - freq, np.repeat(np.arange(n_symbols, dtype=np.int32), freq)
        view, place = memoryview(data), at
        for n in lengths:
            yield symbols[decode_block(view[place : place + n], freq, start, slots)]
            place += n

    return doc_ids, sizes, blocks()


class PieceTokenizer:
    """The library's tokenizer, asked once for each distinct piece of a batch that the worker has not met; a piece is known by itself.

    Pieces are those of the file's own pre-tokenizer, so a text's ids are its pieces' ids in a row. A text
    that holds a marker token goes to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.symbols = byte_symbols()
        self.markers = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        self.slot: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.int64)
        self.bounds = np.zeros(1 << 14, np.int64)
        self.used = 0

    def _learn(self, pieces: list[str]) -> None:
        # a piece is one word to the library's model, which is asked directly: no normaliser, offsets or padding
        symbols, model = self.symbols, self.library.model
        found = [[t.id for t in model.tokenize("".join([symbols[b] for b in piece.encode("utf-8", "surrogatepass")]))] for piece in pieces]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        top, total = int(self.bounds[self.used]), int(sizes.sum())
        while top + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.used + len(found) + 1 > len(self.bounds):
            self.bounds = np.concatenate([self.bounds, np.zeros_like(self.bounds)])
        self.flat[top : top + total] = np.fromiter((x for ids in found for x in ids), np.int64, total)
        self.bounds[self.used + 1 : self.used + 1 + len(found)] = top + np.cumsum(sizes)
        self.slot.update(zip(pieces, range(self.used, self.used + len(found)), strict=True))
        self.used += len(found)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the bounds of the texts."""
        whole = [i for i, t in enumerate(texts) if any(m in t for m in self.markers)]
        plain = ["" if i in set(whole) else t for i, t in enumerate(texts)] if whole else texts
        cps, bounds = K.code_points(plain)
        flat, out = np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
        if len(cps):
            starts, ends, by_text = K.pieces_keeping_space(cps, bounds)
            first, inverse = K.distinct_slices(cps, starts, ends)
            joined = "".join(plain)
            pieces = [joined[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
            if self.used + len(pieces) > REMEMBERED:
                self.forget()
            have = np.fromiter((self.slot.get(p, -1) for p in pieces), np.int64, len(pieces))
            new = np.flatnonzero(have < 0)
            if len(new):
                self._learn([pieces[i] for i in new.tolist()])
                have[new] = np.arange(self.used - len(new), self.used)
            slots = have[inverse]
            flat, at = K.gathered(self.flat, self.bounds[slots], self.bounds[slots + 1] - self.bounds[slots])
            out = at[by_text]
        for i in reversed(whole):
            ids = np.array(self.library.encode(texts[i], add_special_tokens=False).ids, np.int64)
            flat = np.insert(flat, out[i], ids)
            out[i + 1 :] += len(ids)
        return flat, out


_LOADED: dict[str, PieceTokenizer] = {}


def _tokenizer(path: str) -> PieceTokenizer:
    if path not in _LOADED:
        _LOADED[path] = PieceTokenizer(path)
    return _LOADED[path]


def write_files(docs: DataFrame, tokenizer: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> None:
    """Write the ids of all documents, each with the end id, in ascending order of id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, part, seq = _tokenizer(tokenizer), TaskContext.get().partitionId(), 0
        doc_ids: list[int | None] = []
        held: list[np.ndarray] = []
        sizes: list[np.ndarray] = []

        def closed() -> pa.RecordBatch:
            nonlocal seq
            size, ids = np.concatenate(sizes), np.concatenate(held)
            row = [pa.array([v], k) for v, k in ((part, pa.int32()), (seq, pa.int32()), (len(ids), pa.int64()), (encode_file(doc_ids, size, ids), pa.binary()))]
            seq += 1
            doc_ids.clear(), held.clear(), sizes.clear()
            return pa.RecordBatch.from_arrays(row, ["part", "seq", "n_tokens", "file"])

        for batch in batches:
            own, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in K.batches(texts, 1 << 20):
                flat, at = tok.encode(texts[a:b])
                flat = np.insert(flat, at[1:], end_id)
                doc_ids += own[a:b]
                held.append(flat)
                sizes.append(np.diff(at) + 1)
                if sum(map(len, held)) >= FILE_TOKENS:
                    yield closed()
        if doc_ids:
            yield closed()

    small_arrow_batches(docs.sparkSession)
    text = text_or_empty(F.col(text_col))
    ordered = docs.select(F.col(id_col).cast("bigint").alias("id"), text.alias("text")).repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"))
    ordered.mapInArrow(run, "part int, seq int, n_tokens bigint, file binary").write.parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files: start counts the ids of all documents before."""
    files = spark.read.parquet(path)
    upto = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")
    )
    begins = files.select("part", "seq", F.coalesce(F.sum("n_tokens").over(upto), F.lit(0)).alias("within")).join(parts, "part").select("part", "seq", (F.col("before") + F.col("within")).alias("begin"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                doc_ids, sizes, blocks = read_file(data)
                crcs, at, ends = [], 0, np.cumsum(sizes)
                place = 0
                for ids in blocks:
                    raw = ids.astype("<u4").tobytes()
                    while at < len(sizes) and ends[at] <= place + len(ids):
                        crcs.append(zlib.crc32(raw[4 * (int(ends[at] - sizes[at]) - place) : 4 * (int(ends[at]) - place)]))
                        at += 1
                    place += len(ids)
                n = len(doc_ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * n, pa.int32()), pa.array([seq] * n, pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())],
                    ["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    small_arrow_batches(spark, 16)
    read = files.select("part", "seq", "file").mapInArrow(run, "part int, seq int, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint")
    return read.join(begins, ["part", "seq"]).select("doc_id", (F.col("begin") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op5_rans_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    files = scratch_path(spark, "rans-files")
    write_files(table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), files)
    return read_documents(spark, files)
