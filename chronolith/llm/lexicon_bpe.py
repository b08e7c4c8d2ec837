"""BPE encoding and decoding through a minimal acyclic transducer lexicon.

The frequent words of a corpus are counted over all documents, encoded once and compiled into a minimal
acyclic automaton: states with equal futures are shared, every transition carries the number of words that
sort before those below it, so a path's sum is the word's index and the index finds its id outputs. The
automaton is a flat file that executors receive once (``addFile``) and memory-map; all workers of a machine
share its pages. Words that it lacks are merged exactly, rank by rank, many words at a time. What a worker
remembers of a word is kept under the word itself, so equal ids always mean equal words. Decoding starts from
the ids: token strings joined as the file's decoder does it, which is by blanks where it has none.

Bounds: the lexicon holds the ``LEXICON_WORDS`` most frequent words of at most ``LEXICON_BYTES`` bytes
(a size limit of the file; what it leaves out is merged and gives the same ids), a worker remembers
``REMEMBERED`` words.

Defined results: null text is encoded as empty text: no ids, empty decoded text; very long texts are
batches of their own; repeated rows are encoded alike; an empty table gives no rows and an empty lexicon;
columns other than the id and text are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import os
import re
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm import kernels as K
from chronolith.llm.common import discard, materialise, share_file, small_arrow_batches, table

LEXICON_WORDS = 1 << 16
LEXICON_BYTES = 64
REMEMBERED = 600_000
MAGIC = b"MATL0001"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def _kinds(part) -> set[str]:
    """The types of all steps of a normaliser's description."""
    if not isinstance(part, dict):
        return set()
    return {part["type"]}.union(*(_kinds(p) for p in part.get("normalizers", [])))


def _table(entries: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
    data = [f"{x} ".encode() for x in entries]
    return np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])])


class BpeModel:
    """Vocabulary, merges and piece rules of a ``tokenizers`` file with byte-level BPE."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab = model["vocab"]
        self.tokens = [""] * (1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]))
        for t, i in vocab.items():
            self.tokens[i] = t
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for t, i in self.added.items():
            self.tokens[i] = t
        self.added_pattern = re.compile("|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) or r"(?!)")
        self.normalises = bool(spec["normalizer"])
        self.only_lowers = _kinds(spec["normalizer"]) <= {"Sequence", "NFC", "Replace", "Lowercase"}
        self.decoder = (spec["decoder"] or {}).get("type")
        #: Bytes and bounds of every id in decimal and of every token, each with a blank after it.
        self.id_text, self.token_text = (_table(map(str, range(len(self.tokens)))), _table(self.tokens))
        self.drops_space = any(p["type"] == "Split" for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", []))
        symbols = byte_symbols()
        self.first = np.array([vocab[c] for c in symbols], np.int64)
        self.last = np.array([vocab[c + self.suffix] for c in symbols], np.int64)
        pairs = [(vocab[a], vocab[b]) for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
        made = [vocab[self.tokens[a] + self.tokens[b]] for a, b in pairs]
        keys = np.array([a << 32 | b for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_ranks = keys[order], order.astype(np.int64)
        self.made = np.array(made, np.int64)

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    @cached_property
    def normalizer(self):
        return self.library.normalizer

    def normalised(self, text: str) -> str:
        """As the file's normaliser. Of NFC, white space made blanks and lower-casing only the last shows in the ids of
        Latin-1 text; all else goes through the library's own."""
        if not self.normalises:
            return text
        if not self.only_lowers:
            return self.normalizer.normalize_str(text)
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.normalizer.normalize_str(text)
        return text.lower()

    def pieces(self, cps: np.ndarray, bounds: np.ndarray):
        return K.pieces_dropping_space(cps, bounds) if self.drops_space else K.pieces_keeping_space(cps, bounds)

    def ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, or the number of merges where it has none."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], len(self.made))

    def merged(self, flat: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words flat[bounds[i]:bounds[i+1]] (bytes), by exact merging, as flat ids and bounds.

        Words of like length go together, one row each; a round merges the lowest-ranked pair, the leftmost
        of equals, of every row that still has one. Very long words go one by one through a heap.
        """
        lengths = np.diff(bounds)
        out: list = [None] * len(lengths)
        order = np.argsort(lengths, kind="stable")
        a = 0
        while a < len(order):
            n = int(lengths[order[a]])
            if n == 0:
                out[order[a]] = np.zeros(0, np.int64)
                a += 1
                continue
            if n > 256:
                out[order[a]] = self._merged_long(flat[bounds[order[a]] : bounds[order[a] + 1]])
                a += 1
                continue
            b = int(np.searchsorted(lengths[order], n + max(1, n // 4), "right"))
            b = min(b, a + (1 << 17))
            rows = order[a:b]
            for i, ids in zip(rows.tolist(), self._merged_rows(flat, bounds, rows), strict=True):
                out[i] = ids
            a = b
        sizes = np.array([len(x) for x in out], np.int64)
        return (np.concatenate(out) if out else np.zeros(0, np.int64)), np.concatenate([[0], np.cumsum(sizes)])

    def _merged_rows(self, flat: np.ndarray, bounds: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
        lengths = bounds[rows + 1] - bounds[rows]
        width, n, none = int(lengths.max()), len(rows), len(self.made)
        column = np.arange(width)
        inside = column < lengths[:, None]
        symbols = np.full((n, width + 1), -1, np.int64)
        symbols[:, :width][inside] = self.first[flat[(bounds[rows][:, None] + column)[inside]]]
        symbols[np.arange(n), lengths - 1] = self.last[flat[bounds[rows] + lengths - 1]]
        ranks = np.full((n, width), none, np.int64)
        if width > 1:
            paired = inside[:, 1:]
            ranks[:, :-1][paired] = self.ranks_of(symbols[:, : width - 1][paired], symbols[:, 1:width][paired])
        left = np.broadcast_to(column - 1, (n, width)).copy()
        right = np.broadcast_to(column + 1, (n, width)).copy()
        live = np.arange(n)
        while len(live):
            at = ranks[live].argmin(1)
            best = ranks[live, at]
            live, at, best = live[best < none], at[best < none], best[best < none]
            if not len(live):
                break
            gone = right[live, at]
            after = right[live, gone]
            symbols[live, at] = self.made[best]
            symbols[live, gone] = -1
            ranks[live, gone] = none
            right[live, at] = after
            has = (after < width) & (symbols[live, np.minimum(after, width)] >= 0)
            r, c, x = live[has], at[has], after[has]
            left[r, x] = c
            ranks[live, at] = none
            ranks[r, c] = self.ranks_of(symbols[r, c], symbols[r, x])
            before = left[live, at]
            r, c, p = live[before >= 0], at[before >= 0], before[before >= 0]
            ranks[r, p] = self.ranks_of(symbols[r, p], symbols[r, c])
        kept = symbols[:, :width] >= 0
        return np.split(symbols[:, :width][kept], np.cumsum(kept.sum(1))[:-1])

    def _merged_long(self, data: np.ndarray) -> np.ndarray:
        symbols = self.first[data].tolist()
        symbols[-1] = int(self.last[data[-1]])
        n, none = len(symbols), len(self.made)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        ranks = self.ranks_of(np.array(symbols[:-1]), np.array(symbols[1:])).tolist()
        heap = [(r, i, symbols[i], symbols[i + 1]) for i, r in enumerate(ranks) if r < none]
        heapq.heapify(heap)

        def push(i: int, j: int) -> None:
            r = int(self.ranks_of(np.array([symbols[i]]), np.array([symbols[j]]))[0])
            if r < none:
                heapq.heappush(heap, (r, i, symbols[i], symbols[j]))

        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = right[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue
            symbols[i], symbols[j] = int(self.made[r]), -1
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
                push(i, right[i])
            if left[i] >= 0:
                push(left[i], i)
        return np.array([s for s in symbols if s >= 0], np.int64)


def compile_lexicon(model: BpeModel, words: list[bytes]) -> bytes:
    """The file: header of lengths, then transition keys, targets, counts before, state ends, id bounds, ids."""
    words = sorted(set(words))
    shared: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []  # final, ((byte, state), ...)

    def settled(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in shared:
            shared[key] = len(states)
            states.append(key)
        return shared[key]

    #: The path of the last word; a node is [final, [(byte, settled state), ...]].
    path: list[list] = [[False, []]]
    last = b""
    for w in words:
        common = len(os.path.commonprefix([last, w]))
        while len(path) > common + 1:
            done = settled(path.pop())
            path[-1][1].append((last[len(path) - 1], done))
        path += [[False, []] for _ in range(len(w) - common)]
        path[-1][0] = True
        last = w
    while len(path) > 1:
        done = settled(path.pop())
        path[-1][1].append((last[len(path) - 1], done))
    root = settled(path[0])
    below = np.zeros(len(states), np.int64)
    keys, to, before = [], [], []
    for s, (final, edges) in enumerate(states):  # targets are settled before their sources
        n = int(final)
        for byte, t in edges:
            keys.append(s << 8 | byte)
            to.append(t)
            before.append(n)
            n += int(below[t])
        below[s] = n
    flat, bounds = np.frombuffer(b"".join(words), np.uint8), np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    ids, id_bounds = model.merged(flat, bounds)
    parts = [np.array(keys, np.int64), np.array(to, np.int64), np.array(before, np.int64), np.array([f for f, _ in states], np.int64), id_bounds.astype(np.int64), ids.astype(np.int64)]
    head = np.array([root, *map(len, parts)], np.int64)
    return MAGIC + head.tobytes() + b"".join(p.tobytes() for p in parts)


class Lexicon:
    """A compiled file, memory-mapped."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        if self.map[:8] != MAGIC:
            raise ValueError(f"{path} is no lexicon")
        head = np.frombuffer(self.map, np.int64, 7, 8)
        self.root, at, parts = int(head[0]), 8 + 7 * 8, []
        for n in head[1:].tolist():
            parts.append(np.frombuffer(self.map, np.int64, n, at))
            at += 8 * n
        self.keys, self.to, self.before, self.final, self.id_bounds, self.ids = parts

    def indexes(self, flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Index of each word flat[bounds[i]:bounds[i+1]], -1 where the lexicon lacks it. All words step together."""
        n = len(bounds) - 1
        out = np.full(n, -1, np.int64)
        if not len(self.keys):
            return out
        lengths = np.diff(bounds)
        live, state, total = np.arange(n), np.full(n, self.root, np.int64), np.zeros(n, np.int64)
        step = 0
        while len(live):
            ended = lengths[live] == step
            done = live[ended]
            good = self.final[state[done]] > 0
            out[done[good]] = total[done[good]]
            live = live[~ended]
            key = state[live] << 8 | flat[bounds[live] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            there = self.keys[at] == key
            live, at = live[there], at[there]
            state[live] = self.to[at]
            total[live] += self.before[at]
            step += 1
        return out


class Encoder:
    """Encodes and decodes batches of texts: remembered words, then the lexicon, then exact merging."""

    def __init__(self, model: BpeModel, lexicon: Lexicon | None):
        self.model, self.lexicon = model, lexicon
        self.forget()

    def forget(self) -> None:
        self.slot: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.int64)
        self.bounds = np.zeros(1 << 14, np.int64)
        self.used = 0

    def _learn(self, words: list[str]) -> None:
        data = [w.encode("utf-8") for w in words]
        flat, bounds = np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
        found = self.lexicon.indexes(flat, bounds) if self.lexicon else np.full(len(words), -1)
        lacking = np.flatnonzero(found < 0)
        merged, at = self.model.merged(*K.gathered(flat, bounds[lacking], np.diff(bounds)[lacking]))
        # ids of the words one after the other: those of the lexicon, those that were merged
        sizes = np.zeros(len(words), np.int64)
        known = np.flatnonzero(found >= 0)
        sizes[lacking] = np.diff(at)
        if len(known):
            sizes[known] = self.lexicon.id_bounds[found[known] + 1] - self.lexicon.id_bounds[found[known]]
        top, total = int(self.bounds[self.used]), int(sizes.sum())
        while top + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.used + len(words) + 1 > len(self.bounds):
            self.bounds = np.concatenate([self.bounds, np.zeros_like(self.bounds)])
        ends = top + np.cumsum(sizes)
        self.bounds[self.used + 1 : self.used + 1 + len(words)] = ends
        for rows, ids in ((lacking, merged), (known, K.gathered(self.lexicon.ids, self.lexicon.id_bounds[found[known]], sizes[known])[0] if len(known) else merged[:0])):
            place, _ = K.gathered(np.arange(top, top + total), ends[rows] - sizes[rows] - top, sizes[rows])
            self.flat[place] = ids
        self.slot.update(zip(words, range(self.used, self.used + len(words)), strict=True))
        self.used += len(words)

    def slots(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Slot of every piece of the (normalised, marker-free) texts, and the bounds of the texts."""
        cps, bounds = K.code_points(texts)
        if not len(cps):
            return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
        starts, ends, by_text = self.model.pieces(cps, bounds)
        first, inverse = K.distinct_slices(cps, starts, ends)
        joined = "".join(texts)
        words = [joined[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        if self.used + len(words) > REMEMBERED:
            self.forget()
        have = np.fromiter((self.slot.get(w, -1) for w in words), np.int64, len(words))
        new = np.flatnonzero(have < 0)
        if len(new):
            self._learn([words[i] for i in new.tolist()])
            have[new] = np.arange(self.used - len(new), self.used)
        return have[inverse], by_text

    def encode(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For a run of texts after the other their ids in a row, and the bounds of the texts."""
        texts = [t or "" for t in texts]
        model = self.model
        for a, b in K.batches(texts):
            parts: list[str] = []
            after: list[int] = []  # the part that a marker token follows
            marks: list[int] = []
            first: list[int] = []  # of each text its first part and the markers before it
            before: list[int] = []
            for t in texts[a:b]:
                first.append(len(parts))
                before.append(len(marks))
                at = 0
                for m in model.added_pattern.finditer(t) if any(x in t for x in model.added) else ():
                    parts.append(model.normalised(t[at : m.start()]))
                    after.append(len(parts))
                    marks.append(model.added[m[0]])
                    at = m.end()
                parts.append(model.normalised(t[at:] if at else t))
            slots, bounds = self.slots(parts)
            flat, at = K.gathered(self.flat, self.bounds[slots], self.bounds[slots + 1] - self.bounds[slots])
            at = at[bounds]
            if marks:
                flat = np.insert(flat, at[after], marks)
            yield flat, at[[*first, len(parts)]] + np.array([*before, len(marks)])


def spelled(table: tuple[np.ndarray, np.ndarray], flat: np.ndarray, bounds: np.ndarray) -> Iterator[memoryview]:
    """For every run of ids its entries of the table, each of which ends with a blank, but for the last blank."""
    data, at = table
    out, ends = K.gathered(data, at[flat], at[flat + 1] - at[flat])
    view, edges = memoryview(np.ascontiguousarray(out)), ends[bounds].tolist()
    for a, b in zip(edges, edges[1:], strict=False):
        yield view[a : max(a, b - 1)]


def decoded(model: BpeModel, flat: np.ndarray, bounds: np.ndarray) -> Iterator[bytes | memoryview]:
    """The texts of runs of ids in UTF-8, special tokens kept, as the file's decoder makes them; without one, token strings with single spaces between."""
    if not model.decoder:
        return spelled(model.token_text, flat, bounds)
    edges = bounds.tolist()
    return (model.library.decode(flat[a:b].tolist(), skip_special_tokens=False).encode() for a, b in zip(edges, edges[1:], strict=False))


_LOADED: dict[tuple, Encoder] = {}


def _encoder(path: str, lexicon: str | None) -> Encoder:
    """One encoder a worker process and lexicon: models load once, remembered words outlive a task."""
    if (path, lexicon) not in _LOADED:
        _LOADED.clear()
        _LOADED[path, lexicon] = Encoder(BpeModel(path), Lexicon(SparkFiles.get(lexicon)) if lexicon else None)
    return _LOADED[path, lexicon]


def word_counts(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """(word, n) over all texts: pieces as UTF-8 bytes and how often they occur."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _encoder(tokenizer, None).model
        for batch in batches:
            texts = [model.normalised(t) if t else "" for t in batch.column(0).to_pylist()]
            for a, b in K.batches(texts):
                cps, bounds = K.code_points(texts[a:b])
                if not len(cps):
                    continue
                starts, ends, _ = model.pieces(cps, bounds)
                first, inverse = K.distinct_slices(cps, starts, ends)
                n = np.bincount(inverse, minlength=len(first))
                wide = 1 + (cps >= 0x80).astype(np.int64) + (cps >= 0x800) + (cps >= 0x10000)
                offsets = np.concatenate([[0], np.cumsum(wide)])
                data = np.frombuffer("".join(texts[a:b]).encode("utf-8"), np.uint8)
                x, y = offsets[starts[first]], offsets[ends[first]]
                short = (y - x) <= LEXICON_BYTES
                flat, at = K.gathered(data, x[short], (y - x)[short])
                words = pa.Array.from_buffers(pa.binary(), int(short.sum()), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])
                yield pa.RecordBatch.from_arrays([words, pa.array(n[short].astype(np.int64))], ["word", "n"])

    small_arrow_batches(docs.sparkSession)
    return docs.select(F.col(text_col)).mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def count_threshold(counts: DataFrame, size: int) -> int:
    """A count that at most ``size`` words reach, from a histogram of an eighth of an octave: some hundred rows."""
    level = F.floor(F.log2(F.col("n").cast("double")) * 8)
    reached, least = 0, None
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("least")).collect(), reverse=True):
        reached += r["words"]
        if reached > size:
            break
        least = r["least"]
    return least if least is not None else 1 << 62


def build_lexicon(docs: DataFrame, tokenizer: str, text_col: str = "text", size: int = LEXICON_WORDS) -> str:
    """Count all words, compile the most frequent ones, at most ``size``, and ship the file; returns its name for SparkFiles.

    The driver gets a histogram and the chosen words only, whatever the number of partitions.
    """
    counts = materialise(word_counts(docs, tokenizer, text_col).filter(F.col("n") > 1), "word-counts")
    words = [bytes(r[0]) for r in counts.filter(F.col("n") >= count_threshold(counts, size)).select("word").collect()]
    discard(counts)
    return share_file(docs.sparkSession, "lexicon.matl", [compile_lexicon(BpeModel(tokenizer), words)])


def encode_documents(docs: DataFrame, tokenizer: str, lexicon: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every text."""
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(tokenizer, lexicon)
        for batch in batches:
            done = 0
            for flat, bounds in enc.encode(batch.column(1).to_pylist()):
                ids = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(ids)), ids], [id_col, "ids"])
                done += len(ids)

    small_arrow_batches(docs.sparkSession)
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode_documents(encoded: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of every array of ids; null counts as no ids."""
    kind = encoded.select(F.col(id_col)).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _encoder(tokenizer, None).model
        for batch in batches:
            rows = [np.array(x or [], np.int64) for x in batch.column(1).to_pylist()]
            flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
            texts = [bytes(x).decode() for x in decoded(model, flat, np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return encoded.select(F.col(id_col), F.col(ids_col)).mapInArrow(run, f"`{id_col}` {kind}, text string")


def round_trip_digests(docs: DataFrame, tokenizer: str, lexicon: str | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encodes, and decodes the ids, without moving ids or decoded texts."""
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(tokenizer, lexicon)
        for batch in batches:
            done = 0
            for flat, bounds in enc.encode(batch.column(1).to_pylist()):
                ids = [hashlib.sha256(x).hexdigest() for x in spelled(enc.model.id_text, flat, bounds)]
                texts = [hashlib.sha256(x).hexdigest() for x in decoded(enc.model, flat, bounds)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(ids)), pa.array(np.diff(bounds)), pa.array(ids, pa.string()), pa.array(texts, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])
                done += len(ids)

    small_arrow_batches(docs.sparkSession)
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op1_lexicon_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    docs = table(spark, sf_dir, "documents")
    return round_trip_digests(docs, path("word_bpe_49k.json"), build_lexicon(docs, path("word_bpe_49k.json")))
