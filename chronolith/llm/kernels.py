"""Array kernels over batches of texts: code points, word bounds, slice hashes. NumPy only, no Spark."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import xxhash

#: Random odd base of the polynomial slice hash, and its inverse modulo 2**64.
BASE = 0x9E6C63D0876A9A47
BASE_INVERSE = pow(BASE, -1, 1 << 64)
#: Slices of more code points are hashed one by one.
LONG_SLICE = 128
#: Code points that a batch of texts is cut to; a longer text is a batch of its own.
BATCH_CHARS = 1 << 21

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3


@functools.cache
def char_classes() -> np.ndarray:
    """Class of every code point: white space, letter, number or other."""
    out = np.full(0x110000, OTHER, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            out[cp] = LETTER
        elif kind == "N":
            out[cp] = NUMBER
    out[[0x20, *range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    return out


@functools.cache
def blank_table() -> np.ndarray:
    """True for the code points 0x20 and 0x09-0x0D."""
    out = np.zeros(0x110000, bool)
    out[[0x20, *range(0x09, 0x0E)]] = True
    return out


def batches(texts: list[str], limit: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of texts of about ``limit`` code points."""
    a = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > limit:
            yield a, i
            a, total = i, 0
        total += len(t)
    if a < len(texts):
        yield a, len(texts)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in one array, and the bounds of the texts (one more than texts)."""
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=bounds[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), bounds


def _powers(n: int, base: int, _kept: dict = {}) -> np.ndarray:  # noqa: B006
    if base not in _kept or len(_kept[base]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        _kept[base] = np.cumprod(steps, dtype=np.uint64)
    return _kept[base][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slice_hashes(cps: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every slice, the same for equal slices wherever they stand.

    A polynomial in the code points by prefix sums: (S[end] - S[start]) * BASE**-start, then mixed with the length.
    Modulo 2**64 there are different strings of equal value for any base, from some hundred letters on, so
    slices longer than ``LONG_SLICE`` have their XXH64.
    """
    prefix = np.zeros(len(cps) + 1, np.uint64)
    np.cumsum((cps.astype(np.uint64) + np.uint64(1)) * _powers(len(cps), BASE), out=prefix[1:])
    raw = (prefix[ends] - prefix[starts]) * _powers(len(cps) + 1, BASE_INVERSE)[starts]
    out = mixed(raw ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    for i in np.flatnonzero(ends - starts > LONG_SLICE).tolist():
        out[i] = xxhash.xxh64_intdigest(cps[starts[i] : ends[i]].tobytes())
    return out


def distinct_slices(cps: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one place of each distinct slice, the class of every slice). Hashes propose, the code points decide.

    Every slice is compared with the one that stands for its hash; those that differ are classed by their own text.
    """
    _, first, inverse = np.unique(slice_hashes(cps, starts, ends), return_index=True, return_inverse=True)
    size, stands = ends - starts, first[inverse]
    wrong = size != size[stands]
    alike = np.flatnonzero(~wrong)
    here, bounds = gathered(cps, starts[alike], size[alike])
    there, _ = gathered(cps, starts[stands[alike]], size[alike])
    apart = np.flatnonzero(here != there)
    if len(apart):
        wrong[alike[np.searchsorted(bounds, apart, "right") - 1]] = True
    if wrong.any():
        own: dict[bytes, int] = {}
        extra: list[int] = []
        for i in np.flatnonzero(wrong).tolist():
            text = cps[starts[i] : ends[i]].tobytes()
            if text not in own:
                own[text] = len(first) + len(extra)
                extra.append(i)
            inverse[i] = own[text]
        first = np.concatenate([first, np.array(extra, first.dtype)])
    return first, inverse


def words(cps: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of runs without 0x20, 0x09-0x0D, and the bounds of each text's words among them."""
    solid = ~blank_table()[cps]
    first = np.zeros(len(cps) + 1, bool)
    first[bounds] = True
    before = np.zeros(len(cps), bool)
    before[1:] = solid[:-1]
    after = np.zeros(len(cps), bool)
    after[:-1] = solid[1:]
    starts = np.flatnonzero(solid & (~before | first[:-1]))
    ends = np.flatnonzero(solid & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, bounds)


@functools.cache
def all_but(points: str) -> np.ndarray:
    """True for every code point that is not listed."""
    out = np.ones(0x110000, bool)
    out[[ord(c) for c in points]] = False
    return out


def spans(solid: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``words``, of runs where ``solid`` is true."""
    first = np.zeros(len(solid) + 1, bool)
    first[bounds] = True
    edge = np.diff(np.concatenate([[False], solid, [False]]).astype(np.int8))
    starts = np.flatnonzero((edge[:-1] == 1) | (solid & first[:-1]))
    ends = np.flatnonzero((edge[1:] == -1) | (solid & first[1:])) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def lower_ascii(cps: np.ndarray) -> np.ndarray:
    """The code points with A-Z, and only these, lower-cased."""
    return cps + (((cps >= 65) & (cps <= 90)).astype(np.uint32) << np.uint32(5))


def _runs(kind: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """True where a run of one class starts; runs end with their text."""
    run = np.ones(len(kind), bool)
    run[1:] = kind[1:] != kind[:-1]
    run[bounds[:-1][bounds[:-1] < len(kind)]] = True
    return run


def _contractions(cps: np.ndarray, kind: np.ndarray, at: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of apostrophes ``at`` that open a token, those that open 's 't 're 've 'm 'll 'd, and their lengths."""
    if not len(at):
        return at, at
    end = bounds[np.searchsorted(bounds, at, "right")]
    padded = np.concatenate([cps, np.zeros(2, np.uint32)])
    one = np.where(at + 1 < end, padded[at + 1], 0)
    two = np.where(at + 2 < end, padded[at + 2], 0)
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    size = np.where(short, 2, np.where(long, 3, 0))
    return at[size > 0], size[size > 0]


def pieces_dropping_space(cps: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of ``'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+``: starts, ends, bounds by text."""
    kind = char_classes()[cps]
    start = _runs(kind, bounds)
    opens = np.flatnonzero(start & (cps == 0x27))
    start |= kind == NUMBER
    at, size = _contractions(cps, kind, opens, bounds)
    start[at + 1] = False
    after = at + size
    inside = np.isin(after, bounds)
    start[after[~inside]] = True
    edges = np.flatnonzero(start)
    ends = np.append(edges[1:], len(cps))
    keep = kind[edges] != SPACE
    edges, ends = edges[keep], ends[keep]
    return edges, ends, np.searchsorted(edges, bounds)


def pieces_keeping_space(cps: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.

    A run of white space before anything else gives up its last character: to the next piece if that is a
    blank, else as a piece of its own.
    """
    kind = char_classes()[cps]
    start = _runs(kind, bounds)
    text_start = np.zeros(len(cps) + 1, bool)
    text_start[bounds] = True
    solid = np.flatnonzero(start & (kind != SPACE))
    led = solid[~text_start[solid]]
    led = led[kind[led - 1] == SPACE]
    start[led - 1] = True
    blank = led[cps[led - 1] == 0x20]
    start[blank] = False
    opens = np.flatnonzero(start & (cps == 0x27))
    at, size = _contractions(cps, kind, opens, bounds)
    start[at + 1] = False
    after = at + size
    start[after[~np.isin(after, bounds)]] = True
    edges = np.flatnonzero(start)
    return edges, np.append(edges[1:], len(cps)), np.searchsorted(edges, bounds)


def gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices one after the other, and their bounds."""
    bounds = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=bounds[1:])
    return flat[np.arange(bounds[-1]) + np.repeat(starts - bounds[:-1], lengths)], bounds


class Sets:
    """Union-find over members 0..n-1."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j
