"""Sketches, SimHash, language ID, toxicity and the pipeline."""

import hashlib
import math
import random
import re
import time
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from chronolith.llm import kernels, language_id, scaled_sketch, simhash, simhash_similar, toxicity
from chronolith.llm.common import materialise
from tests.conftest import DATA
from tests.llm.conftest import ROWS, frame
from tests.llm.test_native import fold


# --- sketches


def edited(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    for k, (i, t) in enumerate(rows):
        nxt, n = rows[(k + 1) % len(rows)][1] or "", len(t or "")
        yield i, n, (t or "")[: n - n // 2] + nxt[: n // 2], t or "", nxt


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_edits_and_fingerprints(request, listed, which):
    df = request.getfixturevalue(which)
    rows = listed if which == "docs" else [(i, t) for i, t, *_ in ROWS]
    got = scaled_sketch.fingerprint_pairs(df).collect()
    want = sorted((str(i), n, hashlib.sha256(e.encode()).hexdigest()) for i, n, e, *_ in edited(rows))
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in got) == want
    plain = {hashlib.sha256(e.encode()).hexdigest(): t for _, _, e, t, _ in edited(rows)}
    by_text = {}
    for r in got:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        by_text.setdefault(plain[r["edited_sha256"]], set()).add(r["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())


def test_neighbours_under_heavy_ids(spark):
    """A third of the rows without an id, a third with one: no range takes much more than its part, and each row meets its next one."""
    rows = [(None if i % 3 == 0 else 500 if i % 3 == 1 else i, f"text {i} of {i * i} words") for i in range(6000)] + [(None, None), (-(2**63), "least"), (2**63 - 1, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)
    held = scaled_sketch.with_neighbours(df, "doc_id", "text")
    sizes = [r["count"] for r in held.filter("NOT guest").groupBy("part").count().collect()]
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sum(sizes) == len(rows) and max(sizes) <= 3 * len(rows) / parts
    assert held.filter("guest").count() == len(sizes)  # one visitor a range
    text = F.coalesce("text", F.lit(""))
    order = [(r["doc_id"], r["t"]) for r in df.select("doc_id", text.alias("t")).orderBy(F.desc_nulls_last("doc_id"), F.xxhash64("t")).collect()]
    want = [(i, hashlib.sha256((t[: len(t) - len(t) // 2] + order[(k + 1) % len(order)][1][: len(t) // 2]).encode()).hexdigest()) for k, (i, t) in enumerate(order)]
    got = [(r["doc_id"], r["edited_sha256"]) for r in scaled_sketch.fingerprint_pairs(df).select("doc_id", "edited_sha256").collect()]
    assert Counter(got) == Counter(want)


def test_sketch_keeps_every_hash_below_the_threshold(none):
    text = " ".join(str(x) for x in random.Random(1).choices(range(10**6), k=4000))
    s = scaled_sketch.Sketches([text, text + " and more words that follow it", "", "one two"], fraction=1)
    assert s.count.tolist()[0] == 3996 and s.bounds[1] == 3996  # fraction 1 retains all
    some = scaled_sketch.Sketches([text])
    assert set(some.hashes.tolist()) == {h for h in s.hashes[:3996].tolist() if h < (1 << 48) // scaled_sketch.FRACTION}
    assert scaled_sketch.containment(s, np.array([0]), s, np.array([1]))[0] == 1.0
    assert scaled_sketch.fingerprint_pairs(none).count() == 0


def test_containment_estimates_are_close():
    rnd = random.Random(4)
    a = [str(rnd.random()) for _ in range(6000)]
    s = scaled_sketch.Sketches([" ".join(a), " ".join(a[:3000] + [str(rnd.random()) for _ in range(30000)])])
    assert abs(scaled_sketch.containment(s, np.array([0]), s, np.array([1]))[0] - 0.5) < 0.08
    f = s.strings()[0]
    assert scaled_sketch.merge(f, f) == scaled_sketch.parse(f)[2] == s.hashes[: s.bounds[1]].tolist()


M64 = (1 << 64) - 1


def brute_mixed(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & M64
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & M64
    return x ^ x >> 31


def brute_sketch(t):
    """(number, sum, retained hashes) by plain integers: a polynomial for each word, another over the words of a shingle."""
    words = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
    h = []
    for w in words:
        value = sum((ord(c) + 1) * pow(kernels.BASE, i, 1 << 64) for i, c in enumerate(w)) & M64
        h.append(brute_mixed(value ^ len(w) * 0xD6E8FEB86659FD93 & M64) if len(w) <= 128 else xxhash.xxh64_intdigest(w.encode("utf-32-le")))
    n, found = min(5, len(h)), set()
    for i in range(len(h) - n + 1 if h else 0):
        v = 0
        for x in h[i : i + n]:
            v = (v + x) * int(scaled_sketch.STEP) & M64
        found.add(brute_mixed(v + n & M64))
    return len(found), sum(found) & M64, {x >> 16 for x in found if x >> 16 < (1 << 48) // 4}


def brute_contained(a, b):
    return 1.0 if a[:2] == b[:2] else len(a[2] & b[2]) / len(a[2]) if a[2] else 0.0


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_sketches_against_brute_force(request, listed, which):
    df = request.getfixturevalue(which)
    rows = [r for r in (listed if which == "docs" else [(i, t) for i, t, *_ in ROWS]) if r[0] is not None]
    sketch, got, want = {t: brute_sketch(t) for t in {x or "" for _, x in rows}}, [], []
    for r in scaled_sketch.fingerprint_pairs(df.filter("doc_id IS NOT NULL")).collect():
        parts = []
        for name in ("fingerprint", "edited_fingerprint"):
            n, total, kept = scaled_sketch.parse(r[name])
            assert kept == sorted(kept)
            parts.append((n, total, frozenset(kept)))
        got.append((r["doc_id"], r["edited_sha256"], *parts, round(r["near_edited"], 9), round(r["near_next"], 9)))
    for i, _, e, t, nxt in edited(rows):
        parts = [(n, total, frozenset(kept)) for n, total, kept in (sketch[t], brute_sketch(e))]
        want.append((i, hashlib.sha256(e.encode()).hexdigest(), *parts, round(brute_contained(sketch[t], parts[1]), 9), round(brute_contained(sketch[t], sketch[nxt]), 9)))
    assert Counter(got) == Counter(want)


# --- SimHash


def brute_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", fold(t))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(fps))]


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_components(request, listed, which):
    rows = listed if which == "docs" else [(i, t) for i, t, *_ in ROWS]
    fps = [brute_fingerprint(t) for _, t in rows]
    roots, least = brute_components(fps), {}
    for (i, _), r in zip(rows, roots, strict=True):
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    want = sorted(((str(i), f"{f:016x}", least[r]) for (i, _), f, r in zip(rows, fps, roots, strict=True)), key=str)
    df = request.getfixturevalue(which)
    assert sorted(((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(df).collect()), key=str) == want
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and kept.count() == len(least)


def test_postings_reach_every_link(spark, none):
    rnd = random.Random(9)
    fps = {0, (1 << 64) - 1}
    for _ in range(40):
        f = rnd.getrandbits(64)
        for _ in range(rnd.randint(1, 30)):  # chains and clusters
            fps.add(f)
            f ^= sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 5)))
    fps = sorted(fps)
    roots = brute_components(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    prints = spark.createDataFrame([(s, i) for i, s in enumerate(signed)], "fp bigint, doc_id bigint")
    got = {r["fp"]: r["component"] for r in simhash.component_ids(prints, F.col("doc_id")).collect()}
    least = {}
    for i, r in enumerate(roots):
        least.setdefault(r, i)
    assert got == {s: least[r] for s, r in zip(signed, roots, strict=True)}
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0


def test_large_postings_are_split(monkeypatch):
    """Members that agree in the bytes of a choice, most of them unlinked: the components are those of all pairs."""
    rng = np.random.default_rng(2)
    choice = 17
    free = [p for p in range(8) if p not in simhash.CHOICES[choice]]
    data = np.tile(np.frombuffer(b"\x01\x02\x03\x04\x05\x06\x07\x08", np.uint8), (900, 1)).copy()
    data[:, free] = rng.integers(0, 256, (900, 4))
    for i in range(300, 900):  # chains
        data[i] = data[i - 300]
        data[i, free[int(rng.integers(4))]] ^= 1 << int(rng.integers(8)) | 1 << int(rng.integers(8))
    fps = np.unique(data.view(np.uint64).ravel())
    up = kernels.Sets(len(fps))
    place = {int(f): i for i, f in enumerate(fps)}
    n = 0
    for a, b in simhash.split_forest(fps, choice):
        assert (np.bitwise_count(a ^ b) <= 4).all()
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            n += up.join(place[x], place[y])
    want = brute_components(fps.tolist())
    assert n == len(fps) - len(set(want))


# --- SimHash by similarity


def brute_similar(texts):
    """A root for each text: linked if the sets of 5-word shingles have a similarity of 0.8 or more."""
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", fold(t))
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 4 * max(len(a), len(b)) <= 5 * min(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b):
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(texts))]


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_similar_groups(request, listed, which):
    rows = listed if which == "docs" else [(i, t) for i, t, *_ in ROWS]
    least = {}
    for (i, _), r in zip(rows, brute_similar([t for _, t in rows]), strict=True):
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    df = request.getfixturevalue(which)
    kept = simhash_similar.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in kept.select("doc_id").collect()) == sorted(map(str, least.values()))


def test_near_copies_go_and_clean_texts_stay(spark, none):
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(5000)]
    rows, n = [], 0
    for k in range(60):
        text = [rnd.choice(words) for _ in range(rnd.randint(150, 400))]
        for _ in range(1 if k % 3 else 8):  # similarity of copies to the first: 0.93 at least
            copy = list(text)
            if n and rows and rows[-1][4] == k:
                copy[rnd.randrange(len(copy))] = "changed"
            rows.append((n, " ".join(copy), "en", "a", k))
            n += 1
    kept = simhash_similar.keep_one(frame(spark, [r[:4] for r in rows]))
    assert sorted(r["doc_id"] for r in kept.collect()) == [min(r[0] for r in rows if r[4] == k) for k in range(60)]
    assert simhash_similar.keep_one(none).count() == 0


def test_links_are_close_to_the_true_similarity(spark):
    """Of pairs with a true similarity of 0.72 both stay, of pairs with 0.88 one."""
    rnd, rows = random.Random(11), []
    for k in range(80):
        text = [f"k{k}x{i}" for i in range(600)]
        other, changes = list(text), round(596 * (1 - (j := 0.72 if k % 2 else 0.88)) / (1 + j) / 5)
        for c in range(changes):  # each takes five shingles from the shared ones
            other[10 + c * 580 // changes] = f"c{rnd.random()}"
        a, b = (simhash_similar.shingle_hashes(" ".join(t)) for t in (text, other))
        assert abs(len(a & b) / len(a | b) - j) < 0.01
        rows += [(2 * k, " ".join(text), "en", "a"), (2 * k + 1, " ".join(other), "en", "a")]
    kept = {r["doc_id"] for r in simhash_similar.keep_one(frame(spark, rows)).collect()}
    assert kept == {i for i in range(160) if i % 2 == 0 or i // 2 % 2}


def test_short_texts_by_true_similarity(spark):
    """One text the start of the other: at 0.8 or more one stays, however few the shingles; below, both."""
    rows, want = [], set()
    for k, (m, n) in enumerate([(5, 4), (6, 5), (7, 6), (16, 13), (63, 51), (78, 63), (6, 4), (16, 12), (78, 62)] * 8):
        words = [f"k{k}x{i}" for i in range(m + 4)]
        rows += [(2 * k, " ".join(words), "en", "a"), (2 * k + 1, " ".join(words[: n + 4]), "en", "a")]
        want |= {2 * k} if n / m >= 0.8 else {2 * k, 2 * k + 1}
    assert {r["doc_id"] for r in simhash_similar.keep_one(frame(spark, rows)).collect()} == want


def test_no_link_below_the_similarity(spark):
    """Of texts with a true similarity of 0.78 to 0.8, many of them estimated at 0.8, all stay."""
    rows = []
    for k in range(60):
        words = [f"k{k}x{i}" for i in range(204)]
        rows += [(2 * k, " ".join(words), "en", "a"), (2 * k + 1, " ".join(words[: 4 + 159]), "en", "a")]
    assert simhash_similar.keep_one(frame(spark, rows)).count() == 120


def test_batches_cut_no_posting():
    posting = np.repeat([1, 2, 3], [40_000, 2_000, 10])
    whole = pa.RecordBatch.from_arrays([pa.array(posting)], ["posting"])
    tables = list(simhash_similar._whole_postings(whole.slice(a, 700) for a in range(0, len(whole), 700)))
    seen = [set(t.column(0).to_pylist()) for t in tables]
    assert sum(len(x) for x in seen) == 3 and len(seen) > 1


def test_narrow_prints_start_wide_ones():
    texts = [ROWS[5][1], ROWS[0][1], None, ROWS[6][1]]
    (a, m), (b, n) = simhash_similar.fingerprints(texts), simhash_similar.fingerprints(texts, simhash_similar.WIDE)
    assert (a == b[:, : simhash_similar.WORDS]).all() and (m == n).all()


def test_large_postings_in_parts(spark, monkeypatch):
    """However small the parts: the same classes of forests, and the very same pairs between labels."""
    rnd = np.random.default_rng(8)
    fp = np.repeat(rnd.integers(0, 1 << 63, (6, 8), dtype=np.uint64), 40, axis=0)
    fp ^= np.packbits(rnd.random((len(fp), 512)) < 0.03, axis=1, bitorder="little").view(np.uint64)
    rows = [(i, 300, bytearray(x.tobytes()), i % 7) for i, x in enumerate(fp)]
    prints = spark.createDataFrame(rows, "node bigint, n bigint, fp binary, label bigint").cache()
    sets = spark.createDataFrame([(i, 20, [i // 60 * 1000 + k for k in range(18)] + [-i, -i // 2]) for i in range(180)], "node bigint, n bigint, shingles array<bigint>").cache()

    def results():
        forests = []
        for edges in (simhash_similar.link_edges(prints.drop("label"), 8, 0.8), simhash_similar.short_edges(sets)):
            up = kernels.Sets(len(fp))
            for u, v in edges.collect():
                up.join(u, v)
            forests.append([up.root(i) for i in range(len(fp))])
        pairs = simhash_similar.link_edges(prints, 8, 0.8).collect()
        return *forests, sorted(tuple(sorted(p)) for p in pairs)

    whole = results()
    assert whole[0] == [i // 40 * 40 for i in range(240)] and whole[1][:180] == [i // 60 * 60 for i in range(180)]
    monkeypatch.setattr(simhash_similar, "PART", 16)
    monkeypatch.setattr(simhash_similar, "SET_PART", 11)
    assert results() == whole


def test_similar_groups_in_parts(docs, listed, odd, monkeypatch):
    monkeypatch.setattr(simhash_similar, "PART", 9)
    monkeypatch.setattr(simhash_similar, "SET_PART", 5)
    for df, rows in ((docs, listed), (odd, [(i, t) for i, t, *_ in ROWS])):
        least = {}
        for (i, _), r in zip(rows, brute_similar([t for _, t in rows]), strict=True):
            least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
        kept = simhash_similar.keep_one(df)
        assert sorted(str(r["doc_id"]) for r in kept.select("doc_id").collect()) == sorted(map(str, least.values()))


def test_parts_hold_no_whole_group(spark):
    """A third of all rows in one posting: no block has much more than two parts, and any two rows of the posting share one."""
    rows = spark.range(3000).selectExpr("if(id % 3 = 0, 0L, id) AS posting", "id AS node")
    blocks = simhash_similar.in_parts(rows, 100).filter("posting = 0").groupBy("low", "high").agg(F.count("node").alias("rows"), F.collect_list("node").alias("nodes")).collect()
    assert max(b["rows"] for b in blocks) < 300
    met = {(a, b) for r in blocks for a in r["nodes"] for b in r["nodes"] if a < b}
    assert len(met) == 1000 * 999 // 2


def test_postings_split_over_batches():
    rnd = np.random.default_rng(6)
    base = rnd.integers(0, 1 << 63, (30, 8), dtype=np.uint64)
    fp = np.repeat(base, 40, axis=0)
    flips = rnd.random((len(fp), 512)) < 0.05
    fp ^= np.packbits(flips, axis=1, bitorder="little").view(np.uint64)
    node, n = np.arange(len(fp)), np.full(len(fp), 300)
    data = fp.view(np.uint8)
    rows = sorted(((p << 8 | int(data[i, p])) << 16 + 2 * simhash_similar.BITS, i) for p in simhash_similar.FIRSTS for i in node)
    key, of = (np.array(x) for x in zip(*rows, strict=True))
    prints, side = pa.array([fp[i].tobytes() for i in of], pa.binary()), pa.array(np.zeros(len(of), bool))
    whole = pa.RecordBatch.from_arrays([pa.array(key), pa.array(of), pa.array(n[of]), prints, side], ["posting", "node", "n", "fp", "side"])
    up = kernels.Sets(len(fp))
    for b in simhash_similar._edges(whole.slice(a, 7) for a in range(0, len(whole), 7)):
        for i, j in zip(*(b.column(k).to_pylist() for k in range(2)), strict=True):
            assert np.bitwise_count(fp[i] ^ fp[j]).sum() < 80
            up.join(i, j)
    assert [up.root(i) for i in node] == (node // 40 * 40).tolist()


# --- language


def test_language_held_out(spark, docs):
    got = language_id.op3_language_id(spark, DATA).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got[got.held_out].lang == got[got.held_out].lang_pred).mean() > 0.95
    assert got.score.between(0, 1).all()


def test_language_odd(odd, none):
    model = language_id.fit(odd)
    got = {r["doc_id"]: r for r in language_id.identify(odd, model).collect()}
    assert all(got[i]["lang_pred"] == "und" for i in (3, 4, 5)) and got[1]["lang_pred"] in model.languages
    empty = language_id.fit(none)
    assert language_id.identify(none, empty).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(odd, empty).collect()} == {"und"}


def test_penalties_leave_zeros_and_temperature_calibrates():
    rng = np.random.default_rng(0)
    rows = [(np.array([y, 100 + int(rng.integers(50))]), np.array([1.0, 0.3]), y) for y in rng.integers(0, 3, 400).tolist()]
    w, bias = language_id.follow_the_leader(rows, 3)
    assert (w == 0).mean() > 0.99 and all((w[y] + bias).argmax() == y for y in range(3))
    logits = rng.normal(size=(4000, 3))
    p = np.exp(logits) / np.exp(logits).sum(1, keepdims=True)
    y = np.array([rng.choice(3, p=q) for q in p])
    assert abs(language_id.best_temperature(logits * 3, y) - 3) < 0.5


def brute_grams(t):
    """n-grams of a text as (order, letters), by plain strings."""
    kept = re.sub(r"[^\w]|[\d_]", " ", (t or "").lower()) if (t or "").isascii() else "".join(c if unicodedata.category(c)[0] == "L" else " " for c in (t or "").lower())
    kept = re.sub(" +", " ", kept)
    return [kept[i : i + n] for n in language_id.ORDERS for i in range(len(kept) - n + 1)]


def brute_bucket(g):
    h = len(g)
    for c, m in zip(g, language_id.MULTIPLIERS.tolist(), strict=False):
        h = (h + ord(c)) * m & M64
        h ^= h >> 29
    return (h * int(language_id.MULTIPLIERS[0]) & M64) >> 49


def brute_leader(rows, k):
    """FTRL-proximal one weight at a time, as its authors give it."""
    z, n, order = defaultdict(float), defaultdict(float), np.random.default_rng(0)

    def weight(key, l1):
        if abs(z[key]) <= l1:
            return 0.0
        return -(z[key] - math.copysign(l1, z[key])) / ((language_id.BETA + math.sqrt(n[key])) / language_id.ALPHA + language_id.L2)

    for _ in range(language_id.EPOCHS):
        for i in order.permutation(len(rows)):
            b, v, y = rows[i]
            x = [(int(j), float(u)) for j, u in zip(b, v, strict=True)]
            w = {(j, c): weight((j, c), language_id.L1) for j, _ in x for c in range(k)} | {("bias", c): weight(("bias", c), 0.0) for c in range(k)}
            logits = [sum(u * w[j, c] for j, u in x) + w["bias", c] for c in range(k)]
            top = max(logits)
            p = [math.exp(m - top) for m in logits]
            p = [q / sum(p) for q in p]
            for c in range(k):
                for j, u in [*x, ("bias", 1.0)]:
                    g = (p[c] - (c == y)) * u
                    step = (math.sqrt(n[j, c] + g * g) - math.sqrt(n[j, c])) / language_id.ALPHA
                    z[j, c] += g - step * w[j, c]
                    n[j, c] += g * g
    return lambda j, c: weight((j, c), language_id.L1), [weight(("bias", c), 0.0) for c in range(k)]


def test_features_and_leader_against_scalar_loops():
    texts = ["Hello, World 42! don't", "", None, "Straße ÀÉ 日本語", "a", " x "]
    found, total, letters = language_id.grams(texts, chunk=5)
    got = [Counter() for _ in texts]
    for text, bucket in found:
        for i, b in zip(text.tolist(), bucket.tolist(), strict=True):
            got[i][b] += 1
    assert got == [Counter(map(brute_bucket, brute_grams(t))) for t in texts]
    assert total.tolist() == [len(brute_grams(t)) for t in texts] and (letters > 0).tolist() == [True, False, False, True, True, True]
    rng = np.random.default_rng(5)
    rows = [(np.unique(rng.integers(0, 40, 6)) + 40 * y, None, y) for y in rng.integers(0, 3, 60).tolist()]
    rows = [(b, rng.random(len(b)), y) for b, _, y in rows]
    w, bias = language_id.follow_the_leader(rows, 3)
    weight, own = brute_leader(rows, 3)
    assert np.allclose(bias, own) and all(math.isclose(w[j, c], weight(j, c), abs_tol=1e-9) for j in range(160) for c in range(3))


def test_language_model_needs_no_order(spark, docs):
    one, two = (language_id.fit(d.select("doc_id", "text", "lang")) for d in (docs, docs.repartition(5, "lang").orderBy(F.desc("text"))))
    assert (one.weights == two.weights).all() and one.temperature == two.temperature


# --- toxicity


def test_segments_in_linear_time():
    def seconds(n):
        at = np.arange(n) * 9
        score = np.where(np.arange(n) % 2, 1.0, 2.0)  # totals fall from hit to hit: nothing is ever merged
        began = time.perf_counter()
        assert len(toxicity.segments(at, score)) == n
        return time.perf_counter() - began

    seconds(2000)
    assert seconds(200_000) < 40 * max(seconds(20_000), 0.01)


def test_scores_on_real_rows_against_brute_force(spark, docs):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    model = toxicity.fit(docs, labels, F.lit(True))
    known = dict(zip(model.hashes.tolist(), model.scores.tolist(), strict=True))

    def word_score(w):
        cps = np.array([ord(c) for c in w], np.uint32)
        one = lambda n: kernels.slice_hashes(cps, np.array([0]), np.array([n]))[0]
        with np.errstate(over="ignore"):
            forms = [int(one(len(w)))] + [int(kernels.mixed(one(p) + np.uint64(p))) for p in toxicity.PREFIXES if len(w) > p]
        return max([0.0, *(known.get(h, 0.0) for h in forms)])

    def brute_score(t):
        words = regex.findall(r"\p{L}+", (t or "").lower())
        v = [word_score(w) or -toxicity.DRIFT for w in words]
        parts = brute_segments(v, 0, len(v))
        base = math.log(model.k * max(1, len(words)))
        x = math.log(sum(math.exp(model.lam * s) for *_, s in parts)) - base if parts else -base
        return 1 / (1 + math.exp(-(model.slope * x + model.offset)))

    assert len(known) > 0
    got = {r["doc_id"]: r["__score"] for r in toxicity.score_documents(docs, model).collect()}
    toxic = {r["doc_id"] for r in labels.filter("toxic = 1").collect()}
    for r in docs.collect():
        if r["doc_id"] in toxic or r["doc_id"] % 3 == 0:
            assert got[r["doc_id"]] == pytest.approx(brute_score(r["text"]), abs=1e-6)


def brute_segments(v, a, b):
    """The best-scoring stretch, then those of what is left of it and right of it."""
    best, low, total, start = None, 0.0, 0.0, a
    for j in range(a, b):
        if total <= low - 1e-12 or j == a:
            low, start = total, j
        total += v[j]
        if total - low > 1e-12 and (best is None or total - low > best[2] + 1e-12):
            best = (start, j + 1, total - low)
    return [] if best is None else [*brute_segments(v, a, best[0]), best, *brute_segments(v, best[1], b)]


def test_segments_against_brute_force():
    rnd = random.Random(0)
    for _ in range(500):
        v = [rnd.choice([-0.25] * 3 + [rnd.random() * 1.3 + 0.01]) for _ in range(rnd.randint(1, 14))]
        at = np.array([i for i, x in enumerate(v) if x > 0], int)
        assert [s[:2] for s in toxicity.segments(at, np.array(v)[at])] == [s[:2] for s in brute_segments(v, 0, len(v))]


def test_toxicity_finds_planted_words(spark, none):
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    made = []
    for i in range(600):
        w = rnd.choices(words, k=rnd.randint(20, 200))
        if i % 6 == 0:
            for _ in range(3):
                w.insert(rnd.randrange(len(w)), rnd.choice(["vilest", "vilely", "rotter"]))
        made.append((i, " ".join(w), "en", "s"))
    df = frame(spark, made)
    labels = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(500)], "doc_id bigint, toxic int")
    model = toxicity.fit(df, labels, toxicity.training_rows())
    got = {r["doc_id"]: r for r in toxicity.score_documents(df, model).collect()}
    assert all((got[i]["__score"] >= 0.5) == (i % 6 == 0) for i in range(600))
    p = got[0]["__passages"][0]
    assert any(w in made[0][1][p["start"] : p["end"]] for w in ("vilest", "vilely", "rotter"))
    kept = toxicity.drop_toxic(df, model)
    assert kept.columns == df.columns and kept.count() == 500
    assert toxicity.score_documents(none, model).count() == 0


def test_toxicity_without_labels(spark, odd):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    model = toxicity.fit(odd, none, toxicity.training_rows())
    assert {r["__score"] for r in toxicity.score_documents(odd, model).collect()} == {0.0}
    assert toxicity.drop_toxic(odd, model).count() == len(ROWS)


# --- pipeline


def test_pipeline_against_brute_force(spark):
    """Each stage on its own input, at a size where pairs can be listed."""
    from public_tokenizers import path
    from tokenizers import Tokenizer

    import corpus_pipeline as c
    from chronolith.llm import mixing
    from chronolith.llm.common import table

    docs, kept = table(spark, DATA, "documents"), {}
    columns = docs.columns
    stages = dict(c.STAGES)
    for name in ("toxicity", "exact_dedup", "near_dedup", "mixing"):
        before = docs
        docs = materialise(stages[name](spark, docs, DATA), f"test-{name}")
        kept[name] = (before, docs)
        assert docs.columns == columns
    rows = lambda df: [(r["doc_id"], r["text"]) for r in df.collect()]
    a, b = map(rows, kept["exact_dedup"])
    last = {}
    for i, t in a:
        last[fold(t)] = max(i, last.get(fold(t), -1))
    assert sorted(i for i, _ in b) == sorted(last.values())
    a, b = map(rows, kept["near_dedup"])
    least = {}
    for (i, _), r in zip(a, brute_similar([t for _, t in a]), strict=True):
        least[r] = min(i, least.get(r, i))
    assert sorted(i for i, _ in b) == sorted(least.values())
    plan = {r["doc_id"]: r["copies"] for r in mixing.curriculum(kept["mixing"][0]).collect()}
    mixed = rows(kept["mixing"][1])
    assert sorted(i for i, _ in mixed) == sorted(i for i, n in plan.items() for _ in range(n))
    tok = Tokenizer.from_file(path(c.TOKENIZER))
    got = sorted((r["doc_id"], r["n_tokens"]) for r in stages["bpe"](spark, docs, DATA).collect())
    assert got == sorted((i, len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in mixed)


def test_pipeline_on_odd_and_empty_tables(spark, odd, none, tmp_path):
    """Nulls, repeats, ties and clashing columns pass through all stages; an empty table gives no rows."""
    import corpus_pipeline as c

    for name, df in (("odd", odd), ("none", none)):
        df.write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([(1, 0), (2, None), (None, 1)], "doc_id bigint, toxic int").write.parquet(str(tmp_path / name / "labels.parquet"))
        docs = spark.read.parquet(str(tmp_path / name / "documents.parquet"))
        for _, stage in c.STAGES[:-1]:
            docs = materialise(stage(spark, docs, str(tmp_path / name)), "odd-stage")
            assert docs.columns == df.columns
        got = c.run(spark, str(tmp_path / name)).collect()
        assert len(got) == docs.count() and (len(got) > 0) == (name == "odd")
        assert {r["doc_id"] for r in got} <= {r[0] for r in ROWS}


def test_registered_queries(spark):
    import __spark_entry__ as e

    names = list(e.queries())
    assert [n for n in names if n == "pipeline"] and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))
