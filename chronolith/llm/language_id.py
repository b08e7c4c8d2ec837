"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Features: n-grams of 1 to 3 characters of the lower-cased text, in which every run of other characters than
letters is one blank, hashed to ``BUCKETS``; a feature's value is its share of the text's n-grams times its
inverse document frequency. Document frequencies are counted over all training rows. The weights are fitted
by follow-the-regularised-leader with L1 and L2 penalties (so most stay exactly zero) on at most about
``SAMPLE`` rows, the same number of every language where there are so many, and a temperature is fitted on
a fifth of them that the weights have not seen. Since features are linear in occurrences, a text's logits
are a mean over its n-grams: whole texts are scored in array operations, and what is broadcast is one table
of ``BUCKETS`` rows.

Defined results: ``und`` with score 0 if the text is null or has no letter, or if there is nothing to learn
from; equal texts get equal results; very long texts are read whole, a stretch at a time; a null id is not held
out, nor is it learned from; an empty table gives no rows; language, source and id are never inputs of a
prediction, and columns besides id, text and language are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm import kernels as K
from chronolith.llm.common import chosen_by_hash, small_arrow_batches, table

BUCKETS, ORDERS = 1 << 15, (1, 2, 3)
SAMPLE, EPOCHS = 3000, 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.05
#: Shares times idf are small numbers; this brings them to the order of one.
GAIN = 30.0
UNKNOWN = "und"
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


@dataclass
class Model:
    languages: list[str]
    #: (BUCKETS, languages): weight times idf times gain
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0


def grams(texts: list[str | None], chunk: int = 1 << 20) -> tuple[Iterator[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """(text of each n-gram, its bucket) of one order and ``chunk`` places after the other; n-grams by text; letters by text."""
    cps, bounds = K.code_points([(t or "").lower() for t in texts])
    letter = K.char_classes()[cps] == K.LETTER
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[bounds[:-1][np.diff(bounds) > 0]] = True
    spans = list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
    letters = np.array([np.count_nonzero(letter[a:b]) for a, b in spans], np.int64)
    at = np.concatenate([[0], np.cumsum([np.count_nonzero(keep[a:b]) for a, b in spans])]).astype(np.int64)
    cps = np.where(letter, cps, np.uint32(0x20))[keep]
    size = np.diff(at)
    total = sum(np.maximum(0, size - n + 1) for n in ORDERS)

    def found() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for a in range(0, len(cps), chunk):
            place = np.arange(a, min(len(cps), a + chunk))
            text = np.searchsorted(at, place, "right") - 1
            left = at[text + 1] - place
            for n in ORDERS:
                fits = left >= n
                starts = place[fits]
                h = np.full(len(starts), n, np.uint64)
                for j in range(n):
                    h = (h + cps[starts + j].astype(np.uint64)) * MULTIPLIERS[j]
                    h ^= h >> np.uint64(29)
                yield text[fits], ((h * MULTIPLIERS[0]) >> np.uint64(64 - 15)).astype(np.int64)

    return found(), total, letters


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """In how many texts each bucket occurs, and the number of texts; every task sends one row a bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a in range(0, len(texts), 64):
                for x, y in K.batches(texts[a : a + 64]):
                    part = texts[a + x : a + y]
                    there = np.zeros((len(part), BUCKETS), bool)
                    for text, bucket in grams(part)[0]:
                        there[text, bucket] = True
                    df += there.sum(0)
                    n += len(part)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(df[some], n))], ["bucket", "df"])

    small_arrow_batches(docs.sparkSession)
    out = np.zeros(BUCKETS + 1, np.int64)
    for r in docs.select(text_col).mapInArrow(count, "bucket bigint, df bigint").groupBy("bucket").agg(F.sum("df").alias("df")).collect():
        out[r["bucket"]] = r["df"]
    return out[:BUCKETS], int(out[BUCKETS])


def sampled(docs: DataFrame, size: int = SAMPLE) -> tuple[list[str], pd.DataFrame]:
    """Languages in order, and (lang, bucket bytes, count bytes) of about size / languages rows of each, in an order that only these decide.

    The rows with the least hashes of id and text are taken, of equal rows one, and of each language the least of all.
    """
    found = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min(F.xxhash64("doc_id", "text")).alias("least")).collect()
    counts, least = {r["lang"]: r["n"] for r in found}, {r["lang"]: r["least"] for r in found}
    languages = sorted(counts)
    shares = {k: min(1.0, size / len(counts) / n) for k, n in counts.items()}
    if not languages:
        return [], pd.DataFrame(columns=["lang", "b", "c"])
    of = lambda values: F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(values[k]))])[F.col("lang")]
    keyed = docs.withColumn("hash", F.xxhash64("doc_id", "text")).filter(chosen_by_hash(of(shares), "doc_id", "text") | (F.col("hash") == of(least)))
    chosen = keyed.groupBy("lang", "hash").agg(F.min("text").alias("text")).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bs, cs = [], []
            texts = batch.column(1).to_pylist()
            for t in texts:
                n = sum((np.bincount(b, minlength=BUCKETS) for _, b in grams([t])[0]), np.zeros(BUCKETS, np.int64))
                b = np.flatnonzero(n)
                bs.append(b.astype(np.uint16).tobytes())
                cs.append(n[b].astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bs, pa.binary()), pa.array(cs, pa.binary())], ["lang", "b", "c"])

    rows = chosen.mapInArrow(run, "lang string, b binary, c binary").toPandas()
    mixed = rows.assign(key=[hashlib.sha256(b + c).digest() for b, c in zip(rows["b"], rows["c"], strict=True)])
    return languages, mixed.sort_values(["key", "lang"], kind="stable", ignore_index=True)[["lang", "b", "c"]]


def follow_the_leader(rows: list[tuple[np.ndarray, np.ndarray, int]], k: int, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Weights (BUCKETS, k) and biases by FTRL-proximal over (buckets, values, class) rows, with L1 and L2 penalties."""
    z, n, zb, nb = np.zeros((BUCKETS, k)), np.zeros((BUCKETS, k)), np.zeros(k), np.zeros(k)

    def weights(z: np.ndarray, n: np.ndarray, l1: float) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    order = np.random.default_rng(0)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            b, v, y = rows[i]
            w, bias = weights(z[b], n[b], L1), weights(zb, nb, 0.0)
            logits = v @ w + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y] -= 1
            for zz, nn, at, ww, g in ((z, n, b, w, v[:, None] * p), (zb, nb, slice(None), bias, p)):
                old = nn[at]
                new = old + g * g
                zz[at] += g - (np.sqrt(new) - np.sqrt(old)) / ALPHA * ww
                nn[at] = new
    return weights(z, n, L1), weights(zb, nb, 0.0)


def best_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature in [1/16, 16] of least log loss, by golden-section search on its logarithm."""

    def loss(log_t: float) -> float:
        x = logits / np.exp(log_t)
        x = x - x.max(1, keepdims=True)
        return float((np.log(np.exp(x).sum(1)) - x[np.arange(len(y)), y]).mean())

    a, b, r = -np.log(16), np.log(16), (5**0.5 - 1) / 2
    for _ in range(50):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def fit(docs: DataFrame, size: int = SAMPLE) -> Model:
    """docs: doc_id, text, lang of the rows to learn from."""
    train = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    languages, rows = sampled(train, size)
    none = Model([], np.zeros((BUCKETS, 0)), np.zeros(0))
    if not len(rows):
        return none
    df, n = document_frequencies(train)
    idf = np.log((1 + n) / (1 + df)) + 1
    number = {k: i for i, k in enumerate(languages)}
    made = []
    for lang, b, c in rows.itertuples(index=False):
        bucket, count = np.frombuffer(b, np.uint16).astype(np.int64), np.frombuffer(c, np.float32)
        if len(bucket):
            made.append((bucket, GAIN * count / count.sum() * idf[bucket], number[lang]))
    held, used = made[::5], [x for i, x in enumerate(made) if i % 5]
    w, bias = follow_the_leader(used or made, len(languages))
    logits = np.array([v @ w[b] + bias for b, v, _ in held or made])
    t = best_temperature(logits, np.array([y for *_, y in held or made])) if len(logits) else 1.0
    return Model(languages, (w * idf[:, None] * GAIN).astype(np.float64), bias, t)


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    names, scores = [], []
    for a, b in K.batches([t or "" for t in texts], 1 << 19):
        found, total, letters = grams(texts[a:b])
        k = len(model.languages)
        if not k:
            names += [UNKNOWN] * (b - a)
            scores.append(np.zeros(b - a))
            continue
        logits, columns = np.zeros((b - a, k)), np.ascontiguousarray(model.weights.T)
        for text, bucket in found:
            for j in range(k):
                logits[:, j] += np.bincount(text, columns[j][bucket], b - a)
        logits = (logits / np.maximum(1, total)[:, None] + model.bias) / model.temperature
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        blank = letters == 0
        names += [UNKNOWN if x else model.languages[i] for i, x in zip(best.tolist(), blank.tolist(), strict=True)]
        scores.append(np.where(blank, 0.0, p[np.arange(b - a), best]))
    return names, np.concatenate(scores) if scores else np.zeros(0)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = predict(sent.value, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], [id_col, "lang_pred", "score"])

    small_arrow_batches(docs.sparkSession)
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")


def held_out(id_col: str = "doc_id") -> Column:
    """Whether the remainder is 2; a null id has none."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2, F.lit(False))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(~held_out() & F.col("doc_id").isNotNull()).select("doc_id", "text", "lang"))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
