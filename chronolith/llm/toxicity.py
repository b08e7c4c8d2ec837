"""Toxicity by maximum-scoring segments of token log-odds.

Tokens are words (runs of letters, lower case) together with their prefixes of 4, 5 and 6 letters, so that
an inflected form never seen backs off to its stem. Log-odds between toxic and clean labelled documents are
shrunk by a Dirichlet prior (the pooled frequencies, worth ``PRIOR`` counts, and ``EVEN`` for every token;
a document counts a token once, since words come in bursts) and lowered by ``MARGIN`` standard deviations
and by ``FLOOR``; tokens that stay positive score, every other word costs ``DRIFT``. A linear
scan then finds all maximal segments of each text. Segment scores are put on the extreme-value scale: with
lambda solving E[exp(lambda s)] = 1 over clean words and K fitted on clean documents, a segment of score S
in n words is expected K n exp(-lambda S) times by chance. A document's statistic is the log of the summed
evidence of its segments over K n, made a probability by a logistic curve fitted on the sample.

Bounds: the fit takes at most about ``SAMPLE`` labelled rows (chosen by a hash of the id). Every token of these
that scores is kept, in a file that is sent to each worker machine once and memory-mapped. Scoring reads every
whole text.

Defined results: null, empty or letterless text has no segment and the score of that statistic; ids may
repeat; a null id is not held out, nor is it learned from; with no labels, or labels of one class only, all
scores are 0 and nothing is predicted; an empty table gives no rows; labels, language, source and ids are never
inputs of a score; ``drop_toxic`` carries other columns, whatever their names.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from chronolith.llm import kernels as K
from chronolith.llm.common import chosen_by_hash, discard, materialise, share_file, small_arrow_batches, table

SAMPLE = 24_000
PRIOR, EVEN, MARGIN, FLOOR, DRIFT = 500.0, 0.5, 2.0, 1.0, 0.25
PREFIXES = (4, 5, 6)
LEAST_COUNT = 3
SIGNIFICANT = 0.05


@dataclass
class Model:
    hashes: np.ndarray
    scores: np.ndarray
    #: The file that workers read both arrays from, by its name for SparkFiles.
    file: str | None = None
    lam: float = 1.0
    k: float = 1.0
    slope: float = 0.0
    offset: float = float("-inf")

    def __getstate__(self) -> dict:
        """Travels without its arrays where there is a file."""
        return self.__dict__ | ({"hashes": None, "scores": None} if self.file else {})

    def opened(self) -> Model:
        if self.hashes is None:
            at = SparkFiles.get(self.file)
            n = os.path.getsize(at) // 16
            self.hashes, self.scores = np.memmap(at, np.uint64, "r", 0, n), np.memmap(at, np.float64, "r", 8 * n, n)
        return self


def letters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, starts and ends of their runs of letters, bounds by text."""
    cps, bounds = K.code_points([(t or "").lower() for t in texts])
    kind = K.char_classes()[cps]
    run = K._runs(kind, bounds)
    edges = np.flatnonzero(run)
    ends = np.append(edges[1:], len(cps)) if len(edges) else edges
    keep = kind[edges] == K.LETTER
    starts, ends = edges[keep], ends[keep]
    return cps, starts, ends, np.searchsorted(starts, bounds)


def forms(cps: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(which words, hash of the form) for the whole word and for every prefix shorter than it."""
    out = [(np.arange(len(starts)), K.slice_hashes(cps, starts, ends))]
    for p in PREFIXES:
        longer = np.flatnonzero(ends - starts > p)
        out.append((longer, K.mixed(K.slice_hashes(cps, starts[longer], starts[longer] + p) + np.uint64(p))))
    return out


def distinct_words(cps: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _, first, inverse = np.unique(K.slice_hashes(cps, starts, ends), return_index=True, return_inverse=True)
    return first, inverse


def word_scores(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Score of every word (0 where it is neutral), word starts and ends, bounds by text."""
    cps, starts, ends, by_text = letters(texts)
    if not len(starts) or not len(model.hashes):
        return np.zeros(len(starts)), starts, ends, by_text
    first, inverse = distinct_words(cps, starts, ends)
    best = np.zeros(len(first))
    for which, h in forms(cps, starts[first], ends[first]):
        at = np.minimum(np.searchsorted(model.hashes, h), len(model.hashes) - 1)
        hit = model.hashes[at] == h
        np.maximum.at(best, which[hit], model.scores[at[hit]])
    return best[inverse], starts, ends, by_text


def segments(at: np.ndarray, score: np.ndarray, drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first word, word after the last, score) of a text whose positive words are ``at``.

    The words between two positive ones are one step of -drift each. Each segment has a link to the nearest one
    before it that starts from a lower total, and only links are followed: those between are either merged away or
    lie behind a link from then on, so the scan is linear.
    """
    stack: list[tuple[int, int, float, float]] = []  # first, after, total before, total at its end
    lower: list[int] = []
    total, last = 0.0, 0
    for p, s in zip(at.tolist(), score.tolist(), strict=True):
        total -= drift * (p - last)
        first, low = p, total
        total, last = total + s, p + 1
        j = len(stack) - 1
        while j >= 0 and stack[j][2] >= low:
            j = lower[j]
        while j >= 0 and stack[j][3] < total:
            # it joins all from the lower start on, and looks on from there
            first, low = stack[j][0], stack[j][2]
            below = lower[j]
            del stack[j:], lower[j:]
            j = below
        stack.append((first, p + 1, low, total))
        lower.append(j)
    return [(a, b, high - low) for a, b, low, high in stack]


def document_statistics(model: Model, texts: list[str | None]) -> Iterator[tuple[float, float, int, list[tuple[int, int, float]]]]:
    """(statistic, best segment score, words, significant segments with code-point bounds in the lower-cased text)."""
    for a, b in K.batches([t or "" for t in texts]):
        score, starts, ends, by_text = word_scores(model, texts[a:b])
        hits = np.flatnonzero(score > 0)
        span = np.searchsorted(hits, by_text)
        offsets = np.concatenate([[0], np.cumsum([len((t or "").lower()) for t in texts[a:b]])])
        for i in range(b - a):
            n = int(by_text[i + 1] - by_text[i])
            base = np.log(model.k * max(n, 1))
            own = hits[span[i] : span[i + 1]]
            if not len(own):
                yield -base, 0.0, n, []
                continue
            found = segments(own - by_text[i], score[own])
            evidence = np.array([s for *_, s in found]) * model.lam
            good = [
                (int(starts[by_text[i] + x] - offsets[i]), int(ends[by_text[i] + y - 1] - offsets[i]), s)
                for (x, y, s), e in zip(found, evidence, strict=True)
                if np.exp(base - e) <= SIGNIFICANT
            ]
            yield float(np.logaddexp.reduce(evidence) - base), float(max(s for *_, s in found)), n, good


def probability(model: Model, statistic: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-(model.slope * statistic + model.offset)))


def labelled_sample(docs: DataFrame, labels: DataFrame, train: Column, size: int = SAMPLE) -> DataFrame:
    """(text, y) of about ``size`` labelled rows at most. Only the chosen ids are broadcast."""
    known = labels.filter(train & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    count = known.count()
    chosen = known.filter(chosen_by_hash(min(1.0, size / max(1, count)), "doc_id"))
    return docs.join(F.broadcast(chosen), "doc_id").select("text", "y")


def token_counts(sample: DataFrame) -> DataFrame:
    """(h, toxic, clean): texts of either class that hold each form; h = 0 has the sums over all forms."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, y = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), np.int64) > 0
            for a, b in K.batches([t or "" for t in texts]):
                cps, starts, ends, by_text = letters(texts[a:b])
                if not len(starts):
                    continue
                text = np.repeat(np.arange(b - a), np.diff(by_text))
                first, inverse = distinct_words(cps, starts, ends)
                spread = forms(cps, starts[first], ends[first])
                which = np.concatenate([w for w, _ in spread])
                h, form = np.unique(np.concatenate([x for _, x in spread]), return_inverse=True)
                # each text counts a form once: (text, distinct word) pairs, then (text, form) pairs
                pair = np.unique(text * len(first) + inverse)
                order = np.argsort(which, kind="stable")
                at = np.searchsorted(which[order], np.arange(len(first) + 1))
                word = pair % len(first)
                flat, span = K.gathered(form[order], at[word], at[word + 1] - at[word])
                seen = np.unique(np.repeat(pair // len(first), np.diff(span)) * len(h) + flat)
                of = seen % len(h)
                n, t = np.bincount(of, minlength=len(h)), np.bincount(of, y[a:b][seen // len(h)], len(h))
                h, n, t = np.append(h, np.uint64(0)), np.append(n, n.sum()), np.append(t, t.sum())
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(t.astype(np.int64)), pa.array((n - t).astype(np.int64))], ["h", "toxic", "clean"])

    small_arrow_batches(sample.sparkSession)
    return sample.mapInArrow(count, "h bigint, toxic bigint, clean bigint").groupBy("h").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def fit(docs: DataFrame, labels: DataFrame, train: Column, size: int = SAMPLE) -> Model:
    sample = materialise(labelled_sample(docs, labels, train, size).groupBy("text").agg(F.max("y").alias("y")), "toxicity-sample")
    counts = materialise(token_counts(sample), "toxicity-counts")
    try:
        return _fitted(sample, counts)
    finally:
        discard(sample, counts)


def _fitted(sample: DataFrame, counts: DataFrame) -> Model:
    all_words = counts.filter("h = 0").first()
    none = Model(np.zeros(0, np.uint64), np.zeros(0))
    if all_words is None or not all_words["toxic"] or not all_words["clean"]:
        return none
    nt, nc = float(all_words["toxic"]), float(all_words["clean"])
    prior = PRIOR * (F.col("toxic") + F.col("clean")) / (nt + nc) + EVEN
    t, c = F.col("toxic") + prior, F.col("clean") + prior
    odds = F.log(t / (nt + PRIOR - t)) - F.log(c / (nc + PRIOR - c)) - MARGIN * F.sqrt(1 / t + 1 / c) - FLOOR
    kept = counts.filter((F.col("h") != 0) & (F.col("toxic") >= LEAST_COUNT)).select("h", odds.alias("s"), (c / (nc + PRIOR)).alias("p")).filter("s > 0").toPandas()
    if kept.empty:
        return none
    h = kept["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    h, s, p = h[order], kept["s"].to_numpy(float)[order], kept["p"].to_numpy(float)[order]
    model = Model(h, s, share_file(counts.sparkSession, "toxicity.tokens", [h.tobytes(), s.tobytes()]))
    model.lam = extreme_rate(s, p)
    model.k = 1.0
    stats = sample_statistics(sample, model)
    if stats.empty:
        return none
    clean = stats[stats.y == 0]
    model.k = float(len(clean) / max(1e-9, (clean.n.clip(lower=1) * np.exp(-model.lam * clean.best)).sum())) if len(clean) else 1.0
    model.slope, model.offset = logistic(stats.x.to_numpy() - np.log(model.k), stats.y.to_numpy() > 0)
    return model


def extreme_rate(s: np.ndarray, p: np.ndarray, drift: float = DRIFT) -> float:
    """The positive root of sum p exp(lambda s) + (1 - sum p) exp(-lambda drift) = 1."""
    rest = max(0.0, 1 - p.sum())
    excess = lambda x: float((p * np.exp(x * s)).sum() + rest * np.exp(-x * drift) - 1)
    low, high = 1e-4, 1e-3
    while excess(high) < 0 and high < 8:
        high *= 2
    if excess(low) >= 0:
        return low
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return low


def sample_statistics(sample: DataFrame, model: Model):
    """x, best, n and y of every sampled row, as pandas: at most SAMPLE rows of four numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(document_statistics(model.opened(), batch.column(0).to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array([float(r[i]) for r in rows], pa.float64()) for i in range(3)] + [batch.column(1).cast(pa.float64())], ["x", "best", "n", "y"])

    return sample.mapInArrow(run, "x double, best double, n double, y double").toPandas()


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps on smoothed targets (Platt), which keeps separable classes finite."""
    n1, n0 = y.sum(), (~y).sum()
    if not n1 or not n0:
        return 0.0, float("-inf")
    target = np.where(y, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    w = np.zeros(2)
    scale = max(1.0, np.abs(x).max())
    z = np.stack([x / scale, np.ones(len(x))], 1)

    def loss(v: np.ndarray) -> float:
        m = z @ v
        return float((np.logaddexp(0, m) - target * m).sum() + 1e-6 * (v @ v))

    for _ in range(100):
        p = 1 / (1 + np.exp(-(z @ w)))
        gradient = z.T @ (p - target) + 2e-6 * w
        hessian = (z * (p * (1 - p))[:, None]).T @ z + 2e-6 * np.eye(2)
        step, rate = np.linalg.solve(hessian, gradient), 1.0
        while loss(w - rate * step) > loss(w) and rate > 1e-6:
            rate /= 2
        w = w - rate * step
        if np.abs(step).max() < 1e-9:
            break
    return max(0.0, float(w[0] / scale)), float(w[1])


def score_documents(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and score, n_passages, passages (array of start, end, score; code points of the lower-cased text)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    frame = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).alias("__text"))
    made = StructType.fromDDL("__score double, __n_passages bigint, __passages array<struct<start:bigint,end:bigint,score:double>>")
    passage = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value.opened()
        for batch in batches:
            rows = list(document_statistics(m, batch.column(len(keep)).to_pylist()))
            score = probability(m, np.array([r[0] for r in rows])) if rows else np.zeros(0)
            passages = pa.array([[{"start": a, "end": b, "score": s} for a, b, s in r[3]] for r in rows], passage)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(score, pa.float64()), pa.array([len(r[3]) for r in rows], pa.int64()), passages], [*keep, "__score", "__n_passages", "__passages"])

    small_arrow_batches(docs.sparkSession)
    return frame.mapInArrow(run, StructType([*frame.schema.fields[: len(keep)], *made.fields]))


def training_rows(id_col: str = "doc_id") -> Column:
    """Whether a row may be learned from; null where the id is null."""
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5)) != 0


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows that are not predicted toxic, with all their columns; nothing is joined, so repeated ids are no matter."""
    named = [f"c{i}" for i in range(len(docs.columns))]
    scored = score_documents(docs.toDF(*named), model, named[docs.columns.index(text_col)], tuple(named))
    return scored.filter("__score < 0.5").select(*named).toDF(*docs.columns)


def op7_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), training_rows())
    return score_documents(docs, model).select(
        "doc_id", F.coalesce(~training_rows(), F.lit(False)).alias("held_out"), F.col("__score").alias("score"),
        (F.col("__score") >= 0.5).cast("int").alias("predicted"), F.col("__n_passages").alias("n_passages"),
    )
