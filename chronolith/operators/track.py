"""Sequential kernels: rules whose next step depends on what they emitted or accepted before.

``lag`` compares with the last row, these compare with the last emitted one, so each session (or group) is
folded in order: the longer rules by machines (``machines``), which also run on streams, the shorter ones by steps
through which sorted rows stream (``_walked``). Parallelism is across sessions; a session streams through one task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolith.config import DEFAULT, Thresholds
from chronolith.functions.signal import l1
from chronolith.operators.machines import BREAKS, CONFIRM, SCHEDULE, TRACK, Breaks, Confirm, Schedule, Track, folded, schema_of


def _by(rows: DataFrame, keys: list[str], fn, schema: str) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return fn(pdf.sort_values("f", kind="stable"))

    return rows.groupBy(*keys).applyInPandas(run, schema)


#: Types of what a step may add to a row.
ADDED = {"bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}


def _walked(rows: DataFrame, keys: list[str], reads: list[str], rule: Callable[[], Callable], kept: list[str], added: str = "", order: tuple[str, ...] = ("f",)) -> DataFrame:
    """The rows of every group, in order, go through a step that ``rule`` makes for the group. It gets the columns ``reads``;
    where it returns a tuple, the row's columns ``kept`` and the tuple, named and typed by ``added``, are a row of the result.

    Groups stream through a task by the batch, however many or long: one call a group costs far more than its rows.
    """
    kinds, new = dict(rows.dtypes), [x.split() for x in added.split(", ") if x]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    ordered = rows.withColumn("__place", place).sortWithinPartitions(*keys, *order)
    names, types = [*kept, *(n for n, _ in new)], [ADDED[k] for _, k in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = None
        for batch in batches:
            at, found = [], []
            for i, (place, *values) in enumerate(zip(*(batch.column(c).to_pylist() for c in ["__place", *reads]), strict=True)):
                if place == 1:
                    step = rule()
                if (got := step(*values)) is not None:
                    at.append(i)
                    found.append(got)
            if at:
                told = [pa.array(x, k) for x, k in zip(zip(*found, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(at)) for c in kept), *told], names=names)

    return ordered.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), *(f"`{n}` {k}" for n, k in new)]))


def _apart(a: float | None, b: float | None, least: float) -> bool:
    """Whether two values differ by ``least``, as SQL has it: null never does, and NaN from everything."""
    return a is not None and b is not None and not abs(a - b) < least


def dead_band(rows: DataFrame, move: float = DEFAULT.emit_move) -> DataFrame:
    """(session, path, f, v): rows whose value is at least ``move`` from the last emitted one."""

    def rule() -> Callable:
        last, begun = None, False

        def step(v) -> tuple | None:
            nonlocal last, begun
            if begun and not _apart(v, last, move):
                return None
            last, begun = v, True
            return ()

        return step

    columns = ["session", "path", "f", "v"]
    return _walked(rows.select(*columns), ["session", "path"], ["v"], rule, columns)


def emitted_boxes(rows: DataFrame, move: float = DEFAULT.emit_move) -> DataFrame:
    """(session, path, f, box array, source, anchor_f): rows to emit: the box has moved by ``move`` in some coordinate since the last emitted one, or is known otherwise."""

    def rule() -> Callable:
        last = None

        def step(*now) -> tuple | None:
            nonlocal last
            if last is not None and last[:2] == now[:2] and not any(_apart(a, b, move) for a, b in zip(last[2], now[2], strict=True)):
                return None
            last = now
            return ()

        return step

    columns = ["session", "path", "f", "box", "source", "anchor_f"]
    return _walked(rows.select(*columns), ["session", "path"], ["source", "anchor_f", "box"], rule, columns)


def spaced(rows: DataFrame, gap: int = DEFAULT.bbox_sample_gap) -> DataFrame:
    """(session, path, f): rows at least ``gap`` frames after the last emitted one; also the cooldown of cuts."""

    def rule() -> Callable:
        last = None

        def step(f) -> tuple | None:
            nonlocal last
            if last is not None and f - last < gap:
                return None
            last = f
            return ()

        return step

    columns = ["session", "path", "f"]
    return _walked(rows.select(*columns), ["session", "path"], ["f"], rule, columns)


class _Ballot:
    """Reads that vote on the next accepted value; it is empty while nothing contradicts the accepted one."""

    def __init__(self, fps: float, t: Thresholds):
        self.seats, self.needed, self.expire = t.vote_window, t.votes, t.vote_expire_s * fps
        self.persist = max(2, int(t.vote_persist_s * fps))
        self.accepted: float | None = None
        self.votes: list[tuple[int, float]] = []

    def plausible(self, v: float) -> bool:
        return self.accepted is None or abs(v - self.accepted) <= max(1000, 10 * abs(self.accepted))

    def winner(self) -> tuple[float, list[int]]:
        """The value with most votes, the first voted for of equals, and the frames of its votes."""
        frames: dict[float, list[int]] = {}
        for f, v in self.votes:
            frames.setdefault(v, []).append(f)
        return max(frames.items(), key=lambda x: len(x[1]))

    def read(self, f: int, v: float) -> tuple[int, float, float | None] | None:
        """Takes a read; the change (first winning frame, value, value before) if that decides one."""
        if not self.plausible(v) or (v == self.accepted and not self.votes):
            return None
        self.votes = [x for x in [*self.votes, (f, v)][-self.seats :] if f - x[0] <= self.expire]
        value, frames = self.winner()
        confirmed, lasting = value == self.accepted, frames[-1] - frames[0] >= self.persist
        if len(frames) < self.needed or not (confirmed or lasting):
            return None
        before, self.votes, self.accepted = self.accepted, [], value
        return None if confirmed else (frames[0], value, before)


def voted_changes(reads: DataFrame, fps: float, t: Thresholds = DEFAULT) -> DataFrame:
    """(session, path, f, v) reads -> accepted values (session, path, f0, v, prev), dated to the first winning read. Null reads are no evidence."""

    def rule() -> Callable:
        ballot = _Ballot(fps, t)
        return lambda f, v: None if v is None or math.isnan(v) else ballot.read(f, v)

    return _walked(reads.select("session", "path", "f", "v"), ["session", "path"], ["f", "v"], rule, ["session", "path"], "f0 bigint, v double, prev double")


def confirmed_reads(reads: DataFrame) -> DataFrame:
    """reads (session, path, f, v, second, third) -> accepted changes (session, path, f, v, prev).

    A value that differs from the accepted one is taken if an independent second read gives it too. A second read that
    is new itself becomes the candidate, once, and the third has to give it. The first value of all needs no second.
    """

    chosen = reads.select("session", "path", "f", *[F.col(c).cast("double").alias(c) for c in ("v", "second", "third")])
    return folded(chosen, ["session", "path"], Confirm, schema_of(chosen, ["session", "path"], CONFIRM))


def reads_wanted(crops: DataFrame, frames: int, least: float = 1.5, floor: int = 400, share: float = 0.15) -> DataFrame:
    """crops (session, path, f, level, checksum): those to read: changed by more than ``least`` since the crop last looked at, of a
    checksum not seen on the path, within max(floor, share of the frames) reads a session."""

    def rule() -> Callable:
        looked, seen, left = {}, set(), max(floor, int(share * frames))

        def step(path, level, checksum) -> tuple | None:
            nonlocal left
            level = math.nan if level is None else level
            if path in looked and abs(level - looked[path]) <= least:
                return None
            looked[path] = level
            if (path, checksum) in seen or left <= 0:
                return None
            seen.add((path, checksum))
            left -= 1
            return ()

        return step

    columns = ["session", "path", "f", "level", "checksum"]
    return _walked(crops.select(*columns), ["session"], ["path", "level", "checksum"], rule, columns)


def budgeted(rows: DataFrame, share: float = DEFAULT.budget_share, extra: int = DEFAULT.budget_extra, cap: int | None = None) -> DataFrame:
    """(session, f, wanted): grants while those so far are within share * rows seen + extra, and below a cap."""

    def rule() -> Callable:
        granted = seen = 0

        def step(want) -> tuple:
            nonlocal granted, seen
            seen += 1
            give = bool(want) and granted + 1 <= share * seen + extra and (cap is None or granted < cap)
            granted += give
            return (give,)

        return step

    asked = rows.select("session", "f", F.col("wanted").cast("boolean").alias("wanted"))
    return _walked(asked, ["session"], ["wanted"], rule, ["session", "f", "wanted"], "granted boolean")


def model_cap(frames: int, share: float = 0.05, most: int = 24) -> int:
    """Frames of a session that may call the costly model."""
    return min(int(share * frames) - 1, most)


def monotone_repaired(rows: DataFrame, span: int = 8) -> DataFrame:
    """(session, f, v) of a counter that does not fall: a value outside its neighbours, where these are in order and at most ``span`` apart, becomes the one before."""

    def fn(p: pd.DataFrame) -> pd.DataFrame:
        v = p["v"].tolist()
        for i in range(1, len(v) - 1):
            low, high = v[i - 1], v[i + 1]
            if 0 <= high - low <= span and not low <= v[i] <= high:
                v[i] = low
        return p.assign(v=v)

    return _by(rows.select("session", "f", "v"), ["session"], fn, rows.select("session", "f", "v").schema.simpleString()[7:-1].replace(":", " "))


def smoothed(rows: DataFrame, keep: float) -> DataFrame:
    """(session, path, f, v) with s: exponential smoothing, vectorised by pandas."""

    def fn(p: pd.DataFrame) -> pd.DataFrame:
        return p.assign(s=p["v"].astype(float).ewm(alpha=1 - keep, adjust=False).mean())

    kinds = dict(rows.dtypes)
    return _by(rows.select("session", "path", "f", "v"), ["session", "path"], fn, f"session {kinds['session']}, path {kinds['path']}, f {kinds['f']}, v {kinds['v']}, s double")


def blobs(mask: np.ndarray, least: int = 6, most_pixels: int = 6000, top: int = 60) -> list[tuple[int, int, int, int, int]]:
    """Eight-connected regions of a boolean image as (area, x, y, w, h), largest first; none if more than ``most_pixels`` are set."""
    ys, xs = np.nonzero(mask)
    if not len(ys) or len(ys) > most_pixels:
        return []
    label = {p: i for i, p in enumerate(zip(ys.tolist(), xs.tolist(), strict=True))}
    parent = list(range(len(ys)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for (y, x), i in label.items():
        for q in ((y, x - 1), (y - 1, x - 1), (y - 1, x), (y - 1, x + 1)):
            if q in label:
                parent[root(i)] = root(label[q])
    roots = np.array([root(i) for i in range(len(ys))])
    found = []
    for r in np.unique(roots):
        y, x = ys[roots == r], xs[roots == r]
        if len(y) >= least:
            found.append((len(y), int(x.min()), int(y.min()), int(np.ptp(x)) + 1, int(np.ptp(y)) + 1))
    return sorted(found, reverse=True)[:top]


def tracked(boxes: DataFrame, fps: float = 60.0, t: Thresholds = DEFAULT) -> DataFrame:
    """(session, f, x, y, w, h) detections -> (session, f, track, x, y, w, h, state).

    Greedy nearest neighbour on the predicted centre within max(.05, 1.5 diagonals); velocities are smoothed
    .6/.4; a track is confirmed after enough hits and displacement, hidden after four missed frames, removed
    after three seconds. State is ``seen``, ``partial`` (with ten sightings or more, an area below 0.6 of the 80th
    percentile of the last 240), ``hidden`` or ``removed``.
    """

    chosen = boxes.select("session", "f", "x", "y", "w", "h")
    return folded(chosen, ["session"], lambda: Track(fps, t), schema_of(chosen, ["session"], TRACK))


def breaks(frames: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """(session, f, regions array[, hist array]) -> (session, kind, f_start, f_end, conf): flashes of one or two frames, and cuts.

    A frame jumps if enough regions, or the mean, are far from the reference. It is a flash if the next frame or the
    one after is back at the reference. It is a cut if instead most regions of it and the next two are far, the last
    cut is longer ago than the cooldown, and, where there are histograms, its own and that of the second next frame
    are far from the reference's. The first frame counts as a cut for the cooldown but is none. The reference is the
    last frame outside a flash, which is why this is a kernel.
    """
    chosen = frames.select("session", "f", "regions", *(["hist"] if "hist" in frames.columns else []))
    return folded(chosen, ["session"], lambda: Breaks(t), schema_of(chosen, ["session"], BREAKS))


def flashes(frames: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """(session, f, regions array) -> (session, f_start, f_end, conf) of flashes."""
    return breaks(frames, t).filter("kind = 'flash'").drop("kind")


def scheduled(regions: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """(session, f, region, residual, explained, is_text, cut[, flash, fresh]) -> mode, confidence and warning of every region and frame.

    A cut refreshes everything (F). In a flash changed regions are verified and others copied, at the confidence they
    have. Else quiet regions copy, text cells are verified, new objects and large changes that no motion explains ask
    to be read again, explained motion propagates, all other change is verified. Copying and propagating wear
    confidence down, and a region below ``reinfer_below`` asks too. What asks is read (R) while reads of the frames
    before are within a share of all region-frames, and else only verified; a warning follows where confidence then
    is low, at most every ``warn_gap`` frames a region.
    """
    inputs = ["residual", "explained", "is_text", "cut", "flash", "fresh"]
    chosen = regions.select("session", "f", F.col("region").cast("int").alias("region"), *[F.col(c) if c in regions.columns else F.lit(False).alias(c) for c in inputs])

    return folded(chosen, ["session"], lambda: Schedule(t), schema_of(chosen, ["session"], SCHEDULE))


def sample_points(duration: float, changes: list[float], every: float = 1.0, near: float = 0.5, step: float = 0.25) -> list[tuple[float, str]]:
    """Points to annotate: every second but the last instants, and scene changes. A change within half a scan step of a
    point relabels it; one nearer than ``near`` to any point taken so far is left out."""
    points = {i * every: "interval" for i in range(int((duration - 0.05) / every + 1e-6) + 1)} if duration > 0.05 else {}
    for c in sorted(changes):
        gap, at = min(((abs(c - p), p) for p in points), default=(math.inf, c))
        if gap < step / 2:
            points[at] = "scene_change"
        elif gap >= near:
            points[c] = "scene_change"
    return sorted(points.items())


def reidentified(lost: DataFrame, seen: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """lost and seen (session, id, color array, area, x, y) -> (session, seen_id, lost_id): of the lost tracks near in colour, area and place the best.

    The seen ones choose in order of id, and a lost track that has been chosen is lost no more. Only pairs that are
    near enough reach the kernel.
    """
    a = lost.select("session", F.col("id").alias("lost_id"), F.col("color").alias("c0"), F.col("area").alias("a0"), F.col("x").alias("x0"), F.col("y").alias("y0"))
    pairs = seen.withColumnRenamed("id", "seen_id").join(a, "session")
    color, ratio, place = l1(F.col("color"), F.col("c0")), F.col("area") / F.greatest(F.col("a0"), F.lit(1e-6)), F.hypot(F.col("x") - F.col("x0"), F.col("y") - F.col("y0"))
    good = pairs.withColumn("color_gap", color).withColumn("place_gap", place).filter((F.col("color_gap") < t.reid_color) & (ratio > 0.5) & (ratio < 2) & (F.col("place_gap") < t.reid_distance))
    scored = good.select("session", F.col("seen_id").alias("f"), "lost_id", (F.col("color_gap") / t.reid_color + F.col("place_gap")).alias("gap"))

    def fn(p: pd.DataFrame) -> pd.DataFrame:
        taken, out = set(), []
        for seen_id, rows in p.sort_values(["f", "gap", "lost_id"]).groupby("f", sort=True):
            best = next((x for x in rows["lost_id"].tolist() if x not in taken), None)
            if best is not None:
                taken.add(best)
                out.append((p["session"].iloc[0], seen_id, best))
        return pd.DataFrame(out, columns=["session", "seen_id", "lost_id"])

    kinds = dict(scored.dtypes)
    return _by(scored, ["session"], fn, f"session {kinds['session']}, seen_id {kinds['f']}, lost_id {kinds['lost_id']}")
