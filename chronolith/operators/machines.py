"""Sequential rules as machines: what a rule keeps between two frames, and what a frame makes it emit.

A machine is fed one frame of one session (or path) at a time, all rows of it, in order; ``push`` and ``end`` return
rows. It keeps a bounded state and can be pickled at any point, so the same machine serves a batch, which streams
sorted rows through it (``folded``), and a stream, which lays it down between micro-batches (``streaming.stateful``).
"""

from __future__ import annotations

import math
import pickle
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.config import DEFAULT, Thresholds

#: Rows that a batch of results is cut to.
OUT_ROWS = 10_000


class Machine:
    def push(self, f: int, rows: list[dict]) -> list[tuple]:
        raise NotImplementedError

    def end(self) -> list[tuple]:
        return []

    def laid_down(self) -> bytes:
        return pickle.dumps(self)


def taken_up(data: bytes) -> Machine:
    return pickle.loads(data)


def folded(rows: DataFrame, keys: list[str], machine: Callable[[], Machine], schema: str) -> DataFrame:
    """The rows of a machine for every key, keys first. Rows stream through in order of key and frame: of a session
    a task holds a frame and the machine, never all of it."""
    columns = rows.columns
    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, "f")
    names = [c.strip().split()[0].strip("`") for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, f, held, at, out = None, None, [], None, []
        for batch in batches:
            for r in zip(*(batch[c].astype(object).where(batch[c].notna(), None).tolist() if batch[c].dtype != object else batch[c].tolist() for c in columns), strict=True):
                row = dict(zip(columns, r, strict=True))
                key = tuple(row[k] for k in keys)
                if at is not None and (key != now or row["f"] != f):
                    out += [(*now, *x) for x in at.push(f, held)]
                    held = []
                if key != now:
                    if at is not None:
                        out += [(*now, *x) for x in at.end()]
                    now, at = key, machine()
                f = row["f"]
                held.append(row)
            if len(out) >= OUT_ROWS:
                yield pd.DataFrame(out, columns=names)
                out = []
        if at is not None:
            out += [(*now, *x) for x in at.push(f, held)]
            out += [(*now, *x) for x in at.end()]
        if out:
            yield pd.DataFrame(out, columns=names)

    return ordered.mapInPandas(run, schema)


class Confirm(Machine):
    """Rows (v, second, third) -> (f, v, prev).

    A value that differs from the accepted one is taken if an independent second read gives it too. A second read that
    is new itself becomes the candidate, once, and the third has to give it. The first value of all needs no second.
    """

    def __init__(self) -> None:
        self.accepted: float | None = None

    def push(self, f: int, rows: list[dict]) -> list[tuple]:
        out = []
        for r in rows:
            first, second, third, old = r["v"], r["second"], r["third"], self.accepted
            if first is None or first == old:
                continue
            value = first if old is None or second == first else second if second is not None and second != old and third == second else None
            if value is not None:
                out.append((f, float(value), old))
                self.accepted = float(value)
        return out


class Breaks(Machine):
    """Rows (regions[, hist]) -> (kind, f_start, f_end, conf). A frame is judged when the next two are there, so these are what is held."""

    def __init__(self, t: Thresholds = DEFAULT) -> None:
        self.t, self.waiting = t, deque()
        self.ref: tuple | None = None
        self.last_cut = self.skip = 0

    def push(self, f: int, rows: list[dict]) -> list[tuple]:
        out = []
        for r in rows:
            frame = f, np.asarray(r["regions"], float), None if r.get("hist") is None else np.asarray(r["hist"], float)
            if self.ref is None:
                self.ref, self.last_cut = frame, f
                continue
            self.waiting.append(frame)
            if len(self.waiting) == 3:
                out += self.judge()
        return out

    def end(self) -> list[tuple]:
        out = []
        while self.waiting:
            out += self.judge()
        return out

    def far(self, frame: tuple) -> tuple[float, float]:
        return float((np.abs(frame[1] - self.ref[1]) > self.t.flash_residual).mean()), abs(float(frame[1].mean() - self.ref[1].mean()))

    def recoloured(self, frame: tuple) -> bool:
        return frame[2] is None or 0.5 * float(np.abs(frame[2] - self.ref[2]).sum()) >= self.t.cut_histogram

    def judge(self) -> list[tuple]:
        t, frame = self.t, self.waiting.popleft()
        if self.skip:
            self.skip -= 1
            return []
        share, shift = self.far(frame)
        out = []
        if share >= t.flash_fraction or shift >= t.flash_shift:
            ahead = [self.far(x) for x in self.waiting]
            back = next((k for k, (s, m) in enumerate(ahead) if s < t.return_fraction and m < t.return_shift), None)
            if back is not None:
                self.skip = back
                last = self.waiting[back - 1][0] if back else frame[0]
                return [("flash", frame[0], last, 0.9 if share >= t.flash_fraction else 0.7)]
            if len(ahead) == 2 and min(share, *(s for s, _ in ahead)) >= t.cut_fraction and frame[0] - self.last_cut > t.cut_cooldown and self.recoloured(frame) and self.recoloured(self.waiting[1]):
                self.last_cut = frame[0]
                out.append(("cut", frame[0], frame[0], 0.8))
        self.ref = frame
        return out


class Schedule(Machine):
    """Rows (region, residual, explained, is_text, cut, flash, fresh) -> (f, region, mode, conf, warning)."""

    def __init__(self, t: Thresholds = DEFAULT) -> None:
        self.t = t
        self.conf: dict[int, float] = {}
        self.warned: dict[int, int] = {}
        self.frames = self.read = 0

    def choice(self, r: dict, conf: float) -> tuple[str, float, bool]:
        """Mode, confidence and whether the region asks to be read again."""
        t, quiet = self.t, r["residual"] < self.t.copy_residual
        if r["flash"]:
            return ("V" if r["residual"] > t.copy_residual else "C"), conf, False
        if quiet:
            return "C", conf * t.decay_copy, conf * t.decay_copy < t.reinfer_below
        if r["is_text"]:
            return "V", conf, False
        if r["fresh"] or (r["residual"] > t.big_residual and not r["explained"]):
            return "C", conf, True
        if r["explained"]:
            return "P", conf * t.decay_propagated, conf * t.decay_propagated < t.reinfer_below
        return "V", max(conf, 0.8), False

    def push(self, f: int, rows: list[dict]) -> list[tuple]:
        t, out, reads = self.t, [], 0
        self.frames += 1
        may_read = self.read < t.budget_share * len(rows) * self.frames + t.budget_extra
        whole = any(r["cut"] for r in rows)
        for r in sorted(rows, key=lambda r: r["region"]):
            k, warning = r["region"], False
            mode, c, asks = ("F", 1.0, False) if whole else self.choice(r, self.conf.get(k, 1.0))
            if asks and may_read:
                mode, c, reads = "R", t.reread_confidence, reads + 1
            elif asks:
                mode, c = "V", c * t.decay_propagated
                if warning := c < t.warn_below and f - self.warned.get(k, -(10**9)) > t.warn_gap:
                    self.warned[k] = f
            self.conf[k] = c
            out.append((f, k, mode, round(c, 6), warning))
        self.read += reads
        return out


def percentile(values: list[float], q: float) -> float:
    """Linear between neighbours, to the bit as ``np.percentile`` gives it, which takes a hundred microseconds for a short list."""
    if any(math.isnan(v) for v in values):
        return math.nan
    at = (len(values) - 1) * q
    low, ordered = math.floor(at), sorted(values)
    a, b, part = ordered[low], ordered[min(low + 1, len(values) - 1)], at - low
    return b - (b - a) * (1 - part) if part >= 0.5 else a + (b - a) * part


class Track(Machine):
    """Rows (x, y, w, h) -> (f, track, x, y, w, h, state)."""

    def __init__(self, fps: float = 60.0, t: Thresholds = DEFAULT) -> None:
        self.fps, self.t, self.live, self.number = fps, t, [], 0

    def push(self, f: int, rows: list[dict]) -> list[tuple]:
        t, out, found = self.t, [], [(float(r["x"]), float(r["y"]), float(r["w"]), float(r["h"])) for r in rows]
        free, pairs = set(range(len(found))), []
        for k, tr in enumerate(self.live):
            steps = f - tr["f"]
            px, py = tr["cx"] + tr["vx"] * steps, tr["cy"] + tr["vy"] * steps
            gate = max(0.05, 1.5 * math.hypot(tr["w"], tr["h"]))
            for j, (x, y, w, h) in enumerate(found):
                d = math.hypot(x + w / 2 - px, y + h / 2 - py)
                if d <= gate:
                    pairs.append((d, k, j))
        taken = set()
        for _, k, j in sorted(pairs):
            if k in taken or j not in free:
                continue
            taken.add(k)
            free.discard(j)
            tr, (x, y, w, h) = self.live[k], found[j]
            cx, cy, steps = x + w / 2, y + h / 2, max(1, f - tr["f"])
            tr["vx"] = 0.6 * tr["vx"] + 0.4 * (cx - tr["cx"]) / steps
            tr["vy"] = 0.6 * tr["vy"] + 0.4 * (cy - tr["cy"]) / steps
            tr.update(cx=cx, cy=cy, x=x, y=y, w=w, h=h, f=f, hits=tr["hits"] + 1, hidden=False)
            if not tr["id"] and tr["hits"] >= t.confirm_hits and math.hypot(cx - tr["cx0"], cy - tr["cy0"]) >= t.confirm_move:
                self.number += 1
                tr["id"] = self.number
            areas = tr["areas"]
            areas.append(w * h)
            del areas[:-240]
            # the percentile is no greater than the greatest, which is cheaper to find
            partial = len(areas) >= 10 and w * h < t.partial_area * max(areas) and w * h < t.partial_area * percentile(areas, 0.8)
            if tr["id"]:
                out.append((f, tr["id"], x, y, w, h, "partial" if partial else "seen"))
        for tr in list(self.live):
            if f - tr["f"] >= t.remove_after_s * self.fps:
                self.live.remove(tr)
                if tr["id"]:
                    out.append((f, tr["id"], tr["x"], tr["y"], tr["w"], tr["h"], "removed"))
            elif f - tr["f"] >= t.hide_after and not tr["hidden"]:
                tr["hidden"] = True
                if tr["id"]:
                    out.append((f, tr["id"], tr["x"], tr["y"], tr["w"], tr["h"], "hidden"))
        for j in sorted(free):
            x, y, w, h = found[j]
            self.live.append({"id": 0, "cx": x + w / 2, "cy": y + h / 2, "cx0": x + w / 2, "cy0": y + h / 2, "vx": 0.0, "vy": 0.0, "x": x, "y": y, "w": w, "h": h, "f": f, "hits": 1, "hidden": False, "areas": [w * h]})
        return out


class Wait(Machine):
    """Answers of a slow model within a budget of waiting. Rows (id, ready_s) -> (id, asked_f, f, kept, waited_s).

    A row with an id asks at its frame for an answer that is ready at a time of the wall clock (null: never); a frame
    without requests has a row without an id. The clock is the frame's own time and what has been waited so far. Every
    frame takes the answers that are ready. One asked for more than ``patience`` frames ago is waited for, ``one`` seconds
    at a time and ``total`` seconds a session. What has not come at the end is dropped, at no frame.
    """

    def __init__(self, fps: float = 60.0, patience: int = 30, one: float = 20.0, total: float = 45.0) -> None:
        self.fps, self.patience, self.one, self.left, self.waited = fps, patience, one, total, 0.0
        self.pending: list[tuple] = []

    def push(self, f: int, rows: list[dict]) -> list[tuple]:
        out, keep = [], []
        for key, asked, ready in self.pending:
            clock = f / self.fps + self.waited
            if (ready is None or ready > clock) and f - asked > self.patience and self.left > 0:
                spent = min(self.one, self.left, math.inf if ready is None else ready - clock)
                self.waited, self.left = self.waited + spent, self.left - spent
                clock = f / self.fps + self.waited
            if ready is not None and ready <= clock + 1e-9:
                out.append((key, asked, f, True, round(self.waited, 6)))
            else:
                keep.append((key, asked, ready))
        self.pending = keep + sorted((r["id"], f, r["ready_s"]) for r in rows if r["id"] is not None)
        return out

    def end(self) -> list[tuple]:
        out = [(key, asked, None, False, round(self.waited, 6)) for key, asked, _ in self.pending]
        self.pending = []
        return out


class Grid(Machine):
    """Slots of a capture grid: what is due up to a tick is filled with the newest picture, ``burst`` slots a tick at most.
    Where more than ``backlog`` are due, all but the last are left out, so a slot's number stays its time."""

    def __init__(self, rate: float, backlog: int, burst: int):
        self.rate, self.backlog, self.burst = rate, backlog, burst
        self.began: float | None = None
        self.slot = 0

    def push(self, f: int, rows: list[dict]) -> list[tuple]:
        t = max((r["t"] for r in rows if r["t"] is not None), default=None)
        if t is None:
            return []
        self.began = t if self.began is None else self.began
        missing = math.floor((t - self.began) * self.rate) + 1 - self.slot
        left_out = missing - 1 if missing > self.backlog else 0
        n = min(max(missing - left_out, 0), self.burst)
        first, self.slot = self.slot + left_out, self.slot + left_out + n
        return [(f, first, n, left_out)]


def schema_of(rows: DataFrame, keys: list[str], rest: str) -> str:
    kinds = dict(rows.dtypes)
    return ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), rest])


#: What each machine reads and returns beside its keys.
BREAKS = "kind string, f_start bigint, f_end bigint, conf double"
SCHEDULE = "f bigint, region int, mode string, conf double, warning boolean"
TRACK = "f bigint, track bigint, x double, y double, w double, h double, state string"
CONFIRM = "f bigint, v double, prev double"
GRID = "f bigint, first bigint, n bigint, left_out bigint"
WAIT = "id string, asked_f bigint, f bigint, kept boolean, waited_s double"


def waited(rows: DataFrame, fps: float = 60.0, patience: int = 30, one: float = 20.0, total: float = 45.0) -> DataFrame:
    """rows (session, f, id, ready_s), one or more a frame -> (session, id, asked_f, f, kept, waited_s), as ``Wait`` has it."""
    chosen = rows.select("session", "f", F.col("id").cast("string").alias("id"), F.col("ready_s").cast("double").alias("ready_s"))
    return folded(chosen, ["session"], lambda: Wait(fps, patience, one, total), schema_of(chosen, ["session"], WAIT))


def gridded(ticks: DataFrame, rate: float = 60.0, backlog: int = 12, burst: int = 8) -> DataFrame:
    """ticks (session, f, t in seconds) -> (session, f, first, n, left_out): slots first to first + n - 1 show what is newest at the tick."""
    chosen = ticks.select("session", F.col("f").cast("bigint").alias("f"), F.col("t").cast("double").alias("t"))
    return folded(chosen, ["session"], lambda: Grid(rate, backlog, burst), schema_of(chosen, ["session"], GRID))
