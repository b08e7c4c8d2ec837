"""Rules with state over micro-batches, by ``transformWithState``.

``machine_stream`` runs the machines of ``operators.machines`` on a stream: between batches a machine lies in a value
state, and the rows of the last frame, which the next batch may add to, in a list state. ``reordered`` is the buffer that
puts frames in order and writes late observations back into those it still holds. Both need the RocksDB state store
(``use_state_store``). Ends come as rows (of frame null, or of kind ``end``), or by a timer: what is held leaves when
nothing has come for ``idle`` seconds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from chronolith.operators import machines

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """The state store that timers and several states a key need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def time_mode(idle: float) -> str:
    """With timers a query never runs out of batches, so ``trigger(availableNow=True)`` would not end: only where they are used."""
    return "ProcessingTime" if idle > 0 else "None"


class _Idle:
    """A processing-time timer that is put off by every batch with rows."""

    handle: StatefulProcessorHandle
    idle: float

    def put_off(self, now: int) -> None:
        if self.idle <= 0:
            return
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(now + int(self.idle * 1000))


class MachineProcessor(StatefulProcessor, _Idle):
    """Feeds a machine frame by frame. A row at or before the last frame fed is late: it is counted, and told with the key."""

    def __init__(self, keys: list[str], columns: list[str], types: StructType, machine: Callable[[], machines.Machine], names: list[str], idle: float) -> None:
        self.keys, self.columns, self.types, self.machine, self.names, self.idle = keys, columns, types, machine, names, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("machine", "machine binary, fed bigint, late bigint")
        self.rows = handle.getListState("rows", self.types)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        data, fed, late = self.kept.get() if self.kept.exists() else (None, None, 0)
        at = machines.taken_up(bytes(data)) if data is not None else self.machine()
        by_frame: dict[int, list[dict]] = {}
        ended, was_late = False, 0
        for r in [*self.rows.get(), *rows]:
            row = dict(zip(self.columns, r, strict=True))
            f = row["f"]
            if f is None:
                ended = True
            elif fed is not None and f <= fed:
                was_late += 1
            else:
                by_frame.setdefault(f, []).append(row)
        frames, held = sorted(by_frame), []
        if frames and not ended:
            held = by_frame[frames.pop()]  # may not be whole yet
        for f in frames:
            fed = f
            yield from self.told(key, at.push(f, by_frame[f]), 0)
        if was_late:
            yield from self.told(key, [], was_late)
        if ended:
            yield from self.told(key, at.end(), 0)
        self.rows.clear()
        if held:
            self.rows.put([tuple(r[c] for c in self.columns) for r in held])
        self.kept.update((at.laid_down(), fed, late + was_late))
        self.put_off(timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.kept.exists():
            return
        data, fed, late = self.kept.get()
        at = machines.taken_up(bytes(data))
        held = [dict(zip(self.columns, r, strict=True)) for r in self.rows.get()]
        if held:
            fed = held[0]["f"]
            yield from self.told(key, at.push(fed, held), 0)
        yield from self.told(key, at.end(), 0)
        self.rows.clear()
        self.kept.update((at.laid_down(), fed, late))

    def told(self, key: tuple, found: list[tuple], late: int) -> Iterator[Row]:
        make = Row(*self.names)
        for x in found:
            yield make(*key, *x, 0)
        if late:
            yield make(*key, *[None] * (len(self.names) - len(key) - 1), late)

    def close(self) -> None:
        pass


def machine_stream(rows: DataFrame, keys: list[str], machine: Callable[[], machines.Machine], rest: str, idle: float = 0.0) -> DataFrame:
    """A stream of rows (keys, f, ...) through a machine for every key: the machine's rows and ``late``, which is 0 but for
    rows that only say how many came too late. A frame is fed when a later one has come; rows of frame null end a key."""
    use_state_store(rows.sparkSession)
    schema = machines.schema_of(rows, keys, f"{rest}, late bigint")
    names = [c.strip().split()[0].strip("`") for c in schema.split(", ")]
    processor = MachineProcessor(keys, rows.columns, rows.schema, machine, names, idle)
    return rows.groupBy(*keys).transformWithState(processor, schema, "append", time_mode(idle))


FEED = "session string, kind string, f bigint, path string, v string"
RELEASED = "session string, f bigint, kind string, path string, v string, n bigint"


class ReorderProcessor(StatefulProcessor, _Idle):
    """Map states: frames held, by number; observations, by path and frame; requests that are not answered yet."""

    def __init__(self, behind: int, most: int, idle: float) -> None:
        self.behind, self.most, self.idle = behind, most, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.frames = handle.getMapState("frames", "f bigint", "there boolean")
        self.seen = handle.getMapState("seen", "path string, f bigint", "v string")
        self.asked = handle.getMapState("asked", "path string, f bigint", "there boolean")
        self.front = handle.getValueState("front", "f bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        yield from self.step(key[0], list(rows), False)
        self.put_off(timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self.step(key[0], [], True)

    def step(self, session: str, rows: list[Row], ended: bool) -> Iterator[Row]:
        front = self.front.get()[0] if self.front.exists() else -1
        held = {k[0] for k in self.frames.keys()}
        seen = {tuple(k): v[0] for k, v in self.seen.iterator()}
        asked = {tuple(k) for k in self.asked.keys()}
        before = set(held), dict(seen), set(asked)
        buffer = Buffer(front, held, seen, asked, self.behind, self.most)
        make = Row("session", "f", "kind", "path", "v", "n")
        for r in rows:
            if r["kind"] == "end":
                ended = True
            else:
                for x in buffer.take(r["kind"], r["f"], r["path"], r["v"]):
                    yield make(session, *x)
        for x in buffer.release(ended):
            yield make(session, *x)
        for f in before[0] - held:
            self.frames.removeKey((f,))
        for f in held - before[0]:
            self.frames.updateValue((f,), (True,))
        for k in before[1].keys() - seen.keys():
            self.seen.removeKey(k)
        for k, v in seen.items():
            if k not in before[1] or before[1][k] != v:
                self.seen.updateValue(k, (v,))
        for k in before[2] - asked:
            self.asked.removeKey(k)
        for k in asked - before[2]:
            self.asked.updateValue(k, (True,))
        self.front.update((buffer.front,))

    def close(self) -> None:
        pass


class Buffer:
    """Frames in order of number, each with what is known of every path then: the last observation at or before it.

    A frame leaves once more than ``behind`` are held and no request that may still change it is open, or at ``most``
    held. An observation writes itself into all held frames from its own on; of two of one path and frame the last to
    come counts. One from before the front changes what is held and what follows, but not what has left: it is told as
    ``late_seen``. A frame from before the front is told as ``late_frame`` and does not leave again.
    """

    def __init__(self, front: int, held: set[int], seen: dict, asked: set, behind: int = 3, most: int = 900) -> None:
        self.front, self.held, self.seen, self.asked, self.behind, self.most = front, held, seen, asked, behind, most

    def take(self, kind: str, f: int, path: str | None, v: str | None) -> Iterator[tuple]:
        if kind == "frame":
            if f <= self.front or f in self.held:
                yield f, "late_frame", None, None, 1
            else:
                self.held.add(f)
        elif kind == "asked":
            self.asked.add((path, f))
        elif kind == "seen":
            self.asked.discard((path, f))
            if f <= self.front:
                yield f, "late_seen", path, v, 1
            # of the observations at or before the front only the last of each path can still matter
            older = [k for k in self.seen if k[0] == path and k[1] <= self.front]
            if f > self.front or all(k[1] <= f for k in older):
                self.seen[(path, f)] = v

    def release(self, ended: bool) -> Iterator[tuple]:
        order = sorted(self.held)
        changes = sorted((f, path) for path, f in self.seen)
        now: dict[str, str] = {}
        i = at = 0
        oldest = min((f for _, f in self.asked), default=None)
        while i < len(order):
            f, left = order[i], len(order) - i
            waits = oldest is not None and f >= oldest - self.behind
            if not ended and left < self.most and (left <= self.behind or waits):
                break
            while at < len(changes) and changes[at][0] <= f:
                now[changes[at][1]] = self.seen[(changes[at][1], changes[at][0])]
                at += 1
            yield f, "frame", None, None, len(now)
            for path, v in sorted(now.items()):
                yield f, "value", path, v, None
            self.held.discard(f)
            self.front = max(self.front, f)
            i += 1
        # observations that a later one of their path replaces before anything held can see them
        last: dict[str, int] = {}
        for f, path in changes:
            if f <= self.front:
                if path in last:
                    self.seen.pop((path, last[path]), None)
                last[path] = f


def reordered(feed: DataFrame, behind: int = 3, most: int = 900, idle: float = 0.0) -> DataFrame:
    """A feed (session, kind, f, path, v) of frames, requests (``asked``) and observations (``seen``), in any order -> what leaves, in order of frame.

    Rows (session, f, kind, path, v, n): ``frame`` with the number of its values and a row ``value`` for each, then
    ``late_frame`` and ``late_seen`` for what came too late. ``end`` rows let all go.
    """
    use_state_store(feed.sparkSession)
    chosen = feed.select("session", "kind", "f", "path", "v")
    return chosen.groupBy("session").transformWithState(ReorderProcessor(behind, most, idle), RELEASED, "append", time_mode(idle))


def as_batch(feed: DataFrame) -> DataFrame:
    """What ``reordered`` gives if nothing comes too late, from a table: an as-of join of frames with observations."""
    frames = feed.filter("kind = 'frame'").select("session", "f").distinct()
    seen = feed.filter("kind = 'seen'").groupBy("session", "path", "f").agg(F.max("v").alias("v"))
    marks = frames.join(seen.select("session", "path").distinct(), "session").select("session", "path", "f", F.lit(None).cast("string").alias("v"), F.lit(1).alias("asks"))
    w = Window.partitionBy("session", "path").orderBy("f", "asks").rowsBetween(Window.unboundedPreceding, 0)
    both = marks.unionByName(seen.withColumn("asks", F.lit(0)))
    values = both.withColumn("v", F.last("v", True).over(w)).filter("asks = 1 AND v IS NOT NULL").select("session", "f", F.lit("value").alias("kind"), "path", "v", F.lit(None).cast("bigint").alias("n"))
    counts = values.groupBy("session", "f").agg(F.count(F.lit(1)).alias("n"))
    head = frames.join(counts, ["session", "f"], "left").select("session", "f", F.lit("frame").alias("kind"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("v"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
    return head.unionByName(values)
