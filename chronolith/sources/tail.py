"""A stream over files that are still being written: ``spark.readStream.format("tail").load(folder)``.

Spark's file source takes a file once and never looks at it again, so a log that grows needs its own source. An offset
is the byte position in every file of the folder up to which lines are complete, and nothing else is kept: what lies
between two offsets is the same bytes whenever it is read, so a restart from a checkpoint neither loses nor repeats a
line, and a half-written last line waits until its end is there. A batch is cut into ranges of about ``chunk`` bytes at
line ends, each read by its own task from the store (any that Arrow's file systems open, by URI or path).

Rows: file (its name), start (byte position of the line), line. Options: ``suffix`` (files to follow, ``.jsonl``) and
``chunk`` (bytes a task, 32 MB). A batch is all that is complete: Spark doesn't tell a source where it stands
before it asks how far it may go, so a cap on bytes can't be kept over a restart. Empty lines are dropped. A file that gets
shorter, or disappears, is an error: its rows can't be taken back.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

BLOCK = 1 << 16


def opened(path: str):
    """(file system, path in it)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def lengths(folder: str, suffix: str) -> dict[str, int]:
    from pyarrow import fs

    system, path = opened(folder)
    found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return {f.base_name: f.size for f in found if f.is_file and f.base_name.endswith(suffix)}


def line_end(file, low: int, high: int) -> int:
    """The position after the last line end in [low, high), read from the back; low where there is none."""
    at = high
    while at > low:
        begin = max(low, at - BLOCK)
        file.seek(begin)
        found = file.read(at - begin).rfind(b"\n")
        if found >= 0:
            return begin + found + 1
        at = begin
    return low


class Range(InputPartition):
    def __init__(self, name: str, start: int, end: int) -> None:
        self.name, self.start, self.end = name, start, end


class TailReader(DataSourceStreamReader):
    def __init__(self, folder: str, suffix: str, chunk: int) -> None:
        self.folder, self.suffix, self.chunk = folder.rstrip("/"), suffix, chunk
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        system, path = opened(self.folder)
        sizes, ends = lengths(self.folder, self.suffix), {}
        for name in sorted({*sizes, *self.known}):
            was, size = self.known.get(name, 0), sizes.get(name, -1)
            if size < was:
                raise ValueError(f"{name} has {size} bytes where {was} were read")
            ends[name] = was
            if size > was:
                with system.open_input_file(f"{path}/{name}") as file:
                    ends[name] = line_end(file, was, size)
        self.known = ends
        return ends

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        system, path = opened(self.folder)
        if gone := [name for name, a in start.items() if end.get(name, 0) < a]:  # seen so only after a restart
            raise ValueError(f"{', '.join(gone)}: less is there than was read")
        out: list[InputPartition] = []
        for name, stop in sorted(end.items()):
            a = start.get(name, 0)
            if a >= stop:
                continue
            with system.open_input_file(f"{path}/{name}") as file:
                while a < stop:
                    size, b = self.chunk, a
                    while b == a:  # a line longer than a chunk makes its range longer
                        b = stop if stop - a <= size else line_end(file, a, a + size)
                        size *= 2
                    out.append(Range(name, a, b))
                    a = b
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        system, path = opened(self.folder)
        with system.open_input_file(f"{path}/{partition.name}") as file:
            at, held = partition.start, b""
            file.seek(at)
            left = partition.end - partition.start
            while left:
                data = file.read(min(left, 1 << 20))
                if not data:
                    raise ValueError(f"{partition.name} ends before byte {partition.end}")
                left -= len(data)
                *lines, held = (held + data).split(b"\n")
                for line in lines:
                    if line.strip():
                        yield partition.name, at, line.decode("utf-8", "replace")
                    at += len(line) + 1

    def commit(self, end: dict) -> None:
        pass


class Tail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "file string, start bigint, line string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        o = self.options
        return TailReader(o["path"], o.get("suffix", ".jsonl"), int(o.get("chunk", 1 << 25)))


def lines(spark: SparkSession, folder: str, **options: object) -> DataFrame:
    """A stream of the folder's lines."""
    spark.dataSource.register(Tail)
    return spark.readStream.format("tail").options(**options).load(folder)


def finished(spark: SparkSession, folder: str, marker: str) -> bool:
    from chronolith.sources.session import exists

    return exists(spark, f"{folder}/{marker}")


def follow(query, folder: str, marker: str = "done", suffix: str = ".jsonl", every: float = 2.0, most: float | None = None) -> bool:
    """Wait until the writer is done and the query has read all: the marker is there, and two polls in a row find the files as
    long as before. Then stop the query. False if ``most`` seconds pass first; the query runs on then."""
    began, before, alike = time.monotonic(), None, 0
    while most is None or time.monotonic() - began < most:
        if (error := query.exception()) is not None:
            raise error
        now = lengths(folder, suffix)
        alike = alike + 1 if now == before and finished(SparkSession.active(), folder, marker) else 0
        before = now
        if alike >= 2:
            query.processAllAvailable()
            query.stop()
            return True
        time.sleep(every)
    return False


def positions(checkpoint: str) -> dict[str, int]:
    """Byte positions of the last batch that was planned, from a query's checkpoint; none before the first."""
    from pyarrow import fs

    system, path = opened(checkpoint)
    logs = [f for f in system.get_file_info(fs.FileSelector(f"{path}/offsets", allow_not_found=True)) if f.base_name.isdigit()]
    if not logs:
        return {}
    last = max(logs, key=lambda f: int(f.base_name))
    with system.open_input_stream(last.path) as file:
        return json.loads(file.read().decode().splitlines()[-1])
