"""Frames for tests, from a data source."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class SyntheticFrames(DataSource):
    """Deterministic frames for tests and demos: ``spark.read.format("synthetic_frames").option("frames", n)``.

    Row f has 48 region values, quiet but for spikes at frames divisible by ``every``.
    """

    @classmethod
    def name(cls) -> str:
        return "synthetic_frames"

    def schema(self) -> str:
        return "session string, f bigint, t_ms double, regions array<double>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(int(self.options.get("frames", "600")), float(self.options.get("fps", "60")), int(self.options.get("every", "97")), int(self.options.get("chunk", "300")))


class _Reader(DataSourceReader):
    def __init__(self, frames: int, fps: float, every: int, chunk: int):
        self.frames, self.fps, self.every, self.chunk = frames, fps, every, chunk

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(a) for a in range(0, self.frames, self.chunk)]

    def read(self, partition: InputPartition):
        for f in range(partition.value, min(self.frames, partition.value + self.chunk)):
            base = 90.0 if f and f % self.every == 0 else 1.0
            yield ("synthetic", f, round(f * 1000 / self.fps, 2), [base + (r % 8) * 0.01 for r in range(48)])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SyntheticFrames)
