"""A sink for annotations that commits by epoch: ``stream.writeStream.format("annotations").option("path", folder)``.

Tasks write their rows as sorted runs under names that no other attempt has; a run counts only once the manifest of its
epoch names it, which the driver writes in one step when all tasks are done. An epoch that is run again, after a failure
before or after that step, finds its manifest or leaves runs that nothing names: rows are there once or not at all.
``read`` shows what the manifests name. ``compact`` merges all runs of finished epochs into few, sorted by session and
frame, and replaces their manifests by one, in one step too. The folder may be in any store that Arrow's file systems
open and that can replace a file by renaming (or writing) it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage

from chronolith.sources.tail import opened

SCHEMA = "session string, f bigint, kind string, body string"
#: Rows that a task holds before it sorts them and writes a run.
RUN_ROWS = 200_000


@dataclass
class Runs(WriterCommitMessage):
    names: list[str]
    rows: int


class AnnotationWriter(DataSourceStreamWriter):
    def __init__(self, folder: str) -> None:
        self.folder = folder.rstrip("/")

    def write(self, iterator: Iterator) -> Runs:
        import pyarrow as pa
        import pyarrow.parquet as pq

        system, path = opened(self.folder)
        system.create_dir(f"{path}/runs", recursive=True)
        names, held, total = [], [], 0

        def close() -> None:
            held.sort(key=lambda r: (r["session"] or "", -1 if r["f"] is None else r["f"]))
            name = f"{uuid.uuid4().hex}.parquet"
            table = pa.table({c: pa.array([r[c] for r in held], t) for c, t in (("session", pa.string()), ("f", pa.int64()), ("kind", pa.string()), ("body", pa.string()))})
            with system.open_output_stream(f"{path}/runs/{name}") as out:
                pq.write_table(table, out)
            names.append(name)
            held.clear()

        for row in iterator:
            held.append(row.asDict())
            total += 1
            if len(held) == RUN_ROWS:
                close()
        if held:
            close()
        return Runs(names, total)

    def commit(self, messages: list[Runs | None], batchId: int) -> None:
        found = [m for m in messages if m is not None]
        publish(self.folder, f"epoch-{batchId:012d}", {"runs": sorted(n for m in found for n in m.names), "rows": sum(m.rows for m in found), "upto": batchId})

    def abort(self, messages: list[Runs | None], batchId: int) -> None:
        system, path = opened(self.folder)
        for m in messages:
            for name in m.names if m is not None else ():
                system.delete_file(f"{path}/runs/{name}")


class Annotations(DataSource):
    @classmethod
    def name(cls) -> str:
        return "annotations"

    def schema(self) -> str:
        return SCHEMA

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        return AnnotationWriter(self.options["path"])


def publish(folder: str, name: str, body: dict) -> bool:
    """Put a manifest where readers look for it, whole or not at all. False where its epoch is there already."""
    system, path = opened(folder)
    system.create_dir(f"{path}/manifests", recursive=True)
    if name in manifests(folder) or any(m.get("compacted") and m["upto"] >= body["upto"] for m in manifests(folder).values()) and not body.get("compacted"):
        return False
    part = f"{path}/manifests/.{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        out.write(json.dumps(body).encode())
    system.move(part, f"{path}/manifests/{name}.json")
    return True


def manifests(folder: str) -> dict[str, dict]:
    """Manifests in force, by name: the last compaction and the epochs after it."""
    from pyarrow import fs

    system, path = opened(folder)
    found = {}
    for info in system.get_file_info(fs.FileSelector(f"{path}/manifests", allow_not_found=True)):
        if info.base_name.endswith(".json"):
            with system.open_input_stream(info.path) as file:
                found[info.base_name.removesuffix(".json")] = json.loads(file.read())
    upto = max((m["upto"] for m in found.values() if m.get("compacted")), default=-1)
    return {k: m for k, m in found.items() if (m["upto"] == upto if m.get("compacted") else m["upto"] > upto)}


def write(stream: DataFrame, folder: str, checkpoint: str, at_once: bool = True):
    """Start a query that appends annotations (session, f, kind, body)."""
    stream.sparkSession.dataSource.register(Annotations)
    writer = stream.select("session", F.col("f").cast("bigint").alias("f"), "kind", "body").writeStream.format("annotations").option("path", folder).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if at_once else writer).start()


def read(spark: SparkSession, folder: str) -> DataFrame:
    """All annotations of committed epochs."""
    runs = [f"{folder.rstrip('/')}/runs/{n}" for m in manifests(folder).values() for n in m["runs"]]
    return spark.read.schema(SCHEMA).parquet(*runs) if runs else spark.createDataFrame([], SCHEMA)


def compact(spark: SparkSession, folder: str, files: int = 1) -> int:
    """Merge the runs of all committed epochs into ``files`` sorted ones; returns how many runs were merged. Readers see the old
    manifests or the new one. Runs that nothing names any more stay until ``sweep``, since readers may be at them."""
    system, path = opened(folder)
    now = manifests(folder)
    runs = [n for m in now.values() for n in m["runs"]]
    if len(runs) <= files:
        return 0
    upto, made = max(m["upto"] for m in now.values()), f"merge-{uuid.uuid4().hex}"
    rows = read(spark, folder).repartitionByRange(files, "session", "f").sortWithinPartitions("session", "f")
    rows.write.parquet(f"{folder.rstrip('/')}/runs/{made}")
    from pyarrow import fs

    names = [f"{made}/{i.base_name}" for i in system.get_file_info(fs.FileSelector(f"{path}/runs/{made}")) if i.base_name.endswith(".parquet")]
    publish(folder, f"compacted-{upto:012d}-{made[-8:]}", {"runs": sorted(names), "rows": sum(m["rows"] for m in now.values()), "upto": upto, "compacted": True})
    return len(runs)


def sweep(folder: str) -> int:
    """Delete runs that no manifest in force names, when nothing writes or reads; returns how many."""
    from pyarrow import fs

    system, path = opened(folder)
    named = {n for m in manifests(folder).values() for n in m["runs"]}
    found = [i for i in system.get_file_info(fs.FileSelector(f"{path}/runs", recursive=True, allow_not_found=True)) if i.is_file and i.base_name.endswith(".parquet")]
    gone = [i.path for i in found if i.path.rpartition("/runs/")[2] not in named]
    for p in gone:
        system.delete_file(p)
    return len(gone)
