"""The annotation sink: rows are there once, whatever fails between the write and the commit."""

import json

import pytest

from chronolith.sources import annotations
from chronolith.streaming import feeds


def put(folder, name, frames):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps({"session": f"s{f % 2}", "f": f, "kind": "note", "body": f"b{f}"}) for f in frames) + "\n")


def run(spark, tmp_path):
    query = annotations.write(feeds.growing_files(spark, str(tmp_path / "in"), annotations.SCHEMA), str(tmp_path / "out"), str(tmp_path / "cp"))
    try:
        query.awaitTermination(120)
    except Exception:
        return query, False
    return query, query.exception() is None


def frames(spark, tmp_path):
    return sorted(r["f"] for r in annotations.read(spark, str(tmp_path / "out")).collect())


def test_rows_are_there_once_after_failures(spark, tmp_path):
    out = str(tmp_path / "out")
    assert annotations.read(spark, out).count() == 0
    put(tmp_path / "in", "a.json", range(20))
    # runs are written, but the folder of manifests can't be made: the step between write and commit fails
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "manifests").write_text("in the way")
    assert not run(spark, tmp_path)[1]
    (tmp_path / "out" / "manifests").unlink()
    assert frames(spark, tmp_path) == []  # runs that nothing names
    assert run(spark, tmp_path)[1] and frames(spark, tmp_path) == list(range(20))
    # the commit is done but the query's own log does not know: the epoch is run again
    put(tmp_path / "in", "b.json", range(20, 30))
    assert run(spark, tmp_path)[1]
    last = max((tmp_path / "cp" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    for crc in (tmp_path / "cp" / "commits").glob(f".{last.name}.crc"):
        crc.unlink()
    assert run(spark, tmp_path)[1] and frames(spark, tmp_path) == list(range(30))
    assert len(annotations.manifests(out)) == 2


def test_compaction_keeps_rows_and_epochs_apart(spark, tmp_path):
    out = str(tmp_path / "out")
    for i in range(3):
        put(tmp_path / "in", f"{i}.json", range(10 * i, 10 * i + 10))
        assert run(spark, tmp_path)[1]
    before = [n for m in annotations.manifests(out).values() for n in m["runs"]]
    assert annotations.compact(spark, out) == len(before) >= 3
    after = [n for m in annotations.manifests(out).values() for n in m["runs"]]
    assert len(after) == 1 and frames(spark, tmp_path) == list(range(30))
    rows = [(r["session"], r["f"]) for r in spark.read.parquet(f"{out}/runs/{after[0]}").collect()]
    assert rows == sorted(rows)
    assert not annotations.publish(out, "epoch-000000000001", {"runs": before[:1], "rows": 10, "upto": 1})  # an epoch that was merged does not come back
    put(tmp_path / "in", "9.json", range(30, 35))
    assert run(spark, tmp_path)[1] and frames(spark, tmp_path) == list(range(35))
    assert annotations.sweep(out) == len(before) and frames(spark, tmp_path) == list(range(35)) and annotations.compact(spark, out) == 2


def test_an_aborted_batch_leaves_no_runs(tmp_path):
    from pyspark.sql import Row

    writer = annotations.AnnotationWriter(str(tmp_path))
    made = writer.write(iter([Row(session="s", f=2, kind="k", body="b"), Row(session=None, f=None, kind="k", body=None)]))
    assert made.rows == 2 and len(list((tmp_path / "runs").iterdir())) == 1
    writer.abort([made, None], 0)
    assert not list((tmp_path / "runs").iterdir())
    with pytest.raises(OSError):
        (tmp_path / "manifests").write_text("x")
        writer.commit([made], 0)
