"""The source that follows growing files, across appends in the middle of a line, restarts and the end of writing."""

import threading
import time

import pytest

from chronolith.sources import tail
from chronolith.streaming import feeds


def append(path, text):
    with open(path, "ab") as f:
        f.write(text.encode())


def rows(spark, path):
    return sorted((r["file"], r["start"], r["line"]) for r in spark.read.parquet(str(path)).collect())


def test_no_line_is_lost_or_repeated_over_restarts(spark, tmp_path):
    src, log = tmp_path / "in", tmp_path / "in" / "a.jsonl"
    src.mkdir()

    def run(**options):
        query = feeds.to_tables(tail.lines(spark, str(src), **options), str(tmp_path / "out"), str(tmp_path / "cp"))
        assert query.awaitTermination(120) and query.exception() is None

    append(log, '{"f": 0}\n{"f": 1}\n{"f"')  # the writer is in the middle of a line
    run()
    assert [r[2] for r in rows(spark, tmp_path / "out")] == ['{"f": 0}', '{"f": 1}'] and tail.positions(str(tmp_path / "cp")) == {"a.jsonl": 18}
    append(log, ': 2}')
    run()
    assert len(rows(spark, tmp_path / "out")) == 2  # still no line end
    append(log, '\n\n{"f": 3, "s": "é"}\n')
    append(src / "b.jsonl", "x\ny\n")
    append(src / "c.log", "not followed\n")
    run(chunk=4)  # ranges shorter than a line
    whole = log.read_bytes()
    got = rows(spark, tmp_path / "out")
    assert [r[2] for r in got] == ['{"f": 0}', '{"f": 1}', '{"f": 2}', '{"f": 3, "s": "é"}', "x", "y"]
    assert all(whole[s:].startswith(line.encode()) for f, s, line in got if f == "a.jsonl")
    for i in range(500):
        append(log, f'{{"f": {i + 4}}}\n')
    run(chunk=100)  # many tasks
    assert [r[2] for r in rows(spark, tmp_path / "out") if r[0] == "a.jsonl"] == [x for x in log.read_text().splitlines() if x]


def test_a_file_that_shrinks_is_an_error(tmp_path):
    (tmp_path / "a.jsonl").write_text("one\ntwo\n")
    reader = tail.TailReader(str(tmp_path), ".jsonl", 1 << 20)
    assert reader.latestOffset() == {"a.jsonl": 8}
    (tmp_path / "a.jsonl").write_text("one\n")
    with pytest.raises(ValueError, match="a.jsonl"):
        reader.latestOffset()
    again = tail.TailReader(str(tmp_path), ".jsonl", 1 << 20)
    with pytest.raises(ValueError, match="a.jsonl"):
        again.partitions({"a.jsonl": 8}, again.latestOffset())


def test_the_end_is_seen_by_marker_and_two_quiet_polls(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    log = src / "a.jsonl"

    def write():
        for i in range(6):
            append(log, f'{{"f": {i}}}\n')
            time.sleep(0.3)
        (src / "done").write_text("")
        append(log, '{"f": "last"}\n')  # after the marker, but before two quiet polls

    writer = threading.Thread(target=write)
    writer.start()
    query = tail.lines(spark, str(src)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="300 milliseconds").start()
    assert tail.follow(query, str(src), every=0.4, most=90)
    writer.join()
    assert not query.isActive and [r[2] for r in rows(spark, tmp_path / "out")] == log.read_text().splitlines()
