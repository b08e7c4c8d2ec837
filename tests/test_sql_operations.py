"""The operations called from SQL give what the API gives, and read what they need."""

import re

import pytest

from chronolith import api
from chronolith.functions import tables
from tests.test_session import clip, folder  # noqa: F401


@pytest.fixture(scope="module")
def stored(spark, folder, tmp_path_factory):  # noqa: F811
    s = api.ingest(spark, folder, str(tmp_path_factory.mktemp("tables") / "clip"))
    tables.register_sessions(spark, s)
    return s


def test_states_from_sql(spark, stored):
    for f in (-3, 0, 2, 5, 6, 99):
        got = {tuple(r["path"]): r["v"] for r in spark.sql(f"SELECT * FROM get_state('clip', {f})").collect()}
        assert got == {tuple(r["path"]): r["v"] for r in api.get_state(stored, f).collect()}, f
    assert spark.sql("SELECT v FROM get_state('clip', 4) WHERE path = array('hud', 'health', 'v')").first()["v"] == "93"
    assert spark.sql("SELECT * FROM get_state('other', 4)").count() == 0


def test_filters_reach_the_scan(spark, stored):
    plan = spark.sql("SELECT v FROM get_state('clip', 4)")._jdf.queryExecution().executedPlan().toString()
    ops = next(x for x in re.findall(r"FileScan parquet.*", plan) if "op#" in x)
    # frame 4, of snapshot 0; no snapshot is longer than six frames
    assert re.search(r"PushedFilters: \[.*LessThanOrEqual\(snap_f,4\).*GreaterThanOrEqual\(snap_f,-1\)", ops), ops
    assert "Python" not in plan


def test_other_operations_from_sql(spark, stored):
    rows = lambda q: sorted(map(tuple, spark.sql(q).collect()), key=str)
    assert [r[:2] for r in sorted(rows("SELECT * FROM get_changes('clip', 1, 6)"))] == [(2, "delta"), (5, "delta"), (6, "snapshot")]
    assert {r[2] for r in rows("SELECT * FROM get_events('clip', 3, 6)")} == {"ev2"} and {r[2] for r in rows("SELECT * FROM get_events('clip', 0, 99, 'ui_value_changed,flash')")} == {"ev1", "ev10"}
    want = api.get_entity_history(stored, "e1").filter("kind <> 'span'").select("kind", "attr", "f", "v", "conf", "source", "event")
    assert rows("SELECT * FROM get_entity_history('clip', 'e1')") == sorted(map(tuple, want.collect()), key=str)
    for words in ("health", "scene e1", "clip", "nothing"):
        want = sorted((r["score"], r["kind"], r["item"], r["f"]) for r in api.search_semantics(stored, words, 500).collect() if r["kind"] != "summary")
        got = spark.sql(f"SELECT * FROM search_semantics('clip', '{words}')").collect()
        assert sorted((r["score"], r["kind"], r["item"], r["f"]) for r in got if r["kind"] != "summary") == want
        assert sum(r["kind"] == "summary" for r in got) == (words in ("health", "scene e1"))  # the member is named in every window, the session in none
    assert rows("SELECT f, crop FROM get_evidence('clip', 'ev2')") == [(5, "evidence/f5.jpg")]
    assert rows("SELECT claim, f FROM get_evidence('clip', 'hud/health@4')") == [("hud/health=93", 2)] and rows("SELECT * FROM get_evidence('clip', 'hud/none@4')") == []
