import json
import random

import pytest
from pyspark.sql import functions as F

from chronolith.operators import state
from tests.conftest import DATA


def merge(target, patch):
    """RFC 7386."""
    if not isinstance(patch, dict):
        return patch
    out = dict(target) if isinstance(target, dict) else {}
    for k, v in patch.items():
        if v is None:
            out.pop(k, None)
        else:
            out[k] = merge(out.get(k), v)
    return out


def leaves(x, path=()):
    if isinstance(x, dict):
        for k, v in x.items():
            yield from leaves(v, (*path, k))
    else:
        yield path, json.dumps(x)


def folded(spark, patches: dict[str, list]):
    rows = [(s, 0, f, json.dumps(p)) for s, ps in patches.items() for f, p in enumerate(ps)]
    frame = spark.createDataFrame(rows, "session string, snap_f bigint, f bigint, json string")
    got: dict = {s: {} for s in patches}
    for r in state.fold(state.patch_ops(frame, F.col("json"))).collect():
        got[r["session"]][tuple(r["path"])] = r["v"]
    return got


CASES = {
    "replace": [{"a": "b"}, {"a": "c"}],
    "add": [{"a": "b"}, {"b": "c"}],
    "remove": [{"a": "b", "b": "c"}, {"a": None}],
    "nested_remove": [{"a": {"b": "c"}}, {"a": {"b": "d", "c": None}}],
    "object_to_scalar": [{"a": {"b": 1}}, {"a": 2}],
    "scalar_to_object": [{"a": 1}, {"a": {"b": 2}}],
    "delete_then_add": [{"a": {"b": 1, "c": 2}}, {"a": None}, {"a": {"c": 3}}],
    "null_into_missing": [{"x": 1}, {"a": {"bb": {"ccc": None}, "d": 1}}],
    "deep": [{"a": {"b": {"c": {"d": 1}}}}, {"a": {"b": {"c": {"d": None, "e": 2}}}}],
}


def test_merge_patch_cases(spark):
    want = {}
    for name, ps in CASES.items():
        s = {}
        for p in ps:
            s = merge(s, p)
        want[name] = dict(leaves(s))
    assert folded(spark, CASES) == want


def test_random_patches_fold_as_rfc7386(spark):
    rnd = random.Random(7)

    def patch(depth=0):
        return {rnd.choice("abc"): None if rnd.random() < 0.25 else patch(depth + 1) if depth < 3 and rnd.random() < 0.5 else rnd.randint(0, 3) for _ in range(rnd.randint(1, 2))}

    patches = {f"s{i}": [patch() for _ in range(rnd.randint(1, 7))] for i in range(150)}
    want = {}
    for name, ps in patches.items():
        s = {}
        for p in ps:
            s = merge(s, p)
        want[name] = {k: v for k, v in leaves(s)}
    assert folded(spark, patches) == want


@pytest.mark.parametrize("n", [0, 9, 10, 11, 33, 500])
def test_reconstruction_equals_dense_state(spark, n):
    from chronolith.plans.catalogue import sv

    rows = sv(spark, DATA)
    got = {(r["session"], r["path"][0]): r["v"] for r in state.reconstruct(state.encode(rows, 10), n).collect()}
    want = {(r["session"], r["path"]): r["v"] for r in state.state_at(rows, n).collect()}
    assert got == want and want


def test_gaps_and_repeats(spark):
    from chronolith.operators import stream

    rows = spark.createDataFrame([("s", f, "p", float(f), i) for i, f in enumerate([0, 1, 2, 5, 6, 6])], "session string, f bigint, path string, v double, at bigint")
    one = stream.last_wins(rows, F.col("at"))
    assert one.count() == 5
    assert stream.clamp_frame(one, 4).first()["f"] == 2 and stream.clamp_frame(one, -3).first()["f"] == 0 and stream.clamp_frame(one, 99).first()["f"] == 6
    empty = rows.filter("f < 0")
    assert state.state_at(empty, 3).count() == 0 and state.encode(empty).count() == 0


def test_patches_of_any_depth(spark):
    """Up to twelve levels, with brackets and quotes in names and values: as RFC 7386 folds them."""
    rnd = random.Random(12)

    def patch(depth=1):
        if depth >= rnd.choice((2, 7, 12)):
            return rnd.choice([None, 1, '{"[', "x\\", [{"deep": [1]}]])
        return {rnd.choice(("a", "b", 'q"{')): patch(depth + 1) for _ in range(rnd.randint(1, 2))}

    patches = {f"s{i}": [patch() for _ in range(rnd.randint(1, 6))] for i in range(120)}
    patches = {k: [p for p in v if isinstance(p, dict)] or [{}] for k, v in patches.items()}
    want = {}
    for name, ps in patches.items():
        s = {}
        for p in ps:
            s = merge(s, p)
        want[name] = dict(leaves(s))
    got = folded(spark, patches)
    assert {k: {p: json.loads(v) for p, v in x.items()} for k, x in got.items()} == {k: {p: json.loads(v) for p, v in x.items()} for k, x in want.items()}
    assert max(len(p) for x in want.values() for p in x) > 6


def dense_with_gaps(spark):
    """Paths that come, go and come back."""
    rnd = random.Random(3)
    rows = [(s, f, p, float(rnd.randint(0, 2))) for s in ("s", "t") for f in range(0, 64, 1 if s == "s" else 3) for p in "abc" if (f // 7 + ord(p)) % 3]
    return rows, spark.createDataFrame(rows, "session string, f bigint, path string, v double")


def test_paths_that_vanish(spark):
    rows, df = dense_with_gaps(spark)
    ops = state.encode_dense(df, 10).cache()
    assert ops.filter("op = 'del'").count() > 0
    frames = [0, 3, 9, 10, 21, 33, 48, 63]
    got = {(r["session"], r["n"], r["path"][0]): r["v"] for r in state.reconstruct_at(ops, frames).collect()}
    last = {(s, n): max(f for x, f, *_ in rows if x == s and f <= n) for s in ("s", "t") for n in frames}
    assert got == {(s, n, p): v for n in frames for s, f, p, v in rows if last[s, n] == f}


def test_states_written_as_patches_fold_back(spark):
    rnd = random.Random(5)
    field = lambda v, crop: {"v": v, "conf": 0.9, "source": "observed", "crop": crop}
    states = [{"hud": {k: field(rnd.randint(0, 2), rnd.choice([None, "c.jpg"])) for k in rnd.sample("abcd", rnd.randint(1, 4))}, "id": rnd.randint(0, 1)} for _ in range(40)]
    df = spark.createDataFrame([("s", f, json.dumps(x)) for f, x in enumerate(states)], "session string, f bigint, json string")
    out = state.stream_of(df, 15).orderBy("f").collect()
    assert [r["f"] for r in out if r["kind"] == "snapshot"] == [0, 15, 30] and all(r["snap_f"] == r["f"] // 15 * 15 for r in out)
    now = {}
    for r, x in zip(out, states, strict=True):
        p = json.loads(r["json"])
        now = p if r["kind"] == "snapshot" else merge(now, p)
        bare = lambda s: {"id": s["id"], "hud": {k: {n: y for n, y in f.items() if y is not None} for k, f in s["hud"].items()}}
        assert bare(now) == bare(x)
