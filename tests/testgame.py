"""A deterministic game as ground truth: every value is a rule of the frame number.

Fixed values: the flash list, scene and objective frames, and the generator's seed, as the reference test
game has them, so that answers on it are known exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FRAMES = 4201
FPS = 60.0
#: Start and length of every flash.
FLASHES = ((317, 1), (611, 2), (953, 1), (1277, 2), (1589, 1), (2213, 2), (2531, 1), (2867, 2), (3391, 1), (3713, 2))
SEED, DRAWS_BEFORE = 12345, 240
#: Enemy: first frame, frame after its last (none: to the end).
ENEMIES = ((0, None), (0, None), (0, 2400), (1500, None))


def mulberry32(seed: int):
    """The public 32-bit generator of that name, as numbers in [0, 1)."""
    mask, a = 0xFFFFFFFF, seed & 0xFFFFFFFF
    while True:
        a = (a + 0x6D2B79F5) & mask
        x = ((a ^ (a >> 15)) * (a | 1)) & mask
        x ^= (x + ((x ^ (x >> 7)) * (x | 61) & mask)) & mask
        yield ((x ^ (x >> 14)) & mask) / 4294967296


def shots() -> list[int]:
    rng = mulberry32(SEED)
    for _ in range(DRAWS_BEFORE):
        next(rng)
    out, g = [], 90
    while g < 4170:
        out.append(g)
        g += 100 + int(next(rng) * 60)
    return out


def truth(spark: SparkSession, frames: int = FRAMES) -> DataFrame:
    """(session, f, scene, objective, flash, health, ammo, score, enemies): one row a frame."""
    f = F.col("f")
    starts, fired = F.array(*[F.lit(s) for s, _ in FLASHES]), F.array(*[F.lit(g) for g in shots()])
    hits = F.size(F.filter(starts, lambda s: s <= f))
    count = F.size(F.filter(fired, lambda g: g <= f))
    flash = F.exists(F.array(*[F.struct(F.lit(s).alias("s"), F.lit(s + n).alias("e")) for s, n in FLASHES]), lambda x: (x["s"] <= f) & (f < x["e"]))
    alive = [((f >= a) & (F.lit(True) if b is None else f < b)).cast("int") for a, b in ENEMIES]
    return spark.range(frames).select(F.lit("game").alias("session"), F.col("id").alias("f")).select(
        "session", "f",
        F.when(f >= 4200, "gameover").when((f >= 3000) & (f < 3060), "loading").when(f < 3000, "level1").otherwise("level2").alias("scene"),
        F.when(f < 2100, "Reach the gate").otherwise("Defend the core").alias("objective"),
        flash.alias("flash"), (100 - 7 * hits).cast("bigint").alias("health"),
        F.when(count % 30 == 0, 30).otherwise(30 - count % 30).cast("bigint").alias("ammo"),
        (50 * count + F.when(f >= 2400, 500).otherwise(0)).cast("bigint").alias("score"),
        sum(alive[1:], alive[0]).cast("bigint").alias("enemies"),
    )


def signal(frames: DataFrame) -> DataFrame:
    """What a camera's region levels would be: bright in a flash, another level in each scene."""
    base = F.when(F.col("scene") == "level1", 10.0).when(F.col("scene") == "loading", 0.0).otherwise(14.0)
    level = F.when(F.col("flash"), 200.0).otherwise(base)
    return frames.select("session", "f", F.transform(F.sequence(F.lit(0), F.lit(47)), lambda r: level + r * 0.01).alias("regions"))


def leaves(frames: DataFrame) -> DataFrame:
    """The head-up display and texts as (session, path, f, v) rows."""
    names = ("scene", "objective", "health", "ammo", "score", "enemies")
    return frames.select("session", "f", *[F.col(c).cast("string").alias(c) for c in names]).unpivot(["session", "f"], list(names), "path", "v")


def states(frames: DataFrame) -> DataFrame:
    """(session, f, json): whole states with fields, as a recording of the game would have them."""
    number = lambda c: F.col(c).cast("string")
    field = lambda v, f: F.concat(F.lit('{"v":'), v, F.lit(',"conf":0.9,"source":"observed","f":'), f.cast("string"), F.lit(',"bbox":[0.1,0.1,0.2,0.1],"crop":"evidence/f'), f.cast("string"), F.lit('.jpg"}'))
    text = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    of = lambda name, v: F.concat(F.lit(f'"{name}":'), field(v, F.col("since")))
    thing = lambda i: F.when(F.col("enemies") > i, F.concat(F.lit(f'"e{i}":{{'), of("label", F.lit('"enemy"')), F.lit(","), of("visible", F.lit("true")), F.lit("}")))
    held = frames.withColumn("since", F.expr("f div 60 * 60"))
    body = F.concat(
        F.lit('{"scene":{"id":"s1",'), of("label", text("scene")), F.lit('},"hud":{'), F.concat_ws(",", *[of(c, number(c)) for c in ("health", "ammo", "score")]),
        F.lit('},"text":{'), of("objective", text("objective")), F.lit('},"entities":{'), F.concat_ws(",", *[thing(i) for i in range(4)]), F.lit("}}"),
    )
    return held.select("session", "f", body.alias("json"))


def events(frames: DataFrame) -> DataFrame:
    """(line): the game's flashes as lines of an event file."""
    flash = frames.filter("flash").select("f", (F.col("f") * 1000 / FPS).alias("t"))
    return flash.select(F.to_json(F.struct(
        F.concat(F.lit("ev"), F.col("f").cast("string")).alias("id"), F.lit("flash").alias("type"), F.col("f").alias("f_start"), F.col("f").alias("f_end"), F.round("t", 2).alias("t_ms"),
        F.lit(0.9).alias("confidence"), F.lit("observed").alias("source"), F.struct(F.col("f"), F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0)).alias("bbox"), F.lit(None).cast("string").alias("crop")).alias("evidence"),
    )).alias("line"))


def recording(spark: SparkSession, folder: str, frames: int) -> None:
    """A session directory of the game: stream, events and meta files. The driver writes them, a line a frame."""
    import json
    import os

    from chronolith.operators import state

    os.makedirs(folder, exist_ok=True)
    game = truth(spark, frames)
    with open(f"{folder}/stream.jsonl", "w") as out:
        for r in state.stream_of(states(game)).orderBy("f").toLocalIterator():
            body = "state" if r["kind"] == "snapshot" else "delta"
            out.write(f'{{"f":{r["f"]},"t_ms":{round(r["f"] * 1000 / FPS, 2)},"kind":"{r["kind"]}","modes":"{"C" * 48}","{body}":{r["json"]},"vlm":false}}\n')
    with open(f"{folder}/events.jsonl", "w") as out:
        out.writelines(r["line"] + "\n" for r in events(game).toLocalIterator())
    with open(f"{folder}/meta.json", "w") as out:
        json.dump({"fps": FPS, "nb_frames": frames, "width": 1280, "height": 752}, out)
