"""Keyed-state streams against the same records as a table."""

import datetime as dt
import os
import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from episodia.plans import memories as plans
from episodia.streaming import memories, silence

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def drain(stream, path):
    query = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert not query.isActive and query.exception() is None


def files(rows, path, parts):
    """The table's rows as one file for each value of ``parts``, in the order of their times."""
    for k, part in enumerate(parts):
        rows.where(part).coalesce(1).write.json(f"{path}/part{k}")
        name = next(f for f in os.listdir(f"{path}/part{k}") if f.startswith("part-"))
        os.makedirs(f"{path}/in", exist_ok=True)
        os.rename(f"{path}/part{k}/{name}", f"{path}/in/{k}.json")
        os.utime(f"{path}/in/{k}.json", (time.time() - 1000 + 10 * k,) * 2)
    return f"{path}/in"


def test_memories_of_a_stream_equal_a_replay(rocks, sf, tmp_path):
    rows = plans.records(rocks, sf)
    options = {"capacity": 5, "threshold": 0.12, "hits": 3}
    want = sorted(map(str, memories.replay(rows, **options).collect()))
    source = files(rows, str(tmp_path), [F.floor(F.col("place") / 7) == k for k in range(4)])
    stream = rocks.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).json(source)
    drain(memories.serve(stream, **options), tmp_path)
    assert sorted(map(str, rocks.read.parquet(f"{tmp_path}/out").collect())) == want


def record(place, kind, attempt=0, task="t", phase=(1.0, 0.0), effect=(0.0, 1.0)):
    return (place, kind, attempt, task, list(phase), list(effect))


def test_rules_of_the_memories():
    m = memories.Memories(ring_size=2, hits=2, threshold=0.9)
    take = lambda *a, **k: m.take(*record(*a, **k))
    assert take(0, "query")[1] == "no reset"
    assert take(1, "reset")[1] == "ok"
    assert take(2, "effect", effect=(0, 1))[1] == "ok"
    *_, ring, steps, hits = take(3, "query")  # visible at once
    assert ring == [[0.0, 1.0]] and steps == [0] and [h["step"] for h in hits] == [0]
    for place, x in ((4, 1.0), (5, 2.0), (6, 3.0)):
        take(place, "effect", phase=(0, x), effect=(x, 0))
    *_, ring, steps, hits = take(7, "query", phase=(0, 1))
    assert ring == [[2.0, 0.0], [3.0, 0.0]] and steps == [8, 12]
    assert [(h["entry"], h["count"]) for h in hits] == [(1, 3), (0, 1)]
    assert take(8, "end")[1] == "ok"
    *_, ring, _, hits = take(9, "query")  # the ring is empty, the store stays
    assert ring == [] and len(hits) == 2
    assert take(10, "attempt", 2)[1] == "attempt" and take(11, "attempt", 1)[1] == "ok"
    assert take(12, "effect", task="u")[1] == "task" and take(9, "effect")[1] == "order"
    assert take(13, "reset")[1] == "ok"
    assert take(14, "query")[4:] == ([], [], [])


def requests(spark):
    rng = random.Random(5)
    start, rows = dt.datetime(2024, 1, 1), []
    for session in range(12):
        at, seq = start + dt.timedelta(seconds=rng.randrange(600)), 0
        for _ in range(rng.randrange(5, 60)):
            rows.append((session, at, seq, "reset" if seq == 0 and session % 5 else rng.choices(["act", "reset"], [14, 1])[0]))
            at += dt.timedelta(seconds=rng.choice([1, 20, 60, 60, 300, 700, 2000]))
            seq += 1
    return spark.createDataFrame(rows, "session long, ts timestamp, seq long, kind string")


def test_closed_sessions_one_by_one(spark):
    rows = sorted(map(tuple, requests(spark).collect()))
    want, life = [], {}

    def close(session, why, at):
        opened, last, acts, late, _ = life.pop(session)
        want.append((session, opened, at or last + dt.timedelta(seconds=400), why, acts, acts // 4, acts % 4, late))

    for session, ts, _, kind in rows:
        now = life.get(session)
        if now and now[4] and (ts - now[1]).total_seconds() > 400:
            now[4] = False
        if kind == "reset":
            if now:
                close(session, "reset" if now[4] else "silence", ts if now[4] else None)
            life[session] = [ts, ts, 0, 0, True]
        elif now and now[4]:
            now[1:3] = [ts, now[2] + 1]
        elif now:
            now[3] += 1
    for session in list(life):
        close(session, "silence", None)
    got = [tuple(r) for r in silence.closed(requests(spark), 400).collect()]
    assert sorted(got) == sorted(want)
    assert {r[3] for r in got} == {"reset", "silence"} and sum(r[7] for r in got) > 20


def test_stream_closes_what_the_table_closes(rocks, tmp_path):
    rows = requests(rocks)
    far = rocks.createDataFrame([(99, dt.datetime(2024, 3, 1), 0, "reset"), (99, dt.datetime(2024, 3, 2), 1, "act"), (99, dt.datetime(2024, 3, 3), 2, "act")], rows.schema)
    # out of order: requests go to files by a time that is shifted by up to 30 minutes
    shifted = F.unix_timestamp("ts") + F.pmod(F.xxhash64("session", "seq"), F.lit(1800))
    cuts = [1704067200, 1704069500, 1704072000, 1704076000, 1 << 40]
    parts = [(shifted >= a) & (shifted < b) for a, b in zip(cuts, cuts[1:])]
    source = files(rows, str(tmp_path), parts)
    for k in range(3):
        one = far.where(F.col("seq") == k).toPandas()
        pd.DataFrame({"session": [99], "ts": [str(one["ts"][0])], "seq": [k], "kind": [one["kind"][0]]}).to_json(f"{source}/far{k}.json", orient="records", lines=True)
    stream = rocks.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).json(source)
    drain(silence.close_stream(stream, 400, "1 hour", keep_seconds=86_400), tmp_path)
    got = [tuple(r) for r in rocks.read.parquet(f"{tmp_path}/out").where("session < 99").collect()]
    assert sorted(got) == sorted(tuple(r) for r in silence.closed(rows, 400).collect())


def test_memories_keep_vectors_exactly():
    m = memories.Memories()
    m.take(*record(0, "reset"))
    x = np.random.default_rng(1).normal(size=8)
    m.take(*record(1, "effect", phase=x, effect=x))
    assert m.take(*record(2, "query", phase=x))[4] == [x.tolist()]
