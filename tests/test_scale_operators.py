"""Operators that split what depends on order, against the loop that they replace."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from episodia.operators import cursors


def greedy(steps, size):
    out, at = [], -(10**9)
    for s in sorted(set(steps)):
        if s >= at:
            out.append(s)
            at = s + size
    return out


@pytest.mark.parametrize(("size", "block"), [(1, 1), (3, 4), (5, 5), (7, 16), (4, 1 << 16)])
def test_greedy_windows(spark, size, block):
    rng = random.Random(size)
    steps = {e: [rng.randrange(200 if e % 2 else 900) for _ in range(rng.randrange(0, 150))] for e in range(8)}
    steps[8] = list(range(333))
    rows = spark.createDataFrame([(e, s, True) for e, x in steps.items() for s in x] + [(0, 17, None), (3, 5, False)], "episode_index long, frame_index long, ok boolean")
    got = {}
    for r in cursors.greedy_windows(rows, size, F.col("ok"), block).collect():
        got.setdefault(r["episode_index"], []).append(r["start"])
    assert {e: sorted(x) for e, x in got.items()} == {e: greedy(x, size) for e, x in steps.items() if x}
    assert cursors.greedy_windows(rows.limit(0), size, F.col("ok"), block).count() == 0


def test_one_long_episode_is_many_tasks(spark):
    rows = spark.range(0, 400_000, 1, 8).select(F.lit(1).cast("long").alias("episode_index"), F.col("id").alias("frame_index"))
    marked = F.pmod(F.xxhash64("frame_index"), F.lit(7)) < 3
    out = cursors.greedy_windows(rows, 33, marked, block=4096)
    steps = np.array([r["frame_index"] for r in rows.where(marked).collect()])
    assert sorted(r["start"] for r in out.collect()) == greedy(steps.tolist(), 33)


@pytest.mark.parametrize("buckets", [2, 7, 512])
def test_selection_finds_order_statistics(spark, buckets):
    from episodia.operators.selection import quantiles

    rng = random.Random(buckets)
    groups = {
        "a": [rng.gauss(0, 1e6) for _ in range(700)], "ties": [rng.choice([1.0, 2.0, 2.0, 5.0]) for _ in range(900)], "one": [3.5], "same": [7.0] * 50,
        "far": [1e308, -1e308, 0.0, 1e-308, 5e-324, float("inf"), float("-inf")], None: [1.0, 2.0], "close": [1.0 + k * 2.220446049250313e-16 for k in range(40)],
    }
    rows = [(k, v) for k, x in groups.items() for v in x] + [("a", None), ("nulls", None), ("a", float("nan"))]
    rng.shuffle(rows)
    shares = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    got = {r["k"]: r for r in quantiles(spark.createDataFrame(rows, "k string, v double"), F.col("v"), shares, "k", buckets=buckets).collect()}
    assert set(got) == set(groups)
    for k, x in groups.items():
        assert got[k]["n"] == len(x)
        for q, v in zip(shares, got[k]["values"]):
            s, p = sorted(x), q * (len(x) - 1)
            low, high = s[int(np.floor(p))], s[int(np.ceil(p))]
            assert v == (low if low == high else pytest.approx(low + (high - low) * (p - np.floor(p)), nan_ok=True)), (k, q)
    assert quantiles(spark.createDataFrame([], "k string, v double"), F.col("v"), shares, "k").count() == 0


def test_moments_against_numpy(spark, monkeypatch):
    from episodia.operators import gram

    monkeypatch.setattr(gram, "HELD", 2)
    monkeypatch.setattr(gram, "FAN_IN", 2)
    rng = np.random.default_rng(3)
    groups = {k: rng.normal(size=(n, 6)) @ rng.normal(size=(6, 6)) + 1e7 for k, n in {"a": 400, "b": 2, "c": 1, "d": 33, None: 12}.items()}
    flat = np.array([[1.0, 2, 3, 4, 5, 6]] * 9)
    rows = [(k, v.tolist()) for k, x in [*groups.items(), ("flat", flat)] for v in x]
    random.Random(1).shuffle(rows)
    rows += [("a", None), ("a", [1.0, None, 2.0, 3.0, 4.0, 5.0]), ("b", [])]
    states = gram.moments(spark.createDataFrame(rows, "k string, v array<double>").repartition(7), "v", "k").cache()
    cov = {(r["k"], r["i"], r["j"]): r["cov"] for r in gram.covariances(states, "k").collect()}
    ranks = {r["k"]: r["effective_rank"] for r in gram.effective_ranks(states, "k").collect()}
    for k, x in groups.items():
        if len(x) == 1:
            assert cov[k, 0, 0] is None and ranks[k] == 0.0
            continue
        want = np.cov(x.T)
        assert np.allclose([[cov[k, i, j] for j in range(6)] for i in range(6)], want, rtol=1e-6, atol=1e-6)
        s = np.linalg.svd(x - x.mean(0), compute_uv=False) ** 2
        p = np.clip(s / s.sum(), 1e-12, None)
        p = np.concatenate([p, np.full(6 - len(p), 1e-12)])
        assert ranks[k] == pytest.approx(np.exp(-(p * np.log(p)).sum()), rel=1e-5)
    assert ranks["flat"] == 0.0
    states.unpersist()


def test_streamed_statistics_after_every_file(spark, tmp_path):
    from episodia.operators import statistics as st
    from episodia.streaming import statistics as live

    rng = random.Random(2)
    everything = [(rng.randrange(6), rng.gauss(5, 2)) for _ in range(300)]
    frame = lambda rows: spark.createDataFrame(rows, "key long, value double")
    numbers = lambda d: d.withColumn("count", F.col("count").cast("double"))
    base, path = numbers(st.group_stats(frame([(k, v) for k, v in everything[:80] if k != 5]), "value", "key")), f"{tmp_path}/out"
    seen = [(k, v) for k, v in everything[:80] if k != 5]
    for k in range(3):
        more = everything[80 + 70 * k : 150 + 70 * k] if k else [x for x in everything[80:150] if x[0] < 3]  # the first file leaves groups alone
        frame(more).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        seen += more
        live.maintain(spark.readStream.schema("key long, value double").json(f"{tmp_path}/in"), "value", "key", base, path, f"{tmp_path}/state").awaitTermination()
        got = {r["key"]: r for r in live.current(spark, path, base).collect()}
        want = {r["key"]: r for r in st.group_stats(frame(seen), "value", "key").collect()}
        assert set(got) == set(want)
        for key, r in want.items():
            assert [got[key][c] for c in ("min", "max", "mean", "std", "count")] == pytest.approx([r[c] for c in ("min", "max", "mean", "std", "count")])
