"""Edge cases of the trajectory, memory, pose and streaming operators."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from episodia.functions import rotations as ro, text as tx
from episodia.operators import keys as ky, memory as me, retrieval as rt, sampling as sm, statistics as st, trajectories as tr, validation as va
from episodia.sources import tables
from episodia.streaming import lifecycle as lc


def episodes(spark, *lengths):
    return spark.createDataFrame([(e, i, float(i)) for e, n in enumerate(lengths) for i in range(n)], "episode_index long, frame_index long, value double")


def test_window_boundaries(spark):
    n = tr.episode_lengths(episodes(spark, 1, 4, 32, 33, 34, 65))
    starts = sorted((r["episode_index"], r["start"]) for r in tr.complete_windows(n).collect())
    assert starts == [(3, 0), (4, 0), (5, 0), (5, 32)]
    assert sorted(r["start"] for r in tr.coverage_starts(n).where("episode_index = 5").collect()) == [0, 32]


def test_delta_window_clamps_and_keeps_nulls(spark):
    f = spark.createDataFrame([(0, 0, 1.0), (0, 1, None), (0, 2, 3.0)], "episode_index long, frame_index long, value double")
    rows = {r["frame_index"]: r for r in tr.delta_window(f, "value", [-2, 0, 4]).collect()}
    assert rows[1]["window"] == [1.0, None, 3.0] and rows[1]["is_pad"] == [True, False, True]
    assert tr.delta_window(f.limit(0), "value", [0]).count() == 0


def test_islands(spark):
    f = spark.createDataFrame([(0, s) for s in (0, 4, 8, 16, 20)], "episode_index long, frame_index long")
    assert sorted((r["first"], r["last"]) for r in tr.islands(f, F.lit(True), 4).collect()) == [(0, 8), (16, 20)]


def test_next_valid_windows(spark):
    f = episodes(spark, 10).withColumn("ok", F.col("frame_index") != 2)
    assert sorted(r["start"] for r in tr.next_valid_windows(f, 3, "ok").collect()) == [3, 6]


def test_constant_dimension_and_clip(spark):
    s = {c: F.lit(x) for c, x in (("min", 2.0), ("max", 2.0), ("mean", 0.0), ("std", 1.0))}
    r = spark.range(1).select(st.normalise(F.lit(2.5), "minmax", s).alias("a"), st.normalise(F.lit(9.0), "zscore", s).alias("b")).first()
    assert r["a"] == 0.5 and r["b"] == 5.0


def test_merge_equals_whole(spark):
    f = episodes(spark, 5, 9, 1)
    whole = st.group_stats(f.withColumn("k", F.lit(1)), "value", "k").first()
    merged = st.merge_stats(st.group_stats(f.withColumn("k", F.lit(1)), "value", "k", "episode_index"), "k").first()
    assert merged["count"] == whole["count"] and abs(merged["std"] - whole["std"]) < 1e-12


def test_zero_vector_stays_zero_and_ties_go_to_insertion(spark):
    b = spark.createDataFrame([(0, 0, 0, [1.0, 0.0]), (1, 0, 1, [2.0, 0.0]), (2, 0, 2, [3.0, 0.0]), (3, 0, 3, [0.0, 0.0])], "id long, task int, episode long, vector array<double>").withColumn("unit", rt.l2_normalise(F.col("vector")))
    assert b.where("id = 3").first()["unit"] == [0.0, 0.0]
    top = rt.block_top_k(b.where("id = 0"), b, 2, same_task=True)
    assert [r["id"] for r in top.orderBy("rank").collect()] == [1, 2]


def test_merging_store():
    m = me.MergingStore(capacity=2)
    assert m.add([1, 0], [1, 0], 0, 0) == (0, False)
    assert m.add([1, 0], [1, 0], 0, 1) == (0, True) and m.entries[0]["count"] == 2
    assert m.add([0, 1], [0, 1], 0, 2) == (1, False)
    assert m.add([-1, 0], [-1, 0], 1, 3) == (1, False)  # the entry seen once made room
    assert [e["step"] for e in m.entries] == [1, 3]
    assert [i for i, _ in m.query(np.array([1.0, 0.0]), 2)] == [0, 1]
    for cosine, merged in ((0.849999, False), (0.850001, True)):
        s = me.MergingStore()
        s.add([1, 0], [1, 0], 0, 0)
        v = [cosine, (1 - cosine**2) ** 0.5]
        assert s.add(v, v, 0, 1)[1] is merged


def test_rotations(spark):
    r = spark.range(1).select(F.array(*ro.matrix_to_quaternion(ro.quaternion_to_matrix([F.lit(0.0), F.lit(1.0), F.lit(0.0), F.lit(0.0)]))).alias("q"), F.array(*ro.axis_angle_to_quaternion([F.lit(0.0)] * 3)).alias("z"), ro.project_to_rotation(F.array(*[F.lit(x) for x in (2.0, 0.0, 0.0, 0.0, 2.0, 0.0, 0.0, 0.0, -2.0)])).alias("m")).first()
    assert r["q"] == [0.0, 1.0, 0.0, 0.0] and r["z"] == [1.0, 0.0, 0.0, 0.0]
    assert abs(np.linalg.det(np.array(r["m"]).reshape(3, 3)) - 1) < 1e-9


def test_euler_conventions(spark):
    for convention in ("XYZ", "ZYX", "ZYZ", "YXZ"):
        m = np.array(spark.range(1).select(F.array(*ro.euler_to_matrix([F.lit(0.3), F.lit(-0.7), F.lit(1.1)], convention)).alias("m")).first()["m"]).reshape(3, 3)
        assert np.allclose(m @ m.T, np.eye(3)) and abs(np.linalg.det(m) - 1) < 1e-9


def test_text(spark):
    r = spark.range(1).select(tx.normalise_text(F.lit(" A\t B  c ")).alias("t"), tx.normalise_name(F.lit("a--b  C")).alias("n"), tx.duration(F.lit(3661.5)).alias("d"), tx.fixed(F.lit(1234.125)).alias("f")).first()
    assert (r["t"], r["n"], r["d"], r["f"]) == ("a b c", "a_b_c", "01h01m02s", "1234.12")


def test_nearest_ties_go_to_the_earlier(spark):
    q = spark.createDataFrame([(1, 0, 5.0), (2, 0, 20.0), (3, 1, 1.0)], "id long, k int, t double")
    p = spark.createDataFrame([(0, 4.0), (0, 6.0)], "k int, t double")
    got = {r["id"]: (r["nearest"], r["matched"]) for r in ky.nearest(q, p, "k", "t", 1.5).collect()}
    assert got == {1: (4.0, True), 2: (6.0, False), 3: (None, False)}


def test_stratified_split_counts(spark):
    rows = spark.createDataFrame([(i, i % 3) for i in range(30)], "id long, g int")
    got = sm.stratified_split(rows, "g", "id", 0.25, 1).groupBy("g").agg(F.sum(F.col("is_validation").cast("int")).alias("n")).collect()
    assert {r["n"] for r in got} == {2}


def test_differences_and_finite(spark):
    a = spark.createDataFrame([(1, 1.0), (2, None), (3, 1.0)], "k long, x double")
    b = spark.createDataFrame([(1, 1.0), (2, 2.0), (4, 1.0)], "k long, x double")
    assert {r["k"]: r["status"] for r in va.differences(a, b, "k", "x").collect()} == {1: "equal", 2: "different", 3: "missing", 4: "extra"}
    v = spark.createDataFrame([([1.0, float("nan")],), ([1.0, None],), (None,), ([],)], "v array<double>")
    assert [r[0] for r in v.select(va.finite(F.col("v"))).collect()] == [False, False, False, True]


def test_locate_and_writer(spark, tmp_path):
    f = episodes(spark, 3, 70, 5)
    bounds = tr.episode_bounds(f)
    got = tables.locate(spark.range(78).withColumnRenamed("id", "i"), bounds, "i").where("i in (0, 3, 72, 73)")
    assert sorted((r["i"], r["episode_index"], r["local_index"]) for r in got.collect()) == [(0, 0, 0), (3, 1, 0), (72, 1, 69), (73, 2, 0)]
    tables.write_episodes(f, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 78
    with pytest.raises(Exception):
        tables.write_episodes(f, str(tmp_path / "out"))


def test_result_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("log\n0.5\ndone\n")
    (tmp_path / "b.txt").write_text("nothing\n")
    got = {r["file"].rsplit("/", 1)[1]: r["value"] for r in tables.last_number(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": 0.5, "b.txt": None}


REQUESTS = [("s", 0, "reset", 0, 0), ("s", 1, "act", 0, 0), ("s", 2, "act", 0, 0), ("s", 3, "act", 0, 1), ("s", 4, "act", 0, 2), ("s", 5, "act", 0, 3), ("s", 6, "act", 0, 4), ("s", 7, "final", 0, 5), ("s", 8, "reset", 1, 0), ("s", 9, "act", 1, 7), ("s", 10, "act", 1, 0), ("s", 11, "reset", 0, 0)]
STATUS = ["ok", "ok", "repeat", "ok", "ok", "ok", "ok", "ok", "ok", "fault", "latched", "ok"]
SCHEMA = "session string, seq long, kind string, attempt int, step long"


def test_session_replay(spark):
    got = lc.replay(spark.createDataFrame(REQUESTS, SCHEMA)).orderBy("seq").collect()
    assert [r["status"] for r in got] == STATUS and got[7]["groups"] == 1  # of five steps one is an incomplete tail


def test_session_stream_equals_replay(spark, tmp_path):
    for k, part in enumerate((REQUESTS[:5], REQUESTS[5:])):
        pd.DataFrame(part, columns=["session", "seq", "kind", "attempt", "step"]).astype({"attempt": "int32"}).to_parquet(tmp_path / f"{k}.parquet")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    q = lc.serve(stream).writeStream.format("memory").queryName("replies").option("checkpointLocation", str(tmp_path / "_c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r["status"] for r in spark.table("replies").orderBy("seq").collect()] == STATUS


def test_whole_table_vector_statistics(spark, sf):
    from episodia.plans.common import bank
    from episodia.plans.vectors import QUERIES

    rows = bank(spark, sf).orderBy("id").collect()
    ids, task, episode = (np.array([r[c] for r in rows]) for c in ("id", "task", "episode"))
    unit = np.array([r["unit"] for r in rows])
    s = np.round(unit @ unit.T, 6)
    s[episode[:, None] == episode] = -np.inf
    top = np.argsort(-s, axis=1, kind="stable")[:, :5]
    same, pair = task[:, None] == task, s > -np.inf
    got = {r["q_id"]: r["hit"] for r in QUERIES["d27_top5_hits_all"](spark, sf).collect()}
    assert got == {int(i): bool((task[top[k]] == task[k]).any()) for k, i in enumerate(ids)}
    got = {r["task"]: (r["queries"], r["top1"]) for r in QUERIES["f06_neighbour_accuracy_all"](spark, sf).collect()}
    assert got == {int(t): (int((task == t).sum()), round(float((task[top[task == t, 0]] == t).mean()), 6)) for t in set(task)}
    for r in QUERIES["f07_pair_cosine_means_all"](spark, sf).collect():
        own = pair & (same == r["same_task"])
        assert r["pairs"] == own.sum() and abs(r["mean"] - s[own].mean()) < 2e-5
    got = {r["q_id"]: r["log_prob"] for r in QUERIES["d22_contrastive_metric_all"](spark, sf).collect()}
    assert len(got) == ((same & pair).any(axis=1)).sum() == len(ids)
    for k in range(0, len(ids), 7):
        z = s[k] / 0.1
        want = z[same[k] & pair[k]].mean() - z.max() - np.log(np.exp(z - z.max()).sum())
        assert abs(got[int(ids[k])] - want) < 2e-5
    b = bank(spark, sf)
    whole, parts = (sorted((r["q_id"], r["rank"], r["id"]) for r in rt.block_top_k(b, b, 5, block).collect()) for block in (4096, 100))
    assert whole == parts


def test_blocks_meet_within_their_task(spark):
    rng = np.random.default_rng(8)
    rows = [(i, int([0, 0, 0, 1, 2][rng.integers(5)]), int(rng.integers(40)), rng.choice([-1.0, 1.0], 4).tolist()) for i in range(300)]
    shape = "id long, task int, episode long, unit array<double>"
    b = spark.createDataFrame(rows, shape)
    no_task = spark.createDataFrame([(900 + i, None, i, [1.0] * 4) for i in range(3)], shape)
    for same in (True, False, None):
        want = []
        for i, t, e, u in rows[::3]:
            found = sorted((-float(np.dot(u, v)), k) for k, x, f, v in rows if e != f and (same is None or (x == t) is same))
            want += [(i, rank, k, -s) for rank, (s, k) in enumerate(found[:5], 1)]
        bank = b.union(no_task) if same else b
        got = [(r["q_id"], r["rank"], r["id"], r["score"]) for r in rt.block_top_k(bank.where("id % 3 = 0"), bank, 5, block=32, same_task=same).collect()]
        assert sorted(got) == sorted(want), same
    tasks = lambda q, qt, i, t, s: {"asked": [len(set(qt))], "held": [len(set(t))], "same": [int(qt[0] == t[0])]}
    pairs = rt.block_scores(b, b, tasks, "asked long, held long, same long", block=32, same_task=True).collect()
    assert {tuple(r) for r in pairs} == {(1, 1, 1)} and len(pairs) > 20


def test_a_task_reads_few_pairs_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(rt, "WORK", 1, raising=False)
    rng = np.random.default_rng(4)
    shape = "id long, task int, episode long, unit array<double>"
    b = spark.createDataFrame([(i, i % 2, i // 5, rng.choice([-1.0, 1.0], 6).tolist()) for i in range(320)], shape)
    one = lambda q, qt, i, t, s: {"n": [s.size]}
    for same, pairs in ((None, 16 * 16), (True, 2 * 16 * 16)):
        found = rt.block_scores(b, b, one, "n long", block=8, same_task=same).groupBy(F.spark_partition_id()).agg(F.count("*").alias("pairs"), F.sum("n").alias("n")).collect()
        assert sum(r["pairs"] for r in found) <= pairs and sum(r["n"] for r in found) == (320 * 320 if same is None else 2 * 160 * 160)
        assert max(r["pairs"] for r in found) <= 8, same
        top = [(r["q_id"], r["rank"], r["id"]) for r in rt.block_top_k(b, b, 5, block=8, same_task=same).collect()]
        assert sorted(top) == sorted((r["q_id"], r["rank"], r["id"]) for r in rt.block_top_k(b, b, 5, block=4096, same_task=same).collect())


def test_rows_left_out_in_single_precision_are_none_of_the_best(spark):
    rng = np.random.default_rng(12)
    n, k = 4096, 5
    unit = rng.normal(size=(n, 8))
    unit[::3] = unit[0] + rng.normal(size=unit[::3].shape) * 1e-7  # scores that only rounding or double precision tells apart
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    unit[7] = 0
    asked, few = rng.choice(n, 48, replace=False), 4096
    asked[0] = 7
    exact = np.round(unit[asked] @ unit.T, 6)
    rough = unit[asked].astype(np.float32) @ unit.astype(np.float32).T
    for hidden in (0, n - 3):  # of which scores take no part
        exact[0, :hidden] = rough[0, :hidden] = -np.inf
        row, col = rt._likely(rough, k, rt._slack(unit[asked], unit, 6), n * len(asked))
        found = np.zeros(exact.shape, bool)
        found[row, col] = True
        for i in range(len(asked)):
            best = np.lexsort((np.arange(n), -exact[i]))[:k]
            assert found[i, best[exact[i, best] > -np.inf]].all() and not found[i, exact[i] == -np.inf].any()
        assert found[1:].sum() < 0.4 * found[1:].size
    assert rt._likely(rough, k, 10.0, few) is None
    # far too long vectors and those without direction are scored in double precision
    assert rt._slack(unit, unit, 6) < rt.QUICK
    assert not rt._slack(unit * 1e4, unit, 6) < rt.QUICK and not rt._slack(np.where(unit == 0, np.nan, unit), unit, 6) < rt.QUICK
    # by brute force: copies, and a task with nearly all rows
    tasks, ids = np.where(np.arange(n) % 500 == 1, 1, 0), rng.permutation(n)
    b = spark.createDataFrame([(int(ids[i]), int(tasks[i]), i // 5, unit[i].tolist()) for i in range(n)], "id long, task int, episode long, unit array<double>")
    for same in (None, False):
        want = []
        for i in np.flatnonzero(ids % 64 == 0):
            s = np.round(unit @ unit[i], 6)
            s[np.arange(n) // 5 == i // 5] = -np.inf
            s[(tasks == tasks[i]) & (same is False)] = -np.inf
            top = np.lexsort((ids, -s))[:k]
            want += [(int(ids[i]), r, int(ids[j]), float(s[j])) for r, j in enumerate(top, 1) if s[j] > -np.inf]
        got = [(r["q_id"], r["rank"], r["id"], r["score"]) for r in rt.block_top_k(b.where("id % 64 = 0"), b, k, n, same_task=same).collect()]
        assert sorted(got) == sorted(want), same
