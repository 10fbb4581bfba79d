"""Progress files, orders of whole tables, reports, and noise by hash."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from episodia.operators import metadata as md, sampling as sm, transforms as tf
from episodia.functions import rotations as ro


def parts(spark):
    return spark.createDataFrame([(p, i) for p, n in (("a", 4), ("b", 3), ("c", 2)) for i in range(n)], "part string, place long")


def test_progress_is_checked(spark, tmp_path):
    rows = parts(spark)
    write = lambda *state: md.write_progress(spark.createDataFrame(list(state), "part string, total long, next_offset long"), str(tmp_path))
    write(("a", 4, 1), ("b", 3, 3))
    got = sorted(map(tuple, md.remaining(rows, str(tmp_path)).collect()))
    assert got == [("a", 1), ("a", 2), ("a", 3), ("c", 0), ("c", 1)]
    for wrong in (("a", 5, 1), ("b", 3, 4), ("b", 3, -1), ("c", None, 1)):
        write(wrong)
        with pytest.raises(Exception, match="does not fit"):
            md.remaining(rows, str(tmp_path)).collect()


def test_resumed_epoch_takes_up_the_permutation(spark):
    rows = spark.range(200)
    every = {r["place"]: r["id"] for r in sm.resumed_epoch(rows, "id", 5, 0, 0, 8).collect()}
    assert sorted(every) == list(range(200)) and sorted(every.values()) == list(range(200))
    left = {r["place"]: r["id"] for r in sm.resumed_epoch(rows.repartition(3), "id", 5, 0, 3, 8, 4).collect()}
    assert left == {p: i for p, i in every.items() if p >= 96}
    assert sm.resumed_epoch(rows, "id", 5, 1, 3, 8, 4).count() == 200
    assert sm.resumed_epoch(rows, "id", 5, 0, 99, 8).count() == 0


def test_order_of_a_whole_table(spark):
    rng = np.random.default_rng(2)
    values = rng.integers(0, 50, 1000).tolist()
    rows = spark.createDataFrame(list(enumerate(values)), "place long, v long").repartition(9)
    assert sorted(r["place"] for r in md.order_violations(rows, "v").collect()) == [i for i in range(1, 1000) if values[i - 1] > values[i]]
    assert md.order_violations(rows.limit(0), "v").count() == 0


def test_validation_report(spark):
    rows = spark.createDataFrame([(1, 2.0), (2, 3.0), (3, None)], "id long, v double")
    ok = {"positive": F.col("v") > 0}
    assert md.validation_report(rows, "id", ok).first().asDict() == {"rows": 3, "ids": 3, "bad_positive": 1, "status": "failed"}
    assert md.validation_report(rows.where("v > 0"), "id", ok).first()["status"] == "passed"
    assert md.validation_report(rows.where("v > 0").union(rows.limit(1)), "id", ok).first()["status"] == "failed"
    assert md.validation_report(rows.limit(0), "id", ok).first().asDict() == {"rows": 0, "ids": 0, "bad_positive": 0, "status": "failed"}


def test_noise_of_poses(spark):
    poses = spark.range(4000).select("id", F.array(*(F.lit(x) for x in (1.0, 2.0, 3.0, 1.0, 0.0, 0.0, 0.0, 9.0))).alias("pose"))
    noisy = tf.noisy_pose(poses, "pose", "id", "quaternion", 0.05, 0.02, seed=3)
    x = np.array([r["pose"] for r in noisy.collect()])
    assert np.allclose(x[:, :3].mean(0), [1, 2, 3], atol=0.004) and np.allclose(x[:, :3].std(0), 0.05, rtol=0.08)
    assert np.allclose(2 * x[:, 4:7].std(0), 0.02, rtol=0.08) and np.allclose((x[:, 3:7] ** 2).sum(1), 1) and (x[:, 7] == 9).all()
    again = np.array([r["pose"] for r in tf.noisy_pose(poses, "pose", "id", "quaternion", 0.05, 0.02, seed=3).collect()])
    assert (x == again).all()


def test_axis_angles_near_their_limits(spark):
    vectors = [[0.0, 0.0, 0.0], [1e-9, 0.0, 0.0], [3e-7, -2e-7, 1e-7], [1e-3, 0.0, 2e-3], [3.0, 0.1, -0.5], [0.0, 3.14159, 0.0]]
    v = spark.createDataFrame([(x,) for x in vectors], "v array<double>")
    q = ro.axis_angle_to_quaternion([F.get("v", k) for k in range(3)])
    back = v.withColumn("q", F.array(*q)).select("v", "q", F.array(*ro.quaternion_to_axis_angle([F.get("q", k) for k in range(4)])).alias("b")).collect()
    for r in back:
        assert np.allclose(r["b"], r["v"], atol=1e-12) and abs(np.dot(r["q"], r["q"]) - 1) < 1e-12


def test_statistics_of_another_revision(spark, tmp_path):
    from episodia.sources import stats_cache

    path = f"{tmp_path}/s"
    row = lambda s, r, v: (s, r, {"mean": [v, 0.1], "n": []})
    frame = lambda rows: spark.createDataFrame(rows, "signature string, revision string, statistics map<string,array<double>>")
    stats_cache.keep(frame([row("a", "r1", 1.0), row("a", "r2", 2.0), row("b", "r1", 3.0)]), path)
    stats_cache.keep(frame([row("b", "r1", 4.0)]), path)  # replaces one, leaves the others
    wanted = spark.createDataFrame([("a", "r1"), ("a", "r9"), ("b", "r9"), ("c", "r1")], "signature string, revision string")
    got = {(r["signature"], r["revision"]): (r["found"], r["exact"], r["statistics"]) for r in stats_cache.find(spark, path, wanted).collect()}
    tenth = float(np.float32(0.1))
    assert got == {
        ("a", "r1"): ("r1", True, {"mean": [1.0, tenth], "n": []}), ("a", "r9"): ("r2", False, {"mean": [2.0, tenth], "n": []}),
        ("b", "r9"): ("r1", False, {"mean": [4.0, tenth], "n": []}), ("c", "r1"): (None, False, None),
    }


def test_result_files_of_a_task_tie_by_name(spark, tmp_path):
    import json

    for suite, name, n in (("b", "gpu0_task3_results.json", 1), ("b", "gpu1_task3_results.json", 2), ("b", "gpu0_task12_retry_results.json", 5), ("a", "gpu0_task0_results.json", 4), ("x", "gpu0_task0_results.json", 9), ("a", "task1_results.json", 9)):
        (tmp_path / suite).mkdir(exist_ok=True)
        more = {"future_video_psnr_mean": 20.00005} if suite == "a" else {}
        (tmp_path / suite / name).write_text(json.dumps({"total_episodes": 8, "successes": n, "duration": 1.5 * n, "task_description": "put it"} | more, indent=2))
    files = tf.result_files(spark, f"file://{tmp_path}", ["a", "b"])
    assert sorted((r["suite"], r["task_id"], r["successes"]) for r in files.collect()) == [("a", 0, 4), ("b", 3, 1), ("b", 3, 2), ("b", 12, 5)]
    sums = {r["suite"]: (r["total_tasks"], r["total_successes"], r["total_time"], r["average_psnr"]) for r in tf.suite_statistics(files).collect()}
    assert sums == {"a": (1, 4, 6.0, 20.00005), "b": (3, 8, 12.0, None)}
    lines = [r["line"] for r in tf.task_lines(files).orderBy("place", "task_id").collect()]
    assert lines == [
        "Task Description Success Rate (%) Future Video PSNR (dB)", f" a_0      put it            50.00                {20.00005:.4f}",
        " b_3      put it            25.00                    N/A", "b_12      put it            62.50                    N/A",
    ]


def test_sampled_cells(spark):
    picture = F.array(*(F.array(*(F.lit(10 * i + j) for j in range(5))) for i in range(4)))
    one = spark.range(1).select(tf.sampled_cells(picture, F.lit(2).cast("long")).alias("a"), tf.sampled_cells(picture, F.lit(9).cast("long")).alias("b"), tf.sampled_cells(F.array().cast("array<array<int>>"), F.lit(1).cast("long")).alias("c")).first()
    assert one["a"] == [[0, 2, 4], [20, 22, 24]] and one["b"] == [[0]] and one["c"] is None
