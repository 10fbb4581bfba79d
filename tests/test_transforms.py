"""Reversible transforms: widths are checked, statistics come back, rotations are uniform, names nest."""

import pytest
from pyspark.sql import functions as F

from episodia.operators import transforms as tf


def test_wrong_width_is_an_error(spark):
    v = spark.createDataFrame([([1.0, 2.0],)], "x array<double>")
    steps = [tf.scaled(2.0, 2), tf.padded(2, 4)]
    assert v.select(tf.forward(F.col("x"), steps).alias("y")).first().y == [2.0, 4.0, 0.0, 0.0]
    with pytest.raises(Exception, match="a width of 3 is expected"):
        v.select(tf.forward(F.col("x"), [tf.scaled(2.0, 3)]).alias("y")).collect()


def test_random_rotations_are_uniform_and_repeat(spark):
    ids = spark.range(20000)
    q = tf.random_rotations(ids, "id", "q", seed=3)
    means = q.select(*[F.avg(F.pow(F.get("q", k), 2)).alias(f"m{k}") for k in range(4)]).first()
    assert all(abs(m - 0.25) < 0.01 for m in means)
    again = tf.random_rotations(ids.repartition(3), "id", "q", seed=3)
    assert q.join(again.withColumnRenamed("q", "r"), "id").where("q <> r").count() == 0


def test_identical_pictures_are_alike(spark):
    v = spark.createDataFrame([(1, [0.5] * 16, [0.5] * 16), (2, [0.1 * (k % 7) for k in range(16)], [0.3] * 16), (3, None, [0.0] * 16)], "id long, a array<double>, b array<double>")
    got = {r.id: r.ssim for r in tf.similarity(v, "id", "a", "b", 4, 4).collect()}
    assert set(got) == {1, 2} and abs(got[1] - 1) < 1e-9 and got[2] < 0.9


def test_summary_takes_result_files_alone(spark):
    rows = [("a", "x/gpu0_task12_results.json", 5, 4), ("a", "x/gpu1_task12_results.json", 5, 5), ("a", "x/task1.json", 5, 5), ("z", "gpu0_task1_results.json", 1, 1)]
    got = tf.task_summary(spark.createDataFrame(rows, "suite string, file string, trials long, successes long"), ["b", "a"]).collect()
    assert [(r.suite, r.task_id, r.trials, r.successes, r.rate, r.place) for r in got] == [("a", 12, 10, 9, 0.9, 2)]


def test_empty_table(spark):
    v = spark.createDataFrame([], "id long, x array<double>")
    assert tf.normalise_set(v, [tf.Field("x", 2)]).count() == 0
    assert tf.convert_pose(v, "x", "euler", "matrix").count() == 0


def test_rounding_to_zero_keeps_the_sign_as_in_sql(spark):
    import duckdb

    from episodia.plans.common import signed_round

    xs = [-3e-7, 3e-7, -0.0, 0.0, -5e-7, 1.25, -2.5e-6, float("inf"), float("nan"), None]
    got = [r.y for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").select("i", signed_round("x", 6).alias("y")).orderBy("i").collect()]
    want = [duckdb.execute("SELECT round(?::DOUBLE, 6)", [x]).fetchone()[0] for x in xs]
    assert [repr(y) for y in got] == [repr(y) for y in want]
