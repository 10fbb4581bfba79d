"""Metadata operators on small tables, failures included."""

import pytest
from pyspark.sql import functions as F

from episodia.functions import halves
from episodia.operators import keys as ky, metadata as md, trajectories as tr


def test_versions_and_stats(spark):
    stats = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "feature string, mean double")
    episodes = spark.range(3).select(F.col("id").alias("episode_index"))
    assert md.per_episode_stats("v2.0", stats, episodes).count() == 6
    with pytest.raises(ValueError):
        md.per_episode_stats("v2.1", stats, episodes)
    assert md.per_episode_stats("v2.1", stats.withColumn("episode_index", F.lit(0)), episodes).count() == 2
    with pytest.raises(ValueError):
        md.require_version("v2.1", "v3.0")


def test_task_columns(spark):
    assert md.task_column(spark.createDataFrame([(1, "x", "y")], "task_index long, instruction string, other string")) == "instruction"
    assert md.task_column(spark.createDataFrame([(1, "x")], "task_index long, `__index_level_0__` string")) == "__index_level_0__"
    with pytest.raises(ValueError):
        md.task_column(spark.createDataFrame([(1, "x", "y")], "task_index long, a string, b string"))
    tasks = spark.createDataFrame([(1, "Pick  it"), (2, "pick it"), (3, "other")], "task_index long, task string")
    assert [(r["text"], r["keys"]) for r in md.text_conflicts(tasks).collect()] == [("pick it", 2)]


def test_missing_keys_fail(spark):
    rows = spark.createDataFrame([(1,), (2,)], "k long")
    table = spark.createDataFrame([(1, "a")], "k long, v string")
    with pytest.raises(Exception, match="no v for k 2"):
        md.must_match(rows, table, "k", "v").collect()


def test_offsets(spark):
    assert md.window_offsets(2, 6, every=2, fps=2.0) == [-1.0, 0.0, 1.0]
    one = spark.range(1).select(md.frame_offsets(F.array(F.lit(0.25), F.lit(-0.5)), 10.0, 0.06).alias("o")).first()["o"]
    assert one == [2, -5]
    with pytest.raises(Exception, match="no frame"):
        spark.range(1).select(md.frame_offsets(F.array(F.lit(0.25)), 10.0)).collect()


def test_feature_problems(spark):
    got = md.feature_problems(spark.createDataFrame([(1, "x")], "a long, b string"), {"a": "double", "c": "string"})
    assert got == ["missing c", "extra b", "a is bigint, not double"]


def test_paths_and_ambiguity(spark):
    paths = spark.createDataFrame([("/x/open_box_v2/y",), ("/x/my_open_box",), ("/open_box/close_box",), ("/none",)], "path string")
    names = spark.createDataFrame([("open_box",), ("close_box",)], "name string")
    got = {r["path"]: (r["name"], len(r["candidates"])) for r in md.canonical_from_path(paths, names).collect()}
    assert got == {"/x/open_box_v2/y": ("open_box", 1), "/x/my_open_box": ("open_box", 1), "/open_box/close_box": (None, 2), "/none": (None, 0)}


def test_halves(spark):
    values = [0.0, -0.0, 1.0, 1.00390625, 1.01171875, -3.1415927, 1e-40, float("inf"), None]
    rows = spark.createDataFrame([(v,) for v in values], "x float").select("x", halves.upper_half_bits("x").alias("b")).withColumn("y", halves.upper_half_float("b"))
    got = [(r["b"], r["y"]) for r in rows.collect()]
    assert [b for b, _ in got] == [0, 0x8000, 0x3F80, 0x3F80, 0x3F82, 0xC049, 1, 0x7F80, None]
    assert got[5][1] == -3.140625 and got[-1][1] is None


def test_numbered_and_last_effects(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    assert {r["v"]: r["n"] for r in ky.numbered(rows, "n", F.col("v").desc()).collect()} == {v: 1000 - v for v in range(1000)}
    assert ky.numbered(rows.limit(0), "n", F.col("v")).count() == 0
    records = spark.createDataFrame([(0, 0, False, 1.0, 0), (0, 0, True, None, None), (0, 4, False, 2.0, 1), (0, 5, False, 3.0, 2), (0, 9, True, None, None), (1, 1, True, None, None)], "episode_index long, raw_step long, is_query boolean, effect double, effect_index long")
    got = {(r["episode_index"], r["raw_step"]): (r["effects"], r["mask"]) for r in tr.last_effects(records, 2).collect()}
    assert got == {(0, 0): ([0.0, 1.0], [False, True]), (0, 9): ([2.0, 3.0], [True, True]), (1, 1): ([0.0, 0.0], [False, False])}
