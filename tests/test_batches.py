"""Balanced batches, written windows and recall by brute force and their errors."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from episodia.operators import memory, sampling as sm
from episodia.sources import tables


def test_balanced_batches(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i % 7}", i // 6) for i in range(1003)]
    df = spark.createDataFrame(rows, "id long, task string, episode long")
    got = sm.balanced_batches(df, "task", "episode", "id", 3, 4, 5).collect()
    task = {r[0]: r[1] for r in rows}
    own = Counter(r["id"] for r in got if r["tier"] != "wrap")
    assert set(own) == set(task) and set(own.values()) == {1}
    batches = defaultdict(list)
    for r in got:
        batches[r["batch"]].append(r)
    assert len(batches) == -(-len(rows) // 12) and all(sorted(r["slot"] for r in b) == list(range(12)) for b in batches.values())
    primary = [b for b in batches.values() if b[0]["tier"] == "primary"]
    assert primary and all(sorted(Counter(task[r["id"]] for r in b).values()) == [4, 4, 4] for b in primary)
    again = sm.balanced_batches(df.repartition(5), "task", "episode", "id", 3, 4, 5).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))
    few = sm.balanced_batches(df.where("id < 3"), "task", "episode", "id", 3, 4).collect()
    assert len(few) == 12 and {r["batch"] for r in few} == {0} and {r["id"] for r in few} == {0, 1, 2}
    assert sm.balanced_batches(df.limit(0), "task", "episode", "id").count() == 0


def test_written_transitions_reject_repeats(spark, tmp_path):
    rows = spark.range(10).withColumn("x", F.col("id") * 2)
    tables.write_transitions(rows, f"file://{tmp_path}/a", "id", 3)
    assert spark.read.parquet(f"file://{tmp_path}/a/windows").count() == 10
    assert sum(r["rows"] for r in spark.read.json(f"file://{tmp_path}/a/manifest").collect()) == 10
    with pytest.raises(ValueError, match="several rows"):
        tables.write_transitions(rows.union(rows.limit(1)), f"file://{tmp_path}/b", "id")


def test_recall_leaves_out_the_own_attempt(spark):
    rows = [(1, s, s // 2, [1.0, float(s)], [float(s), 1.0]) for s in range(6)]
    df = spark.createDataFrame(rows, "episode long, step long, attempt int, phase array<double>, effect array<double>")
    every = memory.recall_memory(df, 10, threshold=2.0).collect()
    assert Counter(r["step"] for r in every) == {s: s for s in range(1, 6)}
    others = memory.recall_memory(df, 10, threshold=2.0, other_attempts=True).collect()
    assert Counter(r["step"] for r in others) == {2: 2, 3: 2, 4: 4, 5: 4} and all(r["entry_step"] // 2 < r["step"] // 2 for r in others)
    merged = memory.recall_memory(df, 10, threshold=-1.0).collect()
    assert Counter(r["step"] for r in merged) == {s: 1 for s in range(1, 6)} and all(r["entry_step"] == r["step"] - 1 for r in merged)
