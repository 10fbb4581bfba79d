"""Splits, samples and balanced orders; random choices are hashes of ids, so reruns and partitionings agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from episodia.operators.keys import numbered
from episodia.sources.scratch import stored


def shuffled(id_: Column, seed: int) -> Column:
    return F.md5(F.concat(id_.cast("string"), F.lit(f":{seed}")))


def stratified_split(rows: DataFrame, group: str, id_: str, share: float, seed: int = 0) -> DataFrame:
    """``is_validation``: min(n - 1, max(1, round(n * share))) rows of each group."""
    w = Window.partitionBy(group)
    n = F.count("*").over(w)
    held = F.least(n - 1, F.greatest(F.lit(1), F.bround(n * F.lit(share)))).cast("long")
    return rows.withColumns({"_n": held, "_r": F.row_number().over(w.orderBy(shuffled(F.col(id_), seed), id_))}).withColumn("is_validation", F.col("_r") <= F.col("_n")).drop("_n", "_r")


def round_robin(rows: DataFrame, group: str, id_: str, seed: int = 0) -> DataFrame:
    """``turn``, ``pick``: one row of each group in turn, groups in order, rows in hashed order."""
    return rows.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(shuffled(F.col(id_), seed), id_)))


def hash_sample(rows: DataFrame, id_: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows, each subset equally likely over seeds (a top-n by hash)."""
    return rows.orderBy(shuffled(F.col(id_), seed), id_).limit(n)


def epoch_order(rows: DataFrame, id_: str, seed: int, epoch: int) -> DataFrame:
    """The rows with their place in the epoch's permutation, by range partitioning (no single task sorts all)."""
    key = shuffled(F.col(id_), seed + epoch)
    return rows.withColumn("epoch_key", key).repartitionByRange("epoch_key", id_).sortWithinPartitions("epoch_key", id_)


def resumed_epoch(rows: DataFrame, id_: str, seed: int, epoch: int, batches: int, batch: int, processes: int = 1) -> DataFrame:
    """The rows of an epoch that are left after ``batches`` batches of every process, with their ``place`` (from 0) in the permutation; only the first epoch resumes."""
    done = batches * batch * processes if epoch == 0 else 0
    keyed = rows.withColumn("epoch_key", shuffled(F.col(id_), seed + epoch))
    placed = numbered(keyed, "place", F.asc("epoch_key"), F.asc(id_)).withColumn("place", F.col("place") - 1)
    return placed.where(F.col("place") >= done)


def equal_ranges(rows: DataFrame, index: str, total: int, world: int) -> DataFrame:
    """Contiguous ranges of ceil(n / world) rows."""
    return rows.withColumn("rank", F.floor(F.col(index) / F.lit(-(-total // world))))


def longest_first(loads: DataFrame, world: int) -> DataFrame:
    """Greedy assignment of loads (``id``, ``load``), heaviest first, to the least loaded rank.

    Each choice depends on all before it; the table of loads (one row a group of
    rows, such as an episode) goes through one task.
    """
    import heapq

    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["load", "id"], ascending=[False, True])
        heap = [(0, r) for r in range(world)]
        rank = []
        for x in pdf["load"]:
            total, r = heapq.heappop(heap)
            rank.append(r)
            heapq.heappush(heap, (total + int(x), r))
        return pd.DataFrame({"id": pdf["id"], "load": pdf["load"], "rank": rank})

    return loads.select("id", "load").groupBy().applyInPandas(run, "id long, load long, rank long")


def balanced_batches(rows: DataFrame, task: str, episode: str, id_: str, tasks: int = 4, samples: int = 4, seed: int = 0) -> DataFrame:
    """Batches of ``tasks * samples`` rows: ``rows`` with ``batch``, ``slot`` (from 0) and ``tier``, each row once.

    A task's rows come in an order that takes its episodes in turn, cut to chunks
    of ``samples``.  Chunks of one number are a level.  Tier ``primary``: of each
    level as many chunks as fill whole batches, each of ``tasks`` different tasks.
    Tier ``adaptive``: rows left over in pairs of a task, then single ones.  Tier
    ``wrap``: the first rows of the plan again, until the last batch is full.
    Choices are hashes of (id, ``seed``).  Windows see an episode or the chunks
    of a level (one a task); orders of the whole table go by ranges.
    """
    size = tasks * samples
    own = rows.select(F.col(id_).alias("id"), F.col(task).alias("task"), F.col(episode).alias("episode"))
    turns = own.withColumn("turn", F.row_number().over(Window.partitionBy("task", "episode").orderBy(shuffled(F.col("id"), seed), "id")))
    placed = numbered(turns, "place", F.col("task"), F.col("turn"), shuffled(F.col("episode"), seed), F.col("episode"), F.col("id"))
    first = placed.groupBy("task").agg(F.min("place").alias("_first"), F.count("*").alias("n"))
    placed = placed.join(first, "task").withColumn("at", F.col("place") - F.col("_first")).withColumn("chunk", F.floor(F.col("at") / samples))
    placed = placed.withColumn("_whole", (F.col("chunk") + 1) * samples <= F.col("n"))
    chunk_key = shuffled(F.concat_ws(",", F.col("task").cast("string"), F.col("chunk").cast("string")), seed)
    level = Window.partitionBy("chunk")
    chunks = placed.where("_whole").select("task", "chunk").distinct()
    chunks = chunks.withColumns({"_rank": F.row_number().over(level.orderBy(chunk_key, "task")), "_m": F.count("*").over(level)})
    full = chunks.where(F.col("_rank") <= F.floor(F.col("_m") / tasks) * tasks).select("task", "chunk", "_rank")
    full = stored(numbered(full, "_number", F.col("chunk"), F.col("_rank")))
    n_full = full.count() * samples
    both = placed.join(full, ["task", "chunk"], "left").withColumn("_primary", F.col("_number").isNotNull())
    primary = both.where("_primary").withColumn("position", (F.col("_number") - 1) * samples + F.col("at") % samples)
    single = (F.col("at") == F.col("n") - 1) & (F.col("at") % samples % 2 == 0)
    rest = numbered(both.where("not _primary").withColumn("_single", single), "_after", F.col("_single"), F.col("chunk"), chunk_key, F.col("task"), F.col("at")).withColumn("position", F.col("_after") - 1 + n_full)
    plan = stored(primary.select("id", "position", F.lit("primary").alias("tier")).unionByName(rest.select("id", "position", F.lit("adaptive").alias("tier"))))
    n = plan.count()
    missing = -n % size
    again = plan.where(F.col("position") < missing).select("id", F.explode(F.sequence(F.col("position"), F.lit(missing - 1).cast("long"), F.lit(max(n, 1)).cast("long"))).alias("_more"))
    every = plan.unionByName(again.select("id", (F.col("_more") + n).alias("position"), F.lit("wrap").alias("tier")))
    return every.select(F.col("id").alias(id_), F.floor(F.col("position") / size).alias("batch"), (F.col("position") % size).alias("slot"), "tier")
