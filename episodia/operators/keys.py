"""Key resolution: surrogate keys, coalesced lookups, conflicts, ordered distinct."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from episodia.sources.scratch import stored


def assign_keys(known: DataFrame, values: DataFrame, value: str = "task", key: str = "task_index") -> DataFrame:
    """``known`` and the unseen values with the next dense keys, in value order.

    The window runs over distinct unseen values only, one row each.
    """
    fresh = values.select(value).distinct().join(known, value, "left_anti")
    top = known.agg(F.coalesce(F.max(key), F.lit(-1)).alias("_top")).first()[0]
    numbered = fresh.withColumn(key, (F.row_number().over(Window.orderBy(value)) + F.lit(top)).cast("long"))
    return known.select(value, key).unionByName(numbered)


def resolve(rows: DataFrame, by_episode: DataFrame, by_index: DataFrame, raw: Column, unknown: str = "unknown-task") -> DataFrame:
    """``resolved``: the episode's name, else the index's, else the raw one, else ``unknown``."""
    a = by_episode.select("episode", F.col("name").alias("_e"))
    b = by_index.select("task_index", F.col("name").alias("_i"))
    return rows.join(a, "episode", "left").join(b, "task_index", "left").withColumn("resolved", F.coalesce("_e", "_i", raw, F.lit(unknown))).drop("_e", "_i")


def conflicts(pairs: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one value, and how many."""
    return pairs.groupBy(key).agg(F.count_distinct(value).alias("n"), F.min(value).alias("first"), F.max(value).alias("last")).where("n > 1")


def ordered_distinct(rows: DataFrame, value: str, position: str) -> DataFrame:
    """Each value once with the position of its first occurrence."""
    return rows.groupBy(value).agg(F.min(position).alias("first_position"))


def dictionary_codes(rows: DataFrame, value: str, position: str) -> DataFrame:
    """``value, code``: dense codes in the order of first occurrence."""
    first = ordered_distinct(rows, value, position)
    return first.withColumn("code", (F.row_number().over(Window.orderBy("first_position", value)) - 1).cast("long"))


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def nearest(queries: DataFrame, points: DataFrame, key: str, at: str, tolerance: float) -> DataFrame:
    """The point of each query's key nearest in time, the earlier on ties; ``matched`` if nearer than the tolerance.

    A union sorted by time brings the last point before and the first after by
    running windows: no pairs are built.
    """
    both = queries.select(key, at, F.lit(None).cast("double").alias("p"), F.col("id").alias("q")).unionByName(points.select(key, at, F.col(at).alias("p"), F.lit(None).cast("long").alias("q")))
    w = Window.partitionBy(key).orderBy(at, F.col("q").isNotNull())
    back = Window.partitionBy(key).orderBy(F.desc(at), F.col("q").isNotNull())
    running = both.withColumns({"_b": F.last("p", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_a": F.last("p", True).over(back.rowsBetween(Window.unboundedPreceding, 0))}).where("q is not null")
    before, after = F.abs(F.col(at) - F.col("_b")), F.abs(F.col("_a") - F.col(at))
    best = F.when(F.col("_a").isNull() | (before <= after), F.col("_b")).otherwise(F.col("_a"))
    return running.select(F.col("q").alias("id"), best.alias("nearest"), F.coalesce(F.abs(best - F.col(at)) < tolerance, F.lit(False)).alias("matched"))


def numbered(rows: DataFrame, name: str, *order: Column) -> DataFrame:
    """``rows`` with their place (from 1) in one order of the whole table, without one task that sees all rows.

    Rows are dealt to ranges; a row's place is its place in its range and the
    rows of the ranges before, a table of one row a range.
    """
    ranged = stored(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) + F.col("_before")
    return ranged.join(before, "_range").withColumn(name, place.cast("long")).drop("_range", "_before")
