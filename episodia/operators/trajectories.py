"""Windows over trajectories: rows ``episode_index, frame_index, ...`` with dense frame indices from 0.

Every operator partitions by episode only; an episode is bounded (one recording),
so its windows fit in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def episode(*order: str):
    return Window.partitionBy("episode_index").orderBy(*(order or ("frame_index",)))


def index_frames(rows: DataFrame, episode_key: str, *order: str) -> DataFrame:
    """Number the rows of each episode from 0 in the given order."""
    return rows.withColumnRenamed(episode_key, "episode_index").withColumn("frame_index", (F.row_number().over(episode(*order)) - 1).cast("long"))


def episode_lengths(frames: DataFrame) -> DataFrame:
    return frames.groupBy("episode_index").agg(F.count("*").alias("length"))


def episode_bounds(frames: DataFrame) -> DataFrame:
    """``episode_index, length, from_index, to_index``: prefix sums over episodes (one row each goes through the window)."""
    w = Window.orderBy("episode_index").rowsBetween(Window.unboundedPreceding, 0)
    ends = episode_lengths(frames).withColumn("to_index", F.sum("length").over(w))
    return ends.select("episode_index", "length", (F.col("to_index") - F.col("length")).alias("from_index"), "to_index")


def delta_window(frames: DataFrame, column: str, offsets: list[int]) -> DataFrame:
    """``window`` (the column at clamped offsets, nulls kept) and ``is_pad`` for every frame."""
    lo, hi = min(offsets + [0]), max(offsets + [0])
    held = F.collect_list(F.struct(F.col(column).alias("v"))).over(episode().rowsBetween(lo, hi))
    first, length = F.greatest(F.col("frame_index") + lo, F.lit(0)), F.count("*").over(Window.partitionBy("episode_index"))
    rows = frames.withColumns({"_held": held, "_first": first, "_n": length})
    at = [F.col("frame_index") + d for d in offsets]
    clamped = [F.least(F.greatest(a, F.lit(0)), F.col("_n") - 1) for a in at]
    window = F.array(*[F.get("_held", (c - F.col("_first")).cast("int"))["v"] for c in clamped])
    pad = F.array(*[(a < 0) | (a >= F.col("_n")) for a in at])
    return rows.withColumns({"window": window, "is_pad": pad}).drop("_held", "_first", "_n")


def complete_windows(lengths: DataFrame, size: int = 33, stride: int = 32) -> DataFrame:
    """Starts 0, stride, ... of windows that lie inside the episode."""
    fits = lengths.where(F.col("length") >= size)
    return fits.select("episode_index", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - size, F.lit(stride).cast("long"))).alias("start"))


def strided_queries(lengths: DataFrame, size: int = 33, stride: int = 4) -> DataFrame:
    """Query starts 0, stride, ... up to the last multiple that leaves ``size`` frames."""
    return complete_windows(lengths, size, stride)


def coverage_starts(lengths: DataFrame, size: int = 33, stride: int = 32) -> DataFrame:
    """Fewest strided starts that cover the strided queries: the last one is added where it is not aligned."""
    last = F.floor((F.col("length") - size) / 4) * 4
    fits = lengths.where(F.col("length") >= size).withColumn("_last", last.cast("long"))
    starts = F.array_union(F.sequence(F.lit(0).cast("long"), F.col("_last"), F.lit(stride).cast("long")), F.array("_last"))
    return fits.select("episode_index", F.explode(starts).alias("start"))


def irregular_steps(frames: DataFrame, seconds: Column, fps: float, tolerance: float) -> DataFrame:
    """Frames whose distance to the next one in their episode is not 1 / fps within the tolerance."""
    step = F.lead(seconds).over(episode()) - seconds
    return frames.withColumn("step_seconds", step).where(F.abs(F.col("step_seconds") - 1.0 / fps) > tolerance)


def transitions(frames: DataFrame, column: str, size: int = 4) -> DataFrame:
    """Groups of ``size`` steps with the value before and after; valid if complete with a frame after it."""
    numbered = frames.withColumns({"_after": F.lead(column).over(episode()), "transition_index": F.floor(F.col("frame_index") / size)})
    return numbered.groupBy("episode_index", "transition_index").agg(
        F.min_by(column, "frame_index").alias("before"), F.max_by("_after", "frame_index").alias("after"), F.sum(column).alias("total"),
        ((F.count("*") == size) & F.max_by(F.col("_after").isNotNull(), "frame_index")).alias("valid"),
    )


def islands(frames: DataFrame, keep: Column, step: int = 1) -> DataFrame:
    """Segments of kept frames that follow each other by ``step``."""
    kept = frames.where(keep)
    new = F.coalesce((F.col("frame_index") - F.lag("frame_index").over(episode()) != step).cast("int"), F.lit(1))
    marked = kept.withColumn("segment", F.sum(new).over(episode().rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("episode_index", "segment").agg(F.min("frame_index").alias("first"), F.max("frame_index").alias("last"), F.count("*").alias("n"))


def last_effects(records: DataFrame, k: int = 4) -> DataFrame:
    """The last ``k`` effects up to each query step, right-aligned with a mask; an effect at the same step is visible.

    ``records``: episode_index, raw_step, is_query, effect (null for queries).
    """
    effects = records.where(~F.col("is_query") & F.col("effect").isNotNull())
    own = Window.partitionBy("episode_index").orderBy("raw_step", "effect_index")
    tails = effects.withColumn("_tail", F.array_compact(F.array(*[F.lag("effect", j).over(own) for j in range(k - 1, 0, -1)], F.col("effect"))))
    queries = records.where("is_query").withColumn("_tail", F.lit(None).cast(tails.schema["_tail"].dataType))
    # each query sees the tail of the last effect up to it: a running value, not a list of all of them
    so_far = Window.partitionBy("episode_index").orderBy("raw_step", F.col("is_query").cast("int"), "effect_index").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.coalesce(F.last("_tail", ignorenulls=True).over(so_far), F.array().cast(tails.schema["_tail"].dataType))
    out = tails.unionByName(queries).withColumn("_tail", seen).where("is_query")
    short = F.lit(k) - F.size("_tail")
    return out.select("episode_index", "raw_step", F.concat(F.array_repeat(F.lit(0.0), short), "_tail").alias("effects"), F.concat(F.array_repeat(F.lit(False), short), F.array_repeat(F.lit(True), F.size("_tail"))).alias("mask"))


def temporal_ensemble(predictions: DataFrame) -> DataFrame:
    """Mean of all chunk predictions (``start``, ``chunk`` array) that target the same step."""
    each = predictions.select("episode_index", "start", F.posexplode("chunk").alias("pos", "value"))
    return each.groupBy("episode_index", (F.col("start") + F.col("pos")).alias("step")).agg(F.avg("value").alias("value"), F.count("*").alias("n"))


def next_valid_windows(frames: DataFrame, size: int, valid: str) -> DataFrame:
    """Greedy cursor: a window starts at the first valid frame at or after the end of the window before it.

    Each step depends on the one before, so an episode runs as one group.
    """
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame_index")
        ok, step = pdf[valid].to_numpy(bool), pdf["frame_index"].to_numpy()
        starts, at = [], 0
        while at + size <= len(step):
            window = ok[at : at + size]
            if window.all():
                starts.append(int(step[at]))
                at += size
            else:
                at += int(window.argmin()) + 1
        return pd.DataFrame({"episode_index": [pdf["episode_index"].iloc[0]] * len(starts), "start": starts}).astype({"episode_index": "int64", "start": "int64"})

    return frames.select("episode_index", "frame_index", valid).groupBy("episode_index").applyInPandas(run, "episode_index long, start long")
