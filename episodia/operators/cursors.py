"""Greedy cursors over long episodes, split over tasks.

A window may start at a frame that is marked, and takes ``size`` steps; the next
one starts at the first marked frame at or after its end.  Each choice depends on
the one before, but a block of consecutive steps is a function of little: where
the cursor stands when it comes in (0 .. size - 1 steps into the block) gives
where it stands when it leaves.  So every block finds its function on its own
(by pointer doubling over its frames), the functions of an episode's blocks are
composed in rounds of doubling distance, and then every block knows where the
cursor comes in and gives its windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from episodia.sources.scratch import stored

BLOCK = 1 << 16


def _jumps(at: np.ndarray, size: int, block: int) -> np.ndarray:
    """For a cursor at each place of a block, the end of the window that starts next; places from ``block`` on are outside."""
    marked = np.zeros(block, bool)
    marked[at] = True
    place = np.where(marked, np.arange(block), block)
    first = np.minimum.accumulate(place[::-1])[::-1]  # the first marked place from here on
    out = np.arange(block + size)
    out[:block] = np.where(first < block, first + size, block)
    return out


def _leaves(size: int, block: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        jump = _jumps(rows["at"].to_numpy(), size, block)
        while (jump[:size] < block).any():
            jump = jump[jump]
        return pa.table({"_e": [key[0].as_py()], "_b": [key[1].as_py()], "leaves": pa.array([(jump[:size] - block).tolist()], pa.list_(pa.int32()))})

    return run


def _starts(size: int, block: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        at = np.unique(rows["at"].to_numpy())
        cursor, out = rows["enters"][0].as_py(), []
        while (k := int(np.searchsorted(at, cursor))) < len(at):
            out.append(key[1].as_py() * block + int(at[k]))
            cursor = int(at[k]) + size
        return pa.table({"_e": pa.array([key[0].as_py()] * len(out), pa.int64()), "start": pa.array(out, pa.int64())})

    return run


def greedy_windows(frames: DataFrame, size: int, marked: Column, block: int = BLOCK) -> DataFrame:
    """``episode_index, start`` of the chosen windows of ``frames`` (``episode_index, frame_index``).

    Frames may be missing and stand in any order; repeated ones count once, a
    null mark is none.
    """
    if block < size:
        raise ValueError("a block holds a window at least")
    step = F.col("frame_index")
    rows = stored(frames.where(marked).select(F.col("episode_index").alias("_e"), F.floor(step / block).alias("_b"), F.pmod(step, F.lit(block)).cast("long").alias("at")))
    maps = rows.groupBy("_e", "_b").applyInArrow(_leaves(size, block), "_e long, _b long, leaves array<int>")
    order = Window.partitionBy("_e").orderBy("_b")  # one row a block
    apart = F.coalesce(F.lag("_b").over(order) != F.col("_b") - 1, F.lit(False))
    # after a block without marks the cursor comes in at the start
    maps = maps.withColumns({"n": F.row_number().over(order).cast("long"), "leaves": F.when(apart, F.array_repeat(F.col("leaves")[0], size)).otherwise(F.col("leaves"))})
    maps = stored(maps.withColumn("apart", apart))
    most, reach = maps.agg(F.max("n")).first()[0] or 0, 1
    upto = maps.select("_e", "n", "leaves")
    while reach < most:
        earlier = upto.select("_e", (F.col("n") + reach).alias("n"), F.col("leaves").alias("before"))
        both = F.transform("before", lambda x: F.col("leaves")[x])
        upto = stored(upto.join(earlier, ["_e", "n"], "left").select("_e", "n", F.when(F.col("before").isNull(), F.col("leaves")).otherwise(both).alias("leaves")))
        reach *= 2
    came = upto.select("_e", (F.col("n") + 1).alias("n"), F.col("leaves")[0].alias("came"))
    enters = F.when(F.col("apart") | F.col("came").isNull(), F.lit(0)).otherwise(F.col("came"))
    entered = maps.join(came, ["_e", "n"], "left").select("_e", "_b", enters.alias("enters"))
    out = rows.join(entered, ["_e", "_b"]).groupBy("_e", "_b").applyInArrow(_starts(size, block), "_e long, start long")
    return out.withColumnRenamed("_e", "episode_index")
