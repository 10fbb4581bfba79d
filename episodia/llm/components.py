"""Connected components of an edge table, and sums of arrays over tasks, both as tree-shaped Spark jobs."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from episodia.llm.shared import drop, stored


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, root`` for every end of an edge (columns ``a``, ``b``); the root is the smallest node reachable.

    Alternating large and small stars: each round hangs every node's larger
    (then smaller) neighbours on the least of them; the number of rounds grows
    with the logarithm of the longest path.  A hot node is aggregated before
    the shuffle and its join is left to adaptive skew handling.
    """
    both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    both = stored(both)
    for _ in range(max_rounds):
        ends = both.select("u", "v").unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ends.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = ends.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        new = stored(small)
        # done when every node hangs on one root and no root hangs on another node
        flat = new.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").limit(1).count() == 0 and new.select("u").join(new.select(F.col("v").alias("u")), "u", "left_semi").limit(1).count() == 0
        drop(both)
        both = new
        if flat:
            break
    else:
        raise RuntimeError("components did not settle")
    found = stored(both.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(both.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct())
    drop(both)
    return found


def packed(array: np.ndarray, slice_len: int) -> list[tuple[int, bytes]]:
    """Non-zero slices of an array, compressed."""
    return [(i // slice_len, zlib.compress(array[i : i + slice_len].tobytes(), 1)) for i in range(0, len(array), slice_len) if array[i : i + slice_len].any()]


def sum_arrays(parts: DataFrame, slice_len: int, n_slices: int, dtype: str, bits: bool = False, fan_in: int = 256) -> np.ndarray:
    """Element-wise sum (``bits``: or) of the arrays that tasks emitted as ``slice, part, data``.

    A group holds ``fan_in`` slices at most; the driver gets one array of the
    fixed length.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(slice_len, dtype)
        for x in pdf["data"]:
            one = np.frombuffer(zlib.decompress(x), dtype)
            total = total | one if bits else total + one
        return pd.DataFrame({"slice": pdf["slice"].iloc[:1], "part": pdf["up"].iloc[:1], "data": [zlib.compress(total.tobytes(), 1)]})

    while True:
        last = parts.agg(F.max("part")).first()[0]
        if last is None:
            return np.zeros(slice_len * n_slices, dtype)
        parts = stored(parts.withColumn("up", F.floor(F.col("part") / fan_in).cast("long")).groupBy("slice", "up").applyInPandas(run, "slice int, part long, data binary"))
        if last < fan_in:
            break
    out = np.zeros(slice_len * n_slices, dtype)
    for r in parts.select("slice", "data").toLocalIterator():
        out[r["slice"] * slice_len : (r["slice"] + 1) * slice_len] = np.frombuffer(zlib.decompress(bytes(r["data"])), dtype)
    return out


FILTER_BITS = 26  # of the largest filter, 8 MB; beyond 4 million keys it lets more rows pass, which the exact joins after it remove


def filter_bits(n: int, most: int = FILTER_BITS) -> int:
    """Width of a filter for ``n`` keys: 16 to 32 bits a key, within fixed limits."""
    return min(most, max(16, (16 * n).bit_length()))


def bit_set(column: DataFrame, bits: int, slice_bytes: int = 1 << 13) -> np.ndarray:
    """A bitmap of ``2**bits`` bits with those of the leading bits of a long column set."""
    n_bytes = (1 << bits) // 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = np.zeros(n_bytes, np.uint8)
        for b in batches:
            at = b.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - bits)
            np.bitwise_or.at(own, (at >> np.uint64(3)).astype(np.int64), (1 << (at & np.uint64(7))).astype(np.uint8))
        rows = packed(own, slice_bytes)
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([TaskContext.get().partitionId()] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["slice", "part", "data"])

    rows = stored(column.mapInArrow(run, "slice int, part long, data binary"))
    return sum_arrays(rows, slice_bytes, n_bytes // slice_bytes, "uint8", bits=True)


def has_bit(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the filter holds each hash."""
    at = h.view(np.uint64) >> np.uint64(64 - (8 * len(bitmap) - 1).bit_length())
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
