"""Second moments of vectors: states of (count, mean, comoments) that merge in a tree.

A task adds up the states of its rows by matrix products; states of parts merge
by their counts and means, so the result does not depend on large means, and one
row a part and group is all that is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

FAN_IN = 256
HELD = 64  # groups that a task keeps before it sends their states on

State = tuple[int, np.ndarray, np.ndarray]


def state_of(x: np.ndarray) -> State:
    mean = x.mean(0)
    centred = x - mean
    return len(x), mean, centred.T @ centred


def merged(a: State, b: State) -> State:
    n = a[0] + b[0]
    apart = b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n)


def _rows(states: dict, keys: pa.Schema, part: int) -> pa.RecordBatch:
    columns = [pa.array([k[i] for k in states], f.type) for i, f in enumerate(keys)]
    columns += [pa.array([part] * len(states), pa.int64()), pa.array([s[0] for s in states.values()], pa.int64())]
    columns += [pa.array([s[j].ravel().tolist() for s in states.values()], pa.list_(pa.float64())) for j in (1, 2)]
    return pa.RecordBatch.from_arrays(columns, [*keys.names, "part", "n", "mean", "comoments"])


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, states, keys = TaskContext.get().partitionId(), {}, None
    for batch in batches:
        keys = pa.schema([f for f in batch.schema if f.name != "_v"])
        groups: dict[tuple, list[int]] = {}
        for i, k in enumerate(zip(*(batch.column(c).to_pylist() for c in keys.names)) if keys.names else [()] * batch.num_rows):
            groups.setdefault(k, []).append(i)
        vectors = batch.column("_v")
        for k, own in groups.items():
            taken = vectors.take(pa.array(own))
            x = taken.flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1).astype(float)
            states[k] = merged(states[k], state_of(x)) if k in states else state_of(x)
        if len(states) > HELD:
            yield _rows(states, keys, part)
            states = {}
    if states:
        yield _rows(states, keys, part)


def _merge(key: tuple, rows: pa.Table) -> pa.Table:
    out = None
    for n, mean, comoments in zip(rows["n"].to_pylist(), rows["mean"], rows["comoments"]):
        m = np.array(mean.values)
        one = (n, m, np.array(comoments.values).reshape(len(m), len(m)))
        out = merged(out, one) if out else one
    first = rows.slice(0, 1)
    for name, value in (("n", pa.array([out[0]], pa.int64())), ("mean", pa.array([out[1].tolist()], pa.list_(pa.float64()))), ("comoments", pa.array([out[2].ravel().tolist()], pa.list_(pa.float64())))):
        first = first.set_column(first.schema.get_field_index(name), name, value)
    return first


def moments(rows: DataFrame, vector: str, *keys: str) -> DataFrame:
    """``keys, n, mean, comoments`` of each group: sums of products of deviations, row by row of the matrix.

    Null vectors and vectors with null components are left out; vectors of a
    group have one length.
    """
    v = F.col(vector).cast("array<double>")
    sound = rows.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(F.transform(vector, F.isnotnull), lambda x: x)).select(*keys, v.alias("_v"))
    shape = ", ".join([*(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys), "part bigint, n bigint, mean array<double>, comoments array<double>"])
    states = sound.mapInArrow(_by_part, shape)
    some = states.groupBy(*keys, F.floor(F.col("part") / FAN_IN).alias("_parts")).applyInArrow(_merge, shape)
    return some.groupBy(*keys).applyInArrow(_merge, shape).drop("part")


def covariances(states: DataFrame, *keys: str) -> DataFrame:
    """``keys, i, j, cov`` (sample; null for a single row)."""
    size = F.size("mean")
    cells = states.select(*keys, "n", size.alias("_d"), F.posexplode("comoments").alias("_p", "_c"))
    return cells.select(*keys, F.floor(F.col("_p") / F.col("_d")).cast("int").alias("i"), (F.col("_p") % F.col("_d")).alias("j"), F.when(F.col("n") > 1, F.col("_c") / (F.col("n") - 1)).alias("cov"))


def rank_of(comoments: np.ndarray) -> float:
    """exp of the entropy of the normalised spectrum; 0 for a matrix of zeros."""
    p = np.clip(np.linalg.eigvalsh(comoments), 0, None)
    if not p.sum():
        return 0.0
    p = np.clip(p / p.sum(), 1e-12, None)
    return float(np.exp(-(p * np.log(p)).sum()))


def effective_ranks(states: DataFrame, *keys: str) -> DataFrame:
    """``keys, n, effective_rank`` of each group's state; fewer than two rows have rank 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranks = []
            for n, mean, comoments in zip(batch.column("n").to_pylist(), batch.column("mean"), batch.column("comoments")):
                d = len(mean.values)
                ranks.append(rank_of(np.array(comoments.values).reshape(d, d)) if n > 1 else 0.0)
            kept = [batch.column(c) for c in (*keys, "n")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(ranks, pa.float64())], [*keys, "n", "effective_rank"])

    shape = ", ".join([*(f"`{k}` {states.schema[k].dataType.simpleString()}" for k in keys), "n bigint, effective_rank double"])
    return states.mapInArrow(run, shape)
