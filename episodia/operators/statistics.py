"""Two systems of statistics, kept apart: count-weighted with population variance, and unweighted over episodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


STD_REG = 1e-8  # added to a standard deviation before division


def long_vectors(rows: DataFrame, vector: str, *keys: str) -> DataFrame:
    return rows.select(*keys, F.posexplode(vector).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))


def group_stats(rows: DataFrame, column: str, *keys: str) -> DataFrame:
    """min, max, mean, population std, count."""
    x = F.col(column)
    return rows.groupBy(*keys).agg(F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.count(x).alias("count"))


def merge_stats(stats: DataFrame, *keys: str) -> DataFrame:
    """Statistics of the union from statistics of parts (map-side combinable sums)."""
    n, m, s = F.col("count"), F.col("mean"), F.col("std")
    sums = stats.groupBy(*keys).agg(F.min("min").alias("min"), F.max("max").alias("max"), F.sum("count").alias("count"), F.sum(n * m).alias("_s"), F.sum(n * (s * s + m * m)).alias("_q"))
    mean = F.col("_s") / F.col("count")
    return sums.select(*keys, "min", "max", mean.alias("mean"), F.sqrt(F.greatest(F.col("_q") / F.col("count") - mean * mean, F.lit(0.0))).alias("std"), "count")


def normaliser_stats(rows: DataFrame, column: str, episode: str, *keys: str) -> DataFrame:
    """Per-episode mean, sample variance and quantiles, then combined without weights: quantiles by min and max."""
    x = F.col(column)
    per = rows.groupBy(episode, *keys).agg(
        F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.var_samp(x).alias("var"), F.percentile(x, F.lit(0.01)).alias("q01"), F.percentile(x, F.lit(0.99)).alias("q99")
    )
    out = per.groupBy(*keys).agg(
        F.min("min").alias("min"), F.max("max").alias("max"), F.avg("mean").alias("mean"), (F.avg("var") + F.var_pop("mean")).alias("_v"), F.min("q01").alias("q01"), F.max("q99").alias("q99")
    )
    return out.select(*keys, "min", "max", "mean", F.sqrt("_v").alias("std"), "q01", "q99")


def normalise(x: Column, mode: str, s: dict[str, Column], clip: float | None = 5.0, eps: float = 1e-4) -> Column:
    """Linear normalisation: z-score, or a range mapped to [-1, 1]; a constant dimension has scale 1 and offset -min."""
    scale, offset = coefficients(mode, s, eps)
    y = x * scale + offset
    return F.greatest(F.least(y, F.lit(clip)), F.lit(-clip)) if clip is not None else y


def coefficients(mode: str, s: dict[str, Column], eps: float = 1e-4) -> tuple[Column, Column]:
    if mode == "zscore":
        return 1.0 / (s["std"] + F.lit(STD_REG)), -s["mean"] / (s["std"] + F.lit(STD_REG))
    if mode == "minmax":
        low, high = s["min"], s["max"]
    elif mode == "quantile":
        low, high = s["q01"], s["q99"]
    else:  # constant limits: "low/high"
        low, high = (F.lit(float(x)) for x in mode.split("/"))
    flat = (high - low) < eps
    scale = F.when(flat, F.lit(1.0)).otherwise(F.lit(2.0) / F.greatest(high - low, F.lit(eps)))
    offset = F.when(flat, -low).otherwise(F.lit(-1.0) - low * scale)
    return scale, offset


def denormalise(y: Column, mode: str, s: dict[str, Column]) -> Column:
    scale, offset = coefficients(mode, s)
    return (y - offset) / scale


def sample_size(n: Column, least: int = 100, most: int = 10_000, power: float = 0.75) -> Column:
    return F.greatest(F.least(n, F.lit(least)), F.least(F.floor(F.pow(n.cast("double"), F.lit(power))), F.lit(most))).cast("long")


def masked_mean(x: Column, w: Column) -> Column:
    """Aggregate: sum(x * w) / max(sum(w), 1)."""
    return F.sum(x * w) / F.greatest(F.sum(w), F.lit(1.0))


def covariance(rows: DataFrame, vector: str, size: int) -> DataFrame:
    """``i, j, cov`` (sample) of a vector column: one pass of ``size**2`` sums, whatever the number of rows."""
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda j: F.struct(i.alias("i"), j.alias("j"), F.get(vector, i).cast("double").alias("a"), F.get(vector, j).cast("double").alias("b")))))
    return rows.select(F.inline(pairs)).groupBy("i", "j").agg(F.covar_samp("a", "b").alias("cov"))


def effective_rank(rows: DataFrame, vector: str, size: int) -> float:
    """exp of the entropy of the normalised spectrum; the driver sees a ``size`` x ``size`` matrix."""
    import numpy as np

    m = np.zeros((size, size))
    for r in covariance(rows, vector, size).collect():
        m[r["i"], r["j"]] = r["cov"] if r["cov"] is not None else 0.0
    p = np.clip(np.linalg.eigvalsh(m), 0, None)
    if not p.sum():
        return 0.0
    p = np.clip(p / p.sum(), 1e-12, None)
    return float(np.exp(-(p * np.log(p)).sum()))


def running_stats(rows: DataFrame, column: str, key: str, order: str) -> DataFrame:
    """Statistics after each row, as they are maintained incrementally."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(key, order, F.count(column).over(w).alias("count"), F.avg(column).over(w).alias("mean"), F.stddev_pop(column).over(w).alias("std"), F.min(column).over(w).alias("min"), F.max(column).over(w).alias("max"))
