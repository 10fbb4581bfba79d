"""Row predicates and audits of derived caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def finite(vector: Column) -> Column:
    """Whether a vector is present and all its components are finite."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def temporal_violation(effect_length: int = 16) -> Column:
    """For rows ``step, start, stop, is_query``: a query starts at its step; an effect as well, and spans its length."""
    effect = (F.col("step") == F.col("start")) & (F.col("start") < F.col("stop")) & (F.col("stop") - F.col("start") == effect_length)
    return ~F.when(F.col("is_query"), F.col("step") == F.col("start")).otherwise(effect)


def differences(expected: DataFrame, actual: DataFrame, key: str, *columns: str) -> DataFrame:
    """Keys missing on a side, and columns that differ (null-safe)."""
    e, a = expected.select(key, F.struct(*columns).alias("_e")), actual.select(key, F.struct(*columns).alias("_a"))
    both = e.join(a, key, "full_outer")
    status = F.when(F.col("_e").isNull(), "extra").when(F.col("_a").isNull(), "missing").when(~F.col("_e").eqNullSafe(F.col("_a")), "different").otherwise("equal")
    return both.select(key, status.alias("status"))
