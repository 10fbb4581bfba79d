"""Exact quantiles by distributed selection: no group is ever held or sorted in one task.

Each wanted order statistic lies between two values of its group.  A round
counts the values between them in equal buckets and goes on with the least and
the greatest value of the bucket that holds the rank, so an interval shrinks by
the number of buckets each time and ends at one value.  Only counts are
shuffled: a group sends at most one row a bucket, whatever its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from episodia.sources.scratch import drop, stored

BUCKETS = 512
MOST = 1.7976931348623157e308


def _same(a: DataFrame, b: DataFrame, columns: list[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & a[c].eqNullSafe(b[c])
    return out


def quantiles(rows: DataFrame, value: Column, shares: list[float], *keys: str, buckets: int = BUCKETS) -> DataFrame:
    """``keys, n, values``: the number of values and, for each share, its quantile with linear interpolation.

    Nulls and NaN are left out; a group without values has no row.
    """
    names = list(keys)
    data = rows.where(value.isNotNull() & ~F.isnan(value.cast("double"))).select(*names, F.greatest(F.least(value.cast("double"), F.lit(MOST)), F.lit(-MOST)).alias("_v"))
    ends = data.groupBy(*names).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    place = [F.lit(q) * (F.col("_n") - 1) for q in shares]
    ranks = F.array_distinct(F.array(*(f(p).cast("long") for p in place for f in (F.floor, F.ceil))))
    wanted = stored(ends.select(*names, "_n", "_lo", "_hi", F.lit(0).cast("long").alias("_below"), F.explode(ranks).alias("_rank")))
    while wanted.where("_lo < _hi").limit(1).count():
        spans = wanted.where("_lo < _hi").select(*names, "_lo", "_hi").distinct()
        inside = data.join(spans, _same(data, spans, names) & (data["_v"] >= spans["_lo"]) & (data["_v"] <= spans["_hi"])).select(*(spans[c] for c in names), "_lo", "_hi", "_v")
        v, lo, hi = F.col("_v"), F.col("_lo"), F.col("_hi")
        # halves where the width is beyond doubles; a width is never 0
        share = F.when(hi - lo <= MOST, (v - lo) / (hi - lo)).otherwise((v / 2 - lo / 2) / F.when(hi - lo <= MOST, F.lit(1.0)).otherwise(hi / 2 - lo / 2))
        counts = inside.groupBy(*names, "_lo", "_hi", F.least(F.floor(share * buckets), F.lit(buckets - 1)).alias("_bucket")).agg(F.count("*").alias("_k"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
        before = Window.partitionBy(*names, "_lo", "_hi").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("_before", F.coalesce(F.sum("_k").over(before), F.lit(0)))
        own = wanted.where("_lo < _hi")
        step = own["_rank"] - own["_below"]
        found = own.join(counts, _same(own, counts, [*names, "_lo", "_hi"]) & (step >= counts["_before"]) & (step < counts["_before"] + counts["_k"]))
        found = found.select(*(own[c] for c in names), own["_n"], counts["_least"].alias("_lo"), counts["_most"].alias("_hi"), (own["_below"] + counts["_before"]).alias("_below"), own["_rank"])
        narrower = stored(wanted.where("_lo = _hi").unionByName(found))
        drop(wanted)
        wanted = narrower
    per = wanted.groupBy(*names).agg(F.first("_n").alias("_n"), F.map_from_entries(F.collect_list(F.struct("_rank", "_lo"))).alias("_at"))
    limit = lambda x: F.when(x >= MOST, F.lit(float("inf"))).when(x <= -MOST, F.lit(float("-inf"))).otherwise(x)

    def between(p: Column) -> Column:
        low, high = F.col("_at")[F.floor(p).cast("long")], F.col("_at")[F.ceil(p).cast("long")]
        return F.when(low == high, limit(low)).otherwise(limit(low) + (limit(high) - limit(low)) * (p - F.floor(p)))

    return per.select(*names, F.col("_n").alias("n"), F.array(*(between(p) for p in place)).alias("values"))


def normaliser_stats(rows: DataFrame, column: str, episode: str, *keys: str) -> DataFrame:
    """As ``statistics.normaliser_stats``, with the quantiles of each episode by selection."""
    x = F.col(column)
    per = rows.groupBy(episode, *keys).agg(F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.var_samp(x).alias("var"))
    tails = quantiles(rows, x, [0.01, 0.99], episode, *keys)
    out = per.join(tails, _same(per, tails, [episode, *keys])).select(*(per[c] for c in per.columns), "values").groupBy(*keys).agg(
        F.min("min").alias("min"), F.max("max").alias("max"), F.avg("mean").alias("mean"), (F.avg("var") + F.var_pop("mean")).alias("_v"),
        F.min(F.col("values")[0]).alias("q01"), F.max(F.col("values")[1]).alias("q99"),
    )
    return out.select(*keys, "min", "max", "mean", F.sqrt("_v").alias("std"), "q01", "q99")
