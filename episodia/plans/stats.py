"""Statistics and normalisation (D, H16-H18)."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from episodia.operators import gram, selection, statistics as st
from episodia.plans.common import BANK, FRAMES, LENGTHS, Registry, bank, frames, lengths, signed_round
from episodia.session import table
from episodia.sources.scratch import folder
from episodia.streaming import statistics as live

add = Registry()
r6 = lambda c: signed_round(c, 6)


def rounded(df, *keys, digits=6):
    return df.select(*keys, *[signed_round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes if c not in keys])


@add("d01_episode_stats", "SELECT user_id AS episode_index, round(min(value), 6) AS min, round(max(value), 6) AS max, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(value) AS count FROM events GROUP BY 1")
def d01(spark, sf):
    return rounded(st.group_stats(table(spark, sf, "events").withColumnRenamed("user_id", "episode_index"), "value", "episode_index"), "episode_index")


@add("d02_merged_stats", "SELECT event_type, round(min(value), 6) AS min, round(max(value), 6) AS max, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(value) AS count FROM events GROUP BY 1")
def d02(spark, sf):
    parts = st.group_stats(table(spark, sf, "events"), "value", "event_type", "user_id")
    return rounded(st.merge_stats(parts, "event_type"), "event_type").withColumn("count", F.col("count").cast("long"))


NORMALISER = """per AS (SELECT event_type, user_id, min(value) AS lo, max(value) AS hi, avg(value) AS m, var_samp(value) AS v, quantile_cont(value, 0.01) AS a, quantile_cont(value, 0.99) AS b FROM events GROUP BY 1, 2),
s AS (SELECT event_type, min(lo) AS min, max(hi) AS max, avg(m) AS mean, sqrt(avg(v) + var_pop(m)) AS std, min(a) AS q01, max(b) AS q99 FROM per GROUP BY 1)"""


@add("d04_normaliser_stats", f"WITH {NORMALISER} SELECT event_type, round(min, 6) AS min, round(max, 6) AS max, round(mean, 6) AS mean, round(std, 6) AS std, round(q01, 6) AS q01, round(q99, 6) AS q99 FROM s")
def d04(spark, sf):
    return rounded(st.normaliser_stats(table(spark, sf, "events"), "value", "user_id", "event_type"), "event_type")


@add("d05_stepwise_stats", f"""WITH {FRAMES} SELECT frame_index % 8 AS step, round(min(value), 6) AS min, round(max(value), 6) AS max, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(value) AS count FROM frames GROUP BY 1
UNION ALL SELECT NULL, round(min(value), 6), round(max(value), 6), round(avg(value), 6), round(stddev_pop(value), 6), count(value) FROM frames""")
def d05(spark, sf):
    f = frames(spark, sf).withColumn("step", F.col("frame_index") % 8)
    by_step = st.group_stats(f, "value", "step")
    whole = st.merge_stats(by_step.drop("step").withColumn("_", F.lit(1)), "_").select(F.lit(None).cast("long").alias("step"), "min", "max", "mean", "std", F.col("count").cast("long").alias("count"))
    return rounded(by_step.unionByName(whole), "step")


@add("d06_quantiles", "SELECT event_type, round(quantile_cont(value, 0.01), 6) AS q01, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.99), 6) AS q99 FROM events GROUP BY 1")
def d06(spark, sf):
    q = lambda p: r6(F.percentile("value", F.lit(p)))
    return table(spark, sf, "events").groupBy("event_type").agg(q(0.01).alias("q01"), q(0.5).alias("q50"), q(0.99).alias("q99"))


@add("d07_sample_sizes", f"WITH {LENGTHS} SELECT episode_index, greatest(least(length, 100), least(CAST(floor(pow(length * 50, 0.75)) AS BIGINT), 10000)) AS n FROM lengths")
def d07(spark, sf):
    n = F.col("length")
    return lengths(spark, sf).select("episode_index", F.greatest(F.least(n, F.lit(100)), st.sample_size(n * 50, least=0)).alias("n"))


@add("d09_group_counts", """SELECT user_id % 10 AS task, count(*) AS windows, count(DISTINCT user_id) AS episodes, count(DISTINCT user_id) = 1 AS single FROM events GROUP BY 1""")
def d09(spark, sf):
    return table(spark, sf, "events").groupBy((F.col("user_id") % 10).alias("task")).agg(F.count("*").alias("windows"), F.count_distinct("user_id").alias("episodes"), (F.count_distinct("user_id") == 1).alias("single"))


@add("d10_batch_composition", """WITH c AS (SELECT event_id // 64 AS batch, user_id % 10 AS task, count(*) AS c, count(DISTINCT user_id) AS e FROM events GROUP BY 1, 2)
SELECT batch, count(*) AS tasks, sum(e)::BIGINT AS episodes, sum(CASE WHEN c > 1 THEN c ELSE 0 END)::BIGINT AS anchors, sum(c * (c - 1) // 2)::BIGINT AS pairs FROM c GROUP BY 1""")
def d10(spark, sf):
    c = table(spark, sf, "events").groupBy(F.floor(F.col("event_id") / 64).alias("batch"), (F.col("user_id") % 10).alias("task")).agg(F.count("*").alias("c"), F.count_distinct("user_id").alias("e"))
    return c.groupBy("batch").agg(F.count("*").alias("tasks"), F.sum("e").alias("episodes"), F.sum(F.when(F.col("c") > 1, F.col("c")).otherwise(0)).alias("anchors"), F.sum(F.floor(F.col("c") * (F.col("c") - 1) / 2)).alias("pairs"))


@add("d11_vector_dim_stats", "WITH d AS (SELECT label, unnest(range(64)) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT label, dim, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM d GROUP BY 1, 2")
def d11(spark, sf):
    rows = st.long_vectors(table(spark, sf, "embeddings"), "embedding", "label")
    return rows.groupBy("label", F.col("dim").cast("long").alias("dim")).agg(r6(F.avg("x")).alias("mean"), r6(F.stddev_pop("x")).alias("std"))


@add("d12_masked_mean", "SELECT user_id, round(sum(CASE WHEN event_type <> 'error' THEN value ELSE 0 END) / greatest(sum(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END), 1.0), 6) AS mean FROM events GROUP BY 1")
def d12(spark, sf):
    w = F.when(F.col("event_type") != "error", F.lit(1.0)).otherwise(F.lit(0.0))
    return table(spark, sf, "events").groupBy("user_id").agg(r6(st.masked_mean(F.col("value"), w)).alias("mean"))


@add("d13_adaptive_pool", "SELECT vec_id, [round(list_sum([CAST(x AS DOUBLE) FOR x IN embedding[(i * 64) // 6 + 1 : ((i + 1) * 64 + 5) // 6]]) / (((i + 1) * 64 + 5) // 6 - (i * 64) // 6), 6) FOR i IN range(6)] AS pooled FROM embeddings")
def d13(spark, sf):
    from episodia.operators.retrieval import adaptive_pool

    return table(spark, sf, "embeddings").select("vec_id", F.transform(adaptive_pool(F.col("embedding"), 64, 6), lambda x: signed_round(x, 6)).alias("pooled"))


@add("d19_effective_rank")
def d19(spark, sf):
    return spark.createDataFrame([(st.effective_rank(table(spark, sf, "embeddings"), "embedding", 64),)], "effective_rank double")


@add("d20_variance_covariance", """WITH d AS (SELECT [CAST(x AS DOUBLE) FOR x IN embedding[1:8]] AS v FROM embeddings), p AS (SELECT i, j, covar_samp(v[i + 1], v[j + 1]) AS c, var_pop(v[i + 1]) AS w FROM d, range(8) a(i), range(8) b(j) GROUP BY 1, 2)
SELECT round(sum(CASE WHEN i <> j THEN c * c ELSE 0 END) / 8, 6) AS covariance_loss, round(avg(CASE WHEN i = j THEN greatest(1 - sqrt(w + 1e-4), 0) END), 6) AS variance_loss FROM p""")
def d20(spark, sf):
    rows = table(spark, sf, "embeddings")
    n = F.col("n")
    cov = st.covariance(rows, "embedding", 8).join(F.broadcast(rows.agg(F.count("*").alias("n"))))  # one row
    pop = F.col("cov") * (n - 1) / n
    return cov.agg(r6(F.sum(F.when(F.col("i") != F.col("j"), F.col("cov") ** 2).otherwise(0.0)) / 8).alias("covariance_loss"), r6(F.avg(F.when(F.col("i") == F.col("j"), F.greatest(1 - F.sqrt(pop + 1e-4), F.lit(0.0))))).alias("variance_loss"))


@add("d21_window_summary", f"""WITH {FRAMES} SELECT episode_index, frame_index // 16 AS w, round(arg_min(value, frame_index), 6) AS first, round(arg_max(value, frame_index) - arg_min(value, frame_index), 6) AS change, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM frames GROUP BY 1, 2 HAVING count(*) = 16""")
def d21(spark, sf):
    g = frames(spark, sf).groupBy("episode_index", F.floor(F.col("frame_index") / 16).alias("w"))
    first, last = F.min_by("value", "frame_index"), F.max_by("value", "frame_index")
    return g.agg(r6(first).alias("first"), r6(last - first).alias("change"), r6(F.avg("value")).alias("mean"), r6(F.stddev_pop("value")).alias("std"), F.count("*").alias("n")).where("n = 16").drop("n")


@add("d23_clip_psnr", f"""WITH {FRAMES}, m AS (SELECT episode_index, frame_index // 8 AS f, avg(power(value - 5.0, 2)) AS mse FROM frames GROUP BY 1, 2) SELECT episode_index, round(avg(10 * log10(100.0 * 100.0 / (mse + 1e-8))), 6) AS psnr FROM m GROUP BY 1""")
def d23(spark, sf):
    m = frames(spark, sf).groupBy("episode_index", F.floor(F.col("frame_index") / 8).alias("f")).agg(F.avg((F.col("value") - 5.0) ** 2).alias("mse"))
    return m.groupBy("episode_index").agg(r6(F.avg(10 * F.log10(100.0 * 100.0 / (F.col("mse") + 1e-8)))).alias("psnr"))


@add("d25_action_error", "SELECT l_returnflag, round(avg(abs(l_discount - l_tax)), 6) AS l1, round(avg((l_discount - l_tax) * (l_discount - l_tax)), 6) AS l2 FROM lineitem GROUP BY 1")
def d25(spark, sf):
    d = F.col("l_discount") - F.col("l_tax")
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(r6(F.avg(F.abs(d))).alias("l1"), r6(F.avg(d * d)).alias("l2"))


@add("d28_running_stats", f"""WITH {FRAMES} SELECT episode_index, frame_index, count(value) OVER w AS count, round(avg(value) OVER w, 9) AS mean, round(min(value) OVER w, 6) AS min, round(max(value) OVER w, 6) AS max FROM frames WINDOW w AS (PARTITION BY episode_index ORDER BY frame_index)""")
def d28(spark, sf):
    return rounded(st.running_stats(frames(spark, sf), "value", "episode_index", "frame_index").drop("std"), "episode_index", "frame_index", digits=9)


@add("d29_throughput", "SELECT user_id, round(count(*) / greatest(epoch(max(ts)) - epoch(min(ts)), 1), 9) AS steps_per_second, round((200 - count(*)) * (epoch(max(ts)) - epoch(min(ts))) / count(*), 2) AS seconds_left FROM events GROUP BY 1")
def d29(spark, sf):
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    span = (F.max(micros) - F.min(micros)) / 1e6
    return table(spark, sf, "events").groupBy("user_id").agg(signed_round(F.count("*") / F.greatest(span, F.lit(1)), 9).alias("steps_per_second"), signed_round((200 - F.count("*")) * span / F.count("*"), 2).alias("seconds_left"))


MODES = {"zscore": "(value - mean) / (std + 1e-8)", "minmax": "CASE WHEN max - min < 1e-4 THEN value - min ELSE (value - min) * 2 / (max - min) - 1 END", "quantile": "CASE WHEN q99 - q01 < 1e-4 THEN value - q01 ELSE (value - q01) * 2 / (q99 - q01) - 1 END", "0/50": "(value - 0) * 2 / 50 - 1"}


def _normalised(mode):
    def run(spark, sf):
        rows = table(spark, sf, "events")
        s = st.normaliser_stats(rows, "value", "user_id", "event_type")
        own = rows.select("event_id", "event_type", "value").join(s, "event_type")
        cols = {c: F.col(c) for c in ("min", "max", "mean", "std", "q01", "q99")}
        y = st.normalise(F.col("value"), mode, cols)
        free = st.normalise(F.col("value"), mode, cols, clip=None)
        return own.select("event_id", signed_round(y, 5).alias("normalised"), (F.abs(st.denormalise(free, mode, cols) - F.col("value")) < 1e-6).alias("round_trip"))

    return run


for _mode, _sql in MODES.items():
    add(f"h16_normalise_{_mode.replace('/', '_')}", f"WITH {NORMALISER} SELECT event_id, round(greatest(least({_sql}, 5.0), -5.0), 5) AS normalised, true AS round_trip FROM events JOIN s USING (event_type)")(_normalised(_mode))


@add("d04_selected_stats", f"WITH {NORMALISER} SELECT event_type, round(min, 6) AS min, round(max, 6) AS max, round(mean, 6) AS mean, round(std, 6) AS std, round(q01, 6) AS q01, round(q99, 6) AS q99 FROM s")
def d04_selected(spark, sf):
    return rounded(selection.normaliser_stats(table(spark, sf, "events"), "value", "user_id", "event_type"), "event_type")


@add("d06_selected_quantiles", """SELECT l_returnflag, count(*) AS n, round(quantile_cont(l_extendedprice, 0.0), 6) AS q0, round(quantile_cont(l_extendedprice, 0.01), 6) AS q1, round(quantile_cont(l_extendedprice, 0.5), 6) AS q50, round(quantile_cont(l_extendedprice, 0.99), 6) AS q99, round(quantile_cont(l_extendedprice, 1.0), 6) AS q100 FROM lineitem GROUP BY 1""")
def d06_selected(spark, sf):
    """Quantiles of three large groups, none of which is held whole."""
    got = selection.quantiles(table(spark, sf, "lineitem"), F.col("l_extendedprice"), [0.0, 0.01, 0.5, 0.99, 1.0], "l_returnflag")
    return got.select("l_returnflag", "n", *(r6(F.col("values")[i]).alias(c) for i, c in enumerate(("q0", "q1", "q50", "q99", "q100"))))


@add("d19_covariances", """WITH d AS (SELECT label, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings) SELECT label, i::INT AS i, j::INT AS j, round(covar_samp(v[i + 1], v[j + 1]), 9) AS cov FROM d, range(64) a(i), range(64) b(j) GROUP BY 1, 2, 3""")
def d19_covariances(spark, sf):
    """All pairs of all dimensions, by task."""
    return gram.covariances(gram.moments(table(spark, sf, "embeddings"), "embedding", "label"), "label").withColumn("cov", signed_round("cov", 9))


@add("d19_effective_ranks")
def d19_ranks(spark, sf):
    """By task; the spectrum of a matrix is beyond SQL, the tests hold it against NumPy."""
    return gram.effective_ranks(gram.moments(table(spark, sf, "embeddings"), "embedding", "label"), "label")


@add("d20_losses_of_all_dimensions", """WITH d AS (SELECT [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings), p AS (SELECT i, j, covar_samp(v[i + 1], v[j + 1]) AS c, var_pop(v[i + 1]) AS w FROM d, range(64) a(i), range(64) b(j) GROUP BY 1, 2)
SELECT round(sum(CASE WHEN i <> j THEN c * c ELSE 0 END) / 64, 9) AS covariance_loss, round(avg(CASE WHEN i = j THEN greatest(1 - sqrt(w + 1e-4), 0) END), 9) AS variance_loss FROM p""")
def d20_all(spark, sf):
    states = gram.moments(table(spark, sf, "embeddings"), "embedding")
    cov = gram.covariances(states, "n")
    pop = F.col("cov") * (F.col("n") - 1) / F.col("n")
    apart = F.sum(F.when(F.col("i") != F.col("j"), F.col("cov") ** 2).otherwise(0.0)) / 64
    return cov.agg(signed_round(apart, 9).alias("covariance_loss"), signed_round(F.avg(F.when(F.col("i") == F.col("j"), F.greatest(1 - F.sqrt(pop + 1e-4), F.lit(0.0)))), 9).alias("variance_loss"))


@add("d28_streamed_stats", "SELECT user_id, round(min(value), 9) AS min, round(max(value), 9) AS max, round(avg(value), 9) AS mean, round(stddev_pop(value), 9) AS std, count(value)::DOUBLE AS count FROM events GROUP BY 1")
def d28_streamed(spark, sf):
    """Statistics of half the events are stored; a stream brings the others."""
    e = table(spark, sf, "events")
    numbers = lambda d: d.withColumn("count", F.col("count").cast("double"))
    base = numbers(st.group_stats(e.where("event_id % 2 = 0"), "value", "user_id"))
    path = folder(spark)
    stream = spark.readStream.schema(e.schema).parquet(f"{sf}/event*.parquet").where("event_id % 2 = 1")
    live.maintain(stream, "value", "user_id", base, path, f"{path}/state").awaitTermination()
    return rounded(live.current(spark, path, base), "user_id", digits=9)


QUERIES, ORACLES = add.queries, add.oracles
