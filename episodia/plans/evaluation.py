"""Evaluation roll-ups and audits (D15-D17, F15, K), session replay (J)."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from episodia.functions.text import fixed
from episodia.operators.validation import differences
from episodia.plans.common import FRAMES, Registry, frames, signed_round
from episodia.session import table
from episodia.streaming import lifecycle

add = Registry()
TASKS = "t AS (SELECT user_id % 5 AS suite, user_id AS task, count(*) AS trials, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END)::BIGINT AS successes, sum(value) AS seconds FROM events GROUP BY 1, 2), s AS (SELECT suite, count(*) AS tasks, sum(trials)::BIGINT AS trials, sum(successes)::BIGINT AS successes, sum(seconds) AS seconds, max(seconds) AS slowest FROM t GROUP BY 1)"


def tasks(spark, sf):
    return table(spark, sf, "events").groupBy((F.col("user_id") % 5).alias("suite"), F.col("user_id").alias("task")).agg(F.count("*").alias("trials"), F.sum((F.col("event_type") == "purchase").cast("long")).alias("successes"), F.sum("value").alias("seconds"))


def suites(spark, sf):
    return tasks(spark, sf).groupBy("suite").agg(F.count("*").alias("tasks"), F.sum("trials").alias("trials"), F.sum("successes").alias("successes"), F.sum("seconds").alias("seconds"), F.max("seconds").alias("slowest"))


@add("d15_suite_rollup", f"WITH {TASKS} SELECT suite, tasks, trials, successes, round(seconds, 4) AS seconds, round(slowest, 4) AS slowest FROM s")
def d15(spark, sf):
    return suites(spark, sf).withColumns({c: signed_round(c, 4) for c in ("seconds", "slowest")})


@add("d16_macro_overall", f"WITH {TASKS} SELECT round(avg(100.0 * successes / trials), 6) AS macro_rate, round(sum(seconds) / sum(tasks), 6) AS seconds_per_task, round(max(slowest), 4) AS slowest FROM s")
def d16(spark, sf):
    return suites(spark, sf).agg(signed_round(F.avg(100.0 * F.col("successes") / F.col("trials")), 6).alias("macro_rate"), signed_round(F.sum("seconds") / F.sum("tasks"), 6).alias("seconds_per_task"), signed_round(F.max("slowest"), 4).alias("slowest"))


@add("d17_null_skipping_mean", "SELECT event_type, round(avg(CASE WHEN value > 10 THEN value END), 6) AS mean FROM events GROUP BY 1")
def d17(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(signed_round(F.avg(F.when(F.col("value") > 10, F.col("value"))), 6).alias("mean"))


@add("f15_first_success", f"WITH {FRAMES} SELECT episode_index, min(CASE WHEN event_type = 'purchase' THEN frame_index END) AS first_success, least(coalesce(min(CASE WHEN event_type = 'purchase' THEN frame_index END) + 1, count(*)), 4) AS attempts FROM frames GROUP BY 1")
def f15(spark, sf):
    first = F.min(F.when(F.col("event_type") == "purchase", F.col("frame_index")))
    return frames(spark, sf).groupBy("episode_index").agg(first.alias("first_success"), F.least(F.coalesce(first + 1, F.count("*")), F.lit(4)).alias("attempts"))


@add("k02_rates_by_phase", """WITH r AS (SELECT user_id % 10 AS task, avg(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END) FILTER (event_id % 2 = 0) AS clean, avg(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END) FILTER (event_id % 2 = 1) AS random FROM events GROUP BY 1)
SELECT CAST(task AS VARCHAR) AS task, round(clean, 6) AS clean, round(random, 6) AS random FROM r UNION ALL SELECT '__overall__', round(avg(clean), 6), round(avg(random), 6) FROM r""")
def k02(spark, sf):
    phase = F.when(F.col("event_id") % 2 == 0, "clean").otherwise("random")
    r = table(spark, sf, "events").select((F.col("user_id") % 10).cast("string").alias("task"), phase.alias("phase"), (F.col("event_type") == "purchase").cast("double").alias("ok")).groupBy("task").pivot("phase", ["clean", "random"]).avg("ok")
    whole = r.agg(F.avg("clean").alias("clean"), F.avg("random").alias("random")).select(F.lit("__overall__").alias("task"), "clean", "random")
    return r.unionByName(whole).withColumns({c: signed_round(c, 6) for c in ("clean", "random")})


@add("k03_single_results", "SELECT user_id, count(*) AS n, count(*) = 1 AS valid FROM events WHERE event_type = 'purchase' AND value > 20 GROUP BY 1")
def k03(spark, sf):
    return table(spark, sf, "events").where("event_type = 'purchase' and value > 20").groupBy("user_id").agg(F.count("*").alias("n"), (F.count("*") == 1).alias("valid"))


@add("k05_task_results", f"WITH {FRAMES} SELECT episode_index, coalesce(string_agg(frame_index::VARCHAR, ',' ORDER BY frame_index) FILTER (event_type = 'purchase'), '') AS successes, count(*) FILTER (event_type <> 'purchase') AS failures FROM frames GROUP BY 1")
def k05(spark, sf):
    ok = F.col("event_type") == "purchase"
    return frames(spark, sf).groupBy("episode_index").agg(F.array_join(F.sort_array(F.collect_list(F.when(ok, F.col("frame_index")))).cast("array<string>"), ",").alias("successes"), F.count(F.when(~ok, 1)).alias("failures"))


@add("k06_completion", "SELECT count(*) AS total, count(*) FILTER (EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) AS done FROM customer")
def k06(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey")
    done = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("_d", F.lit(1))
    return c.join(done, "c_custkey", "left").agg(F.count("*").alias("total"), F.count("_d").alias("done"))


@add("k07_boundaries", "WITH d AS (SELECT DISTINCT user_id, value FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value) AS r FROM d) SELECT user_id, string_agg(round(value, 2)::VARCHAR, ',' ORDER BY value) AS first FROM r WHERE r <= 8 GROUP BY 1")
def k07(spark, sf):
    w = Window.partitionBy("user_id").orderBy("value")
    d = table(spark, sf, "events").select("user_id", "value").distinct().withColumn("_r", F.row_number().over(w)).where("_r <= 8")
    return d.groupBy("user_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("value")), lambda x: F.round(x, 2).cast("string")), ",").alias("first"))


@add("k09_readiness", "SELECT label, list_filter(['std' || CASE WHEN stddev_pop(embedding[1]::DOUBLE) <= 0.15 THEN '' ELSE '-' END, 'count' || CASE WHEN count(*) < 50 THEN '' ELSE '-' END], lambda x: NOT ends_with(x, '-')) AS failures FROM embeddings GROUP BY 1")
def k09(spark, sf):
    checks = [("std", F.stddev_pop(F.get("embedding", 0).cast("double")) <= 0.15), ("count", F.count("*") < 50)]
    messages = F.array_compact(F.array(*[F.when(c, F.lit(m)) for m, c in checks]))
    return table(spark, sf, "embeddings").groupBy("label").agg(messages.alias("failures"))


@add("k11_equivalence", "SELECT count(*) AS n, round(max(abs(value - round(value, 1))), 6) AS worst, max(abs(value - round(value, 1))) <= 0.051 AS equal FROM events")
def k11(spark, sf):
    d = F.abs(F.col("value") - F.round("value", 1))
    return table(spark, sf, "events").agg(F.count("*").alias("n"), F.round(F.max(d), 6).alias("worst"), (F.max(d) <= 0.051).alias("equal"))


@add("k12_bit_exact_audit", "SELECT CASE WHEN doc_id % 7 = 0 THEN 'missing' WHEN doc_id % 5 = 0 THEN 'different' ELSE 'equal' END AS status, count(*) AS n FROM documents GROUP BY 1")
def k12(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    other = d.where("doc_id % 7 <> 0").withColumn("h", F.when(F.col("doc_id") % 5 == 0, F.lit("x")).otherwise(F.col("h")))
    return differences(d, other, "doc_id", "h").groupBy("status").agg(F.count("*").alias("n"))


@add("k13_layout_audit", f"WITH {FRAMES} SELECT count(*) AS n, count(DISTINCT episode_index) AS episodes, sum(CASE WHEN frame_index < 0 THEN 1 ELSE 0 END)::BIGINT AS negative, count(*) - count(DISTINCT (episode_index, frame_index)) AS duplicates FROM frames")
def k13(spark, sf):
    f = frames(spark, sf)
    return f.agg(F.count("*").alias("n"), F.count_distinct("episode_index").alias("episodes"), F.sum((F.col("frame_index") < 0).cast("long")).alias("negative"), (F.count("*") - F.count_distinct("episode_index", "frame_index")).alias("duplicates"))


@add("h12_fixed_decimals", f"WITH {TASKS} SELECT task, CASE WHEN successes = 0 THEN 'N/A' ELSE CAST(CAST(round_even(100.0 * successes / trials, 1) AS DECIMAL(9, 1)) AS VARCHAR) END AS rate FROM t")
def h12(spark, sf):
    rate = F.when(F.col("successes") > 0, 100.0 * F.col("successes") / F.col("trials"))
    return tasks(spark, sf).select("task", fixed(F.bround(rate, 1), 1).alias("rate"))


def requests(spark, sf):
    """Every conversation turn as an act of its session, between a reset and a final."""
    c = table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("session"), "turn")
    w = Window.partitionBy("session").orderBy("turn")
    acts = c.select("session", (F.row_number().over(w)).cast("long").alias("seq"), F.lit("act").alias("kind"), F.lit(0).alias("attempt"), (F.row_number().over(w) - 1).cast("long").alias("step"))
    n = acts.groupBy("session").agg(F.count("*").alias("n"))
    resets = n.select("session", F.lit(0).cast("long").alias("seq"), F.lit("reset").alias("kind"), F.lit(0).alias("attempt"), F.lit(0).cast("long").alias("step"))
    finals = n.select("session", (F.col("n") + 1).alias("seq"), F.lit("final").alias("kind"), F.lit(0).alias("attempt"), F.col("n").alias("step"))
    return acts.unionByName(resets).unionByName(finals)


@add("j04_complete_groups", "SELECT CAST(conv_id AS VARCHAR) AS session, count(*) AS step, count(*) // 4 AS groups, 'ok' AS status, 0 AS attempt FROM conversations GROUP BY 1")
def j04(spark, sf):
    return lifecycle.latest(lifecycle.replay(requests(spark, sf)))


@add("j02_idempotent_steps", "SELECT DISTINCT conv_id, turn FROM (SELECT conv_id, turn FROM conversations UNION ALL SELECT conv_id, turn FROM conversations)")
def j02(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn")
    return c.unionByName(c).dropDuplicates(["conv_id", "turn"])


QUERIES, ORACLES = add.queries, add.oracles
