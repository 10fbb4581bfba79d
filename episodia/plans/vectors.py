"""Vector retrieval and diagnostics (F, C10, D14, D22, D27, E16, E17, K10)."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from episodia.operators import memory, retrieval as rt, sampling
from episodia.plans.common import BANK, LENGTHS, Registry, bank, lengths, signed_round
from episodia.session import table

add = Registry()
PAIRS = f"WITH {BANK}, p AS (SELECT q.id AS q_id, q.task AS q_task, b.id, b.task, b.episode, round(list_dot_product(q.unit, b.unit), 6) AS score FROM units q JOIN units b ON q.episode <> b.episode AND {{}}), k AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, id) AS rank FROM p)"


def everyone(spark, sf):
    """All rows as queries, and the bank."""
    b = bank(spark, sf)
    return b, b


@add("f01_same_task_topk", PAIRS.format("q.task = b.task") + " SELECT q_id, rank, id, score FROM k WHERE rank <= 4")
def f01(spark, sf):
    return rt.block_top_k(*everyone(spark, sf), 4, same_task=True).select("q_id", F.col("rank").cast("long").alias("rank"), "id", "score")


@add("f02_cross_task_topk", PAIRS.format("q.task <> b.task") + " SELECT q_id, rank, id, score FROM k WHERE rank <= 4")
def f02(spark, sf):
    return rt.block_top_k(*everyone(spark, sf), 4, same_task=False).select("q_id", F.col("rank").cast("long").alias("rank"), "id", "score")


@add("f04_softmax_context", PAIRS.format("q.task = b.task") + """, w AS (SELECT q_id, id, exp((score - max(score) OVER (PARTITION BY q_id)) / 0.1) AS e FROM k WHERE rank <= 4),
n AS (SELECT q_id, id, e / sum(e) OVER (PARTITION BY q_id) AS w FROM w), d AS (SELECT q_id, w, unnest(range(64)) AS dim, unnest(vector) AS x FROM n JOIN bank USING (id))
SELECT q_id, dim, round(sum(w * x), 5) AS value FROM d GROUP BY 1, 2""")
def f04(spark, sf):
    q, b = everyone(spark, sf)
    top = rt.block_top_k(q, b, 4, same_task=True).join(b.select("id", F.col("vector").alias("value")), "id")
    return rt.softmax_mean(top, "value", 0.1).select("q_id", F.col("dim").cast("long").alias("dim"), signed_round("value", 5).alias("value"))


@add("f06_neighbour_accuracy", PAIRS.format("true") + " SELECT q_task AS task, round(avg(CASE WHEN task = q_task THEN 1.0 ELSE 0.0 END), 6) AS top1, count(*) AS queries FROM k WHERE rank = 1 GROUP BY 1")
def f06(spark, sf):
    return _accuracy(*everyone(spark, sf))


def _accuracy(q, b):
    return rt.block_top_k(q, b, 1).groupBy(F.col("q_task").cast("int").alias("task")).agg(signed_round(F.avg((F.col("task") == F.col("q_task")).cast("double")), 6).alias("top1"), F.count("*").alias("queries"))


@add("d27_top5_hits", PAIRS.format("true") + " SELECT q_id, max(CASE WHEN task = q_task THEN 1 ELSE 0 END) = 1 AS hit FROM k WHERE rank <= 5 GROUP BY 1")
def d27(spark, sf):
    return _hits(*everyone(spark, sf))


def _hits(q, b):
    return rt.block_top_k(q, b, 5).groupBy("q_id").agg(F.bool_or(F.col("task") == F.col("q_task")).alias("hit"))


@add("f07_pair_cosine_means", PAIRS.format("true") + " SELECT q_task = task AS same_task, round(avg(score), 5) AS mean, count(*) AS pairs FROM p GROUP BY 1")
def f07(spark, sf):
    return rt.pair_means(*everyone(spark, sf)).withColumn("mean", signed_round("mean", 5))


@add("d14_prototypes", f"WITH {BANK}, d AS (SELECT task, unnest(range(64)) AS dim, unnest(vector) AS x FROM bank) SELECT task, dim, round(avg(x), 6) AS value, count(*) AS n FROM d GROUP BY 1, 2")
def d14(spark, sf):
    return rt.prototypes(bank(spark, sf), "task").select("task", F.col("dim").cast("long").alias("dim"), signed_round("value", 6).alias("value"), "n")


@add("d22_contrastive_metric", PAIRS.format("true") + """, l AS (SELECT q_id, q_task, task, score / 0.1 AS s, max(score / 0.1) OVER (PARTITION BY q_id) AS m FROM p)
SELECT q_id, round(avg(CASE WHEN task = q_task THEN s END) - max(m) - ln(sum(exp(s - m))), 5) AS log_prob FROM l GROUP BY 1 HAVING count(CASE WHEN task = q_task THEN 1 END) > 0""")
def d22(spark, sf):
    return rt.contrastive(*everyone(spark, sf)).select("q_id", signed_round("log_prob", 5).alias("log_prob"))


@add("e16_phase_progression", f"""WITH {BANK}, s AS (SELECT episode, id, unit, first_value(unit) OVER w AS a, last_value(unit) OVER w AS b, lead(unit) OVER (PARTITION BY episode ORDER BY id) AS n, count(*) OVER (PARTITION BY episode) AS c FROM units WINDOW w AS (PARTITION BY episode ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
d AS (SELECT episode, c, [b[i] - a[i] FOR i IN range(1, 65)] AS dir, [n[i] - unit[i] FOR i IN range(1, 65)] AS inc FROM s WHERE n IS NOT NULL AND c >= 3),
m AS (SELECT episode, c, round(list_dot_product(inc, [x / greatest(sqrt(list_dot_product(dir, dir)), 1e-12) FOR x IN dir]), 9) AS m FROM d)
SELECT episode, max(c) AS n, round(avg(abs(m)), 6) AS mean_abs, round(avg(CASE WHEN m > 0 THEN 1.0 ELSE 0.0 END), 6) AS positive, round(avg(CASE WHEN m >= 0.01 THEN 1.0 ELSE 0.0 END), 6) AS clear FROM m GROUP BY 1""")
def e16(spark, sf):
    p = rt.progression(bank(spark, sf))
    return p.select("episode", "n", *[signed_round(c, 6).alias(c) for c in ("mean_abs", "positive", "clear")])


@add("e17_adjacent_cosine", f"""WITH {BANK}, a AS (SELECT q.episode, round(list_dot_product(q.unit, b.unit), 6) AS adjacent, round(list_dot_product(q.unit, c.unit), 6) AS shifted FROM units q JOIN units b ON b.id = q.id + 1 AND b.episode = q.episode LEFT JOIN units c ON c.id = q.id + 2 AND c.episode = q.episode)
SELECT episode, round(avg(adjacent), 5) AS adjacent, round(avg(shifted), 5) AS shifted FROM a GROUP BY 1""")
def e17(spark, sf):
    w = Window.partitionBy("episode").orderBy("id")
    b = bank(spark, sf).withColumns({"_n": F.lead("unit").over(w), "_m": F.lead("unit", 2).over(w)}).where("_n is not null")
    score = lambda c: signed_round(F.avg(F.round(rt.dot(F.col("unit"), F.col(c)), 6)), 5)
    return b.groupBy("episode").agg(score("_n").alias("adjacent"), score("_m").alias("shifted"))


@add("k10_drift", f"""WITH {BANK}, c AS (SELECT task, round(list_dot_product(unit, [round(x, 1) FOR x IN unit]) / greatest(sqrt(list_dot_product([round(x, 1) FOR x IN unit], [round(x, 1) FOR x IN unit])), 1e-12), 6) AS c FROM units)
SELECT task, round(avg(c), 5) AS mean, round(quantile_cont(c, 0.05), 5) AS p05 FROM c GROUP BY 1""")
def k10(spark, sf):
    coarse = F.transform("unit", lambda x: F.round(x, 1))
    c = bank(spark, sf).withColumn("_c", coarse).select("task", F.round(rt.dot(F.col("unit"), F.col("_c")) / F.greatest(rt.norm(F.col("_c")), F.lit(1e-12)), 6).alias("c"))
    return c.groupBy("task").agg(signed_round(F.avg("c"), 5).alias("mean"), signed_round(F.percentile("c", F.lit(0.05)), 5).alias("p05"))


@add("c09_adjacent_intervals", "SELECT a.vec_id AS left_id, b.vec_id AS right_id FROM embeddings a JOIN embeddings b ON a.vec_id // 5 = b.vec_id // 5 AND a.vec_id + 1 = b.vec_id")
def c09(spark, sf):
    v = table(spark, sf, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 5).alias("e"))
    a, b = v.select(F.col("vec_id").alias("left_id"), "e", (F.col("vec_id") + 1).alias("end")), v.select(F.col("vec_id").alias("right_id"), "e", F.col("vec_id").alias("end"))
    return a.join(b, ["e", "end"]).select("left_id", "right_id")


@add("h14_l2_normalise", f"WITH {BANK} SELECT id, [round(x, 6) FOR x IN unit] AS unit FROM units")
def h14(spark, sf):
    return bank(spark, sf).select("id", F.transform("unit", lambda x: signed_round(x, 6)).alias("unit"))


@add("h21_pad_and_mask", "SELECT vec_id, list_concat([CAST(x AS DOUBLE) FOR x IN embedding[1:5]], [0.0, 0.0, 0.0]) AS padded, [true, true, true, true, true, false, false, false] AS mask FROM embeddings")
def h21(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.concat(F.slice(F.col("embedding").cast("array<double>"), 1, 5), F.array_repeat(F.lit(0.0), 3)).alias("padded"), F.concat(F.array_repeat(F.lit(True), 5), F.array_repeat(F.lit(False), 3)).alias("mask"))


@add("i01_merge_memory")
def i01(spark, sf):
    b = bank(spark, sf)
    rows = b.select("episode", F.col("id").alias("step"), F.lit(0).alias("attempt"), F.slice("vector", 1, 32).alias("phase"), F.slice("vector", 33, 32).alias("effect"))
    return memory.merge_memory(rows)


@add("i03_scope_violations", """WITH r AS (SELECT vec_id, label AS task, vec_id // 5 AS episode, (vec_id * 7) % 3 AS attempt FROM embeddings), l AS (SELECT *, attempt - lag(attempt) OVER w AS d, lag(task) OVER w AS pt FROM r WINDOW w AS (PARTITION BY episode ORDER BY vec_id))
SELECT vec_id AS step, coalesce(d NOT IN (0, 1), false) AS bad_attempt, coalesce(pt <> task, false) AS bad_task FROM l WHERE coalesce(d NOT IN (0, 1), false) OR coalesce(pt <> task, false)""")
def i03(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("step"), F.col("label").alias("task"), F.floor(F.col("vec_id") / 5).alias("episode"), ((F.col("vec_id") * 7) % 3).alias("attempt"))
    return memory.scope_violations(rows).select("step", "bad_attempt", "bad_task")


@add("f11_longest_first", f"""WITH RECURSIVE {LENGTHS}, l AS (SELECT episode_index AS id, length AS load, row_number() OVER (ORDER BY length DESC, episode_index) AS n FROM lengths),
s(n, id, load, rank, held) AS (SELECT 0::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, [0::BIGINT FOR x IN range(8)]
UNION ALL SELECT l.n, l.id, l.load, list_position(held, list_min(held)) - 1, list_transform(held, lambda x, i: CASE WHEN i = list_position(held, list_min(held)) THEN x + l.load ELSE x END) FROM s JOIN l ON l.n = s.n + 1)
SELECT id, load, rank FROM s WHERE n > 0""")
def f11(spark, sf):
    return sampling.longest_first(lengths(spark, sf).select(F.col("episode_index").alias("id"), F.col("length").alias("load")), 8)


for _name in ("f06_neighbour_accuracy", "d27_top5_hits", "f07_pair_cosine_means", "d22_contrastive_metric"):  # these names were given to the queries over every row
    add(f"{_name}_all", add.oracles[_name])(add.queries[_name])

QUERIES, ORACLES = add.queries, add.oracles
