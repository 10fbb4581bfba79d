"""Metadata, contracts, mappings, offsets and the memory's lifecycle (A, B, C04, C07, D03, E02, F05, F10, H03, H05, H22, H33, H35, H36, I05-I09, K08)."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from episodia.functions import halves, text as tx
from episodia.operators import metadata as md, retrieval as rt
from episodia.plans.common import BANK, FRAMES, LENGTHS, Registry, bank, frames, lengths, signed_round
from episodia.session import table
from episodia.sources.scratch import folder

add = Registry()
TASKS = "t AS (SELECT event_type AS task, row_number() OVER (ORDER BY event_type) - 1 AS task_index FROM (SELECT DISTINCT event_type FROM events))"


@add("a03_replicated_stats", f"WITH {LENGTHS}, s AS (SELECT event_type AS feature, min(value) AS low, max(value) AS high FROM events GROUP BY 1) SELECT episode_index, feature, low, high FROM lengths CROSS JOIN s")
def a03(spark, sf):
    stats = table(spark, sf, "events").groupBy(F.col("event_type").alias("feature")).agg(F.min("value").alias("low"), F.max("value").alias("high"))
    return md.per_episode_stats("v2.0", stats, lengths(spark, sf))


@add("a04_episodes_without_stats", f"WITH {LENGTHS} SELECT episode_index, length FROM lengths")
def a04(spark, sf):
    md.require_version("v3.0", "v3")
    episodes = frames(spark, sf).groupBy("episode_index").agg(F.count("*").alias("length"), F.min("value").alias("stats/value/min"), F.max("value").alias("stats/value/max"))
    return md.without_stats(episodes)


@add("a08_task_table", "SELECT label AS task_index, 'pick item ' || label AS task FROM (SELECT DISTINCT label FROM embeddings)")
def a08(spark, sf):
    found = table(spark, sf, "embeddings").select(F.col("label").alias("task_index")).distinct()
    return md.task_table(found.withColumn("__index_level_0__", F.concat(F.lit("pick item "), "task_index")))


@add("a26_remaining_rows", "SELECT vec_id FROM embeddings WHERE vec_id >= (SELECT count(*) // 3 FROM embeddings)")
def a26(spark, sf):
    v = table(spark, sf, "embeddings").select("vec_id")
    done = v.agg(F.floor(F.count("*") / 3).alias("next_offset")).withColumn("_one", F.lit(1))
    return v.withColumn("_one", F.lit(1)).join(F.broadcast(done), "_one").where("vec_id >= next_offset").select("vec_id")


@add("a28_cached_context", "SELECT vec_id, [CASE WHEN i % 3 = 0 THEN 0.0 ELSE CAST(embedding[i] AS DOUBLE) END FOR i IN range(1, 65)] AS context FROM embeddings")
def a28(spark, sf):
    v = table(spark, sf, "embeddings").select("vec_id", F.concat(F.lit("prompt "), "vec_id").alias("prompt"), F.col("embedding").cast("array<double>").alias("context"))
    mask = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: i % 3 != 0)
    cache = v.select(F.concat(F.sha2("prompt", 256), F.lit(".t5")).alias("file"), "context", mask.alias("mask"))
    return md.cached_context(v.select("vec_id", "prompt"), cache, ".t5").select("vec_id", "context")


@add("b03_shape_violations", "SELECT vec_id, len(embedding) AS found FROM embeddings WHERE len(embedding) <> 64 - vec_id % 2")
def b03(spark, sf):
    v = table(spark, sf, "embeddings").select("vec_id", F.size("embedding").cast("long").alias("found"), (64 - F.col("vec_id") % 2).alias("wanted"))
    return v.where(F.size(md.problems({"shape": F.col("found") == F.col("wanted")})) > 0).select("vec_id", "found")


@add("b05_buffer_problems", f"WITH {FRAMES}, e AS (SELECT episode_index, count(*) AS n, max(frame_index) AS top FROM frames WHERE frame_index % 7 <> 3 GROUP BY 1) SELECT episode_index, ['numbers'] AS problems FROM e WHERE top <> n - 1")
def b05(spark, sf):
    f = frames(spark, sf).where("frame_index % 7 <> 3")
    episodes = f.groupBy("episode_index").agg(F.collect_list("event_id").alias("frames"), F.first("event_type").alias("task"), F.sort_array(F.collect_list(F.col("frame_index").cast("long"))).alias("indices"))
    return md.buffer_problems(episodes)


@add("b10_cache_row_problems", f"""WITH {FRAMES}, r AS (SELECT event_id, frame_index * 2 AS start, frame_index * 2 + (CASE WHEN frame_index % 5 = 0 THEN 16 ELSE 12 END) AS stop, event_id % 2 = 0 AS is_query FROM frames)
SELECT event_id, list_filter([CASE WHEN start % 4 <> 0 OR stop % 4 <> 0 THEN 'step' END, CASE WHEN NOT is_query AND stop - start <> 16 THEN 'length' END], lambda x: x IS NOT NULL) AS problems FROM r
WHERE start % 4 <> 0 OR stop % 4 <> 0 OR (NOT is_query AND stop - start <> 16)""")
def b10(spark, sf):
    start = F.col("frame_index") * 2
    rows = frames(spark, sf).select("event_id", start.alias("start"), (start + F.when(F.col("frame_index") % 5 == 0, 16).otherwise(12)).alias("stop"), (F.col("event_id") % 2 == 0).alias("is_query"))
    return md.cache_row_problems(rows).select("event_id", "problems")


@add("c04_segments", f"""WITH s AS (SELECT r_regionkey AS ordinal, 40 + 7 * r_regionkey AS size FROM region), b AS (SELECT ordinal, size, coalesce(sum(size) OVER (ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM s)
SELECT c_custkey AS row, ordinal, CAST(c_custkey - start AS BIGINT) AS local FROM customer LEFT JOIN b ON start <= c_custkey AND c_custkey < start + size""")
def c04(spark, sf):
    sizes = table(spark, sf, "region").select(F.col("r_regionkey").alias("ordinal"), (40 + 7 * F.col("r_regionkey")).cast("long").alias("size"))
    return md.segment_rows(sizes, table(spark, sf, "customer").select(F.col("c_custkey").alias("row")))


@add("c07_plan_with_cache", "SELECT vec_id, 'task-' || (vec_id // 5 % 10) AS task_id FROM embeddings")
def c07(spark, sf):
    plan = table(spark, sf, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 5).alias("episode"))
    cache = plan.select("episode").distinct().withColumn("task_id", F.concat(F.lit("task-"), F.col("episode") % 10))
    return md.must_match(plan, cache, "episode", "task_id").select("vec_id", "task_id")


@add("d03_stats_problems", "SELECT label, ['order'] AS problems FROM embeddings GROUP BY label HAVING min(CAST(embedding[1] AS DOUBLE)) > max(CAST(embedding[1] AS DOUBLE)) - 0.9")
def d03(spark, sf):
    x = F.element_at("embedding", 1).cast("double")
    stats = table(spark, sf, "embeddings").groupBy("label").agg(*[F.array(c).alias(n) for n, c in (("mean", F.avg(x)), ("std", F.stddev_pop(x)), ("min", F.min(x)), ("max", F.max(x) - 0.9), ("count", F.count("*")))])
    return md.stats_problems(stats).select("label", "problems")


@add("e02_frame_offsets", "SELECT vec_id, [CAST(round_even((vec_id % 50 + t) / 10.0 * 10, 0) AS BIGINT) FOR t IN range(-2, 4)] AS offsets FROM embeddings")
def e02(spark, sf):
    seconds = F.array(*[(F.col("vec_id") % 50) / 10.0 + F.lit(s) for s in md.window_offsets(2, 6, fps=10.0)])
    return table(spark, sf, "embeddings").select("vec_id", md.frame_offsets(seconds, 10.0).alias("offsets"))


@add("f05_other_rows_topk", f"WITH {BANK}, p AS (SELECT q.id AS q_id, b.id, round(list_dot_product(q.unit, b.unit), 6) AS score FROM units q JOIN units b ON q.id <> b.id AND q.task = b.task), k AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, id) AS rank FROM p) SELECT q_id, rank, id, score FROM k WHERE rank <= 4")
def f05(spark, sf):
    b = bank(spark, sf).withColumn("episode", F.col("id"))  # a row is an episode of its own: only itself is left out
    return rt.block_top_k(b, b, 4, same_task=True).select("q_id", F.col("rank").cast("long").alias("rank"), "id", "score")


@add("f10_order_violations", "WITH l AS (SELECT vec_id, label, lag(label) OVER (PARTITION BY vec_id // 5 ORDER BY vec_id) AS before FROM embeddings) SELECT vec_id FROM l WHERE before > label")
def f10(spark, sf):
    v = table(spark, sf, "embeddings").select("vec_id", "label", F.floor(F.col("vec_id") / 5).alias("episode"))
    return md.order_violations(v, "label", group="episode", by="vec_id").select("vec_id")


@add("h03_names_from_paths", """WITH n AS (SELECT 'task_' || n_nationkey AS name FROM nation), p AS (SELECT c_custkey, '/data/' || CASE c_custkey % 3 WHEN 0 THEN 'task_' || c_nationkey WHEN 1 THEN 'task_' || c_nationkey || '_clean' ELSE 'run_task_' || c_nationkey END || '/x' AS path FROM customer)
SELECT path, 'task_' || any_value(regexp_extract(path, 'task_([0-9]+)', 1)) AS name FROM p GROUP BY path""")
def h03(spark, sf):
    c = table(spark, sf, "customer")
    own = F.concat(F.lit("task_"), "c_nationkey")
    part = F.when(F.col("c_custkey") % 3 == 0, own).when(F.col("c_custkey") % 3 == 1, F.concat(own, F.lit("_clean"))).otherwise(F.concat(F.lit("run_"), own))
    paths = c.select(F.concat(F.lit("/data/"), part, F.lit("/x")).alias("path")).distinct()
    names = table(spark, sf, "nation").select(F.concat(F.lit("task_"), "n_nationkey").alias("name"))
    return md.canonical_from_path(paths, names).select("path", "name")


@add("h05_mapped_tasks", """SELECT vec_id, CASE WHEN vec_id // 5 % 4 = 0 THEN 'layout-' || (vec_id // 5 % 3) WHEN label < 3 THEN 'index-' || label WHEN label < 5 THEN 'text-' || label WHEN label < 8 THEN 'cache-' || label END AS name,
CASE WHEN vec_id // 5 % 4 = 0 THEN 'layout' WHEN label < 3 THEN 'manual index' WHEN label < 5 THEN 'manual text' WHEN label < 8 THEN 'cache text' END AS origin, vec_id // 5 % 4 = 0 AND label < 8 AS conflict FROM embeddings""")
def h05(spark, sf):
    v = table(spark, sf, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 5).alias("episode"), F.col("label").alias("task_index"), F.concat(F.lit("do "), "label").alias("text"))
    own = v.select("task_index", "text").distinct()
    index = own.where("task_index < 3").select("task_index", F.concat(F.lit("index-"), "task_index").alias("name"))
    manual = own.where("task_index < 5").select("text", F.concat(F.lit("text-"), "task_index").alias("name"))
    cache = own.where("task_index < 8").select("text", F.concat(F.lit("cache-"), "task_index").alias("name"))
    cache = cache.unionByName(own.where("task_index >= 8").select("text", F.explode(F.array(F.lit("one"), F.lit("other"))).alias("name")))
    layout = v.select("episode").distinct().where("episode % 4 = 0").withColumn("name", F.concat(F.lit("layout-"), F.col("episode") % 3))
    return md.mapped_tasks(v, index, manual, cache, layout).select("vec_id", "name", "origin", "conflict")


@add("h22_padded_deltas", "SELECT vec_id, [CASE WHEN i <= vec_id % 6 AND i % 2 = 0 THEN 0.0 ELSE CAST(embedding[i] AS DOUBLE) END FOR i IN range(1, 9)] AS action FROM embeddings")
def h22(spark, sf):
    place = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: (i <= F.col("vec_id") % 6) & (i % 2 == 0))
    action = F.zip_with(F.slice(F.col("embedding").cast("array<double>"), 1, 8), place, lambda x, gone: F.when(gone, F.lit(0.0)).otherwise(x))
    return table(spark, sf, "embeddings").select("vec_id", action.alias("action"))


@add("h33_upper_half_floats", "SELECT vec_id, CAST(CASE WHEN embedding[1] < 0 THEN -1 ELSE 1 END AS BIGINT) AS sign FROM embeddings")
def h33(spark, sf):
    bits = halves.upper_half_bits(F.element_at("embedding", 1).cast("float"))
    back = halves.upper_half_float(bits)
    v = table(spark, sf, "embeddings").select("vec_id", F.element_at("embedding", 1).cast("double").alias("x"), back.alias("y"))
    near = F.abs(F.col("y") - F.col("x")) <= F.abs("x") / 256
    return v.select("vec_id", F.when(~near, F.lit(0)).when(F.col("y") < 0, F.lit(-1)).otherwise(F.lit(1)).cast("long").alias("sign"))


@add("h35_cameras", "SELECT vec_id, list_concat([CAST(x AS DOUBLE) FOR x IN embedding[1:CAST(least(vec_id % 5, 3) AS INTEGER)]], [0.0 FOR x IN range(3 - least(vec_id % 5, 3))]) AS cameras FROM embeddings")
def h35(spark, sf):
    held = F.slice(F.col("embedding").cast("array<double>"), F.lit(1), (F.col("vec_id") % 5).cast("int"))
    return table(spark, sf, "embeddings").select("vec_id", F.slice(F.concat(held, F.array_repeat(F.lit(0.0), 3)), 1, 3).alias("cameras"))


@add("h36_cosine_schedule", "SELECT vec_id, round(CASE WHEN vec_id < 20 THEN vec_id / 20.0 ELSE 0.01 + 0.99 * 0.5 * (1 + cos(pi() * least((vec_id - 20) / 180.0, 1.0))) END, 9) AS rate FROM embeddings")
def h36(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", signed_round(tx.cosine_schedule(F.col("vec_id"), 20, 200), 9).alias("rate"))


LIFE = f"""WITH {FRAMES}, k AS (SELECT episode_index, frame_index, event_id, CASE WHEN event_id % 11 = 0 THEN 'reset' WHEN event_id % 7 = 0 THEN 'end' WHEN event_id % 3 = 0 THEN 'query' ELSE 'effect' END AS kind FROM frames),
t AS (SELECT *, sum(CASE WHEN kind = 'reset' THEN 1 ELSE 0 END) OVER w AS session, sum(CASE WHEN kind IN ('end', 'reset') THEN 1 ELSE 0 END) OVER w AS attempt FROM k WINDOW w AS (PARTITION BY episode_index ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def life(spark, sf):
    e = F.col("event_id")
    kind = F.when(e % 11 == 0, "reset").when(e % 7 == 0, "end").when(e % 3 == 0, "query").otherwise("effect")
    return frames(spark, sf).select(F.col("episode_index").alias("episode"), F.col("frame_index").alias("place"), kind.alias("kind"), F.when(kind == "effect", e).alias("effect"))


@add("i05_memory_inputs", LIFE + """, q AS (SELECT q.episode_index AS episode, q.frame_index AS place, (SELECT list(e.event_id ORDER BY e.frame_index DESC) FROM t e WHERE e.episode_index = q.episode_index AND e.attempt = q.attempt AND e.kind = 'effect' AND e.frame_index < q.frame_index) AS back,
(SELECT count(*) FROM t e WHERE e.episode_index = q.episode_index AND e.session = q.session AND e.kind = 'effect' AND e.frame_index < q.frame_index) AS kept FROM t q WHERE q.kind = 'query')
SELECT episode, place, coalesce(list_reverse(back[1:4]), []) AS recent, kept FROM q""")
def i05(spark, sf):
    return md.memory_inputs(life(spark, sf)).select("episode", "place", "recent", "kept")


@add("i07_irregular_history", f"WITH {FRAMES}, s AS (SELECT episode_index AS episode, frame_index * 4 AS raw_step FROM frames WHERE event_id % 9 <> 0), l AS (SELECT *, raw_step - lag(raw_step) OVER (PARTITION BY episode ORDER BY raw_step) AS gap FROM s) SELECT episode, raw_step, gap FROM l WHERE gap <> 4")
def i07(spark, sf):
    rows = frames(spark, sf).where("event_id % 9 <> 0").select(F.col("episode_index").alias("episode"), (F.col("frame_index") * 4).alias("raw_step"))
    return md.irregular_history(rows)


@add("i09_phase_at_step", f"WITH {FRAMES} SELECT event_id, (frame_index - frame_index % 4) / 4 AS phase FROM frames")
def i09(spark, sf):
    f = frames(spark, sf).select("event_id", "episode_index", (F.col("frame_index") - F.col("frame_index") % 4).alias("boundary"))
    seen = f.select("episode_index", "boundary").distinct().withColumn("phase", F.col("boundary") / 4)
    keyed = lambda d: d.withColumn("key", F.concat_ws(":", "episode_index", "boundary"))
    return md.must_match(keyed(f), keyed(seen), "key", "phase").select("event_id", "phase")


@add("j07_retrieval_trace", f"WITH {BANK}, p AS (SELECT q.id AS q_id, b.id, round(list_dot_product(q.unit, b.unit), 6) AS score FROM units q JOIN units b ON q.episode <> b.episode AND q.task = b.task), k AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, id) AS rank FROM p) SELECT q_id, list(id ORDER BY rank) AS ids, list(score ORDER BY rank) AS scores FROM k WHERE rank <= 3 GROUP BY 1")
def j07(spark, sf):
    b = bank(spark, sf)
    found = F.sort_array(F.collect_list(F.struct("rank", "id", "score")))
    return rt.block_top_k(b, b, 3, same_task=True).groupBy("q_id").agg(found.alias("m")).select("q_id", F.col("m.id").alias("ids"), F.col("m.score").alias("scores"))


@add("k04_retry_problems", f"""WITH {FRAMES}, a AS (SELECT episode_index, frame_index // 3 AS seed, count(*) AS attempts, count(*) FILTER (WHERE value > 50) AS counted, count(DISTINCT event_type) AS instructions FROM frames GROUP BY 1, 2)
SELECT episode_index, seed, list_filter([CASE WHEN counted <> 1 THEN 'counted' END, CASE WHEN instructions <> 1 THEN 'instruction' END], lambda x: x IS NOT NULL) AS problems FROM a WHERE counted <> 1 OR instructions <> 1""")
def k04(spark, sf):
    a = frames(spark, sf).groupBy("episode_index", F.floor(F.col("frame_index") / 3).alias("seed")).agg(F.count_if(F.col("value") > 50).alias("counted"), F.countDistinct("event_type").alias("instructions"))
    return a.withColumn("problems", md.problems({"counted": F.col("counted") == 1, "instruction": F.col("instructions") == 1})).where(F.size("problems") > 0).select("episode_index", "seed", "problems")


@add("k08_validation_report", "SELECT count(*) AS rows, count(DISTINCT vec_id) AS ids, count(*) FILTER (WHERE len(embedding) <> 64) AS bad_shapes, count(*) FILTER (WHERE label < 0) AS bad_labels, count(*) FILTER (WHERE len(embedding) <> 64 OR label < 0) = 0 AND count(*) = count(DISTINCT vec_id) AS valid FROM embeddings")
def k08(spark, sf):
    v = table(spark, sf, "embeddings")
    one = v.groupBy("vec_id").agg(F.count("*").alias("n"), F.count_if(F.size("embedding") != 64).alias("s"), F.count_if(F.col("label") < 0).alias("l"))
    report = one.agg(F.sum("n").alias("rows"), F.count("*").alias("ids"), F.sum("s").alias("bad_shapes"), F.sum("l").alias("bad_labels"))
    return report.withColumn("valid", (F.col("bad_shapes") == 0) & (F.col("bad_labels") == 0) & (F.col("rows") == F.col("ids")))


@add("a26_resumed_parts", """WITH r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS place, count(*) OVER (PARTITION BY label) AS n FROM embeddings)
SELECT vec_id, label, place FROM r WHERE label % 3 = 0 OR place >= n // (1 + label % 3)""")
def a26_resumed(spark, sf):
    """Every task is a part; some have written how far they came, the others start again."""
    v = table(spark, sf, "embeddings").select("vec_id", "label")
    v = v.withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).cast("long") - 1)
    path = folder(spark)
    n = v.groupBy("label").agg(F.count("*").alias("total")).where("label % 3 <> 0")
    md.write_progress(n.select(F.col("label").alias("part"), "total", F.floor(F.col("total") / (1 + F.col("label") % 3)).alias("next_offset")), path)
    return md.remaining(v, path, "label")


@add("f10_order_of_the_table", "WITH l AS (SELECT event_id, user_id, lag(user_id) OVER (ORDER BY event_id) AS before FROM events) SELECT event_id FROM l WHERE before > user_id")
def f10_whole(spark, sf):
    """One order of all rows, by ranges."""
    return md.order_violations(table(spark, sf, "events").select("event_id", "user_id"), "user_id", by="event_id").select("event_id")


@add("h33_half_bits", """WITH d AS (SELECT vec_id, unnest(range(64)) AS dim, unnest(embedding)::FLOAT::DOUBLE AS x FROM embeddings),
e AS (SELECT *, floor(log2(abs(x))) AS e0 FROM d WHERE x <> 0), f AS (SELECT *, CASE WHEN abs(x) / pow(2, e0) >= 2 THEN e0 + 1 WHEN abs(x) / pow(2, e0) < 1 THEN e0 - 1 ELSE e0 END AS e1 FROM e),
k AS (SELECT *, round_even((abs(x) / pow(2, e1) - 1) * 128, 0) AS k0 FROM f), n AS (SELECT *, CASE WHEN k0 = 128 THEN e1 + 1 ELSE e1 END AS ex, CASE WHEN k0 = 128 THEN 0 ELSE k0 END AS k1 FROM k)
SELECT vec_id, dim, (CASE WHEN x < 0 THEN 32768 ELSE 0 END + (ex + 127) * 128 + k1)::INTEGER AS bits, sign(x) * (1 + k1 / 128) * pow(2, ex) AS value FROM n""")
def h33_bits(spark, sf):
    """The bits of all dimensions, and the numbers they stand for."""
    d = table(spark, sf, "embeddings").select("vec_id", F.posexplode(F.col("embedding").cast("array<float>")).alias("dim", "x")).where("x <> 0")
    d = d.select("vec_id", F.col("dim").cast("long").alias("dim"), halves.upper_half_bits("x").alias("bits"))
    return d.withColumn("value", halves.upper_half_float("bits").cast("double"))


@add("k08_report_of_checks", """SELECT count(*) AS rows, count(DISTINCT l_orderkey * 10 + l_linenumber) AS ids, count(*) FILTER (WHERE l_quantity <= 0) AS bad_quantity, count(*) FILTER (WHERE NOT l_discount < 0.1) AS bad_discount, count(*) FILTER (WHERE NOT l_tax < 0.08) AS bad_tax, 'failed' AS status FROM lineitem""")
def k08_checks(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("line", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return md.validation_report(rows, "line", {"quantity": F.col("l_quantity") > 0, "discount": F.col("l_discount") < 0.1, "tax": F.col("l_tax") < 0.08})


QUERIES, ORACLES = add.queries, add.oracles
