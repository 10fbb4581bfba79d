"""Windows and segments over trajectories (E), scans of episodes (A), row predicates (B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from episodia.operators import cursors, memory, trajectories as tr
from episodia.plans.common import FRAMES, LENGTHS, Registry, frames, lengths, signed_round
from episodia.session import table
from episodia.sources import tables

add = Registry()


@add("a01_episodes_in_list_order", f"""WITH {FRAMES}, o(episode_index, episode_order) AS (VALUES (7, 0), (3, 1), (11, 2), (5, 3))
SELECT episode_order, episode_index, frame_index, round(value, 6) AS value FROM frames JOIN o USING (episode_index)""")
def a01(spark, sf):
    rows = tables.episodes(spark, f"{sf}/events.parquet", "user_id", [7, 3, 11, 5], ["user_id", "ts", "event_id", "value"], keep_order=True)
    return tr.index_frames(rows, "user_id", "ts", "event_id").select("episode_order", "episode_index", "frame_index", signed_round("value", 6).alias("value"))


@add("a02_episodes_sorted", "SELECT user_id AS episode_index, count(*) AS n, round(sum(value), 6) AS total FROM events WHERE user_id IN (3, 5, 7, 11) GROUP BY 1")
def a02(spark, sf):
    rows = tables.episodes(spark, f"{sf}/events.parquet", "user_id", sorted([7, 3, 11, 5]), ["user_id", "value"])
    return rows.groupBy(F.col("user_id").alias("episode_index")).agg(F.count("*").alias("n"), signed_round(F.sum("value"), 6).alias("total"))


@add("a07_strings_in_json", """SELECT word, count(*) AS n FROM (
  SELECT unnest(list_concat(json_keys(props), list_transform(json_keys(props), lambda k: json_extract_string(props, '$.' || k)))) AS word FROM events) GROUP BY 1""")
def a07(spark, sf):
    pairs = table(spark, sf, "events").select(F.explode(F.from_json("props", "map<string,string>")).alias("k", "v"))
    return pairs.select(F.explode(F.array("k", "v")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@add("a10_tasks_of_episode", "SELECT user_id AS episode_index, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS tasks FROM events GROUP BY 1")
def a10(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_type")
    return rows.groupBy(F.col("user_id").alias("episode_index")).agg(F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("tasks"))


@add("a12_frames_with_timestamps", f"WITH {FRAMES} SELECT episode_index, frame_index, round(frame_index / 30.0, 6) AS timestamp FROM frames")
def a12(spark, sf):
    return frames(spark, sf).select("episode_index", "frame_index", signed_round(F.col("frame_index") / 30.0, 6).alias("timestamp"))


@add("a13_episode_paths", f"WITH {LENGTHS} SELECT episode_index, episode_index // 1000 AS chunk, format('data/chunk-{{:03d}}/episode_{{:06d}}.parquet', episode_index // 1000, episode_index) AS path FROM lengths")
def a13(spark, sf):
    e = F.col("episode_index")
    return lengths(spark, sf).select(e, tables.chunk_of(e).alias("chunk"), tables.episode_path(e).alias("path"))


@add("a18_merged_ranks", """SELECT (vec_id % 3) AS rank, vec_id // 3 AS local_index, vec_id AS global_index FROM embeddings""")
def a18(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id")
    parts = [rows.where(F.col("vec_id") % 3 == r).select(F.lit(r).cast("long").alias("rank"), F.floor(F.col("vec_id") / 3).alias("local_index")) for r in range(3)]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return whole.withColumn("global_index", F.col("local_index") * 3 + F.col("rank"))


@add("a20_locate_rows", f"""WITH {LENGTHS}, b AS (SELECT episode_index, length, sum(length) OVER (ORDER BY episode_index) AS to_index FROM lengths)
SELECT event_id AS global_index, episode_index, CAST(event_id - (to_index - length) AS BIGINT) AS local_index FROM events JOIN b ON event_id >= to_index - length AND event_id < to_index""")
def a20(spark, sf):
    bounds = tr.episode_bounds(table(spark, sf, "events").select(F.col("user_id").alias("episode_index")))
    rows = table(spark, sf, "events").select(F.col("event_id").alias("global_index"))
    return tables.locate(rows, bounds, "global_index").select("global_index", "episode_index", "local_index")


@add("a31_surrogate_keys", """WITH known AS (SELECT event_type AS task, row_number() OVER (ORDER BY event_type) - 1 AS task_index FROM (SELECT DISTINCT event_type FROM events WHERE event_id < 5)),
fresh AS (SELECT DISTINCT event_type AS task FROM events WHERE event_type NOT IN (SELECT task FROM known))
SELECT task, task_index FROM known UNION ALL SELECT task, (SELECT max(task_index) FROM known) + row_number() OVER (ORDER BY task) FROM fresh""")
def a31(spark, sf):
    from episodia.operators.keys import assign_keys

    tasks = table(spark, sf, "events").select("event_id", F.col("event_type").alias("task"))
    known = assign_keys(spark.createDataFrame([], "task string, task_index long"), tasks.where("event_id < 5").select("task"))
    return assign_keys(known, tasks.select("task"))


@add("b06_window_validity", f"""WITH {FRAMES}, g AS (SELECT episode_index, frame_index // 8 AS w, list(value > 2 ORDER BY frame_index) AS ok FROM frames GROUP BY 1, 2)
SELECT episode_index, w, (len(list_filter(ok, lambda x: x)) > 0 AND len(list_filter(ok, lambda x: NOT x)) = 0 AND len(ok) = 8) AS valid FROM g""")
def b06(spark, sf):
    g = frames(spark, sf).groupBy("episode_index", F.floor(F.col("frame_index") / 8).alias("w")).agg(F.collect_list(F.col("value") > 2).alias("ok"))
    same = lambda x: x
    return g.select("episode_index", "w", (F.exists("ok", same) & F.forall("ok", same) & (F.size("ok") == 8)).alias("valid"))


@add("b07_finite_vectors", "SELECT vec_id, len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND embedding IS NOT NULL AS finite FROM embeddings")
def b07(spark, sf):
    from episodia.operators.validation import finite

    return table(spark, sf, "embeddings").select("vec_id", finite(F.col("embedding")).alias("finite"))


@add("b08_query_boundaries", f"WITH {FRAMES} SELECT episode_index, frame_index FROM frames WHERE frame_index % 16 = 0")
def b08(spark, sf):
    return frames(spark, sf).where(F.col("frame_index") % (4 * 4) == 0).select("episode_index", "frame_index")


@add("b09_temporal_violations", f"""WITH {FRAMES}, r AS (SELECT episode_index, frame_index AS step, frame_index + (CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END) AS start, frame_index + 16 AS stop, event_id % 2 = 0 AS is_query FROM frames)
SELECT count(*) AS n, sum(CASE WHEN is_query AND NOT (step = start) THEN 1 ELSE 0 END)::BIGINT AS query_bad, sum(CASE WHEN NOT is_query AND NOT (step = start AND start < stop AND stop - start = 16) THEN 1 ELSE 0 END)::BIGINT AS effect_bad FROM r""")
def b09(spark, sf):
    from episodia.operators.validation import temporal_violation

    r = frames(spark, sf).select(F.col("frame_index").alias("step"), (F.col("frame_index") + (F.col("event_id") % 97 == 0).cast("int")).alias("start"), (F.col("frame_index") + 16).alias("stop"), (F.col("event_id") % 2 == 0).alias("is_query"))
    bad = temporal_violation()
    return r.agg(F.count("*").alias("n"), F.sum((F.col("is_query") & bad).cast("long")).alias("query_bad"), F.sum((~F.col("is_query") & bad).cast("long")).alias("effect_bad"))


@add("b11_long_episodes", f"WITH {LENGTHS} SELECT episode_index, length FROM lengths WHERE length >= 70")
def b11(spark, sf):
    return lengths(spark, sf).where(F.col("length") >= 70)


@add("b13_unpadded_windows", f"WITH {FRAMES} SELECT episode_index, frame_index FROM frames JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) ON user_id = episode_index WHERE frame_index + 4 < n")
def b13(spark, sf):
    w = tr.delta_window(frames(spark, sf), "value", [0, 1, 2, 3, 4])
    return w.where(~F.exists("is_pad", lambda x: x)).select("episode_index", "frame_index")


@add("b17_protocol_fields", "SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT) >= 0, false) AND length(trim(event_type)) > 0 AND isfinite(value) AS valid FROM events")
def b17(spark, sf):
    k = F.expr("try_cast(get_json_object(props, '$.k') AS bigint)")
    ok = F.coalesce(k >= 0, F.lit(False)) & (F.length(F.trim("event_type")) > 0) & ~F.isnan("value") & (F.abs("value") < float("inf"))
    return table(spark, sf, "events").select("event_id", ok.alias("valid"))


OFFSETS = [-2, -1, 0, 1, 2, 3]


@add("e01_delta_window", f"""WITH {FRAMES}, n AS (SELECT episode_index, count(*) AS n FROM frames GROUP BY 1),
w AS (SELECT f.episode_index, f.frame_index, o.d, n.n, least(greatest(f.frame_index + o.d, 0), n.n - 1) AS at FROM frames f JOIN n USING (episode_index), (VALUES (-2), (-1), (0), (1), (2), (3)) o(d))
SELECT w.episode_index, w.frame_index, list(g.value ORDER BY d) AS "window", list(w.frame_index + d < 0 OR w.frame_index + d >= n ORDER BY d) AS is_pad
FROM w JOIN frames g ON g.episode_index = w.episode_index AND g.frame_index = w.at GROUP BY 1, 2""")
def e01(spark, sf):
    return tr.delta_window(frames(spark, sf), "value", OFFSETS).select("episode_index", "frame_index", "window", "is_pad")


@add("e04_sliding_replicated", f"""WITH {FRAMES}, n AS (SELECT episode_index, count(*) AS n FROM frames GROUP BY 1),
w AS (SELECT f.episode_index, f.frame_index, j, least(f.frame_index + j, n.n - 1) AS at FROM frames f JOIN n USING (episode_index), range(4) r(j))
SELECT w.episode_index, w.frame_index, round(sum(g.value * (j + 1)), 6) AS weighted FROM w JOIN frames g ON g.episode_index = w.episode_index AND g.frame_index = w.at GROUP BY 1, 2""")
def e04(spark, sf):
    w = tr.delta_window(frames(spark, sf), "value", [0, 1, 2, 3])
    return w.select("episode_index", "frame_index", signed_round(sum((F.get("window", j) * (j + 1) for j in range(4)), F.lit(0.0)), 6).alias("weighted"))


@add("e05_complete_windows", f"WITH {LENGTHS} SELECT episode_index, unnest(range(0, length - 32, 32)) AS start FROM lengths WHERE length >= 33")
def e05(spark, sf):
    return tr.complete_windows(lengths(spark, sf))


@add("e06_next_valid_windows", f"""WITH {FRAMES}, i AS (SELECT episode_index, frame_index, frame_index - row_number() OVER (PARTITION BY episode_index ORDER BY frame_index) AS island FROM frames WHERE value > 1.0),
l AS (SELECT episode_index, min(frame_index) AS first, count(*) AS n FROM i GROUP BY episode_index, island) SELECT episode_index, first + 8 * unnest(range(0, n // 8)) AS start FROM l""")
def e06(spark, sf):
    return tr.next_valid_windows(frames(spark, sf).withColumn("ok", F.col("value") > 1.0), 8, "ok")


@add("e06_greedy_cursor", f"""WITH RECURSIVE {FRAMES}, m AS (SELECT episode_index, frame_index FROM frames WHERE event_id % 3 <> 1),
w AS (SELECT episode_index, min(frame_index) AS start FROM m GROUP BY 1 UNION ALL SELECT w.episode_index, (SELECT min(m.frame_index) FROM m WHERE m.episode_index = w.episode_index AND m.frame_index >= w.start + 5) FROM w WHERE w.start IS NOT NULL)
SELECT episode_index, start FROM w WHERE start IS NOT NULL""")
def e06_greedy(spark, sf):
    """Windows of five steps from marked frames only, in blocks of 16 steps."""
    return cursors.greedy_windows(frames(spark, sf), 5, F.col("event_id") % 3 != 1, block=16)


@add("e07_strided_queries", f"WITH {LENGTHS} SELECT episode_index, unnest(range(0, length - 32, 4)) AS start FROM lengths WHERE length >= 33")
def e07(spark, sf):
    return tr.strided_queries(lengths(spark, sf))


@add("e08_coverage_starts", f"""WITH {LENGTHS}, l AS (SELECT episode_index, ((length - 33) // 4) * 4 AS last FROM lengths WHERE length >= 33)
SELECT DISTINCT episode_index, unnest(list_append(range(0, last + 1, 32), last)) AS start FROM l""")
def e08(spark, sf):
    return tr.coverage_starts(lengths(spark, sf))


@add("e09_irregular_steps", f"""WITH {FRAMES}, s AS (SELECT episode_index, frame_index, epoch(lead(ts) OVER (PARTITION BY episode_index ORDER BY frame_index)) - epoch(ts) AS d FROM frames)
SELECT episode_index, frame_index, round(d, 3) AS step_seconds FROM s WHERE abs(d - 3600.0) > 1800.0""")
def e09(spark, sf):
    rows = tr.irregular_steps(frames(spark, sf), F.unix_micros(F.col("ts").cast("timestamp")) / 1e6, 1 / 3600.0, 1800.0)
    return rows.select("episode_index", "frame_index", signed_round("step_seconds", 3).alias("step_seconds"))


@add("e10_transitions", f"""WITH {FRAMES}, f AS (SELECT *, lead(value) OVER (PARTITION BY episode_index ORDER BY frame_index) AS nxt FROM frames)
SELECT episode_index, frame_index // 4 AS transition_index, arg_min(value, frame_index) AS before, CASE WHEN max(frame_index) = max(CASE WHEN nxt IS NOT NULL THEN frame_index END) THEN arg_max(nxt, frame_index) END AS after,
       round(sum(value), 6) AS total, count(*) = 4 AND count(nxt) = 4 AS valid FROM f GROUP BY 1, 2""")
def e10(spark, sf):
    return tr.transitions(frames(spark, sf), "value").withColumn("total", signed_round("total", 6))


@add("e11_episode_index", f"WITH {LENGTHS} SELECT episode_index, length, CAST(sum(length) OVER (ORDER BY episode_index) - length AS BIGINT) AS from_index, CAST(sum(length) OVER (ORDER BY episode_index) AS BIGINT) AS to_index FROM lengths")
def e11(spark, sf):
    return tr.episode_bounds(table(spark, sf, "events").select(F.col("user_id").alias("episode_index")))


@add("e12_islands", f"""WITH {FRAMES}, k AS (SELECT *, frame_index - row_number() OVER (PARTITION BY episode_index ORDER BY frame_index) AS g FROM frames WHERE event_type <> 'error'),
i AS (SELECT episode_index, g, min(frame_index) AS first, max(frame_index) AS last, count(*) AS n FROM k GROUP BY 1, 2)
SELECT episode_index, row_number() OVER (PARTITION BY episode_index ORDER BY first) AS segment, first, last, n FROM i""")
def e12(spark, sf):
    return tr.islands(frames(spark, sf), F.col("event_type") != "error")


@add("e13_prefix_check", f"WITH {FRAMES} SELECT episode_index, min(frame_index) = 0 AND max(frame_index) = count(*) - 1 AS contiguous FROM frames GROUP BY 1")
def e13(spark, sf):
    return frames(spark, sf).groupBy("episode_index").agg(((F.min("frame_index") == 0) & (F.max("frame_index") == F.count("*") - 1)).alias("contiguous"))


@add("e14_last_effects", f"""WITH {FRAMES}, q AS (SELECT episode_index, frame_index AS raw_step FROM frames WHERE frame_index % 4 = 0),
e AS (SELECT episode_index, frame_index AS raw_step, value FROM frames WHERE frame_index % 16 = 0 AND frame_index > 0),
h AS (SELECT q.episode_index, q.raw_step, coalesce(list(e.value ORDER BY e.raw_step) FILTER (e.value IS NOT NULL), []) AS l FROM q LEFT JOIN e ON e.episode_index = q.episode_index AND e.raw_step <= q.raw_step GROUP BY 1, 2),
t AS (SELECT episode_index, raw_step, l[greatest(len(l) - 3, 1):] AS tail FROM h)
SELECT episode_index, raw_step, list_concat([0.0::DOUBLE FOR i IN range(4 - len(tail))], tail) AS effects, list_concat([false FOR i IN range(4 - len(tail))], [true FOR i IN range(len(tail))]) AS mask FROM t""")
def e14(spark, sf):
    f = frames(spark, sf)
    q = f.where(F.col("frame_index") % 4 == 0).select("episode_index", F.col("frame_index").alias("raw_step"), F.lit(True).alias("is_query"), F.lit(None).cast("double").alias("effect"), F.lit(-1).cast("long").alias("effect_index"))
    e = f.where((F.col("frame_index") % 16 == 0) & (F.col("frame_index") > 0)).select("episode_index", F.col("frame_index").alias("raw_step"), F.lit(False).alias("is_query"), F.col("value").alias("effect"), F.floor(F.col("frame_index") / 16).alias("effect_index"))
    return tr.last_effects(q.unionByName(e))


@add("e15_running_effects", f"WITH {FRAMES} SELECT episode_index, frame_index, row_number() OVER (PARTITION BY episode_index ORDER BY frame_index) - 1 AS effect_index FROM frames WHERE frame_index % 16 = 15")
def e15(spark, sf):
    f = frames(spark, sf).where(F.col("frame_index") % 16 == 15)
    return f.select("episode_index", "frame_index", (F.row_number().over(tr.episode()) - 1).cast("long").alias("effect_index"))


@add("e18_relative_to_first", f"WITH {FRAMES} SELECT episode_index, frame_index, round(value - first_value(value) OVER (PARTITION BY episode_index ORDER BY frame_index), 6) AS relative FROM frames")
def e18(spark, sf):
    return frames(spark, sf).select("episode_index", "frame_index", signed_round(F.col("value") - F.first("value").over(tr.episode()), 6).alias("relative"))


CHUNKS = f"WITH {FRAMES}, c AS (SELECT f.episode_index, f.frame_index + j AS step, j, f.value * (1 + j) AS v FROM frames f, range(4) r(j) WHERE f.frame_index % 2 = 0)"


def chunks(spark, sf):
    f = frames(spark, sf).where(F.col("frame_index") % 2 == 0)
    return f.select("episode_index", F.col("frame_index").alias("start"), F.array(*[F.col("value") * (1 + j) for j in range(4)]).alias("chunk"))


@add("e19_temporal_ensemble", CHUNKS + " SELECT episode_index, step, round(avg(v), 6) AS value, count(*) AS n FROM c GROUP BY 1, 2")
def e19(spark, sf):
    return tr.temporal_ensemble(chunks(spark, sf)).withColumn("value", signed_round("value", 6))


@add("e20_replanned_actions", CHUNKS + " SELECT episode_index, step, round(v, 6) AS value FROM c WHERE j < 2")
def e20(spark, sf):
    each = chunks(spark, sf).select("episode_index", "start", F.posexplode("chunk").alias("pos", "value")).where("pos < 2")
    return each.select("episode_index", (F.col("start") + F.col("pos")).alias("step"), signed_round("value", 6).alias("value"))


@add("e21_overlaps_agree", CHUNKS + " SELECT episode_index, step, max(v) - min(v) <= 1e-6 AS consistent, round(arg_min(v, step - j), 6) AS value FROM c GROUP BY 1, 2")
def e21(spark, sf):
    each = chunks(spark, sf).select("episode_index", "start", F.posexplode("chunk").alias("pos", "v"))
    return each.groupBy("episode_index", (F.col("start") + F.col("pos")).alias("step")).agg((F.max("v") - F.min("v") <= 1e-6).alias("consistent"), signed_round(F.min_by("v", "start"), 6).alias("value"))


@add("e22_subsampled_frames", f"WITH {FRAMES} SELECT episode_index, frame_index // 4 AS video_index, value FROM frames WHERE frame_index % 4 = 0")
def e22(spark, sf):
    return frames(spark, sf).where(F.col("frame_index") % 4 == 0).select("episode_index", F.floor(F.col("frame_index") / 4).alias("video_index"), "value")


COUNTS = f"WITH {LENGTHS}, c AS (SELECT episode_index, ((length - 33) // 4) * 4 AS last_query FROM lengths WHERE length >= 33)"


@add("i10_cache_records", COUNTS + """, n AS (SELECT *, ((last_query + 32) // 4) // 4 AS effects FROM c)
SELECT episode_index, unnest(range(0, last_query + 1, 4)) AS raw_step, true AS is_query, NULL::BIGINT AS effect_index FROM n
UNION ALL SELECT episode_index, i * 16, false, i - 1 FROM (SELECT episode_index, unnest(range(1, effects + 1)) AS i FROM n)""")
def i10(spark, sf):
    return memory.cache_records(lengths(spark, sf))


@add("i11_record_counts", COUNTS + " SELECT episode_index, last_query, last_query // 4 + 1 AS queries, ((last_query + 32) // 4) // 4 AS effects FROM c")
def i11(spark, sf):
    return memory.record_counts(lengths(spark, sf))


@add("f10_canonical_order", COUNTS + """, n AS (SELECT *, ((last_query + 32) // 4) // 4 AS effects FROM c),
r AS (SELECT episode_index, unnest(range(0, last_query + 1, 4)) AS raw_step, 1 AS q FROM n UNION ALL SELECT episode_index, i * 16, 0 FROM (SELECT episode_index, unnest(range(1, effects + 1)) AS i FROM n))
SELECT CAST(episode_index AS VARCHAR) AS episode_id, raw_step, q = 1 AS is_query, row_number() OVER (PARTITION BY episode_index ORDER BY raw_step, q) AS place FROM r""")
def f10(spark, sf):
    from pyspark.sql import Window

    r = memory.cache_records(lengths(spark, sf)).withColumn("episode_id", F.col("episode_index").cast("string"))
    w = Window.partitionBy("episode_id").orderBy("raw_step", F.col("is_query").cast("int"), F.coalesce("effect_index", F.lit(-1)))
    return r.select("episode_id", "raw_step", "is_query", F.row_number().over(w).cast("long").alias("place"))


QUERIES, ORACLES = add.queries, add.oracles
