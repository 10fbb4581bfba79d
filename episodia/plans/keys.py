"""Lookups, keys, de-duplication, sampling and text (C, G, H01-H12)."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from episodia.functions import text as tx
from episodia.operators import keys as ky, sampling as sm, validation as va
from episodia.plans.common import FRAMES, LENGTHS, Registry, frames, lengths, signed_round
from episodia.session import table
from episodia.sources import tables

add = Registry()
MD5 = "md5(CAST({0} AS VARCHAR) || ':{1}')"


@add("c01_frames_with_tasks", "WITH t AS (SELECT event_type AS task, row_number() OVER (ORDER BY event_type) - 1 AS task_index FROM (SELECT DISTINCT event_type FROM events)) SELECT event_id, task_index, task FROM events JOIN t ON task = event_type")
def c01(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("event_type").alias("task"))
    tasks = ky.assign_keys(spark.createDataFrame([], "task string, task_index long"), e.select("task"))
    return e.join(tasks, "task")


@add("c02_semantic_resolve", """SELECT vec_id, CASE WHEN vec_id // 5 % 3 = 0 THEN 'episode-' || (vec_id // 5) WHEN label < 5 THEN 'index-' || label WHEN label < 8 THEN 'raw-' || label ELSE 'unknown-task' END AS resolved FROM embeddings""")
def c02(spark, sf):
    v = table(spark, sf, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 5).alias("episode"), F.col("label").cast("long").alias("task_index"))
    by_episode = v.select("episode").distinct().where("episode % 3 = 0").withColumn("name", F.concat(F.lit("episode-"), F.col("episode")))
    by_index = v.select("task_index").distinct().where("task_index < 5").withColumn("name", F.concat(F.lit("index-"), F.col("task_index")))
    raw = F.when(F.col("task_index") < 8, F.concat(F.lit("raw-"), F.col("task_index")))
    return ky.resolve(v, by_episode, by_index, raw).select("vec_id", "resolved")


@add("c03_remapped_episode_ids", "SELECT vec_id, 'task-' || (vec_id // 5 % 10) || '::episode-' || (vec_id // 5) AS id FROM embeddings")
def c03(spark, sf):
    old = table(spark, sf, "embeddings").select("vec_id", F.concat(F.lit("raw::episode-"), F.floor(F.col("vec_id") / 5)).alias("old"))
    number = F.regexp_extract("old", r"::episode-(\d+)$", 1).cast("long")
    return old.select("vec_id", F.concat(F.lit("task-"), number % 10, F.lit("::episode-"), number).alias("id"))


@add("c05_nearest_timestamp", f"""WITH {FRAMES}, p AS (SELECT episode_index AS u, epoch_us(ts) / 1e6 AS t FROM frames WHERE frame_index % 3 = 0), q AS (SELECT event_id AS id, episode_index AS u, epoch_us(ts) / 1e6 AS t FROM frames WHERE frame_index % 3 = 1),
m AS (SELECT q.id, q.t, arg_min(p.t, (abs(p.t - q.t), p.t)) AS n FROM q JOIN p USING (u) GROUP BY 1, 2) SELECT id, round(n, 6) AS nearest, abs(n - t) < 3600.0 AS matched FROM m""")
def c05(spark, sf):
    f = frames(spark, sf).select("event_id", "frame_index", F.col("episode_index").alias("u"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    q, p = f.where("frame_index % 3 = 1").select(F.col("event_id").alias("id"), "u", "t"), f.where("frame_index % 3 = 0").select("u", "t")
    return ky.nearest(q, p, "u", "t", 3600.0).select("id", signed_round("nearest", 6).alias("nearest"), "matched")


@add("c06_expected_frames", "SELECT event_id, CAST(round_even(value * 10, 0) AS BIGINT) AS frame FROM events")
def c06(spark, sf):
    return table(spark, sf, "events").select("event_id", F.bround(F.col("value") * 10).cast("long").alias("frame"))


@add("c08_aligned_episodes", """WITH a AS (SELECT DISTINCT user_id AS e FROM events WHERE event_type = 'error'), b AS (SELECT DISTINCT user_id AS e FROM events WHERE event_type = 'purchase' AND value > 20)
SELECT coalesce(a.e, b.e) AS episode_index, CASE WHEN a.e IS NULL THEN 'extra' WHEN b.e IS NULL THEN 'missing' ELSE 'equal' END AS status FROM a FULL JOIN b ON a.e = b.e""")
def c08(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("episode_index"), "event_type", "value")
    a, b = e.where("event_type = 'error'").select("episode_index").distinct(), e.where("event_type = 'purchase' and value > 20").select("episode_index").distinct()
    one = F.lit(1).alias("x")
    return va.differences(a.select("*", one), b.select("*", one), "episode_index", "x")


@add("c11_cached_windows_only", "SELECT e.event_id FROM events e WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = e.event_id)")
def c11(spark, sf):
    return table(spark, sf, "events").select("event_id").join(table(spark, sf, "labels").select(F.col("doc_id").alias("event_id")), "event_id", "left_semi")


@add("c12_uncached_prompts", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def c12(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left_anti")


@add("c13_missing_report", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) ORDER BY doc_id LIMIT 5")
def c13(spark, sf):
    return c12(spark, sf).orderBy("doc_id").limit(5)


@add("c14_identity_checked_join", "SELECT count(*) AS n, sum(CASE WHEN o_custkey = c_custkey THEN 0 ELSE 1 END)::BIGINT AS mismatches FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey")
def c14(spark, sf):
    li, o, c = (table(spark, sf, t) for t in ("lineitem", "orders", "customer"))
    j = li.select("l_orderkey").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(c.select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"))
    return j.agg(F.count("*").alias("n"), F.sum((~F.col("o_custkey").eqNullSafe(F.col("c_custkey"))).cast("long")).alias("mismatches"))


@add("c15_dictionary_codes", "SELECT event_type, row_number() OVER (ORDER BY min(event_id)) - 1 AS code, min(event_id) AS first_position FROM events GROUP BY 1")
def c15(spark, sf):
    return ky.dictionary_codes(table(spark, sf, "events"), "event_type", "event_id")


@add("c17_unique_windows", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def c17(spark, sf):
    return ky.duplicates(table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber")


@add("c18_decoded_codes", "SELECT c_custkey, n.n_name AS nation, r.r_name AS region FROM customer JOIN nation n ON c_nationkey = n_nationkey JOIN region r ON n_regionkey = r_regionkey")
def c18(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    named = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select("n_nationkey", F.col("n_name").alias("nation"), F.col("r_name").alias("region"))
    return table(spark, sf, "customer").join(named, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "nation", "region")


@add("g01_union_on_common_columns", "SELECT 'a' AS dataset, doc_id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark")
def g01(spark, sf):
    return tables.shared_union(table(spark, sf, "documents"), table(spark, sf, "benchmark").withColumnRenamed("item_id", "doc_id"), ("a", "b"))


@add("g03_set_differences", "(SELECT user_id FROM events WHERE event_type = 'error' EXCEPT SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 20)")
def g03(spark, sf):
    e = table(spark, sf, "events")
    return e.where("event_type = 'error'").select("user_id").subtract(e.where("event_type = 'purchase' and value > 20").select("user_id"))


@add("g04_ordered_distinct", "SELECT text, min(doc_id) AS first_position FROM documents GROUP BY 1")
def g04(spark, sf):
    return ky.ordered_distinct(table(spark, sf, "documents"), "text", "doc_id")


@add("g05_duplicate_keys", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def g05(spark, sf):
    return ky.duplicates(table(spark, sf, "events"), "user_id", "event_type")


@add("g06_episode_split", f"WITH {LENGTHS}, r AS (SELECT episode_index, row_number() OVER (ORDER BY {MD5.format('episode_index', 1)}, episode_index) AS r, count(*) OVER () AS n FROM lengths) SELECT episode_index, r <= CAST(floor(n * 0.99) AS BIGINT) AS is_train FROM r")
def g06(spark, sf):
    e = lengths(spark, sf).select("episode_index")
    n = e.count()
    w = Window.orderBy(sm.shuffled(F.col("episode_index"), 1), "episode_index")  # one row an episode
    return e.select("episode_index", (F.row_number().over(w) <= int(n * 0.99)).alias("is_train"))


@add("g07_stratified_split", f"WITH r AS (SELECT vec_id, row_number() OVER (PARTITION BY label ORDER BY {MD5.format('vec_id', 3)}, vec_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM embeddings) SELECT vec_id, r <= least(n - 1, greatest(1, round_even(n * 0.1, 0))) AS is_validation FROM r")
def g07(spark, sf):
    return sm.stratified_split(table(spark, sf, "embeddings"), "label", "vec_id", 0.1, 3).select("vec_id", "is_validation")


@add("g09_balanced_pick", f"WITH r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY {MD5.format('vec_id', 5)}, vec_id) AS turn FROM embeddings) SELECT vec_id, label, turn FROM r ORDER BY turn, label LIMIT 64")
def g09(spark, sf):
    r = sm.round_robin(table(spark, sf, "embeddings").select("vec_id", "label"), "label", "vec_id", 5)
    return r.orderBy("turn", "label").limit(64).withColumn("turn", F.col("turn").cast("long"))


@add("g10_hash_sample", f"SELECT vec_id FROM embeddings ORDER BY {MD5.format('vec_id', 7)}, vec_id LIMIT 50")
def g10(spark, sf):
    return sm.hash_sample(table(spark, sf, "embeddings").select("vec_id"), "vec_id", 50, 7)


@add("g11_edges_and_sample", f"(SELECT vec_id FROM embeddings ORDER BY {MD5.format('vec_id', 9)}, vec_id LIMIT 13) UNION SELECT * FROM (SELECT unnest([0, (count(*) // 2)::BIGINT, count(*) - 1]) FROM embeddings)")
def g11(spark, sf):
    v = table(spark, sf, "embeddings").select("vec_id")
    edges = v.agg(F.count("*").alias("n")).select(F.explode(F.array(F.lit(0).cast("long"), F.floor(F.col("n") / 2), F.col("n") - 1)).alias("vec_id"))
    return sm.hash_sample(v, "vec_id", 13, 9).union(edges).distinct()


@add("g12_epoch_order", f"SELECT vec_id, {MD5.format('vec_id', 13)} AS epoch_key FROM embeddings")
def g12(spark, sf):
    return sm.epoch_order(table(spark, sf, "embeddings").select("vec_id"), "vec_id", 11, 2)


@add("g12_resumed_epoch", f"WITH r AS (SELECT vec_id, row_number() OVER (ORDER BY {MD5.format('vec_id', 11)}, vec_id) - 1 AS place FROM embeddings) SELECT * FROM r WHERE place >= 96")
def g12_resumed(spark, sf):
    """The first epoch goes on after three batches of sixteen on two processes."""
    return sm.resumed_epoch(table(spark, sf, "embeddings").select("vec_id"), "vec_id", 11, 0, 3, 16, 2).select("vec_id", "place")


@add("g13_text_conflicts", "SELECT lower(trim(regexp_replace(l_linestatus, '\\s+', ' ', 'g'))) AS norm, count(DISTINCT l_returnflag) AS n, min(l_returnflag) AS first, max(l_returnflag) AS last FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1")
def g13(spark, sf):
    return ky.conflicts(table(spark, sf, "lineitem").select(tx.normalise_text(F.col("l_linestatus")).alias("norm"), "l_returnflag"), "norm", "l_returnflag")


@add("g14_cyclic_extension", "SELECT i, i % 25 AS n_nationkey, n_name FROM range(100) r(i) JOIN nation ON n_nationkey = i % 25")
def g14(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name")
    return spark.range(100).select(F.col("id").alias("i"), (F.col("id") % 25).alias("n_nationkey")).join(n, "n_nationkey")


@add("g15_padded_round_robin", f"WITH {LENGTHS}, b AS (SELECT row_number() OVER (ORDER BY episode_index) - 1 AS i, episode_index FROM lengths), n AS (SELECT count(*) AS n FROM b) SELECT s.i AS slot, s.i % 8 AS rank, coalesce(b.episode_index, (SELECT episode_index FROM b WHERE i = 0)) AS episode_index FROM n, range(((n + 7) // 8) * 8) s(i) LEFT JOIN b ON b.i = s.i")
def g15(spark, sf):
    b = lengths(spark, sf).select("episode_index").withColumn("i", F.row_number().over(Window.orderBy("episode_index")).cast("long") - 1)
    n = b.count()
    first = b.where("i = 0").select(F.col("episode_index").alias("_first"))
    slots = spark.range(-(-n // 8) * 8).withColumnRenamed("id", "slot")
    out = slots.join(b, F.col("slot") == F.col("i"), "left").join(F.broadcast(first))  # one row
    return out.select("slot", (F.col("slot") % 8).alias("rank"), F.coalesce("episode_index", "_first").alias("episode_index"))


@add("f12_equal_ranges", "SELECT vec_id, vec_id // ((n + 7) // 8) AS rank FROM embeddings, (SELECT count(*) AS n FROM embeddings)")
def f12(spark, sf):
    v = table(spark, sf, "embeddings").select("vec_id")
    return sm.equal_ranges(v, "vec_id", v.count(), 8)


@add("f13_round_robin_shards", "SELECT vec_id, vec_id % 8 AS rank FROM embeddings")
def f13(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", (F.col("vec_id") % 8).alias("rank"))


@add("f14_numeric_suffix_order", "SELECT c_name, row_number() OVER (ORDER BY CAST(regexp_extract(c_name, '([0-9]+)$', 1) AS BIGINT) DESC) AS place FROM customer")
def f14(spark, sf):
    suffix = F.regexp_extract("c_name", r"([0-9]+)$", 1).cast("long")
    return ky.numbered(table(spark, sf, "customer").select("c_name"), "place", suffix.desc())


@add("f16_binarised", "SELECT event_id, value > 0.5 AS closed, -value AS flipped FROM events")
def f16(spark, sf):
    return table(spark, sf, "events").select("event_id", (F.col("value") > 0.5).alias("closed"), (-F.col("value")).alias("flipped"))


@add("h01_normalised_text", "SELECT item_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS norm FROM benchmark")
def h01(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", tx.normalise_text(F.col("text")).alias("norm"))


@add("h02_normalised_names", "SELECT p_partkey, regexp_replace(replace(replace(lower(trim(p_name)), '-', '_'), ' ', '_'), '_+', '_', 'g') AS norm FROM part")
def h02(spark, sf):
    return table(spark, sf, "part").select("p_partkey", tx.normalise_name(F.col("p_name")).alias("norm"))


@add("h04_text_owners", "SELECT lower(trim(p_name)) AS norm, count(DISTINCT p_brand) AS n, min(p_brand) AS first, max(p_brand) AS last FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1")
def h04(spark, sf):
    return ky.conflicts(table(spark, sf, "part").select(tx.normalise_text(F.col("p_name")).alias("norm"), "p_brand"), "norm", "p_brand")


@add("h06_fixed_layout", "SELECT user_id // 15 AS task, min(user_id) AS first, max(user_id) AS last, count(DISTINCT user_id) AS n, max(user_id) - min(user_id) + 1 = count(DISTINCT user_id) AS contiguous FROM events GROUP BY 1")
def h06(spark, sf):
    u = F.col("user_id")
    return table(spark, sf, "events").groupBy(F.floor(u / 15).alias("task")).agg(F.min(u).alias("first"), F.max(u).alias("last"), F.count_distinct(u).alias("n"), (F.max(u) - F.min(u) + 1 == F.count_distinct(u)).alias("contiguous"))


@add("h07_bilingual_split", "SELECT event_id, split_part(event_type || '@' || user_id, '@', 2) AS second, '[High]' || split_part(event_type || '@' || user_id, '@', 1) AS first FROM events")
def h07(spark, sf):
    parts = F.split(F.concat("event_type", F.lit("@"), "user_id"), "@")
    return table(spark, sf, "events").select("event_id", parts[1].alias("second"), F.concat(F.lit("[High]"), parts[0]).alias("first"))


@add("h09_prompt_files", "SELECT item_id, sha256('Task: ' || text) || '.len512.pt' AS file FROM benchmark")
def h09(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.concat(F.sha2(F.concat(F.lit("Task: "), "text"), 256), F.lit(".len512.pt")).alias("file"))


@add("h10_slugs", "SELECT c_custkey, regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') AS slug FROM customer")
def h10(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", tx.slug(F.col("c_name")).alias("slug"))


@add("h11_durations", """WITH s AS (SELECT event_id, CAST(round_even(value * 100, 0) AS BIGINT) AS s FROM events)
SELECT event_id, CASE WHEN s < 60 THEN lpad(CAST(s AS VARCHAR), 2, '0') || 's' WHEN s < 3600 THEN lpad(CAST(s // 60 AS VARCHAR), 2, '0') || 'm' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') || 's'
  ELSE lpad(CAST(s // 3600 AS VARCHAR), 2, '0') || 'h' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || 'm' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') || 's' END AS duration FROM s""")
def h11(spark, sf):
    return table(spark, sf, "events").select("event_id", tx.duration(F.col("value") * 100).alias("duration"))


@add("h37_decoded_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events")
def h37(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k double")["k"].alias("k"))


QUERIES, ORACLES = add.queries, add.oracles
