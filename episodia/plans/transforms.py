"""Features, files, memory and summaries (A05, A06, A09, A14-A16, A22, A23, A30, B01, B02, B14-B16, D08, D18, D24, D26, E18, G02, H08, H13, H15, H18, H19, H32, I02, I04, I08, J01, J05, J06, K01)."""

from __future__ import annotations

from math import exp

from pyspark.sql import Window, functions as F

from episodia.operators import keys, memory, retrieval as rt, trajectories as tr, transforms as tf, validation
from episodia.plans.common import BANK, FRAMES, Registry, bank, frames, signed_round
from episodia.session import table
from episodia.sources import scratch, tables
from episodia.streaming import lifecycle

add = Registry()


@add("a05_manifest", "SELECT r_regionkey AS region, r_name AS name, [r_regionkey, r_regionkey + 1]::BIGINT[] AS shape FROM region")
def a05(spark, sf):
    path = scratch.folder(spark)
    text = F.format_string('{\n    "region": %d,\n    "name": "%s",\n    "shape": [\n        %d,\n        %d\n    ]\n}', "r_regionkey", "r_name", "r_regionkey", F.col("r_regionkey") + 1)
    table(spark, sf, "region").select(F.col("r_regionkey").alias("part"), text.alias("value")).write.partitionBy("part").text(path)
    return tables.read_manifest(spark, path).select(F.col("region").cast("int").alias("region"), "name", "shape")


@add("a06_json_lines", "SELECT n_nationkey::BIGINT AS key, n_name || chr(9) || 'raw' AS name FROM nation UNION ALL SELECT n_nationkey::BIGINT + 100, n_name FROM nation")
def a06(spark, sf):
    path, n = scratch.folder(spark), table(spark, sf, "nation")
    n.select(F.format_string('{"key": %d, "name": "%s\traw"}', "n_nationkey", "n_name")).write.text(path)
    tables.append_jsonl(n.select((F.col("n_nationkey") + 100).alias("key"), F.col("n_name").alias("name")), path)
    return tables.read_jsonl(spark, path, "key long, name string")


@add("a09_episode_columns", f"WITH {FRAMES} SELECT episode_index, list(event_id ORDER BY frame_index) AS ids, list(value ORDER BY frame_index) AS vals FROM frames GROUP BY 1")
def a09(spark, sf):
    rows = F.sort_array(F.collect_list(F.struct("frame_index", "event_id", "value")))
    return frames(spark, sf).groupBy("episode_index").agg(rows.alias("r")).select("episode_index", F.col("r.event_id").alias("ids"), F.col("r.value").alias("vals"))


def files(spark, sf):
    """One small file a nation."""
    path = scratch.folder(spark)
    text = F.concat(F.lit("log of "), "n_name", F.lit("\nrate 1\n"), F.col("n_nationkey") / 4, F.lit("\nend"))
    table(spark, sf, "nation").select(F.col("n_nationkey").alias("nation"), text.alias("value")).write.partitionBy("nation").text(path)
    return path


def nation():
    return F.regexp_extract("path", r"nation=(\d+)", 1).cast("int").alias("n_nationkey")


CONTENT = "'log of ' || n_name || chr(10) || 'rate 1' || chr(10) || CAST(n_nationkey / 4.0 AS DOUBLE) || chr(10) || 'end' || chr(10)"


@add("a14_embedded_bytes", f"SELECT n_nationkey, n_name, len({CONTENT}) AS length, hex(encode({CONTENT})) AS content FROM nation")
def a14(spark, sf):
    held = spark.read.format("binaryFile").load(files(spark, sf)).select(nation(), "length", F.hex("content").alias("content"))
    return table(spark, sf, "nation").select("n_nationkey", "n_name").join(held, "n_nationkey")


@add("b15_content_digests", f"SELECT n_nationkey, sha256({CONTENT}) AS sha256 FROM nation")
def b15(spark, sf):
    return tables.content_hashes(spark, files(spark, sf)).select(nation(), "sha256")


@add("a22_last_numbers", "SELECT n_nationkey, n_nationkey / 4.0::DOUBLE AS value FROM nation")
def a22(spark, sf):
    return tables.last_number(spark, files(spark, sf)).withColumnRenamed("file", "path").select(nation(), "value")


@add("a16_shard_places", "SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // 512 AS shard, (row_number() OVER (ORDER BY event_id) - 1) % 512 AS \"offset\" FROM events")
def a16(spark, sf):
    placed = keys.numbered(table(spark, sf, "events").select("event_id"), "place", F.col("event_id")).withColumn("place", F.col("place") - 1)
    return placed.select("event_id", F.floor(F.col("place") / 512).alias("shard"), (F.col("place") % 512).alias("offset"))


FEATURES = {"state": ("float32", 3), "label": ("int64", 1), "even": ("bool", 1)}


@add("a30_typed_features", "SELECT embedding[1:3]::FLOAT[] AS state, label::BIGINT AS label, vec_id % 2 = 0 AS even FROM embeddings")
def a30(spark, sf):
    v = table(spark, sf, "embeddings").withColumns({"state": F.slice("embedding", 1, 3), "even": F.col("vec_id") % 2 == 0})
    return tf.as_features(v, FEATURES)


@add("b01_numeric_features", "SELECT c_custkey::DOUBLE AS c_custkey, c_nationkey::DOUBLE AS c_nationkey, c_acctbal FROM customer")
def b01(spark, sf):
    c = table(spark, sf, "customer")
    return c.select(*[F.col(f.name).cast("double").alias(f.name) for f in c.schema.fields if f.dataType.typeName() not in ("string", "binary")])


@add("b02_prefixed_keys", "SELECT vec_id, unnest(['observation.state', 'observation.state.arm', 'action.gripper']) AS key, unnest([embedding[1], embedding[2], embedding[3]])::DOUBLE AS value FROM embeddings")
def b02(spark, sf):
    named = {("observation.state", "default"): 0, ("observation.state", "arm"): 1, ("action", "gripper"): 2}
    cells = [F.struct(F.lit(kind if key == "default" else f"{kind}.{key}").alias("key"), F.get("embedding", k).cast("double").alias("value")) for (kind, key), k in named.items()]
    return table(spark, sf, "embeddings").select("vec_id", F.inline(F.array(*cells)))


@add("b14_manifest_differences", "SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN 'different' WHEN n_nationkey % 7 = 0 THEN 'missing' ELSE 'equal' END AS status FROM nation")
def b14(spark, sf):
    n = table(spark, sf, "nation").select("n_nationkey", "n_name", F.when(F.col("n_nationkey") % 2 == 0, "n_regionkey").alias("held"))
    actual = n.where("n_nationkey % 7 <> 0 or n_nationkey % 5 = 0").withColumn("n_name", F.when(F.col("n_nationkey") % 5 == 0, F.lit(None)).otherwise(F.col("n_name")))
    return validation.differences(n, actual, "n_nationkey", "n_name", "held")


@add("b16_index_guard", "SELECT vec_id AS asked, vec_id + CASE WHEN vec_id % 13 = 0 THEN 1 ELSE 0 END AS given FROM embeddings WHERE vec_id % 13 = 0")
def b16(spark, sf):
    v = table(spark, sf, "embeddings").select("vec_id")
    given = v.select("vec_id", (F.col("vec_id") + (F.col("vec_id") % 13 == 0).cast("long")).alias("given"))
    return v.join(given, "vec_id").where("vec_id <> given").select(F.col("vec_id").alias("asked"), "given")


@add("d08_picture_cells", """WITH s AS (SELECT vec_id, 100 + vec_id * 37 % 900 AS h, 100 + vec_id * 53 % 900 AS w FROM embeddings), k AS (SELECT *, CASE WHEN greatest(h, w) < 300 THEN 1 ELSE greatest(h, w) // 150 END AS stride FROM s)
SELECT vec_id, stride, list_sum(range(0, h, stride))::BIGINT AS rows_read, len(range(0, w, stride)) AS columns_read FROM k""")
def d08(spark, sf):
    s = table(spark, sf, "embeddings").select("vec_id", (100 + F.col("vec_id") * 37 % 900).alias("h"), (100 + F.col("vec_id") * 53 % 900).alias("w"))
    s = s.withColumn("stride", tf.image_stride(F.col("h"), F.col("w")))
    places = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1, F.col("stride"))
    return s.select("vec_id", "stride", F.aggregate(places("h"), F.lit(0).cast("long"), lambda a, x: a + x).alias("rows_read"), F.size(places("w")).cast("long").alias("columns_read"))


@add("d18_gathered_means", "SELECT user_id % 10 AS task, round(avg(m), 9) AS mean, sum(n)::BIGINT AS held FROM (SELECT user_id, avg(value) FILTER (WHERE event_id % 3 <> 0) AS m, count(*) FILTER (WHERE event_id % 3 <> 0) AS n FROM events GROUP BY 1) GROUP BY 1")
def d18(spark, sf):
    x = F.when(F.col("event_id") % 3 != 0, F.col("value"))  # null, not a sentinel, where there is nothing
    per = table(spark, sf, "events").groupBy("user_id").agg(F.avg(x).alias("m"), F.count(x).alias("n"))
    return per.groupBy((F.col("user_id") % 10).alias("task")).agg(signed_round(F.avg("m"), 9).alias("mean"), F.sum("n").alias("held"))


WINDOW = [exp(-((k - 5) ** 2) / 4.5) for k in range(11)]
WINDOW = [x / sum(WINDOW) for x in WINDOW]
BLUR = "list_sum([list_sum([g[a - i + 6] * g[b - j + 6] * {} FOR b IN range(greatest(j - 5, 0), least(j + 6, 8))]) FOR a IN range(greatest(i - 5, 0), least(i + 6, 8))])"


@add("d24_structural_similarity", f"""WITH e AS (SELECT vec_id, [abs(v::DOUBLE) FOR v IN embedding] AS x, [abs(v::DOUBLE) * 0.9 + 0.01 FOR v IN embedding] AS y, {WINDOW} AS g FROM embeddings),
c AS (SELECT vec_id, x, y, g, p // 8 AS i, p % 8 AS j FROM e, range(64) r(p)),
m AS (SELECT vec_id, {BLUR.format('x[a * 8 + b + 1]')} AS mx, {BLUR.format('y[a * 8 + b + 1]')} AS my, {BLUR.format('x[a * 8 + b + 1] * x[a * 8 + b + 1]')} AS xx, {BLUR.format('y[a * 8 + b + 1] * y[a * 8 + b + 1]')} AS yy, {BLUR.format('x[a * 8 + b + 1] * y[a * 8 + b + 1]')} AS xy FROM c)
SELECT vec_id, round(avg((2 * mx * my + 0.0001) * (2 * (xy - mx * my) + 0.0009) / ((mx * mx + my * my + 0.0001) * (xx - mx * mx + yy - my * my + 0.0009) + 1e-12)), 6) AS ssim FROM m GROUP BY 1""")
def d24(spark, sf):
    x = F.transform(F.col("embedding").cast("array<double>"), F.abs)
    v = table(spark, sf, "embeddings").select("vec_id", x.alias("x")).withColumn("y", F.transform("x", lambda v: v * 0.9 + 0.01))
    return tf.similarity(v, "vec_id", "x", "y", 8, 8).withColumn("ssim", signed_round("ssim", 6))


@add("d26_time_sums", "SELECT user_id, round(sum(CASE WHEN event_id % 2 = 0 THEN value END), 6) AS inference, round(sum(CASE WHEN event_id % 2 <> 0 THEN value END), 6) AS simulation FROM events GROUP BY 1")
def d26(spark, sf):
    even = F.col("event_id") % 2 == 0
    return table(spark, sf, "events").groupBy("user_id").agg(signed_round(F.sum(F.when(even, F.col("value"))), 6).alias("inference"), signed_round(F.sum(F.when(~even, F.col("value"))), 6).alias("simulation"))


@add("e18_relative_to_last", f"WITH {FRAMES} SELECT episode_index, frame_index, round(value - max_by(value, frame_index) OVER (PARTITION BY episode_index), 6) AS relative FROM frames")
def e18_last(spark, sf):
    last = F.max_by("value", "frame_index").over(Window.partitionBy("episode_index"))
    return frames(spark, sf).select("episode_index", "frame_index", signed_round(F.col("value") - last, 6).alias("relative"))


@add("i08_phase_keyed_topk", f"WITH {BANK}, p AS (SELECT q.id AS q_id, b.id, round(list_dot_product(q.unit, b.unit), 6) AS score FROM units q JOIN units b ON q.episode <> b.episode AND q.task = b.task AND q.id % 5 = b.id % 5), k AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, id) AS rank FROM p) SELECT q_id, rank, id, score FROM k WHERE rank <= 4")
def i08(spark, sf):
    b = bank(spark, sf).withColumn("task", (F.col("task") * 5 + F.col("id") % 5).cast("int"))  # a task's phase is a key of its own
    return rt.block_top_k(b, b, 4, same_task=True).select("q_id", F.col("rank").cast("long").alias("rank"), "id", "score")


@add("g02_column_sets", "WITH l AS (SELECT column_name AS name FROM (DESCRIBE documents)), r AS (SELECT column_name AS name FROM (DESCRIBE labels)) SELECT coalesce(l.name, r.name) AS name, CASE WHEN r.name IS NULL THEN 'left' WHEN l.name IS NULL THEN 'right' ELSE 'both' END AS side FROM l FULL JOIN r ON l.name = r.name")
def g02(spark, sf):
    return tf.name_sets(table(spark, sf, "documents"), table(spark, sf, "labels"))


@add("h08_prompts", "SELECT c_custkey, 'A video of a robot that does this: visit customer ' || c_custkey || ' of ' || lower(c_mktsegment) AS prompt FROM customer")
def h08(spark, sf):
    task = F.concat(F.lit("visit customer "), "c_custkey", F.lit(" of "), F.lower("c_mktsegment"))
    return table(spark, sf, "customer").select("c_custkey", F.format_string("A video of a robot that does this: %s", task).alias("prompt"))


@add("h13_nested_names", "SELECT c_custkey, c_name AS name, c_nationkey AS nation, c_acctbal AS balance, 'key,who/money/balance,who/name,who/place/nation' AS names FROM customer")
def h13(spark, sf):
    who = F.struct(F.col("c_name").alias("name"), F.struct(F.col("c_nationkey").alias("nation")).alias("place"), F.struct(F.col("c_acctbal").alias("balance")).alias("money"))
    flat = tf.flatten_names(table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), who.alias("who")))
    back = tf.unflatten_names(flat)
    return back.select(F.col("key").alias("c_custkey"), "who.name", "who.place.nation", "who.money.balance", F.lit(",".join(sorted(flat.columns))).alias("names"))


@add("h15_dot_and_cosine", "SELECT vec_id, round(list_dot_product(a, b), 6) + 0.0 AS dot, round(list_cosine_similarity(a, b), 6) + 0.0 AS cosine FROM (SELECT vec_id, embedding[1:32]::DOUBLE[] AS a, embedding[33:64]::DOUBLE[] AS b FROM embeddings)")
def h15(spark, sf):
    e = F.col("embedding").cast("array<double>")
    v = table(spark, sf, "embeddings").select("vec_id", F.slice(e, 1, 32).alias("a"), F.slice(e, 33, 32).alias("b"))
    a, b = F.col("a"), F.col("b")
    return v.select("vec_id", (F.round(rt.dot(a, b), 6) + 0.0).alias("dot"), (F.round(rt.dot(a, b) / (rt.norm(a) * rt.norm(b)), 6) + 0.0).alias("cosine"))


SET = "WITH e AS (SELECT vec_id, vec_id % 4 AS step, [x::DOUBLE FOR x IN embedding[1:2]] AS a, [x::DOUBLE FOR x IN embedding[3:4]] AS s FROM embeddings)"


@add("h18_normaliser_set", SET + """, r AS (SELECT step, min(a[1]) AS l1, max(a[1]) AS h1, min(a[2]) AS l2, max(a[2]) AS h2 FROM e GROUP BY 1), z AS (SELECT avg(s[1]) AS m1, stddev_pop(s[1]) AS d1, avg(s[2]) AS m2, stddev_pop(s[2]) AS d2 FROM e)
SELECT vec_id, [round(2 * (a[1] - l1) / (h1 - l1) - 1, 5) + 0.0, round(2 * (a[2] - l2) / (h2 - l2) - 1, 5) + 0.0] AS action, [round((s[1] - m1) / (d1 + 1e-8), 5) + 0.0, round((s[2] - m2) / (d2 + 1e-8), 5) + 0.0] AS state FROM e JOIN r USING (step) CROSS JOIN z""")
def h18(spark, sf):
    v = fields(spark, sf)
    return rounded(tf.normalise_set(v, SET_FIELDS))


@add("h18_restored_set", SET + " SELECT vec_id, [round(x, 5) + 0.0 FOR x IN a] AS action, [round(x, 5) + 0.0 FOR x IN s] AS state FROM e")
def h18_back(spark, sf):
    v = fields(spark, sf)
    held = {f.column: tf.field_stats(v, f) for f in SET_FIELDS}
    return rounded(tf.normalise_set(tf.normalise_set(v, SET_FIELDS, stats=held), SET_FIELDS, inverse=True, stats=held))


SET_FIELDS = [tf.Field("action", 2, "minmax", "step"), tf.Field("state", 2, "zscore")]


def fields(spark, sf):
    e = F.col("embedding").cast("array<double>")
    return table(spark, sf, "embeddings").select("vec_id", (F.col("vec_id") % 4).alias("step"), F.slice(e, 1, 2).alias("action"), F.slice(e, 3, 2).alias("state"))


def rounded(v):
    six = lambda c: F.transform(c, lambda x: F.round(x, 5) + 0.0).alias(c)
    return v.select("vec_id", six("action"), six("state"))


@add("h19_stats_names", """SELECT label, sha256('{"label":' || label || ',"mode":"minmax"}') || '.json' AS file, list_sort(list(vec_id))::BIGINT[] AS ids FROM embeddings GROUP BY 1""")
def h19(spark, sf):
    held = table(spark, sf, "embeddings").groupBy("label").agg(F.to_json(F.sort_array(F.collect_list("vec_id"))).alias("json"))
    name = F.concat(tf.signature_digest(F.col("label"), F.lit("minmax").alias("mode")), F.lit(".json"))
    return held.select("label", name.alias("file"), F.from_json("json", "array<bigint>").alias("ids"))


@add("h32_transform_pipeline", "SELECT vec_id, [x::DOUBLE * 4 FOR x IN embedding[1:3]] || [0.0, 0.0] AS there, [x::DOUBLE FOR x IN embedding[1:3]] AS back FROM embeddings")
def h32(spark, sf):
    steps = [tf.scaled(2.0, 3), tf.padded(3, 5), tf.scaled(2.0, 5)]
    v = table(spark, sf, "embeddings").select("vec_id", F.slice(F.col("embedding").cast("array<double>"), 1, 3).alias("x"))
    v = v.withColumn("there", tf.forward(F.col("x"), steps))
    return v.select("vec_id", "there", tf.backward(F.col("there"), steps).alias("back"))


@add("i02_evicted_memory", "WITH n AS (SELECT vec_id, vec_id // 20 AS episode, row_number() OVER (PARTITION BY vec_id // 20 ORDER BY vec_id) AS n FROM embeddings) SELECT episode, vec_id AS step, least(n, 6) - 1 AS slot, false AS merged, least(n, 6) AS size FROM n")
def i02(spark, sf):
    """Nothing merges, so the oldest entry makes room."""
    e = F.col("embedding").cast("array<double>")
    rows = table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 20).alias("episode"), F.col("vec_id").alias("step"), F.lit(0).alias("attempt"), F.slice(e, 1, 32).alias("phase"), F.slice(e, 33, 32).alias("effect"))
    return memory.merge_memory(rows, capacity=6, threshold=2.0)


@add("i04_ring_buffer", f"WITH {FRAMES} SELECT episode_index, frame_index, list_concat([0.0 FOR x IN range(3 - least(frame_index + 1, 3))], list(value) OVER (PARTITION BY episode_index ORDER BY frame_index ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) AS ring FROM frames")
def i04(spark, sf):
    last = Window.partitionBy("episode_index").orderBy("frame_index")
    held = F.concat(F.array_repeat(F.lit(0.0), 3), F.array_compact(F.array(F.lag("value", 2).over(last), F.lag("value", 1).over(last), F.col("value"))))
    return frames(spark, sf).select("episode_index", "frame_index", F.slice(held, -3, 3).alias("ring"))


def faulty(spark, sf):
    """Of each session: a reset, an act out of turn for odd ones, an act, a retry before the end, a new start and its act."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("session"), (F.col("s_suppkey") % 2).alias("odd"))
    plan = [("reset", 0, F.lit(0)), ("act", 0, F.when(F.col("odd") == 1, 3).otherwise(0)), ("act", 0, F.lit(0)), ("final", 0, F.lit(1)), ("final", 0, F.lit(1)), ("reset", 1, F.lit(0)), ("reset", 0, F.lit(0)), ("act", 0, F.lit(0))]
    rows = [F.struct(F.lit(k).cast("long").alias("seq"), F.lit(kind).alias("kind"), F.lit(attempt).alias("attempt"), step.cast("long").alias("step")) for k, (kind, attempt, step) in enumerate(plan)]
    return s.select("session", F.inline(F.array(*rows)))


def replies(odd, even):
    return f"SELECT CAST(s_suppkey AS VARCHAR) AS session, unnest(range(8)) AS seq, unnest(CASE WHEN s_suppkey % 2 = 1 THEN {odd} ELSE {even} END) AS status FROM supplier"


@add("j01_protocol_replies", replies(["ok", "fault", "latched", "latched", "latched", "fault", "ok", "ok"], ["ok", "ok", "repeat", "ok", "repeat", "ok", "ok", "ok"]))
def j01(spark, sf):
    return lifecycle.replay(faulty(spark, sf)).select("session", "seq", "status")


@add("j05_latched_sessions", "SELECT CAST(s_suppkey AS VARCHAR) AS session, 3::BIGINT AS latched FROM supplier WHERE s_suppkey % 2 = 1")
def j05(spark, sf):
    return lifecycle.replay(faulty(spark, sf)).where("status = 'latched'").groupBy("session").agg(F.count("*").alias("latched"))


@add("j06_session_states", "SELECT CAST(s_suppkey AS VARCHAR) AS session, 0 AS attempt, 0::BIGINT AS step, 'ok' AS status, 0::BIGINT AS groups FROM supplier")
def j06(spark, sf):
    return lifecycle.latest(lifecycle.replay(faulty(spark, sf)))


SUITES = ["BUILDING", "MACHINERY", "FURNITURE", "HOUSEHOLD"]
RESULTS = f"r AS (SELECT c_mktsegment AS suite, list_position({SUITES}, c_mktsegment) AS place, c_nationkey::BIGINT AS task_id, sum(5 + c_custkey % 3) AS trials, sum(c_custkey % 5)::BIGINT AS successes FROM customer WHERE c_mktsegment IN {tuple(SUITES)} AND c_custkey % 11 <> 0 GROUP BY ALL)"


def summary(spark, sf):
    name = F.when(F.col("c_custkey") % 11 == 0, F.lit("notes.json")).otherwise(F.format_string("out/gpu%d_task%d_results.json", F.col("c_custkey") % 4, "c_nationkey"))
    rows = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("suite"), name.alias("file"), (5 + F.col("c_custkey") % 3).alias("trials"), (F.col("c_custkey") % 5).alias("successes"))
    return tf.task_summary(rows, SUITES)


@add("k01_task_summary", f"WITH {RESULTS} SELECT suite, place, task_id, trials::BIGINT AS trials, successes, successes / trials AS rate FROM r")
def k01(spark, sf):
    return summary(spark, sf).withColumn("place", F.col("place").cast("long"))


@add("a23_transposed_summary", f"WITH {RESULTS}, s AS (SELECT suite, count(*)::DOUBLE AS tasks, avg(successes / trials) AS rate FROM r GROUP BY 1), l AS (SELECT suite, unnest(['tasks', 'rate']) AS measure, unnest([tasks, rate]) AS v FROM s) SELECT measure, " + ", ".join(f"round(max(v) FILTER (WHERE suite = '{s}'), 9) AS \"{s}\"" for s in SUITES) + " FROM l GROUP BY 1")
def a23(spark, sf):
    per = summary(spark, sf).groupBy("suite").agg(F.count("*").alias("tasks"), F.avg("rate").alias("rate"))
    return tf.transposed(per, "suite", SUITES, ["tasks", "rate"]).select("measure", *[signed_round(s, 9).alias(s) for s in SUITES])


QUERIES, ORACLES = add.queries, add.oracles
