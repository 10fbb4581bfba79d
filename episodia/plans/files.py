"""Queries over files that they write themselves from the given tables: metadata folders, committed shards, strings of any format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from episodia.operators import metadata as md, retrieval as rt, transforms as tf
from episodia.plans.common import BANK, FRAMES, Registry, bank, frames, signed_round
from episodia.operators.transforms import signature_digest
from episodia.session import table
from episodia.sources import metadata_source as ms, stats_cache
from episodia.sources.committed import Shards
from episodia.sources.scratch import folder
from episodia.sources.strings import strings_of

add = Registry()

EPISODES = f"""{FRAMES}, e AS (SELECT episode_index, count(*) AS length, list_sort(list(DISTINCT event_type)) AS tasks, min(value) AS low, max(value) AS high FROM frames GROUP BY 1)"""


def episodes(spark: SparkSession, sf: str) -> DataFrame:
    return frames(spark, sf).groupBy("episode_index").agg(
        F.count("*").alias("length"), F.sort_array(F.collect_set("event_type")).alias("tasks"), F.min("value").alias("low"), F.max("value").alias("high"))


def write_v2(spark: SparkSession, sf: str, version: str) -> str:
    """Metadata of version 2 of the event trajectories: JSON and JSON lines; statistics of the whole before 2.1, of episodes from then on."""
    root = folder(spark)
    own = episodes(spark, sf)
    total = own.agg(F.count("*").alias("n"), F.sum("length").alias("frames")).first()
    ms.write_info(spark, root, version, {"value": ("float64", [1]), "event_type": ("string", [1])}, total["n"], total["frames"], 30)
    tasks = frames(spark, sf).select(F.col("event_type").alias("task")).distinct()
    tasks.select(F.hash("task").cast("long").alias("task_index"), "task").write.json(f"{root}/meta/tasks.jsonl")
    own.select("episode_index", "tasks", "length").write.json(f"{root}/meta/episodes.jsonl")
    if ms.number(version) < (2, 1):
        one = frames(spark, sf).agg(F.array(F.min("value")).alias("min"), F.array(F.max("value")).alias("max"), F.array(F.array(F.count("*"))).alias("count"))
        one.select(F.struct("min", "max", "count").alias("value")).coalesce(1).write.json(f"{root}/meta/stats.json")
    else:
        stats = F.struct(F.struct(F.array("low").alias("min"), F.array("high").alias("max"), F.array("length").alias("count")).alias("value"))
        own.select("episode_index", stats.alias("stats")).write.json(f"{root}/meta/episodes_stats.jsonl")
    return root


def write_v3(spark: SparkSession, sf: str) -> str:
    """Metadata of version 3.0: Parquet, the episodes in chunks with their statistics."""
    root = folder(spark)
    own = episodes(spark, sf)
    total = own.agg(F.count("*").alias("n"), F.sum("length").alias("frames")).first()
    ms.write_info(spark, root, "v3.0", {"value": ("float64", [1])}, total["n"], total["frames"], 30)
    tasks = frames(spark, sf).select(F.col("event_type").alias("__index_level_0__")).distinct()
    tasks.select(F.hash("__index_level_0__").cast("long").alias("task_index"), "__index_level_0__").write.parquet(f"{root}/meta/tasks.parquet")
    columns = own.select("episode_index", "tasks", "length", F.array("low").alias("stats/value/min"), F.array("high").alias("stats/value/max"), F.floor(F.col("episode_index") / 40).alias("chunk"))
    columns.repartition("chunk").write.partitionBy("chunk").parquet(f"{root}/meta/episodes")
    return root


@add("a03_metadata_v20", f"""WITH {EPISODES}, g AS (SELECT min(value) AS low, max(value) AS high, count(*)::DOUBLE AS n FROM frames)
SELECT episode_index, tasks, length, 'v2.0' AS version, 'value' AS feature, s.statistic, [CASE s.statistic WHEN 'min' THEN low WHEN 'max' THEN high ELSE n END] AS values FROM (SELECT episode_index, tasks, length FROM e) e CROSS JOIN g CROSS JOIN (VALUES ('min'), ('max'), ('count')) s(statistic)""")
def a03_v20(spark, sf):
    """Before version 2.1 the statistics of the whole stand for every episode."""
    root = write_v2(spark, sf, "v2.0")
    read = lambda t: ms.read_metadata(spark, root, t, "v2")
    version = read("info").where("feature = 'value'").select("version")
    per = md.per_episode_stats(version.first()[0], read("stats").drop("episode_index"), read("episodes"))
    return read("episodes").join(per, "episode_index").select("episode_index", "tasks", "length", F.lit(version.first()[0]).alias("version"), "feature", "statistic", "values")


@add("a03_metadata_v21", f"WITH {EPISODES} SELECT episode_index, tasks, length, 'value' AS feature, s.statistic, [CASE s.statistic WHEN 'min' THEN low WHEN 'max' THEN high ELSE length::DOUBLE END] AS values FROM e CROSS JOIN (VALUES ('min'), ('max'), ('count')) s(statistic) WHERE episode_index IN (3, 5, 77, 100000)")
def a03_v21(spark, sf):
    """From version 2.1 on every episode has its own; a list of episodes is pushed down to the files."""
    root = write_v2(spark, sf, "v2.1")
    wanted = F.col("episode_index").isin(3, 5, 77, 100000)
    return ms.read_metadata(spark, root, "episodes", "v2").where(wanted).join(ms.read_metadata(spark, root, "stats", "v2").where(wanted), "episode_index")


@add("a04_metadata_v3", f"WITH {EPISODES} SELECT episode_index, tasks, length, s.statistic, [CASE s.statistic WHEN 'min' THEN low ELSE high END] AS values FROM e CROSS JOIN (VALUES ('min'), ('max')) s(statistic) WHERE episode_index >= 20 AND episode_index < 90")
def a04_v3(spark, sf):
    """Episodes without their statistics, and the statistics by row, of the chunks that a range of episodes needs."""
    root = write_v3(spark, sf)
    between = (F.col("episode_index") >= 20) & (F.col("episode_index") < 90)
    stats = ms.read_metadata(spark, root, "stats", "v3").where(between).drop("feature")
    return ms.read_metadata(spark, root, "episodes", "v3").where(between).join(stats, "episode_index")


@add("a08_tasks_of_both_versions", "SELECT t.event_type AS task, v.version, count(*) AS n FROM (SELECT DISTINCT event_type FROM events) t CROSS JOIN (VALUES ('v2.1'), ('v3.0')) v(version) GROUP BY ALL")
def a08(spark, sf):
    """Task texts, found by name or, in version 3.0, as the index of the table."""
    v2, v3 = ms.read_metadata(spark, write_v2(spark, sf, "v2.1"), "tasks"), ms.read_metadata(spark, write_v3(spark, sf), "tasks")
    both = v2.withColumn("version", F.lit("v2.1")).unionByName(v3.withColumn("version", F.lit("v3.0")))
    return both.groupBy("task", "version").agg(F.countDistinct("task_index").alias("n"))


@add("b04_feature_report", """SELECT * FROM (VALUES ('camera', 'missing', NULL::BIGINT), ('label', 'is int, not float32', NULL)) v(feature, problem, rows)
UNION ALL SELECT 'embedding', 'is not of shape [60]', count(*) FROM embeddings WHERE len(embedding) <> 60
UNION ALL SELECT 'extra_one', 'extra', NULL
UNION ALL SELECT 'pairs', 'is not of shape [2, 3]', count(*) FROM embeddings WHERE vec_id % 5 = 0""")
def b04(spark, sf):
    """A table against the features that its metadata declares."""
    root = folder(spark)
    features = {"vec_id": ("int64", [1]), "embedding": ("float32", [60]), "label": ("float32", [1]), "camera": ("image", [3, 4, 4]), "pairs": ("float64", [2, 3])}
    ms.write_info(spark, root, "v2.1", features, 1, 1, 30)
    row = F.array(*(F.lit(x) for x in (1.0, 2.0, 3.0)))
    pairs = F.when(F.col("vec_id") % 5 == 0, F.array(row, F.slice(row, 1, 2))).otherwise(F.array(row, row))
    rows = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<float>").alias("embedding"), F.col("label").cast("int").alias("label"), F.lit("x").alias("extra_one"), pairs.alias("pairs"))
    return md.feature_report(rows, ms.read_metadata(spark, root, "info").select("feature", "dtype", "shape"))


@add("a07_strings_of_any_format", """WITH n AS (SELECT n_name, n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
s AS (SELECT 'json' AS format, unnest(['region', 'nations', r_name] || list(n_name)) AS text FROM n GROUP BY r_name
UNION ALL SELECT 'jsonl', unnest(['name', 'part', 'tags', s_name, 'a', 'b', s_suppkey::VARCHAR]) FROM supplier
UNION ALL SELECT 'csv', unnest(['id', 'status', 'note', o_orderkey::VARCHAR, o_orderstatus, 'x, "y"']) FROM orders
UNION ALL SELECT 'parquet', unnest([c_name, 'inner', 'more', c_mktsegment, 'z']) FROM customer
UNION ALL SELECT 'text', p_name FROM part WHERE trim(p_name) <> ''
UNION ALL SELECT 'yaml', unnest(['event_' || event_type, 'list', event_type, 'tail']) FROM (SELECT DISTINCT event_type FROM events))
SELECT format, text, count(*) AS n FROM s GROUP BY ALL""")
def a07(spark, sf):
    """Strings and keys, nested ones too, of files of six formats."""
    root, t = folder(spark), lambda name: table(spark, sf, name)
    nations = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("region")).agg(F.collect_list("n_name").alias("nations"))
    nations.repartition(8, "region").selectExpr("to_json(named_struct('region', region, 'nations', nations)) AS value").write.option("maxRecordsPerFile", 1).text(f"{root}/json")
    t("supplier").select(F.col("s_name").alias("name"), F.struct(F.array(F.lit("a"), F.lit("b"), F.col("s_suppkey").cast("string")).alias("tags"), F.lit(1.5).alias("_n")).alias("part")).selectExpr("to_json(named_struct('name', name, 'part', named_struct('tags', part.tags))) AS value").write.text(f"{root}/jsonl")
    t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.lit('x, "y"').alias("note")).write.option("header", "true").option("escape", '"').csv(f"{root}/csv")
    t("customer").select("c_name", "c_custkey", F.struct(F.struct(F.array("c_mktsegment", F.lit("z")).alias("more")).alias("inner")).alias("nested")).write.parquet(f"{root}/parquet")
    t("part").select("p_name").write.text(f"{root}/text")
    line = F.format_string("event_%s:\n  list: [%s, 3, {tail: null}]", "event_type", "event_type")
    t("events").select("event_type").distinct().select(line.alias("value")).write.text(f"{root}/yaml")
    out = None
    for format in ("json", "jsonl", "csv", "parquet", "text", "yaml"):
        one = strings_of(spark, f"{root}/{format}", format).select(F.lit(format).alias("format"), "text")
        out = one if out is None else out.unionByName(one)
    return out.groupBy("format", "text").agg(F.count("*").alias("n"))


@add("a16_committed_shards", "SELECT event_id, value, event_id % 3 AS batch, true AS fits FROM events")
def a16(spark, sf):
    """Three batches in shards of at most 100 rows; one is tried twice before it is committed, one comes again."""
    shards = Shards(folder(spark), rows=100)
    e = table(spark, sf, "events").select("event_id", "value")
    for batch in range(3):
        rows = e.where(F.col("event_id") % 3 == batch)
        if batch == 1:
            shards.stage(e, 1)  # a run that ended before its commit
        shards.write(rows, batch)
        shards.write(e, batch)  # the batch again, with other rows: nothing happens
    listed = shards.manifest(spark).where("rows <= 100 and last = rows - 1").select("batch", "shard", "rows")
    found = shards.read(spark, e.schema).join(listed, ["batch", "shard"])
    return found.select("event_id", "value", "batch", (F.col("offset") < F.col("rows")).alias("fits"))


@add("a24_streamed_trace", f"WITH {BANK}, p AS (SELECT q.id AS q_id, b.id, round(list_dot_product(q.unit, b.unit), 6) AS score FROM units q JOIN units b ON q.episode <> b.episode AND q.task = b.task), k AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, id) AS rank FROM p) SELECT q_id, list(id ORDER BY rank) AS ids, list(score ORDER BY rank) AS scores FROM k WHERE rank <= 3 GROUP BY 1")
def a24(spark, sf):
    """Requests arrive as a stream; each one's ranked matches are a line of the trace, once."""
    b = bank(spark, sf)
    matches = rt.block_top_k(b, b, 3, same_task=True).groupBy("q_id").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("m"))
    ranked = matches.select("q_id", F.col("m.id").alias("ids"), F.transform("m.score", lambda x: signed_round(x, 6)).alias("scores"))
    asked = spark.readStream.schema(table(spark, sf, "embeddings").schema).parquet(f"{sf}/embedding*.parquet").select(F.col("vec_id").alias("q_id"))
    trace = Shards(folder(spark), rows=1000, format="json")
    for _ in range(2):  # started again, it goes on after what it has written
        query = trace.commit_stream(asked.join(ranked, "q_id"), f"{trace.path}/state")
        query.awaitTermination()
    return trace.read(spark, ranked.schema).select("q_id", "ids", "scores")


@add("h19_stats_of_a_revision", """WITH d AS (SELECT label, i, min(embedding[i]::FLOAT) AS lo, max(embedding[i]::FLOAT) AS hi FROM embeddings, range(1, 65) r(i) GROUP BY 1, 2),
s AS (SELECT label, list(lo ORDER BY i) AS low, list(hi ORDER BY i) AS high FROM d GROUP BY 1)
SELECT label, CASE WHEN label % 2 = 0 THEN 'r3' ELSE 'r2' END AS found, label % 2 = 0 AS exact, [x::DOUBLE FOR x IN low] AS low, [x::DOUBLE FOR x IN high] AS high FROM s""")
def h19(spark, sf):
    """Revision r3 has statistics of half the tasks; for the others those of r2 stand in."""
    d = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    per = d.groupBy("label", "i").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).groupBy("label")
    own = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("i", c))), lambda s: s[c].cast("double"))
    stats = per.agg(F.create_map(F.lit("min"), own("lo"), F.lit("max"), own("hi")).alias("statistics"))
    stats = stats.withColumn("signature", signature_digest(F.col("label"), F.lit("minmax").alias("mode")))
    path = folder(spark)
    blank = F.map_from_arrays(F.array(F.lit("min")), F.array(F.array(F.lit(0.0))))
    stats_cache.keep(stats.select("signature", F.lit("r1").alias("revision"), blank.alias("statistics")), path)
    stats_cache.keep(stats.select("signature", F.lit("r2").alias("revision"), "statistics"), path)
    stats_cache.keep(stats.where("label % 2 = 0").select("signature", F.lit("r3").alias("revision"), "statistics"), path)
    names = stats.select("label", F.col("signature").alias("_s"))
    found = stats_cache.find(spark, path, stats.select("signature", F.lit("r3").alias("revision")))
    doubles = lambda c: F.col("statistics")[c].cast("array<double>")
    return found.join(names, F.col("signature") == F.col("_s")).select("label", "found", "exact", doubles("min").alias("low"), doubles("max").alias("high"))


SUITES = ["MACHINERY", "BUILDING", "FURNITURE"]
FILES = f"""f AS (SELECT c_mktsegment AS suite, list_position({SUITES}, c_mktsegment) AS place, c_nationkey::BIGINT AS task_id, c_custkey % 2 AS gpu, sum(5 + c_custkey % 3)::BIGINT AS n, sum(c_custkey % 5)::BIGINT AS s, sum(c_custkey % 7)::DOUBLE AS t,
CASE WHEN c_nationkey % 4 = 0 THEN NULL ELSE avg(c_custkey % 11) END AS psnr FROM customer WHERE c_mktsegment IN {tuple(SUITES)} GROUP BY c_mktsegment, c_nationkey, c_custkey % 2)"""


def result_files(spark, sf):
    """One file a suite, device and task, beside files that are none."""
    c = table(spark, sf, "customer").where("c_mktsegment <> 'HOUSEHOLD'")
    per = c.groupBy("c_mktsegment", "c_nationkey", (F.col("c_custkey") % 2).alias("gpu")).agg(
        F.sum(5 + F.col("c_custkey") % 3).alias("total_episodes"), F.sum(F.col("c_custkey") % 5).alias("successes"), F.sum(F.col("c_custkey") % 7).cast("double").alias("duration"), F.avg(F.col("c_custkey") % 11).alias("p"))
    per = per.withColumns({"task_description": F.concat(F.lit("pick "), "c_nationkey"), "future_video_psnr_mean": F.when(F.col("c_nationkey") % 4 != 0, F.col("p"))})
    value = F.to_json(F.struct("total_episodes", "successes", "duration", "task_description", "future_video_psnr_mean"))
    name = F.format_string("gpu%d_task%d_results.json", "gpu", "c_nationkey")
    path = folder(spark)
    rows = per.select("c_mktsegment", F.explode(F.array(name, F.concat(F.lit("notes_"), name))).alias("file"), value.alias("value"))
    rows.repartition(8, "c_mktsegment", "file").write.partitionBy("c_mktsegment", "file").text(path)
    return tf.result_files(spark, path, SUITES)


@add("k01_suite_statistics", f"WITH {FILES} SELECT suite, place, count(*) AS total_tasks, sum(n)::BIGINT AS total_trials, sum(s)::BIGINT AS total_successes, sum(t) AS total_time, max(t) AS max_time, round(avg(psnr), 6) AS average_psnr FROM f GROUP BY 1, 2")
def k01_suites(spark, sf):
    return tf.suite_statistics(result_files(spark, sf)).withColumn("place", F.col("place").cast("int")).withColumn("average_psnr", signed_round("average_psnr", 6))


@add("k01_printed_tasks", f"""WITH {FILES}, o AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY suite, task_id ORDER BY gpu DESC) = 1),
t AS (SELECT place::BIGINT AS place, task_id, suite || '_' || task_id AS a, 'pick ' || task_id AS b, printf('%.2f', s * 100.0 / n) AS c, coalesce(printf('%.4f', psnr), 'N/A') AS d FROM o UNION ALL SELECT 0, 0, 'Task', 'Description', 'Success Rate (%)', 'Future Video PSNR (dB)'),
w AS (SELECT max(len(a))::INT AS wa, max(len(b))::INT AS wb, max(len(c))::INT AS wc, max(len(d))::INT AS wd FROM t)
SELECT place, task_id, lpad(a, wa, ' ') || ' ' || lpad(b, wb, ' ') || ' ' || lpad(c, wc, ' ') || ' ' || lpad(d, wd, ' ') AS line FROM t, w""")
def k01_lines(spark, sf):
    return tf.task_lines(result_files(spark, sf))


@add("d08_sampled_cells", """WITH s AS (SELECT vec_id, embedding, 8 + vec_id * 37 % 24 AS h, 8 + vec_id * 53 % 24 AS w FROM embeddings), k AS (SELECT *, CASE WHEN greatest(h, w) < 16 THEN 1 ELSE greatest(h, w) // 8 END AS stride FROM s)
SELECT vec_id, stride, [[embedding[((i * w + j) % 64 + 1)::INT]::DOUBLE FOR j IN range(0, w, stride)] FOR i IN range(0, h, stride)] AS cells FROM k""")
def d08(spark, sf):
    """Pictures of several sizes, made of the vectors' components, read at every second or third row and column."""
    v = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"), (8 + F.col("vec_id") * 37 % 24).alias("h"), (8 + F.col("vec_id") * 53 % 24).alias("w"))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    picture = F.transform(upto("h"), lambda i: F.transform(upto("w"), lambda j: F.get("e", ((i * F.col("w") + j) % 64).cast("int"))))
    v = v.withColumns({"picture": picture, "stride": tf.image_stride(F.col("h"), F.col("w"), 8, 16)})
    return v.select("vec_id", "stride", tf.sampled_cells(F.col("picture"), F.col("stride")).alias("cells"))


QUERIES, ORACLES = add.queries, add.oracles
