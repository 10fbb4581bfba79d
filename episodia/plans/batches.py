"""Balanced batches, written windows and traces, recall, tied scores and finals (A21, A24, E03, F03, F08, G08, J03)."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from episodia.operators import memory, metadata as md, retrieval as rt, sampling as sm, trajectories as tr
from episodia.plans.common import BANK, FRAMES, Registry, bank, frames, signed_round
from episodia.session import table
from episodia.sources import scratch, tables
from episodia.streaming import lifecycle

add = Registry()
MD5 = "md5(CAST({0} AS VARCHAR) || ':{1}')"


@add("a21_written_transitions", f"""WITH {FRAMES}, f AS (SELECT *, lead(value) OVER (PARTITION BY episode_index ORDER BY frame_index) AS nxt FROM frames),
w AS (SELECT episode_index, frame_index // 4 AS transition_index, arg_min(value, frame_index) AS before, count(*) = 4 AND count(nxt) = 4 AS valid FROM f GROUP BY 1, 2)
SELECT episode_index, transition_index, before, (SELECT count(*) FROM w WHERE valid) AS in_manifest FROM w WHERE valid""")
def a21(spark, sf):
    path = scratch.folder(spark)
    rows = tr.transitions(frames(spark, sf), "value").where("valid").withColumn("source_index", F.col("episode_index") * (1 << 32) + F.col("transition_index"))
    tables.write_transitions(rows, path, "source_index", 500)
    n = tables.read_jsonl(spark, f"{path}/manifest", "file string, rows long").agg(F.sum("rows").alias("in_manifest"))
    return spark.read.schema(rows.schema).parquet(f"{path}/windows").select("episode_index", "transition_index", "before").crossJoin(n)  # one row


TRACE = f"""WITH {BANK}, p AS (SELECT q.id AS q_id, b.id, round(list_dot_product(q.unit, b.unit), 6) AS score FROM units q JOIN units b ON q.episode <> b.episode AND q.task = b.task),
k AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, id) AS rank FROM p)"""


@add("a24_appended_trace", TRACE + " SELECT q_id AS event, list({'id': id, 'rank': rank, 'score': score} ORDER BY rank) AS matches FROM k WHERE rank <= 3 GROUP BY 1")
def a24(spark, sf):
    b = bank(spark, sf)
    match = F.struct("id", F.col("rank").cast("long").alias("rank"), "score")
    found = scratch.stored(rt.block_top_k(b, b, 3, same_task=True).groupBy(F.col("q_id").alias("event")).agg(F.array_sort(F.collect_list(match), lambda x, y: (x["rank"] - y["rank"]).cast("int")).alias("matches")))
    path = scratch.folder(spark)
    for part in (F.col("event") % 2 == 0, F.col("event") % 2 == 1):  # two appends, as of two runs
        tables.append_jsonl(found.where(part), path)
    return tables.read_jsonl(spark, path, "event long, matches array<struct<id: long, rank: long, score: double>>")


@add("e03_window_offsets", "SELECT past, size, [round(t / 10.0, 6) FOR t IN range(-past, size - past)] AS seconds FROM (SELECT r_regionkey AS past, r_regionkey + 4 AS size FROM region)")
def e03(spark, sf):
    sizes = [(past, past + 4, [round(x, 6) for x in md.window_offsets(past, past + 4, fps=10.0)]) for past in range(5)]
    known = spark.createDataFrame(sizes, "past int, size int, seconds array<double>")
    return table(spark, sf, "region").select(F.col("r_regionkey").cast("int").alias("past")).join(known, "past")


@add("f03_tied_topk", """WITH s AS (SELECT vec_id AS id, label AS task, vec_id // 5 AS episode, [CASE WHEN x > 0 THEN 1 ELSE -1 END FOR x IN embedding[1:6]] AS v FROM embeddings),
p AS (SELECT q.id AS q_id, b.id, list_sum(list_transform(range(1, 7), lambda i: q.v[i] * b.v[i])) AS score FROM s q JOIN s b ON q.task = b.task AND q.episode <> b.episode),
k AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, id) AS rank FROM p) SELECT q_id, rank, id, CAST(score AS BIGINT) AS score FROM k WHERE rank <= 4""")
def f03(spark, sf):
    signs = F.transform(F.slice("vector", 1, 6), lambda x: F.when(x > 0, F.lit(1.0)).otherwise(F.lit(-1.0)))
    b = bank(spark, sf).withColumn("unit", signs)
    return rt.block_top_k(b, b, 4, block=256, same_task=True).select("q_id", F.col("rank").cast("long").alias("rank"), "id", F.col("score").cast("long").alias("score"))


@add("f08_memory_recall", """WITH b AS (SELECT vec_id AS step, vec_id // 5 AS episode, [CAST(x AS DOUBLE) FOR x IN embedding[1:32]] AS p FROM embeddings),
u AS (SELECT step, episode, [x / greatest(sqrt(list_dot_product(p, p)), 1e-12) FOR x IN p] AS p FROM b),
s AS (SELECT q.episode, q.step, e.step AS entry_step, round(list_dot_product(q.p, e.p), 6) AS score FROM u q JOIN u e ON e.episode = q.episode AND e.step < q.step)
SELECT episode, step, row_number() OVER (PARTITION BY step ORDER BY score DESC, entry_step) AS rank, entry_step, score FROM s QUALIFY rank <= 3""")
def f08(spark, sf):
    """Entries that never merge (no cosine reaches the threshold): the state is then all earlier rows."""
    b = bank(spark, sf)
    rows = b.select("episode", F.col("id").alias("step"), F.lit(0).alias("attempt"), F.slice("vector", 1, 32).alias("phase"), F.slice("vector", 33, 32).alias("effect"))
    return memory.recall_memory(rows, 3, threshold=2.0).withColumn("score", signed_round("score", 6))


G08 = f"""WITH o AS (SELECT vec_id, label, vec_id // 5 AS e, row_number() OVER (PARTITION BY label, vec_id // 5 ORDER BY {MD5.format('vec_id', 11)}, vec_id) AS turn FROM embeddings),
p AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY turn, {MD5.format('e', 11)}, e, vec_id) - 1 AS pl, count(*) OVER (PARTITION BY label) AS n FROM o),
c AS (SELECT *, pl // 4 AS chunk, (pl // 4 + 1) * 4 <= n AS whole FROM p),
l AS (SELECT DISTINCT label, chunk FROM c WHERE whole),
r AS (SELECT label, chunk, row_number() OVER (PARTITION BY chunk ORDER BY {MD5.format("label || ',' || chunk", 11)}, label) AS rk, count(*) OVER (PARTITION BY chunk) AS m FROM l),
f AS (SELECT label, chunk, row_number() OVER (ORDER BY chunk, rk) - 1 AS no FROM r WHERE rk <= m // 4 * 4),
b AS (SELECT c.*, f.no FROM c LEFT JOIN f ON f.label = c.label AND f.chunk = c.chunk AND c.whole),
q AS (SELECT vec_id, no * 4 + pl % 4 AS pos, 'primary' AS tier FROM b WHERE no IS NOT NULL
      UNION ALL SELECT vec_id, row_number() OVER (ORDER BY pl = n - 1 AND pl % 4 % 2 = 0, chunk, {MD5.format("label || ',' || chunk", 11)}, label, pl) - 1 + (SELECT count(*) * 4 FROM f), 'adaptive' FROM b WHERE no IS NULL),
t AS (SELECT count(*) AS n FROM q),
w AS (SELECT vec_id, pos, tier FROM q UNION ALL SELECT vec_id, pos + t.n, 'wrap' FROM q, t WHERE pos < (16 - t.n % 16) % 16)
SELECT vec_id, CAST(pos // 16 AS BIGINT) AS batch, CAST(pos % 16 AS BIGINT) AS slot, tier FROM w"""


@add("g08_balanced_batches", G08)
def g08(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", "label", F.floor(F.col("vec_id") / 5).alias("episode"))
    return sm.balanced_batches(rows, "label", "episode", "vec_id", 4, 4, 11)


@add("j03_finals", """WITH n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1)
SELECT CAST(conv_id AS VARCHAR) AS session, n + 1 AS seq, CASE WHEN conv_id % 3 = 0 THEN 'fault' ELSE 'ok' END AS status, n // 4 AS groups FROM n
UNION ALL SELECT CAST(conv_id AS VARCHAR), n + 2, CASE WHEN conv_id % 3 = 0 THEN 'latched' ELSE 'repeat' END, n // 4 FROM n""")
def j03(spark, sf):
    """Every session ends with a final and its repeat; every third names a step too many at first."""
    c = table(spark, sf, "conversations").select("conv_id", F.col("conv_id").cast("string").alias("session"), "turn")
    w = Window.partitionBy("session").orderBy("turn")
    request = lambda seq, kind, step: [seq.cast("long").alias("seq"), F.lit(kind).alias("kind"), F.lit(0).alias("attempt"), step.cast("long").alias("step")]
    place = F.row_number().over(w)
    acts = c.select("session", *request(place, "act", place - 1))
    n = c.groupBy("conv_id", "session").agg(F.count("*").alias("n"))
    wrong = (F.col("conv_id") % 3 == 0).cast("int")
    rows = acts.unionByName(n.select("session", *request(F.lit(0), "reset", F.lit(0))))
    rows = rows.unionByName(n.select("session", *request(F.col("n") + 1, "final", F.col("n") + wrong))).unionByName(n.select("session", *request(F.col("n") + 2, "final", F.col("n"))))
    return lifecycle.replay(rows).where("kind = 'final'").select("session", "seq", "status", "groups")


QUERIES, ORACLES = add.queries, add.oracles
