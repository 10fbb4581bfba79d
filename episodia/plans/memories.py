"""Queries of the episode memories; the SQL folds the records one by one in a recursive CTE, with the entries as a list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from episodia.operators import memory
from episodia.plans.common import Registry, signed_round
from episodia.session import table
from episodia.streaming import memories, silence

add = Registry()

ENTRIES = "STRUCT(phase DOUBLE[], effect DOUBLE[], count BIGINT, attempt INTEGER, step BIGINT, entry BIGINT)[]"


def unit(x: str) -> str:
    return f"list_transform({x}, lambda v: v / greatest(sqrt(list_dot_product({x}, {x})), 1e-12))"


def joined(own: str, new: str) -> str:
    mean = f"list_transform(list_zip(e.{own}, {new}), lambda z: (z[1] * e.count + z[2]) / (e.count + 1))"
    return unit(mean)


def folded_sql(records: str, capacity: int, threshold: float, ring: int = 4) -> str:
    """``s``: the state after record ``n`` of each episode, from ``records(episode, n, place, kind, attempt, task, phase, effect)``.

    ``slot`` and ``merged`` say where an effect went.
    """
    return f"""RECURSIVE records AS ({records}),
r AS (SELECT *, {unit("phase")} AS p, {unit("effect")} AS f FROM records),
s(episode, n, status, task, attempt, effects, ring, entries, made, slot, merged) AS (
  SELECT DISTINCT episode, 0::BIGINT, '', NULL::VARCHAR, 0, 0::BIGINT, []::STRUCT(effect DOUBLE[], step BIGINT)[], []::{ENTRIES}, 0::BIGINT, NULL::BIGINT, NULL::BOOLEAN FROM records
  UNION ALL SELECT episode, n, problem,
    CASE WHEN problem = 'ok' AND kind = 'reset' THEN asked_task ELSE task END,
    CASE WHEN problem <> 'ok' THEN attempt WHEN kind = 'reset' THEN 0 WHEN kind = 'attempt' THEN asked_attempt ELSE attempt END,
    CASE WHEN problem <> 'ok' THEN effects WHEN kind IN ('reset', 'attempt') THEN 0 WHEN kind = 'effect' THEN effects + 1 ELSE effects END,
    CASE WHEN problem <> 'ok' THEN ring WHEN kind IN ('reset', 'attempt', 'end') THEN [] WHEN kind = 'effect' THEN list_append(ring, {{'effect': raw, 'step': effects * {memories.WINDOW}}})[-{ring}:] ELSE ring END,
    CASE WHEN problem <> 'ok' THEN entries WHEN kind = 'reset' THEN [] WHEN kind <> 'effect' THEN entries
      WHEN near THEN list_transform(entries, lambda e, i: CASE WHEN i = best THEN {{'phase': {joined("phase", "p")}, 'effect': {joined("effect", "f")}, 'count': e.count + 1, 'attempt': attempt, 'step': at_step, 'entry': e.entry}} ELSE e END)
      ELSE list_append(CASE WHEN len(entries) >= {capacity} THEN list_filter(entries, lambda e, i: i <> least_used) ELSE entries END, {{'phase': p, 'effect': f, 'count': 1::BIGINT, 'attempt': attempt, 'step': at_step, 'entry': made}}) END,
    CASE WHEN problem = 'ok' AND kind = 'effect' AND NOT near THEN made + 1 ELSE made END,
    CASE WHEN problem = 'ok' AND kind = 'effect' THEN CASE WHEN near THEN best - 1 ELSE least(len(entries), {capacity} - 1) END END,
    CASE WHEN problem = 'ok' AND kind = 'effect' THEN near END
  FROM (SELECT *, coalesce(len(entries) > 0 AND list_max(scores) >= {threshold}, false) AS near, list_position(scores, list_max(scores)) AS best, list_position(uses, list_min(uses)) AS least_used
    FROM (SELECT s.episode, r.n, r.kind, r.attempt AS asked_attempt, r.task AS asked_task, r.p, r.f, r.effect AS raw, s.task, s.attempt, s.effects, s.ring, s.entries, s.made, coalesce(r.step, s.effects * {memories.WINDOW}) AS at_step,
      CASE WHEN r.kind = 'reset' THEN 'ok' WHEN s.task IS NULL THEN 'no reset' WHEN r.kind = 'attempt' AND r.attempt - s.attempt NOT IN (0, 1) THEN 'attempt' WHEN r.kind = 'effect' AND r.task <> s.task THEN 'task' ELSE 'ok' END AS problem,
      list_transform(s.entries, lambda e: 0.5 * list_dot_product(e.phase, r.p) + 0.5 * list_dot_product(e.effect, r.f)) AS scores,
      list_transform(s.entries, lambda e, i: {{'count': e.count, 'attempt': e.attempt, 'step': e.step, 'i': i}}) AS uses
      FROM s JOIN r ON r.episode = s.episode AND r.n = s.n + 1)))"""


def near_sql(state: str, record: str, hits: int) -> str:
    """The nearest entries of a state by a record's phase, earlier ones first among equals."""
    return f"list_sort(list_transform({state}.entries, lambda e, i: {{'far': -list_dot_product(e.phase, {record}.p), 'i': i, 'entry': e.entry, 'count': e.count, 'attempt': e.attempt, 'step': e.step}}))[1:{hits}]"


HALVES = "[x::DOUBLE FOR x IN embedding[1:32]] AS phase, [x::DOUBLE FOR x IN embedding[33:64]] AS effect"


def halves() -> tuple:
    e = F.col("embedding").cast("array<double>")
    return F.slice(e, 1, 32).alias("phase"), F.slice(e, 33, 32).alias("effect")


EPISODE = 25
KIND = "CASE WHEN p = 0 THEN 'reset' WHEN p = 12 THEN 'end' WHEN p IN (8, 16, 20) THEN 'attempt' WHEN p % 3 = 2 THEN 'query' ELSE 'effect' END"
RECORDS = f"""SELECT vec_id // {EPISODE} AS episode, row_number() OVER (PARTITION BY vec_id // {EPISODE} ORDER BY p) AS n, p AS place, {KIND} AS kind,
(CASE p WHEN 8 THEN 1 WHEN 16 THEN 2 WHEN 20 THEN 7 ELSE 0 END)::INTEGER AS attempt, CASE WHEN p = 13 THEN 'other' ELSE 'task' END AS task, NULL::BIGINT AS step, {HALVES}
FROM (SELECT *, vec_id % {EPISODE} AS p FROM embeddings) WHERE NOT (p = 0 AND vec_id % 4 = 3)"""


def records(spark: SparkSession, sf: str) -> DataFrame:
    """Every 25 vectors are an episode: effects and queries, two further attempts, one that skips, one effect of another task, some without a reset."""
    p = F.col("vec_id") % EPISODE
    rows = table(spark, sf, "embeddings").where(~((p == 0) & (F.col("vec_id") % 4 == 3)))
    kind = F.when(p == 0, "reset").when(p == 12, "end").when(p.isin(8, 16, 20), "attempt").when(p % 3 == 2, "query").otherwise("effect")
    attempt = F.when(p == 8, 1).when(p == 16, 2).when(p == 20, 7).otherwise(0)
    task = F.when(p == 13, "other").otherwise("task")
    return rows.select(F.floor(F.col("vec_id") / EPISODE).alias("episode"), p.alias("place"), kind.alias("kind"), attempt.alias("attempt"), task.alias("task"), *halves())


CAPACITY, THRESHOLD, HITS, RING = 5, 0.12, 3, 4


@add("i05_lifecycle_replies", f"WITH {folded_sql(RECORDS, CAPACITY, THRESHOLD, RING)} SELECT s.episode, r.place, r.kind, s.status, s.attempt, s.effects FROM s JOIN r USING (episode, n) WHERE r.kind <> 'query'")
def i05(spark, sf):
    """The reply to every record that changes memories."""
    got = memories.replay(records(spark, sf), capacity=CAPACITY, threshold=THRESHOLD, hits=HITS, ring_size=RING)
    return got.where("kind <> 'query'").select("episode", "place", "kind", "status", "attempt", "effects")


@add("i06_memory_query", f"""WITH {folded_sql(RECORDS, CAPACITY, THRESHOLD, RING)}, q AS (SELECT s.*, r.place, {near_sql("s", "r", HITS)} AS found FROM s JOIN r USING (episode, n) WHERE r.kind = 'query')
SELECT episode, place, status, attempt, effects, CASE WHEN status = 'ok' THEN list_transform(ring, lambda x: x.effect) END AS ring, CASE WHEN status = 'ok' THEN list_transform(ring, lambda x: x.step) END AS ring_steps,
{", ".join(f"CASE WHEN status = 'ok' THEN list_transform(found, lambda x: x.{c}) END AS hit_{c}" for c in ("entry", "count", "attempt", "step"))}, CASE WHEN status = 'ok' THEN list_transform(found, lambda x: round(-x.far, 6)) END AS hit_score FROM q""")
def i06(spark, sf):
    """Both memories as every query sees them, with the provenance of the entries found."""
    got = memories.replay(records(spark, sf), capacity=CAPACITY, threshold=THRESHOLD, hits=HITS, ring_size=RING).where("kind = 'query'")
    kept = [F.col(f"hits.{c}").alias(f"hit_{c}") for c in ("entry", "count", "attempt", "step")]
    return got.select("episode", "place", "status", "attempt", "effects", "ring", "ring_steps", *kept, F.transform("hits.score", lambda x: signed_round(x, 6)).alias("hit_score"))


def effects_sql(size: int) -> str:
    """Every ``size`` vectors are an episode of effects only, after a reset that the SQL needs."""
    rows = f"SELECT vec_id // {size} AS episode, row_number() OVER (PARTITION BY vec_id // {size} ORDER BY vec_id) + 1 AS n, vec_id AS place, 'effect' AS kind, ((vec_id % {size}) // 7)::INTEGER AS attempt, 'task' AS task, vec_id AS step, {HALVES} FROM embeddings"
    start = f"SELECT DISTINCT vec_id // {size}, 1::BIGINT, -1::BIGINT, 'reset', 0, 'task', NULL::BIGINT, [1.0::DOUBLE], [1.0::DOUBLE] FROM embeddings"
    return f"{rows} UNION ALL {start}"


def effects(spark: SparkSession, sf: str, size: int) -> DataFrame:
    v = F.col("vec_id")
    return table(spark, sf, "embeddings").select(F.floor(v / size).alias("episode"), v.alias("step"), F.lit(0).alias("attempt"), *halves())


@add("i01_merged_memory", f"WITH {folded_sql(effects_sql(20), 256, THRESHOLD)} SELECT s.episode, r.place AS step, s.slot, s.merged, len(s.entries)::BIGINT AS size FROM s JOIN r USING (episode, n) WHERE r.kind = 'effect'")
def i01(spark, sf):
    """Many observations join an entry."""
    return memory.merge_memory(effects(spark, sf, 20), threshold=THRESHOLD)


#: The query of ``plans.vectors``: five observations an episode, the operator's own threshold.
add.oracles["i01_merge_memory"] = f"WITH {folded_sql(effects_sql(5), 256, 0.85)} SELECT s.episode, r.place AS step, s.slot, s.merged, len(s.entries)::BIGINT AS size FROM s JOIN r USING (episode, n) WHERE r.kind = 'effect'"


@add("i02_merged_and_evicted", f"WITH {folded_sql(effects_sql(50), 4, THRESHOLD)} SELECT s.episode, r.place AS step, s.slot, s.merged, len(s.entries)::BIGINT AS size FROM s JOIN r USING (episode, n) WHERE r.kind = 'effect'")
def i02(spark, sf):
    """Observations join entries, and the least used entry makes room."""
    return memory.merge_memory(effects(spark, sf, 50), capacity=4, threshold=THRESHOLD)


@add("f08_recall_of_merged", f"""WITH {folded_sql(effects_sql(50), 8, THRESHOLD)}, q AS (SELECT r.episode, r.place AS step, {near_sql("s", "r", 4)} AS found FROM s JOIN r ON r.episode = s.episode AND r.n = s.n + 1 WHERE r.kind = 'effect'),
u AS (SELECT episode, step, unnest(found) AS x, unnest(range(1, len(found) + 1)) AS rank FROM q) SELECT episode, step, rank, x.step AS entry_step, round(-x.far, 6) AS score FROM u""")
def f08(spark, sf):
    """What each row finds among merged entries, before it is added."""
    return memory.recall_memory(effects(spark, sf, 50), capacity=8, threshold=THRESHOLD).withColumn("score", signed_round("score", 6))


@add("j04_closed_sessions", """WITH l AS (SELECT user_id AS session, ts, event_id AS seq, event_type = 'signup' AS reset, sum((event_type = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS life FROM events),
g AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY session, life ORDER BY ts, seq) > INTERVAL 1 DAY, false) AS gap FROM l WHERE life > 0),
x AS (SELECT *, bool_or(gap) OVER (PARTITION BY session, life ORDER BY ts, seq) AS late FROM g),
a AS (SELECT session, life, min(ts) AS opened, max(ts) FILTER (WHERE NOT late) + INTERVAL 1 DAY AS silent, count(*) FILTER (WHERE NOT late AND NOT reset) AS acts, count(*) FILTER (WHERE late) AS rejected FROM x GROUP BY ALL),
n AS (SELECT *, coalesce(lead(opened) OVER (PARTITION BY session ORDER BY life) <= silent, false) AS again, lead(opened) OVER (PARTITION BY session ORDER BY life) AS following FROM a)
SELECT session, opened, CASE WHEN again THEN following ELSE silent END AS closed, CASE WHEN again THEN 'reset' ELSE 'silence' END AS why, acts, acts // 4 AS groups, acts % 4 AS discarded, rejected FROM n WHERE again OR silent < TIMESTAMP '2024-01-29'""")
def j04(spark, sf):
    """Users' sessions start with a sign-up and close after a day of silence; a group of acts that is not complete is discarded."""
    e = table(spark, sf, "events")
    rows = e.select(F.col("user_id").alias("session"), "ts", F.col("event_id").alias("seq"), F.when(F.col("event_type") == "signup", "reset").otherwise("act").alias("kind"))
    return silence.closed(rows, 86_400, "2024-01-29")


QUERIES, ORACLES = add.queries, add.oracles
