"""Stand-ins for trajectory tables over the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from episodia.operators import retrieval, trajectories as tr
from episodia.session import table

FRAMES = "frames AS (SELECT user_id AS episode_index, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_index, event_id, ts, event_type, value, user_id % 10 AS task FROM events)"
LENGTHS = "lengths AS (SELECT user_id AS episode_index, count(*) AS length FROM events GROUP BY 1)"
BANK = "bank AS (SELECT vec_id AS id, label AS task, vec_id // 5 AS episode, [CAST(x AS DOUBLE) FOR x IN embedding] AS vector FROM embeddings), units AS (SELECT id, task, episode, vector, [x / greatest(sqrt(list_dot_product(vector, vector)), 1e-12) FOR x IN vector] AS unit FROM bank)"


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, name: str, oracle: str | None = None):
        def add(f):
            self.queries[name] = f
            if oracle:
                self.oracles[name] = oracle
            return f

        return add


def signed_round(x: Column | str, digits: int) -> Column:
    """``round`` as in SQL, where what rounds to zero from below keeps its sign; Spark's makes it 0.0."""
    x = F.col(x) if isinstance(x, str) else x
    r = F.round(x, digits)
    return F.when(r == 0, x * 0.0).otherwise(r)


def frames(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type", "value", (F.col("user_id") % 10).alias("task"))
    return tr.index_frames(rows, "user_id", "ts", "event_id")


def lengths(spark: SparkSession, sf: str) -> DataFrame:
    return tr.episode_lengths(table(spark, sf, "events").select(F.col("user_id").alias("episode_index")))


def bank(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("task"), F.floor(F.col("vec_id") / 5).alias("episode"), F.col("embedding").cast("array<double>").alias("vector"))
    return rows.withColumn("unit", retrieval.l2_normalise(F.col("vector")))
