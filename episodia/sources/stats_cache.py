"""Statistics kept as JSON by signature and revision, and found again, if need be those of another revision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

VALUES = "map<string,array<float>>"


def encoded(statistics: Column) -> Column:
    """JSON of a map of number lists."""
    return F.to_json(statistics.cast("map<string,array<double>>"))


def decoded(text: Column) -> Column:
    """The map of number lists, as 32-bit floats; null for what is no such JSON."""
    return F.from_json(text, "map<string,array<double>>").cast(VALUES)


def keep(statistics: DataFrame, path: str) -> None:
    """Write ``signature, revision, statistics``, a file each, below ``path``; what is there of the same signature and revision is replaced."""
    rows = statistics.select("signature", "revision", encoded(F.col("statistics")).alias("value"))
    rows.repartition("signature", "revision").write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("signature", "revision").text(path)


def find(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """``signature, revision, found, exact, statistics`` of each wanted signature and revision.

    Statistics of another revision stand in where the wanted one has none, the
    greatest of them; without any, ``found`` and ``statistics`` are null.
    """
    held = spark.read.schema("value string, signature string, revision string").text(path)
    held = held.select(F.col("signature").alias("_s"), F.col("revision").alias("found"), "value")
    asked = wanted.select("signature", "revision")
    exact = F.coalesce(F.col("found") == F.col("revision"), F.lit(False))
    best = Window.partitionBy("signature", "revision").orderBy(F.desc("exact"), F.desc_nulls_last("found"))
    both = asked.join(held, F.col("signature") == F.col("_s"), "left").withColumn("exact", exact)
    first = both.withColumn("_r", F.row_number().over(best)).where("_r = 1")
    return first.select("signature", "revision", "found", "exact", decoded(F.col("value")).alias("statistics"))
