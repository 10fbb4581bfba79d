"""Readers and writers for trajectory data sets and their metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def episodes(spark: SparkSession, path: str, key: str, wanted: list[int] | None = None, columns: list[str] | None = None, keep_order: bool = False) -> DataFrame:
    """Rows of the wanted episodes; the list becomes a pushed-down ``In`` filter, the columns a pruned schema.

    ``keep_order`` adds ``episode_order``, the place in the given list.
    """
    rows = spark.read.parquet(path)
    if columns is not None:
        rows = rows.select(*columns)
    if wanted is None:
        return rows
    rows = rows.where(F.col(key).isin(wanted))
    if keep_order:
        order = spark.createDataFrame([(e, i) for i, e in enumerate(wanted)], f"`{key}` long, episode_order long")
        rows = rows.join(F.broadcast(order), key)  # the given list: its length is the caller's
    return rows


def chunk_of(episode: Column, size: int = 1000) -> Column:
    return F.floor(episode / size)


def episode_path(episode: Column, size: int = 1000) -> Column:
    return F.format_string("data/chunk-%03d/episode_%06d.parquet", chunk_of(episode, size), episode)


def write_episodes(frames: DataFrame, path: str, size: int = 1000, rows_in_file: int = 1_000_000) -> None:
    """One folder a chunk, clustered by episode; refuses to overwrite."""
    out = frames.withColumn("chunk", chunk_of(F.col("episode_index"), size))
    out.repartition("chunk", "episode_index").sortWithinPartitions("episode_index", "frame_index").write.option("maxRecordsPerFile", rows_in_file).partitionBy("chunk").mode("errorifexists").parquet(path)


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON lines; raw control characters inside strings are tolerated."""
    reader = spark.read.option("allowUnquotedControlChars", "true")
    return (reader.schema(schema) if schema else reader).json(path)


def append_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_transitions(rows: DataFrame, path: str, key: str, rows_in_file: int = 1_000_000) -> None:
    """Windows below ``path/windows`` and a manifest of files and their rows in ``path/manifest``; a repeated ``key`` is an error."""
    twice = rows.groupBy(key).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{key} {twice[0][0]} stands on several rows")
    rows.write.option("maxRecordsPerFile", rows_in_file).mode("errorifexists").parquet(f"{path}/windows")
    files = rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/windows").groupBy(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"))
    files.agg(F.count("*").alias("rows"), F.min(key).alias("least"), F.max(key).alias("greatest")).write.mode("errorifexists").json(f"{path}/manifest")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", "true").json(path)


def last_number(spark: SparkSession, path: str) -> DataFrame:
    """``file, value``: the last line of each text file that parses as a number; null where there is none."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "text"))
    number = F.expr("try_cast(trim(text) AS double)")
    return lines.groupBy("file").agg(F.max_by(number, F.when(number.isNotNull(), F.col("line"))).alias("value"))


def content_hashes(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 and length of each file."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def shared_union(left: DataFrame, right: DataFrame, ids: tuple[str, str] = ("0", "1")) -> DataFrame:
    """Concatenation on the common columns, with the data set's id."""
    both = [c for c in left.columns if c in right.columns]
    return left.select(F.lit(ids[0]).alias("dataset"), *both).unionByName(right.select(F.lit(ids[1]).alias("dataset"), *both))


def locate(rows: DataFrame, bounds: DataFrame, index: str) -> DataFrame:
    """(episode, local index) of global rows: bounds are bucketed, so the range join is an equi-join plus a filter."""
    width = 64
    wide = bounds.where("length > 0").withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("from_index") / width), F.floor((F.col("to_index") - 1) / width))))
    asked = rows.withColumn("_bucket", F.floor(F.col(index) / width))
    inside = (F.col(index) >= F.col("from_index")) & (F.col(index) < F.col("to_index"))
    return asked.join(wide, "_bucket").where(inside).select(*rows.columns, "episode_index", (F.col(index) - F.col("from_index")).alias("local_index"))
