"""Shards of bounded size with a manifest, committed batch by batch.

A batch first writes its shards, then one manifest file of that batch, which is
moved into place in one step.  Only shards of batches in the manifest count: a
run that was killed in between leaves files that nobody reads and that the next
try replaces, and a batch that comes again adds nothing.  So a stream with a
checkpoint writes every row once.

A row's place is its shard and its offset there.  A shard is one file, named
after its part and its number in the part; rows are numbered while their part is
written, so that no row moves between tasks.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType

IN_PART = (1 << 33) - 1  # the low bits of a row's id count the rows of its part


@dataclass
class Shards:
    """Shards of at most ``rows`` rows in a folder; ``format`` is a file format of Spark."""

    path: str
    rows: int = 1_000_000
    format: str = "parquet"

    def _batch(self, batch: int) -> str:
        return f"{self.path}/manifest/batch-{batch:012d}.json"

    def committed(self, spark: SparkSession, batch: int) -> bool:
        path, fs = _files(spark, self._batch(batch))
        return fs.exists(path)

    def write(self, rows: DataFrame, batch: int) -> bool:
        """Write a batch; false if it is there already."""
        spark = rows.sparkSession
        if self.committed(spark, batch):
            return False
        self.stage(rows, batch)
        self.commit(rows, batch)
        return True

    def stage(self, rows: DataFrame, batch: int) -> None:
        """The shards of a batch, in place of what an earlier try has left: a file each, numbered in its part by the writer."""
        at = F.monotonically_increasing_id().bitwiseAND(F.lit(IN_PART))
        rows.withColumn("offset", at % self.rows).write.format(self.format).mode("overwrite").option("maxRecordsPerFile", self.rows).save(f"{self.path}/shards/batch={batch}")

    def commit(self, rows: DataFrame, batch: int) -> None:
        """One line a shard of what is on disk now, then the move that makes the batch count."""
        spark = rows.sparkSession
        found = self._read(spark, rows.schema, [batch])
        lines = found.groupBy("shard").agg(F.count("*").alias("rows"), F.max("offset").alias("last")).select(F.lit(batch).cast("long").alias("batch"), "shard", "rows", "last")
        draft = f"{self.path}/drafts/{uuid.uuid4().hex}"
        lines.write.json(draft)
        source, fs = _files(spark, draft)
        target, _ = _files(spark, self._batch(batch))
        fs.mkdirs(target.getParent())
        if not fs.rename(source, target):
            raise RuntimeError(f"batch {batch} was committed by another writer")

    def manifest(self, spark: SparkSession) -> DataFrame:
        """``batch, shard, rows, last`` of every shard that counts."""
        schema = "batch long, shard string, rows long, last long"
        path, fs = _files(spark, f"{self.path}/manifest")
        if not fs.exists(path):
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).json(f"{self.path}/manifest/batch-*.json")

    def _read(self, spark: SparkSession, schema: StructType, batches: list[int]) -> DataFrame:
        """Rows of these batches; what lies in the folders of others is not looked at."""
        whole = StructType([*schema.fields, StructField("offset", LongType()), StructField("batch", LongType())])
        if not batches:
            return spark.createDataFrame([], StructType([*whole.fields[:-1], StructField("shard", StringType()), whole.fields[-1]]))
        found = spark.read.format(self.format).schema(whole).option("basePath", f"{self.path}/shards").load([f"{self.path}/shards/batch={b}" for b in batches])
        number = lambda pattern: F.regexp_extract("_metadata.file_name", pattern, 1).cast("long")
        shard = F.format_string("%05d-%06d", number(r"^part-(\d+)-"), number(r"-c(\d+)\."))
        return found.select(*[F.col(f"`{c}`") for c in schema.names], "offset", shard.alias("shard"), "batch")

    def read(self, spark: SparkSession, schema: StructType) -> DataFrame:
        """The committed rows with ``offset, shard, batch``; ``schema`` is that of the rows."""
        return self._read(spark, schema, sorted(r["batch"] for r in self.manifest(spark).select("batch").distinct().collect()))

    def commit_stream(self, rows: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """A stream whose micro-batches are batches of these shards."""

        def write(batch: DataFrame, number: int) -> None:
            self.write(batch, number)

        return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
