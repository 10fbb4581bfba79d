"""Statistics of a growing table, kept up to date by a stream and joined to those stored before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from episodia.operators import statistics as st
from episodia.sources.committed import Shards


def maintain(rows: DataFrame, column: str, key: str, base: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """A stream whose every micro-batch leaves a whole version of ``key, min, max, mean, std, count`` below ``path``.

    The stream's own totals are in its state (update mode: a batch sends only the
    groups that it changed).  A version is the version before with the changed
    groups replaced: their totals merged with ``base``, the statistics of what
    the stream has not seen.  Versions are committed by batch, so a batch that
    comes again changes nothing.
    """
    versions = Shards(path)
    totals = st.group_stats(rows, column, key)

    def write(changed: DataFrame, batch: int) -> None:
        spark = changed.sparkSession
        if versions.committed(spark, batch):
            return
        before = current(spark, path, base, batch)
        touched = base.join(changed.select(key), key, "left_semi")
        now = st.merge_stats(changed.select(*base.columns).unionByName(touched), key).select(*base.columns)
        versions.write(before.join(changed.select(key), key, "left_anti").unionByName(now), batch)

    return totals.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str, base: DataFrame, before: int | None = None) -> DataFrame:
    """The last version (of a batch before ``before``), or ``base`` if there is none."""
    versions = Shards(path)
    listed = versions.manifest(spark)
    last = (listed if before is None else listed.where(listed["batch"] < before)).agg({"batch": "max"}).first()[0]
    if last is None:
        return base
    return versions._read(spark, base.schema, [last]).select(*base.columns)
