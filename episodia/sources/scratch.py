"""Tables in the folder that the driver and all executors share.

Lineage is cut with tables under ``spark.checkpoint.dir``; it is read from the
session and set only where it is unset in a local session (as in tests).  A
cluster without that setting is an error: executors would write to their own
disks.  Once a table is written nothing reads the shuffle files of its plan any
more; Spark deletes them with the query, not when the driver collects garbage.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def folder(spark: SparkSession) -> str:
    """A fresh path below the shared folder."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='episodia-')}")
        base = sc.getCheckpointDir()
    return f"{base.rstrip('/')}/episodia-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again; its shuffle files are deleted."""
    spark = df.sparkSession
    path = folder(spark)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Delete the files of tables that ``stored`` made, once nothing reads them any more."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(conf).delete(path, True)
