"""All strings of files of any format, keys and nested values included.

JSON, YAML and nested Parquet columns become VARIANT values, which are taken
apart level by level: a level gives its strings and its objects' keys, and what
its containers hold is the next level.  CSV rows give the header's names and the
cells; text gives its lines that are not blank.
"""

from __future__ import annotations

import csv
import json
import re
from collections.abc import Iterator
from itertools import groupby, islice
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from episodia.sources.scratch import stored

CELLS = 8192  # in a batch
LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+")
OBJECT, ARRAY = "OBJECT<%", "ARRAY<%"


def strings_of_variants(rows: DataFrame, value: str = "v") -> DataFrame:
    """``file, text`` for every string and key in the variants of ``rows`` (``file, v``)."""
    out = None
    level = stored(rows.select("file", F.col(value).alias("v")))
    while True:
        kind = F.schema_of_variant("v")
        here = level.where(kind == "STRING").select("file", F.variant_get("v", "$", "string").alias("text"))
        out = here if out is None else out.unionByName(here)
        nested = level.where(kind.like(OBJECT) | kind.like(ARRAY))
        if not nested.limit(1).count():
            return out
        name = f"nested_{id(nested)}"
        nested.createOrReplaceTempView(name)
        inner = stored(rows.sparkSession.sql(f"SELECT file, key, value AS v FROM {name}, LATERAL variant_explode(v)"))
        rows.sparkSession.catalog.dropTempView(name)
        out = out.unionByName(inner.where("key IS NOT NULL").select("file", F.col("key").alias("text")))
        level = inner.select("file", "v")


def _records(lines: Iterator[str]) -> Iterator[str]:
    """Lines with their ends, as a file opened with ``newline=""`` gives them: a lone carriage return ends one as well."""
    for line in lines:
        if "\r" in line:
            yield from (m.group() for m in LINE.finditer(line + "\n"))
        else:
            yield line + "\n"


def _csv_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Header names and cells of each row; the lines of a file follow each other, and no more than a batch of either is held."""
    lines = (x for b in batches for x in zip(*(b.column(c).to_pylist() for c in ("path", "file", "value"))))
    for (_, file), own in groupby(lines, key=itemgetter(0, 1)):
        rows = csv.DictReader(_records(x[2] for x in own))
        cells = (x for row in rows for pair in row.items() for y in pair for x in (y if isinstance(y, list) else [y]) if isinstance(x, str))
        while some := list(islice(cells, CELLS)):
            yield pa.RecordBatch.from_pydict({"file": [file] * len(some), "text": pa.array(some, pa.string())})


def _csv_strings(spark: SparkSession, path: str) -> DataFrame:
    """Lines are read in splits and come back to their order, a file in one task, by a sort that spills."""
    lines = spark.read.option("lineSep", "\n").text(path)
    at = [F.xxhash64("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_row")]
    own = lines.select(*at, "value").repartition("path", "file").sortWithinPartitions("path", "file", "_at", "_row")
    return own.select("path", "file", "value").mapInArrow(_csv_cells, "file string, text string")


def _yaml_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import yaml

    for batch in batches:
        yield pa.RecordBatch.from_pydict({"file": batch.column("file"), "value": pa.array([json.dumps(yaml.safe_load(x), default=lambda v: None) for x in batch.column("value").to_pylist()], pa.string())})


def strings_of(spark: SparkSession, path: str, format: str) -> DataFrame:
    """``file, text``, one row an occurrence, of the files below a path.

    A document that cannot be parsed fails the job.  ``format`` is json (one
    document a file), jsonl, csv, parquet, text or yaml; whole documents are one
    task's each, lines and Parquet rows are split; a CSV file's rows are read by
    one task, line by line.
    """
    file = F.col("_metadata.file_name").alias("file")
    if format == "text":
        return spark.read.text(path).select(file, F.col("value").alias("text")).where(F.trim("text", F.lit(" \t\r\x0b\x0c")) != "")
    if format == "jsonl":
        lines = spark.read.text(path).select(file, "value").where(F.trim("value") != "")
        return strings_of_variants(lines.select("file", F.parse_json("value").alias("v")))
    if format == "parquet":
        rows = spark.read.option("mergeSchema", "true").parquet(path)
        nested = [f.name for f in rows.schema.fields if f.dataType.simpleString().startswith(("string", "array<", "struct<", "map<string,"))]
        if not nested:
            return spark.createDataFrame([], "file string, text string")
        values = F.array(*(F.to_variant_object(F.struct(F.array(f"`{c}`").alias("x"))) for c in nested))
        each = rows.select(file, F.explode(values).alias("v")).select("file", F.variant_get("v", "$.x[0]", "variant").alias("v"))
        return strings_of_variants(each.where("v IS NOT NULL AND NOT is_variant_null(v)"))
    if format == "csv":
        return _csv_strings(spark, path)
    whole = spark.read.text(path, wholetext=True).select(file, "value")
    if format == "yaml":
        whole = whole.mapInArrow(_yaml_documents, "file string, value string")
    elif format != "json":
        raise ValueError(f"no strings of {format}")
    return strings_of_variants(whole.select("file", F.parse_json("value").alias("v")))
