"""Metadata folders, committed shards, and what a killed run leaves."""

import os

import pytest
from pyspark.sql import functions as F

from episodia.operators import metadata as md
from episodia.plans import files
from episodia.sources import metadata_source as ms
from episodia.sources.committed import Shards


def test_versions_are_refused(spark, tmp_path):
    for version, wanted, ok in (("v2.0", "v2", True), ("v2.1", None, True), ("v2.1", "v3", False), ("v1.6", None, False), ("v3.1", None, False), ("v3.0", "v3.0", True), ("v4.0", None, False)):
        root = f"{tmp_path}/{version}{wanted}"
        ms.write_info(spark, root, version, {"x": ("float32", [3])}, 1, 2, 10)
        if ok:
            row = ms.read_metadata(spark, root, "info", wanted).first()
            assert (row["version"], row["fps"], row["total_frames"], row["feature"], row["dtype"], list(row["shape"])) == (version, 10.0, 2, "x", "float32", [3])
        else:
            with pytest.raises(Exception, match="needed"):
                ms.read_metadata(spark, root, "info", wanted).collect()


def test_filters_choose_files(spark, sf):
    root = files.write_v3(spark, sf)
    everything = ms.read_metadata(spark, root, "episodes")
    some = everything.where((F.col("episode_index") >= 85) & (F.col("episode_index") < 90))
    assert everything.rdd.getNumPartitions() > some.rdd.getNumPartitions() == 1
    assert {r["episode_index"] for r in some.collect()} == set(range(85, 90))
    reader = ms.MetadataReader(root, "episodes", None)
    kept = list(reader.pushFilters([ms.EqualTo(("length",), 3), ms.In(("episode_index",), (1, 130)), ms.LessThan(("episode_index",), 100)]))
    assert [f.attribute for f in kept] == [("length",)] and len(reader.tests) == 2
    assert [reader._passes(x) for x in (1, 2, 130, None)] == [True, False, False, False]
    assert [reader._may_pass(*x) for x in ((0, 39), (2, 9), (100, 140))] == [True, False, False]


def test_nested_statistics_and_missing_files(spark, tmp_path):
    root = str(tmp_path)
    ms.write_info(spark, root, "v2.1", {}, 0, 0, 30)
    os.makedirs(f"{root}/meta", exist_ok=True)
    with open(f"{root}/meta/episodes_stats.jsonl", "w") as f:
        f.write('{"episode_index": 4, "stats": {"image": {"mean": [[[0.5]], [[1]]], "count": [7]}}}\n\n')
    rows = {(r["episode_index"], r["feature"], r["statistic"]): list(r["values"]) for r in ms.read_metadata(spark, root, "stats").collect()}
    assert rows == {(4, "image", "mean"): [0.5, 1.0], (4, "image", "count"): [7.0]}
    assert ms.read_metadata(spark, root, "tasks").count() == 0 and ms.read_metadata(spark, root, "info").count() == 0


def test_feature_report_counts_shapes(spark):
    features = spark.createDataFrame([("a", "float64", [2]), ("b", "int64", [1]), ("c", "string", [1]), ("gone", "bool", [1])], "feature string, dtype string, shape array<long>")
    rows = spark.createDataFrame([([1.0, 2.0], 1, "x", 1), ([1.0], 2, None, 1), (None, None, "y", 1), ([], 3, "z", 1)], "a array<double>, b long, c string, more int")
    got = {(r["feature"], r["problem"], r["rows"]) for r in md.feature_report(rows, features).collect()}
    assert got == {("gone", "missing", None), ("more", "extra", None), ("a", "is not of shape [2]", 2)}
    assert md.feature_report(rows.limit(0), features).count() == 2


def test_a_killed_batch_is_written_once(spark, tmp_path):
    shards = Shards(str(tmp_path), rows=7)
    rows = spark.range(100).repartition(3)
    assert shards.read(spark, rows.schema).count() == 0 and shards.manifest(spark).count() == 0
    shards.stage(rows, 0)  # killed before its commit: nobody sees it
    assert shards.read(spark, rows.schema).count() == 0
    assert shards.write(rows.where("id < 60"), 0) and not shards.write(rows, 0)
    assert shards.write(rows.where("id >= 60"), 1) and shards.write(rows.limit(0), 2)
    found = shards.read(spark, rows.schema).collect()
    assert sorted(r["id"] for r in found) == list(range(100))
    per = {}
    for r in found:
        per.setdefault((r["batch"], r["shard"]), []).append(r["offset"])
    assert all(sorted(v) == list(range(len(v))) and len(v) <= 7 for v in per.values())
    assert {(r["batch"], r["shard"]): r["rows"] for r in shards.manifest(spark).collect()} == {k: len(v) for k, v in per.items()}


def test_a_stream_that_is_started_again(spark, tmp_path):
    shards = Shards(f"{tmp_path}/out", rows=10, format="json")
    for k in range(3):
        spark.range(k * 20, k * 20 + 20).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    run = lambda: shards.commit_stream(spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in"), f"{tmp_path}/state").awaitTermination()
    run()
    commits = sorted(f for f in os.listdir(f"{tmp_path}/state/commits") if f.isdigit())
    for name in (commits[-1], f".{commits[-1]}.crc"):  # killed after the shards' commit and before the stream's
        os.remove(f"{tmp_path}/state/commits/{name}")
    run()
    schema = spark.range(1).schema
    assert sorted(r["id"] for r in shards.read(spark, schema).collect()) == list(range(60))


def test_csv_is_read_line_by_line_in_order(spark, tmp_path, monkeypatch):
    import csv
    import io

    import pyarrow as pa

    from episodia.sources import strings

    texts = {
        "a/x.csv": 'id,"no\nte",x\n1,"say ""hi""\n\nthere, you",\n2,short\n3,a,b,more,"and\r\nmore"\n\n' + "".join(f'{i},"line\n{i}",y\n' for i in range(400)),
        "b/x.csv": "name,name\r\nq\"uote,2\rlone,3\r\n\r\n,\n",
        "b/y.csv": "only,header",
        "b/z.csv": "",
    }
    for name, text in texts.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(text.encode())
    want = sorted((name[2:], x) for name, text in texts.items() for row in csv.DictReader(io.StringIO(text, newline="")) for pair in row.items() for y in pair for x in (y if isinstance(y, list) else [y]) if isinstance(x, str))
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")  # splits inside quoted cells
    try:
        got = sorted((r.file, r.text) for r in strings.strings_of(spark, f"{tmp_path}/*", "csv").collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    assert got == want
    # a file's cells come in batches, before its last line is read
    seen = []

    def lines():
        for i in range(40):
            seen.append(i)
            yield pa.RecordBatch.from_pydict({"path": [1] * 1000, "file": ["f"] * 1000, "value": ["a,b"] * 1000})

    first = next(strings._csv_cells(lines()))
    assert 0 < first.num_rows <= 8192 and len(seen) < 10


def test_a_shard_is_a_file_and_no_folder(spark, tmp_path):
    from episodia.sources.committed import Shards

    rows = spark.range(103, numPartitions=3).selectExpr("id", "id * 2 AS shard_of")
    shards = Shards(str(tmp_path / "s"), rows=10)
    shards.stage(spark.range(500).selectExpr("id", "id AS shard_of"), 4)  # a longer try before
    assert shards.write(rows, 4) and not shards.write(rows, 4)
    assert not [p for p in (tmp_path / "s" / "shards" / "batch=4").iterdir() if p.is_dir()]
    listed = {r.shard: (r.rows, r.last) for r in shards.manifest(spark).collect()}
    assert sum(n for n, _ in listed.values()) == 103 and all(n <= 10 and last == n - 1 for n, last in listed.values())
    got = shards.read(spark, rows.schema).collect()
    assert sorted((r.id, r.shard_of) for r in got) == [(i, 2 * i) for i in range(103)]
    assert len({(r.shard, r.offset) for r in got}) == 103 and {r.shard for r in got} == set(listed) and {r.batch for r in got} == {4}
    assert list(shards.read(spark, rows.schema).columns) == ["id", "shard_of", "offset", "shard", "batch"]
