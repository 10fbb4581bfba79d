"""What the n-gram join leaves on disk, and which sets of a list it takes together."""

import subprocess
import time

import numpy as np
from pyspark.sql import functions as F

from episodia.llm import components as co, ngram_join as nj
from episodia.llm.shared import folder, stored


def shuffle_files(spark) -> set[str]:
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}


def tables(spark) -> set[str]:
    top = folder(spark).rpartition("/")[0].removeprefix("file:")
    return set(subprocess.run(["find", top, "-mindepth", "1", "-maxdepth", "1", "-name", "episodia-*"], capture_output=True, text=True).stdout.split())


def columns(spark, tables: set[str]) -> set[str]:
    return {c for t in tables for c in spark.read.parquet(t).columns}


def random_set(rng: np.random.Generator, n: int) -> np.ndarray:
    return np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))


def test_a_stored_table_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    got = stored(spark.range(1000).withColumn("k", F.col("id") % 7).repartition(5, "id").groupBy("k").agg(F.sum("id").alias("s")))
    for _ in range(50):
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left
    assert got.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_components_keep_only_their_result(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(0, 40) if k != 20], "a long, b long")
    before = tables(spark)
    out = co.components(edges)
    assert {r["node"]: r["root"] for r in out.collect()} == {k: 0 if k <= 20 else 21 for k in range(41)}
    assert len(tables(spark) - before) == 1


def test_lists_and_sets_do_not_stay(spark):
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(words), " ".join([*words[:-1], "other"]), " ".join(words[::-1]), "one two"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for block in (nj.BLOCK, 40):
        before = tables(spark)
        found = nj.link_components(docs, block=block)
        kept = columns(spark, tables(spark) - before)
        assert not kept & {"shingle", "head", "items", "cluster", "blocks", "a", "b"}
        assert {r["doc_id"]: r["component_id"] for r in found.collect()} == {0: 0, 1: 0, 2: 2, 3: 3}


def test_a_common_passage_joins_no_unlike_sets():
    rng = np.random.default_rng(5)
    sets = [random_set(rng, int(n)) for n in np.geomspace(89, 9000, 300)]  # no gap in size
    sets += [np.union1d(sets[250][:-50], random_set(rng, 50)), np.union1d(sets[100][5:], random_set(rng, 2))]
    label = nj.list_groups(np.array([len(s) for s in sets]), [nj.sketch(s) for s in sets])
    assert label[300] == label[250] and label[301] == label[100]
    assert len(set(label.tolist())) == 300


def test_sets_that_link_are_of_one_group():
    rng = np.random.default_rng(11)
    for _ in range(10):
        sets = []
        for _ in range(20):
            base = random_set(rng, int(rng.integers(1, 3000)))
            sets += [np.union1d(base[rng.random(len(base)) > 0.3 * rng.random()], random_set(rng, int(0.2 * len(base) * rng.random()) + 1)) for _ in range(int(rng.integers(1, 5)))]
        sets = [sets[i] for i in rng.permutation(len(sets))]
        label = nj.list_groups(np.array([len(s) for s in sets]), [nj.sketch(s) for s in sets])
        for i, one in enumerate(sets):
            for j in range(i):
                shared = len(np.intersect1d(one, sets[j], assume_unique=True))
                if nj.DEN * shared >= nj.NUM * (len(one) + len(sets[j]) - shared):
                    assert label[i] == label[j]
