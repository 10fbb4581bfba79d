"""Huge components and scores beyond 64 bits do not end the search."""

import numpy as np
from pyspark.sql import functions as F

from episodia.llm import topk_search as tk


def test_huge_components(spark):
    rng = np.random.default_rng(5)
    vectors = {i: rng.integers(-300, 300, 4).tolist() for i in range(220)}
    vectors |= {300: [2**62, 1, 0, -5], 301: [-(2**62), 3, 2, 1], 302: [2**40, -(2**40), 2**33, 7], 350: [2**63 - 1] * 4, 351: [-(2**63)] * 4, 352: [2**31, 2**31, 0, 1], 400: [2**31, 2**31, 0, 0], 401: [0, 0, 2**62, 0], 402: [1, 2, 3, 4]}
    rows = spark.createDataFrame(list(vectors.items()), "id long, vector array<bigint>")
    got = {}
    for r in tk.search(rows, F.col("id") % 50 == 0, block=64, query_block=4).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    clamp = lambda x: min(max(x, -tk.MOST), tk.MOST)
    for q in [i for i in vectors if i % 50 == 0]:
        scores = sorted((-clamp(sum(a * b for a, b in zip(vectors[q], v))), i) for i, v in vectors.items() if i != q)[:5]
        assert got[q] == {k: (i, -s) for k, (s, i) in enumerate(scores, 1)}, q


def test_quantised_beyond_64_bits(spark):
    v = spark.createDataFrame([([1e300, -1e300, 1.5],), ([float("inf"), 0.0, 0.0],), ([1.0, None, 0.0],)], "v array<double>")
    got = [r["q"] for r in v.select(tk.quantised(F.col("v")).alias("q")).collect()]
    assert got == [[2**63 - 1, -(2**63), 384], None, None]
