"""The pipeline's stages against their operators and brute force."""

from pyspark.sql import functions as F

import corpus_pipeline as cp
from episodia.llm import quality_rules as qr, segment_sampling as ss
from test_llm import brute_links, brute_repeats


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, held = docs.columns, {}
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, sf)
        assert k + 1 == len(cp.STAGES) or out.columns == columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        held[name] = docs
    kept = {r["doc_id"]: r["text"] for r in held["quality_rules"].collect()}
    stats = qr.text_stats(held["quality_rules"].select("doc_id", "text"))
    assert stats.where(qr.base_failed()).count() == 0
    ids = sorted(kept)
    links = brute_links([kept[i] for i in ids])
    heads = {ids[k] for k, (_, c) in enumerate(links) if k == c}
    near = {r["doc_id"]: r["text"] for r in held["ngram_join"].collect()}
    assert set(near) == heads and all(near[i] == kept[i] for i in heads)
    left = sorted(near)
    want = {i: size - gone for i, (size, gone, _, _) in zip(left, brute_repeats([near[i] for i in left], 400))}
    cut = {r["doc_id"]: r["text"] for r in held["suffix_dedup"].collect()}
    assert all(want[i] - 8 <= len(cut[i].encode()) <= want[i] for i in cut) and all(want[i] < 400 for i in set(left) - set(cut))
    mixed = held["source_mix"].groupBy("doc_id").agg(F.count("*").alias("n"))
    assert mixed.where("n > 2").count() == 0 and mixed.join(held["suffix_dedup"], "doc_id", "left_anti").count() == 0
    tokens = held["segment_sampling"]
    assert tokens.where("not round_trip").count() == 0
    assert tokens.select("doc_id").distinct().count() == mixed.count()
    assert tokens.where("size(ids) <> n_tokens").count() == 0
    texts = {r["doc_id"]: r["text"] for r in held["source_mix"].collect()}
    decoded = ss.decode(tokens.select("doc_id", "copy", "sample", "ids"), ss.default_model()).collect()
    assert all(r["text"] == texts[r["doc_id"]] for r in decoded)
    copies = {}
    for r in decoded:
        copies.setdefault(r["doc_id"], {}).setdefault(r["copy"], []).append(tuple(r["ids"]))
    times = {r["doc_id"]: r["n"] for r in mixed.collect()}
    assert {i: len(c) for i, c in copies.items()} == times
    twice = [list(c.values()) for i, c in copies.items() if times[i] == 2 and len(texts[i]) > 200]
    assert len(twice) > 20 and all(set(a).isdisjoint(b) for a, b in twice)


def test_copies_over_parts(spark):
    docs = spark.createDataFrame([(1, "some words to sample from"), (1, "some words to sample from"), (2, "other words"), (1, "some words to sample from")] * 3, "doc_id long, text string").coalesce(1)
    got = ss.encode_samples(docs, ss.default_model(), k=1, copies=True).collect()
    assert [r["copy"] for r in got] == [0, 1, 0, 0, 1, 2, 0, 0, 1, 2, 0, 0]
    assert {r["copy"] for r in ss.encode_samples(docs.repartition(12), ss.default_model(), k=1, copies=True).collect()} <= {0, 1, 2, 3}
