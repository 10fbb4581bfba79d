"""Every dealt operator and pipeline stage on nulls, empty and long texts, repeats, empty tables and clashing names."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from episodia.llm import html_extract as he, license_scan as ls, ngram_join as nj, quality_rules as qr, segment_sampling as ss, source_mix as sx, suffix_dedup as sd, topk_search as tk, url_filter as uf, warc
from episodia.llm.shared import least_hashes
from test_llm import words

#: Names of result columns and of columns that plans use inside.
CLASHES = ["row", "a0", "a1", "key", "copies", "spans", "n_removed", "sha", "license", "kept", "rule", "host", "sample", "seed", "_k", "_n", "_row", "has `tick", "dotted.name"]


def edge_docs(spark):
    import random

    rng = random.Random(4)
    long = words(rng, 30_000)
    texts = [None, "", " \n\t", "one", long, long, "x" * 70_000, words(rng, 120), words(rng, 120)]
    rows = [(i, t, f"s{i % 3}", "en", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[7]] * 3 + [(None, None, None, None, None)] * 2 + [(None, words(rng, 90), None, "fr", 5), (None, words(rng, 90), "s1", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    return docs.withColumns({c: F.lit(f"mine {c}") for c in CLASHES})


def labels_of(spark):
    return spark.createDataFrame([(0, 0, 0), (4, 1, 0), (None, 1, 0), (7, None, None), (7, 1, 0)], "doc_id long, quality int, toxic int")


def pages_of(docs):
    return docs.select(F.col("doc_id").alias("page_id"), F.when(F.col("source").isNotNull(), F.concat(F.lit("http://h.net/"), "doc_id")).alias("url"), F.col("text").alias("html"), *[f"`{c.replace('`', '``')}`" for c in CLASHES])


OPERATORS = {
    "op1": (lambda s, d: tk.search(d.select(F.col("doc_id").alias("id"), F.array(F.length("text").cast("long"), F.lit(1).cast("long")).alias("vector"), "row", "a0"), F.col("id") % 2 == 0), None),
    "op2": (lambda s, d: warc.captures(pages_of(d)), 1.0),
    "op3": (lambda s, d: sd.remove_repeats(d), 1.0),
    "op4": (lambda s, d: sx.mix(d), 1.0),
    "op5": (lambda s, d: ls.scan(d, ls.known_digests(s)), 1.0),
    "op6": (lambda s, d: uf.filter_urls(pages_of(d), uf.rule_table(s)), 1.0),
    "op7": (lambda s, d: he.extract(pages_of(d)), 1.0),
    "op8": (lambda s, d: nj.link_components(d), 1.0),
    "op9": (lambda s, d: qr.judge(qr.text_stats(d), labels_of(s)), 1.0),
    "op10": (lambda s, d: ss.encode_samples(d, ss.default_model()), None),
}
#: Result columns of an operator, which replace columns of the input; all other columns pass through.
REPLACED = {"op3": {"n_removed"}, "op5": {"license"}, "op6": {"host", "rule"}, "op9": {"kept", "rule"}}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator_edges(spark, name):
    docs = edge_docs(spark)
    run, share = OPERATORS[name]
    out = run(spark, docs)
    rows = out.collect()
    assert share is None or len(rows) == share * docs.count()
    if name in REPLACED:
        for c in set(CLASHES) - REPLACED[name]:
            assert all(r[c] == f"mine {c}" for r in rows), c
        assert all(r[c] != f"mine {c}" for c in REPLACED[name] for r in rows)
    assert len(set(out.columns)) == len(out.columns)
    empty = run(spark, docs.limit(0))
    assert empty.count() == 0 and empty.columns == out.columns


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stage_edges(spark, tmp_path, stage):
    labels_of(spark).write.parquet(f"{tmp_path}/labels.parquet")
    docs = edge_docs(spark)
    run = dict(corpus_pipeline.STAGES)[stage]
    out = run(spark, docs, str(tmp_path))
    rows = out.collect()
    if stage != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == docs.columns
        for c in CLASHES:
            assert all(r[c] == f"mine {c}" for r in rows), c
    assert rows
    assert run(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_empty_rule_and_licence_tables(spark):
    pages = pages_of(edge_docs(spark))
    got = uf.filter_urls(pages, uf.rule_table(spark).limit(0)).collect()
    assert len(got) == pages.count() and {(r["rule"], r["verdict"]) for r in got} == {(None, "allow")}
    assert {(r["license"], tuple(r["notices"])) for r in ls.scan(edge_docs(spark), ls.known_digests(spark).limit(0)).collect()} == {(None, ())}


def test_warc_of_an_empty_table(spark, tmp_path):
    root = f"file://{tmp_path}/w"
    places = warc.write_archives(warc.captures(pages_of(edge_docs(spark)).limit(0)), root)
    index = warc.build_index(places, root)
    assert warc.read_records(warc.lookup(index, places, root), root).count() == 0


def test_warc_lookup_of_one_url_with_many_captures(spark, tmp_path):
    root = f"file://{tmp_path}/w"
    pages = spark.createDataFrame([(i // 2, "http://h.org/" + "ab"[i % 7 == 0], f"<p>{i}") for i in range(400)], "page_id long, url string, html string")
    places = warc.write_archives(warc.captures(pages), root)
    index = warc.build_index(places, root, block_lines=3)
    asked = places.select("url_key", "page_id").distinct()
    assert warc.lookup(index, asked, root).count() == 400
    one = asked.where("page_id = 77 or page_id = -5")
    assert {r["page_id"] for r in warc.lookup(index, one.unionByName(asked.select("url_key", (-F.col("page_id") - 1).alias("page_id"))), root).collect()} == {77}


def test_repeated_rows_of_the_mix(spark):
    docs = spark.createDataFrame([(None, "a b c", None, i % 5) for i in range(9000)] + [(1, "d e", "s", 0)] * 50 + [(2, "f", "s", 0)], "doc_id long, text string, source string, extra long")
    mixed = sx.mix(docs, group=512, fan_in=4).collect()
    assert len(mixed) == 9051
    out = sx.materialise(docs, group=512, fan_in=4)
    assert out.count() == sum(r["copies"] for r in mixed)
    per = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert per[None] == sum(r["copies"] for r in mixed if r["source"] is None)


def water_filling(sizes, weights, rate, cap):
    """Targets by resharing the excess again and again."""
    names = sorted(sizes, key=lambda x: (x is None, x or ""))
    w = {n: weights[i % 3] for i, n in enumerate(names)}
    target, open_ = dict.fromkeys(names, 0.0), set(names)
    left = rate * sum(sizes.values())
    while open_ and left > 1e-9:
        total = sum(w[n] for n in open_)
        share = {n: left * w[n] / total for n in open_}
        full = {n for n in open_ if target[n] + share[n] >= cap * sizes[n]}
        left = sum(target[n] + share[n] - cap * sizes[n] for n in full)
        for n in open_:
            target[n] = cap * sizes[n] if n in full else target[n] + share[n]
        open_ -= full
    return target


def test_targets_against_resharing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for frame in (docs, docs.withColumn("source", F.when(F.col("doc_id") % 11 > 0, F.concat("source", F.col("doc_id") % 4)))):
        rows = frame.select("source", sx.word_count(F.col("text")).alias("size")).groupBy("source").agg(F.sum("size").alias("n")).collect()
        want = water_filling({r["source"]: r["n"] for r in rows}, sx.WEIGHTS, sx.RATE, sx.CAP)
        got = {r["source"]: r["target"] for r in sx.targets(frame.select("source", sx.word_count(F.col("text")).alias("size"))).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 * max(1, want[k]) for k in want)


def test_joint_law_and_inclusion_of_two_samples():
    m = ss.model(ss.default_model())
    n = 6000
    keys = np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(99)
    r = ss.sample_batch(m, pa.array(["the cat"] * n), keys, 2)
    by = {}
    for row, sample, ids, lp, incl in zip(r["row"], r["sample"], r["ids"], r["log_prob"], r["inclusion"]):
        by.setdefault(row, {})[sample] = (tuple(ids.tolist()), float(np.exp(lp)), incl)
    p = {ids: q for x in by.values() for ids, q, _ in x.values()}
    pairs = {}
    for x in by.values():
        pairs[x[1][0], x[2][0]] = pairs.get((x[1][0], x[2][0]), 0) + 1
    for (a, b), seen in sorted(pairs.items(), key=lambda x: -x[1])[:5]:
        want = p[a] * p[b] / (1 - p[a])
        assert abs(seen / n - want) < 5 * (want * (1 - want) / n) ** 0.5 + 1e-3
    # weights 1 / inclusion make sums over a sample unbiased
    weighed = np.array([sum(q / incl for _, q, incl in x.values()) for x in by.values()])
    assert abs(weighed.mean() - 1) < 5 * weighed.std() / n**0.5
    best, log_prob = ss.best_batch(m, pa.array(["the cat", "", None]))
    assert tuple(best[0].tolist()) == max(p, key=p.get) and abs(np.exp(log_prob[0]) - max(p.values())) < 1e-9 and len(best[1]) == len(best[2]) == 0


def test_decoding_of_tables(spark):
    texts = ["Hello  world ▁ é\U0001f600\n x", "", " lead", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    path = ss.default_model()
    tokens = ss.encode_best(docs, path).withColumn("row", F.lit("mine"))
    got = {r["doc_id"]: (r["text"], r["row"]) for r in ss.decode(tokens, path).collect()}
    assert got == {i: (t or "", "mine") for i, t in enumerate(texts)}
    assert ss.decode(tokens.withColumn("ids", F.lit(None).cast("array<int>")), path).where("text is not null").count() == 0
    assert ss.encode_samples(docs.withColumnRenamed("doc_id", "sample"), path, key="sample").columns[:2] == ["key", "sample"]


def test_a_cluster_without_a_shared_folder_is_an_error(spark, monkeypatch):
    from episodia.llm import shared

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda *a: None)

    with pytest.raises(RuntimeError):
        shared.folder(Session())


def test_least_hashes(spark):
    rows = spark.range(5000).select(F.xxhash64("id").alias("h"), "id")
    want = [r["id"] for r in rows.orderBy("h").limit(50).collect()]
    assert [r["id"] for r in least_hashes(rows, "h", 50).orderBy("h").collect()] == want
    assert least_hashes(rows.limit(10), "h", 50).count() == 10


def test_decision_list_finds_planted_rules(spark):
    rng = np.random.default_rng(3)
    n = 3000
    words_ = rng.integers(50, 400, n)
    repeat, symbols = (words_ * rng.random(n) / 2).astype(int), (words_ * rng.random(n)).astype(int)
    bad = (symbols / (5 * words_) > 0.15) | ((repeat / words_ > 0.3) & (words_ < 200))
    rows = [(i, int(w), int(w) * 5, int(s), 0, int(r), 1, 0, 0, 0, int(w) * 6, int(not b)) for i, (w, r, s, b) in enumerate(zip(words_, repeat, symbols, bad))]
    stats = spark.createDataFrame(rows, ["doc_id", *qr.COUNTS, "quality"])
    held, train = stats.where("doc_id % 3 = 0").drop("quality"), stats.where("doc_id % 3 > 0").select("doc_id", "quality")
    rules = qr.learn(stats.join(train.select("doc_id"), "doc_id").withColumnRenamed("quality", "_label"), "_label")
    got = {r["doc_id"]: r["r"] is not None for r in held.select("doc_id", qr.verdict(rules).alias("r")).collect()}
    right = sum(got[i] == bool(bad[i]) for i in got)
    assert right >= 0.93 * len(got) and len(rules) >= 2


@pytest.mark.parametrize("members", [3, 60, 3000])
def test_merged_lists_against_counting(members):
    rng = np.random.default_rng(members)
    lists = [np.sort(rng.choice(members, rng.integers(0, min(members, 40) + 1), replace=False)) for _ in range(30)]
    for own in (lists, lists[:1], []):
        postings = np.concatenate([np.zeros(0, np.int64), *own])
        found, times = nj.occurrences(postings, members)
        count = np.bincount(postings, minlength=members)
        assert found.tolist() == np.flatnonzero(count).tolist() and times.tolist() == count[count > 0].tolist()


def test_search_against_brute_force():
    rng = np.random.default_rng(8)
    base = [np.sort(rng.choice(400, 60, replace=False).astype(np.uint64)) for _ in range(40)]
    sets = base + [np.unique(np.concatenate([s[rng.random(len(s)) > 0.1], rng.choice(400, 3).astype(np.uint64)])) for s in base for _ in range(3)]
    index = nj.Index(sets, np.arange(len(sets)))
    for q in sets[::7] + [np.zeros(0, np.uint64)]:
        want = [i for i, s in enumerate(sets) if (both := len(np.intersect1d(q, s))) and 100 * both >= 75 * (len(q) + len(s) - both)]
        assert index.search(q).tolist() == want
