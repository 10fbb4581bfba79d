"""The byte network against a plain forward pass and numeric gradients, and held-out accuracy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from episodia.llm import language_id as li


def forward(network, window):
    """One window, one filter place after another."""
    p, hidden = network.params, []
    for w in li.WIDTHS:
        rows = [np.concatenate([p["bytes"][b] for b in window[i : i + w]]) @ p[f"filter{w}"] for i in range(len(window) - w + 1)]
        hidden.append(np.max(rows, 0) + p[f"shift{w}"])
    logits = np.maximum(np.concatenate(hidden), 0) @ p["out"] + p["bias"]
    prob = np.exp(logits - logits.max())
    return prob / prob.sum()


def test_tables_give_the_same_as_the_layers():
    rng = np.random.default_rng(1)
    network = li.Network(5, seed=2)
    windows = rng.integers(0, 256, (7, li.WINDOW)).astype(np.uint8)
    want = np.array([forward(network, w) for w in windows])
    assert np.allclose(network.probabilities(windows), want, atol=1e-5)
    assert network.probabilities(windows[:0]).shape == (0, 5)


def test_gradients_against_differences():
    rng = np.random.default_rng(3)
    network = li.Network(3, seed=4)
    network.params = {k: v.astype(float) for k, v in network.params.items()}
    windows, labels = rng.integers(97, 110, (6, li.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 1])
    loss = lambda: -np.mean([np.log(forward(network, w)[y]) for w, y in zip(windows, labels)])
    grads = network.gradients(windows, labels)
    for name, g in grads.items():
        flat, step = network.params[name].reshape(-1), 1e-6
        for i in np.argsort(-np.abs(g.reshape(-1)))[:3]:
            flat[i] += step
            up = loss()
            flat[i] -= 2 * step
            down = loss()
            flat[i] += step
            assert g.reshape(-1)[i] == pytest.approx((up - down) / (2 * step), rel=2e-3, abs=1e-7), name


def test_windows_cover_whole_texts():
    texts = ["", "Ab" * 300, "x", "é" * 100]
    data = [t.encode() for t in texts]
    at = np.concatenate([[0], np.cumsum([len(d) for d in data])])
    windows, text = li.windows_of(np.frombuffer(b"".join(data), np.uint8), at[:-1], at[1:])
    for k, d in enumerate(data):
        own = windows[text == k].tobytes()
        assert own.rstrip(b"\0") == d.lower().replace("É".encode(), "É".encode())
        assert len(own) == -(-len(d) // li.WINDOW) * li.WINDOW


@pytest.fixture(scope="module")
def learned(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return docs, *li.train(docs)


def test_held_out_accuracy(spark, sf, learned):
    docs, languages, network = learned
    rows = li.predict(docs.withColumn("held_out", li.held_out()), languages, network).where("held_out and lang is not null and n_chars >= 20").select("lang", "lang_pred", "score").collect()
    assert len(rows) > 150
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) >= 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_query_and_reruns(spark, sf):
    a, b = (sorted((r["doc_id"], r["held_out"], r["lang_pred"]) for r in li.query(spark, sf).collect()) for _ in range(2))
    assert a == b and len(a) == spark.read.parquet(f"{sf}/documents.parquet").count()
    import zlib

    assert all(held == (zlib.crc32(str(i).encode()) % 4 == 2) for i, held, _ in a)


def test_held_out_rows_are_not_learned_from(spark, learned):
    docs, languages, network = learned
    other = docs.withColumn("lang", F.when(li.held_out(), F.lit("zz")).otherwise(F.col("lang")))
    again, same = li.train(other)
    assert again == languages
    assert all(np.array_equal(same.params[k], network.params[k]) for k in network.params)


def test_edges(spark, learned):
    known, languages, network = learned
    german = known.where(li.held_out() & F.col("lang").eqNullSafe("de") & (F.length("text") > 300)).orderBy("doc_id").first()["text"]
    long = "the of and that with this from " * 60_000
    rows = [(1, None, "a"), (2, "", "b"), (3, "123 --- 4\n", None), (4, long, "c"), (4, long, "c"), (None, german, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"lang_pred": F.lit("mine"), "score": F.lit("x"), "row": F.lit(1), "a1": F.lit(2)})
    got = li.predict(docs, languages, network)
    assert got.columns == ["doc_id", "text", "lang", "row", "a1", "lang_pred", "score"]
    by = {r["doc_id"]: r for r in got.collect()}
    assert len(got.collect()) == 6
    assert [(by[k]["lang_pred"], by[k]["score"]) for k in (1, 2, 3)] == [("und", 0.0)] * 3
    assert by[4]["lang_pred"] == "en" and by[4]["text"] == long and by[4]["row"] == 1
    assert by[None]["lang_pred"] == "de"
    assert li.predict(docs.limit(0), languages, network).count() == 0


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "some words", None), (2, None, "en"), (None, "words", "en")], "doc_id long, text string, lang string")
    languages, network = li.train(docs)
    assert (languages, network) == ([], None)
    assert {(r["lang_pred"], r["score"]) for r in li.predict(docs, languages, network).collect()} == {("und", 0.0)}
    assert li.train(docs.limit(0)) == ([], None)
