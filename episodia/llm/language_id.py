"""Language identification by a small convolutional network over bytes.

A window of ``WINDOW`` bytes becomes an embedding for each byte; filters of
several widths slide over it, each filter's highest response is kept, and a
softmax over the languages follows.  Training is plain NumPy on the driver, from
at most ``SAMPLE_ROWS`` labelled rows, of which ``SAMPLE_WINDOWS`` windows at even
places are taken inside the tasks.  Prediction cuts every whole text into
windows and scores them in batches; a text's probabilities are the means of its
windows', weighted by their letters.

In prediction the first layer is read from tables: embedding and filter are one
linear map, so the response to two neighbouring bytes is one row of a table of
all byte pairs.

Only ``text`` is read for a prediction.  Learning takes rows with a language
whose ``crc32`` of the id, as text, is not 2 modulo 4.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; a
null id is not held out but not learned from either; without labelled rows, and
with a text of letters, the answer is ``und`` with score 0; very long texts are
scored window by window; repeated rows are judged one by one; other columns are
kept, but a result replaces a column of its name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from episodia.llm.shared import folded, unfolded
from episodia.llm.textkernel import LOWER, buffers, release, slices

WINDOW = 192
WIDTHS, FILTERS, WIDTH = (2, 3, 4), 24, 8  # filter widths, filters of each, length of an embedding
SAMPLE_ROWS, SAMPLE_WINDOWS = 3000, 4
EPOCHS, BATCH, RATE, SEED = 6, 128, 4e-3, 20240229
AT_ONCE = 256  # windows of a batch of predictions
HELD = 8192  # windows that are cut at a time
LETTER = np.zeros(256, np.float32)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def window_places(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and stop of all windows of the texts, and the text of each."""
    count = -(-(end - begin) // WINDOW)
    text = np.repeat(np.arange(len(begin)), count)
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    start = begin[text] + (np.arange(len(text)) - first[text]) * WINDOW
    return start, np.minimum(start + WINDOW, end[text]), text


def cut(raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Windows, lower-cased and filled with 0."""
    at = start[:, None] + np.arange(WINDOW)
    return np.where(at < stop[:, None], LOWER[raw[np.minimum(at, max(len(raw) - 1, 0))]], 0).astype(np.uint8)


def windows_of(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the texts, and the text of each."""
    start, stop, text = window_places(begin, end)
    return cut(raw, start, stop), text


class Network:
    """Byte embeddings, filters of several widths, their maxima, and a softmax."""

    def __init__(self, classes: int, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.params = {"bytes": rng.normal(0, 0.5, (256, WIDTH))}
        for w in WIDTHS:
            self.params[f"filter{w}"] = rng.normal(0, (2 / (w * WIDTH)) ** 0.5, (w * WIDTH, FILTERS))
            self.params[f"shift{w}"] = np.zeros(FILTERS)
        self.params["out"] = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, classes))
        self.params["bias"] = np.zeros(classes)
        self.params = {k: v.astype(np.float32) for k, v in self.params.items()}

    def gradients(self, windows: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy."""
        p, n = self.params, len(windows)
        embedded = p["bytes"][windows]
        pooled, best, patches = [], [], {}
        for w in WIDTHS:
            view = np.lib.stride_tricks.sliding_window_view(embedded, w, axis=1).transpose(0, 1, 3, 2).reshape(n, WINDOW - w + 1, w * WIDTH)
            patches[w] = view
            response = view @ p[f"filter{w}"]
            at = response.argmax(1)
            best.append(at)
            pooled.append(np.take_along_axis(response, at[:, None], 1)[:, 0] + p[f"shift{w}"])
        hidden = np.maximum(np.concatenate(pooled, 1), 0)
        logits = hidden @ p["out"] + p["bias"]
        prob = np.exp(logits - logits.max(1, keepdims=True))
        prob /= prob.sum(1, keepdims=True)
        prob[np.arange(n), labels] -= 1
        prob /= n
        grads = {"out": hidden.T @ prob, "bias": prob.sum(0), "bytes": np.zeros_like(p["bytes"])}
        back = (prob @ p["out"].T) * (hidden > 0)
        rows = np.arange(n)[:, None]
        for k, w in enumerate(WIDTHS):
            g = back[:, k * FILTERS : (k + 1) * FILTERS]
            at = best[k]
            chosen = patches[w][rows, at]  # windows x filters x (bytes of the patch)
            grads[f"filter{w}"] = np.einsum("nfi,nf->if", chosen, g)
            grads[f"shift{w}"] = g.sum(0)
            down = (g[:, :, None] * p[f"filter{w}"].T).reshape(n, FILTERS, w, WIDTH)
            np.add.at(grads["bytes"], windows[rows[:, :, None], at[:, :, None] + np.arange(w)], down)
        return grads

    def fit(self, windows: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, batch: int = BATCH, rate: float = RATE, seed: int = SEED) -> Network:
        """Adam over shuffled batches, with a rate that falls to zero; a third of the windows are cut to a short text's length each time."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.params.items()}
        second = {k: np.zeros_like(v) for k, v in self.params.items()}
        steps, t = epochs * -(-len(windows) // batch), 0
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for i in range(0, len(order), batch):
                own = order[i : i + batch]
                t += 1
                now = rate * (1 - (t - 1) / steps)
                length = np.where(rng.random(len(own)) < 1 / 3, rng.integers(8, WINDOW, len(own)), WINDOW)
                cut = np.where(np.arange(WINDOW) < length[:, None], windows[own], 0).astype(np.uint8)
                for k, g in self.gradients(cut, labels[own]).items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.params[k] -= (now * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self

    def tables(self) -> list[tuple[int, list[tuple[int, int, np.ndarray]]]]:
        """For each width the parts (offset, bytes taken, table) whose rows add up to the responses; pairs of bytes are one row."""
        out = []
        for w in WIDTHS:
            single = [self.params["bytes"] @ self.params[f"filter{w}"][o * WIDTH : (o + 1) * WIDTH] for o in range(w)]
            parts = [(o, 2, (single[o][:, None] + single[o + 1][None]).reshape(65536, FILTERS)) for o in range(0, w - 1, 2)]
            if w % 2:
                parts.append((w - 1, 1, single[w - 1]))
            out.append((w, parts))
        return out

    def probabilities(self, windows: np.ndarray, tables: list | None = None) -> np.ndarray:
        tables = tables or self.tables()
        out = []
        for i in range(0, len(windows), AT_ONCE):
            one = windows[i : i + AT_ONCE].astype(np.int32)
            two = (one[:, :-1] << 8) | one[:, 1:]
            pooled = []
            for w, parts in tables:
                places = WINDOW - w + 1
                response = None
                for offset, taken, table in parts:
                    rows = table[(two if taken == 2 else one)[:, offset : offset + places]]
                    response = rows if response is None else np.add(response, rows, out=response)
                pooled.append(response.max(1) + self.params[f"shift{w}"])
            logits = np.maximum(np.concatenate(pooled, 1), 0) @ self.params["out"] + self.params["bias"]
            prob = np.exp(logits - logits.max(1, keepdims=True))
            out.append(prob / prob.sum(1, keepdims=True))
        return np.concatenate(out) if out else np.zeros((0, len(self.params["bias"])), np.float32)


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        raw, begin, end = buffers(batch.column("text"))
        lang, order = batch.column("lang").to_pylist(), batch.column("order").to_pylist()
        for k in range(batch.num_rows):
            start, stop, _ = window_places(begin[k : k + 1], end[k : k + 1])
            if len(start):
                own = np.unique(np.linspace(0, len(start) - 1, SAMPLE_WINDOWS).round().astype(int))
                chosen = cut(raw, start[own], stop[own])
                yield pa.RecordBatch.from_pydict({"lang": [lang[k]], "order": [order[k]], "windows": pa.array([chosen.tobytes()], pa.binary())})


def train(docs: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[list[str], Network | None]:
    """The languages and a network, from at most about ``rows`` rows, as many of each language as there are.

    Rows are the ones of the least hashes of their language, so that a rerun
    learns the same; a hot language is cut in parts by hash before it is sorted.
    """
    known = docs.where(F.col("doc_id").isNotNull() & ~held_out() & F.col("lang").isNotNull() & F.regexp_like("text", F.lit(r"\p{L}")))
    hashed = known.select("lang", "text", F.xxhash64("doc_id", "text").alias("order"))
    counts = {r["lang"]: r["n"] for r in hashed.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").limit(rows).collect()}
    if not counts:
        return [], None
    each = max(1, rows // len(counts))
    # a language's limit on hashes lets about twice its share through; the rest never moves
    limit = {lang: min((1 << 63) - 1, -(1 << 63) + (((2 * each + 40) << 64) // n)) for lang, n in counts.items()}
    below = hashed.sparkSession.createDataFrame(list(limit.items()), "lang string, _limit long")
    few = hashed.join(F.broadcast(below), "lang").where("order <= _limit")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("order", F.length("text")))
    chosen = few.withColumn("_place", place).where(F.col("_place") <= each).select("lang", "order", "text")
    got = chosen.mapInArrow(_sample, "lang string, order long, windows binary").collect()
    got.sort(key=lambda r: (r["lang"], r["order"], r["windows"]))
    languages = sorted({r["lang"] for r in got})
    wins = [np.frombuffer(r["windows"], np.uint8).reshape(-1, WINDOW) for r in got]
    labels = np.repeat([languages.index(r["lang"]) for r in got], [len(w) for w in wins])
    return languages, Network(len(languages)).fit(np.concatenate(wins), labels)


def predict(docs: DataFrame, languages: list[str], network: Network | None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``."""
    rows = folded(docs, "text").withColumn("a1", F.coalesce(F.regexp_like("a0", F.lit(r"\p{L}")), F.lit(False)))
    known = np.array([*languages, "und"], dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = network.tables() if network else None
        for batch in slices(batches, "a0"):
            raw, begin, end = buffers(batch.column("a0"))
            asked = batch.column("a1").to_numpy(zero_copy_only=False).astype(bool)
            pred, score = np.full(batch.num_rows, len(languages)), np.zeros(batch.num_rows)
            if network is not None and asked.any():
                own = np.flatnonzero(asked)
                sums = np.zeros((len(own), len(languages)))
                weight = np.zeros(len(own))
                start, stop, text = window_places(begin[own], end[own])
                for i in range(0, len(start), HELD):  # so many at a time, however long a text is
                    part = slice(i, i + HELD)
                    wins = cut(raw, start[part], stop[part])
                    letters = LETTER[wins].sum(1)
                    np.add.at(sums, text[part], network.probabilities(wins, tables) * letters[:, None])
                    np.add.at(weight, text[part], letters)
                mean = sums / weight[:, None]
                pred[own], score[own] = mean.argmax(1), np.clip(mean.max(1), 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("a0"), pa.array(known[pred], pa.string()), pa.array(score, pa.float64())], ["row", "a0", "lang_pred", "score"])
        release()

    row = rows.schema["row"].dataType.simpleString()
    out = rows.mapInArrow(run, f"row {row}, a0 string, lang_pred string, score double")
    return unfolded(out, docs.columns, {"text": "a0"}, {c: F.col(c) for c in ("lang_pred", "score")})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    languages, network = train(docs)
    asked = docs.select("doc_id", "text", held_out().alias("held_out"))
    return predict(asked, languages, network).select("doc_id", "held_out", "lang_pred", "score")
