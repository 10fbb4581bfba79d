"""Quality rules: text statistics and a learned, ordered decision list.

``text_stats`` measures every whole text in one pass of Arrow batches (no
shuffle).  ``learn`` fits reject rules by sequential covering on a bounded
sample of labelled statistics: each rule is grown one threshold at a time by
information gain on two thirds of the rows still uncovered, then its conditions
are pruned on the other third, and it is accepted only while it is precise
there.  ``verdict`` turns the ordered rules into one Spark ``CASE`` expression.

Words, lines and three-word windows are compared by 64-bit hashes within one
text.

Defined cases: a null or empty text has no words and zero statistics; a null
``doc_id`` is carried through; repeated rows are judged one by one; an empty
table gives an empty result; without labels (or without both classes) no rule is
learned and only the base conditions decide; of several labels of a ``doc_id``
the least counts.  Further columns pass through, but a result column
(``COUNTS``, ``base_failed``, ``rule``, ``kept``) replaces one of its name;
``keep`` returns the columns of its input whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from episodia.llm import textkernel as tk
from episodia.llm.shared import folded, least_hashes, stored, unfolded

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_punct", "n_digits", "n_bytes"]
#: Largest number of labelled rows that the rules are fitted on.
MAX_LABELLED = 20_000


def _classes(members: str) -> np.ndarray:
    lut = np.zeros(256, bool)
    lut[list(members.encode())] = True
    return lut


SYMBOL = _classes("#*$%&|<>")
UPPER = _classes("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
PUNCT = _classes("!\"'(),-./:;?@[\\]^_`{}~+=")
DIGIT = _classes("0123456789")


def _per_text(mask: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    at = np.flatnonzero(mask)
    return np.searchsorted(at, ends) - np.searchsorted(at, starts)


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    raw, starts, ends = tk.buffers(texts)
    n = len(starts)
    w = tk.Words(raw, starts, ends)
    solid = ~tk.SPACE[raw]
    out = {"n_words": w.count, "word_chars": _per_text(solid & ((raw & 0xC0) != 0x80), starts, ends)}
    for name, lut in (("n_symbols", SYMBOL), ("n_upper", UPPER), ("n_punct", PUNCT), ("n_digits", DIGIT)):
        out[name] = _per_text(lut[raw], starts, ends)
    out["n_bytes"] = ends - starts

    newline = np.flatnonzero(raw == 10)
    begin = np.concatenate([starts, newline + 1])
    end = np.concatenate([ends, newline])
    holder = np.concatenate([np.arange(n), tk.owner(newline, starts)])
    order = np.lexsort((begin, holder))  # the k-th start of a text goes with its k-th end
    begin, holder = begin[order], holder[order]
    end = end[np.lexsort((end, np.concatenate([np.arange(n), tk.owner(newline, starts)])))]
    out["n_lines"] = np.bincount(holder, minlength=n)
    has = np.searchsorted(w.begin, end) > np.searchsorted(w.end, begin, "right")
    begin, end, holder = begin[has], end[has], holder[has]
    _, at = tk.sorted_unique(tk.range_hash(raw, begin, end), holder, n)
    out["n_dup_lines"] = np.bincount(holder, minlength=n) - np.diff(at)

    first, h = w.windows(3)
    twin = first[tk.same(tk.mix(h + w.doc[first].astype(np.uint64) * tk.U64(tk.BASE)))]
    marked = np.zeros(len(w.doc), bool)
    for k in range(3):
        marked[twin + k] = True
    out["n_repeat_words"] = np.bincount(w.doc[marked], minlength=n)
    return out


def _measured(rows: DataFrame) -> DataFrame:
    """``row, a0`` (the text) and the statistics in ``COUNTS`` (long)."""
    schema = T.StructType([rows.schema["row"], rows.schema["a0"], *(T.StructField(c, T.LongType()) for c in COUNTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tk.slices(batches, "a0"):
            m = measure(b.column("a0"))
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("a0"), *(pa.array(m[c], pa.int64()) for c in COUNTS)], schema.names)

    return rows.select("row", "a0").mapInArrow(run, schema)


def text_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs``, without their text, with the statistics in ``COUNTS``."""
    rest = [c for c in docs.columns if c != text]
    return unfolded(_measured(folded(docs, text)), rest, {}, {c: F.col(c) for c in COUNTS})


def features() -> dict[str, Column]:
    words, chars, size = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "word_chars", "n_bytes"))
    return {
        "n_words": F.col("n_words").cast("double"),
        "mean_word_length": F.col("word_chars") / words,
        "symbol_share": F.col("n_symbols") / chars,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / words,
        "upper_share": F.col("n_upper") / chars,
        "punct_share": F.col("n_punct") / chars,
        "digit_share": F.col("n_digits") / chars,
        "bytes_per_word": size / words,
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        x = features()[self.feature]
        return x >= F.lit(self.threshold) if self.above else x <= F.lit(self.threshold)

    def covers(self, x: np.ndarray) -> np.ndarray:
        return x >= self.threshold if self.above else x <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _covered(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    return reduce(np.logical_and, (c.covers(x[c.feature]) for c in rule), np.ones(n, bool))


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, max_conditions: int) -> Rule:
    rule: Rule = ()
    inside = np.ones(len(bad), bool)
    while len(rule) < max_conditions:
        p0, n0 = int(bad[inside].sum()), int((~bad[inside]).sum())
        if not n0 or not p0:
            break
        base, best = log2(p0 / (p0 + n0)), (0.0, None)
        for name, v in x.items():
            values = v[inside]
            order = np.argsort(values, kind="stable")
            vs, pos = values[order], np.cumsum(bad[inside][order])
            cuts = np.flatnonzero(vs[1:] > vs[:-1])
            if not len(cuts):
                continue
            mid = (vs[cuts] + vs[cuts + 1]) / 2
            for above in (False, True):
                p = p0 - pos[cuts] if above else pos[cuts]
                n = (len(vs) - cuts - 1 if above else cuts + 1) - p
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / (p + n)) - base), -np.inf)
                k = int(np.argmax(gain))
                if gain[k] > best[0] + 1e-9:
                    best = (float(gain[k]), Condition(name, above, float(mid[k])))
        if best[1] is None:
            break
        rule = (*rule, best[1])
        inside &= best[1].covers(x[best[1].feature])
    return rule


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """The shortest prefix of the rule with the best (p - n) / (p + n) on the pruning rows."""
    best, best_worth = rule, -2.0
    for k in range(1, len(rule) + 1):
        hit = _covered(rule[:k], x, len(bad))
        p, n = int(bad[hit].sum()), int((~bad[hit]).sum())
        worth = (p - n) / (p + n) if p + n else -1.0
        if worth > best_worth + 1e-9:
            best, best_worth = rule[:k], worth
    return best


def learn(labelled: DataFrame, label: str = "quality", max_rows: int = MAX_LABELLED, max_rules: int = 12, max_conditions: int = 4, min_precision: float = 0.95, min_support: int = 5, seed: int = 7) -> list[Rule]:
    """Ordered reject rules from rows that hold ``COUNTS`` and a 0/1 label.

    At most ``max_rows`` labelled rows are used, those of the smallest seeded
    hash of ``doc_id``; this is the only sample that the operator takes.
    """
    cols = features()
    chosen = labelled.where(F.col(label).isin(0, 1)).select(
        F.xxhash64("doc_id", F.lit(seed)).alias("_o"), "doc_id", F.col(label).alias("_bad"), *(c.alias(f"_{k}") for k, c in cols.items())
    )
    rows = least_hashes(chosen, "_o", max_rows).toPandas()
    bad = rows["_bad"].to_numpy() == 0
    x = {k: rows[f"_{k}"].to_numpy(float) for k in cols}
    part = np.arange(len(rows)) % 3 == 2
    left = np.ones(len(rows), bool)
    rules: list[Rule] = []
    while len(rules) < max_rules:
        grow, prune = left & ~part, left & part
        if not bad[grow].any() or not (~bad[grow]).any():
            break
        rule = _grow({k: v[grow] for k, v in x.items()}, bad[grow], max_conditions)
        if not rule:
            break
        rule = _prune(rule, {k: v[prune] for k, v in x.items()}, bad[prune])
        hit = _covered(rule, x, len(bad)) & left
        held = hit & part
        if bad[hit].sum() < min_support or bad[held].sum() < min_precision * max(held.sum(), 1) or bad[hit].sum() < min_precision * hit.sum():
            break
        rules.append(rule)
        left &= ~hit
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that covers a row (from 1), or null, as one CASE expression."""
    out = F.lit(None).cast("int")
    for k in range(len(rules), 0, -1):
        out = F.when(reduce(lambda a, b: a & b, (c.column() for c in rules[k - 1])), F.lit(k)).otherwise(out)
    return out


def base_failed(min_words: int = 50, max_repeat_percent: int = 50) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def _labels(labels: DataFrame) -> DataFrame:
    return labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("_label"))


def judge(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """``stats`` with ``base_failed``, ``rule`` and ``kept``; rules are learned from ``labels``."""
    rules = learn(stored(stats.select("doc_id", *COUNTS).join(_labels(labels), "doc_id")), "_label")
    return stats.withColumns({"base_failed": base_failed(), "rule": verdict(rules)}).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def keep(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps.

    The texts are measured once, into a stored table; the rules are learned from
    its narrow columns, so no text is shuffled.
    """
    rows = folded(docs, text)
    place = [c for c in docs.columns if c != text].index("doc_id")
    measured = stored(_measured(rows))
    stats = measured.select(F.col("row").getField(f"c{place}").alias("doc_id"), *COUNTS)
    rules = learn(stored(stats.join(_labels(labels), "doc_id")), "_label")
    return unfolded(measured.where(~base_failed() & verdict(rules).isNull()), docs.columns, {text: "a0"})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    stats = stored(text_stats(docs))
    return judge(stats, spark.read.parquet(f"{sf_dir}/labels.parquet")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
