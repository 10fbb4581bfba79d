"""Order-dependent interaction memories of an episode, as grouped maps; the state of one episode is bounded.

A merging store: a new (phase, effect) joins the stored entry of the best
weighted cosine if that reaches the threshold (running mean, normalised again),
else it is appended; at capacity the entry with the least (count, attempt, step,
place) makes room.  Merging is not associative, so rows of an episode are taken
in order; episodes are independent.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F


def unit(x: np.ndarray) -> np.ndarray:
    return x / max(float(np.sqrt(x @ x)), 1e-12)


@dataclass
class MergingStore:
    capacity: int = 256
    threshold: float = 0.85
    phase_weight: float = 0.5
    effect_weight: float = 0.5
    entries: list[dict] = field(default_factory=list)

    def add(self, phase: np.ndarray, effect: np.ndarray, attempt: int, step: int) -> tuple[int, bool]:
        """Place of the entry that holds the observation, and whether it was merged."""
        phase, effect = unit(np.asarray(phase, float)), unit(np.asarray(effect, float))
        if self.entries:
            phases, effects = np.stack([e["phase"] for e in self.entries]), np.stack([e["effect"] for e in self.entries])
            score = (self.phase_weight * (phases @ phase) + self.effect_weight * (effects @ effect)) / (self.phase_weight + self.effect_weight)
            best = int(np.argmax(score))  # the first of equals
            if score[best] >= self.threshold:
                e = self.entries[best]
                n = e["count"]
                e |= {"phase": unit((e["phase"] * n + phase) / (n + 1)), "effect": unit((e["effect"] * n + effect) / (n + 1)), "count": n + 1, "attempt": attempt, "step": step}
                return best, True
        if len(self.entries) >= self.capacity:
            out = min(range(len(self.entries)), key=lambda i: (self.entries[i]["count"], self.entries[i]["attempt"], self.entries[i]["step"], i))
            del self.entries[out]
        self.entries.append({"phase": phase, "effect": effect, "count": 1, "attempt": attempt, "step": step})
        return len(self.entries) - 1, False

    def query(self, phase: np.ndarray, k: int, not_attempt: int | None = None) -> list[tuple[int, float]]:
        """Places and scores of the ``k`` nearest entries by phase, earlier entries first among equals."""
        phase = unit(np.asarray(phase, float))
        found = [(i, float(e["phase"] @ phase)) for i, e in enumerate(self.entries) if e["attempt"] != not_attempt]
        return sorted(found, key=lambda x: (-x[1], x[0]))[:k]


def merge_memory(rows: DataFrame, capacity: int = 256, threshold: float = 0.85) -> DataFrame:
    """``episode, step, slot, merged, size`` after each row of ``episode, step, attempt, phase, effect``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("step")
        store = MergingStore(capacity, threshold)
        out = []
        for e, s, a, p, f in zip(pdf["episode"], pdf["step"], pdf["attempt"], pdf["phase"], pdf["effect"]):
            slot, merged = store.add(p, f, int(a), int(s))
            out.append((e, s, slot, merged, len(store.entries)))
        return pd.DataFrame(out, columns=["episode", "step", "slot", "merged", "size"])

    return rows.select("episode", "step", "attempt", "phase", "effect").groupBy("episode").applyInPandas(run, "episode long, step long, slot long, merged boolean, size long")


def recall_memory(rows: DataFrame, k: int = 4, capacity: int = 256, threshold: float = 0.85, other_attempts: bool = False) -> DataFrame:
    """``episode, step, rank, entry_step, score``: what each row of ``merge_memory``'s input finds by phase before it is added.

    ``entry_step`` is the last step that went into the entry; with
    ``other_attempts`` entries of the row's own attempt are left out.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        store = MergingStore(capacity, threshold)
        out = []
        for e, s, a, p, f in pdf.sort_values("step")[["episode", "step", "attempt", "phase", "effect"]].itertuples(index=False):
            found = store.query(p, k, int(a) if other_attempts else None)
            out += [(e, s, rank, store.entries[i]["step"], score) for rank, (i, score) in enumerate(found, 1)]
            store.add(p, f, int(a), int(s))
        return pd.DataFrame(out, columns=["episode", "step", "rank", "entry_step", "score"])

    return rows.select("episode", "step", "attempt", "phase", "effect").groupBy("episode").applyInPandas(run, "episode long, step long, rank long, entry_step long, score double")


def scope_violations(rows: DataFrame) -> DataFrame:
    """Rows whose attempt neither stays nor goes up by one, or whose task differs from the row before."""
    w = Window.partitionBy("episode").orderBy("step")
    step = F.col("attempt") - F.lag("attempt").over(w)
    return rows.withColumn("bad_attempt", ~F.coalesce(step.isin(0, 1), F.lit(True))).withColumn("bad_task", F.coalesce(F.lag("task").over(w) != F.col("task"), F.lit(False))).where("bad_attempt or bad_task")


def record_counts(lengths: DataFrame, size: int = 33) -> DataFrame:
    """How many query and effect records an episode has: one query each 4 steps, one effect each completed 16."""
    last = (F.floor((F.col("length") - size) / 4) * 4).cast("long")
    fits = lengths.where(F.col("length") >= size).withColumn("last_query", last)
    return fits.select("episode_index", "last_query", (F.floor(F.col("last_query") / 4) + 1).alias("queries"), F.floor(F.floor((F.col("last_query") + 32) / 4) / 4).alias("effects"))


def cache_records(lengths: DataFrame) -> DataFrame:
    """A query record for each boundary and an effect record for each completed 16 steps, in canonical order keys."""
    n = record_counts(lengths)
    queries = n.select("episode_index", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last_query"), F.lit(4).cast("long"))).alias("raw_step"), F.lit(True).alias("is_query"))
    effects = n.where("effects > 0").select("episode_index", F.explode(F.transform(F.sequence(F.lit(1).cast("long"), F.col("effects")), lambda i: i * 16)).alias("raw_step"), F.lit(False).alias("is_query"))
    rows = queries.unionByName(effects)
    return rows.withColumn("effect_index", F.when(~F.col("is_query"), F.floor(F.col("raw_step") / 16) - 1))
