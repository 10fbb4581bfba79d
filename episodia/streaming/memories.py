"""Memories of an episode over a stream: a ring of recent effects and a merging store, in keyed state.

Records: ``episode, place, kind, attempt, task, phase, effect``.  Kinds:

* ``reset`` starts an episode: both memories are empty, the attempt is 0;
* ``attempt`` goes on with the same attempt or the next one: the ring is emptied, the store stays;
* ``end`` ends the attempt: the ring is emptied at once, the store stays;
* ``effect`` is a completed effect: it is in both memories from the next record on;
* ``query`` asks for the ring and the nearest stored entries by phase, those of its own attempt too.

Every record gets one reply; a record that breaks a rule (no reset yet, an
attempt that skips one, another task, a place that does not go on) gets its
reason and changes nothing.  ``replay`` gives the same replies for a table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from episodia.operators.memory import MergingStore

HIT = "struct<entry:bigint,score:double,count:bigint,attempt:int,step:bigint>"
REPLY = f"episode long, place long, kind string, status string, attempt int, effects long, ring array<array<double>>, ring_steps array<bigint>, hits array<{HIT}>"
NAMES = [x.split()[0] for x in "episode long, place long, kind string, status string, attempt int, effects long, ring a, ring_steps a, hits a".split(", ")]
RECORD = ["episode", "place", "kind", "attempt", "task", "phase", "effect"]
WINDOW = 4  # steps of an effect

NOW = "task string, attempt int, effects long, place long, entries long"
RING = "effect array<double>, step long"
ENTRY = "phase array<double>, effect array<double>, count long, attempt int, step long"


@dataclass
class Memories:
    """The state of one episode and its rules."""

    ring_size: int = 4
    hits: int = 4
    capacity: int = 256
    threshold: float = 0.85
    task: str | None = None
    attempt: int = 0
    effects: int = 0
    place: int = -1
    entries: int = 0
    ring: list[tuple[list[float], int]] = field(default_factory=list)
    store: MergingStore = field(default_factory=MergingStore)

    def __post_init__(self) -> None:
        self.store = MergingStore(self.capacity, self.threshold)

    def fault(self, place: int, kind: str, attempt: int, task: str) -> str | None:
        if place <= self.place:
            return "order"
        if kind == "reset":
            return None
        if self.task is None:
            return "no reset"
        if kind == "attempt":
            return None if attempt - self.attempt in (0, 1) else "attempt"
        return "task" if kind == "effect" and task != self.task else None

    def take(self, place: int, kind: str, attempt: int, task: str, phase, effect) -> tuple:
        """The reply to one record."""
        status = self.fault(place, kind, attempt, task)
        ring, steps, found = None, None, None
        if status is None:
            self.place = place
            if kind == "reset":
                self.task, self.attempt, self.effects, self.ring = task, 0, 0, []
                self.store.entries.clear()
            elif kind == "attempt":
                self.attempt, self.effects, self.ring = attempt, 0, []
            elif kind == "end":
                self.ring = []
            elif kind == "effect":
                step = self.effects * WINDOW
                self.ring = [*self.ring, (np.asarray(effect, float).tolist(), step)][-self.ring_size :]
                slot, merged = self.store.add(phase, effect, self.attempt, step)
                if not merged:
                    self.store.entries[slot]["entry"] = self.entries
                    self.entries += 1
                self.effects += 1
            elif kind == "query":
                ring, steps = [x for x, _ in self.ring], [s for _, s in self.ring]
                found = []
                for slot, score in self.store.query(phase, self.hits):
                    e = self.store.entries[slot]
                    found.append({"entry": e["entry"], "score": score, "count": e["count"], "attempt": e["attempt"], "step": e["step"]})
        return kind, status or "ok", self.attempt, self.effects, ring, steps, found


def _replies(episode: int, frames: Iterator[pd.DataFrame], memories: Memories) -> pd.DataFrame:
    rows = pd.concat(list(frames)).sort_values("place", kind="stable")
    out = []
    for place, kind, attempt, task, phase, effect in zip(*(rows[c] for c in RECORD[1:])):
        out.append((episode, place, *memories.take(int(place), kind, int(attempt), task, phase, effect)))
    return pd.DataFrame(out, columns=NAMES)


class MemoryProcessor(StatefulProcessor):
    """Ring as a list, store as a map by entry number (its order is the store's), the rest as one value.

    Only entries that a batch changed are written back.
    """

    def __init__(self, **options):
        self.options = options

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", NOW)
        self.ring = handle.getListState("ring", RING)
        self.stored = handle.getMapState("store", "entry long", ENTRY)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        memories = Memories(**self.options)
        before = {}
        if self.now.exists():
            memories.task, memories.attempt, memories.effects, memories.place, memories.entries = self.now.get()
            memories.ring = [(list(effect), step) for effect, step in self.ring.get()]
            for (entry,), (phase, effect, count, attempt, step) in sorted(self.stored.iterator()):
                memories.store.entries.append({"phase": np.array(phase), "effect": np.array(effect), "count": count, "attempt": attempt, "step": step, "entry": entry})
                before[entry] = (count, attempt, step)
        out = _replies(int(key[0]), rows, memories)
        if memories.task is not None:
            self.now.update((memories.task, memories.attempt, memories.effects, memories.place, memories.entries))
            if memories.ring:
                self.ring.put([(effect, int(step)) for effect, step in memories.ring])
            else:
                self.ring.clear()
            held = {e["entry"]: e for e in memories.store.entries}
            for entry in before.keys() - held.keys():
                self.stored.removeKey((entry,))
            for entry, e in held.items():
                if before.get(entry) != (e["count"], e["attempt"], e["step"]):
                    self.stored.updateValue((entry,), (e["phase"].tolist(), e["effect"].tolist(), int(e["count"]), int(e["attempt"]), int(e["step"])))
        yield out

    def close(self) -> None:
        pass


def serve(records: DataFrame, **options) -> DataFrame:
    """Replies to a stream of records; the places of an episode ascend over the micro-batches."""
    return records.select(*RECORD).groupBy("episode").transformWithStateInPandas(MemoryProcessor(**options), REPLY, "Append", "None")


def replay(records: DataFrame, **options) -> DataFrame:
    """The same replies from a table of records; one episode is one task's, its state is bounded."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return _replies(int(key[0]), iter([rows]), Memories(**options))

    return records.select(*RECORD).groupBy("episode").applyInPandas(run, REPLY)
