"""Session protocol over a stream of requests, one keyed state for each session.

Requests: ``session, seq, kind (reset|act|final), attempt, step, value``.  A reset
opens an attempt (0, or the next after a finalised one); an act must carry the
next step, a repeat of the last step is answered again and changes nothing; a
final must carry the number of steps and may be repeated.  After a fault only
reset 0 is accepted.  At the end only complete groups of four steps count: the
incomplete tail is discarded, never padded.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

GROUP = 4
REPLY = "session string, seq long, kind string, attempt int, step long, status string, groups long"
STATE = "attempt int, step long, open boolean, fault boolean"
START = (-1, 0, False, False)


def advance(state: tuple, kind: str, attempt: int, step: int) -> tuple[tuple, str, int]:
    """The next state, the reply's status, and how many complete groups the session's attempt has."""
    own, done, is_open, fault = state
    groups = done // GROUP
    if kind == "reset":
        if attempt == 0 or (not fault and not is_open and attempt == own + 1 and own >= 0):
            return (attempt, 0, True, False), "ok", 0
        return (own, done, is_open, True), "fault", groups
    if fault:
        return state, "latched", groups
    if kind == "act" and is_open and attempt == own:
        if step == done:
            return (own, done + 1, True, False), "ok", (done + 1) // GROUP
        if step == done - 1:
            return state, "repeat", groups
    if kind == "final" and attempt == own and step == done:
        return (own, done, False, False), "ok" if is_open else "repeat", groups
    return (own, done, is_open, True), "fault", groups


def _replies(rows: pd.DataFrame, state: tuple) -> tuple[list[tuple], tuple]:
    out = []
    for r in rows.sort_values("seq").itertuples(index=False):
        state, status, groups = advance(state, r.kind, int(r.attempt), int(r.step))
        out.append((r.session, r.seq, r.kind, r.attempt, r.step, status, groups))
    return out, state


NAMES = [x.split()[0] for x in REPLY.split(", ")]


def serve(requests: DataFrame) -> DataFrame:
    """Replies to a stream of requests."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else START
        out, held = _replies(pd.concat(list(frames)), tuple(held))
        state.update(held)
        yield pd.DataFrame(out, columns=NAMES)

    return requests.groupBy("session").applyInPandasWithState(run, REPLY, STATE, "append", GroupStateTimeout.NoTimeout)


def replay(requests: DataFrame) -> DataFrame:
    """The same replies from a batch of requests."""
    return requests.groupBy("session").applyInPandas(lambda pdf: pd.DataFrame(_replies(pdf, START)[0], columns=NAMES), REPLY)


def distinct_steps(requests: DataFrame, time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each (session, step) once within the watermark: repeats of a request are idempotent."""
    return requests.withWatermark(time, late).dropDuplicatesWithinWatermark(["session", "step"])


def latest(replies: DataFrame) -> DataFrame:
    """The current state of each session."""
    return replies.groupBy("session").agg(F.max_by(F.struct("attempt", "step", "status", "groups"), "seq").alias("now")).select("session", "now.*")
