"""Sessions that fall silent, closed by event time.

Requests: ``session, ts, seq, kind (reset|act)``.  A reset opens a session, acts
count while it is open.  A session without a request for longer than the limit
is closed at its last request plus the limit: complete groups of four acts
count, the incomplete tail is discarded and never padded, and acts after that
are rejected until the next reset.  A reset of an open session closes it too.

``closed`` gives this for a table, in windows.  ``close_stream`` gives the same
for a stream whose requests arrive out of order: requests wait in state until
the watermark has passed them, and an event-time timer closes a session that
stays silent.  Requests later than the watermark are dropped by the stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

GROUP = 4
CLOSED = "session long, opened timestamp, closed timestamp, why string, acts long, groups long, discarded long, rejected long"
COLUMNS = [x.split()[0] for x in CLOSED.split(", ")]


def closed(requests: DataFrame, limit_seconds: int, end: str | None = None) -> DataFrame:
    """One row a session life that has ended, with the acts that came after its end.

    ``end`` is how far the clock has come; a life that is still open by then is left out.
    Without it every life is taken as silent after its last request.
    """
    order = Window.partitionBy("session").orderBy("ts", "seq")
    life = F.sum((F.col("kind") == "reset").cast("long")).over(order)
    rows = requests.withColumn("life", life).where("life > 0")
    own = Window.partitionBy("session", "life").orderBy("ts", "seq")
    silent = F.col("ts") > F.lag("ts").over(own) + F.make_dt_interval(secs=F.lit(limit_seconds))
    late = F.max(F.coalesce(silent, F.lit(False))).over(own.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("late", late)
    lives = rows.groupBy("session", "life").agg(
        F.min("ts").alias("opened"), F.max(F.when(~F.col("late"), F.col("ts"))).alias("last"),
        F.count_if(~F.col("late") & (F.col("kind") == "act")).alias("acts"), F.count_if(F.col("late")).alias("rejected"),
    )
    following = F.lead("opened").over(Window.partitionBy("session").orderBy("life"))
    silent = F.col("last") + F.make_dt_interval(secs=F.lit(limit_seconds))
    lives = lives.withColumns({"_next": following, "_silent": silent})
    by_reset = F.col("_next").isNotNull() & (F.col("_next") <= F.col("_silent"))
    out = lives.withColumns({"closed": F.when(by_reset, F.col("_next")).otherwise(F.col("_silent")), "why": F.when(by_reset, "reset").otherwise("silence")})
    if end is not None:
        out = out.where(by_reset | (F.col("_silent") < F.lit(end).cast(requests.schema["ts"].dataType)))
    groups = F.floor(F.col("acts") / GROUP)
    return out.select("session", "opened", "closed", "why", "acts", groups.alias("groups"), (F.col("acts") - groups * GROUP).alias("discarded"), "rejected")


class SilenceProcessor(StatefulProcessor):
    """Requests wait in a list until their timer; ``life`` is (opened, last, acts, rejected, open) in milliseconds.

    A life that was closed by silence waits for the rejected acts: its row goes out
    when the next reset comes, or ``keep`` after its end.
    """

    def __init__(self, limit_seconds: int, keep_seconds: int):
        self.limit, self.keep = limit_seconds * 1000, keep_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts long, seq long, kind string")
        self.life = handle.getValueState("life", "opened long, last long, acts long, rejected long, open boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        times = set()
        for frame in rows:
            for ts, seq, kind in zip(frame["ts"], frame["seq"], frame["kind"]):
                at = int(ts.value // 1_000_000)
                self.waiting.appendValue((at, int(seq), kind))
                times.add(at)
        for at in times:
            self.handle.registerTimer(at)
        yield pd.DataFrame([], columns=COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        waiting = sorted(self.waiting.get()) if self.waiting.exists() else []
        due = [x for x in waiting if x[0] <= now]
        if due:
            rest = waiting[len(due) :]
            if rest:
                self.waiting.put(rest)
            else:
                self.waiting.clear()
        life = self.life.get() if self.life.exists() else None
        out = []
        for at, _, kind in due:
            life = self._silent(life, at)
            if kind == "reset":
                if life:
                    out.append(self._row(key, life, at if life[4] else None))
                life = (at, at, 0, 0, True)
            elif life and life[4]:
                life = (life[0], at, life[2] + 1, life[3], True)
            elif life:
                life = (life[0], life[1], life[2], life[3] + 1, False)
        life = self._silent(life, now)
        if life and now >= life[1] + self.limit + self.keep:
            out.append(self._row(key, life, None))
            life = None
        if life:
            self.life.update(life)
            self.handle.registerTimer(life[1] + self.limit + (1 if life[4] else self.keep))
        elif self.life.exists():
            self.life.clear()
        yield pd.DataFrame(out, columns=COLUMNS)

    def _silent(self, life: tuple | None, now: int) -> tuple | None:
        if life and life[4] and now > life[1] + self.limit:
            return (*life[:4], False)
        return life

    def _row(self, key, life: tuple, reset: int | None) -> tuple:
        opened, last, acts, rejected, _ = life
        end = last + self.limit if reset is None else reset
        stamp = lambda ms: pd.Timestamp(ms, unit="ms")
        return (int(key[0]), stamp(opened), stamp(end), "silence" if reset is None else "reset", acts, acts // GROUP, acts % GROUP, rejected)

    def close(self) -> None:
        pass


def close_stream(requests: DataFrame, limit_seconds: int, late: str = "1 hour", keep_seconds: int = 0) -> DataFrame:
    """``closed`` for a stream (times in whole milliseconds, a session in one time zone).

    ``late`` is how far out of order requests may come; ``keep_seconds`` is how
    long a closed session's state waits for acts to reject.  A reset that comes
    within it takes the row along; after it the state is gone and acts without a
    reset are ignored.
    """
    rows = requests.select("session", "ts", "seq", "kind").withWatermark("ts", late)
    return rows.groupBy("session").transformWithStateInPandas(SilenceProcessor(limit_seconds, keep_seconds), CLOSED, "Append", "EventTime")
