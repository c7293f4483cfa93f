"""A job queue as state over an event stream: back-off, dead letters and stuck jobs, by timers in event time.

Each job has a state: its attempts since the last success, and since when it runs. A failure puts the job back with a delay
that doubles, or among the dead; a start sets a timer, and a job that runs on past it is put back as stuck. State is keyed by
job and lies in the state store, so it grows with the jobs, not with the events.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Attempts after which a job is dead, seconds of the first delay, seconds after which a running job is stuck.
MOST, BASE, STUCK = 3, 30, 3600
OUT = "job long, at timestamp, status string, attempts int, delay_s int"
#: Where Spark keeps state with timers.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Jobs(StatefulProcessor):
    """Transitions of one job a key. Events of a batch are taken in the order of time and id."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.attempts = handle.getValueState("attempts", "n int")
        self.since = handle.getValueState("since", "us long")

    def _wait(self, us: int | None) -> None:
        """From now on the job runs since `us`, or doesn't run."""
        if self.since.exists():
            self.handle.deleteTimer((self.since.get()[0] + STUCK * 1_000_000) // 1000)
            self.since.clear()
        if us is not None:
            self.since.update((us,))
            self.handle.registerTimer((us + STUCK * 1_000_000) // 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        (job,) = key
        out = []
        events = pd.concat([*rows]).sort_values(["us", "id"], kind="stable")
        n = self.attempts.get()[0] if self.attempts.exists() else 0
        since = self.since.get()[0] if self.since.exists() else None
        for us, kind in zip(events["us"].tolist(), events["kind"].tolist()):
            if since is not None and us > since + STUCK * 1_000_000:
                out.append((job, since + STUCK * 1_000_000, "STUCK", n, None))
            since = None
            if kind == "start":
                since = us
            elif kind == "done":
                n = 0
            elif kind == "fail":
                n += 1
                out.append((job, us, "DEAD", n, None) if n >= MOST else (job, us, "QUEUED", n, BASE * 2 ** (n - 1)))
        self.attempts.update((n,))
        self._wait(since)
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        (job,) = key
        out = []
        if self.since.exists():
            n = self.attempts.get()[0] if self.attempts.exists() else 0
            out.append((job, self.since.get()[0] + STUCK * 1_000_000, "STUCK", n, None))
            self.since.clear()
        yield _frame(out)

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    made = pd.DataFrame(rows, columns=["job", "at", "status", "attempts", "delay_s"])
    made["at"] = pd.to_datetime(made["at"], unit="us").astype("datetime64[ns]")
    return made.astype({"job": "int64", "attempts": "Int32", "delay_s": "Int32"})


def transitions(events: DataFrame, job: str, at: str, kind: str, id: str, delay: str = "1 hour") -> DataFrame:
    """(job, at, status, attempts, delay_s) of a stream: QUEUED with its delay or DEAD at a failure, STUCK where a job has run
    for STUCK seconds without an event. `kind`: start, done or fail, else the event only shows that the job lives. Attempts
    count from the last success. A stuck job is told when the watermark, `delay` behind the latest event, has passed."""
    rows = events.select(F.col(job).cast("long").alias("job"), F.col(at).cast("timestamp").alias("ts"), F.unix_micros(F.col(at).cast("timestamp")).alias("us"), F.col(kind).alias("kind"), F.col(id).cast("long").alias("id"))
    return rows.withWatermark("ts", delay).groupBy("job").transformWithStateInPandas(statefulProcessor=Jobs(), outputStructType=OUT, outputMode="Append", timeMode="EventTime")
