"""Streaming forms of the job-log operators, as micro-batch merges, stateful aggregates and processors whose state ends."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def fold_stream(log: DataFrame, events: list[str]) -> DataFrame:
    """The running fold of every job: last payload per event type and its count.

    The same aggregate as the batch fold, kept up to date by Spark's own state; write it
    with output mode ``update`` or ``complete``.
    """
    return log.groupBy("job_id").agg(
        *[
            F.max_by("data", F.when(F.col("event") == e, F.col("seq"))).alias(f"last_{e}")
            for e in events
        ],
        *[F.count_if(F.col("event") == e).alias(f"n_{e}") for e in events],
        F.max("seq").alias("last_seq"),
    )


def stage_stream(log: DataFrame) -> DataFrame:
    """The latest status per (job, stage) of a stream of (job_id, seq, stage, status)."""
    return log.groupBy("job_id", "stage").agg(F.max_by("status", "seq").alias("status"))


def readiness_stream(reports: DataFrame, expected: list[str]) -> DataFrame:
    """Per job: which expected sources reported and when the last of them first did."""
    firsts = [
        F.min(F.when(F.col("source") == s, F.col("ts"))).alias(f"first_{i}")
        for i, s in enumerate(expected)
    ]
    names = [F.col(f"first_{i}") for i in range(len(expected))]
    ready = names[0].isNotNull()
    for name in names[1:]:
        ready = ready & name.isNotNull()
    latest = F.greatest(*names) if len(names) > 1 else names[0]
    return (
        reports.where(F.col("source").isin(expected))
        .groupBy("job_id")
        .agg(*firsts)
        .select("job_id", ready.alias("ready"), F.when(ready, latest).alias("ready_at"))
    )


def write_frames(log: DataFrame, path: str, checkpoint: str):
    """Append a job log to a folder as JSON rows, exactly once per micro-batch."""
    return (
        log.writeStream.format("json")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


#: Seconds after which a job that never ended is forgotten.
KEEP_S = 30 * 86400


class EndedFolds(StatefulProcessor):
    """Per job: the last payload and the number of events of each kind, given out as one row by the terminal event.

    State is one row a kind and ends with the job, or ``keep_s`` after its first event. A job that comes again starts anew.
    """

    def __init__(self, events: list[str], terminal: list[str], keep_s: int):
        self.events, self.terminal, self.keep_ms = events, set(terminal), keep_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kinds = handle.getMapState("kinds", "event string", "seq bigint, data string, n bigint")
        self.ends = handle.getValueState("ends", "ms bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        kinds = {event: self.kinds.getValue((event,)) for (event,) in self.kinds.keys()} if self.kinds.exists() else {}
        batch = pd.concat(list(rows)).sort_values("seq")
        for seq, event, data in zip(batch["seq"].tolist(), batch["event"].tolist(), batch["data"].tolist(), strict=True):
            last, payload, n = kinds.get(event, (-1, None, 0))
            kinds[event] = (seq, data, n + 1) if seq >= last else (last, payload, n + 1)
            if event in self.terminal:
                none = (None, None, 0)
                found = [kinds.get(e, none) for e in self.events]
                out.append((key[0], *(f[1] for f in found), *(f[2] for f in found), max(k[0] for k in kinds.values())))
                kinds = {}
        if self.kinds.exists():
            self.kinds.clear()
        for event, held in kinds.items():
            self.kinds.updateValue((event,), held)
        if not kinds:
            self.ends.clear()
        elif not self.ends.exists() or out:
            ends = int(batch["ts_ms"].min()) + self.keep_ms
            self.ends.update((ends,))
            self.handle.registerTimer(ends)
        yield pd.DataFrame(out, columns=["job_id", *(f"last_{e}" for e in self.events), *(f"n_{e}" for e in self.events), "last_seq"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.ends.exists() and self.ends.get()[0] <= expiredTimerInfo.getExpiryTimeInMs():
            self.kinds.clear()
            self.ends.clear()
        return iter(())

    def close(self) -> None:
        pass


def ended_folds(log: DataFrame, events: list[str], terminal: list[str], lateness: str = "0 seconds", keep_s: int = KEEP_S) -> DataFrame:
    """The fold of every job of a stream (job_id, seq, ts, event, data) that has ended, one row a job. Needs the RocksDB state store."""
    rows = log.withWatermark("ts", lateness).select("job_id", "seq", "ts", F.unix_millis("ts").alias("ts_ms"), "event", F.col("data").cast("string"))
    columns = [*(f"last_{e} string" for e in events), *(f"n_{e} bigint" for e in events)]
    return rows.groupBy("job_id").transformWithStateInPandas(
        EndedFolds(events, terminal, keep_s), f"job_id bigint, {', '.join(columns)}, last_seq bigint", outputMode="Append", timeMode="EventTime"
    )


class Barrier(StatefulProcessor):
    """Per job: holds what the expected sources report until the last of them has, then gives all out once, in order.

    The held rows are a list in state and go with the release. That the job is done is remembered until ``keep_s`` after its first
    report, when a job that never got ready is forgotten as well; what comes in between goes out at once.
    """

    def __init__(self, expected: list[str], keep_s: int):
        self.expected, self.keep_ms = set(expected), keep_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "seq bigint, source string, payload string")
        self.job = handle.getValueState("job", "ends_ms bigint, waiting string, released boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("seq")
        if self.job.exists():
            ends, waiting, released = self.job.get()
            waiting = set(filter(None, waiting.split("\n")))
        else:
            ends, waiting, released = int(batch["ts_ms"].min()) + self.keep_ms, set(self.expected), False
            self.handle.registerTimer(ends)
        new = list(zip(batch["seq"].tolist(), batch["source"].tolist(), batch["payload"].tolist(), strict=True))
        waiting -= {source for _, source, _ in new}
        out = []
        if released:
            out = new
        elif waiting:
            self.held.appendList(new)
        else:
            before = [tuple(r) for r in self.held.get()] if self.held.exists() else []
            out, released = sorted([*before, *new], key=lambda r: r[0]), True
            self.held.clear()
        self.job.update((ends, "\n".join(sorted(waiting)), released))
        yield pd.DataFrame([(key[0], *r, k) for k, r in enumerate(out)], columns=["job_id", "seq", "source", "payload", "place"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        self.job.clear()
        return iter(())

    def close(self) -> None:
        pass


def barrier_stream(reports: DataFrame, expected: list[str], lateness: str = "0 seconds", keep_s: int = KEEP_S) -> DataFrame:
    """Rows (job_id, seq, ts, source, payload) of a stream, held until every expected source of the job has reported.

    ``place`` counts a release's rows. Rows of other sources are left out. Needs the RocksDB state store.
    """
    rows = reports.where(F.col("source").isin(expected)).withWatermark("ts", lateness)
    rows = rows.select("job_id", "seq", "ts", F.unix_millis("ts").alias("ts_ms"), "source", "payload")
    schema = "job_id bigint, seq bigint, source string, payload string, place bigint"
    return rows.groupBy("job_id").transformWithStateInPandas(Barrier(expected, keep_s), schema, outputMode="Append", timeMode="EventTime")
