"""Streaming forms of the request operators: window counts and in-flight leaders."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from reviewtrust.operators.events import window_counts


def rate_windows(requests: DataFrame, limit: int, window_s: int, lateness: str = "10 minutes") -> DataFrame:
    """Requests per (client, window) and how many of them were over the limit.

    State is one counter per open window; the watermark closes windows.
    """
    counted = window_counts(requests.withWatermark("ts", lateness), window_s)
    return counted.withColumn("refused", F.greatest(F.col("n") - limit, F.lit(0)))


VERDICTS = "request_id bigint, client string, bucket bigint, allowed boolean, remaining bigint, retry_after bigint"


class WindowLimits(StatefulProcessor):
    """Per client: a counter for each open window; a window's counter goes when the watermark passes its end."""

    def __init__(self, limit: int, window_s: int):
        self.limit, self.window_s = limit, window_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "bucket bigint", "n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["ts_us", "request_id"])
        seconds = batch["ts_us"] // 1_000_000
        bucket = seconds // self.window_s
        before = {}
        for b in map(int, bucket.unique()):
            before[b] = self.seen.getValue((b,))[0] if self.seen.containsKey((b,)) else 0
            if not before[b]:
                self.handle.registerTimer((b + 1) * self.window_s * 1000)
        n = bucket.map(before) + bucket.groupby(bucket).cumcount() + 1
        for b, last in n.groupby(bucket).max().items():
            self.seen.updateValue((int(b),), (int(last),))
        allowed = n <= self.limit
        wait = (self.window_s - seconds % self.window_s).where(~allowed, 0)
        yield pd.DataFrame(
            {
                "request_id": batch["request_id"], "client": key[0], "bucket": bucket, "allowed": allowed,
                "remaining": (self.limit - n).clip(lower=0), "retry_after": wait,
            }
        )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ended = expiredTimerInfo.getExpiryTimeInMs() // 1000 // self.window_s
        for (bucket,) in list(self.seen.keys()):
            if bucket < ended:
                self.seen.removeKey((bucket,))
        return iter(())

    def close(self) -> None:
        pass


def rate_limit_stream(requests: DataFrame, limit: int, window_s: int, lateness: str = "10 minutes") -> DataFrame:
    """The verdict of :func:`operators.events.rate_limit` for every request of a stream (request_id, ts, client).

    Requests of one micro-batch are taken in time order; one that is late counts when it comes. Needs the RocksDB state store.
    """
    rows = requests.withWatermark("ts", lateness).select("client", "request_id", "ts", F.unix_micros("ts").alias("ts_us"))
    return rows.groupBy("client").transformWithStateInPandas(
        WindowLimits(limit, window_s), VERDICTS, outputMode="Append", timeMode="EventTime"
    )


LEADERS = "cache_key string, request_id bigint, leader_id bigint, starts_job boolean"


class InflightLeaders(StatefulProcessor):
    """Per key: the running leader and when its claim ends.

    State is one row per key, however many requests follow it, and goes when the watermark passes
    the claim's end. Requests of one batch are taken in time order.
    """

    def __init__(self, ttl_s: int):
        self.ttl_us = ttl_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.claim = handle.getValueState("claim", "leader_id bigint, ends_us bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["ts_us", "request_id"])
        leader, ends = self.claim.get() if self.claim.exists() else (None, None)
        out = []
        for request_id, ts_us in zip(batch["request_id"], batch["ts_us"]):
            starts = leader is None or ts_us >= ends
            if starts:
                leader, ends = int(request_id), int(ts_us) + self.ttl_us
            out.append((key[0], int(request_id), leader, starts))
        self.claim.update((leader, ends))
        if any(starts for *_, starts in out):
            self.handle.registerTimer(-(-ends // 1000))
        yield pd.DataFrame(out, columns=["cache_key", "request_id", "leader_id", "starts_job"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.claim.exists() and self.claim.get()[1] <= expiredTimerInfo.getExpiryTimeInMs() * 1000:
            self.claim.clear()
        return iter(())

    def close(self) -> None:
        pass


def inflight_stream(requests: DataFrame, ttl_s: int, lateness: str = "10 minutes") -> DataFrame:
    """Leader of every request of a stream (request_id, ts, cache_key) that is at most ``lateness`` late.

    Needs the RocksDB state store. A key's requests of one micro-batch are read by one
    task; bound the batch with the source's own limits (maxFilesPerTrigger and the like).
    """
    rows = requests.withWatermark("ts", lateness).select(
        "cache_key", "request_id", "ts", F.unix_micros("ts").alias("ts_us")
    )
    return rows.groupBy("cache_key").transformWithStateInPandas(
        InflightLeaders(ttl_s), LEADERS, outputMode="Append", timeMode="EventTime"
    )


FOLLOWED = "job_id bigint, seq bigint, event string, message string"


class FollowJobs(StatefulProcessor):
    """Deliver a job's events until a terminal one; report a timeout if none comes.

    A job's state goes ``keep_s`` after its deadline: no event may come later than that, or it counts as a new job's.
    """

    def __init__(self, timeout_s: int, terminal: list[str], keep_s: int):
        self.timeout_ms, self.keep_ms = timeout_s * 1000, keep_s * 1000
        self.terminal = set(terminal)
        self.message = (
            f"analysis did not complete within {timeout_s}s (worker may be unavailable)"
        )

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "deadline_ms bigint, ended boolean")

    def handleInputRows(self, key, rows, timerValues):
        batch = pd.concat(list(rows)).sort_values("seq")
        if self.job.exists():
            deadline, ended = self.job.get()
        else:
            deadline, ended = int(batch["ts_ms"].min()) + self.timeout_ms, False
            self.handle.registerTimer(deadline)
        out = []
        for seq, ts_ms, event in zip(batch["seq"], batch["ts_ms"], batch["event"]):
            if ended or ts_ms >= deadline:
                continue
            out.append((key[0], int(seq), event, None))
            ended = event in self.terminal
        self.job.update((deadline, ended))
        yield pd.DataFrame(out, columns=["job_id", "seq", "event", "message"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        deadline, ended = self.job.get()
        if expiredTimerInfo.getExpiryTimeInMs() >= deadline + self.keep_ms:
            self.job.clear()
        else:
            self.job.update((deadline, True))
            self.handle.registerTimer(deadline + self.keep_ms)
        late = [] if ended else [(key[0], None, "error", self.message)]
        yield pd.DataFrame(late, columns=["job_id", "seq", "event", "message"]).astype({"seq": "Int64"})

    def close(self) -> None:
        pass


def follow_stream(
    log: DataFrame, timeout_s: int, terminal: list[str], lateness: str = "0 seconds", keep_s: int = 30 * 86400
) -> DataFrame:
    """Followed events of a stream of (job_id, seq, ts, event), by event time.

    A job times out when the watermark passes its deadline, and is forgotten ``keep_s`` later.
    """
    rows = log.withWatermark("ts", lateness).select(
        "job_id", "seq", "ts", F.unix_millis("ts").alias("ts_ms"), "event"
    )
    return rows.groupBy("job_id").transformWithStateInPandas(
        FollowJobs(timeout_s, terminal, keep_s), FOLLOWED, outputMode="Append", timeMode="EventTime"
    )
