"""Streams over stored events must give what the batch operators give."""

import time

import pytest
from pyspark.sql import functions as F

from reviewtrust.operators import events as E
from reviewtrust.sources import tables as T
from reviewtrust.streaming import jobs as SJ
from reviewtrust.streaming import requests as SR


def stream_of(spark, df, tmp_path, files=3):
    """The rows as one file per time slice, written oldest first."""
    path = str(tmp_path / "in")
    first, last = df.agg(F.min("ts"), F.max("ts")).first()
    for i in range(files):
        start, end = first + (last - first) / files * i, first + (last - first) / files * (i + 1)
        upper = F.col("ts") <= end if i == files - 1 else F.col("ts") < end
        df.where((F.col("ts") >= start) & upper).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def collect(stream, mode, tmp_path, name):
    q = (
        stream.writeStream.format("memory").queryName(name).outputMode(mode)
        .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return stream.sparkSession.table(name)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_fold_matches_batch(spark, small, tmp_path):
    log = T.event_log(spark, small)
    kinds = ["click", "done", "error"]
    got = collect(SJ.fold_stream(stream_of(spark, log, tmp_path), kinds), "complete", tmp_path, "fold")
    assert rows(got) == rows(E.fold_jobs(log, kinds))


def test_readiness_matches_batch(spark, small, tmp_path):
    log = T.event_log(spark, small).withColumnRenamed("event", "source")
    got = collect(SJ.readiness_stream(stream_of(spark, log, tmp_path), ["signup", "error"]), "complete", tmp_path, "ready")
    assert rows(got) == rows(E.readiness(log, ["signup", "error"]))


def test_window_counts_match_batch(spark, small, tmp_path):
    reqs = T.requests(spark, small)
    stream = SR.rate_windows(stream_of(spark, reqs, tmp_path), 3, 86400)
    got = collect(stream, "update", tmp_path, "windows").groupBy("client", "window").agg(F.max("n").alias("n"))
    want = E.window_counts(reqs, 86400)
    assert rows(got.select("client", "window.start", "n")) == rows(want.select("client", "window.start", "n"))


@pytest.mark.parametrize("ttl", [3600, 36000])
def test_inflight_matches_batch(spark, small, tmp_path, ttl):
    reqs = T.requests(spark, small)
    got = collect(SR.inflight_stream(stream_of(spark, reqs, tmp_path), ttl), "append", tmp_path, f"inflight{ttl}")
    want = E.attach_to_inflight(reqs, ttl_s=ttl)
    cols = ["request_id", "cache_key", "leader_id", "starts_job"]
    assert rows(got.select(cols)) == rows(want.select(cols))


def test_follow_matches_batch(spark, small, tmp_path):
    log = T.event_log(spark, small).select("job_id", "seq", "ts", "event")
    got = collect(SR.follow_stream(stream_of(spark, log, tmp_path), 3600, E.TERMINAL_EVENTS), "append", tmp_path, "followed")
    want = E.follow(log, timeout_s=3600)
    delivered = got.where("seq is not null").select("job_id", "seq", "event")
    assert rows(delivered) == rows(want.where("seq is not null").select("job_id", "seq", "event"))
    # The stream ends before the last deadlines pass, so it may report fewer timeouts, never others.
    late = set(rows(got.where("seq is null").select("job_id", "message")))
    assert late <= set(rows(want.where("seq is null").select("job_id", "message")))
    assert late


def test_inflight_state_ends(spark, tmp_path):
    early = spark.range(200).selectExpr("id as request_id", "timestamp'2024-01-01' + make_interval(0,0,0,0,0,0,id) as ts", "concat('k', id) as cache_key")
    late = spark.range(3).selectExpr("500 + id as request_id", "timestamp'2024-01-03' + make_interval(0,0,0,id) as ts", "'z' as cache_key")
    stream = SR.inflight_stream(stream_of(spark, early.unionByName(late), tmp_path, files=4), 60)
    query = (
        stream.writeStream.format("memory").queryName("ends").option("checkpointLocation", str(tmp_path / "ck"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert spark.table("ends").where("starts_job").count() == 203
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] < 20


def state_rows(stream, tmp_path, name):
    query = (
        stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "ck"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query.lastProgress["stateOperators"][0]["numRowsTotal"]


def test_rate_verdicts_match_batch_and_state_ends(spark, small, tmp_path):
    reqs = T.requests(spark, small).select("request_id", "ts", "client")
    last = reqs.agg(F.max("ts")).first()[0]
    # A request long after the others lets the watermark pass every window.
    after = spark.createDataFrame([(10**9, last, "late")], "request_id bigint, ts timestamp, client string").withColumn("ts", F.col("ts") + F.expr("interval 9 days"))
    stream = SR.rate_limit_stream(stream_of(spark, reqs.unionByName(after), tmp_path, files=5), 2, 86400, "1 day")
    left = state_rows(stream, tmp_path, "verdicts")
    got = spark.table("verdicts").where("client <> 'late'").select("request_id", "client", "bucket", "allowed", "remaining", "retry_after")
    want = E.rate_limit(reqs, 2, 86400)
    assert rows(got) == rows(want) and want.where("not allowed").count() > 0
    assert left <= 4


def _ending_log(spark, small):
    """Each job's events up to its first terminal one."""
    log = T.event_log(spark, small).select("job_id", "seq", "ts", "event", F.col("data").cast("string").alias("data"))
    end = log.where("event = 'done'").groupBy("job_id").agg(F.min("ts").alias("end"))
    return log.join(end, "job_id", "left").where("end is null or ts <= end").drop("end")


def test_ended_folds_match_batch_and_leave_no_state(spark, small, tmp_path):
    kinds = ["click", "done", "error"]
    log = _ending_log(spark, small)
    ended = log.where("event = 'done'").select("job_id").distinct()
    stream = SJ.ended_folds(stream_of(spark, log.join(ended, "job_id"), tmp_path), kinds, ["done"])
    left = state_rows(stream, tmp_path, "folds")
    want = E.fold_jobs(log.join(ended, "job_id"), kinds)
    assert rows(spark.table("folds").select(want.columns)) == rows(want) and want.count() > 5
    assert left == 0


def test_barrier_releases_a_job_once_and_in_order(spark, small, tmp_path):
    reports = _ending_log(spark, small).withColumnsRenamed({"event": "source", "data": "payload"})
    expected = ["click", "done"]
    stream = SJ.barrier_stream(stream_of(spark, reports, tmp_path, files=4), expected)
    collect(stream, "append", tmp_path, "barrier")
    ready = E.readiness(reports, expected).where("ready").select("job_id")
    mine = reports.where(F.col("source").isin(expected)).join(ready, "job_id").select("job_id", "seq", "source", "payload")
    got = spark.table("barrier")
    assert rows(got.select("job_id", "seq", "source", "payload")) == rows(mine) and ready.count() >= 5
    in_order = {}
    for r in sorted(got.collect(), key=lambda r: (r["job_id"], r["place"])):
        in_order.setdefault(r["job_id"], []).append(r["seq"])
    assert all(s == sorted(s) for s in in_order.values())
