"""Request and job event logs: rate limits, folding, stages, liveness, replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewtrust.config import DEFAULTS, Settings
from reviewtrust.functions.numbers import join_text
from reviewtrust.operators.sample import numbered
from reviewtrust.session import Workspace

# The stages of a run in order, and the events that end one.
STAGES = [
    ("product_identification", "Product identified"),
    ("product_info_collected", "Product information collected"),
    ("reviews_collected", "Reviews collected"),
    ("sentiment_analyzed", "Customer sentiment analyzed"),
    ("pattern_analysis", "Checking recurring patterns"),
    ("review_reliability", "Checking review reliability"),
    ("external_research", "Searching external sources"),
    ("claim_research", "Cross-checking product claims"),
    ("evidence_synthesis", "Synthesizing evidence"),
    ("trust_score", "Calculating Trust Score"),
    ("verdict", "Generating verdict"),
]
TERMINAL_EVENTS = ["done", "error", "cancelled"]


def stage_plan() -> Column:
    """The stages as a literal array of {stage_order, stage, label}."""
    return F.array(
        *[
            F.struct(
                F.lit(i).alias("stage_order"), F.lit(key).alias("stage"), F.lit(label).alias("label")
            )
            for i, (key, label) in enumerate(STAGES, start=1)
        ]
    )


def client_identity(forwarded: Column, peer: Column, trust_proxy: bool = False) -> Column:
    """Who sent a request: the first forwarded hop only when proxies are trusted."""
    hop = F.nullif(F.trim(F.split(forwarded, ",")[0]), F.lit(""))
    known = F.nullif(F.trim(peer), F.lit(""))
    return F.coalesce(hop, known, F.lit("unknown")) if trust_proxy else F.coalesce(known, F.lit("unknown"))


def _bucket(ts: Column, window_s: int) -> Column:
    return F.floor(F.unix_seconds(ts) / window_s).cast("bigint")


def rate_limit(
    requests: DataFrame, limit: int | None = None, window_s: int | None = None, settings: Settings = DEFAULTS
) -> DataFrame:
    """Verdict of a fixed-window limit for every request (request_id, client, ts).

    Allowed rows are at most ``limit`` per (client, bucket) and found by a limited
    row_number; every later row is known to be refused from the bucket's cutoff alone, so
    a client flooding one bucket is never sorted as a whole.
    """
    limit = settings.rate_limit if limit is None else limit
    window_s = settings.rate_window_s if window_s is None else window_s
    rows = requests.select("request_id", "client", "ts").withColumn("bucket", _bucket(F.col("ts"), window_s))
    allowed = numbered(rows, ["client", "bucket"], ["ts", "request_id"], limit, "n")
    cutoff = allowed.where(F.col("n") == limit).select(
        "client", "bucket", F.struct("ts", "request_id").alias("cutoff")
    )
    refused = rows.join(cutoff, ["client", "bucket"]).where(F.struct("ts", "request_id") > F.col("cutoff"))
    wait = F.lit(window_s) - (F.unix_seconds("ts") % window_s)
    return allowed.select(
        "request_id", "client", "bucket", F.lit(True).alias("allowed"),
        (F.lit(limit) - F.col("n")).cast("bigint").alias("remaining"), F.lit(0).cast("bigint").alias("retry_after"),
    ).unionByName(
        refused.select(
            "request_id", "client", "bucket", F.lit(False).alias("allowed"),
            F.lit(0).cast("bigint").alias("remaining"), wait.cast("bigint").alias("retry_after"),
        )
    )


def window_counts(requests: DataFrame, window_s: int) -> DataFrame:
    """Requests per (client, window); the same plan serves batch and stream."""
    return requests.groupBy("client", F.window("ts", f"{window_s} seconds")).agg(F.count("*").alias("n"))


def last_events(log: DataFrame, keep: int | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """The newest events per job, as a trimmed stream would hold them."""
    keep = settings.job_events_kept if keep is None else keep
    return numbered(log, ["job_id"], [F.desc("seq")], keep, "newest")


def fold_jobs(log: DataFrame, events: list[str]) -> DataFrame:
    """One row per job: the last payload of every event type, and its count."""
    return log.groupBy("job_id").agg(
        *[
            F.max_by("data", F.when(F.col("event") == e, F.col("seq"))).alias(f"last_{e}")
            for e in events
        ],
        *[F.count_if(F.col("event") == e).alias(f"n_{e}") for e in events],
        F.max("seq").alias("last_seq"),
    )


def assemble_result(log: DataFrame) -> DataFrame:
    """Fold a job's events into one stored result, defaults where an event never came.

    Later events overwrite earlier ones: an error after done leaves status 'error'.
    """
    def last(event: str, column: Column) -> Column:
        return F.max_by(column, F.when(F.col("event") == event, F.col("seq")))

    body = F.col("data")
    ended = F.col("event").isin("done", "error")
    return log.groupBy("job_id").agg(
        F.coalesce(
            F.max_by(
                F.when(F.col("event") == "error", F.lit("error")).otherwise(
                    F.get_json_object(body, "$.status")
                ),
                F.when(ended, F.col("seq")),
            ),
            F.lit("ok"),
        ).alias("status"),
        F.max_by(F.get_json_object(body, "$.message"), F.when(ended, F.col("seq"))).alias("message"),
        F.coalesce(last("reviews", F.get_json_object(body, "$.reviews")), F.lit("[]")).alias("reviews"),
        F.coalesce(
            last("reviews", F.get_json_object(body, "$.reviews_passed").try_cast("bigint")), F.lit(0)
        ).alias("reviews_passed"),
        last("reviews", F.get_json_object(body, "$.filter_report")).alias("filter_report"),
        F.coalesce(last("reviews", F.get_json_object(body, "$.sources")), F.lit("[]")).alias("sources"),
        last("summary", F.get_json_object(body, "$.summary")).alias("summary"),
        last("summary", F.get_json_object(body, "$.llm")).alias("llm"),
        last("match", F.get_json_object(body, "$.product_match")).alias("product_match"),
        F.coalesce(last("done", F.get_json_object(body, "$.videos")), F.lit("[]")).alias("videos"),
        F.coalesce(last("done", F.get_json_object(body, "$.contributed")), F.lit("[]")).alias("contributed"),
        F.coalesce(
            last("done", F.get_json_object(body, "$.partial").try_cast("boolean")), F.lit(False)
        ).alias("partial"),
    )


def follow(log: DataFrame, timeout_s: int | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """What a reader of each job sees: events up to the first terminal one, or a timeout.

    Reading starts with the job's first event. Ordering is by ``seq``.
    """
    timeout_s = settings.job_timeout_s if timeout_s is None else timeout_s
    limit = F.make_interval(secs=F.lit(timeout_s))
    jobs = log.groupBy("job_id").agg(F.min("ts").alias("started"))
    timed = log.join(jobs, "job_id").withColumn("deadline", F.col("started") + limit)
    in_time = timed.where(F.col("ts") < F.col("deadline"))
    ends = in_time.where(F.col("event").isin(TERMINAL_EVENTS)).groupBy("job_id").agg(F.min("seq").alias("end_seq"))
    seen = in_time.join(ends, "job_id", "left").where(
        F.col("end_seq").isNull() | (F.col("seq") <= F.col("end_seq"))
    )
    message = f"analysis did not complete within {timeout_s}s (worker may be unavailable)"
    timeouts = jobs.join(ends, "job_id", "left_anti").select(
        "job_id",
        F.lit(None).cast("bigint").alias("seq"),
        (F.col("started") + limit).alias("ts"),
        F.lit("error").alias("event"),
        F.lit(message).alias("message"),
    )
    return seen.select("job_id", "seq", "ts", "event", F.lit(None).cast("string").alias("message")).unionByName(timeouts)


def inflight_leaders(requests: DataFrame, ttl_s: int | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """Times at which a request starts a new job: the first per key, then the first request
    at least ``ttl_s`` after the previous leader, and so on.

    The rule is sequential per key, but leaders are reached by pointer doubling: every
    request time knows the next time that would lead after it, pointers are squared each
    round, and the number of rounds is the logarithm of the longest chain. Neighbours are
    found inside (key, TTL-wide bucket) groups, so no task reads a whole key.
    """
    ttl = settings.inflight_ttl_s if ttl_s is None else ttl_s
    micros = ttl * 1_000_000
    space = Workspace(requests.sparkSession, "leaders")
    times = requests.select("cache_key", F.unix_micros("ts").alias("t")).distinct()
    bucket = F.floor(F.col("at") / micros).cast("bigint")
    points = times.select("cache_key", F.col("t").alias("at"), F.lit(None).cast("bigint").alias("asks"))
    asks = times.select("cache_key", (F.col("t") + micros).alias("at"), F.col("t").alias("asks"))
    rows = points.unionByName(asks).withColumn("bucket", bucket)
    # A point at the same time as a question answers it.
    downward = Window.partitionBy("cache_key", "bucket").orderBy(
        F.desc("at"), F.col("asks").asc_nulls_first()
    ).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    answer = F.min(F.when(F.col("asks").isNull(), F.col("at"))).over(downward)
    asked = rows.withColumn("near", answer).where(F.col("asks").isNotNull())
    # First request of every later bucket, one row per (key, bucket).
    firsts = rows.groupBy("cache_key", "bucket").agg(
        F.min(F.when(F.col("asks").isNull(), F.col("at"))).alias("first_at")
    )
    later = Window.partitionBy("cache_key").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    beyond = firsts.select("cache_key", "bucket", F.min("first_at").over(later).alias("far"))
    jump = space.write(
        asked.join(beyond, ["cache_key", "bucket"]).select(
            "cache_key", F.col("asks").alias("t"), F.coalesce("near", "far").alias("next_t")
        ).where(F.col("next_t").isNotNull())
    )
    reached = space.write(times.groupBy("cache_key").agg(F.min("t").alias("t")))
    while True:
        found = reached.join(jump, ["cache_key", "t"]).select("cache_key", F.col("next_t").alias("t"))
        if found.isEmpty():
            break
        reached = space.write(reached.unionByName(found).distinct())
        further = jump.select("cache_key", F.col("t").alias("next_t"), F.col("next_t").alias("after"))
        jump = space.write(
            jump.join(further, ["cache_key", "next_t"]).select("cache_key", "t", F.col("after").alias("next_t"))
        )
    return reached.select("cache_key", F.timestamp_micros("t").alias("leader_ts"))


def attach_to_inflight(requests: DataFrame, ttl_s: int | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """For each request (request_id, ts, cache_key): the leader it follows.

    Leaders of one key are at least a TTL apart, so a request's leader is in its own
    TTL-wide bucket or the one before, and each bucket has at most one: two equi-joins.
    Requests at the leader's own time attach to the lowest request id among them.
    """
    ttl = settings.inflight_ttl_s if ttl_s is None else ttl_s
    micros = ttl * 1_000_000
    leaders = inflight_leaders(requests, ttl, settings)
    first = (
        requests.join(leaders, (requests["cache_key"] == leaders["cache_key"]) & (F.col("ts") == F.col("leader_ts")))
        .groupBy(requests["cache_key"], F.col("leader_ts"))
        .agg(F.min("request_id").alias("leader_id"))
        .withColumn("b", F.floor(F.unix_micros("leader_ts") / micros).cast("bigint"))
    )
    rows = requests.select("request_id", "ts", "cache_key").withColumn(
        "b", F.floor(F.unix_micros("ts") / micros).cast("bigint")
    )
    here = first.select("cache_key", "b", F.struct("leader_ts", "leader_id").alias("here"))
    prior = first.select("cache_key", (F.col("b") + 1).alias("b"), F.struct("leader_ts", "leader_id").alias("prior"))
    joined = rows.join(here, ["cache_key", "b"], "left").join(prior, ["cache_key", "b"], "left")
    chosen = F.when(F.col("here.leader_ts") <= F.col("ts"), F.col("here")).otherwise(F.col("prior"))
    return joined.withColumn("l", chosen).select(
        "request_id",
        "cache_key",
        F.col("l.leader_id").alias("leader_id"),
        (F.col("l.leader_id") == F.col("request_id")).alias("starts_job"),
    )


def readiness(reports: DataFrame, expected: list[str]) -> DataFrame:
    """When each job had heard from every expected source (job_id, source, ts)."""
    firsts = (
        reports.where(F.col("source").isin(expected))
        .groupBy("job_id", "source")
        .agg(F.min("ts").alias("first_ts"))
    )
    return firsts.groupBy("job_id").agg(
        (F.count("*") == len(expected)).alias("ready"),
        F.when(F.count("*") == len(expected), F.max("first_ts")).alias("ready_at"),
    )


def stage_trail(log: DataFrame) -> DataFrame:
    """Latest status of every stage of every job; stages never reported are pending.

    ``log``: job_id, seq, stage, status.
    """
    latest = log.groupBy("job_id", "stage").agg(F.max_by("status", "seq").alias("status"))
    rows = (
        latest.select("job_id")
        .distinct()
        .select("job_id", F.explode(stage_plan()).alias("s"))
        .select("job_id", "s.*")
    )
    return rows.join(latest, ["job_id", "stage"], "left").withColumn(
        "status", F.coalesce("status", F.lit("pending"))
    )


def stage_details(runs: DataFrame) -> DataFrame:
    """What the counted stages of a run report, as (product_id, stage, status, detail).

    ``runs``: product_id, reviews_total, reviews_passed, clusters (null when filtering is
    off), video_sources, videos, evidence_items, concerns, conflicts.
    """
    some = F.col("reviews_total") > 0
    nothing = F.lit("No reviews to analyze")
    clusters = F.when(
        F.col("clusters") > 0, join_text(F.col("clusters"), " duplicate-phrasing cluster(s) found")
    ).otherwise("No duplicate-phrasing or submission-timing clusters found")
    found = F.when(
        F.col("videos") > 0,
        join_text(F.col("videos"), " video(s) across ", F.col("video_sources"), " platform(s)"),
    ).otherwise("no review videos found on the platforms checked")
    asked = F.col("video_sources") > 0
    evidence = F.when(
        F.col("evidence_items") > 0,
        join_text(
            F.col("evidence_items"), " evidence item(s) found (", F.col("concerns"), " concern(s), ",
            F.col("conflicts"), " claim conflict(s))",
        ),
    ).otherwise("Limited evidence synthesized")
    rows = [
        (
            "reviews_collected",
            F.lit("complete"),
            F.when(
                some,
                join_text(F.col("reviews_passed"), " of ", F.col("reviews_total"), " review(s) passed filtering"),
            ).otherwise("No reviews were found for this product"),
        ),
        (
            "sentiment_analyzed",
            F.when(some, "complete").otherwise("skipped"),
            F.when(
                some, join_text("Sentiment signals scored across ", F.col("reviews_total"), " review(s)")
            ).otherwise(nothing),
        ),
        (
            "pattern_analysis",
            F.when(some & F.col("clusters").isNotNull(), "complete").otherwise("skipped"),
            F.when(~some, nothing)
            .when(F.col("clusters").isNull(), "Pattern filtering is disabled")
            .otherwise(clusters),
        ),
        (
            "external_research",
            F.when(~asked, "skipped").when(F.col("videos") > 0, "complete").otherwise("failed"),
            F.when(~asked, "No product name was available to search video platforms.").otherwise(found),
        ),
        ("evidence_synthesis", F.lit("complete"), evidence),
    ]
    entries = F.array(
        *[F.struct(F.lit(k).alias("stage"), s.alias("status"), d.alias("detail")) for k, s, d in rows]
    )
    return runs.select("product_id", F.explode(entries).alias("e")).select("product_id", "e.*")


def log_rows(records: DataFrame) -> DataFrame:
    """Log records as one compact JSON text each, personal data scrubbed.

    Every string column is scrubbed by its name; other columns are kept as they are.
    """
    from reviewtrust.functions.redact import scrub_field

    fields = [
        (scrub_field(name, F.col(name)) if kind == "string" else F.col(name)).alias(name)
        for name, kind in records.dtypes
    ]
    return records.select(F.to_json(F.struct(*fields)).alias("line"))


def replay_stages(results: DataFrame) -> DataFrame:
    """A stored result as the stage events a live run would have sent.

    ``results``: product_id, reviews_total, reviews_passed, has_info, has_risk,
    video_sources, videos, claim_check, verdict.
    """
    def stage(key: str, status: Column, detail: Column | None = None) -> Column:
        return F.struct(
            F.lit(key).alias("stage"),
            status.alias("status"),
            (detail if detail is not None else F.lit(None).cast("string")).alias("detail"),
        )

    def done_if(condition: Column, otherwise: str) -> Column:
        return F.when(F.coalesce(condition, F.lit(False)), "complete").otherwise(otherwise)

    some = F.col("reviews_total") > 0
    verdict = F.coalesce(F.length("verdict") > 0, F.lit(False))
    info = F.when(F.col("has_info"), "Image and/or description found").otherwise(
        "No image or description found"
    )
    asked = F.col("video_sources") > 0
    events = F.array(
        stage("product_identification", F.lit("complete"), F.lit("from cached analysis")),
        stage("product_info_collected", F.lit("complete"), info),
        stage(
            "reviews_collected",
            done_if(F.col("reviews_passed") > 0, "failed"),
            join_text(F.col("reviews_passed"), " of ", F.col("reviews_total"), " review(s) passed filtering"),
        ),
        stage("sentiment_analyzed", done_if(some, "skipped")),
        stage("pattern_analysis", done_if(some, "skipped")),
        stage("review_reliability", done_if(F.col("has_risk"), "skipped")),
        stage(
            "external_research",
            F.when(~asked, "skipped").otherwise(done_if(F.col("videos") > 0, "failed")),
            F.when(~asked, F.lit("No product name to search video platforms with")),
        ),
        stage("claim_research", done_if(F.length("claim_check") > 0, "skipped")),
        stage("evidence_synthesis", done_if(verdict, "failed")),
        stage("trust_score", done_if(verdict, "failed")),
        stage("verdict", done_if(verdict, "failed")),
    )
    return results.select("product_id", F.posexplode(events).alias("pos", "e")).select(
        "product_id", (F.col("pos") + 1).alias("stage_order"), "e.stage", "e.status", "e.detail"
    )


def worker_liveness(beats: DataFrame, as_of: Column, ttl_s: int | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """Last heartbeat per worker and whether it is recent enough."""
    ttl_s = settings.worker_ttl_s if ttl_s is None else ttl_s
    rows = beats.groupBy("worker_id").agg(F.max("ts").alias("last_beat"))
    return rows.withColumn(
        "alive", F.col("last_beat") > as_of - F.make_interval(secs=F.lit(ttl_s))
    )


def latest_state(marks: DataFrame, as_of: Column, ttl_s: int | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """Latest state per job, while it is still kept (job_id, ts, seq, state)."""
    ttl_s = settings.job_result_ttl_s if ttl_s is None else ttl_s
    rows = marks.groupBy("job_id").agg(
        F.max_by("state", F.struct("ts", "seq")).alias("state"), F.max("ts").alias("updated_at")
    )
    return rows.where(F.col("updated_at") > as_of - F.make_interval(secs=F.lit(ttl_s)))


def queue_stats(states: DataFrame, workers: DataFrame) -> DataFrame:
    """Queued jobs and live workers."""
    both = states.select((F.col("state") == "queued").alias("queued"), F.lit(False).alias("alive")).unionByName(
        workers.select(F.lit(False).alias("queued"), "alive")
    )
    return both.agg(F.count_if("queued").alias("depth"), F.count_if("alive").alias("workers"))


LATENCY_BUCKET_MS = 65_536


def event_latency(log: DataFrame) -> DataFrame:
    """Milliseconds from a job's first event to the first of each kind: median and 95th.

    Exact, without sorting an event's waits in one task: waits are counted per millisecond and per bucket of
    ``LATENCY_BUCKET_MS``; running counts over an event's buckets (40,000 for a month) name the few buckets that hold the
    wanted ranks, and only the milliseconds of those are put in order.
    """
    firsts = log.groupBy("job_id", "event").agg(F.min("ts").alias("first_ts"))
    started = firsts.groupBy("job_id").agg(F.min("first_ts").alias("started"))
    waits = firsts.join(started, "job_id").select(
        "event", (F.unix_millis("first_ts") - F.unix_millis("started")).alias("ms")
    )
    counted = (
        waits.groupBy("event", "ms")
        .agg(F.count("*").alias("n"))
        .withColumn("bucket", F.floor(F.col("ms") / LATENCY_BUCKET_MS))
    )
    in_event = Window.partitionBy("event")
    buckets = (
        counted.groupBy("event", "bucket")
        .agg(F.sum("n").alias("n"))
        .withColumns({"upto": F.sum("n").over(in_event.orderBy("bucket")), "jobs": F.sum("n").over(in_event)})
    )
    place = {q: (F.col("jobs") - 1) * F.lit(q) for q in (0.5, 0.95)}
    ranks = F.array(*[r.cast("bigint") for p in place.values() for r in (F.floor(p), F.ceil(p))])
    held = buckets.select("event", "bucket", "jobs", (F.col("upto") - F.col("n")).alias("below"), "upto", F.posexplode(ranks).alias("which", "rank"))
    wanted = held.where((F.col("rank") >= F.col("below")) & (F.col("rank") < F.col("upto"))).drop("upto")
    in_bucket = Window.partitionBy("event", "which").orderBy("ms")
    found = (
        counted.join(wanted, ["event", "bucket"])
        .withColumn("upto", F.col("below") + F.sum("n").over(in_bucket))
        .where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
        .groupBy("event")
        .agg(F.max("jobs").alias("jobs"), *[F.max(F.when(F.col("which") == i, F.col("ms"))).alias(f"r{i}") for i in range(4)])
    )

    def between(low: str, high: str, at: Column) -> Column:
        return F.col(low) + (F.col(high) - F.col(low)) * (at - F.floor(at))

    return found.select(
        "event", "jobs", between("r0", "r1", place[0.5]).alias("median_ms"), between("r2", "r3", place[0.95]).alias("p95_ms")
    )


def event_type_counts(logs: DataFrame) -> DataFrame:
    return logs.groupBy("event_type").agg(F.count("*").alias("n"))


def token_costs(reports: DataFrame, prices: DataFrame) -> DataFrame:
    """Tokens and cost per model; ``prices`` has dollars per million tokens."""
    used = reports.groupBy("model").agg(
        F.count("*").alias("calls"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens", "cached_tokens")],
    )
    cost = (
        F.col("input_tokens") * F.col("input_price") + F.col("output_tokens") * F.col("output_price")
    ) / 1e6
    return used.join(prices, "model", "left").select(
        "model", "calls", "input_tokens", "output_tokens", "cached_tokens", cost.alias("cost_usd")
    )


def framed(log: DataFrame) -> DataFrame:
    """Events as text frames: compact JSON behind ``data:``."""
    body = F.to_json(F.struct(*[F.col(c) for c in log.columns]))
    return log.select("job_id", "seq", F.concat(F.lit("data: "), body, F.lit("\n\n")).alias("frame"))
