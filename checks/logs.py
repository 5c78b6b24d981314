"""Registered queries: ingest, results, event logs, redaction, display, parsing."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from checks.core import QUERIES, SQL, _verdicts, long, query, r6  # noqa: F401
from checks.core_sql import FRAGMENTS, array, compose, quote, squeeze
from reviewtrust.functions import display as DI
from reviewtrust.functions import parse as PA
from reviewtrust.functions import redact as RE
from reviewtrust.operators import events as E
from reviewtrust.operators import ingest as IN
from reviewtrust.operators import results as RS
from reviewtrust.operators import videos as VI
from reviewtrust.sources import tables as T

# ------------------------------------------------------------------ ingest

FRAGMENTS["fprint"] = (
    ["rv"],
    f"select *, lower(trim(author)) || '|' || {squeeze('lower(t)')} as k from (select *, {squeeze('text')} as t from rv) where length(t) >= 8",
)


@query("cleaned_reviews", compose(["fprint"], "select review_id, t as text from fprint"))
def cleaned_reviews(spark, sf):
    return IN.clean(T.reviews(spark, sf)).select("review_id", "text")


@query(
    "deduped_reviews",
    compose(["fprint"], "select product_id, source, min(review_id) as review_id from fprint group by product_id, source, k"),
)
def deduped_reviews(spark, sf):
    return IN.first_seen(IN.clean(T.reviews(spark, sf))).select("product_id", "source", "review_id")


@query(
    "capped_events",
    compose(
        [],
        """select event_id as review_id, source, product_id, n > 150 as truncated from (
select event_id, event_type as source, user_id % 7 as product_id, row_number() over (partition by event_type, user_id % 7 order by event_id) as rn,
count(*) over (partition by event_type, user_id % 7) as n from events) where rn <= 150""",
    ),
)
def capped_events(spark, sf):
    rows = T.events(spark, sf).select(
        F.col("event_id").alias("review_id"), F.col("event_type").alias("source"), (F.col("user_id") % 7).alias("product_id")
    )
    return IN.capped(rows)


@query(
    "union_of_sources",
    compose(["rv", "vid"], "select 'reviews' as kind, source, count(*) as n from rv group by 1, 2 union all select 'videos', source, count(*) from vid group by 1, 2"),
)
def union_of_sources(spark, sf):
    both = IN.collect_sources(
        T.reviews(spark, sf).select(F.lit("reviews").alias("kind"), "source", "rating"),
        T.videos(spark, sf).select(F.lit("videos").alias("kind"), "source"),
    )
    return both.groupBy("kind", "source").agg(F.count("*").alias("n"))


FRAGMENTS["pg"] = (
    ["rv"],
    f"""select product_id % 3 as listing_id, review_id % 20 as page_no, lower(trim(author)) || '|' || {squeeze('lower(t)')} as k
from (select *, {squeeze('text')} as t from rv) where length(t) >= 8""",
)
FRAGMENTS["pgnew"] = (
    ["pg"],
    """select listing_id, page_no, count(*) as added from (select listing_id, k, min(page_no) as page_no from pg where page_no <= 12 group by 1, 2) group by 1, 2""",
)
FRAGMENTS["pgrows"] = (
    ["pg", "pgnew"],
    """select p.listing_id, p.page_no, coalesce(n.added, 0) as added, coalesce(n.added, 0) > 0 and not (p.listing_id = 1 and p.page_no = 4) as good
from (select distinct listing_id, page_no from pg where page_no <= 12) p left join pgnew n using (listing_id, page_no)""",
)


@query(
    "crawl_stop",
    compose(
        ["pgrows"],
        """select listing_id, page_no, op and before < 150 as fetched, case when op and before < 150 and run then least(added, 150 - before) else 0 end as reviews_added,
op and before < 150 and run and before + added > 150 as truncated from (
select *, cast(coalesce(sum(added) over (partition by listing_id order by page_no rows between unbounded preceding and 1 preceding), 0) as bigint) as before,
  coalesce(bool_and(good) over (partition by listing_id order by page_no rows between unbounded preceding and 1 preceding), true) as op,
  bool_and(good) over (partition by listing_id order by page_no rows between unbounded preceding and current row) as run from pgrows)""",
    ),
)
def crawl_stop(spark, sf):
    rows = T.reviews(spark, sf).select(
        (F.col("product_id") % 3).alias("listing_id"), (F.col("review_id") % 20).alias("page_no"), F.col("review_id").alias("pos"), "author", "text"
    )
    pages = rows.select("listing_id", "page_no").distinct().select(
        "listing_id", "page_no", F.lit(True).alias("ok"), ((F.col("listing_id") == 1) & (F.col("page_no") == 4)).alias("blocked")
    )
    return IN.reviews_until_stop(pages, rows).withColumn("reviews_added", long("reviews_added"))


# ------------------------------------------------------------------ parsing and text rules

_BOIL = ["Read more. Helpful | Report. ", "12 people found this helpful. ", "Verified Purchase | ", ""]


def noisy_reviews(spark, sf):
    pick = F.element_at(F.array(*[F.lit(b) for b in _BOIL]), (F.col("review_id") % 4 + 1).cast("int"))
    return T.reviews(spark, sf).select("review_id", F.concat(pick, "text").alias("text"))


FRAGMENTS["noisy"] = (["rv"], f"select review_id, ({array(_BOIL)})[cast(review_id % 4 as int) + 1] || text as text from rv")
_B1 = squeeze(f"regexp_replace(text, {quote('(?i)' + PA.BOILERPLATE_PATTERN)}, ' ', 'g')")
_B2 = f"trim(regexp_replace(regexp_replace({_B1}, '(?:\\s*[.·|,;:]\\s*){{2,}}', '. ', 'g'), '^[\\s.·|,;:\\-–—]+', ''))"


@query(
    "boilerplate",
    compose(
        ["noisy"],
        f"""select review_id, {_B2} as text, case when regexp_matches(text, {quote('(?i)' + PA.VERIFIED_PATTERN)}) then true end as verified,
try_cast(regexp_replace(regexp_extract(text, {quote('(?i)' + PA.HELPFUL_PATTERN)}, 1), '[,.]', '', 'g') as int) as votes from noisy""",
    ),
)
def boilerplate(spark, sf):
    t = F.col("text")
    return noisy_reviews(spark, sf).select(
        "review_id", PA.strip_boilerplate(t).alias("text"), PA.verified_badge(t).alias("verified"), PA.helpful_votes(t).alias("votes")
    )


@query(
    "normalized_ratings",
    compose(
        [],
        """select p_partkey, case when v > 0 and v * (5.0::double / s) <= 5.5 then round_even(least(v * (5.0::double / s), 5.0), 2) end as rating from (
select p_partkey, case p_partkey % 4 when 0 then (p_size % 6)::double when 1 then p_size::double when 2 then (p_size / 10.0)::double else p_size::double end as v,
 (case p_partkey % 4 when 0 then 5 when 1 then 100 when 2 then 10 else 5 end)::double as s from part)""",
    ),
)
def normalized_ratings(spark, sf):
    size = F.col("p_size").cast("string")
    key = F.col("p_partkey")
    printed = (
        F.when(key % 4 == 0, F.concat((F.col("p_size") % 6).cast("string"), F.lit(" out of 5 stars")))
        .when(key % 4 == 1, F.concat(size, F.lit("%")))
        .when(key % 4 == 2, F.concat(F.regexp_replace(F.format_number(F.col("p_size") / 10.0, 1), r"\.", ","), F.lit(" / 10")))
        .otherwise(size)
    )
    return T.read_table(spark, sf, "part").select("p_partkey", PA.normalize_rating(printed).alias("rating"))


@query(
    "parsed_dates",
    compose(
        ["rv"],
        """select review_id, cast(case review_id % 5 when 0 then date '2024-06-15' - cast((review_id % 9) * 7 as int) when 1 then d when 2 then d when 3 then d else null end as varchar) as parsed
from (select review_id, date '2024-01-01' + cast(review_id % 300 as int) as d from rv)""",
    ),
)
def parsed_dates(spark, sf):
    rid = F.col("review_id")
    d = F.date_add(F.to_date(F.lit("2024-01-01")), (rid % 300).cast("int"))
    printed = (
        F.when(rid % 5 == 0, F.concat((rid % 9).cast("string"), F.lit(" weeks ago")))
        .when(rid % 5 == 1, F.concat(F.lit("Reviewed in the United States on "), F.date_format(d, "MMMM d, yyyy")))
        .when(rid % 5 == 2, F.date_format(d, "yyyy-MM-dd"))
        .when(rid % 5 == 3, F.concat(F.lit("Posted "), F.date_format(d, "d MMM yyyy")))
        .otherwise(F.lit("4 stars rating 2024"))
    )
    return T.reviews(spark, sf).select("review_id", PA.parse_date(printed, datetime.date(2024, 6, 15)).cast("string").alias("parsed"))


@query(
    "iso_durations",
    compose([], "select p_partkey, case when p_size * 60 + p_partkey % 60 + (p_partkey % 3) * 3600 > 0 and p_partkey % 13 <> 0 then cast(p_size * 60 + p_partkey % 60 + (p_partkey % 3) * 3600 as bigint) end as seconds from part"),
)
def iso_durations(spark, sf):
    key = F.col("p_partkey")
    text = F.concat(
        F.when(key % 13 == 0, "X").otherwise("P"), F.lit("T"), F.when(key % 3 > 0, F.concat((key % 3).cast("string"), F.lit("H"))).otherwise(""),
        F.col("p_size").cast("string"), F.lit("M"), (key % 60).cast("string"), F.lit("S"),
    )
    return T.read_table(spark, sf, "part").select("p_partkey", VI.iso_duration_seconds(text).alias("seconds"))


_ASCII = "regexp_replace(text, '[^\\x00-\\x7F\\p{Z}\\p{P}\\p{S}]', 'ñ', 'g')"


@query(
    "scrubbed_text",
    compose(
        [],
        """select doc_id, case when length(m) > 200 then left(m, 200) || '…' else m end as scrubbed from (
select doc_id, regexp_replace(regexp_replace(text, '\\b[\\w.+-]+@[\\w-]+\\.[\\w.-]+\\b', '[email]', 'g'), '\\b\\d{9,}\\b', '[digits]', 'g') as m from documents)""",
    ),
)
def scrubbed_text(spark, sf):
    return T.read_table(spark, sf, "documents").select("doc_id", RE.scrub_text(F.col("text")).alias("scrubbed"))


# ------------------------------------------------------------------ stored results

AS_OF = "2024-01-20 00:00:00"


def result_log(spark, sf):
    """One stored analysis per event; a tenth are thin results."""
    rows = T.events(spark, sf).select(
        F.concat_ws("-", F.lit("k"), (F.col("user_id") % 60).cast("string")).alias("cache_key"),
        F.col("event_id").alias("seq"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("name "), F.col("event_id").cast("string"))).alias("product_name"),
        F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("https://x/"), F.col("event_id").cast("string"))).alias("canonical_url"),
        F.when(F.col("event_id") % 10 == 0, "not_enough_data").otherwise("ok").alias("status"),
        F.col("props").alias("payload"), (F.col("event_id") % 50).alias("review_count"), F.col("ts").alias("created_at"),
    )
    return RS.put_rows(rows)


FRAGMENTS["rlog"] = (
    [],
    """select 'k-' || cast(user_id % 60 as varchar) as cache_key, event_id as seq, case when event_id % 3 = 0 then 'name ' || cast(event_id as varchar) end as product_name,
  case when event_id % 5 = 0 then 'https://x/' || cast(event_id as varchar) end as canonical_url, case when event_id % 10 = 0 then 'not_enough_data' else 'ok' end as status,
  props as payload, event_id % 50 as review_count, ts as created_at, ts + case when event_id % 10 = 0 then interval 1 hour else interval 24 hour end as expires_at from events""",
)
FRAGMENTS["rcur"] = (
    ["rlog"],
    """select cache_key, (list(product_name order by created_at desc, seq desc) filter (product_name is not null))[1] as product_name,
  (list(canonical_url order by created_at desc, seq desc) filter (canonical_url is not null))[1] as canonical_url,
  (list(status order by created_at desc, seq desc))[1] as status, (list(payload order by created_at desc, seq desc))[1] as payload,
  (list(review_count order by created_at desc, seq desc))[1] as review_count, max(created_at) as created_at,
  (list(expires_at order by created_at desc, seq desc))[1] as expires_at, count(*) as writes from rlog group by 1""",
)
_TS = "cast(epoch_us({}) as bigint)"


@query(
    "current_results",
    compose(["rcur"], f"select cache_key, product_name, canonical_url, status, payload, review_count, {_TS.format('created_at')} as created_us, {_TS.format('expires_at')} as expires_us, writes from rcur"),
)
def current_results(spark, sf):
    return RS.current(result_log(spark, sf)).select(
        "cache_key", "product_name", "canonical_url", "status", "payload", "review_count",
        F.unix_micros("created_at").alias("created_us"), F.unix_micros("expires_at").alias("expires_us"), "writes",
    )


FRAGMENTS["reqs"] = ([], "select event_id as request_id, ts, 'k-' || cast((event_id * 7) % 80 as varchar) as cache_key from events")


def lookups(spark, sf):
    requests = T.events(spark, sf).select(
        F.col("event_id").alias("request_id"), "ts", F.concat(F.lit("k-"), ((F.col("event_id") * 7) % 80).cast("string")).alias("cache_key")
    )
    early = result_log(spark, sf).where(F.col("created_at") <= F.to_timestamp(F.lit(AS_OF)))
    return RS.lookup(requests, RS.current(early)), RS.current(early)


FRAGMENTS["rcur2"] = (["rlog"], FRAGMENTS["rcur"][1].replace("from rlog", f"from rlog where created_at <= timestamp '{AS_OF}'"))
FRAGMENTS["look"] = (
    ["reqs", "rcur2"],
    """select r.request_id, r.cache_key, coalesce(c.created_at <= r.ts and c.expires_at > r.ts, false) as hit,
  epoch(date_trunc('second', r.ts)) - epoch(date_trunc('second', c.created_at)) as age, c.status from reqs r left join rcur2 c using (cache_key)""",
)


@query(
    "cached_lookups",
    compose(["look"], "select request_id, cache_key, hit, case when hit then cast(age as bigint) end as age_seconds, case when hit then status end as cached_status from look"),
)
def cached_lookups(spark, sf):
    return lookups(spark, sf)[0]


@query(
    "store_stats",
    compose(["look", "rcur2"], f"select count(*) as entries, count(*) filter (expires_at > timestamp '{AS_OF}') as live, (select count(*) from look where hit) as hits_served from rcur2"),
)
def store_stats(spark, sf):
    seen, snapshot = lookups(spark, sf)
    return RS.store_stats(snapshot, RS.hit_counts(seen), F.to_timestamp(F.lit(AS_OF)))


@query(
    "live_results",
    compose(["rcur2"], f"select cache_key from rcur2 where expires_at > timestamp '{AS_OF}' and cache_key not in (select 'k-' || cast(p_partkey as varchar) from part where p_partkey < 9)"),
)
def live_results(spark, sf):
    _, snapshot = lookups(spark, sf)
    dropped = T.read_table(spark, sf, "part").where("p_partkey < 9").select(F.concat(F.lit("k-"), F.col("p_partkey").cast("string")).alias("cache_key"))
    return RS.invalidate(RS.purge(snapshot, F.to_timestamp(F.lit(AS_OF))), dropped).select("cache_key")


# ------------------------------------------------------------------ request and job logs

FRAGMENTS["rq"] = ([], "select event_id as request_id, ts, cast(user_id as varchar) as client, event_type || ':' || cast(user_id % 10 as varchar) as cache_key from events")


@query(
    "rate_limit",
    compose(
        ["rq"],
        """select request_id, client, bucket, n <= 3 as allowed, cast(greatest(0, 3 - n) as bigint) as remaining,
case when n <= 3 then 0 else 86400 - cast(floor(epoch(ts)) as bigint) % 86400 end as retry_after from (
select *, row_number() over (partition by client, bucket order by ts, request_id) as n from (select *, cast(floor(epoch(ts)) as bigint) // 86400 as bucket from rq))""",
    ),
)
def rate_limit(spark, sf):
    return E.rate_limit(T.requests(spark, sf), limit=3, window_s=86400)


@query(
    "window_counts",
    compose(["rq"], "select client, cast(floor(epoch(ts)) as bigint) // 3600 * 3600 as window_start, count(*) as n from rq group by 1, 2"),
)
def window_counts(spark, sf):
    return E.window_counts(T.requests(spark, sf), 3600).select("client", F.unix_seconds("window.start").alias("window_start"), "n")


FRAGMENTS["lead0"] = (["rq"], "select cache_key, min(ts) as t from rq group by 1")
FRAGMENTS["chain"] = (
    ["lead0", "rq"],
    """select cache_key, t from lead0 union all
select c.cache_key, (select min(r.ts) from rq r where r.cache_key = c.cache_key and r.ts >= c.t + interval 36000 second) from chain c where c.t is not null""",
)


@query(
    "inflight_requests",
    compose(
        ["rq", "chain"],
        """select q.request_id, q.cache_key, l.leader_id, l.leader_id = q.request_id as starts_job from rq q asof join (
select c.cache_key, c.t as ts, min(r.request_id) as leader_id from chain c join rq r on r.cache_key = c.cache_key and r.ts = c.t group by 1, 2) l
on q.cache_key = l.cache_key and q.ts >= l.ts""",
    ).replace("chain AS MATERIALIZED", "chain AS"),
)
def inflight_requests(spark, sf):
    return E.attach_to_inflight(T.requests(spark, sf), ttl_s=36000)


FRAGMENTS["jl"] = ([], "select user_id as job_id, event_id as seq, ts, case when event_type = 'purchase' then 'done' else event_type end as event, value, props as data from events")


@query(
    "folded_jobs",
    compose(
        ["jl"],
        """select job_id, max(seq) as last_seq, """ + ", ".join(
            f"arg_max(data, seq) filter (event = '{e}') as last_{e}, count(*) filter (event = '{e}') as n_{e}" for e in ("click", "view", "done", "error")
        ) + " from jl group by 1",
    ),
)
def folded_jobs(spark, sf):
    return E.fold_jobs(T.event_log(spark, sf), ["click", "view", "done", "error"])


def typed_log(spark, sf):
    """The event log with payloads a live run would carry."""
    kinds = F.element_at(F.array(*[F.lit(x) for x in ("reviews", "summary", "done", "source", "error")]), (F.col("event_id") % 5 + 1).cast("int"))
    body = F.to_json(
        F.struct(
            F.when(F.col("event_id") % 2 == 0, "ok").otherwise("not_enough_data").alias("status"), F.col("event_type").alias("message"),
            (F.col("event_id") % 100).alias("reviews_passed"), F.col("event_type").alias("llm"), (F.col("event_id") % 4 == 0).alias("partial"),
        )
    )
    return T.events(spark, sf).select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), "ts", kinds.alias("event"), body.alias("data"))


@query(
    "assembled_results",
    compose(
        [],
        """select user_id as job_id, coalesce(arg_max(case when event_id % 5 = 4 then 'error' when event_id % 2 = 0 then 'ok' else 'not_enough_data' end, event_id) filter (event_id % 5 in (2, 4)), 'ok') as status,
arg_max(event_type, event_id) filter (event_id % 5 in (2, 4)) as message, coalesce(arg_max(event_id % 100, event_id) filter (event_id % 5 = 0), 0) as reviews_passed,
arg_max(event_type, event_id) filter (event_id % 5 = 1) as llm, coalesce(arg_max(event_id % 4 = 0, event_id) filter (event_id % 5 = 2), false) as partial from events group by 1""",
    ),
)
def assembled_results(spark, sf):
    return E.assemble_result(typed_log(spark, sf)).select("job_id", "status", "message", "reviews_passed", "llm", "partial")


@query(
    "followed_jobs",
    compose(
        ["jl"],
        """with s as (select job_id, min(ts) as t0 from jl group by 1), i as (select jl.* from jl join s using (job_id) where ts < t0 + interval 172800 second),
e as (select job_id, min(seq) as e from i where event in ('done', 'error', 'cancelled') group by 1)
select i.job_id, i.seq, cast(epoch_us(i.ts) as bigint) as us, i.event, cast(null as varchar) as message from i left join e using (job_id) where e.e is null or i.seq <= e.e
union all select s.job_id, null, cast(epoch_us(s.t0 + interval 172800 second) as bigint), 'error', 'analysis did not complete within 172800s (worker may be unavailable)' from s where job_id not in (select job_id from e)""".replace("with s as", ", s as"),
    ).replace("\n, s as", ", s as"),
)
def followed_jobs(spark, sf):
    return E.follow(T.event_log(spark, sf), timeout_s=172800).select("job_id", "seq", F.unix_micros("ts").alias("us"), "event", "message")


@query(
    "last_job_events",
    compose(["jl"], "select job_id, seq from (select *, row_number() over (partition by job_id order by seq desc) as rn from jl) where rn <= 25"),
)
def last_job_events(spark, sf):
    return E.last_events(T.event_log(spark, sf), keep=25).select("job_id", "seq")


@query(
    "source_readiness",
    compose(
        ["jl"],
        """select job_id, count(*) = 2 as ready, case when count(*) = 2 then cast(epoch_us(max(f)) as bigint) end as ready_us from (
select job_id, event, min(ts) as f from jl where event in ('signup', 'error') group by 1, 2) group by 1""",
    ),
)
def source_readiness(spark, sf):
    rows = T.event_log(spark, sf).withColumnRenamed("event", "source")
    return E.readiness(rows, ["signup", "error"]).select("job_id", "ready", F.unix_micros("ready_at").alias("ready_us"))


_STAGE_KEYS = [k for k, _ in E.STAGES]


@query(
    "stage_trail",
    compose(
        [],
        f"""select j.job_id, s.stage_order, s.stage, s.label, coalesce(l.status, 'pending') as status from (select distinct user_id as job_id from events) j
cross join (values {', '.join(f"({i}, {quote(k)}, {quote(l)})" for i, (k, l) in enumerate(E.STAGES, 1))}) as s(stage_order, stage, label)
left join (select user_id as job_id, ({array(_STAGE_KEYS)})[cast(event_id % 13 as int) + 1] as stage, arg_max(event_type, event_id) as status from events group by 1, 2) l using (job_id, stage)""",
    ),
)
def stage_trail(spark, sf):
    stage = F.get(F.array(*[F.lit(k) for k in _STAGE_KEYS]), (F.col("event_id") % 13).cast("int"))
    log = T.events(spark, sf).select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), stage.alias("stage"), F.col("event_type").alias("status"))
    return E.stage_trail(log)


@query("replayed_stages")
def replayed_stages(spark, sf):
    key = F.col("p_partkey")
    rows = T.read_table(spark, sf, "part").select(
        key.alias("product_id"), F.col("p_size").alias("reviews_total"), (F.col("p_size") % 9).alias("reviews_passed"), (key % 2 == 0).alias("has_info"),
        (key % 3 == 0).alias("has_risk"), (key % 4).alias("video_sources"), (key % 5).alias("videos"), F.when(key % 6 == 0, "agrees").alias("claim_check"),
        F.when(key % 7 != 0, "fine").alias("verdict"),
    )
    return E.replay_stages(rows)


SQL["replayed_stages"] = """with p as (select p_partkey as k, p_size as n, p_size % 9 as g from part)
select k as product_id, o as stage_order, stage, status, detail from (
select k, 1 as o, 'product_identification' as stage, 'complete' as status, 'from cached analysis' as detail from p
union all select k, 2, 'product_info_collected', 'complete', case when k % 2 = 0 then 'Image and/or description found' else 'No image or description found' end from p
union all select k, 3, 'reviews_collected', case when g > 0 then 'complete' else 'failed' end, cast(g as varchar) || ' of ' || cast(n as varchar) || ' review(s) passed filtering' from p
union all select k, 4, 'sentiment_analyzed', case when n > 0 then 'complete' else 'skipped' end, null from p
union all select k, 5, 'pattern_analysis', case when n > 0 then 'complete' else 'skipped' end, null from p
union all select k, 6, 'review_reliability', case when k % 3 = 0 then 'complete' else 'skipped' end, null from p
union all select k, 7, 'external_research', case when k % 4 = 0 then 'skipped' when k % 5 > 0 then 'complete' else 'failed' end, case when k % 4 = 0 then 'No product name to search video platforms with' end from p
union all select k, 8, 'claim_research', case when k % 6 = 0 then 'complete' else 'skipped' end, null from p
union all select k, 9, 'evidence_synthesis', case when k % 7 <> 0 then 'complete' else 'failed' end, null from p
union all select k, 10, 'trust_score', case when k % 7 <> 0 then 'complete' else 'failed' end, null from p
union all select k, 11, 'verdict', case when k % 7 <> 0 then 'complete' else 'failed' end, null from p)"""


@query(
    "worker_liveness",
    compose([], "select user_id as worker_id, cast(epoch_us(max(ts)) as bigint) as last_us, max(ts) > timestamp '2024-01-30 00:00:00' - interval 43200 second as alive from events group by 1"),
)
def worker_liveness(spark, sf):
    beats = T.events(spark, sf).select(F.col("user_id").alias("worker_id"), "ts")
    rows = E.worker_liveness(beats, F.to_timestamp(F.lit("2024-01-30 00:00:00")), ttl_s=43200)
    return rows.select("worker_id", F.unix_micros("last_beat").alias("last_us"), "alive")


@query(
    "latest_job_state",
    compose(
        [],
        """select user_id as job_id, arg_max(event_type, event_id) as state, cast(epoch_us(max(ts)) as bigint) as updated_us from events
group by 1 having max(ts) > timestamp '2024-01-30 00:00:00' - interval 86400 second""",
    ),
)
def latest_job_state(spark, sf):
    return E.latest_state(_marks(spark, sf), F.to_timestamp(F.lit("2024-01-30 00:00:00")), ttl_s=86400).select(
        "job_id", "state", F.unix_micros("updated_at").alias("updated_us")
    )


def _marks(spark, sf):
    return T.events(spark, sf).select(F.col("user_id").alias("job_id"), "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("state"))


@query(
    "queue_stats",
    compose(
        [],
        """select (select count(*) from (select arg_max(event_type, event_id) as s from events group by user_id having max(ts) > timestamp '2024-01-30 00:00:00' - interval 864000 second) where s = 'view') as depth,
(select count(*) from (select max(ts) as m from events group by user_id) where m > timestamp '2024-01-30 00:00:00' - interval 43200 second) as workers""",
    ),
)
def queue_stats(spark, sf):
    now = F.to_timestamp(F.lit("2024-01-30 00:00:00"))
    marks = _marks(spark, sf).withColumn("state", F.when(F.col("state") == "view", "queued").otherwise("done"))
    workers = E.worker_liveness(T.events(spark, sf).select(F.col("user_id").alias("worker_id"), "ts"), now, ttl_s=43200)
    return E.queue_stats(E.latest_state(marks, now, ttl_s=864000), workers)


@query(
    "event_latency",
    compose(
        ["jl"],
        """select event, count(*) as jobs, round(quantile_cont(ms, 0.5), 3) as median_ms, round(quantile_cont(ms, 0.95), 3) as p95_ms from (
select f.event, epoch_us(f.t) // 1000 - epoch_us(s.t) // 1000 as ms from (select job_id, event, min(ts) as t from jl group by 1, 2) f join (select job_id, min(ts) as t from jl group by 1) s using (job_id)) group by 1""",
    ),
)
def event_latency(spark, sf):
    return E.event_latency(T.event_log(spark, sf)).select("event", "jobs", F.round("median_ms", 3).alias("median_ms"), F.round("p95_ms", 3).alias("p95_ms"))


@query("event_type_counts", compose([], "select event_type, count(*) as n from events group by 1"))
def event_type_counts(spark, sf):
    return E.event_type_counts(T.events(spark, sf))


_PRICES = [("click", 5.0, 25.0), ("view", 2.0, 10.0), ("error", 1.0, 5.0)]


@query(
    "token_costs",
    compose(
        [],
        """select model, calls, i as input_tokens, o as output_tokens, c as cached_tokens, round((i * p.ip + o * p.op) / 1e6, 9) as cost_usd from (
select event_type as model, count(*) as calls, cast(sum(event_id % 4000) as bigint) as i, cast(sum(user_id * 3) as bigint) as o, cast(sum(case when event_id % 2 = 0 then 10 else 0 end) as bigint) as c from events group by 1) u
left join (values """ + ", ".join(f"('{m}', {a}::double, {b}::double)" for m, a, b in _PRICES) + ") as p(m, ip, op) on p.m = u.model",
    ),
)
def token_costs(spark, sf):
    reports = T.events(spark, sf).select(
        F.col("event_type").alias("model"), (F.col("event_id") % 4000).alias("input_tokens"), (F.col("user_id") * 3).alias("output_tokens"),
        F.when(F.col("event_id") % 2 == 0, 10).cast("bigint").alias("cached_tokens"),
    )
    prices = spark.createDataFrame(_PRICES, "model string, input_price double, output_price double")
    return E.token_costs(reports, prices).withColumn("cost_usd", F.round("cost_usd", 9))


@query(
    "framed_events",
    compose(["jl"], """select job_id, seq, 'data: {"job_id":' || cast(job_id as varchar) || ',"seq":' || cast(seq as varchar) || ',"event":"' || event || '"}' || chr(10) || chr(10) as frame from jl"""),
)
def framed_events(spark, sf):
    return E.framed(T.event_log(spark, sf).select("job_id", "seq", "event"))


@query(
    "client_identity",
    compose([], "select event_id, case when event_id % 3 = 0 then '10.1.1.' || cast(user_id as varchar) when event_id % 7 = 0 then 'unknown' else 'peer' || cast(user_id as varchar) end as client, case when event_id % 7 = 0 then 'unknown' else 'peer' || cast(user_id as varchar) end as direct from events"),
)
def client_identity(spark, sf):
    eid, uid = F.col("event_id"), F.col("user_id").cast("string")
    forwarded = F.when(eid % 3 == 0, F.concat(F.lit(" 10.1.1."), uid, F.lit(" , 10.9.9.9")))
    peer = F.when(eid % 7 != 0, F.concat(F.lit("peer"), uid))
    return T.events(spark, sf).select(
        "event_id", E.client_identity(forwarded, peer, trust_proxy=True).alias("client"), E.client_identity(forwarded, peer).alias("direct")
    )


# ------------------------------------------------------------------ display


@query(
    "display_text",
    compose(
        [],
        """select p_partkey, repeat('★', cast(floor(p_size / 10.0) as int)) || case when p_size / 10.0 - floor(p_size / 10.0) >= 0.5 then '½' else '' end as stars,
case when p_size * 13 = 0 then '' else cast(p_size * 13 // 60 as varchar) || ':' || lpad(cast(p_size * 13 % 60 as varchar), 2, '0') end as duration,
case when v = 0 then '' when v >= 1000000 then printf('%.1f', v / 1e6) || 'M views' when v >= 1000 then cast(cast(floor(v / 1e3 + 0.5) as bigint) as varchar) || 'K views' else cast(v as varchar) || ' views' end as views,
case when p_size >= 70 then 'ok' when p_size >= 40 then 'warn' else 'err' end as colour from (select *, p_partkey * p_size * 17 as v from part)""",
    ),
)
def display_text(spark, sf):
    size = F.col("p_size")
    return T.read_table(spark, sf, "part").select(
        "p_partkey", DI.stars(size / 10.0).alias("stars"), DI.duration(size * 13).alias("duration"),
        DI.views(F.col("p_partkey") * size * 17).alias("views"), DI.score_colour(size).alias("colour"),
    )


@query("stage_details")
def stage_details(spark, sf):
    key = F.col("p_partkey")
    rows = T.read_table(spark, sf, "part").select(
        key.alias("product_id"), (F.col("p_size") % 12).alias("reviews_total"), (F.col("p_size") % 5).alias("reviews_passed"),
        F.when(key % 7 != 0, key % 4).alias("clusters"), (key % 3).alias("video_sources"), (key % 5).alias("videos"), (key % 6).alias("evidence_items"),
        (key % 2).alias("concerns"), (key % 3).alias("conflicts"),
    )
    return E.stage_details(rows)


SQL["stage_details"] = """with p as (select p_partkey as k, p_size % 12 as n, p_size % 5 as g, case when p_partkey % 7 <> 0 then p_partkey % 4 end as c, p_partkey % 3 as vs, p_partkey % 5 as v, p_partkey % 6 as e from part)
select k as product_id, 'reviews_collected' as stage, 'complete' as status, case when n > 0 then cast(g as varchar) || ' of ' || cast(n as varchar) || ' review(s) passed filtering' else 'No reviews were found for this product' end as detail from p
union all select k, 'sentiment_analyzed', case when n > 0 then 'complete' else 'skipped' end, case when n > 0 then 'Sentiment signals scored across ' || cast(n as varchar) || ' review(s)' else 'No reviews to analyze' end from p
union all select k, 'pattern_analysis', case when n > 0 and c is not null then 'complete' else 'skipped' end, case when n = 0 then 'No reviews to analyze' when c is null then 'Pattern filtering is disabled' when c > 0 then cast(c as varchar) || ' duplicate-phrasing cluster(s) found' else 'No duplicate-phrasing or submission-timing clusters found' end from p
union all select k, 'external_research', case when vs = 0 then 'skipped' when v > 0 then 'complete' else 'failed' end, case when vs = 0 then 'No product name was available to search video platforms.' when v > 0 then cast(v as varchar) || ' video(s) across ' || cast(vs as varchar) || ' platform(s)' else 'no review videos found on the platforms checked' end from p
union all select k, 'evidence_synthesis', 'complete', case when e > 0 then cast(e as varchar) || ' evidence item(s) found (' || cast(k % 2 as varchar) || ' concern(s), ' || cast(k % 3 as varchar) || ' claim conflict(s))' else 'Limited evidence synthesized' end from p"""


@query(
    "log_lines",
    compose([], """select '{"event_id":' || cast(event_id as varchar) || ',"user":"[redacted]","note":"' || event_type || ' [email] [digits]"}' as line from events"""),
)
def log_lines(spark, sf):
    note = F.concat("event_type", F.lit(" a.b"), F.col("user_id").cast("string"), F.lit("@x.org 123456789"), F.col("user_id").cast("string"))
    return E.log_rows(T.events(spark, sf).select("event_id", F.col("user_id").cast("string").alias("user"), note.alias("note")))


@query(
    "recommendation_labels",
    compose(
        [],
        """select p_partkey, (['Buy with confidence', 'Buy with caution', 'Proceed with caution', 'Consider avoiding', 'Not enough data'])[cast(p_partkey % 5 as int) + 1] as label,
(['buy', 'caution', 'caution', 'avoid', 'unknown'])[cast(p_partkey % 5 as int) + 1] as style from part""",
    ),
)
def recommendation_labels(spark, sf):
    kinds = F.array(*[F.lit(k) for k in DI.RECOMMENDATION_LABELS])
    value = F.get(kinds, (F.col("p_partkey") % 5).cast("int"))
    return T.read_table(spark, sf, "part").select("p_partkey", DI.recommendation_label(value).alias("label"), DI.recommendation_style(value).alias("style"))


FRAGMENTS["absl"] = ([], "select page_id, url, (['p2', '/root', '//cdn.example/x', '?page=9', 'https://other.example/'])[cast(page_id % 5 as int) + 1] as href from pages")


@query(
    "absolute_links",
    compose(
        ["absl"],
        """select page_id, case page_id % 5 when 0 then o || regexp_replace(case when pth = '' then '/' else pth end, '[^/]*$', '') || href when 1 then o || href when 2 then regexp_extract(url, '^([a-z]+:)', 1) || href
when 3 then o || pth || href else href end as link from (select *, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) as o, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) as pth from absl)""",
    ),
)
def absolute_links(spark, sf):
    from reviewtrust.functions import urls as U

    href = F.get(F.array(*[F.lit(h) for h in ("p2", "/root", "//cdn.example/x", "?page=9", "https://other.example/")]), (F.col("page_id") % 5).cast("int"))
    return T.read_table(spark, sf, "pages").select("page_id", U.absolute_link(F.col("url"), href).alias("link"))
