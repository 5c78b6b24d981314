"""Registered queries: titles, matching, videos, URLs, crawl rules, prices."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.core import QUERIES, SQL, long, query, r6  # noqa: F401
from checks.core_sql import FRAGMENTS, array, compose, fixed, percent, quote
from reviewtrust.functions import titles as TI
from reviewtrust.functions import urls as U
from reviewtrust.operators import crawl as CR
from reviewtrust.operators import fx as FX
from reviewtrust.operators import matching as M
from reviewtrust.operators import sample as SA
from reviewtrust.operators import videos as VI
from reviewtrust.sources import tables as T

SP = r"[\s\x0B\x1C-\x1F\x85\p{Z}]+"


def title_norm(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(replace(lower(coalesce({x}, '')), '&', ' and '), '[^\\p{{L}}\\p{{N}}_\\s\\-/\".]', ' ', 'g'), '{SP}', ' ', 'g'))"


def title_tok(x: str) -> str:
    return f"""list_filter(list_transform(string_split({title_norm(x)}, ' '), lambda t: regexp_replace(t, '^[-/.]+|[-/.]+$', '', 'g')),
  lambda t: t <> '' and not list_contains({array(TI.TITLE_STOP_WORDS)}, t) and (length(t) > 1 or regexp_matches(t, '^[0-9]$')))"""


def title_models(t: str) -> str:
    return f"""list_transform(list_filter({t}, lambda t, i: not regexp_matches(t, {quote(TI.MEASUREMENT_PATTERN)}) and (
  (regexp_matches(t, '^[a-z0-9][a-z0-9\\-/]{{2,}}$') and regexp_matches(t, '[0-9]') and regexp_matches(t, '[a-z]'))
  or (regexp_matches(t, '^[0-9]{{1,3}}$') and i > 1 and list_contains({array(TI.GENERATION_WORDS)}, {t}[i - 1])))), lambda t: regexp_replace(t, '[-/]', '', 'g'))"""


_UNIT_MAP = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in TI.SPEC_UNITS.items()) + "}"
_SPEC = quote(rf'(\d+(?:\.\d+)?)\s*({TI.UNITS}|")s?(?:\b|\s|$)')


def title_specs(x: str) -> str:
    return f"""list_distinct(list_filter(list_transform(list_zip(regexp_extract_all({title_norm(x)}, {_SPEC}, 1), regexp_extract_all({title_norm(x)}, {_SPEC}, 2)),
  lambda p: case when {_UNIT_MAP}[p[2]] is not null then {_UNIT_MAP}[p[2]] || ':' || regexp_replace(case when contains(p[1], '.') then regexp_replace(p[1], '\\.?0+$', '') else p[1] end, '^0+([0-9])', '\\1') || case when p[2] = '"' then 'inch' else p[2] end end),
  lambda s: s is not null))"""


FRAGMENTS["lst"] = (
    [],
    """select p_partkey as listing_id, p_brand || ' ' || p_name || ' WX-' || cast(1000 + p_partkey % 40 as varchar) || ' ' || cast(64 * (1 + p_partkey % 3) as varchar) || 'gb' || case when p_partkey % 23 = 0 then ' case' else '' end as title,
  case when p_partkey % 7 <> 0 then p_brand end as brand,
  case when p_partkey % 5 <> 0 then 'sku' || lpad(cast(p_partkey - p_partkey % 4 as varchar), 6, '0') end as sku from part""",
)
FRAGMENTS["ltok"] = (["lst"], f"select *, {title_tok('title')} as toks, {title_specs('title')} as specs, {title_norm('title')} as norm from lst")
FRAGMENTS["lfeat"] = (
    ["ltok"],
    f"""select *, {title_models('toks')} as models, list_distinct(toks) as tset,
  case when brand is not null then string_split({title_norm('brand')}, ' ')[1] else toks[1] end as b,
  case when regexp_matches(norm, {quote(TI.ACCESSORY_PATTERN)}) then 'accessory term ''' || regexp_extract(norm, {quote(TI.ACCESSORY_PATTERN)}, 1) || ''''
       when regexp_matches(norm, {quote(TI.FOR_PATTERN)}) then 'describes itself as being for another product' end as acc from ltok""",
)


@query(
    "title_features",
    compose(
        ["lfeat"],
        """select listing_id, array_to_string(toks, ' ') as tokens, array_to_string(models, ' ') as models,
array_to_string(list_sort(specs), ' ') as specs, b as brand, acc as accessory, sku from lfeat""",
    ),
)
def title_features(spark, sf):
    rows = T.listings(spark, sf)
    tokens = TI.title_tokens(F.col("title"))
    return rows.withColumn("tokens", tokens).select(
        "listing_id", F.array_join("tokens", " ").alias("tokens"),
        F.array_join(TI.model_tokens(F.col("tokens")), " ").alias("models"),
        F.array_join(F.array_sort(F.transform(TI.specs(F.col("title")), lambda s: F.concat(s["dimension"], F.lit(":"), s["value"]))), " ").alias("specs"),
        TI.brand_of(F.col("title"), F.col("brand")).alias("brand"),
        TI.accessory_signal(F.col("title")).alias("accessory"),
        F.try_element_at(TI.identifiers(F.col("ids")), F.lit("sku")).alias("sku"),
    )


FRAGMENTS["mpair"] = (
    ["lfeat"],
    """select q.listing_id as query_id, c.listing_id as position, q.sku as qs, c.sku as cs, q.b as qb, c.b as cb, q.tset as qt, c.tset as ct, q.models as qm, c.models as cm,
  q.brand is not null as qd, c.brand is not null as cd, q.specs as qsp, c.specs as csp, q.acc as qa, c.acc as ca,
  list_filter(q.tset, lambda x: not list_contains(q.models, x)) as qw, list_filter(c.tset, lambda x: not list_contains(c.models, x)) as cw,
  list_distinct(list_transform(q.specs, lambda s: string_split(s, ':')[1])) as qdim, list_distinct(list_transform(c.specs, lambda s: string_split(s, ':')[1])) as cdim
from lfeat q join lfeat c on q.listing_id % 10 = 0 and c.listing_id % 10 <> 0 and c.listing_id - c.listing_id % 10 = q.listing_id""",
)
FRAGMENTS["mscore"] = (
    ["mpair"],
    """select *, coalesce(qs = cs, false) as by_id, list_sort(list_intersect(qm, cm)) as sm, list_sort(list_intersect(qw, cw)) as sw,
  list_distinct(list_transform(list_intersect(qsp, csp), lambda s: string_split(s, ':')[1])) as agreed from mpair""",
)
FRAGMENTS["mscore2"] = (
    ["mscore"],
    """select *, case when len(qw) > 0 and len(cw) > 0 then (2 * len(sw)) / (len(qw) + len(cw)) else 0.0 end as dice,
  list_filter(list_intersect(qdim, cdim), lambda d: not list_contains(agreed, d)) as bad,
  coalesce(qb = cb, false) as ba, coalesce(list_contains(ct, qb), false) as bp,
  coalesce(qb <> cb and ((qd and cd) or (not list_contains(ct, qb) and not list_contains(qt, cb))), false) as bclash from mscore""",
)
FRAGMENTS["mscore3"] = (
    ["mscore2"],
    f"""select *, case when by_id then 1.0 else least(1.0, case when len(sm) > 0 then 0.60 + 0.28 * dice else 0.72 * dice end + case when ba then 0.15 when bp then 0.10 else 0.0 end + least(0.10, 0.05 * len(agreed))) end as score,
  case when by_id then '' else concat_ws(' / ', case when qs <> cs then 'identifiers disagree: sku' end, case when bclash then 'brand mismatch: ' || qb || ' vs ' || cb end,
    case when len(bad) > 0 then bad[1] || ' differs: ' || regexp_replace(qsp[1], '^[^:]*:', '') || ' vs ' || regexp_replace(csp[1], '^[^:]*:', '') end,
    case when ca is not null and qa is null then 'candidate looks like an accessory: ' || ca end,
    case when len(sm) = 0 and len(qm) > 0 and len(cm) > 0 then 'model tokens differ: ' || array_to_string(qm[1:3], '/') || ' vs ' || array_to_string(cm[1:3], '/') end) end as conflicts,
  case when by_id then 'identifier match: sku' else concat_ws(' / ', case when len(sm) > 0 then 'model token match: ' || array_to_string(sm, ', ') end,
    case when dice >= 0.3 then 'descriptive overlap ' || {fixed('dice', 2)} || ': ' || array_to_string(sw[1:6], ', ') end,
    case when ba then 'brand agrees: ' || qb when bp then 'brand present in candidate: ' || qb end,
    case when len(agreed) > 0 then 'specs agree: ' || array_to_string(agreed, ', ') end) end as reasons from mscore2""",
)
FRAGMENTS["mfinal"] = (
    ["mscore3"],
    """select query_id, position, score, conflicts, reasons, conflicts = '' and score >= 0.62 as matched,
  case when conflicts <> '' then 'none' when score >= 0.85 then 'high' when score >= 0.62 then 'medium' when score >= 0.62::double * 0.7 then 'low' else 'none' end as confidence from mscore3""",
)


def scored_listings(spark, sf):
    """Every tenth part is a query; the nine after it are its candidates."""
    rows = T.listings(spark, sf)
    key = F.col("listing_id")
    queries = rows.where(key % 10 == 0).withColumnRenamed("listing_id", "query_id")
    candidates = rows.where(key % 10 != 0).select((key - key % 10).alias("query_id"), key.alias("position"), "title", "brand", "ids")
    return M.score_candidates(queries, candidates)


@query(
    "match_scores",
    compose(["mfinal"], "select query_id, position, matched, round(score, 6) as score, confidence, reasons, conflicts from mfinal"),
)
def match_scores(spark, sf):
    return scored_listings(spark, sf).select(
        "query_id", "position", "matched", r6(F.col("score")).alias("score"), "confidence",
        F.array_join("reasons", " / ").alias("reasons"), F.array_join("conflicts", " / ").alias("conflicts"),
    )


@query(
    "best_match",
    compose(
        ["mfinal"],
        """select query_id, case when matched then position end as best_position, matched, round(score, 6) as score, confidence from (
select *, row_number() over (partition by query_id order by matched desc, round(score, 12) desc, position) as rn from mfinal) where rn = 1""",
    ),
)
def best_match(spark, sf):
    scored = scored_listings(spark, sf).withColumn("score", F.round("score", 12))
    return M.best_match(scored).select("query_id", "best_position", "matched", r6(F.col("score")).alias("score"), "confidence")


# ------------------------------------------------------------------ videos

FRAGMENTS["vid"] = (
    [],
    """select p_partkey % 20 as product_id, p_partkey as video_key, 'v' || cast(p_partkey - p_partkey % 2 as varchar) as video_id,
  p_brand || ' ' || p_name || ' WX-' || cast(1000 + p_partkey % 40 as varchar) || ([' review', ' giveaway', ' unboxing', ''])[cast(p_partkey % 4 as int) + 1] as title,
  case when p_partkey % 9 <> 0 then cast(p_size * 10 as bigint) end as duration_seconds, case when p_partkey % 8 <> 0 then p_partkey * 37 end as views,
  case when p_partkey % 2 = 0 then 'youtube' else 'tiktok' end as source from part""",
)
FRAGMENTS["prodtitle"] = ([], "select p_partkey as product_id, p_brand || ' ' || p_name || ' WX-' || cast(1000 + p_partkey % 40 as varchar) as product_title from part")
FRAGMENTS["vtok"] = (
    ["vid", "prodtitle"],
    f"select v.*, p.product_title, list_distinct({title_tok('p.product_title')}) as pt, list_distinct({title_tok('v.title')}) as vt from vid v join prodtitle p using (product_id)",
)
FRAGMENTS["vrel0"] = (
    ["vtok"],
    f"""select *, list_sort(list_distinct(list_intersect({title_models('pt')}, {title_models('vt')}))) as sm, len(list_intersect(pt, vt)) / len(pt) as cover,
  regexp_matches(title, {quote('(?i)' + VI.JUNK_PATTERN)}) as junk, regexp_matches(title, {quote('(?i)' + VI.REVIEW_HINT_PATTERN)}) as hint from vtok""",
)
FRAGMENTS["vrel"] = (
    ["vrel0"],
    f"""select *, case when junk then 0.0 else least(1.0, case when len(sm) > 0 then 0.6 else 0.0 end + 0.4 * cover + case when hint then 0.12 else 0.0 end) end as relevance,
  case when junk then 'title matches a non-review pattern' else concat_ws(' / ', case when len(sm) > 0 then 'model token: ' || array_to_string(sm, ', ') end,
    case when cover > 0 then 'covers ' || {percent('cover')} || ' of product terms' end, case when hint then 'title reads as a review' end) end as reasons from vrel0""",
)
FRAGMENTS["vjudge"] = (
    ["vrel"],
    f"""select *, case when source <> 'tiktok' and coalesce(duration_seconds < 120, false) then 'too short'
  when relevance < 0.45 then case when relevance = 0 and reasons <> '' then string_split(reasons, ' / ')[1] else 'relevance ' || {fixed('relevance', 2)} || ' below threshold 0.45' end end as drop_reason from vrel""",
)


def relevant_videos(spark, sf):
    key = F.col("p_partkey")
    titles = T.read_table(spark, sf, "part").select(
        key.alias("product_id"), F.concat("p_brand", F.lit(" "), "p_name", F.lit(" WX-"), (1000 + key % 40).cast("string")).alias("product_title")
    )
    return VI.judge_videos(VI.score_relevance(T.videos(spark, sf).join(titles, "product_id")))


@query(
    "video_relevance",
    compose(["vjudge"], "select video_key, round(relevance, 6) as relevance, reasons, drop_reason, drop_reason is null as kept from vjudge"),
)
def video_relevance(spark, sf):
    return relevant_videos(spark, sf).select(
        "video_key", r6(F.col("relevance")).alias("relevance"), F.array_join("relevance_reasons", " / ").alias("reasons"), "drop_reason", "kept"
    )


FRAGMENTS["vtop"] = (
    ["vjudge"],
    """select *, row_number() over (partition by product_id, source order by round(relevance, 12) desc, coalesce(views, 0) desc, video_key) as source_rank
from vjudge where drop_reason is null""",
)


def _rounded(spark, sf):
    return relevant_videos(spark, sf).withColumn("relevance", F.round("relevance", 12))


@query(
    "top_videos",
    compose(["vtop"], "select product_id, source, video_key, cast(source_rank as bigint) as source_rank from vtop where source_rank <= case when source = 'tiktok' then 3 else 6 end"),
)
def top_videos(spark, sf):
    return VI.top_videos(_rounded(spark, sf)).select("product_id", "source", "video_key", long("source_rank").alias("source_rank"))


@query(
    "video_report",
    compose(["vjudge"], "select product_id, source, count(*) as considered, count(drop_reason) as filtered_out, count(*) - count(drop_reason) as kept from vjudge group by 1, 2"),
)
def video_report(spark, sf):
    return VI.source_report(relevant_videos(spark, sf))


@query(
    "interleaved_videos",
    compose(["vtop"], "select product_id, video_key, source, cast(source_rank as bigint) as source_rank from vtop where source_rank <= case when source = 'tiktok' then 3 else 6 end"),
)
def interleaved_videos(spark, sf):
    top = VI.top_videos(_rounded(spark, sf)).drop("source_rank")
    return SA.interleave(top).select("product_id", "video_key", "source", long("source_rank").alias("source_rank"))


@query(
    "fallback_videos",
    compose(
        ["vtop", "rv"],
        """select product_id, video_key, cast(p as bigint) as position from (select *, row_number() over (partition by product_id order by source_rank, source) as p
from vtop where product_id not in (select distinct product_id from rv where rating >= 4)) where p <= 6""",
    ),
)
def fallback_videos(spark, sf):
    survivors = T.reviews(spark, sf).where("rating >= 4").select("product_id")
    rows = SA.fallback_videos(_rounded(spark, sf).where("kept"), survivors)
    return rows.select("product_id", "video_key", long("position").alias("position"))


@query(
    "video_dedupe",
    compose(["vid"], "select video_id, min(video_key) as video_key from vid group by 1"),
)
def video_dedupe(spark, sf):
    return VI.first_per_key(T.videos(spark, sf), ["video_id"], ["video_key"]).select("video_id", "video_key")


@query(
    "search_with_details",
    compose(
        [],
        """select 'v' || cast(p_partkey as varchar) as video_id, p_name as title,
case when p_partkey % 6 <> 0 and p_size * 60 + p_partkey % 60 > 0 then cast(p_size * 60 + p_partkey % 60 as bigint) end as duration_seconds,
case when p_partkey % 6 <> 0 and p_partkey % 5 <> 0 then p_partkey * 3 end as views, '2024-03-0' || cast(1 + p_partkey % 9 as varchar) as published,
'https://www.youtube.com/watch?v=v' || cast(p_partkey as varchar) as url from part""",
    ),
)
def search_with_details(spark, sf):
    key = F.col("p_partkey")
    part = T.read_table(spark, sf, "part")
    vid = F.concat(F.lit("v"), key.cast("string"))
    search = part.select(
        vid.alias("video_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("channel"), F.col("p_brand").alias("channel_id"),
        F.concat(F.lit("2024-03-0"), (1 + key % 9).cast("string"), F.lit("T10:00:00Z")).alias("published_at"), F.col("p_type").alias("description"),
    )
    details = part.where(key % 6 != 0).select(
        vid.alias("video_id"), F.concat(F.lit("PT"), F.col("p_size").cast("string"), F.lit("M"), (key % 60).cast("string"), F.lit("S")).alias("duration"),
        F.when(key % 5 != 0, (key * 3).cast("string")).otherwise("hidden").alias("view_count"),
    )
    return VI.merge_details(search, details).select("video_id", "title", "duration_seconds", "views", "published", "url")


@query(
    "api_errors",
    compose(
        [],
        """select event_id, case when st = 403 and event_type = 'error' then 'YouTube API quota exceeded for today' when st = 403 then 'YouTube API rejected the request (forbidden): ' || event_type
when st = 400 and event_type = 'signup' then 'YOUTUBE_API_KEY is not valid' else 'YouTube API HTTP ' || cast(st as varchar) || ': ' || event_type end as explained, st in (401, 403, 429) as blocked
from (select event_id, event_type, ([400, 401, 403, 429, 500])[cast(event_id % 5 as int) + 1] as st from events)
""".replace("case when st = 400 and event_type = 'signup'", "case when st = 400 and event_type = 'signup'"),
    ).replace("else 'YouTube API HTTP ' || cast(st as varchar) || ': ' || event_type end", "else 'YouTube API HTTP ' || cast(st as varchar) || ': ' || case event_type when 'error' then 'Quota exceeded' when 'signup' then 'API key not valid' else event_type end end"),
)
def api_errors(spark, sf):
    status = F.element_at(F.array(*[F.lit(x) for x in (400, 401, 403, 429, 500)]), (F.col("event_id") % 5 + 1).cast("int"))
    message = F.when(F.col("event_type") == "error", "Quota exceeded").when(F.col("event_type") == "signup", "API key not valid").otherwise(F.col("event_type"))
    rows = T.events(spark, sf).select("event_id", status.alias("st"), message.alias("message"))
    return rows.select("event_id", VI.api_error_bucket(F.col("st"), F.lit(""), F.col("message")).alias("explained"), VI.api_blocked(F.col("st")).alias("blocked"))


SQL["api_errors"] = SQL["api_errors"].replace("(forbidden): ' || event_type", "(forbidden): ' || case event_type when 'signup' then 'API key not valid' else event_type end")

# ------------------------------------------------------------------ URLs

HOST = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"
PATH = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
QRY = "regexp_extract(url, '^[^?#]*[?]([^#]*)', 1)"
NOFRAG = "string_split(url, '#')[1]"


@query(
    "url_facts",
    compose(
        [],
        f"""select page_id, regexp_extract(url, '^([a-z]+):', 1) as scheme, {HOST} as domain, starts_with(url, 'https:') as secure,
regexp_replace({HOST}, '^www\\.', '') as source_name, 'generic' as adapter, regexp_extract(url, '^([a-z]+):', 1) || '://' || {HOST} || {PATH} as bare_url,
regexp_extract(url, '^([a-z]+):', 1) || '://' || {HOST} || {PATH} || case when len(kept) > 0 then '?' || array_to_string(kept, '&') else '' end as canonical_url
from (select *, list_filter(string_split({QRY}, '&'), lambda p: p <> '' and not regexp_matches(p, '(?i)^(utm_|gclid|fbclid|ref_?|_encoding|psc|th|tag|linkCode)')) as kept from pages)""",
    ),
)
def url_facts(spark, sf):
    url, none = F.col("url"), F.lit(None).cast("string")
    facts = U.listing_facts(url)
    return T.read_table(spark, sf, "pages").select(
        "page_id", facts["scheme"].alias("scheme"), facts["domain"].alias("domain"), facts["secure"].alias("secure"),
        U.source_name(url, none).alias("source_name"), U.site_adapter(url, none).alias("adapter"),
        U.bare_url(url).alias("bare_url"), U.canonical_url(url).alias("canonical_url"),
    )


_HOSTS = ["www.amazon.com", "www.ebay.co.uk", "shop.walmart.com", "bestbuy.com", "www.newegg.com", "10.0.0.8", "localhost", "169.254.169.254", "intranet", "myamazon.org"]
_PATHS = ["/Brand-Thing-One/dp/B0", "/itm/thing-two/1234", "/ip/nice-thing/55", "/site/x/6", "/p/N8", "/product/abc-", "/listing/7"]


def shop_urls(spark, sf):
    """Retail-looking URLs, one per part."""
    key = F.col("p_partkey")
    host = F.element_at(F.array(*[F.lit(h) for h in _HOSTS]), (key % len(_HOSTS) + 1).cast("int"))
    path = F.element_at(F.array(*[F.lit(p) for p in _PATHS]), (key % len(_PATHS) + 1).cast("int"))
    scheme = F.when(key % 17 == 0, "ftp").when(key % 2 == 0, "http").otherwise("https")
    tail = F.when(key % 5 == 0, ".p?page=2&ref=x").when(key % 4 == 0, "?sku=S1").otherwise("")
    return T.read_table(spark, sf, "part").select(
        key.alias("product_id"), "p_name",
        F.concat(scheme, F.lit("://"), host, path, F.lpad(key.cast("string"), 8, "0"), tail).alias("url"),
    )


FRAGMENTS["shop"] = (
    [],
    f"""select p_partkey as product_id, p_name, case when p_partkey % 17 = 0 then 'ftp' when p_partkey % 2 = 0 then 'http' else 'https' end || '://' || ({array(_HOSTS)})[cast(p_partkey % {len(_HOSTS)} as int) + 1]
  || ({array(_PATHS)})[cast(p_partkey % {len(_PATHS)} as int) + 1] || lpad(cast(p_partkey as varchar), 8, '0') || case when p_partkey % 5 = 0 then '.p?page=2&ref=x' when p_partkey % 4 = 0 then '?sku=S1' else '' end as url from part""",
)
FRAGMENTS["shop2"] = (["shop"], f"select *, {HOST} as h, {PATH} as pth, {QRY} as q, regexp_extract(url, '^([a-z]+):', 1) as sch from shop")
_GENERIC_PATH = r"(?i)/(?:dp|itm|ip|pd|prd|product|products|listing|item)/(?:[^/?#]+/)?([A-Za-z0-9][\w-]{3,})"
_GENERIC_QUERY = r"(?i)[?&](?:product_?id|sku|pid|itemid)=([\w-]+)"
_GENERIC_ID = f"nullif(regexp_extract(pth || case when q <> '' then '?' || q else '' end, {quote(_GENERIC_PATH)}, 1), '')"
_SITE_IDS = ", ".join(
    f"case when regexp_matches(h, {quote(rf'(?i)(^|[.]){s}[.]')}) then nullif(regexp_extract(pth, {quote(p)}, 1), '') end"
    for s, p in [
        ("amazon", r"(?i)/(?:dp|gp/product|gp/aw/d)/([A-Z0-9]{10})"),
        ("ebay", r"/itm/(?:.*/)?(\d{9,})"),
        ("walmart", r"/ip/(?:[^/]+/)?(\d+)"),
        ("bestbuy", r"/(\d{6,})\.p"),
        ("etsy", r"/listing/(\d+)"),
        ("aliexpress", r"/item/(?:.*?)(\d{6,})\.html"),
        ("jumia", r"-(\d+)\.html"),
    ]
)
FRAGMENTS["shop3"] = (
    ["shop2"],
    f"""select *, coalesce({_SITE_IDS}, {_GENERIC_ID}, nullif(regexp_extract(pth || case when q <> '' then '?' || q else '' end, {quote(_GENERIC_QUERY)}, 1), '')) as pid,
  case when regexp_matches(h, '(^|\\.)amazon\\.') then 'amazon' when regexp_matches(h, '(^|\\.)newegg\\.') then 'newegg' when regexp_matches(h, '(^|\\.)bestbuy\\.') then 'bestbuy'
    when regexp_matches(h, '(^|\\.)ebay\\.') then 'ebay' else 'generic' end as adapter,
  case when sch not in ('http', 'https') then 'scheme ''' || sch || ''' is not allowed' when h = '169.254.169.254' then 'cloud metadata endpoint' when h = '10.0.0.8' then 'private network address'
    when h = 'localhost' then 'local hostname' when not contains(h, '.') then 'non-public hostname' end as reason from shop2""",
)


@query(
    "product_ids",
    compose(["shop3"], "select product_id, pid, adapter from shop3"),
)
def product_ids(spark, sf):
    return shop_urls(spark, sf).select(
        "product_id", U.product_id_from_url(F.col("url")).alias("pid"), U.site_adapter(F.col("url"), F.lit(None).cast("string")).alias("adapter")
    )


@query(
    "fetch_safety",
    compose(["shop3"], "select product_id, reason, case when reason is null then null when contains(reason, 'scheme') then 'invalid_url' else 'unsupported_target' end as bucket from shop3"),
)
def fetch_safety(spark, sf):
    rows = shop_urls(spark, sf).select("product_id", U.rejection_reason(F.col("url")).alias("reason"))
    return rows.withColumn("bucket", U.rejection_bucket(F.col("reason")))


@query(
    "cache_keys",
    compose(
        ["shop3"],
        """select product_id, left(sha256(case when product_id % 3 = 0 and pid is not null then 'id:shop:' || upper(pid) when product_id % 3 = 1 and pid is not null then 'id:' || upper(pid)
when product_id % 2 = 0 then 'url:' || regexp_replace(h, '^www\\.', '') || regexp_replace(pth, '/+$', '') else 'name:' || trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) end), 32) as cache_key from shop3""",
    ),
)
def cache_keys(spark, sf):
    key, url = F.col("product_id"), F.col("url")
    pid = F.when(key % 3 != 2, U.product_id_from_url(url))
    site = F.when((key % 3 == 0), F.lit(" Shop "))
    return shop_urls(spark, sf).select(
        "product_id", U.cache_key(pid, site, F.when(key % 2 == 0, url), F.col("p_name")).alias("cache_key")
    )


@query(
    "names_from_urls",
    compose(
        ["shop2"],
        """select product_id, (list_sort(list_transform(list_filter(list_transform(list_filter(string_split(pth, '/'), lambda s: s <> '' and not list_contains(['dp', 'gp', 'product', 'products', 'itm', 'item', 'site', 'p', 'ip', 'pd', 's', 'aspx', 'html', 'htm', 'www'], lower(s))),
 lambda s: list_filter(regexp_split_to_array(s, '[-_+]+'), lambda w: w <> '' and not regexp_matches(w, '^[0-9]+$'))), lambda w: len(w) >= 2), lambda w: [lpad(cast(1000 - length(array_to_string(w, ' ')) as varchar), 6, '0'), array_to_string(w, ' ')])))[1][2] as name from shop2""",
    ),
)
def names_from_urls(spark, sf):
    return shop_urls(spark, sf).select("product_id", U.name_from_url(F.col("url")).alias("name"))


@query(
    "review_page_urls",
    compose(
        ["shop3"],
        """select product_id, case adapter when 'amazon' then concat_ws(' ', url, case when asin <> '' then 'https://' || h || '/product-reviews/' || upper(asin) || '?reviewerType=all_reviews&sortBy=recent&pageNumber=1' end,
  case when asin <> '' then 'https://' || h || '/product-reviews/' || upper(asin) || '?pageNumber=1' end)
when 'newegg' then concat_ws(' ', url, case when nid <> '' then 'https://www.newegg.com/product-reviews/' || nid end)
when 'bestbuy' then concat_ws(' ', url, case when bid <> '' then 'https://www.bestbuy.com/site/reviews/product/' || bid end)
when 'ebay' then url else concat_ws(' ', url, regexp_replace(string_split(string_split(url, '?')[1], '#')[1], '/+$', '') || '/reviews', regexp_replace(string_split(string_split(url, '?')[1], '#')[1], '/+$', '') || '/review') end as urls
from (select *, regexp_extract(url, '(?i)/(?:dp|gp/product|gp/aw/d|product-reviews)/([A-Z0-9]{10})', 1) as asin, regexp_extract(url, '/p/([A-Za-z0-9]+)', 1) as nid, regexp_extract(url, '/(\\d{6,})\\.p', 1) as bid from shop3)""",
    ),
)
def review_page_urls(spark, sf):
    none = F.lit(None).cast("string")
    return shop_urls(spark, sf).select(
        "product_id", F.array_join(U.review_page_urls(F.col("url"), none, U.site_adapter(F.col("url"), none)), " ").alias("urls")
    )


@query(
    "entry_kinds",
    compose(["rv"], "select review_id, case when trim(text) = '' then 'empty' when regexp_matches(trim(text), '^[A-Za-z][A-Za-z0-9+.-]*:\\S*$') then 'url' else 'name' end as kind from rv"),
)
def entry_kinds(spark, sf):
    return T.reviews(spark, sf).select("review_id", U.entry_kind(F.col("text")).alias("kind"))


# ------------------------------------------------------------------ crawl rules

_RULES = "User-agent: *\nAllow: /\nDisallow: /en/\nAllow: /en/*7\nDisallow: /*.html$\n\nUser-agent: shopbot\nDisallow: /es/ # spanish\n"


def crawl_files(spark, sf):
    """One rule file per host seen in the page table."""
    pages = T.read_table(spark, sf, "pages")
    return pages.select(U.host(F.col("url")).alias("host")).distinct().select("host", F.lit(_RULES).alias("text"))


@query(
    "crawl_rules",
    compose(
        [],
        f"""select host, agent, pattern, allow from (select distinct {HOST} as host from pages) cross join (values
('*', '/', true), ('*', '/en/', false), ('*', '/en/*7', true), ('*', '/*.html$', false), ('shopbot', '/es/', false)) as t(agent, pattern, allow)""",
    ),
)
def crawl_rules(spark, sf):
    return CR.parse_rules(crawl_files(spark, sf))


@query(
    "crawl_allowed",
    compose(
        [],
        f"""select page_id, arg_max(allow, len * 2 + allow::int) as crawl_allowed from (
select page_id, {PATH} || case when {QRY} <> '' then '?' || {QRY} else '' end as p, r.pattern, r.allow, length(r.pattern) as len, r.rx from pages cross join (values
('/', true, '^/'), ('/en/', false, '^/en/'), ('/en/*7', true, '^/en/.*7'), ('/*.html$', false, '^/.*\\.html$')) as r(pattern, allow, rx)) where regexp_matches(p, rx) group by 1""",
    ),
)
def crawl_allowed(spark, sf):
    rules = CR.parse_rules(crawl_files(spark, sf))
    return CR.allowed_urls(T.read_table(spark, sf, "pages"), rules, "Mozilla/5.0").select("page_id", "crawl_allowed")


# ------------------------------------------------------------------ prices

_RATES = [("EUR", 0.92), ("GBP", 0.79), ("JPY", 151.5), ("XXX", 0.0)]
_CODES = ["USD", "eur", "GBP ", "JPY", "XXX", "ABC", ""]


@query(
    "usd_prices",
    compose(
        [],
        f"""select p_partkey as product_id, case when code = 'USD' then round_even(p_retailprice, 2) when r.rate > 0 then round_even(p_retailprice / r.rate, 2) end as price_usd
from (select *, upper(trim(({array(_CODES)})[cast(p_partkey % 7 as int) + 1])) as code from part)
left join (values {', '.join(f"('{c}', {r}::double)" for c, r in _RATES)}) as r(cur, rate) on r.cur = code""",
    ),
)
def usd_prices(spark, sf):
    code = F.element_at(F.array(*[F.lit(c) for c in _CODES]), (F.col("p_partkey") % 7 + 1).cast("int"))
    prices = T.read_table(spark, sf, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_retailprice").alias("price"), code.alias("currency"))
    rates = spark.createDataFrame(_RATES, "currency string, rate double")
    return FX.with_usd(prices, rates).select("product_id", "price_usd")
