"""Common table expressions shared by the check SQL, and the core review queries.

``FRAGMENTS`` maps a name to (names it needs, SQL); ``compose`` puts a query together with
just the fragments it uses.
"""

from __future__ import annotations

from reviewtrust.functions import lexicon
from reviewtrust.sources.tables import BUYER_OFFSET, BUYER_TEXTS


def quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def array(values) -> str:
    return "[" + ", ".join(quote(v) for v in values) + "]"


FRAGMENTS: dict[str, tuple[list[str], str]] = {}


def compose(needs: list[str], body: str) -> str:
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for other in FRAGMENTS[name][0]:
            visit(other)
        ordered.append(name)

    for name in needs:
        visit(name)
    if not ordered:
        return body
    parts = ",\n".join(f"{n} AS MATERIALIZED ({FRAGMENTS[n][1]})" if n not in ("reach",) else f"{n} AS ({FRAGMENTS[n][1]})" for n in ordered)
    return f"WITH RECURSIVE {parts}\n{body}"


SPACE = r"[\s\x0B\x1C-\x1F\x85\p{Z}]+"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SPACE}', ' ', 'g'))"


def normalize(x: str) -> str:
    inner = f"regexp_replace(lower(coalesce({x}, '')), '[^\\p{{L}}\\p{{N}}_\\s''%$£€/-]', ' ', 'g')"
    return squeeze(inner)


def words(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9'']+')"


def count_matches(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {quote(pattern)}))"


def ascii_words(x: str) -> str:
    """Map letters outside ASCII to '_' so that ASCII word boundaries are exact."""
    return f"regexp_replace({x}, '[\\p{{L}}\\p{{N}}--[\\x00-\\x7F]]', '_', 'g')".replace(
        "[\\p{L}\\p{N}--[\\x00-\\x7F]]", "[^\\x00-\\x7F$£€¥₦₹\\p{Z}\\p{P}\\p{S}]"
    )


def percent(x: str) -> str:
    return f"cast(cast(round_even(({x}) * 100, 0) as bigint) as varchar) || '%'"


def fixed(x: str, digits: int) -> str:
    return f"printf('%.{digits}f', round_even({x}, {digits}))"


FRAGMENTS["rv"] = (
    [],
    f"""
select d.doc_id // 100 as product_id, d.doc_id as review_id, d.text, d.source,
  case when d.doc_id % 13 <> 0 then cast((d.doc_id * 7) % 5 + 1 as double) end as rating,
  case when d.doc_id % 11 = 0 then null
       when d.doc_id % 3 = 0 then date '2024-01-01' + cast((d.doc_id // 100) % 4 as int)
       else date '2024-01-01' + cast(d.n_chars % 60 as int) end as review_date,
  case when d.doc_id % 17 = 0 then '2 weeks ago' end as date_raw,
  case l.quality when 1 then true when 0 then false end as verified_purchase,
  'user' || cast(d.doc_id % 97 as varchar) as author,
  cast((d.doc_id * 3) % 60 as int) as helpful_votes
from documents d left join labels l using (doc_id)
union all
select doc_id // 100, doc_id + {BUYER_OFFSET},
  ({array(BUYER_TEXTS)})[cast((doc_id * 7 + quality * 3 + toxic) % {len(BUYER_TEXTS)} as int) + 1],
  'src' || cast(doc_id % 3 as varchar), cast((doc_id % 2) * 2 + 3 as double),
  date '2024-02-10' + cast(doc_id % 6 as int), null,
  case when toxic = 1 then false when doc_id % 4 = 0 then true end,
  'buyer' || cast(doc_id % 50 as varchar), cast(doc_id % 12 as int)
from labels""",
)
FRAGMENTS["tok"] = (["rv"], f"select product_id, review_id, {words('text')} as w from rv")


def ngram_sets(size: int) -> str:
    run = " || ' ' || ".join(["w[i]"] + [f"w[i + {k}]" for k in range(1, size)])
    return f"""case when len(w) = 0 then [] when len(w) < {size} then [array_to_string(w, ' ')]
  else list_distinct(list_transform(range(1, len(w) - {size - 2}), lambda i: {run})) end"""


CONTENT = f"list_distinct(list_filter(w, lambda t: not list_contains({array(lexicon.STOP_WORDS)}, t)))"
FRAGMENTS["sets"] = (
    ["tok"],
    f"select product_id, review_id, {ngram_sets(2)} as s2, {ngram_sets(3)} as s3, {CONTENT} as sc from tok",
)
FRAGMENTS["g2"] = (["sets"], "select product_id, review_id, unnest(s2) as g from sets")
FRAGMENTS["g3"] = (["sets"], "select product_id, review_id, unnest(s3) as g from sets")
FRAGMENTS["gc"] = (["sets"], "select product_id, review_id, unnest(sc) as g from sets")
FRAGMENTS["cand"] = (
    ["g2"],
    """select distinct a.product_id, a.review_id as l, b.review_id as r
from g2 a join g2 b using (product_id, g) where a.review_id < b.review_id""",
)
for _k in ("2", "3", "c"):
    FRAGMENTS[f"both{_k}"] = (
        [f"g{_k}"],
        f"""select a.product_id, a.review_id as l, b.review_id as r, count(*) as n
from g{_k} a join g{_k} b using (product_id, g) where a.review_id < b.review_id group by 1, 2, 3""",
    )
FRAGMENTS["sim"] = (
    ["cand", "both2", "both3", "bothc", "sets"],
    """select c.product_id, c.l, c.r,
  greatest(coalesce(b3.n / (len(x.s3) + len(y.s3) - b3.n), 0.0),
           0.85 * coalesce(b2.n / (len(x.s2) + len(y.s2) - b2.n), 0.0),
           0.75 * coalesce((bc.n * 2) / (len(x.sc) + len(y.sc)), 0.0)) as similarity
from cand c
join sets x on x.product_id = c.product_id and x.review_id = c.l
join sets y on y.product_id = c.product_id and y.review_id = c.r
left join both2 b2 on b2.product_id = c.product_id and b2.l = c.l and b2.r = c.r
left join both3 b3 on b3.product_id = c.product_id and b3.l = c.l and b3.r = c.r
left join bothc bc on bc.product_id = c.product_id and bc.l = c.l and bc.r = c.r""",
)
FRAGMENTS["edges"] = (["sim"], "select * from sim where similarity >= 0.55")
FRAGMENTS["firsts"] = (
    ["tok"],
    """select product_id, min(review_id) as review_id from tok where len(w) > 0
group by product_id, array_to_string(w, ' ')""",
)
FRAGMENTS["textlinks"] = (
    ["edges", "firsts"],
    """select e.* from edges e
semi join firsts x on x.product_id = e.product_id and x.review_id = e.l
semi join firsts y on y.product_id = e.product_id and y.review_id = e.r""",
)
FRAGMENTS["links"] = (
    ["edges"],
    "select product_id, l as a, r as b from edges union all select product_id, r, l from edges",
)
FRAGMENTS["reach"] = (
    ["links"],
    """select product_id, a as node, a as other from links
union select x.product_id, x.node, y.b from reach x join links y on y.product_id = x.product_id and y.a = x.other""",
)
FRAGMENTS["clu"] = (
    ["reach", "sim"],
    """select product_id, node as review_id, min(other) as cluster_id, count(*) as cluster_size
from reach group by 1, 2""",
)
FRAGMENTS["peak"] = (
    ["edges"],
    """select product_id, review_id, max(similarity) as max_similarity from (
  select product_id, l as review_id, similarity from edges union all select product_id, r, similarity from edges)
group by 1, 2""",
)
FRAGMENTS["days"] = (
    ["rv"],
    """select product_id, review_date as day, count(*) as n from rv
where review_date is not null
  and not coalesce(regexp_matches(date_raw, '(?i)\\b(ago|today|yesterday|just now|recently|last (?:week|month))\\b'), false)
group by 1, 2""",
)
FRAGMENTS["daystat"] = (
    ["days"],
    """select product_id, sum(n) as usable, count(*) as nd, sum(n * n) as sq, median(n) as med,
  cast(max(day) - min(day) + 1 as bigint) as span from days group by 1""",
)
FRAGMENTS["dayrep"] = (
    ["days", "daystat"],
    """select d.product_id, d.day, d.n as day_count, s.usable, s.nd, s.med, s.span, d.n / s.usable as day_share,
  s.usable >= 8 and (d.n >= greatest(3.0, s.med + 2.5 * greatest(
      case when s.nd > 1 then sqrt(cast(s.nd * s.sq - s.usable * s.usable as double)) / s.nd else 0.0 end, 0.5))
    or (d.n / s.usable >= 0.6 and d.n >= 3)) as in_burst
from days d join daystat s using (product_id)""",
)
FRAGMENTS["sent"] = (
    ["rv"],
    f"""select *, case when wc > 0 and pos + neg > 0 then (pos - neg) / (pos + neg) else 0.0 end as polarity,
  case when wc > 0 then inten / wc else 0.0 end as intensity,
  case when wc > 0 then least(1.0, list_sum(list_append(list_transform(generic, lambda p: len(regexp_extract_all(p, '[a-z0-9'']+'))), 0)) / wc) else 0.0 end as generic_ratio,
  case when wc > 0 then least(1.0, (units * 2 + len(markers) * 2 + prices * 2 + least(numbers, 4)) / 10.0) else 0.0 end as specificity
from (
  select product_id, review_id, text, norm, wd, len(wd) as wc,
    len(list_filter(wd, lambda t: list_contains({array(lexicon.POSITIVE)}, t))) as pos,
    len(list_filter(wd, lambda t: list_contains({array(lexicon.NEGATIVE)}, t))) as neg,
    len(list_filter(wd, lambda t: list_contains({array(lexicon.INTENSIFIERS)}, t))) as inten,
    list_filter({array(lexicon.GENERIC_PRAISE)}, lambda p: contains(norm, p)) as generic,
    list_filter({array(lexicon.SPECIFIC_MARKERS)}, lambda p: contains(norm, p)) as markers,
    {count_matches(ascii_words('norm'), '(?i)' + lexicon.UNIT_PATTERN)} as units,
    {count_matches(ascii_words('norm'), lexicon.NUMBER_PATTERN)} as numbers,
    {count_matches(ascii_words('text'), '(?i)' + lexicon.PRICE_PATTERN)} as prices
  from (select product_id, review_id, text, {normalize('text')} as norm,
          {words(normalize('text'))} as wd from rv))""",
)
FRAGMENTS["bare"] = (
    ["sent"],
    """select *, wc > 0 and polarity >= 0.8 and specificity <= 0.2 and len(markers) = 0
  and (generic_ratio >= 0.30 or wc <= 25) as contentless,
  0.52::double * least(1.0, 0.55::double + greatest(generic_ratio,
    case when wc <= 15 and specificity = 0.0 then 0.45 when wc <= 25 then 0.20 else 0.0 end)) as praise_weight
from sent""",
)
FRAGMENTS["sig"] = (
    ["rv", "bare", "clu", "peak", "dayrep"],
    """select rv.product_id, rv.review_id, rv.source, rv.rating, rv.verified_purchase, rv.text,
  c.cluster_id, c.cluster_size, p.max_similarity,
  case when c.cluster_size >= 2 then 0.55::double * least(1.0, 0.45::double + 0.11::double * (c.cluster_size - 2)) * least(1.0, p.max_similarity / 0.8) end as w_dup,
  case when b.contentless then b.praise_weight end as w_praise,
  case when d.in_burst then 0.30::double * least(1.0, 0.5 + d.day_share) end as w_burst,
  case when not coalesce(rv.verified_purchase, false) then 0.12::double end as w_unver,
  b.polarity, b.specificity, b.generic, b.wc, d.day_count, d.usable, rv.review_date
from rv join bare b using (product_id, review_id)
left join clu c on c.product_id = rv.product_id and c.review_id = rv.review_id
left join peak p on p.product_id = rv.product_id and p.review_id = rv.review_id
left join dayrep d on d.in_burst and d.product_id = rv.product_id and d.day = rv.review_date
  and not coalesce(regexp_matches(rv.date_raw, '(?i)\\b(ago)\\b'), false)""",
)
FRAGMENTS["scored"] = (
    ["sig"],
    """select *, score < 0.5 as passed from (select *, greatest(0.0, least(1.0,
    case when w_dup is null and w_praise is null and w_burst is null then least(total, 0.49) else total end)) as score
  from (select *, coalesce(w_dup, 0.0) + coalesce(w_praise, 0.0) + coalesce(w_burst, 0.0) + coalesce(w_unver, 0.0) as total from sig))""",
)
FRAGMENTS["topclu"] = (
    ["clu"],
    """select * from (select *, row_number() over (partition by product_id order by cluster_size desc, cluster_id) as rank
  from (select distinct product_id, cluster_id, cluster_size from clu)) where rank <= 8""",
)
FRAGMENTS["risk"] = (
    ["scored", "clu", "dayrep"],
    """select *, case when total >= 5 then cast(round_even(greatest(0.0, least(1.0,
    fail_share * 0.55 + duplicate_share * 0.30 + burst_share * 0.15)) * 100, 0) as bigint) end as risk_score
from (select t.product_id, t.total, t.failed, t.failed / t.total as fail_share,
    least(1.0, coalesce(c.clustered, 0) / t.total) as duplicate_share,
    least(1.0, coalesce(b.n, 0) / t.total) as burst_share,
    coalesce(c.n_clusters, 0) as n_clusters, coalesce(c.largest, 0) as largest
  from (select product_id, count(*) as total, count(*) filter (not passed) as failed from scored group by 1) t
  left join (select product_id, count(*) as n_clusters, sum(cluster_size) as clustered, max(cluster_size) as largest from (select distinct product_id, cluster_id, cluster_size from clu) group by 1) c using (product_id)
  left join (select product_id, sum(day_count) as n from dayrep where in_burst group by 1) b using (product_id))""",
)
FRAGMENTS["srcstat"] = (
    ["scored"],
    """select product_id, source, count(*) as n, count(rating) as n_rated, sum(rating) as rating_sum,
  case when count(rating) >= 3 then round_even(sum(rating) / count(rating), 2) end as mean_rating
from scored where passed group by 1, 2""",
)
FRAGMENTS["revsum"] = (
    ["srcstat"],
    """select product_id, sum(n) as review_count, count(source) as source_count, sum(n_rated) as rated_count,
  sum(rating_sum) as rating_sum, count(mean_rating) as rated_sources, max(mean_rating) - min(mean_rating) as spread,
  max(mean_rating) as highest_mean, min(mean_rating) as lowest_mean,
  list(source order by source) as sources,
  (list(source order by mean_rating desc, source) filter (mean_rating is not null))[1] as highest_source,
  (list(source order by mean_rating, source) filter (mean_rating is not null))[1] as lowest_source,
  string_agg(source || ' ' || printf('%.1f', round_even(mean_rating, 1)) || '/5', ', ' order by source) filter (mean_rating is not null) as listed
from srcstat group by 1""",
)
FRAGMENTS["ev"] = (
    [],
    """select *, least(1.0, greatest(0.0, severity)) * (0.4 + 0.6 * least(1.0, review_mentions / 5.0)) as weight
from (select doc_id // 100 as product_id, doc_id as pos,
  (['evidence', 'concern', 'claim_conflict'])[cast(doc_id % 3 as int) + 1] as type,
  (doc_id % 10) / 40.0 as severity, cast(doc_id % 7 as int) as review_mentions from labels)""",
)
FRAGMENTS["products"] = (
    [],
    """select p_partkey as product_id, p_brand || ' ' || p_name as product_name,
  case when p_partkey % 4 <> 0 then p_type || ' ' || p_name end as description from part""",
)
FRAGMENTS["comp"] = (
    ["risk", "revsum", "ev", "products"],
    """select *, case when rated_count > 0 then least(100.0, greatest(0.0, rating_sum / rated_count / 5 * 100)) end as customer_experience,
  greatest(0.0, least(100.0, 100.0 - risk_score)) as review_reliability_raw,
  case when risk_score is not null then greatest(0.0, least(100.0, 100.0 - risk_score)) end as review_reliability,
  case when review_count > 0 then greatest(0.0, least(100.0, 100.0 - concern_penalty * 25)) end as recurring_complaints,
  case when rated_sources >= 2 then greatest(0.0, least(100.0, 100.0 - spread * 40)) end as external_evidence,
  case when claim_attempted then greatest(0.0, least(100.0, 100.0 - conflict_penalty * 35)) end as claim_consistency,
  case when review_count > 0 then least(100.0, review_count / 12 * 100) * 0.7 + least(100.0, source_count * 50.0) * 0.3 end as evidence_confidence
from (select r.product_id, r.total, r.failed, r.risk_score,
    case when risk_score is null then 'insufficient_data' when risk_score >= 60 then 'high' when risk_score >= 30 then 'medium' else 'low' end as risk_level,
    coalesce(s.review_count, 0) as review_count, coalesce(s.source_count, 0) as source_count,
    coalesce(s.rated_count, 0) as rated_count, s.rating_sum, coalesce(s.rated_sources, 0) as rated_sources, s.spread,
    coalesce(e.concern_penalty, 0.0) as concern_penalty, coalesce(e.conflict_penalty, 0.0) as conflict_penalty,
    coalesce(e.concerns, 0) as concern_count, coalesce(e.conflicts, 0) as conflict_count,
    coalesce(length(p.description) > 0, false) as claim_attempted
  from risk r left join revsum s using (product_id)
  left join (select product_id, sum(weight) filter (type = 'concern') as concern_penalty,
      sum(weight) filter (type = 'claim_conflict') as conflict_penalty,
      count(*) filter (type = 'concern') as concerns, count(*) filter (type = 'claim_conflict') as conflicts
    from ev group by 1) e using (product_id)
  left join products p using (product_id))""",
)
_KEYS = ["customer_experience", "review_reliability", "recurring_complaints", "external_evidence", "claim_consistency", "evidence_confidence"]
_WEIGHTS = [0.25, 0.15, 0.15, 0.15, 0.15, 0.15]
_SCORE = " + ".join(f"coalesce({k} * {w}, 0.0)" for k, w in zip(_KEYS, _WEIGHTS))
_WEIGHT = " + ".join(f"(case when {k} is not null then {w} else 0.0 end)" for k, w in zip(_KEYS, _WEIGHTS))
FRAGMENTS["trust"] = (
    ["comp"],
    f"""select *, case when confidence = 'none' or review_count <= 0 then 'INSUFFICIENT_DATA'
    when adjusted >= 75 then 'BUY_WITH_CONFIDENCE' when adjusted >= 55 then 'BUY_WITH_CAUTION'
    when adjusted >= 35 then 'PROCEED_WITH_CAUTION' else 'AVOID' end as recommendation
from (select *, overall - case risk_level when 'high' then 30 when 'medium' then 15 else 0 end as adjusted,
    case when least(review_count, 60) = 0 then 'none' when least(review_count, 60) < 12 then 'low'
      when source_count < 2 or least(review_count, 60) < 35 then 'medium' else 'high' end as confidence
  from (select *, cast(round_even(cast({_SCORE} as double) / cast({_WEIGHT} as double), 0) as bigint) as overall from comp))""",
)
