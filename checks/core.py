"""Registered queries of the review core: text, duplicates, pacing, suspicion, risk, score."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.core_sql import FRAGMENTS, array, compose, fixed, normalize, percent, squeeze, words  # noqa: F401
from reviewtrust.functions import sentiment as SE
from reviewtrust.functions import text as X
from reviewtrust.operators import duplicates as D
from reviewtrust.operators import pacing as P
from reviewtrust.operators import risk as R
from reviewtrust.operators import score as S
from reviewtrust.operators import suspicion as SU
from reviewtrust.operators import verdict as V
from reviewtrust.plans import trust
from reviewtrust.sources import tables as T

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf: str) -> DataFrame:
            # Table times carry no zone; the check SQL reads them as UTC.
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def r6(col):
    return F.round(col, 6)


def long(col):
    return F.col(col).cast("bigint") if isinstance(col, str) else col.cast("bigint")


# ------------------------------------------------------------------ flagship

_COMPONENTS = ", ".join(f"round({k}, 6) as {k}" for k, _ in S.COMPONENTS)


@query(
    "trust_score",
    compose(
        ["trust"],
        f"""select product_id, case when review_count >= 5 then 'ok' else 'not_enough_data' end as status,
cast(total as bigint) as total, cast(review_count as bigint) as passed, cast(failed as bigint) as failed,
risk_score, risk_level, {_COMPONENTS}, overall, confidence, recommendation from trust""",
    ),
)
def trust_score(spark: SparkSession, sf: str) -> DataFrame:
    df = trust.analyze(T.reviews(spark, sf), T.products(spark, sf), T.evidence(spark, sf), T.videos(spark, sf))
    return df.select(
        "product_id", "status", long("total").alias("total"), long("passed").alias("passed"),
        long("failed").alias("failed"), "risk_score", "risk_level",
        *[r6(F.col(k)).alias(k) for k, _ in S.COMPONENTS], long("overall").alias("overall"),
        "confidence", "recommendation",
    )


# ------------------------------------------------------------------ text


@query("normalize_text", compose(["rv"], f"select review_id, {normalize('text')} as normalized from rv"))
def normalize_text(spark, sf):
    return T.reviews(spark, sf).select("review_id", X.normalize(F.col("text")).alias("normalized"))


@query(
    "token_counts",
    compose(
        ["tok"],
        f"""select review_id, cast(len(w) as bigint) as n_tokens,
cast(len(list_filter(w, lambda t: not list_contains({array(__import__('reviewtrust.functions.lexicon', fromlist=['x']).STOP_WORDS)}, t))) as bigint) as n_content,
array_to_string(w, ' ') as joined from tok""",
    ),
)
def token_counts(spark, sf):
    text = F.col("text")
    return T.reviews(spark, sf).select(
        "review_id",
        long(F.size(X.tokens(text))).alias("n_tokens"),
        long(F.size(X.tokens(text, drop_stop_words=True))).alias("n_content"),
        F.array_join(X.tokens(text), " ").alias("joined"),
    )


@query(
    "shingle_sets",
    compose(
        ["sets"],
        """select review_id, cast(len(s2) as bigint) as n_pairs, cast(len(s3) as bigint) as n_triples,
cast(len(sc) as bigint) as n_content, array_to_string(list_sort(s3), '|') as triples from sets""",
    ),
)
def shingle_sets(spark, sf):
    w = T.reviews(spark, sf).select("review_id", X.tokens(F.col("text")).alias("w"))
    return w.select(
        "review_id",
        long(F.size(X.shingles(F.col("w"), 2))).alias("n_pairs"),
        long(F.size(X.shingles(F.col("w"), 3))).alias("n_triples"),
        long(F.size(X.hashed_content(F.col("w")))).alias("n_content"),
        F.array_join(F.array_sort(X.shingles(F.col("w"), 3)), "|").alias("triples"),
    )


@query(
    "sentence_counts",
    compose(["rv"], "select review_id, cast(greatest(1, len(regexp_extract_all(text, '[.!?]+'))) as bigint) as sentences from rv"),
)
def sentence_counts(spark, sf):
    return T.reviews(spark, sf).select("review_id", long(X.sentence_count(F.col("text"))).alias("sentences"))


@query(
    "sentiment",
    compose(
        ["bare"],
        """select review_id, cast(wc as bigint) as word_count, round(polarity, 6) as polarity, round(intensity, 6) as intensity,
round(generic_ratio, 6) as generic_ratio, round(specificity, 6) as specificity, array_to_string(generic, '|') as generic_phrases,
array_to_string(markers, '|') as specific_markers, contentless from bare""",
    ),
)
def sentiment(spark, sf):
    m = SE.with_sentiment(T.reviews(spark, sf))
    return m.select(
        "review_id", long("word_count").alias("word_count"), r6(F.col("polarity")).alias("polarity"),
        r6(F.col("intensity")).alias("intensity"), r6(F.col("generic_ratio")).alias("generic_ratio"),
        r6(F.col("specificity")).alias("specificity"),
        F.array_join("generic_phrases", "|").alias("generic_phrases"),
        F.array_join("specific_markers", "|").alias("specific_markers"),
        SE.contentless().alias("contentless"),
    )


# ------------------------------------------------------------------ duplicates


FRAGMENTS["copylinks"] = (
    ["tok"],
    """select product_id, min(review_id) as first_id, count(*) as n, array_to_string(w, ' ') as k from tok
where len(w) > 0 group by product_id, array_to_string(w, ' ') having count(*) > 1""",
)
FRAGMENTS["copies"] = (
    ["copylinks", "tok"],
    """select c.product_id, c.first_id as left_id, t.review_id as right_id from copylinks c
join tok t on t.product_id = c.product_id and array_to_string(t.w, ' ') = c.k and t.review_id > c.first_id""",
)


@query("candidate_pairs", compose(["textlinks"], "select product_id, l as left_id, r as right_id from textlinks"))
def candidate_pairs(spark, sf):
    """The candidates among different texts that prove similar."""
    return D.text_links(T.reviews(spark, sf)).drop("similarity")


@query(
    "pair_similarity",
    compose(
        ["textlinks", "copies"],
        """select product_id, l as left_id, r as right_id, round(similarity, 6) as similarity from textlinks
union all select product_id, left_id, right_id, 1.0 from copies""",
    ),
)
def pair_similarity(spark, sf):
    return D.near_duplicate_edges(T.reviews(spark, sf)).withColumn("similarity", r6(F.col("similarity")))


FRAGMENTS["nbr"] = (
    ["edges"],
    """select product_id, review_id, string_agg(cast(o as varchar), ',' order by o) as similar_to from (
  select *, row_number() over (partition by product_id, review_id order by o) as rn from (
    select product_id, l as review_id, r as o from edges union all select product_id, r, l from edges)) where rn <= 5 group by 1, 2""",
)


@query(
    "duplication_findings",
    compose(
        ["rv", "clu", "peak", "nbr"],
        """select rv.product_id, rv.review_id, round(coalesce(p.max_similarity, 0.0), 6) as max_similarity,
coalesce(c.cluster_size, 1) as cluster_size, coalesce(c.cluster_id, -1) as cluster_id, coalesce(n.similar_to, '') as similar_to
from rv left join clu c using (product_id, review_id) left join peak p using (product_id, review_id)
left join nbr n using (product_id, review_id)""",
    ),
)
def duplication_findings(spark, sf):
    f = D.duplication_findings(T.reviews(spark, sf))
    return f.withColumn("max_similarity", r6(F.col("max_similarity"))).withColumn(
        "similar_to", F.array_join(F.col("similar_to").cast("array<string>"), ",")
    )


@query(
    "cluster_summary",
    compose(
        ["topclu", "clu", "rv"],
        """select t.product_id, cast(t.rank as bigint) as rank, t.cluster_id, t.cluster_size,
(select string_agg(cast(review_id as varchar), ',' order by review_id) from (
   select c.review_id, row_number() over (order by c.review_id) as rn from clu c
   where c.product_id = t.product_id and c.cluster_id = t.cluster_id) where rn <= 12) as review_ids,
left(rv.text, 160) as sample
from topclu t join rv on rv.product_id = t.product_id and rv.review_id = t.cluster_id""",
    ),
)
def cluster_summary(spark, sf):
    reviews = T.reviews(spark, sf)
    s = D.cluster_summary(reviews, D.review_clusters(reviews))
    return s.withColumn("review_ids", F.array_join(F.col("review_ids").cast("array<string>"), ",")).withColumn(
        "rank", long("rank")
    )


@query("exact_copies", compose(["copies"], "select * from copies"))
def exact_copies(spark, sf):
    return D.exact_copy_links(T.reviews(spark, sf)).drop("similarity")


# ------------------------------------------------------------------ pacing


@query(
    "burst_days",
    compose(
        ["dayrep"],
        """select product_id, cast(day as varchar) as day, day_count, cast(usable as bigint) as usable_dates, nd as distinct_days,
span as span_days, round(med, 6) as median_per_day, round(day_share, 6) as day_share, in_burst from dayrep""",
    ),
)
def burst_days(spark, sf):
    return P.day_report(T.reviews(spark, sf)).select(
        "product_id", F.col("day").cast("string").alias("day"), "day_count", "usable_dates",
        "distinct_days", long("span_days").alias("span_days"), r6(F.col("median_per_day")).alias("median_per_day"),
        r6(F.col("day_share")).alias("day_share"), "in_burst",
    )


@query(
    "pacing_report",
    compose(
        ["dayrep", "rv"],
        """select p.product_id, coalesce(cast(r.usable as bigint), 0) as usable_dates, coalesce(r.usable >= 8, false) as analyzed,
case when r.usable >= 8 then r.nd else 0 end as distinct_days, case when r.usable >= 8 then r.span else 0 end as span_days,
coalesce(r.bursts, '') as burst_days,
case when not coalesce(r.usable >= 8, false) then 'only ' || cast(coalesce(r.usable, 0) as varchar) || ' review(s) carry a precise date; 8 are needed before clustering means anything' end as note
from (select distinct product_id from rv) p left join (
  select product_id, any_value(usable) as usable, any_value(nd) as nd, any_value(span) as span,
    string_agg(cast(day as varchar) || '=' || cast(day_count as varchar), ',' order by day) filter (in_burst) as bursts
  from dayrep group by 1) r using (product_id)""",
    ),
)
def pacing_report(spark, sf):
    bursts = F.array_join(
        F.transform(
            F.array_sort(F.map_entries("burst_days")),
            lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"].cast("string")),
        ),
        ",",
    )
    return P.pacing_report(T.reviews(spark, sf)).select(
        "product_id", "usable_dates", "analyzed", "distinct_days", "span_days", bursts.alias("burst_days"), "note"
    )


@query(
    "imprecise_dates",
    compose(
        ["rv"],
        """select review_id, coalesce(regexp_matches(date_raw, '(?i)\\b(ago|today|yesterday|just now|recently|last (?:week|month))\\b'), false) as imprecise from rv""",
    ),
)
def imprecise_dates(spark, sf):
    return T.reviews(spark, sf).select("review_id", P.is_imprecise(F.col("date_raw")).alias("imprecise"))


# ------------------------------------------------------------------ suspicion and risk


def _verdicts(spark, sf, keep=("source", "rating")):
    return trust.judged_reviews(T.reviews(spark, sf), keep=keep)[0]


@query(
    "review_verdicts",
    compose(
        ["scored"],
        """select product_id, review_id, round(score, 6) as score, passed,
case when score >= 0.75 then 'high' when score >= 0.5 then 'medium' when score >= 0.25 then 'low' else 'none' end as confidence,
concat_ws('|', case when w_dup is not null then 'duplicate_phrasing' end, case when w_praise is not null then 'contentless_praise' end,
  case when w_burst is not null then 'submission_burst' end, case when w_unver is not null then 'unverified_purchase' end) as rules,
round(coalesce(w_dup, 0.0), 6) as w_dup, round(coalesce(w_praise, 0.0), 6) as w_praise, round(coalesce(w_burst, 0.0), 6) as w_burst,
cast(coalesce(w_unver, 0.0) as double) as w_unver from scored""",
    ),
)
def review_verdicts(spark, sf):
    def weight(rule):
        found = F.filter("signals", lambda s: s["rule"] == rule)
        return r6(F.coalesce(F.get(found, F.lit(0))["weight"], F.lit(0.0)))

    return _verdicts(spark, sf).select(
        "product_id", "review_id", r6(F.col("score")).alias("score"), "passed", "confidence",
        F.array_join("rules", "|").alias("rules"),
        weight("duplicate_phrasing").alias("w_dup"), weight("contentless_praise").alias("w_praise"),
        weight("submission_burst").alias("w_burst"), weight("unverified_purchase").alias("w_unver"),
    )


@query(
    "signal_details",
    compose(
        ["scored"],
        f"""select * from (
select review_id, 'duplicate_phrasing' as rule, cast(printf('%.3f', w_dup) as double) as weight, 'near-duplicate of ' || cast(cluster_size - 1 as varchar)
  || ' other review(s) (peak similarity ' || {fixed('max_similarity', 2)} || '); cluster of ' || cast(cluster_size as varchar) as detail from scored where w_dup is not null
union all select review_id, 'contentless_praise', cast(printf('%.3f', w_praise) as double), 'uniform praise with no specifics — ' || concat_ws('; ',
  'polarity ' || printf('%+.2f', round_even(polarity, 2)), 'specificity ' || {fixed('specificity', 2)},
  case when len(generic) > 0 then 'stock phrases: ' || array_to_string(generic[1:3], ', ') end,
  case when wc <= 25 then 'only ' || cast(wc as varchar) || ' words' end) from scored where w_praise is not null
union all select review_id, 'submission_burst', cast(printf('%.3f', w_burst) as double), 'unnatural submission pacing — ' || cast(day_count as varchar) || ' of ' || cast(usable as varchar)
  || ' dated reviews posted on ' || cast(review_date as varchar) from scored where w_burst is not null
union all select review_id, 'unverified_purchase', cast(w_unver as double), case when verified_purchase = false then 'no verified-purchase badge'
  else 'site did not indicate whether the purchase was verified' end from scored where w_unver is not null)""",
    ),
)
def signal_details(spark, sf):
    return (
        _verdicts(spark, sf)
        .select("review_id", F.explode_outer(SU.rounded_signals()).alias("s"))
        .where(F.col("s").isNotNull())
        .select("review_id", "s.rule", "s.weight", "s.detail")
    )


@query(
    "filter_report",
    compose(
        ["scored"],
        """select product_id, count(*) as total, count(*) filter (passed) as passed, count(*) filter (not passed) as failed,
count(w_dup) as duplicate_phrasing, count(w_praise) as contentless_praise, count(w_burst) as submission_burst, count(w_unver) as unverified_purchase
from scored group by 1""",
    ),
)
def filter_report(spark, sf):
    reviews = T.reviews(spark, sf)
    verdicts, _ = trust.judged_reviews(reviews)
    report = SU.filter_report(verdicts, P.pacing_report(reviews))
    rules = ["duplicate_phrasing", "contentless_praise", "submission_burst", "unverified_purchase"]
    return report.select(
        "product_id", "total", "passed", "failed",
        *[F.coalesce(F.try_element_at("rule_counts", F.lit(r)), F.lit(0)).alias(r) for r in rules],
    )


@query(
    "rule_counts",
    compose(
        ["scored"],
        """select product_id, rule, count(*) as n from (
select product_id, unnest(list_filter([case when w_dup is not null then 'duplicate_phrasing' end, case when w_praise is not null then 'contentless_praise' end,
  case when w_burst is not null then 'submission_burst' end, case when w_unver is not null then 'unverified_purchase' end], lambda x: x is not null)) as rule from scored) group by 1, 2""",
    ),
)
def rule_counts(spark, sf):
    return SU.rule_counts(_verdicts(spark, sf))


@query(
    "rejected_audit",
    compose(
        ["scored"],
        """select product_id, review_id, 'review_filtered' as event_type, source, cast(printf('%.3f', score) as double) as score,
concat_ws('|', case when w_dup is not null then 'duplicate_phrasing' end, case when w_praise is not null then 'contentless_praise' end,
  case when w_burst is not null then 'submission_burst' end, case when w_unver is not null then 'unverified_purchase' end) as rules,
left(text, 80) as excerpt from scored where not passed""",
    ),
)
def rejected_audit(spark, sf):
    reviews = T.reviews(spark, sf).withColumn("excerpt", F.left("text", F.lit(80)))
    verdicts, _ = trust.judged_reviews(reviews, keep=("source", "excerpt"))
    return SU.rejected_audit(verdicts).withColumn("rules", F.array_join("rules", "|"))


@query(
    "unfiltered_reviews",
    compose(["rv"], "select review_id, true as passed, 0.0::double as score, 'none' as confidence from rv"),
)
def unfiltered_reviews(spark, sf):
    return SU.unfiltered(T.reviews(spark, sf)).select("review_id", "passed", "score", "confidence")


@query(
    "review_risk",
    compose(
        ["risk"],
        f"""select product_id, total, failed, round(fail_share, 6) as fail_share, round(duplicate_share, 6) as duplicate_share,
round(burst_share, 6) as burst_share, n_clusters, risk_score,
case when risk_score is null then 'insufficient_data' when risk_score >= 60 then 'high' when risk_score >= 30 then 'medium' else 'low' end as risk_level,
concat_ws(' / ', case when failed > 0 then cast(failed as varchar) || ' of ' || cast(total as varchar) || ' reviews (' || {percent('fail_share')} || ') showed patterns that failed automated review-pattern filtering before reaching this analysis.' end,
 case when n_clusters > 0 then 'Found ' || cast(n_clusters as varchar) || ' group(s) of reviews with unusually similar wording, the largest spanning ' || cast(largest as varchar) || ' reviews. This is a pattern worth noting, not proof any individual review is fake.' end,
 case when burst_share > 0 then 'About ' || {percent('burst_share')} || ' of reviews were posted in short, concentrated bursts rather than spread out over time.' end) as details
from risk""",
    ),
)
def review_risk(spark, sf):
    reviews = T.reviews(spark, sf)
    verdicts, clusters = trust.judged_reviews(reviews)
    totals = verdicts.groupBy("product_id").agg(
        F.count("*").alias("total"), F.count_if(~F.col("passed")).alias("failed")
    )
    risk = R.review_risk(totals, clusters, P.pacing_report(reviews))
    return risk.select(
        "product_id", "total", "failed", *[r6(F.col(c)).alias(c) for c in ("fail_share", "duplicate_share", "burst_share")],
        "n_clusters", "risk_score", "risk_level",
        F.array_join(F.transform("risk_signals", lambda s: s["detail"]), " / ").alias("details"),
    )
