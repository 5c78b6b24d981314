"""Per-review suspicion: four explainable signals, one score, one verdict.

Reviews are annotated, never removed. Review text is measured in the map stage and does
not travel through the joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewtrust.config import DEFAULTS, Settings
from reviewtrust.functions.numbers import clamp, fixed, half_even, join_text
from reviewtrust.functions.sentiment import (
    contentless,
    contentless_detail,
    contentless_weight,
    with_sentiment,
)
from reviewtrust.operators.pacing import burst_days, burst_detail, burst_weight, usable_date

KEY = ["product_id", "review_id"]
SIGNALS = "array<struct<rule:string,weight:double,detail:string>>"


def duplicate_weight(settings: Settings = DEFAULTS) -> Column:
    size_factor = F.least(F.lit(1.0), F.lit(0.45) + F.lit(0.11) * (F.col("cluster_size") - 2))
    return (
        F.lit(settings.weight_duplicate)
        * size_factor
        * F.least(F.lit(1.0), F.col("max_similarity") / F.lit(0.8))
    )


def duplicate_detail() -> Column:
    return join_text(
        "near-duplicate of ",
        F.col("cluster_size") - 1,
        " other review(s) (peak similarity ",
        fixed(F.col("max_similarity"), 2),
        "); cluster of ",
        F.col("cluster_size"),
    )


def verification_detail() -> Column:
    return F.when(
        F.col("verified_purchase") == F.lit(False), F.lit("no verified-purchase badge")
    ).otherwise(F.lit("site did not indicate whether the purchase was verified"))


def confidence_band(score: Column) -> Column:
    return (
        F.when(score >= 0.75, "high")
        .when(score >= 0.5, "medium")
        .when(score >= 0.25, "low")
        .otherwise("none")
    )


def _signal(rule: str, fired: Column, weight: Column, detail: Column) -> Column:
    return F.when(
        fired, F.struct(F.lit(rule).alias("rule"), weight.alias("weight"), detail.alias("detail"))
    )


def measure(
    reviews: DataFrame,
    settings: Settings = DEFAULTS,
    keep: tuple[str, ...] = ("source", "rating"),
    words: str | None = None,
) -> DataFrame:
    """What the verdict needs of each review's own row; the text stays behind unless it is kept, its tokens if ``words`` names a column."""
    measured = with_sentiment(reviews, praise_only=True, words=words)
    return measured.select(
        *KEY,
        *keep,
        *([words] if words else []),
        *(c for c in ("verified_purchase", "review_date", "date_raw") if c not in keep),
        _signal(
            "contentless_praise", contentless(), contentless_weight(settings), contentless_detail()
        ).alias("praise"),
    )


def score_reviews(
    reviews: DataFrame,
    clusters: DataFrame,
    settings: Settings = DEFAULTS,
    keep: tuple[str, ...] = ("source", "rating"),
) -> DataFrame:
    """Score and judge every review.

    ``clusters`` is the output of :func:`duplicates.review_clusters`; ``keep`` names review
    columns to carry along.
    """
    return score_measured(measure(reviews, settings, keep), clusters, burst_days(reviews, settings), settings, keep)


def score_measured(
    measured: DataFrame,
    clusters: DataFrame,
    bursts: DataFrame,
    settings: Settings = DEFAULTS,
    keep: tuple[str, ...] = ("source", "rating"),
) -> DataFrame:
    """Score and judge the rows of :func:`measure`; ``bursts`` are the rows of :func:`pacing.burst_days`."""
    bursts = bursts.select("product_id", "day", "day_count", "usable_dates", "day_share")
    dated = measured.withColumn("day", F.when(usable_date(), F.col("review_date")))
    joined = dated.join(
        clusters.select(*KEY, "cluster_size", "max_similarity"), KEY, "left"
    ).join(bursts, ["product_id", "day"], "left")
    signals = F.array_compact(
        F.array(
            _signal(
                "duplicate_phrasing",
                F.col("cluster_size") >= 2,
                duplicate_weight(settings),
                duplicate_detail(),
            ),
            F.col("praise"),
            _signal(
                "submission_burst",
                F.col("day_count").isNotNull(),
                burst_weight(settings),
                burst_detail(),
            ),
            _signal(
                "unverified_purchase",
                ~F.coalesce("verified_purchase", F.lit(False)),
                F.lit(settings.weight_unverified),
                verification_detail(),
            ),
        )
    ).cast(SIGNALS)
    scored = joined.select(
        *KEY, *keep, *(c for c in ("verified_purchase",) if c not in keep), signals.alias("signals")
    )
    return judge(scored, settings)


def judge(scored: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Turn ``signals`` into score, verdict and confidence."""
    total = F.aggregate("signals", F.lit(0.0), lambda acc, s: acc + s["weight"])
    substantive = F.exists("signals", lambda s: s["rule"] != "unverified_purchase")
    # A weak signal alone must stay below the threshold, whatever the weights are.
    guarded = F.when(substantive, total).otherwise(
        F.least(total, F.lit(settings.filter_threshold - 0.01))
    )
    scored = scored.withColumn("score", clamp(guarded, 0.0, 1.0))
    return scored.withColumns(
        {
            "passed": F.col("score") < settings.filter_threshold,
            "confidence": confidence_band(F.col("score")),
            "rules": F.transform("signals", lambda s: s["rule"]),
        }
    )


def unfiltered(reviews: DataFrame, keep: tuple[str, ...] = ("source", "rating")) -> DataFrame:
    """The verdict every review gets when filtering is switched off."""
    return reviews.select(
        *KEY,
        *keep,
        "verified_purchase",
        F.array().cast(SIGNALS).alias("signals"),
        F.lit(0.0).alias("score"),
        F.lit(True).alias("passed"),
        F.lit("none").alias("confidence"),
        F.array().cast("array<string>").alias("rules"),
    )


def rounded_signals() -> Column:
    """Signals as reported: weights to three decimals."""
    return F.transform(
        "signals",
        lambda s: F.struct(
            s["rule"].alias("rule"),
            half_even(s["weight"], 3).alias("weight"),
            s["detail"].alias("detail"),
        ),
    )


def rejected_audit(verdicts: DataFrame) -> DataFrame:
    """One row per failed review for the log: no author, a short excerpt only.

    ``verdicts`` must carry ``source`` and ``excerpt`` (first 80 characters).
    """
    return verdicts.where(~F.col("passed")).select(
        *KEY,
        F.lit("review_filtered").alias("event_type"),
        "source",
        half_even(F.col("score"), 3).alias("score"),
        "rules",
        "excerpt",
    )


def rule_counts(verdicts: DataFrame) -> DataFrame:
    return (
        verdicts.select("product_id", F.explode("rules").alias("rule"))
        .groupBy("product_id", "rule")
        .agg(F.count("*").alias("n"))
    )


def filter_report(verdicts: DataFrame, pacing: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Totals, rule counts and pacing per product."""
    rules = ["contentless_praise", "duplicate_phrasing", "submission_burst", "unverified_purchase"]
    counted = verdicts.groupBy("product_id").agg(
        F.count("*").alias("total"),
        F.count_if("passed").alias("passed"),
        *[F.count_if(F.array_contains("rules", r)).alias(f"n_{r}") for r in rules],
    )
    as_map = F.map_filter(
        F.create_map(*[x for r in rules for x in (F.lit(r), F.col(f"n_{r}"))]),
        lambda _, n: n > 0,
    )
    return counted.join(pacing, "product_id", "left").select(
        "product_id",
        "total",
        "passed",
        (F.col("total") - F.col("passed")).alias("failed"),
        F.lit(settings.filter_threshold).alias("threshold"),
        as_map.alias("rule_counts"),
        F.struct(
            "analyzed", "usable_dates", "distinct_days", "span_days", "burst_days", "note"
        ).alias("pacing"),
        F.array_compact(F.array(F.concat(F.lit("pacing: "), F.col("note")))).alias("notes"),
    )
