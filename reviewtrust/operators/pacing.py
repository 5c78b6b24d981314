"""Submission bursts: days holding far more of a product's reviews than its usual day.

Reviews are first counted per (product, day) with map-side combining. Everything after
that works on day rows, of which a product has at most one per calendar day, so even the
largest product is a small group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewtrust.config import DEFAULTS, Settings
from reviewtrust.functions.lexicon import IMPRECISE_DATE_PATTERN
from reviewtrust.functions.numbers import join_text


def is_imprecise(date_raw: Column) -> Column:
    """Was the date relative on the page?"""
    return F.coalesce(date_raw.rlike("(?iU)" + IMPRECISE_DATE_PATTERN), F.lit(False))


def usable_date() -> Column:
    return F.col("review_date").isNotNull() & ~is_imprecise(F.col("date_raw"))


def day_counts(reviews: DataFrame) -> DataFrame:
    return (
        reviews.where(usable_date())
        .groupBy("product_id", F.col("review_date").alias("day"))
        .agg(F.count("*").alias("n"))
    )


def day_report(reviews: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """One row per (product, day) with the product's statistics and the burst flag."""
    of_product = Window.partitionBy("product_id")
    n, days = F.col("n"), F.col("distinct_days")
    stats = day_counts(reviews).withColumns(
        {
            "usable_dates": F.sum("n").over(of_product),
            "distinct_days": F.count("*").over(of_product),
            "sum_sq": F.sum(n * n).over(of_product),
            "median_per_day": F.percentile("n", 0.5).over(of_product),
            "first_day": F.min("day").over(of_product),
            "last_day": F.max("day").over(of_product),
        }
    )
    # Population deviation from whole-number sums: exact for ties, whatever the row order.
    spread = F.when(
        days > 1,
        F.sqrt((days * F.col("sum_sq") - F.col("usable_dates") * F.col("usable_dates")).cast("double"))
        / days,
    ).otherwise(F.lit(0.0))
    threshold = F.greatest(
        F.lit(float(settings.min_burst)),
        F.col("median_per_day")
        + F.lit(settings.burst_multiplier) * F.greatest(spread, F.lit(settings.min_spread)),
    )
    share = n / F.col("usable_dates")
    analyzed = F.col("usable_dates") >= settings.pacing_min_dated
    burst = analyzed & (
        (n >= threshold) | ((share >= settings.dominant_share) & (n >= settings.min_burst))
    )
    return stats.select(
        "product_id",
        "day",
        n.alias("day_count"),
        "usable_dates",
        "distinct_days",
        "median_per_day",
        (F.datediff("last_day", "first_day") + 1).alias("span_days"),
        share.alias("day_share"),
        analyzed.alias("analyzed"),
        burst.alias("in_burst"),
    )


def burst_days(reviews: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    return day_report(reviews, settings).where("in_burst")


def pacing_report(reviews: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """One row per product: sample size, span, burst days and the reason if not analyzed."""
    return pacing_of_days(reviews.select("product_id").distinct(), day_report(reviews, settings), settings)


def pacing_of_days(products: DataFrame, days: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """The same for distinct products, of the rows of :func:`day_report`."""
    per_product = (
        days.groupBy("product_id")
        .agg(
            F.first("usable_dates").alias("usable_dates"),
            F.first("distinct_days").alias("distinct_days"),
            F.first("span_days").alias("span_days"),
            F.first("median_per_day").alias("median_per_day"),
            F.first("analyzed").alias("analyzed"),
            F.map_from_entries(
                F.sort_array(
                    F.collect_list(F.when(F.col("in_burst"), F.struct("day", "day_count")))
                )
            ).alias("burst_days"),
            F.sum(F.when(F.col("in_burst"), F.col("day_count"))).alias("burst_reviews"),
        )
    )
    usable = F.coalesce("usable_dates", F.lit(0))
    done = F.coalesce("analyzed", F.lit(False))
    return products.join(per_product, "product_id", "left").select(
        "product_id",
        usable.cast("bigint").alias("usable_dates"),
        F.when(done, F.col("distinct_days")).otherwise(F.lit(0)).cast("bigint").alias("distinct_days"),
        F.when(done, F.col("span_days")).otherwise(F.lit(0)).cast("bigint").alias("span_days"),
        F.when(done, F.col("median_per_day")).otherwise(F.lit(0.0)).alias("median_per_day"),
        done.alias("analyzed"),
        F.coalesce("burst_days", F.create_map().cast("map<date,bigint>")).alias("burst_days"),
        F.coalesce("burst_reviews", F.lit(0)).cast("bigint").alias("burst_reviews"),
        F.when(
            ~done,
            join_text(
                "only ",
                usable,
                " review(s) carry a precise date; ",
                settings.pacing_min_dated,
                " are needed before clustering means anything",
            ),
        ).alias("note"),
    )


def burst_weight(settings: Settings = DEFAULTS) -> Column:
    return F.lit(settings.weight_burst) * F.least(F.lit(1.0), F.lit(0.5) + F.col("day_share"))


def burst_detail() -> Column:
    return join_text(
        "unnatural submission pacing — ",
        F.col("day_count"),
        " of ",
        F.col("usable_dates"),
        " dated reviews posted on ",
        F.col("day"),
    )
