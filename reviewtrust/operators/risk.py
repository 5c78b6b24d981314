"""Review risk: counted patterns of a review set turned into a 0-100 read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewtrust.config import DEFAULTS, Settings
from reviewtrust.functions.numbers import clamp, join_text, percent, whole

# Fixed value: shown with every risk read.
DISCLAIMER = (
    "Review Risk is an AI-generated assessment of observable patterns, not a "
    "definitive determination of review authenticity."
)


def risk_level(score: Column) -> Column:
    return (
        F.when(score.isNull(), "insufficient_data")
        .when(score >= 60, "high")
        .when(score >= 30, "medium")
        .otherwise("low")
    )


def _signal(fired: Column, label: str, detail: Column) -> Column:
    return F.when(fired, F.struct(F.lit(label).alias("label"), detail.alias("detail")))


def review_risk(
    totals: DataFrame, clusters: DataFrame, pacing: DataFrame, settings: Settings = DEFAULTS
) -> DataFrame:
    """Risk per product.

    ``totals`` has (product_id, total, failed); every cluster counts, and the
    denominator is every review, dated or not.
    """
    biggest = (
        clusters.select("product_id", "cluster_id", "cluster_size")
        .distinct()
        .groupBy("product_id")
        .agg(
            F.count("*").alias("n_clusters"),
            F.sum("cluster_size").alias("clustered"),
            F.max("cluster_size").alias("largest"),
        )
    )
    bursts = pacing.select(
        "product_id", F.when(F.col("analyzed"), F.col("burst_reviews")).alias("burst_reviews")
    )
    rows = (
        totals.select("product_id", "total", "failed")
        .join(biggest, "product_id", "left")
        .join(bursts, "product_id", "left")
        .na.fill(0, ["n_clusters", "clustered", "largest", "burst_reviews"])
    )
    total = F.col("total")
    rows = rows.withColumns(
        {
            "fail_share": F.when(total > 0, F.col("failed") / total),
            "duplicate_share": F.when(
                total > 0, F.least(F.lit(1.0), F.col("clustered") / total)
            ),
            "burst_share": F.when(
                total > 0, F.least(F.lit(1.0), F.col("burst_reviews") / total)
            ),
        }
    )
    raw = (
        F.col("fail_share") * 0.55 + F.col("duplicate_share") * 0.30 + F.col("burst_share") * 0.15
    )
    score = F.when(total >= settings.min_reviews, whole(clamp(raw, 0.0, 1.0) * 100))
    failed = join_text(
        F.col("failed"), " of ", total, " reviews (", percent(F.col("fail_share")),
        ") showed patterns that failed automated review-pattern filtering before reaching "
        "this analysis.",
    )
    repeated = join_text(
        "Found ", F.col("n_clusters"),
        " group(s) of reviews with unusually similar wording, the largest spanning ",
        F.col("largest"),
        " reviews. This is a pattern worth noting, not proof any individual review is fake.",
    )
    concentrated = join_text(
        "About ", percent(F.col("burst_share")),
        " of reviews were posted in short, concentrated bursts rather than spread out over time.",
    )
    nothing = F.array(
        F.struct(
            F.lit("No notable patterns").alias("label"),
            F.lit("No unusual duplication or submission-timing patterns were observed.").alias(
                "detail"
            ),
        )
    )
    found = F.array_compact(
        F.array(
            _signal(F.col("failed") > 0, "Reviews flagged by automated filtering", failed),
            _signal(F.col("n_clusters") > 0, "Repeated phrasing across reviews", repeated),
            _signal(F.col("burst_share") > 0, "Unusual submission pattern", concentrated),
        )
    )
    rows = rows.withColumn("risk_score", score)
    known = F.col("risk_score").isNotNull()
    return rows.select(
        "product_id",
        "total",
        "failed",
        "fail_share",
        "duplicate_share",
        "burst_share",
        "n_clusters",
        "risk_score",
        risk_level(F.col("risk_score")).alias("risk_level"),
        F.when(known & (F.size(found) > 0), found)
        .when(known, nothing)
        .otherwise(F.array().cast("array<struct<label:string,detail:string>>"))
        .alias("risk_signals"),
        F.lit(DISCLAIMER).alias("disclaimer"),
        F.when(
            ~known, F.lit("Too few reviews were collected to assess risk reliably.")
        ).alias("risk_note"),
    )
