"""The flagship job: reviews in, one trust row per product out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewtrust.config import DEFAULTS, Settings
from reviewtrust.operators import score as S
from reviewtrust.operators.duplicates import clusters_of_sets, review_clusters_of_sets, review_sets
from reviewtrust.operators.pacing import burst_days, day_report, pacing_of_days
from reviewtrust.operators.risk import review_risk
from reviewtrust.operators.suspicion import measure, score_measured
from reviewtrust.operators.verdict import confidence_ceiling, run_status
from reviewtrust.session import Workspace


def judged_reviews(
    reviews: DataFrame, settings: Settings = DEFAULTS, keep: tuple[str, ...] = ("source", "rating")
) -> tuple[DataFrame, DataFrame]:
    """Verdict per review, and the clusters behind it, with exact peak similarities for the details.

    Reviews are read once: clusters, bursts and verdicts come from one written table.
    """
    measured = measured_reviews(reviews, settings, keep)
    clusters = Workspace(reviews.sparkSession, "clusters").write(review_clusters_of_sets(measured, settings))
    return score_measured(measured.drop("words", "copy_key"), clusters, burst_days(measured, settings), settings, keep), clusters


def measured_reviews(reviews: DataFrame, settings: Settings = DEFAULTS, keep: tuple[str, ...] = ("source", "rating")) -> DataFrame:
    """One written table with all that is read from a review's row: its sets, its praise signal, its dates."""
    facts = tuple(dict.fromkeys((*keep, "verified_purchase", "review_date", "date_raw")))
    rows = measure(reviews, settings, facts, words="_tokens")
    return Workspace(reviews.sparkSession, "measured").write(review_sets(rows, (*facts, "praise"), words="_tokens"))


def trust_inputs(
    reviews: DataFrame,
    products: DataFrame,
    evidence: DataFrame,
    videos: DataFrame | None = None,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Everything the score needs, one row per product."""
    measured, space = measured_reviews(reviews, settings), Workspace(reviews.sparkSession, "clusters")
    clusters = space.write(clusters_of_sets(measured, settings))
    days = space.write(day_report(measured, settings))
    rows = measured.drop("words", "copy_key")
    verdicts = score_measured(rows, clusters, days.where("in_burst"), settings)
    # One pass over the verdicts gives per-source counts of all and of surviving reviews.
    alive = F.col("passed")
    per_source = Workspace(reviews.sparkSession, "sources").write(
        verdicts.groupBy("product_id", "source").agg(
            F.count("*").alias("total"),
            F.count_if(alive).alias("n"),
            F.count(F.when(alive, F.col("rating"))).alias("n_rated"),
            F.sum(F.when(alive, F.col("rating"))).alias("rating_sum"),
        )
    )
    totals = per_source.groupBy("product_id").agg(
        F.sum("total").alias("total"), F.sum(F.col("total") - F.col("n")).alias("failed")
    )
    risk = review_risk(totals, clusters, pacing_of_days(totals.select("product_id"), days, settings), settings)
    survivors = S.review_summary(per_source.where("n > 0").drop("total"))
    penalties = S.evidence_penalties(S.evidence_totals(evidence))
    rows = (
        risk.join(survivors, "product_id", "left")
        .join(penalties, "product_id", "left")
        .join(products, "product_id", "left")
    )
    if videos is not None:
        counted = videos.groupBy("product_id").agg(F.count("*").alias("n_videos"))
        rows = rows.join(counted, "product_id", "left")
    else:
        rows = rows.withColumn("n_videos", F.lit(0))
    zero = F.lit(0)
    rows = rows.withColumns(
        {
            "review_count": F.coalesce("review_count", zero),
            "source_count": F.coalesce("source_count", zero),
            "rated_count": F.coalesce("rated_count", zero),
            "rated_sources": F.coalesce("rated_sources", zero),
            "concern_penalty": F.coalesce("concern_penalty", F.lit(0.0)),
            "conflict_penalty": F.coalesce("conflict_penalty", F.lit(0.0)),
            "concern_count": F.coalesce("concern_count", zero),
            "conflict_count": F.coalesce("conflict_count", zero),
            "claim_attempted": F.coalesce(F.length("description") > 0, F.lit(False)),
        }
    )
    # Videos stand in as evidence only when no review survived.
    return rows.withColumn(
        "video_count",
        F.when(F.col("review_count") == 0, F.coalesce("n_videos", zero)).otherwise(zero),
    )


def analyze(
    reviews: DataFrame,
    products: DataFrame,
    evidence: DataFrame,
    videos: DataFrame | None = None,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Status, risk, six components, overall score and recommendation per product."""
    rows = S.score_breakdown(
        trust_inputs(reviews, products, evidence, videos, settings), settings
    )
    used = F.least(F.col("review_count"), F.lit(settings.prompt_max_reviews))
    rows = rows.withColumn(
        "confidence", confidence_ceiling(used, F.col("source_count"), settings)
    )
    return rows.select(
        "product_id",
        run_status(F.col("review_count"), settings).alias("status"),
        "total",
        F.col("review_count").alias("passed"),
        "failed",
        "risk_score",
        "risk_level",
        *[name for name, _ in S.COMPONENTS],
        "overall",
        "confidence",
        S.recommendation(F.col("overall"), F.col("confidence"), used, F.col("risk_level")).alias(
            "recommendation"
        ),
        "components",
        "explanation",
    )
