"""Trust score: six named components, their weighted mean, and a sentence explaining it.

Rows are reduced to (product, source) and (product, type) aggregates first, with map-side
combining; everything else is column arithmetic on one row per product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewtrust.config import DEFAULTS, Settings
from reviewtrust.functions.numbers import clamp, fixed, half_even, join_text, whole

COMPONENTS = [
    ("customer_experience", "Customer experience"),
    ("review_reliability", "Review reliability"),
    ("recurring_complaints", "Recurring complaints"),
    ("external_evidence", "External evidence"),
    ("claim_consistency", "Claim consistency"),
    ("evidence_confidence", "Evidence confidence"),
]
NOT_ENOUGH = "Not enough data"


# ---------------------------------------------------------------- ratings per source


def source_stats(reviews: DataFrame) -> DataFrame:
    """Review and rating counts per (product, source)."""
    return reviews.groupBy("product_id", "source").agg(
        F.count("*").alias("n"),
        F.count("rating").alias("n_rated"),
        F.sum("rating").alias("rating_sum"),
    )


def ratings_by_source(stats: DataFrame) -> DataFrame:
    """Mean rating of every source with at least three ratings."""
    return stats.where((F.col("n_rated") >= 3) & F.col("source").isNotNull()).select(
        "product_id",
        "source",
        half_even(F.col("rating_sum") / F.col("n_rated"), 2).alias("mean_rating"),
    )


def review_summary(stats: DataFrame) -> DataFrame:
    """One row per product: counts, mean rating, per-source ratings and their spread."""
    published = (F.col("n_rated") >= 3) & F.col("source").isNotNull()
    mean = half_even(F.col("rating_sum") / F.col("n_rated"), 2)
    rows = stats.withColumn("mean_rating", F.when(published & (mean != 0), mean))
    entry = F.when(F.col("mean_rating").isNotNull(), F.struct("source", "mean_rating"))
    # Among equal means the alphabetically first source is named.
    # A source without a mean has no place in the order: min_by passes over null keys.
    rated = F.col("mean_rating").isNotNull()
    high = F.min_by("source", F.when(rated, F.struct(-F.col("mean_rating"), F.col("source"))))
    low = F.min_by("source", F.when(rated, F.struct(F.col("mean_rating"), F.col("source"))))
    return rows.groupBy("product_id").agg(
        F.sum("n").alias("review_count"),
        F.count("source").alias("source_count"),
        F.array_sort(F.collect_set("source")).alias("sources"),
        F.sum("n_rated").alias("rated_count"),
        F.sum("rating_sum").alias("rating_sum"),
        F.array_sort(F.collect_list(entry)).alias("source_ratings"),
        F.count("mean_rating").alias("rated_sources"),
        (F.max("mean_rating") - F.min("mean_rating")).alias("spread"),
        F.max("mean_rating").alias("highest_mean"),
        F.min("mean_rating").alias("lowest_mean"),
        high.alias("highest_source"),
        low.alias("lowest_source"),
    )


def divergence_note(settings: Settings = DEFAULTS) -> Column:
    """One sentence on whether sources agree; null with fewer than two rated sources."""
    listed = F.array_join(
        F.transform(
            "source_ratings",
            lambda e: F.concat(e["source"], F.lit(" "), fixed(e["mean_rating"], 1), F.lit("/5")),
        ),
        ", ",
    )
    gap = fixed(F.col("spread"), 1)
    disagree = join_text(
        "Average rating by platform: ", listed, ". These disagree by ", gap, " stars (",
        F.col("highest_source"), " rates it notably higher than ", F.col("lowest_source"),
        "). Treat this gap as a finding: mention it in the verdict and in caveats.",
    )
    agree = join_text(
        "Average rating by platform: ", listed, ". The platforms broadly agree (", gap,
        " stars apart).",
    )
    return F.when(
        F.col("rated_sources") >= 2,
        F.when(F.col("spread") >= settings.divergence_spread, disagree).otherwise(agree),
    )


# ---------------------------------------------------------------- evidence


def evidence_weight() -> Column:
    severity = F.coalesce(clamp(F.col("severity"), 0.0, 1.0), F.lit(0.5))
    mentions = F.coalesce(F.col("review_mentions"), F.lit(0))
    return severity * (F.lit(0.4) + F.lit(0.6) * F.least(F.lit(1.0), mentions / F.lit(5.0)))


def evidence_totals(evidence: DataFrame) -> DataFrame:
    """Summed weight and number of items per (product, type)."""
    return evidence.groupBy("product_id", "type").agg(
        F.sum(evidence_weight()).alias("penalty"), F.count("*").alias("items")
    )


def evidence_penalties(totals: DataFrame) -> DataFrame:
    def of(kind: str, column: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("type") == kind, F.col(column))), F.lit(0))

    return totals.groupBy("product_id").agg(
        of("concern", "penalty").cast("double").alias("concern_penalty"),
        of("claim_conflict", "penalty").cast("double").alias("conflict_penalty"),
        of("concern", "items").alias("concern_count"),
        of("claim_conflict", "items").alias("conflict_count"),
        F.sum("items").alias("evidence_count"),
    )


# ---------------------------------------------------------------- components


def customer_experience() -> Column:
    return F.when(
        F.col("rated_count") > 0,
        clamp(F.col("rating_sum") / F.col("rated_count") / F.lit(5) * F.lit(100), 0.0, 100.0),
    )


def review_reliability() -> Column:
    return clamp(F.lit(100.0) - F.col("risk_score"), 0.0, 100.0)


def recurring_complaints() -> Column:
    return F.when(
        F.col("review_count") > 0,
        clamp(F.lit(100.0) - F.col("concern_penalty") * 25, 0.0, 100.0),
    )


def claim_consistency() -> Column:
    return F.when(
        F.col("claim_attempted"),
        clamp(F.lit(100.0) - F.col("conflict_penalty") * 35, 0.0, 100.0),
    )


def external_evidence() -> Column:
    consistency = F.when(
        F.col("rated_sources") >= 2, clamp(F.lit(100.0) - F.col("spread") * 40, 0.0, 100.0)
    )
    corroboration = F.when(
        F.col("video_count") > 0, F.least(F.lit(100.0), F.col("video_count") * F.lit(25.0))
    )
    both = consistency.isNotNull() & corroboration.isNotNull()
    return F.when(both, (consistency + corroboration) / 2).otherwise(
        F.coalesce(consistency, corroboration)
    )


def evidence_confidence(settings: Settings = DEFAULTS) -> Column:
    volume = F.least(F.lit(100.0), F.col("review_count") / F.lit(settings.volume_target) * 100)
    diversity = F.least(F.lit(100.0), F.col("source_count") * F.lit(50.0))
    return F.when(F.col("review_count") > 0, volume * 0.7 + diversity * 0.3)


def with_components(rows: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Add the six component values.

    ``rows``: product_id, review_count, source_count, rated_count, rating_sum,
    rated_sources, spread, risk_score, concern_penalty, conflict_penalty, video_count,
    claim_attempted.
    """
    return rows.withColumns(
        {
            "customer_experience": customer_experience(),
            "review_reliability": review_reliability(),
            "recurring_complaints": recurring_complaints(),
            "external_evidence": external_evidence(),
            "claim_consistency": claim_consistency(),
            "evidence_confidence": evidence_confidence(settings),
        }
    )


def overall_score(settings: Settings = DEFAULTS) -> Column:
    """Weighted mean over the components that have a value; 50 when none has."""
    values = [(F.col(key), F.lit(getattr(settings.weights, key))) for key, _ in COMPONENTS]
    weight_sum = sum((F.when(v.isNotNull(), w).otherwise(0.0) for v, w in values), F.lit(0.0))
    score_sum = sum((F.coalesce(v * w, F.lit(0.0)) for v, w in values), F.lit(0.0))
    return F.when(weight_sum > 0, whole(score_sum / weight_sum)).otherwise(F.lit(50))


def component_table(settings: Settings = DEFAULTS) -> Column:
    """The six components as an array of {key, label, value, weight, note}."""
    n = F.col("review_count")
    notes = {
        "customer_experience": join_text("Average rating across ", n, " review(s)"),
        "review_reliability": join_text("Review Risk level: ", F.col("risk_level")),
        "recurring_complaints": join_text(F.col("concern_count"), " concern(s) identified"),
        "external_evidence": F.lit("Cross-platform ratings and video corroboration"),
        "claim_consistency": join_text(F.col("conflict_count"), " claim conflict(s) found"),
        "evidence_confidence": join_text(
            n, " review(s) across ", F.greatest(F.col("source_count"), F.lit(1)), " platform(s)"
        ),
    }
    unchecked = F.lit("No product description was available to check claims against")

    def note(key: str) -> Column:
        text = F.when(F.col(key).isNull(), F.lit(NOT_ENOUGH)).otherwise(notes[key])
        if key == "claim_consistency":
            return F.when(F.col("claim_attempted"), text).otherwise(unchecked)
        return text

    return F.array(
        *[
            F.struct(
                F.lit(key).alias("key"),
                F.lit(label).alias("label"),
                F.col(key).alias("value"),
                F.lit(getattr(settings.weights, key)).alias("weight"),
                note(key).alias("note"),
            )
            for key, label in COMPONENTS
        ]
    )


def explanation(components: Column, overall: Column) -> Column:
    """Name the strongest components on each side and those without data."""
    scored = F.transform(
        components,
        lambda c, i: F.struct(
            ((c["value"] - 50) * c["weight"]).alias("push"),
            i.alias("i"),
            F.lower(c["label"]).alias("label"),
            F.concat(
                F.lower(c["label"]), F.lit(" ("), whole(c["value"]).cast("string"), F.lit(")")
            ).alias("text"),
        ),
    )

    def strongest(side: Column, sign: int) -> Column:
        ranked = F.array_sort(
            F.transform(
                side, lambda s: F.struct((s["push"] * sign).alias("k"), s["i"], s["text"].alias("t"))
            )
        )
        return F.array_join(F.transform(F.slice(ranked, 1, 2), lambda s: s["t"]), ", ")

    up = F.filter(scored, lambda s: s["push"] > 0)
    down = F.filter(scored, lambda s: s["push"] < 0)
    missing = F.filter(scored, lambda s: s["push"].isNull())
    sentences = F.concat_ws(
        " ",
        join_text("Trust score of ", overall, "/100."),
        F.when(F.size(up) > 0, join_text("Pulled up by ", strongest(up, -1), ".")),
        F.when(F.size(down) > 0, join_text("Pulled down by ", strongest(down, 1), ".")),
        F.when(
            F.size(missing) > 0,
            join_text(
                F.array_join(F.transform(missing, lambda s: s["label"]), ", "),
                " could not be assessed (not enough data) and did not factor into the score.",
            ),
        ),
    )
    neutral = F.lit(
        "Trust score defaulted to a neutral 50 — no signal had enough evidence to compute."
    )
    return F.when(F.size(missing) == len(COMPONENTS), neutral).otherwise(sentences)


def score_breakdown(rows: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Add components, overall and explanation to one row per product."""
    rows = with_components(rows, settings).withColumn("overall", overall_score(settings))
    rows = rows.withColumn("components", component_table(settings))
    return rows.withColumn("explanation", explanation(F.col("components"), F.col("overall")))


# ---------------------------------------------------------------- impact, recommendation


def impact_points(evidence: DataFrame, scores: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Split each component's point swing over the evidence items that caused it.

    ``scores`` has recurring_complaints, claim_consistency and customer_experience per
    product. Weights are summed by aggregation and joined back, so a product with a very
    long evidence list is not collected into one task.
    """
    w = settings.weights
    swings = scores.select(
        "product_id",
        F.coalesce(
            (F.col("recurring_complaints") - 100) * F.lit(w.recurring_complaints), F.lit(0.0)
        ).alias("concern"),
        F.coalesce(
            (F.col("claim_consistency") - 100) * F.lit(w.claim_consistency), F.lit(0.0)
        ).alias("claim_conflict"),
        F.coalesce(
            F.greatest(
                F.lit(0.0), (F.col("customer_experience") - 50) * F.lit(w.customer_experience)
            ),
            F.lit(0.0),
        ).alias("evidence"),
    )
    swing = (
        evidence_totals(evidence)
        .join(swings, "product_id", "left")
        .select(
            "product_id",
            "type",
            F.when(F.col("type") == "concern", F.col("concern"))
            .when(F.col("type") == "claim_conflict", F.col("claim_conflict"))
            .when(F.col("type") == "evidence", F.col("evidence"))
            .alias("swing"),
            F.when(F.col("penalty") == 0, F.lit(1.0)).otherwise(F.col("penalty")).alias("total"),
        )
    )
    item = evidence.withColumn("weight", evidence_weight())
    return item.join(swing, ["product_id", "type"], "left").select(
        *evidence.columns,
        "weight",
        whole(F.col("swing") * (F.col("weight") / F.col("total"))).alias("impact_points"),
    )


def recommendation(score: Column, confidence: Column, reviews: Column, risk_level: Column) -> Column:
    adjusted = (
        F.when(risk_level == "high", score - 30)
        .when(risk_level == "medium", score - 15)
        .otherwise(score)
    )
    return (
        F.when((confidence == "none") | (reviews <= 0), "INSUFFICIENT_DATA")
        .when(adjusted >= 75, "BUY_WITH_CONFIDENCE")
        .when(adjusted >= 55, "BUY_WITH_CAUTION")
        .when(adjusted >= 35, "PROCEED_WITH_CAUTION")
        .otherwise("AVOID")
    )
