"""Limits on an external verdict: confidence ceilings, caveats, normalized numbers, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewtrust.config import DEFAULTS, Settings
from reviewtrust.functions.numbers import clamp, fixed, half_even, join_text, percent, whole
from reviewtrust.operators.score import recommendation

# What each evidence tier lets a verdict claim.
TIER_TEXT = {
    "very thin": (
        "This is far too little evidence for a verdict. Describe only what these few "
        "reviewers said, state clearly that a handful of reviews cannot support a "
        "recommendation, and set confidence to 'low'."
    ),
    "thin": (
        "This is a small sample. Report what these reviewers said, avoid implying a "
        "general pattern, note explicitly that the sample is small, and set confidence "
        "to 'low'."
    ),
    "moderate": (
        "Enough for a qualified view. Note in caveats that the evidence is limited. "
        "Confidence should be 'medium' at most."
    ),
    "moderate, one platform": (
        "Enough for a qualified view. Note in caveats that the evidence is limited "
        "and comes from a single platform. Confidence should be 'medium' at most."
    ),
    "reasonable": (
        "Enough for a confident view on points that recur across reviews. Confidence may "
        "be 'high' only where reviewers clearly agree."
    ),
}


def confidence_rank(confidence: Column) -> Column:
    return F.array_position(
        F.array(F.lit("none"), F.lit("low"), F.lit("medium"), F.lit("high")), confidence
    )


def confidence_ceiling(reviews: Column, sources: Column, settings: Settings = DEFAULTS) -> Column:
    return (
        F.when(reviews == 0, "none")
        .when(reviews < settings.confident_min_reviews, "low")
        .when((sources < 2) | (reviews < settings.strong_min_reviews), "medium")
        .otherwise("high")
    )


def evidence_tier(reviews: Column, sources: Column, settings: Settings = DEFAULTS) -> Column:
    return (
        F.when(reviews < settings.min_reviews, "very thin")
        .when(reviews < settings.confident_min_reviews, "thin")
        .when((reviews < settings.strong_min_reviews) | (sources < 2), "moderate")
        .otherwise("reasonable")
    )


def tier_instruction(tier: Column, sources: Column) -> Column:
    named = F.when((tier == "moderate") & (sources < 2), "moderate, one platform").otherwise(tier)
    return F.create_map(*[F.lit(x) for pair in TIER_TEXT.items() for x in pair])[named]


def confidence_reason(confidence: Column, reviews: Column, sources: Column) -> Column:
    basis = join_text(
        confidence,
        " — based on ",
        reviews,
        F.when(reviews == 1, " review from ").otherwise(" reviews from "),
        F.greatest(sources, F.lit(1)),
        F.when(sources == 1, " platform.").otherwise(" platforms."),
    )
    return F.when(
        reviews <= 0, F.lit("none — no customer reviews were found for this product.")
    ).otherwise(basis)


def _add_caveat(existing: str, wanted: Column, text: Column) -> Column:
    """Append unless the first three words all occur in one caveat already there."""
    opening = F.slice(F.split(F.lower(text), " +"), 1, 3)
    said = F.exists(
        existing, lambda c: F.forall(opening, lambda word: F.contains(F.lower(c), word))
    )
    return F.when(
        F.coalesce(wanted & ~said, F.lit(False)), F.concat(existing, F.array(text))
    ).otherwise(F.col(existing))


def apply_caution(rows: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Cap a stated verdict by the evidence behind it and list every change.

    ``rows``: confidence, caveats, trust_score, star_rating (as stated), review_count,
    source_count, sources, filtered_out, total_scraped, rated_sources, spread,
    highest_source, highest_mean, lowest_source, lowest_mean.
    """
    n, platforms = F.col("review_count"), F.col("source_count")
    raw = F.when(
        F.coalesce("confidence", F.lit("")) == "", F.lit("low")
    ).otherwise(F.lower(F.trim("confidence")))
    rows = rows.withColumn("_raw", raw).withColumn("_known", confidence_rank(F.col("_raw")) > 0)
    rows = rows.withColumns(
        {
            "stated_confidence": F.when(F.col("_known"), F.col("_raw")).otherwise("low"),
            "ceiling": confidence_ceiling(n, platforms, settings),
        }
    )
    lowered = confidence_rank(F.col("stated_confidence")) > confidence_rank(F.col("ceiling"))
    rows = rows.withColumns(
        {
            "_lowered": lowered,
            "capped_confidence": F.when(lowered, F.col("ceiling")).otherwise(
                F.col("stated_confidence")
            ),
            "_score": F.coalesce(whole(clamp(F.col("trust_score"), 0.0, 100.0)), F.lit(50)),
            "_stars": F.coalesce(
                clamp(half_even(F.col("star_rating") * 2) / 2, 0.0, 5.0), F.lit(2.5)
            ),
            "_caveats": F.coalesce("caveats", F.array().cast("array<string>")),
        }
    )
    share = F.col("filtered_out") / F.when(F.col("total_scraped") > 0, F.col("total_scraped"))
    additions = [
        (
            n == 0,
            F.lit(
                "No customer reviews were found for this product — this verdict draws on "
                "video commentary and/or general knowledge instead, not verified reviews."
            ),
        ),
        (
            (n > 0) & (n < settings.confident_min_reviews),
            join_text(
                "Based on only ", n,
                " review(s) — too few to be confident this reflects most buyers' experience.",
            ),
        ),
        (
            (n > 0) & (platforms < 2),
            join_text(
                "All reviews come from a single platform (",
                F.coalesce(F.get("sources", F.lit(0)), F.lit("unknown")),
                "), so they share whatever moderation and incentives that platform has.",
            ),
        ),
        (
            (F.col("filtered_out") > 0) & (share >= 0.3),
            join_text(
                F.col("filtered_out"), " of ", F.col("total_scraped"), " reviews (", percent(share),
                ") were removed by automated review-pattern filtering, which is a high share — "
                "treat the remaining reviews with care.",
            ),
        ),
        (
            (F.col("rated_sources") >= 2) & (F.col("spread") >= settings.divergence_spread),
            join_text(
                "Ratings disagree across platforms: ", F.col("highest_source"), " averages ",
                fixed(F.col("highest_mean"), 1), "/5 versus ", F.col("lowest_source"), " at ",
                fixed(F.col("lowest_mean"), 1), "/5.",
            ),
        ),
    ]
    for wanted, text in additions:
        rows = rows.withColumn("_caveats", _add_caveat("_caveats", wanted, text))
    adjustments = F.array_compact(
        F.array(
            F.when(
                ~F.col("_known"),
                join_text(
                    "model returned unrecognized confidence '", F.col("_raw"), "'; treated as low"
                ),
            ),
            F.when(
                F.col("_lowered"),
                join_text(
                    "confidence lowered from '", F.col("stated_confidence"), "' to '",
                    F.col("ceiling"), "': ", n, " review(s) from ", platforms,
                    " platform(s) cannot support more",
                ),
            ),
            F.when(
                ~F.coalesce(F.col("_score") == F.col("trust_score"), F.lit(False)),
                join_text("trust_score normalized to ", F.col("_score")),
            ),
            F.when(
                ~F.coalesce(F.col("_stars") == F.col("star_rating"), F.lit(False)),
                join_text("star_rating normalized to ", F.col("_stars")),
            ),
        )
    )
    return rows.withColumns(
        {
            "adjustments": adjustments,
            "confidence": F.col("capped_confidence"),
            "caveats": F.col("_caveats"),
            "trust_score": F.col("_score"),
            "star_rating": F.col("_stars"),
            "confidence_reason": confidence_reason(F.col("capped_confidence"), n, platforms),
        }
    ).drop("_raw", "_known", "_lowered", "_score", "_stars", "_caveats", "capped_confidence")


def override_score(rows: DataFrame) -> DataFrame:
    """Replace the stated score by the computed one, and say so when it moved by 10 or more."""
    stated, overall = F.col("trust_score"), F.col("overall")
    note = F.when(
        F.abs(stated - overall) >= 10,
        F.array(
            join_text(
                "trust_score recomputed from named signals: ", stated, " (model) -> ", overall,
                " (weighted breakdown)",
            )
        ),
    ).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumns(
        {
            "adjustments": F.concat("adjustments", note),
            "trust_score": overall,
            "star_rating": clamp(half_even(overall / 100 * 5 * 2) / 2, 0.0, 5.0),
        }
    )
    return rows.withColumn(
        "recommendation",
        recommendation(
            F.col("trust_score"), F.col("confidence"), F.col("review_count"), F.col("risk_level")
        ),
    )


# ---------------------------------------------------------------- status of a run


def run_status(passed: Column, settings: Settings = DEFAULTS) -> Column:
    return F.when(passed >= settings.min_reviews, "ok").otherwise("not_enough_data")


def run_message(settings: Settings = DEFAULTS) -> Column:
    """Why a review set is too thin; null when it is not.

    Columns: passed, filtered_out, host_source, host_ok, host_blocked, host_error.
    """
    passed, out, need = F.col("passed"), F.col("filtered_out"), settings.min_reviews
    host = F.coalesce("host_source", F.lit("the host site"))
    return (
        F.when(passed >= need, F.lit(None).cast("string"))
        .when(
            (passed > 0) & (out > 0),
            join_text(
                "Only ", passed, " of ", passed + out, " reviews passed fake-review filtering; ",
                need, " are needed. See filter_report for which rules fired.",
            ),
        )
        .when(
            F.col("host_blocked"),
            join_text(
                host,
                " blocked the request, so its reviews could not be read. This is common on large "
                "retailers that detect automated access.",
            ),
        )
        .when(
            ~F.coalesce("host_ok", F.lit(False)) & F.col("host_error").isNotNull(),
            join_text("Could not read reviews from ", host, ": ", F.col("host_error"), "."),
        )
        .when(
            passed == 0,
            F.lit(
                "No reviews were found for this product. It may have none, or they may be "
                "loaded in a way this scraper cannot read yet."
            ),
        )
        .otherwise(
            join_text(
                "Only ", passed, " review(s) found across all sources; ", need,
                " are needed to say anything useful about this product.",
            )
        )
    )


def run_outcome(runs: DataFrame, reports: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Status, message, contributing sources and partial reasons per product.

    ``runs``: product_id, passed, filtered_out, summary_error (null when a summary exists).
    ``reports``: product_id, kind (host/video), source, ok, blocked, error, count; one row
    per source a run asked.
    """
    is_host = F.col("kind") == "host"
    trouble = (
        F.when(
            is_host & (F.col("blocked") | F.col("error").isNotNull()),
            F.struct(
                F.lit(0).alias("o"),
                join_text(F.col("source"), " partially blocked review collection").alias("t"),
            ),
        )
        .when(
            ~is_host & F.col("error").isNotNull(),
            F.struct(
                F.lit(1).alias("o"),
                join_text(F.col("source"), " video search failed (", F.col("error"), ")").alias("t"),
            ),
        )
    )
    gave = F.when(
        F.col("count") > 0,
        F.struct(F.when(is_host, 0).otherwise(1).alias("o"), F.col("source").alias("s")),
    )
    per_run = reports.groupBy("product_id").agg(
        F.max(F.when(is_host, F.col("source"))).alias("host_source"),
        F.max(F.when(is_host, F.col("ok"))).alias("host_ok"),
        F.coalesce(F.max(F.when(is_host, F.col("blocked"))), F.lit(False)).alias("host_blocked"),
        F.max(F.when(is_host, F.col("error"))).alias("host_error"),
        F.transform(F.array_sort(F.collect_list(gave)), lambda g: g["s"]).alias("contributed"),
        F.transform(F.array_sort(F.collect_list(trouble)), lambda g: g["t"]).alias("troubles"),
    )
    rows = runs.join(per_run, "product_id", "left")
    rows = rows.withColumns(
        {"status": run_status(F.col("passed"), settings), "message": run_message(settings)}
    )
    none = F.array().cast("array<string>")
    reasons = F.concat(
        F.coalesce("troubles", none),
        F.when(F.col("summary_error").isNotNull(), F.array("summary_error")).otherwise(none),
    )
    rows = rows.withColumn(
        "partial_reasons", F.when(F.col("status") == "ok", reasons).otherwise(none)
    )
    return rows.select(
        "product_id",
        "status",
        "message",
        F.coalesce("contributed", none).alias("contributed"),
        (F.size("partial_reasons") > 0).alias("partial"),
        "partial_reasons",
    )
