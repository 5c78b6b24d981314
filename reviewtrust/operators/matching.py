"""Are two listings the same product? Scores of (query, candidate) rows and the best one.

Candidates belong to a query (the listings its own search returned), so scoring is one
equi-join on ``query_id`` and grows with the number of candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewtrust.config import DEFAULTS, Settings
from reviewtrust.functions.numbers import clamp, fixed, join_text
from reviewtrust.functions.titles import (
    accessory_signal,
    brand_of,
    identifiers,
    model_tokens,
    specs,
    title_tokens,
)


def listing_features(listings: DataFrame, legacy_measurement_tokens: bool = False) -> DataFrame:
    """Everything matching needs from one listing: a projection, no shuffle."""
    tokens = listings.withColumn("tokens", title_tokens(F.col("title")))
    models = tokens.withColumn("models", model_tokens(F.col("tokens"), legacy_measurement_tokens))
    return models.select(
        *[c for c in listings.columns if c not in ("ids", "brand")],
        identifiers(F.col("ids")).alias("ids"),
        (F.trim(F.coalesce("brand", F.lit(""))) != "").alias("declared"),
        brand_of(F.col("title"), F.col("brand")).alias("brand"),
        F.array_distinct("tokens").alias("tokens"),
        "models",
        F.array_except(F.array_distinct("tokens"), "models").alias("words"),
        specs(F.col("title")).alias("specs"),
        accessory_signal(F.col("title")).alias("accessory"),
    )


def _dimensions(pairs: Column) -> Column:
    return F.array_distinct(F.transform(pairs, lambda s: s["dimension"]))


def _values(pairs: Column, dimension: Column) -> Column:
    of_dimension = F.filter(pairs, lambda s: s["dimension"] == dimension)
    return F.array_join(F.array_sort(F.transform(of_dimension, lambda s: s["value"])), "/")


def score_pairs(pairs: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Score rows holding two feature structs ``q`` and ``c``."""
    q, c = F.col("q"), F.col("c")
    rows = pairs.withColumns(
        {
            "shared_ids": F.filter(
                F.map_keys(q["ids"]), lambda k: q["ids"][k] == F.try_element_at(c["ids"], k)
            ),
            "clashing_ids": F.filter(
                F.map_keys(q["ids"]), lambda k: q["ids"][k] != F.try_element_at(c["ids"], k)
            ),
            "shared_models": F.array_sort(F.array_intersect(q["models"], c["models"])),
            "shared_words": F.array_sort(F.array_intersect(q["words"], c["words"])),
            "agreed": F.array_sort(_dimensions(F.array_intersect(q["specs"], c["specs"]))),
            "both_state": F.array_intersect(_dimensions(q["specs"]), _dimensions(c["specs"])),
        }
    )
    n_words = F.size(q["words"]) + F.size(c["words"])
    both_worded = (F.size(q["words"]) > 0) & (F.size(c["words"]) > 0)
    rows = rows.withColumns(
        {
            "dice": F.when(both_worded, F.size("shared_words") * 2 / n_words).otherwise(F.lit(0.0)),
            "brand_agrees": F.coalesce(q["brand"] == c["brand"], F.lit(False)),
            "brand_present": F.coalesce(F.array_contains(c["tokens"], q["brand"]), F.lit(False)),
            "spec_conflicts": F.array_sort(F.array_except("both_state", "agreed")),
        }
    )
    brand_clash = F.coalesce(
        (q["brand"] != c["brand"])
        & (
            (q["declared"] & c["declared"])
            | (
                ~F.array_contains(c["tokens"], q["brand"])
                & ~F.array_contains(q["tokens"], c["brand"])
            )
        ),
        F.lit(False),
    )
    has_shared_model = F.size("shared_models") > 0
    model_clash = ~has_shared_model & (F.size(q["models"]) > 0) & (F.size(c["models"]) > 0)
    accessory = c["accessory"].isNotNull() & q["accessory"].isNull()

    def first_three(models: Column) -> Column:
        return F.array_join(F.slice(models, 1, 3), "/")

    conflicts = F.concat(
        F.array_compact(
            F.array(
                F.when(
                    F.size("clashing_ids") > 0,
                    join_text("identifiers disagree: ", F.array_join("clashing_ids", ", ")),
                ),
                F.when(brand_clash, join_text("brand mismatch: ", q["brand"], " vs ", c["brand"])),
            )
        ),
        F.transform(
            "spec_conflicts",
            lambda d: F.concat(
                d, F.lit(" differs: "), _values(q["specs"], d), F.lit(" vs "), _values(c["specs"], d)
            ),
        ),
        F.array_compact(
            F.array(
                F.when(
                    accessory, join_text("candidate looks like an accessory: ", c["accessory"])
                ),
                F.when(
                    model_clash,
                    join_text(
                        "model tokens differ: ", first_three(q["models"]), " vs ",
                        first_three(c["models"]),
                    ),
                ),
            )
        ),
    )
    reasons = F.array_compact(
        F.array(
            F.when(
                has_shared_model,
                join_text("model token match: ", F.array_join("shared_models", ", ")),
            ),
            F.when(
                F.col("dice") >= 0.3,
                join_text(
                    "descriptive overlap ", fixed(F.col("dice"), 2), ": ",
                    F.array_join(F.slice("shared_words", 1, 6), ", "),
                ),
            ),
            F.when(F.col("brand_agrees"), join_text("brand agrees: ", q["brand"])).when(
                F.col("brand_present"), join_text("brand present in candidate: ", q["brand"])
            ),
            F.when(
                F.size("agreed") > 0, join_text("specs agree: ", F.array_join("agreed", ", "))
            ),
        )
    )
    base = F.when(has_shared_model, F.lit(0.60) + F.lit(0.28) * F.col("dice")).otherwise(
        F.lit(0.72) * F.col("dice")
    )
    brand_points = (
        F.when(F.col("brand_agrees"), F.lit(0.15))
        .when(F.col("brand_present"), F.lit(0.10))
        .otherwise(F.lit(0.0))
    )
    spec_points = F.least(F.lit(0.10), F.lit(0.05) * F.size("agreed"))
    untitled = (F.trim(F.coalesce(q["title"], F.lit(""))) == "") | (
        F.trim(F.coalesce(c["title"], F.lit(""))) == ""
    )
    by_id = F.size("shared_ids") > 0
    none = F.array().cast("array<string>")
    rows = rows.withColumns(
        {
            "score": F.when(untitled, F.lit(0.0))
            .when(by_id, F.lit(1.0))
            .otherwise(clamp(base + brand_points + spec_points, 0.0, 1.0)),
            "conflicts": F.when(untitled | by_id, none).otherwise(conflicts),
            "reasons": F.when(untitled, F.array(F.lit("one side has no title")))
            .when(by_id, F.array(join_text("identifier match: ", F.array_join("shared_ids", ", "))))
            .otherwise(reasons),
        }
    )
    clean = F.size("conflicts") == 0
    threshold = settings.match_threshold
    rows = rows.withColumns(
        {
            "matched": clean & (F.col("score") >= threshold),
            "confidence": F.when(~clean, "none")
            .when(F.col("score") >= 0.85, "high")
            .when(F.col("score") >= threshold, "medium")
            .when(F.col("score") >= threshold * 0.7, "low")
            .otherwise("none"),
        }
    )
    return rows.drop(
        "q", "c", "shared_ids", "clashing_ids", "shared_models", "shared_words", "agreed",
        "both_state", "brand_agrees", "brand_present", "spec_conflicts", "dice",
    )


def score_candidates(
    queries: DataFrame,
    candidates: DataFrame,
    settings: Settings = DEFAULTS,
    legacy_measurement_tokens: bool = False,
) -> DataFrame:
    """Verdict for every candidate of every query.

    ``queries``: query_id, title, brand, ids. ``candidates``: query_id, position, title,
    brand, ids.
    """
    left = listing_features(queries, legacy_measurement_tokens)
    right = listing_features(candidates, legacy_measurement_tokens)
    q = left.select("query_id", F.struct(*[c for c in left.columns if c != "query_id"]).alias("q"))
    c = right.select(
        "query_id", "position", F.struct(*[c for c in right.columns if c not in ("query_id", "position")]).alias("c")
    )
    return score_pairs(c.join(q, "query_id"), settings)


def best_match(scored: DataFrame) -> DataFrame:
    """The best candidate per query: matches first, then score, then position.

    ``best_position`` is null when nothing matched; the best rejected verdict is kept, so
    the reason is visible.
    """
    best = F.max_by(
        F.struct("position", "matched", "score", "confidence", "reasons", "conflicts"),
        F.struct("matched", "score", -F.col("position")),
    )
    return scored.groupBy("query_id").agg(best.alias("b")).select(
        "query_id",
        F.when(F.col("b.matched"), F.col("b.position")).alias("best_position"),
        "b.matched",
        "b.score",
        "b.confidence",
        "b.reasons",
        "b.conflicts",
    )
