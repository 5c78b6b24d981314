"""Choosing which rows to show: stratified samples, interleaved lists, evidence picks.

Every pick is a ``row_number() <= k`` filter. Spark applies such a limit in the map tasks
as well, so a product holding a third of all rows sends only a few rows per task onwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewtrust.config import DEFAULTS, Settings


def numbered(df: DataFrame, by: list, order: list, limit: int, name: str = "rn") -> DataFrame:
    """Number rows within a group and keep the first ``limit``."""
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= limit)


def stratified_sample(
    reviews: DataFrame, limit: int | None = None, settings: Settings = DEFAULTS, whole_in_order: bool = True
) -> DataFrame:
    """Round-robin over (source, rating band) buckets per product, in input order.

    A product with at most ``limit`` reviews is returned whole and, unless ``whole_in_order`` is False, in input
    order instead of turns. Adds ``position``, 1-based.
    """
    limit = settings.prompt_max_reviews if limit is None else limit
    rows = reviews.withColumns(
        {
            "_source": F.coalesce("source", F.lit("?")),
            "_band": F.coalesce(F.floor("rating"), F.lit(0)).cast("int"),
        }
    )
    # One row more than the limit survives each cut: enough to tell "more than the limit".
    bucket = numbered(rows, ["product_id", "_source", "_band"], ["review_id"], limit + 1, "_round")
    turn = numbered(bucket, ["product_id"], ["_round", "_source", "_band"], limit + 1, "_turn")
    if not whole_in_order:
        return turn.where(F.col("_turn") <= limit).withColumnRenamed("_turn", "position").drop("_source", "_band", "_round")
    of_product = Window.partitionBy("product_id")
    kept = turn.withColumn("_n", F.max("_turn").over(of_product))
    in_order = F.row_number().over(of_product.orderBy("review_id"))
    return (
        kept.withColumn("_in_order", in_order)
        .where(F.col("_turn") <= limit)
        .withColumn(
            "position", F.when(F.col("_n") > limit, F.col("_turn")).otherwise(F.col("_in_order"))
        )
        .drop("_source", "_band", "_round", "_turn", "_n", "_in_order")
    )


def evidence_score() -> Column:
    return (
        F.least(F.length(F.coalesce("text", F.lit(""))), F.lit(400)) / F.lit(400)
        + F.when(F.col("verified_purchase"), F.lit(0.5)).otherwise(F.lit(0.0))
        + F.when(F.col("rating").isNotNull(), F.lit(0.3)).otherwise(F.lit(0.0))
        + F.least(F.coalesce("helpful_votes", F.lit(0)), F.lit(50)) / F.lit(100)
    )


def evidence_pick(reviews: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """The reviews shown as evidence: the best of both sides, alternating from the top.

    ``reviews`` carries ``passed``. Ties keep the lower review id first.
    """
    k = settings.evidence_shown
    eligible = reviews.where(
        F.coalesce("passed", F.lit(True)) & (F.length(F.coalesce("text", F.lit(""))) > 40)
    ).withColumns(
        {
            "evidence_score": evidence_score(),
            "critical": F.coalesce(F.col("rating") <= 3, F.lit(False)),
        }
    )
    sided = numbered(
        eligible, ["product_id", "critical"], [F.desc("evidence_score"), "review_id"], k, "side_rank"
    )
    return numbered(sided, ["product_id"], ["side_rank", "critical"], k, "position").drop("side_rank")


def interleave(
    videos: DataFrame, limit_per_source: int | None = None, settings: Settings = DEFAULTS
) -> DataFrame:
    """Alternate the sources of each product, each in order of relevance.

    A source's list is cut to ``limit_per_source`` (the number of videos a source may
    return). Sources take turns in name order: read the rows by (source_rank, source).
    """
    limit = settings.video_limit if limit_per_source is None else limit_per_source
    order = [F.desc(F.coalesce("relevance", F.lit(0.0))), F.desc(F.coalesce("views", F.lit(0))), "video_key"]
    return numbered(videos, ["product_id", "source"], order, limit, "source_rank")


def fallback_videos(
    videos: DataFrame, survivors: DataFrame, limit: int = 6, settings: Settings = DEFAULTS
) -> DataFrame:
    """The first interleaved videos of products without a surviving review."""
    bare = videos.join(survivors.select("product_id").distinct(), "product_id", "left_anti")
    # No source can fill more than the whole list, so each is cut to it first.
    return numbered(
        interleave(bare, limit_per_source=limit), ["product_id"], ["source_rank", "source"], limit, "position"
    )
