"""Labelled text blocks: sampled reviews or videos of a product as one prompt row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewtrust.config import DEFAULTS, Settings
from reviewtrust.functions.numbers import join_text
from reviewtrust.functions.text import excerpt, squeeze
from reviewtrust.functions.urls import listing_facts
from reviewtrust.operators.sample import stratified_sample
from reviewtrust.operators.score import divergence_note
from reviewtrust.operators.verdict import evidence_tier, tier_instruction


def _filled(column: str) -> Column:
    return F.nullif(squeeze(F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(""))


def review_line(settings: Settings = DEFAULTS) -> Column:
    """``[n] platform=… rating=…/5 date=… verified``, then the title and the cut text."""
    header = F.concat_ws(
        " ",
        join_text("[", F.col("position"), "]"),
        F.concat(F.lit("platform="), F.col("source")),
        F.concat(F.lit("rating="), F.col("rating").cast("string"), F.lit("/5")),
        F.concat(F.lit("date="), F.col("review_date").cast("string")),
        F.when(F.col("verified_purchase"), F.lit("verified")),
    )
    body = excerpt(squeeze(F.col("text")), settings.prompt_review_chars)
    return F.concat_ws("\n", header, _filled("title"), body)


def video_line() -> Column:
    header = F.concat_ws(
        " ",
        join_text("[", F.col("position"), "]"),
        F.lit("source=video"),
        F.concat(F.lit("channel="), _filled("channel")),
        F.when(F.col("views") > 0, F.concat(F.lit("views="), F.col("views").cast("string"))),
        F.concat(F.lit("published="), _filled("published")),
    )
    return F.concat_ws("\n", header, _filled("title"), _filled("description"))


def _block(lines: DataFrame) -> DataFrame:
    """Join at most one sample's worth of lines per product, in position order."""
    ordered = F.array_sort(F.collect_list(F.struct("position", "line")))
    return lines.groupBy("product_id").agg(
        F.array_join(F.transform(ordered, lambda s: s["line"]), "\n\n").alias("lines"),
        F.count("*").alias("n_lines"),
        F.array_sort(F.collect_set("source")).alias("line_sources"),
    )


def shortened(reviews: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Reviews with just as much text as a prompt needs to show an excerpt: what goes through joins and samples."""
    # Two characters more than shown: one may be a space, and the other still tells that the text goes on.
    return reviews.withColumn("text", F.left(squeeze(F.col("text")), F.lit(settings.prompt_review_chars + 2)))


def review_prompts(
    survivors: DataFrame, products: DataFrame, summary: DataFrame, settings: Settings = DEFAULTS, whole_in_order: bool = True
) -> DataFrame:
    """One prompt per product from a stratified sample (see ``stratified_sample``) of its surviving reviews.

    ``summary`` is :func:`score.review_summary` plus total_scraped and filtered_out.
    """
    sample = stratified_sample(survivors, settings=settings, whole_in_order=whole_in_order)
    if "title" not in sample.columns:
        sample = sample.withColumn("title", F.lit(None).cast("string"))
    lines = sample.select("product_id", "position", "source", review_line(settings).alias("line"))
    rows = _block(lines).join(summary, "product_id").join(products, "product_id", "left")
    supplied, platforms = F.col("n_lines"), F.size("line_sources")
    tier = evidence_tier(supplied, platforms, settings)
    more = F.col("review_count") - supplied
    listing = listing_facts(F.col("url"))
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("Product: "), F.coalesce("product_name", F.lit("unknown product"))),
        F.lit("\n## Evidence"),
        join_text("- Reviews supplied: ", supplied),
        F.when(more > 0, join_text("- ", more, " more passed filtering and were left out by sampling")),
        F.when(
            F.col("filtered_out") > 0,
            join_text("- ", F.col("filtered_out"), " of ", F.col("total_scraped"), " were filtered out"),
        ),
        F.concat(F.lit("- Platforms: "), F.array_join("line_sources", ", ")),
        F.concat(F.lit("- Evidence strength: "), tier),
        F.concat(F.lit("- "), divergence_note(settings)),
        F.lit("\n## What this evidence supports"),
        tier_instruction(tier, platforms),
        F.concat(
            F.lit("\n## Listing URL\n- Scheme: "), listing["scheme"],
            F.when(listing["secure"], F.lit(" (secure (https))\n- Domain: ")).otherwise(
                F.lit(" (not https)\n- Domain: ")
            ),
            listing["domain"],
        ),
        F.concat(F.lit("\n## Product description\n"), F.trim("description")),
        F.lit("\n## Reviews\n"),
        F.col("lines"),
    )
    return rows.select("product_id", text.alias("prompt"), supplied.alias("reviews_used"))


def fallback_prompts(products: DataFrame, videos: DataFrame) -> DataFrame:
    """The prompt of a product without surviving reviews: its videos, if any.

    ``videos`` comes from :func:`sample.fallback_videos`; missing text columns are null.
    """
    for column in ("channel", "published", "description"):
        if column not in videos.columns:
            videos = videos.withColumn(column, F.lit(None).cast("string"))
    lines = videos.select("product_id", "position", "source", video_line().alias("line"))
    rows = products.join(_block(lines), "product_id", "left")
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("Product: "), F.coalesce("product_name", F.lit("unknown product"))),
        F.lit("\n## Evidence"),
        F.lit("- No customer reviews were found for this product on any tracked platform."),
        F.when(
            F.col("n_lines") > 0,
            join_text("- ", F.col("n_lines"), " video(s) about this product were found; see below.\n\n## Videos\n"),
        ).otherwise(F.lit("- No review videos were found either.")),
        F.col("lines"),
        F.concat(F.lit("\n## Product description\n"), F.trim("description")),
    )
    return rows.select("product_id", text.alias("prompt"), F.lit(0).alias("reviews_used"))
