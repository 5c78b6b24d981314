"""Review videos: relevance to a product, keep/drop decisions, ranking and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewtrust.config import DEFAULTS, Settings
from reviewtrust.functions.numbers import clamp, fixed, join_text, percent
from reviewtrust.functions.text import squeeze
from reviewtrust.functions.titles import model_tokens, title_tokens
from reviewtrust.operators.sample import numbered

# Titles that are not reviews, and words that suggest one.
JUNK_PATTERN = (
    r"\b(giveaway|win a|free (?:iphone|phone|laptop)|"
    r"asmr|"
    r"lofi|lo-fi|music|song|beat|remix|playlist|"
    r"prank|reaction to|"
    r"how to (?:get|download|hack|crack)|"
    r"fake vs real|replica|clone|knock ?off|"
    r"top \d+ (?:phones|laptops|headphones|gadgets) (?:of|in) \d{4})\b"
)
REVIEW_HINT_PATTERN = (
    r"\b(review|reviewed|tested|test|hands ?on|comparison|vs\.?|versus|"
    r"unboxing|long ?term|after \d+ (?:days|weeks|months|years)|"
    r"worth it|should you buy|pros and cons|honest)\b"
)


def iso_duration_seconds(value: Column) -> Column:
    """Whole seconds of a duration such as PT12M34S; null if malformed or zero."""
    text = F.upper(F.trim(value))
    shape = r"^P(?:(\d+)D)?T?(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?$"

    def part(group: int) -> Column:
        return F.coalesce(F.regexp_extract(text, shape, group).try_cast("double"), F.lit(0.0))

    total = part(1) * 86400 + part(2) * 3600 + part(3) * 60 + part(4)
    return F.when(text.rlike(shape) & (total > 0), F.floor(total).cast("bigint"))


def score_relevance(videos: DataFrame, product_title: str = "product_title", title: str = "title") -> DataFrame:
    """Add ``relevance`` and ``relevance_reasons`` for a product title on each row."""
    rows = videos.withColumns(
        {
            "_p": title_tokens(F.col(product_title)),
            "_v": title_tokens(F.col(title)),
        }
    )
    rows = rows.withColumn(
        "_models", F.array_sort(F.array_intersect(model_tokens(F.col("_p")), model_tokens(F.col("_v"))))
    )
    overlap, wanted = F.size(F.array_intersect("_p", "_v")), F.size(F.array_distinct("_p"))
    rows = rows.withColumn("_cover", F.when(wanted > 0, overlap / wanted))
    untitled = F.trim(F.coalesce(F.col(title), F.lit(""))) == ""
    junk = F.col(title).rlike("(?iU)" + JUNK_PATTERN)
    hint = F.col(title).rlike("(?iU)" + REVIEW_HINT_PATTERN)
    points = (
        F.when(F.size("_models") > 0, F.lit(0.6)).otherwise(F.lit(0.0))
        + F.lit(0.4) * F.col("_cover")
        + F.when(hint, F.lit(0.12)).otherwise(F.lit(0.0))
    )
    refused = (
        F.when(untitled, "no title")
        .when(junk, "title matches a non-review pattern")
        .when(wanted == 0, "no product title to compare against")
    )
    reasons = F.array_compact(
        F.array(
            F.when(F.size("_models") > 0, join_text("model token: ", F.array_join("_models", ", "))),
            F.when(F.col("_cover") > 0, join_text("covers ", percent(F.col("_cover")), " of product terms")),
            F.when(hint, F.lit("title reads as a review")),
        )
    )
    return rows.withColumns(
        {
            "relevance": F.when(refused.isNotNull(), F.lit(0.0)).otherwise(clamp(points, 0.0, 1.0)),
            "relevance_reasons": F.when(refused.isNotNull(), F.array(refused)).otherwise(reasons),
        }
    ).drop("_p", "_v", "_models", "_cover")


def judge_videos(videos: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Add ``kept`` and ``drop_reason``: too short (long-form sources), then relevance."""
    threshold = settings.video_relevance
    too_short = (F.col("source") != "tiktok") & F.coalesce(
        F.col("duration_seconds") < settings.video_min_seconds, F.lit(False)
    )
    low = join_text(
        "relevance ", fixed(F.col("relevance"), 2), f" below threshold {threshold:.2f}"
    )
    irrelevant = F.when(
        (F.col("relevance") == 0.0) & (F.size("relevance_reasons") > 0), F.get("relevance_reasons", F.lit(0))
    ).otherwise(low)
    reason = F.when(too_short, "too short").when(F.col("relevance") < threshold, irrelevant)
    return videos.withColumn("drop_reason", reason).withColumn("kept", reason.isNull())


def source_limit(settings: Settings = DEFAULTS) -> Column:
    """The short-form source gets half the places, at least two."""
    return F.when(F.col("source") == "tiktok", max(2, settings.video_limit // 2)).otherwise(
        settings.video_limit
    )


def top_videos(judged: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """The best kept videos per (product, source): relevance, then views."""
    order = [F.desc(F.coalesce("relevance", F.lit(0.0))), F.desc(F.coalesce("views", F.lit(0))), "video_key"]
    ranked = numbered(
        judged.where("kept"), ["product_id", "source"], order, settings.video_limit, "source_rank"
    )
    return ranked.where(F.col("source_rank") <= source_limit(settings))


def source_report(judged: DataFrame) -> DataFrame:
    """Considered, filtered out and kept per (product, source)."""
    return judged.groupBy("product_id", "source").agg(
        F.count("*").alias("considered"),
        F.count_if(~F.col("kept")).alias("filtered_out"),
        F.count_if("kept").alias("kept"),
    )


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Keep the first row per key in a stated order."""
    return numbered(df, keys, order, 1, "_first").drop("_first")


def merge_details(search: DataFrame, details: DataFrame) -> DataFrame:
    """Search rows with durations and view counts from the detail rows, where there are any.

    ``search``: video_id, title, channel, channel_id, published_at, description.
    ``details``: video_id, duration (ISO 8601), view_count (text).
    """
    usable = search.where((F.coalesce("video_id", F.lit("")) != "") & (F.coalesce("title", F.lit("")) != ""))
    joined = usable.join(details.select("video_id", "duration", "view_count"), "video_id", "left")
    return joined.select(
        "video_id",
        "title",
        F.concat(F.lit("https://www.youtube.com/watch?v="), "video_id").alias("url"),
        F.lit("youtube").alias("source"),
        "channel",
        F.concat(F.lit("https://www.youtube.com/channel/"), "channel_id").alias("channel_url"),
        iso_duration_seconds(F.col("duration")).alias("duration_seconds"),
        F.nullif(F.left("published_at", F.lit(10)), F.lit("")).alias("published"),
        F.when(F.col("view_count").rlike(r"^\d+$"), F.col("view_count").try_cast("bigint")).alias("views"),
        F.nullif(F.left(squeeze(F.col("description")), F.lit(300)), F.lit("")).alias("description"),
    )


def api_error_bucket(status: Column, reason: Column, message: Column) -> Column:
    """What a failed video API call means to whoever has to fix it."""
    why, text = F.coalesce(reason, F.lit("")), F.coalesce(message, F.lit(""))
    short = F.left(text, F.lit(120))
    return (
        F.when(
            (status == 403) & F.contains(F.lower(F.concat(why, text)), F.lit("quota")),
            F.lit("YouTube API quota exceeded for today"),
        )
        .when(
            status == 403,
            join_text(
                "YouTube API rejected the request (",
                F.when(why == "", F.lit("forbidden")).otherwise(why), "): ", short,
            ),
        )
        .when(
            (status == 400) & F.contains(F.lower(text), F.lit("api key not valid")),
            F.lit("YOUTUBE_API_KEY is not valid"),
        )
        .otherwise(join_text("YouTube API HTTP ", status, ": ", short))
    )


def api_blocked(status: Column) -> Column:
    return status.isin(401, 403, 429)
