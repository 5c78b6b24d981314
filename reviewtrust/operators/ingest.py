"""From scraped review rows to a clean review table: clean, dedupe, cap, union, crawl stop."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewtrust.config import DEFAULTS, Settings
from reviewtrust.functions.text import squeeze
from reviewtrust.operators.sample import numbered


def clean(reviews: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Collapse white space and drop texts too short to be a review."""
    return reviews.withColumn("text", squeeze(F.coalesce("text", F.lit("")))).where(
        F.length("text") >= settings.min_text_chars
    )


def fingerprint() -> Column:
    """Author and the whole normalized body."""
    author = F.lower(F.trim(F.coalesce("author", F.lit(""))))
    return F.concat(author, F.lit("|"), squeeze(F.lower("text")))


def first_seen(reviews: DataFrame, order: str = "review_id") -> DataFrame:
    """One row per (product, source, fingerprint): the first in input order.

    Only the key's digest and the order are compared; a large group of copies is cut to
    one row in every map task before the shuffle.
    """
    keyed = reviews.withColumn("_print", F.sha2(fingerprint(), 256))
    return numbered(keyed, ["product_id", "source", "_print"], [order], 1, "_rn").drop("_print", "_rn")


def capped(reviews: DataFrame, order: str = "review_id", settings: Settings = DEFAULTS) -> DataFrame:
    """The first ``review_cap`` reviews per (product, source); ``truncated`` if more exist."""
    cap = settings.review_cap
    one_more = numbered(reviews, ["product_id", "source"], [order], cap + 1, "_rn")
    # At most cap + 1 rows per group reach this window.
    reached = F.max("_rn").over(Window.partitionBy("product_id", "source"))
    return (
        one_more.withColumn("truncated", reached > cap).where(F.col("_rn") <= cap).drop("_rn")
    )


def collect_sources(*sources: DataFrame) -> DataFrame:
    """All sources' rows in one table; every row keeps its ``source``."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def reviews_until_stop(
    pages: DataFrame, page_reviews: DataFrame, settings: Settings = DEFAULTS
) -> DataFrame:
    """Which stored pages of a listing a crawl would have used, and what each added.

    ``pages``: listing_id, page_no, ok, blocked. ``page_reviews``: listing_id, page_no,
    pos, author, text. Pages are read in order until the page limit, the review cap, a
    failed or blocked page, or a page adding nothing new. Page numbers beyond the limit are
    dropped first, so a listing never has more than ``max_pages`` page rows.
    """
    early = page_reviews.where(F.col("page_no") <= settings.max_pages)
    text = squeeze(F.coalesce("text", F.lit("")))
    keyed = early.where(F.length(text) >= settings.min_text_chars).select(
        "listing_id", "page_no", F.sha2(fingerprint(), 256).alias("print")
    )
    # First page a fingerprint appears on, by aggregation: copies are combined map-side.
    first = keyed.groupBy("listing_id", "print").agg(F.min("page_no").alias("page_no"))
    fresh = first.groupBy("listing_id", "page_no").agg(F.count("*").alias("added"))
    rows = (
        pages.where(F.col("page_no") <= settings.max_pages)
        .join(fresh, ["listing_id", "page_no"], "left")
        .na.fill(0, ["added"])
    )
    in_order = Window.partitionBy("listing_id").orderBy("page_no")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = in_order.rowsBetween(Window.unboundedPreceding, -1)
    usable = F.col("ok") & ~F.col("blocked") & (F.col("added") > 0)
    rows = rows.withColumns(
        {
            "before": F.coalesce(F.sum("added").over(earlier), F.lit(0)),
            "open": F.coalesce(F.min(usable.cast("int")).over(earlier), F.lit(1)) == 1,
            "running": F.min(usable.cast("int")).over(so_far) == 1,
        }
    )
    fetched = F.col("open") & (F.col("before") < settings.review_cap)
    taken = F.when(
        fetched & F.col("running"),
        F.least(F.col("added"), F.lit(settings.review_cap) - F.col("before")),
    ).otherwise(F.lit(0))
    return rows.select(
        "listing_id",
        "page_no",
        fetched.alias("fetched"),
        taken.alias("reviews_added"),
        (fetched & F.col("running") & (F.col("before") + F.col("added") > settings.review_cap)).alias("truncated"),
    )
