"""Stored analysis results: an append-only log, its current state, lookups and expiry.

The current state is an aggregate (``max_by`` per key, combined map-side), not a window,
so a key rewritten very often is not gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewtrust.config import DEFAULTS, Settings


def expiry(status: Column, created_at: Column, settings: Settings = DEFAULTS) -> Column:
    """A thin or failed result expires sooner."""
    hours = F.when(status == "ok", F.lit(settings.ttl_hours)).otherwise(F.lit(settings.ttl_thin_hours))
    return created_at + F.make_interval(hours=hours)


def put_rows(results: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Rows to append to the result log; rows without a key are not stored."""
    return results.where(F.col("cache_key").isNotNull()).withColumn(
        "expires_at", expiry(F.col("status"), F.col("created_at"), settings)
    )


def append(results: DataFrame, path: str, settings: Settings = DEFAULTS) -> None:
    put_rows(results, settings).write.mode("append").parquet(path)


def current(log: DataFrame) -> DataFrame:
    """The live row per key: last write wins, but a null name or URL keeps the older one.

    ``log``: cache_key, seq, product_name, canonical_url, status, payload, review_count,
    created_at, expires_at. ``seq`` breaks ties between equal times.
    """
    order = F.struct("created_at", "seq")

    def last(column: str) -> Column:
        return F.max_by(column, order).alias(column)

    def last_known(column: str) -> Column:
        return F.max_by(column, F.when(F.col(column).isNotNull(), order)).alias(column)

    return log.groupBy("cache_key").agg(
        last_known("product_name"),
        last_known("canonical_url"),
        last("status"),
        last("payload"),
        last("review_count"),
        last("created_at"),
        last("expires_at"),
        F.count("*").alias("writes"),
    )


def live(snapshot: DataFrame, as_of: Column) -> DataFrame:
    return snapshot.where(F.col("expires_at") > as_of)


def purge(snapshot: DataFrame, as_of: Column) -> DataFrame:
    """What is left after deleting expired rows."""
    return live(snapshot, as_of)


def invalidate(snapshot: DataFrame, keys: DataFrame) -> DataFrame:
    """Drop the rows of the given keys."""
    return snapshot.join(keys.select("cache_key").distinct(), "cache_key", "left_anti")


def lookup(requests: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Add ``hit`` and ``age_seconds`` to each request (request_id, ts, cache_key)."""
    stored = snapshot.select("cache_key", "created_at", "expires_at", F.col("status").alias("cached_status"))
    hit = F.coalesce(
        (F.col("created_at") <= F.col("ts")) & (F.col("expires_at") > F.col("ts")), F.lit(False)
    )
    age = F.unix_seconds("ts") - F.unix_seconds("created_at")
    return requests.join(stored, "cache_key", "left").select(
        "request_id",
        "cache_key",
        hit.alias("hit"),
        F.when(hit, age).alias("age_seconds"),
        F.when(hit, F.col("cached_status")).alias("cached_status"),
    )


def hit_counts(lookups: DataFrame) -> DataFrame:
    return lookups.where("hit").groupBy("cache_key").agg(F.count("*").alias("hits"))


def store_stats(snapshot: DataFrame, hits: DataFrame, as_of: Column) -> DataFrame:
    """Entries, live entries and hits served."""
    return (
        snapshot.join(hits, "cache_key", "left")
        .agg(
            F.count("*").alias("entries"),
            F.count_if(F.col("expires_at") > as_of).alias("live"),
            F.coalesce(F.sum("hits"), F.lit(0)).alias("hits_served"),
        )
    )
