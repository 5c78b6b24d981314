"""Prices in US dollars, by a rate table of units per dollar."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewtrust.functions.numbers import half_even


def with_usd(prices: DataFrame, rates: DataFrame) -> DataFrame:
    """Add ``price_usd``; null for an unknown currency or an unusable rate.

    Ties at half a cent follow the shortest decimal form of the quotient.
    """
    keyed = prices.withColumn("_code", F.upper(F.trim(F.coalesce("currency", F.lit("")))))
    known = rates.select(F.upper("currency").alias("_code"), "rate").where(F.col("rate") > 0)
    usd = F.when(F.col("_code") == "USD", F.col("price")).otherwise(F.col("price") / F.col("rate"))
    return (
        keyed.join(known, "_code", "left")
        .withColumn("price_usd", half_even(usd, 2))
        .drop("_code", "rate")
    )
