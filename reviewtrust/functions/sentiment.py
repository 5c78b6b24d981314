"""Sentiment and specificity measurements of one review: projections only, no shuffle."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewtrust.config import DEFAULTS, Settings
from reviewtrust.functions import lexicon
from reviewtrust.functions.numbers import fixed
from reviewtrust.functions.text import normalize, tokens


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def phrases_in(normalized: Column, phrases: list[str]) -> Column:
    """Which phrases occur, as plain substrings of the normalized text."""
    return F.filter(_strings(phrases), lambda p: F.contains(normalized, p))


def _phrase_words(phrases: list[str]) -> Column:
    sizes = {p: len(re.findall(r"[a-z0-9']+", p)) for p in phrases}
    return F.create_map(*[F.lit(x) for p, n in sizes.items() for x in (p, n)])


def with_sentiment(df: DataFrame, text: str = "text", praise_only: bool = False, words: str | None = None) -> DataFrame:
    """Add word_count, polarity, intensity, generic_*, specific_markers and specificity.

    With ``praise_only`` the phrase and pattern searches run only on one-sidedly positive
    texts, and the other rows keep zeros there. :func:`contentless` is the same either way.
    ``words`` names a column that keeps the tokens.
    """
    # Normalizing leaves the tokens' characters and the breaks between them alone: these are the normalized text's tokens too.
    df = df.withColumn("_words", tokens(F.col(text)))
    listed = [*lexicon.POSITIVE, *lexicon.NEGATIVE, *lexicon.INTENSIFIERS]
    df = df.withColumn("_listed", F.filter("_words", lambda w: w.isin(listed)))
    n = F.col("word_count")
    df = df.withColumns(
        {
            "word_count": F.size("_words"),
            "_pos": F.size(F.filter("_listed", lambda w: w.isin(lexicon.POSITIVE))),
            "_neg": F.size(F.filter("_listed", lambda w: w.isin(lexicon.NEGATIVE))),
            "_int": F.size(F.filter("_listed", lambda w: w.isin(lexicon.INTENSIFIERS))),
        }
    )
    hits = F.col("_pos") + F.col("_neg")
    df = df.withColumns(
        {
            "polarity": F.when(hits > 0, (F.col("_pos") - F.col("_neg")) / hits).otherwise(F.lit(0.0)),
            "intensity": F.when(n > 0, F.col("_int") / n).otherwise(F.lit(0.0)),
        }
    )
    searched = (F.col("polarity") >= 0.8) if praise_only else F.lit(True)
    df = df.withColumn("_norm", F.when(searched, normalize(F.col(text))))

    def count(column: str, pattern: str) -> Column:
        found = F.regexp_count(F.coalesce(F.col(column), F.lit("")), F.lit(pattern))
        return F.when(searched, found).otherwise(F.lit(0))

    nothing = F.array().cast("array<string>")
    df = df.withColumns(
        {
            "generic_phrases": F.when(
                searched, phrases_in(F.col("_norm"), lexicon.GENERIC_PRAISE)
            ).otherwise(nothing),
            "specific_markers": F.when(
                searched, phrases_in(F.col("_norm"), lexicon.SPECIFIC_MARKERS)
            ).otherwise(nothing),
            "_units": count("_norm", "(?iU)" + lexicon.UNIT_PATTERN),
            "_numbers": count("_norm", "(?U)" + lexicon.NUMBER_PATTERN),
            "_prices": count(text, "(?iU)" + lexicon.PRICE_PATTERN),
        }
    )
    word_totals = _phrase_words(lexicon.GENERIC_PRAISE)
    generic_words = F.aggregate(
        F.col("generic_phrases"), F.lit(0), lambda acc, p: acc + word_totals[p]
    )
    evidence = (
        F.col("_units") * 2
        + F.size("specific_markers") * 2
        + F.col("_prices") * 2
        + F.least(F.col("_numbers"), F.lit(4))
    )
    df = df.withColumns(
        {
            "generic_ratio": F.when(
                n > 0, F.least(F.lit(1.0), generic_words / n)
            ).otherwise(F.lit(0.0)),
            "specificity": F.when(
                n > 0, F.least(F.lit(1.0), evidence / F.lit(10.0))
            ).otherwise(F.lit(0.0)),
        }
    )
    if words:
        df = df.withColumn(words, F.col("_words"))
    return df.drop("_norm", "_words", "_listed", "_pos", "_neg", "_int", "_units", "_numbers", "_prices")


def contentless() -> Column:
    """Praise with nothing in it, over the columns of :func:`with_sentiment`."""
    return (
        (F.col("word_count") > 0)
        & (F.col("polarity") >= 0.8)
        & (F.col("specificity") <= 0.2)
        & (F.size("specific_markers") == 0)
        & ((F.col("generic_ratio") >= 0.30) | (F.col("word_count") <= 25))
    )


def contentless_weight(settings: Settings = DEFAULTS) -> Column:
    brief = (
        F.when((F.col("word_count") <= 15) & (F.col("specificity") == 0.0), F.lit(0.45))
        .when(F.col("word_count") <= 25, F.lit(0.20))
        .otherwise(F.lit(0.0))
    )
    factor = F.least(F.lit(1.0), F.lit(0.55) + F.greatest(F.col("generic_ratio"), brief))
    return F.lit(settings.weight_contentless) * factor


def contentless_detail() -> Column:
    signed = fixed(F.col("polarity"), 2, signed=True)
    stock = F.array_join(F.slice("generic_phrases", 1, 3), ", ")
    pieces = F.concat_ws(
        "; ",
        F.concat(F.lit("polarity "), signed),
        F.concat(F.lit("specificity "), fixed(F.col("specificity"), 2)),
        F.when(F.size("generic_phrases") > 0, F.concat(F.lit("stock phrases: "), stock)),
        F.when(
            F.col("word_count") <= 25,
            F.concat(F.lit("only "), F.col("word_count").cast("string"), F.lit(" words")),
        ),
    )
    return F.concat(F.lit("uniform praise with no specifics — "), pieces)
