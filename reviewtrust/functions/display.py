"""Display text for ratings, durations, views, verdicts and themes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewtrust.functions.numbers import join_text

# Labels and styles per recommendation.
RECOMMENDATION_LABELS = {
    "BUY_WITH_CONFIDENCE": "Buy with confidence",
    "BUY_WITH_CAUTION": "Buy with caution",
    "PROCEED_WITH_CAUTION": "Proceed with caution",
    "AVOID": "Consider avoiding",
    "INSUFFICIENT_DATA": "Not enough data",
}
RECOMMENDATION_STYLES = {
    "BUY_WITH_CONFIDENCE": "buy",
    "BUY_WITH_CAUTION": "caution",
    "PROCEED_WITH_CAUTION": "caution",
    "AVOID": "avoid",
    "INSUFFICIENT_DATA": "unknown",
}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def stars(rating: Column) -> Column:
    full = F.floor(rating)
    half = F.when(rating - full >= 0.5, F.lit("½")).otherwise(F.lit(""))
    return F.coalesce(F.concat(F.repeat(F.lit("★"), full.cast("int")), half), F.lit(""))


def duration(seconds: Column) -> Column:
    text = join_text(F.floor(seconds / 60), ":", F.lpad((seconds % 60).cast("string"), 2, "0"))
    return F.when(F.coalesce(seconds, F.lit(0)) == 0, F.lit("")).otherwise(text)


def _tenths(x: Column) -> Column:
    """A number from 1 on with one decimal, rounded by its exact binary value, ties to even digits, as C's printf does.

    ``format_string`` and ``round`` go by the shortest decimal that reads back as the number: 1.15 is a little less than that.
    """
    # Below a number's whole part lie at most 52 bits, so everything here is exact.
    bits = 1 << 52
    scaled = ((x - F.floor(x)) * F.lit(float(bits))).cast("bigint") * 10
    down = F.shiftright(scaled, 52)
    rest = scaled - F.shiftleft(down, 52)
    up = (rest > bits // 2) | ((rest == bits // 2) & (down % 2 == 1))
    tenths = F.floor(x) * 10 + down + up.cast("bigint")
    return join_text(F.floor(tenths / 10), ".", tenths % 10)


def views(count: Column) -> Column:
    # Half a thousand rounds up here, as it is shown to people.
    return (
        F.when(F.coalesce(count, F.lit(0)) == 0, F.lit(""))
        .when(count >= 1_000_000, F.concat(_tenths(count / 1e6), F.lit("M views")))
        .when(count >= 1_000, join_text(F.floor(count / 1e3 + 0.5), "K views"))
        .otherwise(join_text(count, " views"))
    )


def recommendation_label(value: Column) -> Column:
    return _lookup(RECOMMENDATION_LABELS, value)


def recommendation_style(value: Column) -> Column:
    return _lookup(RECOMMENDATION_STYLES, value)


def score_colour(score: Column) -> Column:
    return F.when(score >= 70, "ok").when(score >= 40, "warn").otherwise("err")


def split_themes(themes: Column) -> Column:
    """Ordered {label, sentiment} themes to {positive, negative} label lists.

    A mixed theme joins whichever list is shorter when its turn comes, positive on a tie.
    """
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("positive"), empty.alias("negative"))

    def place(acc: Column, theme: Column) -> Column:
        label = F.array(theme["label"])
        to_positive = (theme["sentiment"] == "positive") | (
            ~F.coalesce(theme["sentiment"], F.lit("mixed")).isin("positive", "negative")
            & (F.size(acc["positive"]) <= F.size(acc["negative"]))
        )
        to_positive = F.coalesce(to_positive, F.size(acc["positive"]) <= F.size(acc["negative"]))
        return F.struct(
            F.when(to_positive, F.concat(acc["positive"], label)).otherwise(acc["positive"]).alias("positive"),
            F.when(to_positive, acc["negative"]).otherwise(F.concat(acc["negative"], label)).alias("negative"),
        )

    return F.aggregate(themes, start, place)
