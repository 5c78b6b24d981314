"""Reading ratings, dates, votes and badges out of page text."""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewtrust.functions.text import squeeze

# Interface phrases and patterns found in review markup.
BOILERPLATE_PATTERN = (
    r"(brief content visible,?\s*double tap to read full content"
    r"|full content visible,?\s*double tap to read brief content"
    r"|double tap to read (?:full|brief) content"
    r"|read (?:more|less)\b"
    r"|show (?:more|less)\b"
    r"|see more\b"
    r"|report abuse"
    r"|was this (?:review )?helpful"
    r"|helpful\s*\|?\s*report"
    r"|\d[\d,.]*\s*(?:people|persons?)?\s*found this helpful"
    r"|translate (?:review )?to english"
    r"|originally (?:posted|published) in"
    r"|verified purchase"
    r"|top \d+ reviewer"
    r"|vine customer review of free product)"
)
#: Every match of the pattern holds one of these.
BOILERPLATE_FRAGMENTS = [
    "content visible", "double tap to read", "read more", "read less", "show more", "show less", "see more", "report abuse",
    "helpful", "translate ", "originally p", "verified purchase", " reviewer", "vine customer",
]
VERIFIED_PATTERN = (
    r"verified\s+(purchase|buyer|owner|customer)|confirmed\s+purchase|"
    r"achat\s+v[eé]rifi[eé]|verifizierter\s+kauf"
)
HELPFUL_PATTERN = r"(\d[\d,.]*)\s*(?:people|persons?|users?)?\s*(?:found|voted|thought)"
RATING_PAIR_PATTERN = r"(?i)(\d+(?:[.,]\d+)?)\s*(?:out of|/|von|sur)\s*(\d+(?:[.,]\d+)?)"
NUMBER_PATTERN = r"(\d+(?:[.,]\d+)?)"
DATE_PREFIX_PATTERN = r"(?i)^.*?\bon\s+|^reviewed\s+|^published\s+|^posted\s+|^date[:\s]+"
RELATIVE_DATE_PATTERN = r"(?i)^(\d+)\s+(day|week|month|year|hour|minute)s?\s+ago"
RATING_WORD_PATTERN = r"(?i)\b(stars?|rating|out of|verified|helpful)\b"
DATE_LIKE_PATTERN = (
    r"(?i)\b(19|20)\d{2}\b|\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
    r"|\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}"
)
MONTHS = [
    ("jan", "january"), ("feb", "february"), ("mar", "march"), ("apr", "april"), ("may",), ("jun", "june"),
    ("jul", "july"), ("aug", "august"), ("sep", "sept", "september"), ("oct", "october"), ("nov", "november"), ("dec", "december"),
]
_MONTH_NAMES = "|".join(sorted((name for names in MONTHS for name in names), key=len, reverse=True))
DATE_TOKEN_PATTERN = rf"(?<![a-z])(?:{_MONTH_NAMES})(?![a-z])|\d+"
TIME_PATTERN = (
    r"(?i)(?<!\d)\d{1,2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?(?:\s*[ap]\.?m\b\.?)?(?:\s*(?:z|utc|gmt)\b)?(?:\s*[+-]\d{2}:?\d{2}\b)?"
    r"|(?<!\d)\d{1,2}\s*[ap]m\b"
)
UNIT_DAYS = {"hour": 0, "minute": 0, "day": 1, "week": 7, "month": 30, "year": 365}


def _let(value: Column, body) -> Column:
    """``body(value)`` with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _mentions(text: Column, fragments: list[str]) -> Column:
    """Does the text hold one of the fragments, in any case? A plain search that spares most texts the patterns."""

    listed = F.split(F.lit("|".join(fragments)), r"\|")

    def held(low: Column) -> Column:
        return F.exists(listed, lambda fragment: F.contains(low, fragment))

    return _let(F.lower(text), held)


def strip_boilerplate(text: Column) -> Column:
    """Drop interface phrases and the punctuation they leave stranded."""

    def stripped(t: Column) -> Column:
        return F.when(
            _mentions(t, BOILERPLATE_FRAGMENTS), F.regexp_replace(t, "(?i)" + BOILERPLATE_PATTERN, " ")
        ).otherwise(t)

    cleaned = squeeze(_let(F.coalesce(text, F.lit("")), stripped))
    collapsed = F.regexp_replace(cleaned, r"(?:\s*[.·|,;:]\s*){2,}", ". ")
    return F.trim(F.regexp_replace(collapsed, r"^[\s.·|,;:\-–—]+", ""))


def verified_badge(text: Column) -> Column:
    """True, or null: a missing badge proves nothing."""
    return F.when(_mentions(text, ["rifi", "confirmed"]) & text.rlike("(?i)" + VERIFIED_PATTERN), F.lit(True))


def helpful_votes(text: Column) -> Column:
    def read(t: Column) -> Column:
        raw = F.when(_mentions(t, ["found", "voted", "thought"]), F.regexp_extract(t, "(?i)" + HELPFUL_PATTERN, 1))
        return F.regexp_replace(F.coalesce(raw, F.lit("")), "[,.]", "").try_cast("int")

    return _let(F.coalesce(text, F.lit("")), read)


def normalize_rating(value: Column, scale: Column | float = 5.0) -> Column:
    """Any printed rating on a five-point scale; null when the scale was misread."""
    text = F.trim(value.cast("string"))
    scale = F.lit(float(scale)) if isinstance(scale, (int, float)) else scale
    scale = F.when(F.coalesce(scale, F.lit(0.0)) == 0, F.lit(5.0)).otherwise(scale)

    def number(pattern: str, group: int) -> Column:
        return F.replace(F.regexp_extract(text, pattern, group), F.lit(","), F.lit(".")).try_cast("double")

    paired = text.rlike(RATING_PAIR_PATTERN)
    rating = F.when(paired, number(RATING_PAIR_PATTERN, 1)).otherwise(number(NUMBER_PATTERN, 1))
    top = (
        F.when(paired, number(RATING_PAIR_PATTERN, 2))
        .when(text.contains("%"), F.lit(100.0))
        .otherwise(scale)
    )
    top = F.when(top == 0, F.lit(5.0)).otherwise(top)
    scaled = rating * (F.lit(5.0) / top)
    return F.when(
        (rating > 0) & (top > 0) & (scaled <= 5.5), F.bround(F.least(scaled, F.lit(5.0)), 2)
    )


def _date_tokens(text: Column) -> Column:
    """Numbers and month names in order: (month or 0, number, whether it has more than two digits)."""
    bare = F.regexp_replace(text, r"(?i)(?<=\d)t(?=\d{1,2}:)", " ")
    bare = F.regexp_replace(F.regexp_replace(bare, TIME_PATTERN, " "), r"(?<!\d)(\d{4})(\d{2})(\d{2})(?!\d)", "$1 $2 $3")
    number = F.expr("map(" + ", ".join(f"'{name}', {k}" for k, names in enumerate(MONTHS, 1) for name in names) + ")")
    return F.transform(
        F.regexp_extract_all(F.lower(bare), F.lit(DATE_TOKEN_PATTERN), F.lit(0)),
        lambda t: F.struct(
            F.coalesce(F.try_element_at(number, t), F.lit(0)).alias("month"),
            t.try_cast("int").alias("number"),
            (F.length(t) > 2).alias("long"),
        ),
    )


def _date_of(tokens: Column, today: Column) -> Column:
    """The date that one to three tokens mean, by which of them can only be a year and where the month name stands.

    What is missing is taken from ``today``, the day at most the month's last.
    """
    at = [F.get(tokens, F.lit(k)) for k in range(3)]
    n, named = F.size(tokens), F.size(F.filter(tokens, lambda t: t["month"] > 0))
    name_at = (F.array_position(F.transform(tokens, lambda t: t["month"] > 0), True) - 1).cast("int")
    none = F.struct(F.lit(0).alias("month"), F.lit(None).cast("int").alias("number"), F.lit(False).alias("long"))

    def year_like(k: int) -> Column:
        return at[k]["long"] | (at[k]["number"] > 31)

    def parts(year: Column, month: Column, day: Column) -> Column:
        return F.struct(year.alias("year"), month.alias("month"), day.alias("day"))

    month = F.get(tokens, name_at)["month"]
    two = F.when(name_at == 0, at[1]).otherwise(at[0])
    first, second, third = (x["number"] for x in at)
    chosen = (
        F.when((n > 3) | (n == 0) | (named > 1), None)
        .when((n == 1) & (named == 1), parts(none, month, none["number"]))
        .when(n == 1, F.when(year_like(0), parts(at[0], none["number"], none["number"])).otherwise(parts(none, none["number"], first)))
        .when(
            (n == 2) & (named == 1),
            F.when(two["long"] | (two["number"] > 31), parts(two, month, none["number"])).otherwise(parts(none, month, two["number"])),
        )
        .when(
            n == 2,
            F.when(year_like(0), parts(at[0], second, none["number"]))
            .when(year_like(1), parts(at[1], first, none["number"]))
            .otherwise(parts(none, first, second)),
        )
        .when(name_at == 0, F.when(year_like(1), parts(at[1], month, third)).otherwise(parts(at[2], month, second)))
        .when(name_at == 1, F.when(year_like(0), parts(at[0], month, third)).otherwise(parts(at[2], month, first)))
        .when(name_at == 2, F.when(year_like(1), parts(at[1], month, first)).otherwise(parts(at[0], month, second)))
        .when(year_like(0), parts(at[0], second, third))
        .when(first > 12, parts(at[2], second, first))
        .otherwise(parts(at[2], first, second))
    )

    def dated(p: Column) -> Column:
        near = p["year"]["number"] + F.floor(F.year(today) / 100).cast("int") * 100
        full = F.when(p["year"]["long"], p["year"]["number"]).otherwise(
            F.when(near >= F.year(today) + 50, near - 100).when(near < F.year(today) - 50, near + 100).otherwise(near)
        )
        year, mon = F.coalesce(full, F.year(today)), F.coalesce(p["month"], F.month(today))
        first_day = F.try_to_date(F.concat_ws("-", year.cast("string"), mon.cast("string"), F.lit("1")), "y-M-d")
        day = F.coalesce(p["day"], F.least(F.dayofmonth(today), F.dayofmonth(F.last_day(first_day))))
        return F.try_to_date(F.concat_ws("-", year.cast("string"), mon.cast("string"), day.cast("string")), "y-M-d")

    return F.when(chosen.isNotNull(), _let(chosen, dated))


def parse_date(value: Column, as_of: datetime.date | Column) -> Column:
    """The day a printed date means, or null. Relative dates count back from ``as_of``, and missing parts are taken from it.

    Dates are read as numbers and English month names in any order and punctuation, with a time of day or without; a number of
    two digits is a year of the hundred around ``as_of`` where it stands for one.
    """
    today = as_of if isinstance(as_of, Column) else F.lit(as_of)
    raw = F.trim(value)
    cleaned = F.trim(F.regexp_replace(raw, DATE_PREFIX_PATTERN, ""))
    amount = F.regexp_extract(cleaned, RELATIVE_DATE_PATTERN, 1).try_cast("int")
    unit = F.lower(F.regexp_extract(cleaned, RELATIVE_DATE_PATTERN, 2))
    per_unit = F.create_map(*[F.lit(x) for pair in UNIT_DAYS.items() for x in pair])
    relative = F.date_sub(today, amount * F.try_element_at(per_unit, unit))
    absolute = _let(_date_tokens(cleaned), lambda tokens: _date_of(tokens, today))
    return (
        F.when(raw.isNull() | (raw == ""), F.lit(None).cast("date"))
        .when(amount.isNotNull(), relative)
        .when(cleaned.rlike(RATING_WORD_PATTERN), F.lit(None).cast("date"))
        .when(
            cleaned.rlike(DATE_LIKE_PATTERN),
            _let(absolute, lambda d: F.when(F.year(d).between(F.lit(1995), F.year(today) + 1), d)),
        )
    )
