"""Removing personal data from values bound for a log."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keys never logged, and what is masked inside free text.
SENSITIVE_KEYS = ["author", "reviewer", "reviewer_name", "email", "user", "username", "profile"]
EMAIL_PATTERN = r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b"
LONG_DIGITS_PATTERN = r"\b\d{9,}\b"
MAX_TEXT = 200
MAX_ITEMS = 20


def scrub_text(text: Column) -> Column:
    masked = F.regexp_replace(text, "(?U)" + EMAIL_PATTERN, "[email]")
    masked = F.regexp_replace(masked, "(?U)" + LONG_DIGITS_PATTERN, "[digits]")
    return F.when(
        F.length(masked) > MAX_TEXT, F.concat(F.left(masked, F.lit(MAX_TEXT)), F.lit("…"))
    ).otherwise(masked)


def scrub_field(name: str, value: Column) -> Column:
    """Scrub one named string column; personal fields are replaced whole."""
    if name.lower() in SENSITIVE_KEYS:
        return F.when(value.isNotNull(), F.lit("[redacted]"))
    return scrub_text(value)


def scrub_list(values: Column) -> Column:
    return F.transform(F.slice(values, 1, MAX_ITEMS), scrub_text)


def scrub_map(values: Column) -> Column:
    return F.transform_values(
        values,
        lambda k, v: F.when(F.lower(k).isin(SENSITIVE_KEYS), F.lit("[redacted]")).otherwise(scrub_text(v)),
    )
