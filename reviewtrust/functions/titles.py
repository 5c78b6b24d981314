"""Product-title columns: tokens, model numbers, specifications, identifiers, brand."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewtrust.functions.text import squeeze

# Word lists, units and patterns of product matching.
TITLE_STOP_WORDS = [
    "the", "a", "an", "and", "or", "with", "for", "in", "on", "of", "to", "by",
    "new", "genuine", "official", "original", "authentic", "brand",
    "free", "shipping", "sale", "deal", "best", "top", "premium", "pro",
    "buy", "shop", "online", "store", "item", "product", "model",
    "edition", "version", "series", "generation", "gen",
    "color", "colour", "size", "pack", "count", "piece", "pieces", "set",
    "includes", "included", "bundle", "kit",
    "wireless", "bluetooth",
    "amazon", "walmart", "bestbuy", "ebay", "target",
    "renewed", "refurbished", "used", "open", "box",
]
SPEC_UNITS = {
    "gb": "capacity", "tb": "capacity", "mb": "capacity",
    "mm": "size", "cm": "size", "inch": "size", "in": "size", '"': "size",
    "oz": "volume", "ml": "volume", "l": "volume", "litre": "volume", "liter": "volume",
    "quart": "volume", "qt": "volume", "gallon": "volume", "gal": "volume",
    "pint": "volume", "pt": "volume",
    "w": "power", "kw": "power", "wh": "power", "mah": "power", "v": "power",
    "hz": "frequency", "khz": "frequency", "ghz": "frequency",
    "mp": "resolution", "k": "resolution", "p": "resolution",
    "kg": "weight", "g": "weight", "lb": "weight", "lbs": "weight",
    "ct": "count", "pc": "count", "pcs": "count",
}
UNITS = (
    "gb|tb|mb|mm|cm|inch|in|oz|ml|litre|liter|quart|qts|qt|gallon|gal|pint|pt|l|kwh|kw|wh|mah|"
    "w|v|khz|ghz|hz|mp|kg|lbs|lb|g|ct|pcs|pc|k|p"
)
SPEC_PATTERN = rf'(\d+(?:\.\d+)?)\s*({UNITS}|")s?(?:\b|(?=\s)|$)'
MEASUREMENT_PATTERN = rf"(?i)^\d+(?:\.\d+)?({UNITS})s?$"
MODEL_PATTERN = r"^[a-z0-9][a-z0-9\-/]{2,}$"
GENERATION_WORDS = [
    "iphone", "ipad", "imac", "macbook", "watch", "airpods",
    "pixel", "galaxy", "playstation", "ps", "xbox", "switch",
    "surface", "note", "fold", "flip", "mark", "mk", "gt",
]
IDENTIFIER_KEYS = ["upc", "ean", "gtin", "gtin13", "gtin12", "isbn", "mpn", "model", "sku"]
ACCESSORY_PATTERN = (
    r"\b(case|cover|sleeve|pouch|holster|skin|decal|wrap|"
    r"screen protector|protector|tempered glass|"
    r"ear ?pads?|ear ?tips?|ear ?cushions?|foam tips?|"
    r"charger|charging (?:cable|dock|stand|pad)|cable|cord|adapter|adaptor|dock|"
    r"stand|mount|holder|bracket|tripod|grip|"
    r"strap|band|lanyard|"
    r"replacement|spare|refill|filter|"
    r"lens cap|hood|remote|stylus|"
    r"carrying|travel case|hard case)\b"
)
FOR_PATTERN = (
    r"\b(for|compatible with|fits|designed for|suitable for|replacement for)\s+(the\s+)?[a-z0-9]"
)


def normalize_title(title: Column) -> Column:
    lowered = F.replace(F.lower(F.coalesce(title, F.lit(""))), F.lit("&"), F.lit(" and "))
    return squeeze(F.regexp_replace(lowered, r'[^\p{L}\p{N}_\s\-/".]', " "))


def title_tokens(title: Column) -> Column:
    """Meaningful tokens, in order and with repeats."""
    stripped = F.transform(
        F.split(normalize_title(title), " "), lambda t: F.regexp_replace(t, r"^[-/.]+|[-/.]+$", "")
    )
    return F.filter(
        stripped,
        lambda t: (t != "")
        & ~t.isin(TITLE_STOP_WORDS)
        & ((F.length(t) > 1) | t.rlike(r"(?U)^\d$")),
    )


def model_tokens(tokens: Column, legacy_measurement_tokens: bool = False) -> Column:
    """Tokens that name a model, separators removed.

    A plain measurement ("128gb") is not a model number. ``legacy_measurement_tokens``
    counts it as one, as the original scores did.
    """
    paired = F.zip_with(
        tokens,
        F.concat(F.array(F.lit("")), tokens),
        lambda t, before: F.struct(t.alias("t"), before.alias("before")),
    )

    def is_model(p: Column) -> Column:
        t = p["t"]
        mixed = t.rlike(MODEL_PATTERN) & t.rlike("[0-9]") & t.rlike("[a-z]")
        numbered = t.rlike(r"^\d{1,3}$") & p["before"].isin(GENERATION_WORDS)
        found = mixed | numbered
        return found if legacy_measurement_tokens else found & ~t.rlike(MEASUREMENT_PATTERN)

    kept = F.filter(paired, lambda p: p["t"].isNotNull() & is_model(p))
    return F.transform(kept, lambda p: F.regexp_replace(p["t"], "[-/]", ""))


def specs(title: Column) -> Column:
    """Distinct {dimension, value} pairs stated in a title, such as {capacity, 128gb}."""
    text = normalize_title(title)
    values = F.regexp_extract_all(text, F.lit(SPEC_PATTERN), F.lit(1))
    units = F.regexp_extract_all(text, F.lit(SPEC_PATTERN), F.lit(2))
    dimension = F.create_map(*[F.lit(x) for pair in SPEC_UNITS.items() for x in pair])

    def plain(v: Column) -> Column:
        trimmed = F.regexp_replace(v, r"^0+(\d)", "$1")
        return F.when(
            trimmed.contains("."), F.regexp_replace(trimmed, r"\.?0+$", "")
        ).otherwise(trimmed)

    pairs = F.zip_with(
        values,
        units,
        lambda v, u: F.struct(
            dimension[u].alias("dimension"),
            F.concat(plain(v), F.when(u == '"', F.lit("inch")).otherwise(u)).alias("value"),
        ),
    )
    return F.array_distinct(F.filter(pairs, lambda s: s["dimension"].isNotNull()))


def identifiers(ids: Column) -> Column:
    """Comparable identifiers: known keys, letters and digits only, four or more of them."""
    cleaned = F.transform_values(ids, lambda _, v: F.regexp_replace(F.lower(v), "[^a-z0-9]", ""))
    return F.coalesce(
        F.map_filter(cleaned, lambda k, v: k.isin(IDENTIFIER_KEYS) & (F.length(v) >= 4)),
        F.create_map().cast("map<string,string>"),
    )


def brand_of(title: Column, declared: Column) -> Column:
    first_word = F.nullif(F.split(normalize_title(declared), " ")[0], F.lit(""))
    return F.when(F.trim(F.coalesce(declared, F.lit(""))) != "", first_word).otherwise(
        F.get(title_tokens(title), F.lit(0))
    )


def accessory_signal(title: Column) -> Column:
    """Why a title describes an accessory; null if it does not."""
    text = normalize_title(title)
    term = F.nullif(F.regexp_extract(text, "(?iU)" + ACCESSORY_PATTERN, 1), F.lit(""))
    return F.coalesce(
        F.concat(F.lit("accessory term '"), term, F.lit("'")),
        F.when(text.rlike("(?iU)" + FOR_PATTERN), F.lit("describes itself as being for another product")),
    )
