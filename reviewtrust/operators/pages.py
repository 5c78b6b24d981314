"""Bulk extraction from stored pages: reviews, product facts, identity, links, block pages.

``pages`` has page_id, url, html and, where known, status. Parsing and selection stay
inside a page's row; only choosing among a page's strategies groups by page.
"""

from __future__ import annotations

import datetime
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewtrust.functions import parse as P
from reviewtrust.functions.text import squeeze
from reviewtrust.functions.urls import (
    absolute_link,
    canonical_url,
    host,
    host_labels,
    path,
    shape_id,
    site_adapter,
)
from reviewtrust.sources import html as H
from reviewtrust.sources.rules import DEFAULT, RuleSet, literal

# Block-page markers, page-furniture words and the selectors of each field.
BLOCK_STATUSES = [401, 403, 407, 429, 503]
BLOCK_MARKERS = [
    "enter the characters you see below",
    "type the characters you see in this image",
    "to discuss automated access to amazon data",
    "api-services-support@amazon.com",
    "robot check",
    "are you a human",
    "verify you are a human",
    "unusual traffic from your computer",
    "access denied",
    "request blocked",
    "captcha-delivery.com",
    "cf-browser-verification",
    "checking your browser before accessing",
    "px-captcha",
    "please enable javascript and cookies to continue",
]
NOT_A_PRODUCT_PATTERN = (
    r"(?i)\b(search|results?|categor(y|ies)|collections?|catalog(ue)?|browse|deals?|shop all|"
    r"best ?sellers?|new arrivals|cart|basket|checkout|wish ?list|sign ?in|log ?in|register|"
    r"account|orders?|returns?|home ?page|404|not found|privacy|terms|contact|about us|blog|help|support)\b"
)
PRICE_NEAR_PATTERN = r"(?:[$£€¥₦₹]|USD|EUR|GBP|NGN)\s?\d"
CONTAINERS = [
    (None, "data-hook", "eq", "review"),
    (None, "data-review-id", "has", None),
    (None, "data-reviewid", "has", None),
    ("li", "class", "like", "review-item"),
    ("div", "class", "like", "review-item"),
    ("div", "class", "like", "review-card"),
    ("article", "class", "like", "review"),
    ("li", "class", "like", "reviews__item"),
    ("div", "class", "like", "ReviewCard"),
    ("div", "class", "like", "review-entry"),
    ("div", "itemprop", "eq", "review"),
    ("div", "class", "start", "review"),
    ("li", "class", "start", "review"),
]
BODIES = [
    ("span", "class", "absent", None, "data-hook", "review-body"),
    (None, "data-hook", "eq", "review-collapsed"),
    (None, "data-hook", "eq", "review-body"),
    (None, "class", "like", "review-text"),
    (None, "class", "like", "review-body"),
    (None, "class", "like", "review-content"),
    (None, "class", "like", "reviewText"),
    (None, "class", "like", "review-description"),
    (None, "itemprop", "eq", "reviewBody"),
    ("p", None, None, None),
]
RATINGS = [
    (None, "data-hook", "eq", "review-star-rating"),
    (None, "class", "like", "review-rating"),
    (None, "class", "like", "star-rating"),
    (None, "class", "like", "stars"),
    (None, "itemprop", "eq", "ratingValue"),
    (None, "aria-label", "has", None),
]
DATES = [
    (None, "data-hook", "eq", "review-date"),
    (None, "class", "like", "review-date"),
    (None, "class", "like", "date"),
    ("time", None, None, None),
    (None, "itemprop", "eq", "datePublished"),
]
AUTHORS = [
    (None, "class", "like", "profile-name"),
    (None, "class", "like", "review-author"),
    (None, "class", "like", "author"),
    (None, "class", "like", "reviewer"),
    (None, "itemprop", "eq", "author"),
]
TITLES = [
    (None, "data-hook", "eq", "review-title"),
    (None, "class", "like", "review-title"),
    (None, "class", "like", "review-heading"),
    ("h3", None, None, None),
    ("h4", None, None, None),
]
NOISE = [
    ("script", None, None, None),
    ("style", None, None, None),
    ("noscript", None, None, None),
    ("button", None, None, None),
    (None, "class", "word", "a-expander-prompt"),
    (None, "data-hook", "eq", "review-vote"),
    (None, "class", "like", "expander-prompt"),
    (None, "class", "like", "helpful"),
    (None, "class", "like", "vote"),
    (None, "class", "like", "report"),
    (None, "class", "like", "translate"),
]
NEXT_LINKS = [
    ("link", "rel", "word", "next"),
    ("a", "rel", "word", "next"),
]
NEXT_GUESSES = [
    ("a", "href", "has", None, "class", "a-last"),
    ("a", "href", "has", None, "data-hook", "pagination-bar"),
    ("a", "class", "like", "next"),
    ("a", "aria-label", "like", "next"),
    ("a", "title", "like", "next"),
]
DESCRIPTION_CHARS = 500


def looks_blocked(html: Column, status: Column) -> Column:
    """A bot wall rather than a page: by status, or by a marker near the top."""
    head = F.lower(F.left(html, F.lit(6000)))
    marked = F.exists(F.array(*[F.lit(m) for m in BLOCK_MARKERS]), lambda m: F.contains(head, m))
    return F.coalesce(status.isin(BLOCK_STATUSES), F.lit(False)) | F.coalesce(marked, F.lit(False))


def with_nodes(pages: DataFrame) -> DataFrame:
    parsed = pages.withColumn("nodes", H.dom_nodes(F.col("html")))
    return H.bind(parsed, nodes=F.col("nodes"))


# ---------------------------------------------------------------- JSON-LD fields


def _is(v: Column, path: str) -> Column:
    """A string field of a JSON object, null when it is anything else."""
    value = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(v, path, "string"))


def _filled(v: Column, path: str) -> Column:
    return F.nullif(F.trim(_is(v, path)), F.lit(""))


def _scalar(v: Column, path: str) -> Column:
    """A string or number field as text; objects and lists give null."""
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    plain = ~(kind.startswith("OBJECT") | kind.startswith("ARRAY"))
    return F.nullif(F.when(plain, F.try_variant_get(v, path, "string")), F.lit(""))


def _typed(v: Column, pattern: str) -> Column:
    """Does @type, alone or in a list, match the pattern?"""
    kind = F.coalesce(F.try_variant_get(v, "$['@type']", "array<string>"), F.array(F.try_variant_get(v, "$['@type']", "string")))
    return F.coalesce(F.exists(kind, lambda t: t.rlike(pattern)), F.lit(False))


def _named(v: Column, key: str) -> Column:
    """A name given as text, as an object with a name, or as the first of a list of either."""
    return F.coalesce(
        _is(v, f"$.{key}"), _is(v, f"$.{key}.name"), _is(v, f"$.{key}[0]"), _is(v, f"$.{key}[0].name")
    )


# ---------------------------------------------------------------- reviews of a page

#: Selectors of the one walk over a page, by their place in this list.
_GROUPS = {
    "container": CONTAINERS,
    "title": TITLES,
    "body": BODIES,
    "rating": RATINGS,
    "date": DATES,
    "author": AUTHORS,
    "noise": NOISE,
    "scope": [(None, "itemtype", "like", "schema.org/Review"), (None, "itemtype", "like", "schema.org/UserReview")],
    "nested": [(None, "data-hook", "eq", "review"), (None, "data-review-id", "has", None)],
    "star": [(None, "class", "like", "star")],
}
_FIRST = dict(zip(_GROUPS, accumulate([0, *map(len, _GROUPS.values())]), strict=False))
_SELECTORS = [H.of_fields(*s) for group in _GROUPS.values() for s in group]
_NOISE = [_FIRST["noise"] + k for k in range(len(NOISE))]
_LD_SCRIPT = ("type", "(?i)ld\\+json")
_LD_REVIEW = r"(?i)^(review|userreview|criticreview)$"

_page_reviews_parse = H.parsed_pages(_SELECTORS, _NOISE, _LD_SCRIPT, H.LD_KEYS, _LD_REVIEW)


def _group(nodes: Column, name: str) -> Column:
    return H.by_selector(nodes, _FIRST[name], len(_GROUPS[name]))


def _in_group(n: Column, name: str) -> Column:
    first, count = _FIRST[name], len(_GROUPS[name])
    return F.exists(n["marks"], lambda m: (m["k"] >= first) & (m["k"] < first + count))


def _let(value: Column, body) -> Column:
    """``body(value)`` with value computed once, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _review(kind: str, as_of: datetime.date, pos: Column, **fields: Column) -> Column:
    """One review of a page; ``text`` is null or short where it is none."""
    none = {"title": "string", "author": "string", "date_raw": "string", "rating": "double", "verified_purchase": "boolean", "helpful_votes": "int", "url": "string"}
    given = {k: fields.get(k, F.lit(None).cast(t)).cast(t) for k, t in none.items()}

    def dated(raw: Column) -> Column:
        return F.struct(raw.alias("raw"), P.parse_date(raw, as_of).alias("day"))

    return _let(_let(given["date_raw"], dated), lambda date: F.struct(
        pos.cast("int").alias("pos"),
        fields["text"].alias("text"),
        given["rating"].alias("rating"),
        date["day"].alias("review_date"),
        date["raw"].alias("date_raw"),
        given["author"].alias("author"),
        given["title"].alias("title"),
        given["verified_purchase"].alias("verified_purchase"),
        given["helpful_votes"].alias("helpful_votes"),
        given["url"].alias("url"),
        fields.get("extracted_by", F.lit(kind)).alias("extracted_by"),
    ))


def _ld_review(v: Column, pos: Column, url: Column, as_of: datetime.date) -> Column:
    raw_rating = F.coalesce(*[_scalar(v, p) for p in ("$.reviewRating.ratingValue", "$.reviewRating[0].ratingValue", "$.reviewRating", "$.rating.ratingValue", "$.rating")])
    best = F.coalesce(*[_scalar(v, p).try_cast("double") for p in ("$.reviewRating.bestRating", "$.reviewRating[0].bestRating", "$.rating.bestRating")], F.lit(5.0))
    link = _filled(v, "$.url")
    return _review(
        "json-ld",
        as_of,
        pos,
        text=P.strip_boilerplate(F.coalesce(_filled(v, "$.reviewBody"), _filled(v, "$.description"), _filled(v, "$.text"))),
        rating=_let(F.struct(raw_rating.alias("raw"), best.alias("best")), lambda r: P.normalize_rating(r["raw"], r["best"])),
        date_raw=F.coalesce(_is(v, "$.datePublished"), _is(v, "$.dateCreated")),
        author=F.coalesce(_named(v, "author"), _named(v, "creator")),
        title=_is(v, "$.name"),
        url=F.when(link.isNotNull(), absolute_link(url, link)),
    )


def _micro_review(sub: Column, pos: Column, as_of: datetime.date) -> Column:
    def prop(name: str) -> Column:
        return F.filter(sub, lambda n: F.coalesce(H.attr(n, "itemprop") == name, F.lit(False)))

    def text_of_first(name: str) -> Column:
        return F.nullif(_let(F.get(prop(name), F.lit(0)), lambda n: H.text_of(sub, n)), F.lit(""))

    def read(name: str, *attributes: str) -> Column:
        return _let(F.get(prop(name), F.lit(0)), lambda n: H.first_value(F.array(*(H.attr(n, a) for a in attributes), H.text_of(sub, n))))

    bodies = F.concat(prop("reviewBody"), prop("description"))
    return _review(
        "microdata",
        as_of,
        pos,
        text=H.first_value(F.transform(bodies, lambda n: H.text_of(sub, n))),
        rating=_let(read("ratingValue", "content"), P.normalize_rating),
        date_raw=read("datePublished", "datetime", "content"),
        author=text_of_first("author"),
        title=text_of_first("name"),
    )


def rating_in(nodes: Column) -> Column:
    """A rating from labels and texts that speak of stars, else from a class name."""
    candidates = F.flatten(
        F.transform(
            _group(nodes, "rating"),
            lambda n: F.array(
                H.attr(n, "aria-label"), H.attr(n, "title"), H.attr(n, "content"), H.attr(n, "alt"), H.text_of(nodes, n)
            ),
        )
    )
    speaking = F.filter(
        candidates, lambda c: c.rlike(r"\d") & c.rlike(r"(?i)star|rating|out of|/\s*5|von 5")
    )
    coded = F.transform(
        F.filter(nodes, lambda n: _in_group(n, "star")),
        lambda n: F.regexp_extract(H.attr(n, "class"), r"(?i)(?:star|rating)[-_]?(\d(?:[.,]\d)?)", 1),
    )
    found = F.concat(
        F.transform(speaking, lambda c: P.normalize_rating(c)), F.transform(coded, lambda c: P.normalize_rating(c))
    )
    return F.get(F.array_compact(found), F.lit(0))


def _card(nodes: Column, c: Column, as_of: datetime.date) -> Column:
    """The review in a container, null where it holds several containers of reviews."""

    def fields(sub: Column, clean: Column, titles: Column) -> Column:
        bodies = F.filter(_group(clean, "body"), lambda n: ~F.exists(titles, lambda t: t["i"] == n["i"]))
        body = F.coalesce(H.first_value(F.transform(bodies, lambda n: H.text_of(clean, n))), H.text_of(clean, c))
        texts = F.struct(P.strip_boilerplate(body).alias("text"), H.text_of(sub, c).alias("blob"))
        return _let(
            texts,
            lambda x: F.when(
                F.length(x["text"]) >= 20,
                _review(
                    "dom",
                    as_of,
                    F.lit(0),
                    text=x["text"],
                    rating=rating_in(clean),
                    date_raw=H.first_value(F.transform(_group(clean, "date"), lambda n: H.text_of(clean, n))),
                    author=H.first_value(F.transform(_group(clean, "author"), lambda n: H.text_of(clean, n))),
                    title=H.first_value(F.transform(titles, lambda n: H.text_of(clean, n))),
                    verified_purchase=P.verified_badge(x["blob"]),
                    helpful_votes=P.helpful_votes(x["blob"]),
                ),
            ),
        )

    def whole(sub: Column) -> Column:
        quiet = F.filter(sub, lambda n: n["noise"] <= c["i"])
        made = _let(quiet, lambda clean: _let(_group(clean, "title"), lambda titles: fields(sub, clean, titles)))
        return F.when(F.size(F.filter(sub, lambda n: _in_group(n, "nested"))) <= 1, made)

    return _let(H.inside(nodes, c), whole)


def _cards(nodes: Column, as_of: datetime.date) -> Column:
    """Reviews of the container selector that yields most; of equal ones the first. Each container is read once."""
    first, count = _FIRST["container"], len(CONTAINERS)
    containers = F.filter(nodes, lambda n: _in_group(n, "container"))
    read = F.transform(containers, lambda c: F.struct(c["marks"].alias("marks"), _card(nodes, c, as_of).alias("review")))
    names = F.array(*[F.lit(_css(s)) for s in CONTAINERS])

    def of_selector(cards: Column, k: Column) -> Column:
        mine = F.filter(cards, lambda x: x["review"].isNotNull() & F.exists(x["marks"], lambda m: m["k"] == k))

        def placed(x: Column) -> Column:
            nth = F.get(F.filter(x["marks"], lambda m: m["k"] == k), F.lit(0))["nth"]
            return x["review"].withField("pos", nth).withField("extracted_by", F.concat(F.lit("dom:"), F.get(names, k - first)))

        return F.transform(mine, placed)

    def best(cards: Column) -> Column:
        numbers = F.transform(
            F.sequence(F.lit(first), F.lit(first + count - 1)),
            lambda k: F.struct(
                F.size(F.filter(cards, lambda x: x["review"].isNotNull() & F.exists(x["marks"], lambda m: m["k"] == k))).alias("n"),
                (-k).alias("k"),
            ),
        )
        return of_selector(cards, -F.array_max(numbers)["k"])

    return _let(read, best)


def _review_arrays(pages: DataFrame, as_of: datetime.date, *wanted: str) -> DataFrame:
    """page_id and the wanted arrays of reviews, one for each strategy, from one parse of the page."""
    parsed = pages.select("page_id", "url", _page_reviews_parse(F.col("html")).alias("page"))
    rows = H.bind(parsed, nodes=F.col("page.nodes"), objects=F.col("page.objects")).drop("page")
    nodes, url = F.col("nodes"), F.col("url")

    def ld() -> Column:
        found = F.transform("objects", lambda o, i: _let(F.try_parse_json(o), lambda v: _ld_review(v, i, url, as_of)))
        return F.filter(found, lambda r: F.length(r["text"]) >= 8)

    def micro() -> Column:
        scopes = F.filter(nodes, lambda n: _in_group(n, "scope"))
        found = F.transform(scopes, lambda s, i: _let(H.inside(nodes, s), lambda sub: _micro_review(sub, i, as_of)))
        return F.filter(found, lambda r: r["text"].isNotNull())

    def declared() -> Column:
        return F.size("objects") + F.size(F.filter(nodes, lambda n: _in_group(n, "scope")))

    made = {"ld": ld, "micro": micro, "dom": lambda: _cards(nodes, as_of), "declared": declared}
    return rows.select("page_id", *(made[name]().alias(name) for name in wanted))


def _listed(rows: DataFrame, reviews: str, *more: str) -> DataFrame:
    # A plain explode adds a test of its input that would be made of the whole expression again.
    rows = H.bind(rows.select("page_id", reviews, *more), **{reviews: F.col(reviews)})
    return rows.select("page_id", *more, F.explode(reviews).alias("r")).select("page_id", "r.*", *more)


def json_ld_reviews(pages: DataFrame, as_of: datetime.date) -> DataFrame:
    """Reviews a page declares as JSON-LD."""
    return _listed(_review_arrays(pages, as_of, "ld"), "ld")


def microdata_reviews(pages: DataFrame, as_of: datetime.date) -> DataFrame:
    """Reviews a page marks up as microdata."""
    return _listed(_review_arrays(pages, as_of, "micro"), "micro")


def dom_reviews(pages: DataFrame, as_of: datetime.date) -> DataFrame:
    """Reviews found in review-like containers; the selector yielding most wins per page."""
    return _listed(_review_arrays(pages, as_of, "dom"), "dom")


def _css(selector: tuple) -> str:
    tag, name, op, value = selector[:4]
    forms = {"eq": f'[{name}="{value}"]', "has": f"[{name}]", "like": f'[{name}*="{value}" i]', "start": f'[{name}^="{value}" i]'}
    return (tag or "") + forms[op]


def page_reviews(pages: DataFrame, as_of: datetime.date, than_declared: bool = False) -> DataFrame:
    """Reviews of every page by its better strategy: the DOM only if it found strictly more.

    More than the reviews read from structured data or, with ``than_declared``, than the page declares, also those too short
    to be one. The choice is made inside the page's row: nothing is shuffled.
    """
    arrays = _review_arrays(pages, as_of, "ld", "micro", "dom", "declared")
    found = H.bind(arrays, structured=F.concat("ld", "micro"), dom=F.col("dom"), declared=F.col("declared")).drop("ld", "micro")
    by_dom = F.size("dom") > (F.col("declared") if than_declared else F.size("structured"))
    chosen = found.select(
        "page_id", F.when(by_dom, F.col("dom")).otherwise(F.col("structured")).alias("reviews"), F.when(by_dom, "dom").otherwise("structured-data").alias("strategy")
    )
    return _listed(chosen, "reviews", "strategy")


# ---------------------------------------------------------------- product facts


def _meta(nodes: Column, *pairs: tuple[str, str]) -> Column:
    return H.pick_attr(nodes, H.selector_list([("meta", a, "eq", v) for a, v in pairs]), "content")


def product_facts(pages: DataFrame) -> DataFrame:
    """Image, description, name, price with currency, colour, brand and SKU of each page."""
    nodes = F.col("nodes")
    rows = H.bind(
        with_nodes(pages).select("page_id", "url", "nodes"), blocks=H.script_blocks(nodes, "(?i)ld\\+json")
    )
    rows = rows.select("page_id", "url", "nodes", H.ld_products(F.col("blocks")).alias("objects"))
    rows = H.bind(rows, objects=F.col("objects"))
    parsed = F.transform("objects", lambda o: F.try_parse_json(o))
    products = F.filter(parsed, lambda v: _typed(v, "(?i)^product$"))
    rows = rows.select(
        "page_id",
        "url",
        products.alias("products"),
        _meta(nodes, ("property", "og:image"), ("property", "og:image:url"), ("name", "twitter:image"), ("name", "twitter:image:src")).alias("image"),
        _meta(nodes, ("property", "og:description"), ("name", "twitter:description"), ("name", "description")).alias("meta_description"),
        _meta(nodes, ("property", "og:title"), ("name", "twitter:title")).alias("meta_name"),
        _meta(nodes, ("property", "product:price:amount")).try_cast("double").alias("meta_price"),
        F.trim(_meta(nodes, ("property", "product:price:currency"))).alias("meta_currency"),
    ).withColumn("p", F.get("products", F.lit(0)))
    p = F.col("p")

    def first_of(fields) -> Column:
        return H.first_value(F.transform("products", lambda v: F.coalesce(*[_filled(v, f) for f in fields])))

    # Price and currency come from one offer: the first that has a price.
    offers = F.coalesce(
        F.try_variant_get(p, "$.offers", "array<variant>"), F.array(F.try_variant_get(p, "$.offers", "variant"))
    )
    priced = F.filter(
        F.transform(
            offers,
            lambda o: F.struct(
                _scalar(o, "$.price").try_cast("double").alias("price"), _filled(o, "$.priceCurrency").alias("currency")
            ),
        ),
        lambda o: o["price"].isNotNull(),
    )
    offer = F.get(priced, F.lit(0))
    price = F.coalesce("meta_price", offer["price"])
    currency = F.when(F.col("meta_price").isNotNull(), F.col("meta_currency")).otherwise(offer["currency"])
    properties = F.coalesce(
        F.try_variant_get(p, "$.additionalProperty", "array<struct<name:string,value:string>>"),
        F.array().cast("array<struct<name:string,value:string>>"),
    )
    colours = F.transform(
        F.filter(properties, lambda x: F.lower(F.trim(x["name"])).isin("color", "colour")), lambda x: F.trim(x["value"])
    )
    complete = price.isNotNull() & (F.coalesce(currency, F.lit("")) != "")
    sku = F.coalesce(*[_filled(p, f"$.{k}") for k in ("sku", "mpn", "gtin13", "gtin")])
    image = F.coalesce(F.col("image"), first_of(["$.image", "$.image[0]", "$.image.url", "$.image[0].url"]))
    return rows.select(
        "page_id",
        F.when(image.isNotNull(), absolute_link(F.col("url"), F.trim(image))).alias("image_url"),
        F.left(squeeze(F.coalesce("meta_description", first_of(["$.description"]))), F.lit(DESCRIPTION_CHARS)).alias("description"),
        squeeze(F.coalesce("meta_name", _filled(p, "$.name"))).alias("name"),
        F.when(complete, price).alias("price"),
        F.when(complete, F.upper(currency)).alias("currency"),
        F.coalesce(_filled(p, "$.color"), H.first_value(colours)).alias("color"),
        F.coalesce(_filled(p, "$.brand.name"), _filled(p, "$.brand")).alias("brand"),
        sku.alias("sku"),
    )


def next_pages(pages: DataFrame) -> DataFrame:
    """The next page a page links to, as an absolute URL."""
    nodes = F.col("nodes")
    rows = with_nodes(pages).select(
        "page_id",
        "url",
        H.pick_attr(nodes, H.selector_list(NEXT_LINKS), "href").alias("declared"),
        F.transform(
            H.selector_list(NEXT_GUESSES),
            lambda s: H.first_value(
                F.transform(F.filter(nodes, lambda n: H.matches(nodes, n, s)), lambda n: H.attr(n, "href"))
            ),
        ).alias("guesses"),
    )
    usable = F.filter("guesses", lambda g: ~g.rlike(r"(?i)^\s*#|javascript:"))
    href = F.coalesce("declared", F.get(usable, F.lit(0)))
    return rows.select("page_id", F.when(href.isNotNull(), absolute_link(F.col("url"), href)).alias("next_url"))


# ---------------------------------------------------------------- listings and videos


def search_listings(pages: DataFrame) -> DataFrame:
    """All listings of a stored retailer search page, by that retailer's markup."""
    nodes = F.col("nodes")
    cells = {
        "newegg": [(None, "class", "word", "item-cell"), (None, "class", "word", "item-container")],
        "bestbuy": [("li", "class", "word", "sku-item"), (None, "data-testid", "eq", "product-list-item")],
        "ebay": [("li", "class", "word", "s-item"), ("li", "class", "word", "s-card")],
    }
    links = {
        "newegg": [("a", "class", "word", "item-title")],
        "bestbuy": [("a", None, None, None, "class", "sku-title"), ("a", "class", "word", "sku-title-link")],
        "ebay": [("a", "class", "word", "s-item__link"), ("a", "class", "word", "su-link")],
    }
    ebay_titles = [(None, "class", "word", "s-item__title"), (None, "class", "word", "su-styled-text")]
    site = site_adapter(F.col("url"), F.lit(None).cast("string"))
    rows = with_nodes(pages).withColumn("site", site)

    def by_site(table: dict) -> Column:
        choice = F.when(F.lit(False), H.selector_list([]).cast(f"array<{H.SELECTOR}>"))
        for name, selectors in table.items():
            choice = choice.when(F.col("site") == name, H.selector_list(selectors))
        return choice

    rows = rows.withColumns({"cells": by_site(cells), "links": by_site(links)}).where(F.col("cells").isNotNull())
    found = F.array_sort(F.array_distinct(F.transform(H.select(nodes, F.col("cells")), lambda n: F.struct(n["i"].alias("i"), n["last"].alias("last")))))
    rows = rows.select(
        "page_id", "url", "site", "links", "nodes", F.posexplode_outer(found).alias("pos", "c")
    ).where("c is not null")
    rows = rows.select(
        "page_id", "url", "site", "pos", "links", H.inside(nodes, F.col("c")).alias("sub"),
        F.get(F.filter(nodes, lambda n: n["i"] == F.col("c.i")), F.lit(0)).alias("cell"),
    )
    sub = F.col("sub")
    link = F.get(H.select(sub, F.col("links")), F.lit(0))
    rows = rows.withColumn("link", link)
    title = F.when(F.col("site") == "ebay", H.pick_text(sub, H.selector_list(ebay_titles))).otherwise(
        H.text_of(sub, F.col("link"))
    )
    title = F.when(
        F.col("site") == "ebay", F.regexp_replace(title, r"(?i)^(new listing|sponsored)\s*", "")
    ).otherwise(title)
    href = H.attr(F.col("link"), "href")
    href = F.when(F.col("site") == "ebay", F.substring_index(href, "?", 1)).otherwise(href)
    image = H.selector_list([("img", None, None, None, "class", "item-brand")])
    out = rows.select(
        "page_id",
        "site",
        "pos",
        title.alias("title"),
        F.when(href != "", absolute_link(F.col("url"), href)).alias("url"),
        F.when(F.col("site") == "newegg", F.coalesce(H.pick_attr(sub, image, "title"), H.pick_attr(sub, image, "alt"))).alias("brand"),
        F.when(F.col("site") == "bestbuy", H.attr(F.col("cell"), "data-sku-id")).alias("sku"),
    )
    return out.where(
        (F.coalesce("title", F.lit("")) != "")
        & F.col("url").isNotNull()
        & ~((F.col("site") == "ebay") & F.contains("title", F.lit("Shop on eBay")))
    )


def short_videos(pages: DataFrame) -> DataFrame:
    """Short videos from a page's embedded state, else from its links; first of an id wins."""
    nodes = F.col("nodes")
    states = F.filter(
        nodes,
        lambda n: (n["tag"] == "script")
        & F.coalesce(H.attr(n, "id").isin("__UNIVERSAL_DATA_FOR_REHYDRATION__", "SIGI_STATE"), F.lit(False)),
    )
    blocks = F.transform(
        states, lambda s: F.array_join(F.transform(H.inside(nodes, s), lambda m: F.coalesce(m["text"], F.lit(""))), "")
    )
    parsed = H.bind(with_nodes(pages).select("page_id", "nodes"), blocks=blocks).select(
        "page_id", "nodes", H.state_objects(F.col("blocks")).alias("objects")
    )
    v = F.col("v")
    state = parsed.select("page_id", F.posexplode_outer("objects").alias("pos", "o")).select(
        "page_id", "pos", F.try_parse_json("o").alias("v")
    )
    handle = F.coalesce(_is(v, "$.author.uniqueId"), _is(v, "$.author"))
    video_id = F.coalesce(_scalar(v, "$.id"), _scalar(v, "$.awemeId"))
    state = state.select(
        "page_id",
        "pos",
        F.lit(0).alias("way"),
        video_id.alias("video_id"),
        handle.alias("handle"),
        _is(v, "$.desc").alias("caption"),
        F.try_variant_get(v, "$.video.duration", "bigint").alias("duration_seconds"),
        F.try_variant_get(v, "$.stats.playCount", "bigint").alias("views"),
    ).where(F.col("caption").isNotNull() & (F.col("handle") != "") & F.col("video_id").rlike(r"^\d+$"))
    shape = r"/@([\w.\-]+)/video/(\d{6,})"
    anchors = parsed.select(
        "page_id",
        "nodes",
        F.posexplode_outer(
            F.filter(nodes, lambda n: (n["tag"] == "a") & F.coalesce(H.attr(n, "href").rlike(shape), F.lit(False)))
        ).alias("pos", "a"),
    ).where("a is not null")
    captions = [
        (None, "data-e2e", "eq", "search-card-video-caption"),
        (None, "class", "like", "video-meta-caption"),
        (None, "data-e2e", "eq", "search-card-desc"),
        (None, "class", "like", "caption"),
    ]
    # The smallest enclosing element that holds a caption and no other video link.
    around = F.filter(
        nodes,
        lambda n: ~n["tag"].isin("#text", "#data", "body", "html")
        & (n["i"] < F.col("a.i"))
        & (n["last"] >= F.col("a.last"))
        & (
            F.size(
                F.filter(H.inside(nodes, n), lambda m: F.coalesce(F.contains(H.attr(m, "href"), F.lit("/video/")), F.lit(False)))
            )
            <= 1
        ),
    )
    near = H.first_value(
        F.transform(F.slice(F.reverse(around), 1, 5), lambda n: H.pick_text(H.inside(nodes, n), H.selector_list(captions)))
    )
    href = H.attr(F.col("a"), "href")
    dom = anchors.select(
        "page_id",
        "pos",
        F.lit(1).alias("way"),
        F.regexp_extract(href, shape, 2).alias("video_id"),
        F.regexp_extract(href, shape, 1).alias("handle"),
        F.coalesce(near, H.text_of(nodes, F.col("a"))).alias("caption"),
        F.lit(None).cast("bigint").alias("duration_seconds"),
        F.lit(None).cast("bigint").alias("views"),
    )
    first_way = F.min("way").over(Window.partitionBy("page_id"))
    order = Window.partitionBy("page_id", "video_id").orderBy("pos")
    rows = state.unionByName(dom).withColumn("best", first_way).where("way = best")
    rows = rows.withColumn("rn", F.row_number().over(order)).where("rn = 1")
    named = F.coalesce(F.nullif("caption", F.lit("")), F.concat(F.lit("TikTok video by @"), "handle"))
    channel = F.concat(F.lit("https://www.tiktok.com/@"), "handle")
    return rows.select(
        "page_id",
        "video_id",
        F.left(named, F.lit(300)).alias("title"),
        F.concat(channel, F.lit("/video/"), "video_id").alias("url"),
        F.concat(F.lit("@"), "handle").alias("channel"),
        channel.alias("channel_url"),
        "duration_seconds",
        "views",
    )


# ---------------------------------------------------------------- product identity


def by_site_rules(nodes: Column, url: Column, rules: RuleSet = DEFAULT) -> Column:
    """(site, id, title, confidence) of the first site whose rules apply and find an id or a title; ``nodes`` are
    marked by the rules' selectors."""
    selectors, labels, tail = rules.selectors(), host_labels(host(url)), path(url)

    def marked(mark: Column) -> Column:
        return F.filter(nodes, lambda n: F.exists(n["marks"], lambda m: m["k"] == mark))

    def applies(r: Column) -> Column:
        return F.when(r["source"] == "host", F.array_contains(labels, r["pattern"])).otherwise(F.size(marked(r["mark"])) > 0)

    def read(r: Column) -> Column:
        in_url = F.call_function("regexp_extract", tail, r["pattern"], F.lit(1))
        on_page = _let(
            F.get(marked(r["mark"]), F.lit(0)),
            lambda n: squeeze(F.when(r["take"].isNull(), H.text_of(nodes, n)).otherwise(H.attr(n, r["take"]))),
        )
        return F.when(r["source"] == "page", on_page).otherwise(in_url)

    def first(field: str, site: Column) -> Column:
        mine = F.filter(literal(rules.of_field(field, generic=False), selectors), lambda r: r["site"] == site)
        return H.first_value(F.transform(mine, read))

    held = F.filter(literal(rules.of_field("applies"), selectors), applies)
    confidences = literal(rules.of_field("confidence"))
    found = F.transform(
        F.array_distinct(F.transform(held, lambda r: r["site"])),
        lambda s: F.struct(
            s.alias("site"),
            first("product_id", s).alias("id"),
            first("title", s).alias("title"),
            F.get(F.filter(confidences, lambda r: r["site"] == s), F.lit(0))["pattern"].alias("confidence"),
        ),
    )
    return F.get(F.filter(found, lambda x: x["id"].isNotNull() | x["title"].isNotNull()), F.lit(0))


def detect_products(pages: DataFrame, rules: RuleSet = DEFAULT) -> DataFrame:
    """Product id, title, canonical URL and confidence of each page.

    Strategies in order of trust: JSON-LD, microdata, the table of site rules, meta tags, URL shape,
    and last the page's own heading. The first value found wins per field.
    """
    nodes = F.col("nodes")
    parse = H.parsed_pages([H.css(s) for s in rules.selectors()], [], ("type", r"^application/ld\+json$"), H.IDENTITY_KEYS, "(?i)product")
    rows = H.bind(pages.select("page_id", "url", parse(F.col("html")).alias("page")), nodes=F.col("page.nodes"), objects=F.col("page.objects")).drop("page")
    product = F.try_parse_json(F.get("objects", F.lit(0)))
    scope = F.get(
        F.filter(nodes, lambda n: F.coalesce(H.attr(n, "itemtype").rlike(r"(?i)schema\.org/Product"), F.lit(False))), F.lit(0)
    )
    heading = H.text_of(nodes, F.get(F.filter(nodes, lambda n: n["tag"] == "h1"), F.lit(0)))
    page_title = H.text_of(nodes, F.get(F.filter(nodes, lambda n: n["tag"] == "title"), F.lit(0)))
    buy = F.exists(
        nodes,
        lambda n: F.coalesce(
            F.lower(F.concat_ws(" ", H.attr(n, "id"), H.attr(n, "class"), H.attr(n, "data-testid"))).contains("add-to-cart")
            | (F.lower(H.attr(n, "name")) == "add")
            | ((n["tag"] == "button") & (H.attr(n, "type") == "submit") & F.contains(F.lower(H.attr(n, "value")), F.lit("cart"))),
            F.lit(False),
        ),
    )
    body = H.text_of(nodes, F.get(F.filter(nodes, lambda n: n["tag"] == "body"), F.lit(0)))
    rows = rows.select(
        "page_id",
        "url",
        "nodes",
        product.alias("ld"),
        scope.alias("scope"),
        by_site_rules(nodes, F.col("url"), rules).alias("rule"),
        F.nullif(heading, F.lit("")).alias("heading"),
        F.nullif(page_title, F.lit("")).alias("page_title"),
        (F.coalesce(buy, F.lit(False)) & F.coalesce(body.rlike(PRICE_NEAR_PATTERN), F.lit(False))).alias("buy_signals"),
        H.pick_attr(nodes, H.selector_list([("link", "rel", "like", "canonical")]), "href").alias("canonical"),
        _meta(nodes, ("property", "og:type"), ("name", "og:type")).alias("og_type"),
        _meta(nodes, ("property", "og:title"), ("name", "og:title"), ("property", "twitter:title"), ("name", "twitter:title")).alias("meta_title"),
        _meta(nodes, ("property", "og:url"), ("name", "og:url")).alias("meta_url"),
        F.coalesce(
            _meta(
                nodes,
                *[(a, f"product:{k}") for k in ("retailer_item_id", "sku", "item_group_id") for a in ("property", "name")],
            ),
            _meta(nodes, ("itemprop", "sku")),
        ).alias("meta_id"),
    )
    sub = H.inside(nodes, F.col("scope"))

    def prop(name: str) -> Column:
        n = F.get(F.filter("sub", lambda m: F.coalesce(H.attr(m, "itemprop") == name, F.lit(False))), F.lit(0))
        return H.first_value(F.array(H.attr(n, "content"), H.attr(n, "href"), H.text_of(F.col("sub"), n)))

    rows = H.bind(rows, sub=sub)
    ld = F.col("ld")
    ld_id = F.coalesce(*[_scalar(ld, f"$.{k}") for k in ("sku", "mpn", "productID", "gtin13", "gtin")])
    rows = rows.select(
        "page_id", "url", "rule", "heading", "page_title", "buy_signals", "canonical", "og_type", "meta_title", "meta_url", "meta_id",
        F.trim(ld_id).alias("ld_id"),
        _filled(ld, "$.name").alias("ld_title"),
        _filled(ld, "$.url").alias("ld_url"),
        F.coalesce(prop("sku"), prop("mpn"), prop("productID")).alias("micro_id"),
        prop("name").alias("micro_title"),
        prop("url").alias("micro_url"),
        F.col("rule.id").alias("rule_id"),
        shape_id(F.col("url"), rules).alias("shape_id"),
    )
    ids = [("json-ld", "ld_id"), ("microdata", "micro_id"), ("site-rules", "rule_id"), ("meta", "meta_id"), ("url-shape", "shape_id")]
    known = F.coalesce(*[F.col(c) for _, c in ids])
    candidate = F.coalesce("heading", F.get(F.split("page_title", r"\s+[|–—·:]\s+"), F.lit(0)))
    furniture = F.coalesce(candidate.rlike(NOT_A_PRODUCT_PATTERN), F.lit(False))
    trusted = F.col("heading").isNotNull() | known.isNotNull() | F.col("buy_signals")
    guess = F.when(~furniture & trusted, candidate)
    title = F.coalesce("ld_title", "micro_title", F.col("rule.title"), "meta_title", guess)
    via = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(name)) for name, c in ids])
    meta_confidence = F.when(F.col("og_type").rlike("(?i)product"), "high").otherwise("medium")
    confidence = (
        F.when(via.isin("json-ld", "microdata"), "high")
        .when(via == "site-rules", F.col("rule.confidence"))
        .when(via == "meta", meta_confidence)
        .when(via == "url-shape", "low")
        .when(title.isNotNull(), "low")
        .otherwise("none")
    )
    declared = F.coalesce("ld_url", "micro_url", "meta_url")
    fallback = canonical_url(F.coalesce(absolute_link(F.col("url"), F.col("canonical")), F.col("url")))
    return rows.select(
        "page_id",
        known.alias("product_id"),
        title.alias("title"),
        F.coalesce(declared, fallback).alias("canonical_url"),
        F.coalesce("rule.site", host(F.col("url"))).alias("site"),
        via.alias("id_from"),
        confidence.alias("confidence"),
        (known.isNotNull() | title.isNotNull()).alias("detected"),
    )
