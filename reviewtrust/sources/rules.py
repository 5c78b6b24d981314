"""Site rules as a table: which shop a page belongs to, where it keeps id and title, and where its reviews are.

A rule is a row (site, priority, field, step, source, pattern, take). Rows of a lower priority go first, and within a field
those of a lower step; the first that finds something counts. A shop is added by adding rows.

| field | source | pattern | take |
|---|---|---|---|
| applies | host: a label of the host but the last; page: a selector | label or selector | |
| product_id | path, path_query: group 1 of a pattern; page: the first element a selector finds | pattern or selector | attribute; none: text |
| title | page | selector | attribute; none: text |
| confidence | fixed | high, medium or low | |
| adapter | host | label, which is also the hint's name | |
| review_id | product_id, url: group 1 of a pattern | pattern | upper: in capitals |
| review_page, search | template with {url} {base} {netloc} {id} {query} | template | |
| home | fixed: {netloc} where the URL has none | host | |
| next_page | count: parameter set or added; append: cut from it on, then added; none: no next page | parameter | text the URL must hold |

Rows of site ``*`` hold where no other does.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "site string, priority int, field string, step int, source string, pattern string, take string"
#: The table is configuration, read to the driver and compiled into expressions.
MAX_RULES = 10_000
ANY = "*"

# Hosts, path shapes, selectors and addresses of the known shops.
_DETECTOR = {
    "amazon": (
        [("path", r"(?i)/(?:dp|gp/product|gp/aw/d)/([A-Z0-9]{10})", None), ("page", "input#ASIN", "value"), ("page", '[data-asin!=""]', "data-asin")],
        ["#productTitle", "#title"],
    ),
    "ebay": ([("path", r"/itm/(?:.*/)?(\d{9,})", None)], ["h1 .ux-textspans--BOLD", "#itemTitle", "h1"]),
    "walmart": ([("path", r"/ip/(?:[^/]+/)?(\d+)", None)], ['h1[itemprop="name"]', "h1"]),
    "bestbuy": ([("path", r"/(\d{6,})\.p", None)], ["h1.heading-5", "h1"]),
    "etsy": ([("path", r"/listing/(\d+)", None)], ["h1[data-buy-box-listing-title]", "h1"]),
    "aliexpress": ([("path", r"/item/(?:.*?)(\d{6,})\.html", None)], ["h1[data-pl]", "h1"]),
    "jumia": ([("page", "[data-sku]", "data-sku"), ("path", r"-(\d+)\.html", None)], ["h1.-fs20", "h1"]),
    "shopify": ([("path", r"/products/([\w-]+)", None)], ["h1.product__title", "h1"]),
}
_PAGE_MARKS = {"shopify": ['script[src*="cdn.shopify.com"]', "#shopify-features"]}
_CONFIDENCE = {"shopify": "medium"}
_SHAPES = [
    ("path_query", r"(?i)/(?:dp|itm|ip|pd|prd|product|products|listing|item)/(?:[^/?#]+/)?([A-Za-z0-9][\w-]{3,})"),
    ("path_query", r"(?i)[?&](?:product_?id|sku|pid|itemid)=([\w-]+)"),
]
_ADAPTERS = {
    "amazon": [
        ("home", "fixed", "www.amazon.com", None),
        ("review_id", "product_id", r"(?i)^([A-Z0-9]{10})$", "upper"),
        ("review_id", "url", r"(?i)/(?:dp|gp/product|gp/aw/d|product-reviews)/([A-Z0-9]{10})", "upper"),
        ("review_page", "template", "{url}", None),
        ("review_page", "template", "https://{netloc}/product-reviews/{id}?reviewerType=all_reviews&sortBy=recent&pageNumber=1", None),
        ("review_page", "template", "https://{netloc}/product-reviews/{id}?pageNumber=1", None),
        ("next_page", "count", "pageNumber", "/product-reviews/"),
        ("next_page", "none", None, None),
    ],
    "newegg": [
        ("review_id", "url", r"/p/([A-Za-z0-9]+)", None),
        ("review_page", "template", "{url}", None),
        ("review_page", "template", "https://www.newegg.com/product-reviews/{id}", None),
        ("next_page", "count", "page", "/product-reviews/"),
        ("search", "template", "https://www.newegg.com/p/pl?d={query}", None),
    ],
    "bestbuy": [
        ("review_id", "product_id", r"^(\d+)$", None),
        ("review_id", "url", r"/(\d{6,})\.p", None),
        ("review_page", "template", "{url}", None),
        ("review_page", "template", "https://www.bestbuy.com/site/reviews/product/{id}", None),
        ("next_page", "append", "page", "/site/reviews/"),
        ("search", "template", "https://www.bestbuy.com/site/searchpage.jsp?st={query}", None),
    ],
    "ebay": [
        ("review_page", "template", "{url}", None),
        ("search", "template", "https://www.ebay.com/sch/i.html?_nkw={query}&LH_ItemCondition=1000", None),
    ],
    ANY: [
        ("review_page", "template", "{url}", None),
        ("review_page", "template", "{base}/reviews", None),
        ("review_page", "template", "{base}/review", None),
    ],
}


@dataclass(frozen=True)
class Rule:
    site: str
    priority: int
    field: str
    step: int
    source: str
    pattern: str | None
    take: str | None


def _known() -> list[Rule]:
    rules = []
    for priority, (site, (ids, titles)) in enumerate(_DETECTOR.items()):
        marks = _PAGE_MARKS.get(site)
        rules += [Rule(site, priority, "applies", k, "page", m, None) for k, m in enumerate(marks or ())]
        if not marks:
            rules.append(Rule(site, priority, "applies", 0, "host", site, None))
        rules += [Rule(site, priority, "product_id", k, *row) for k, row in enumerate(ids)]
        rules += [Rule(site, priority, "title", k, "page", selector, None) for k, selector in enumerate(titles)]
        rules.append(Rule(site, priority, "confidence", 0, "fixed", _CONFIDENCE.get(site, "high"), None))
    rules += [Rule(ANY, 1000, "product_id", k, *row, None) for k, row in enumerate(_SHAPES)]
    for priority, (site, rows) in enumerate(_ADAPTERS.items()):
        if site != ANY:
            rules.append(Rule(site, priority, "adapter", 0, "host", site, None))
        rules += [Rule(site, priority, field, k, *rest) for k, (field, *rest) in enumerate(rows)]
    return rules


class RuleSet:
    """The rules of a table, in order, as literals for expressions."""

    def __init__(self, rules: list[Rule]):
        self.rules = sorted(rules, key=lambda r: (r.priority, r.site, r.field, r.step))

    @classmethod
    def of(cls, table: DataFrame) -> RuleSet:
        rows = table.select(*(c.split()[0] for c in SCHEMA.split(", "))).limit(MAX_RULES + 1).collect()
        if len(rows) > MAX_RULES:
            raise ValueError(f"more than {MAX_RULES} site rules")
        return cls([Rule(*r) for r in rows])

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(vars(r).values()) for r in self.rules], SCHEMA)

    def of_field(self, *fields: str, generic: bool | None = None) -> list[Rule]:
        """Rules of these fields; only those of named sites, or only those of site ``*``, if asked."""
        return [r for r in self.rules if r.field in fields and (generic is None or (r.site == ANY) == generic)]

    def selectors(self) -> list[str]:
        """The selectors of all rules, each once: their numbers are those of the parse's marks."""
        return list(dict.fromkeys(r.pattern for r in self.rules if r.source == "page"))


DEFAULT = RuleSet(_known())


def read_rules(spark: SparkSession, path: str, file_format: str = "parquet") -> RuleSet:
    """A stored table of rules, which replaces the known ones."""
    return RuleSet.of(spark.read.schema(SCHEMA).format(file_format).load(path))


def literal(rules: list[Rule], selectors: list[str] | None = None) -> Column:
    """Rules as an array of structs, in order; ``mark`` is the place of a page rule's selector."""
    places = {s: k for k, s in enumerate(selectors or ())}
    rows = [
        F.struct(
            F.lit(n).alias("n"), F.lit(r.site).alias("site"), F.lit(r.field).alias("field"), F.lit(r.source).alias("source"),
            F.lit(r.pattern).cast("string").alias("pattern"), F.lit(r.take).cast("string").alias("take"),
            F.lit(places.get(r.pattern, -1) if r.source == "page" else -1).alias("mark"),
        )
        for n, r in enumerate(rules)
    ]
    empty = "array<struct<n:int,site:string,field:string,source:string,pattern:string,take:string,mark:int>>"
    return F.array(*rows) if rows else F.array().cast(empty)
