"""Literal pages: structured data, containers, search results, embedded videos, identity."""

import datetime

import pytest
from pyspark.sql import functions as F

from reviewtrust.functions import urls as U
from reviewtrust.operators import pages as PG
from reviewtrust.sources import html as H
from reviewtrust.sources import rules

TODAY = datetime.date(2024, 6, 15)
LD = """<script type="application/ld+json">{"@graph":[{"@type":"Product","name":"Lamp","sku":"L1","image":["/i.png"],
"review":[{"@type":"Review","reviewBody":"Bright and quiet. Read more","reviewRating":{"ratingValue":"8","bestRating":10},"author":[{"name":"Ann"}]},
{"@type":["UserReview"],"description":"Broke after a month of use","datePublished":"2024-01-02","url":"/r/2"}]}]}</script>
<script type="application/ld+json">{broken</script>"""
MICRO = """<div itemscope itemtype="http://schema.org/Review"><span itemprop="author">Bob</span><p itemprop="reviewBody">Fits the shelf well</p></div>"""
CHROME = '<div data-review-id="1"><span class="review-text">Read more Report abuse</span></div>'
CARDS = "".join(
    f'<div data-review-id="{i}"><h4>T{i}</h4><p>A long enough text about item {i}.</p><i class="star-4">x</i>'
    f'<time>1 Feb 2024</time><div class="helpful">1,204 people found this helpful</div></div>' for i in range(3)
)


def page(spark, *bodies, url="https://shop.example/product/item-77"):
    rows = [(i, url, f"<html><body>{b}</body></html>") for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def test_json_ld(spark):
    got = PG.json_ld_reviews(page(spark, LD), TODAY).orderBy("pos").collect()
    assert [r["text"] for r in got] == ["Bright and quiet.", "Broke after a month of use"]
    assert got[0]["rating"] == 4.0 and got[0]["author"] == "Ann"
    assert got[1]["url"] == "https://shop.example/r/2" and got[1]["review_date"] == datetime.date(2024, 1, 2)


def test_strategy_choice(spark):
    got = PG.page_reviews(page(spark, LD, MICRO, CARDS, LD + CARDS, CHROME), TODAY).groupBy("page_id", "strategy").count().collect()
    assert sorted(tuple(r) for r in got) == [
        (0, "structured-data", 2), (1, "structured-data", 1), (2, "dom", 3), (3, "dom", 3),
    ]


def test_card_fields(spark):
    row = PG.dom_reviews(page(spark, CARDS), TODAY).orderBy("pos").first()
    assert row["text"] == "A long enough text about item 0." and row["title"] == "T0"
    assert row["rating"] == 4.0 and row["helpful_votes"] == 1204 and row["verified_purchase"] is None
    assert row["review_date"] == datetime.date(2024, 2, 1) and row["extracted_by"] == "dom:[data-review-id]"


def test_facts(spark):
    row = PG.product_facts(page(spark, '<meta name="description" content=" A  lamp ">' + LD)).first()
    assert row["description"] == "A lamp" and row["name"] == "Lamp" and row["sku"] == "L1"
    assert row["image_url"] == "https://shop.example/i.png" and row["price"] is None


def test_next_link(spark):
    got = PG.next_pages(page(spark, '<a class="btn-next" href="#">n</a><a title="Next" href="p2">n</a>', "<p>x</p>"))
    assert [r["next_url"] for r in got.orderBy("page_id").collect()] == ["https://shop.example/product/p2", None]


def test_search_results(spark):
    ebay = "".join(
        f'<li class="s-item"><a class="s-item__link" href="https://www.ebay.com/itm/{i}?x=1"><div class="s-item__title">{t}</div></a></li>'
        for i, t in enumerate(["Shop on eBay", "New Listing Acme lamp"])
    )
    got = PG.search_listings(page(spark, ebay, url="https://www.ebay.com/sch/i.html?_nkw=lamp")).collect()
    assert [(r["title"], r["url"]) for r in got] == [("Acme lamp", "https://www.ebay.com/itm/1")]
    newegg = '<div class="item-cell"><a class="item-brand"><img title="Acme"></a><a class="item-title" href="/p/1">Acme lamp</a></div>'
    row = PG.search_listings(page(spark, newegg, url="https://www.newegg.com/p/pl?d=lamp")).first()
    assert (row["title"], row["brand"], row["url"]) == ("Acme lamp", "Acme", "https://www.newegg.com/p/1")


def test_short_videos(spark):
    state = """<script id="SIGI_STATE">{"a":{"b":[{"id":"1234567","desc":"Lamp review","author":{"uniqueId":"ann"},"stats":{"playCount":9},"video":{"duration":41}},
    {"id":"1234567","desc":"again","author":"x"}]}}</script>"""
    dom = '<div><div><a href="/@bob/video/7654321">go</a></div><p class="caption">Lamp test</p></div>'
    got = {r["page_id"]: r for r in PG.short_videos(page(spark, state, dom)).collect()}
    assert got[0]["title"] == "Lamp review" and got[0]["views"] == 9 and got[0]["duration_seconds"] == 41
    assert got[1]["title"] == "Lamp test" and got[1]["channel"] == "@bob"


def test_identity(spark):
    got = {r["page_id"]: r for r in PG.detect_products(page(spark, LD, "<h1>Search results</h1>", "<title>Lamp | Shop</title><h1>Desk lamp</h1>", url="https://shop.example/x")).collect()}
    assert (got[0]["product_id"], got[0]["confidence"]) == ("L1", "high")
    assert not got[1]["detected"] and got[1]["confidence"] == "none"
    assert (got[2]["title"], got[2]["confidence"]) == ("Desk lamp", "low")


def test_block_pages(spark):
    df = spark.createDataFrame([("<p>Robot check</p>", 200), ("fine", 503), ("fine", 200), (None, None)], "html string, status int")
    assert [r[0] for r in df.select(PG.looks_blocked(F.col("html"), F.col("status"))).collect()] == [True, True, False, False]


def test_elements_without_end_tags(spark):
    items = "".join(f'<li class="review-item"><p>A long enough text about item {i}.' for i in range(2))
    got = PG.dom_reviews(page(spark, f"<ul>{items}</ul>"), TODAY).orderBy("pos").collect()
    assert [r["text"] for r in got] == ["A long enough text about item 0.", "A long enough text about item 1."]


def test_long_lists_are_read_whole(spark):
    cards = "".join(f'<div data-review-id="{i}"><p>A long enough text about item {i}.</p></div>' for i in range(450))
    assert PG.dom_reviews(page(spark, cards), TODAY).count() == 450
    cells = "".join(f'<div class="item-cell"><a class="item-title" href="/p/{i}">Lamp {i}</a></div>' for i in range(25))
    assert PG.search_listings(page(spark, cells, url="https://www.newegg.com/p/pl?d=lamp")).count() == 25


SHOPS = [
    ("https://www.amazon.co.uk/x/dp/B0ABCDEFGH?th=1", '<span id="productTitle"> Acme   lamp </span>', "B0ABCDEFGH", "Acme lamp", "amazon", "high"),
    ("https://www.amazon.com/x", '<input id="ASIN" value="B0INPUT000"><b id="title">Lamp</b>', "B0INPUT000", "Lamp", "amazon", "high"),
    ("https://www.amazon.com/x", '<p data-asin=""></p><p data-asin="B0DATA0000"></p>', "B0DATA0000", None, "amazon", "high"),
    ("https://ebay.de/itm/lamp/123456789", '<h1><i class="a ux-textspans--BOLD">Bold lamp</i> rest</h1>', "123456789", "Bold lamp", "ebay", "high"),
    ("https://www.walmart.com/ip/lamp/55", '<h1>No</h1><h1 itemprop="name">Lamp</h1>', "55", "Lamp", "walmart", "high"),
    ("https://www.bestbuy.com/site/lamp/6501234.p", '<h1 class="heading-5 v">Lamp</h1>', "6501234", "Lamp", "bestbuy", "high"),
    ("https://www.etsy.com/listing/77", "<h1 data-buy-box-listing-title>Lamp</h1>", "77", "Lamp", "etsy", "high"),
    ("https://de.aliexpress.com/item/x1234567.html", "<h1 data-pl>Lamp</h1>", "1234567", "Lamp", "aliexpress", "high"),
    ("https://www.jumia.com.ng/lamp-123.html", '<div data-sku="SK9"></div><h1 class="-fs20">Lamp</h1>', "SK9", "Lamp", "jumia", "high"),
    ("https://lamps.example/products/desk-lamp", '<script src="https://CDN.shopify.com/a.js"></script><h1 class="product__title">Lamp</h1>', "desk-lamp", "Lamp", "shopify", "medium"),
    ("https://lamps.example/products/desk-lamp", "<h1>Lamp</h1>", "desk-lamp", "Lamp", "lamps.example", "low"),
    ("https://myamazon.org/dp/B0ABCDEFGH", "<h1>Lamp</h1>", "B0ABCDEFGH", "Lamp", "myamazon.org", "low"),
]


def _shops(spark):
    rows = [(i, url, f"<html><body>{body}</body></html>") for i, (url, body, *_) in enumerate(SHOPS)]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def test_site_rules_of_every_shop(spark):
    got = PG.detect_products(_shops(spark)).orderBy("page_id").collect()
    assert [(r["product_id"], r["title"], r["site"], r["confidence"]) for r in got] == [s[2:] for s in SHOPS]


def test_a_new_shop_is_a_row_of_the_stored_table(spark, tmp_path):
    more = [
        ("lampshop", -1, "applies", 0, "host", "lamps", None),
        ("lampshop", -1, "product_id", 0, "page", "div.buy[data-lamp]", "data-lamp"),
        ("lampshop", -1, "title", 0, "page", "main [role=heading]", None),
        ("lampshop", -1, "confidence", 0, "fixed", "medium", None),
        ("lampshop", 9, "adapter", 0, "host", "lamps", None),
        ("lampshop", 9, "review_id", 0, "url", r"/products/([\w-]+)", None),
        ("lampshop", 9, "review_page", 0, "template", "https://{netloc}/r/{id}", None),
        ("lampshop", 9, "next_page", 0, "count", "p", None),
    ]
    known = rules.DEFAULT.table(spark)
    known.unionByName(spark.createDataFrame(more, known.schema)).write.parquet(f"{tmp_path}/rules")
    table = rules.read_rules(spark, f"{tmp_path}/rules")
    body = '<div class="buy x" data-lamp="L7"></div><main><b role="heading">Desk  lamp</b></main><h1>Other</h1>'
    url = "https://lamps.example/products/desk-lamp"
    row = PG.detect_products(page(spark, body, url=url), table).first()
    assert (row["product_id"], row["title"], row["site"], row["confidence"]) == ("L7", "Desk lamp", "lampshop", "medium")
    c = spark.range(1).select(F.lit(url).alias("u"))
    adapter = U.site_adapter(F.col("u"), F.lit(None).cast("string"), table)
    one = c.select(adapter, U.review_page_urls(F.col("u"), F.lit("x"), adapter, table), U.next_page_url(F.lit("https://a?p=2"), F.lit(2), adapter, F.lit("adv"), table)).first()
    assert tuple(one) == ("lampshop", ["https://lamps.example/r/desk-lamp"], "https://a?p=3")
    assert PG.detect_products(_shops(spark), table).orderBy("page_id").first()["site"] == "amazon"


def test_selectors_that_are_not_known_are_refused(spark):
    for bad in ("a > b", "a b c", "", "a:hover", "[x"):
        with pytest.raises(ValueError, match="unknown selector"):
            H.css(bad)


def test_json_is_walked_to_any_depth_without_copies_of_what_is_around():
    deep = {"@type": "Review", "reviewBody": "deep"}
    for _ in range(400):
        deep = {"@graph": [{"item": deep}]}
    assert [o["reviewBody"] for o in H.walk(deep, H.LD_KEYS, H._wanted("Review", []))] == ["deep"]
    assert list(H.walk([{"a": 1, "b": {"desc": 1, "c": {"desc": 2}}}, {"desc": 3}], None, H._wanted(None, ["desc"]))) == [
        {"desc": 1, "c": {"desc": 2}}, {"desc": 2}, {"desc": 3},
    ]


def test_one_python_evaluation_and_no_shuffle_for_page_reviews(spark):
    for made in (PG.page_reviews, PG.dom_reviews):
        plan = made(page(spark, LD + CARDS), TODAY)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan
