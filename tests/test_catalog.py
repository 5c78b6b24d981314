"""Literal cases of matching, videos, URLs, crawl rules, redaction and display."""

import pytest
from pyspark.sql import functions as F

from reviewtrust.functions import display as DI
from reviewtrust.functions import redact as RE
from reviewtrust.functions import urls as U
from reviewtrust.operators import crawl as CR
from reviewtrust.operators import fx as FX
from reviewtrust.operators import matching as M
from reviewtrust.operators import videos as VI

LISTING = "query_id bigint, title string, brand string, ids map<string,string>"
CANDIDATE = "query_id bigint, position bigint, title string, brand string, ids map<string,string>"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def match(spark, query, candidate, **kw):
    q = spark.createDataFrame([(1, query, None, None)], LISTING)
    c = spark.createDataFrame([(1, 1, candidate, None, None)], CANDIDATE)
    return M.score_candidates(q, c, **kw).first()


def test_models_and_hyphens(spark):
    assert match(spark, "Sony WH-1000XM5 headphones", "Sony WH1000XM5 headphones black")["matched"]
    clash = match(spark, "Sony WH-1000XM5 headphones", "Sony WH-1000XM4 headphones")
    assert not clash["matched"] and clash["conflicts"][0].startswith("model tokens differ")


def test_capacity_conflict(spark):
    got = match(spark, "Acme phone 128GB", "Acme phone 256GB")
    assert not got["matched"] and got["conflicts"] == ["capacity differs: 128gb vs 256gb"]
    legacy = match(spark, "Acme phone 128GB", "Acme phone 256GB", legacy_measurement_tokens=True)
    assert any(c.startswith("model tokens differ") for c in legacy["conflicts"])


def test_accessory(spark):
    got = match(spark, "Acme Zed9 phone", "case for Acme Zed9 phone")
    assert not got["matched"] and "accessory" in " ".join(got["conflicts"])


def test_shared_identifier_decides(spark):
    q = spark.createDataFrame([(1, "a b", None, {"upc": "0123-456"})], LISTING)
    c = spark.createDataFrame([(1, 1, "c d", None, {"upc": "0123456"}), (1, 2, "a b", None, None)], CANDIDATE)
    best = M.best_match(M.score_candidates(q, c)).first()
    assert best["best_position"] == 1 and best["confidence"] == "high"


def test_durations(spark):
    cases = {"PT12M34S": 754, "P1DT1S": 86401, "PT0S": None, "x": None}
    for text, want in cases.items():
        assert one(spark, VI.iso_duration_seconds(F.lit(text))) == want


def test_crawl_rule_precedence(spark):
    files = spark.createDataFrame(
        [("a.com", "User-agent: *\nAllow: /\nDisallow: /x\nAllow: /x/open$\n\n# c\nUser-agent: bot\nUser-agent: other\nDisallow: /*.pdf$\n\nUser-agent: free\nDisallow:\n")],
        "host string, text string",
    )
    rules = CR.parse_rules(files)
    urls = spark.createDataFrame(
        [(u,) for u in ("http://a.com/", "http://a.com/x", "http://a.com/x/open", "http://a.com/f.pdf", "http://b.com/x")], "url string"
    )

    def allowed(agent):
        return {r["url"]: r["crawl_allowed"] for r in CR.allowed_urls(urls, rules, agent).collect()}

    plain = allowed("Mozilla")
    assert plain == {"http://a.com/": True, "http://a.com/x": False, "http://a.com/x/open": True, "http://a.com/f.pdf": True, "http://b.com/x": True}
    assert allowed("MyBot/1.0 bot")["http://a.com/f.pdf"] is False
    assert allowed("free")["http://a.com/x"] is True


def test_crawl_wildcards(spark):
    lines = ["/a*b*c$", "/d**e", "/f*ff$", "/g.h+", "/i*j*"]
    files = spark.createDataFrame([("a.com", "User-agent: *\n" + "\n".join(f"Disallow: {p}" for p in lines))], "host string, text string")
    refused = ["/abc", "/axbxbxc", "/de", "/d1/e2", "/ffff", "/g.h+k", "/i2j3"]
    allowed = ["/abcd", "/acb", "/d", "/ff", "/gxh+", "/gh", "/i2k", "/x/abc"]
    urls = spark.createDataFrame([(f"http://a.com{u}",) for u in refused + allowed], "url string")
    got = CR.allowed_urls(urls, CR.parse_rules(files), "Mozilla").where("not crawl_allowed").collect()
    assert sorted(r["url"] for r in got) == sorted(f"http://a.com{u}" for u in refused)


def test_unsafe_targets(spark):
    cases = {
        "http://127.0.0.1/": "loopback address",
        "http://[::1]/": "loopback address",
        "http://[::ffff:10.0.0.1]/": "private network address",
        "http://172.20.1.1/": "private network address",
        "http://224.0.0.1/": "multicast address",
        "http://metadata.goog/": "cloud metadata endpoint",
        "http://printer.local/": "local hostname",
        "http://intranet/": "non-public hostname",
        "file:///etc/passwd": "scheme 'file' is not allowed",
        "http:///x": "URL has no host",
        "https://user@shop.com:8443/x": None,
        "http://8.8.8.8/": None,
    }
    for url, want in cases.items():
        assert one(spark, U.rejection_reason(F.lit(url))) == want, url


def test_names_keys_and_links(spark):
    assert one(spark, U.name_from_url(F.lit("https://a.com/Anker-PowerCore-10000/dp/B0XXXXX"))) == "Anker PowerCore"
    none = F.lit(None).cast("string")

    def key(pid=none, site=none, url=none, name=none):
        return one(spark, U.cache_key(pid, site, url, name))

    assert key(F.lit("b09xs7jwhh"), F.lit("Amazon")) == key(F.lit("B09XS7JWHH"), F.lit("amazon "))
    assert key(url=F.lit("https://www.shop.com/a/")) == key(url=F.lit("http://shop.com/a?x=1"))
    assert key(name=F.lit("ab")) is None
    base = F.lit("https://a.com/x/y?q=1")
    links = {"//b.com/z": "https://b.com/z", "/z": "https://a.com/z", "z": "https://a.com/x/z", "?p=2": "https://a.com/x/y?p=2", "http://c.com": "http://c.com"}
    for href, want in links.items():
        assert one(spark, U.absolute_link(base, F.lit(href))) == want


def test_next_pages(spark):
    def following(url, page, site):
        return one(spark, U.next_page_url(F.lit(url), F.lit(page), F.lit(site), F.lit("adv")))

    assert following("https://amazon.com/product-reviews/B0?pageNumber=1", 1, "amazon") == "https://amazon.com/product-reviews/B0?pageNumber=2"
    assert following("https://amazon.com/dp/B0", 1, "amazon") is None
    assert following("https://www.newegg.com/product-reviews/N8", 3, "newegg") == "https://www.newegg.com/product-reviews/N8?page=4"
    assert following("https://x.com/a", 1, "generic") == "adv"
    assert one(spark, U.search_url(F.lit("a b"), F.lit("newegg"))) == "https://www.newegg.com/p/pl?d=a+b"


def test_usd(spark):
    prices = spark.createDataFrame([(1, 10.0, "usd"), (2, 92.0, "EUR"), (3, 1.0, "ABC"), (4, 1.0, None)], "id int, price double, currency string")
    rates = spark.createDataFrame([("EUR", 0.92)], "currency string, rate double")
    got = {r["id"]: r["price_usd"] for r in FX.with_usd(prices, rates).collect()}
    assert got == {1: 10.0, 2: 100.0, 3: None, 4: None}


def test_redaction(spark):
    assert one(spark, RE.scrub_text(F.lit("mail a.b@c.org or 1234567890"))) == "mail [email] or [digits]"
    assert len(one(spark, RE.scrub_text(F.lit("x" * 300)))) == 201
    assert one(spark, RE.scrub_field("Author", F.lit("Ann"))) == "[redacted]"
    assert one(spark, F.size(RE.scrub_list(F.array_repeat(F.lit("a"), 50)))) == 20


@pytest.mark.parametrize(
    ("themes", "positive", "negative"),
    [
        ([("a", "mixed"), ("b", "mixed"), ("c", "positive"), ("d", "mixed")], ["a", "c"], ["b", "d"]),
        ([("a", "negative"), ("b", "odd"), ("c", None)], ["b", "c"], ["a"]),
    ],
)
def test_theme_split(spark, themes, positive, negative):
    df = spark.createDataFrame([(themes,)], "t array<struct<label:string,sentiment:string>>")
    got = df.select(DI.split_themes(F.col("t")).alias("s")).first()["s"]
    assert (got["positive"], got["negative"]) == (positive, negative)
