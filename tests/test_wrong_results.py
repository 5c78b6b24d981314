"""Cases that once gave wrong results."""

from reviewtrust.operators import ingest
from reviewtrust.operators import pages as PG
from reviewtrust.operators import risk as R
from reviewtrust.operators import score as S
from tests.test_pages import page


def test_price_and_currency_come_from_one_offer(spark):
    def product(offers):
        return f'<script type="application/ld+json">{{"@type":"Product","name":"Lamp","offers":{offers}}}</script>'

    many = ",".join(['{"priceCurrency":"USD"}'] * 5)
    bodies = [
        product('[{"priceCurrency":"USD"},{"price":"9","priceCurrency":"EUR"}]'),
        product(f'[{many},{{"price":4,"priceCurrency":"CHF"}}]'),
        product('{"price":"3.5","priceCurrency":"gbp"}'),
    ]
    got = PG.product_facts(page(spark, *bodies)).orderBy("page_id").collect()
    assert [(r["price"], r["currency"]) for r in got] == [(9.0, "EUR"), (4.0, "CHF"), (3.5, "GBP")]


def test_a_thin_source_is_neither_highest_nor_lowest(spark):
    rows = [(1, "a", 4, 4, 20.0), (1, "b", 4, 4, 8.0), (1, "c", 1, 1, 3.0)]
    stats = spark.createDataFrame(rows, "product_id bigint, source string, n bigint, n_rated bigint, rating_sum double")
    got = S.review_summary(stats).first()
    assert (got["highest_source"], got["lowest_source"]) == ("a", "b")


def test_an_ancestor_may_have_several_classes(spark):
    body = '<ul><li class="a-last b"><a href="p2">n</a></li></ul>'
    got = PG.next_pages(page(spark, body.replace(" b", ""), body)).collect()
    assert len({tuple(r)[1:] for r in got}) == 1 and got[0][-1] is not None


def test_long_reviews_with_one_opening_both_stay(spark):
    rows = [(1, k, "s", "Ann", "x" * 400 + end) for k, end in enumerate(("one", "two", "two"))]
    reviews = spark.createDataFrame(rows, "product_id bigint, review_id bigint, source string, author string, text string")
    assert {r["review_id"] for r in ingest.first_seen(reviews).collect()} == {0, 1}


def test_risk_counts_every_cluster(spark):
    totals = spark.createDataFrame([(1, 100, 0)], "product_id bigint, total bigint, failed bigint")
    clusters = spark.createDataFrame([(1, k, 2) for k in range(20)], "product_id bigint, cluster_id bigint, cluster_size bigint")
    pacing = spark.createDataFrame([(1, False, 0)], "product_id bigint, analyzed boolean, burst_reviews bigint")
    got = R.review_risk(totals, clusters, pacing).first()
    assert got["duplicate_share"] == 0.4
