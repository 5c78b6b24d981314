"""Products of few texts are compared text by text, larger ones by shared elements: both must give the links of all pairs."""

import pytest
from pyspark.sql import functions as F

from reviewtrust.functions.text import shingles, similarity, tokens
from reviewtrust.operators import duplicates as D
from tests.test_families import _mixed, _reviews


def _every_link(reviews):
    l, r = (
        reviews.select("product_id", F.col("review_id").alias(f"{s}_id"), F.col("text").alias(f"{s}_text"), shingles(tokens(F.col("text")), 2).alias(f"{s}_pairs"))
        for s in ("left", "right")
    )
    met = l.join(r, "product_id").where("left_id < right_id and arrays_overlap(left_pairs, right_pairs)")
    scored = met.select("left_id", "right_id", F.round(similarity(F.col("left_text"), F.col("right_text")), 9).alias("s"))
    return {(x["left_id"], x["right_id"]): x["s"] for x in scored.where("s >= 0.55").collect()}


@pytest.mark.parametrize("few", [0, 50, 256])
def test_both_ways_find_the_same_links(spark, monkeypatch, few):
    monkeypatch.setattr(D, "FEW_TEXTS", few)
    reviews = _reviews(spark, _mixed(11) + [(9, 9000, "great"), (9, 9001, "great great"), (9, 9002, "great great great"), (9, 9003, "the of and")])
    want = _every_link(reviews)
    first = {r["review_id"]: r["first_id"] for r in D.copy_classes(D.review_sets(reviews)).collect()}
    between = {(a, b): s for (a, b), s in want.items() if first.get(a, a) == a and first.get(b, b) == b}
    got = {(r["left_id"], r["right_id"]): round(r["similarity"], 9) for r in D.text_links(reviews).collect()}
    assert got == between != {}

    def found(clusters):
        return sorted((r["review_id"], r["cluster_id"], r["cluster_size"], round(min(r["max_similarity"], D.SURE), 9)) for r in clusters.collect())

    assert found(D.review_clusters(reviews)) == found(D.family_clusters(reviews)) != []


def test_a_small_product_shuffles_no_elements(spark, monkeypatch):
    """Its words travel once, a hash a word: no row for each word pair, triple or content word."""

    def refused(*_):
        raise AssertionError("elements of a small product were listed")

    monkeypatch.setattr(D, "prefixes", refused)
    reviews = _reviews(spark, [(1, k, f"one two three four five six seven x{k % 7}") for k in range(100)])
    assert D.text_links(reviews).count() == 21
    assert {r["cluster_size"] for r in D.family_clusters(reviews).collect()} == {100}
    assert D.review_sets(reviews).columns == ["product_id", "review_id", "words", "copy_key"]
