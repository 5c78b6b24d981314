"""Clusters by connectivity against clusters from all links, and families of near copies that must stay cheap."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewtrust.operators import duplicates as D


def _reviews(spark, rows):
    return spark.createDataFrame(rows, "product_id bigint, review_id bigint, text string")


def _mixed(seed):
    """Families, chains of texts that drift away from each other, copies, unrelated texts and texts without words."""
    rng = np.random.default_rng(seed)
    rows, next_id = [], 0
    for product in range(4):
        vocabulary = [f"w{k}" for k in range(120)]
        for _ in range(6):
            words = list(rng.choice(vocabulary, int(rng.integers(4, 40))))
            for _ in range(int(rng.integers(1, 9))):
                for _ in range(int(rng.integers(0, 4))):
                    words[int(rng.integers(0, len(words)))] = str(rng.choice(vocabulary))
                rows.append((product, next_id, " ".join(words)))
                next_id += 1
        rows += [(product, next_id, ""), (product, next_id + 1, None), (product, next_id + 2, rows[-1][2]), (product, next_id + 3, "one"), (product, next_id + 4, "One!")]
        next_id += 5
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_clusters_equal_those_from_all_links(spark, seed):
    reviews = _reviews(spark, _mixed(seed))

    def found(clusters):
        return sorted((r["product_id"], r["review_id"], r["cluster_id"], r["cluster_size"], round(min(r["max_similarity"], D.SURE), 9)) for r in clusters.collect())

    whole, family = D.review_clusters(reviews), D.family_clusters(reviews)
    assert whole.columns == family.columns and found(whole) == found(family) != []


def test_links_equal_all_pairs(spark):
    from reviewtrust.functions.text import similarity

    reviews = _reviews(spark, _mixed(7))
    l, r = (reviews.select("product_id", F.col("review_id").alias(f"{s}_id"), F.col("text").alias(f"{s}_text")) for s in ("left", "right"))
    pairs = l.join(r, "product_id").where("left_id < right_id")
    every = pairs.select("left_id", "right_id", F.round(similarity(F.col("left_text"), F.col("right_text")), 9).alias("s")).where("s >= 0.55").collect()
    links = D.near_duplicate_edges(reviews).select("left_id", "right_id", F.round("similarity", 9)).collect()
    want = {(x["left_id"], x["right_id"]): x["s"] for x in every}
    assert all(want[a, b] == s for a, b, s in links)
    # Further copies of a text are linked to its lowest review only; all other links are there.
    first = {r["review_id"]: r["first_id"] for r in D.copy_classes(D.review_sets(reviews)).collect()}
    between = {(a, b) for a, b in want if first.get(a, a) == a and first.get(b, b) == b}
    assert between == {(a, b) for a, b, _ in links if first[a] != first[b]}


def test_a_family_of_5000_near_copies_is_one_cluster_at_linear_cost(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(5000):
        words = list(base)
        words[int(rng.integers(0, 60))] = f"x{k}"
        rows.append((1, k, " ".join(words)))
    rows += [(1, 6000 + k, " ".join(f"y{k}a{j}" for j in range(20))) for k in range(50)]
    compared = []
    scored = D.pair_similarity

    def counting(pairs, sets):
        compared.append(pairs.count())
        return scored(pairs, sets)

    monkeypatch.setattr(D, "pair_similarity", counting)
    found = D.family_clusters(_reviews(spark, rows)).collect()
    assert len(found) == 5000 and {(r["cluster_id"], r["cluster_size"]) for r in found} == {(0, 5000)}
    # Stars only: each review with the lowest holder of each element of its prefix; no bridge, no peak left open.
    assert compared[0] <= 30 * 5000 and compared[1:] == [0, 0]
    assert all(r["max_similarity"] >= D.SURE for r in found)
