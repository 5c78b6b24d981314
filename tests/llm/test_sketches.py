"""Sketches drop pairs of texts that can't reach the near-duplicate stage's similarity, and no other."""

import random

from pyspark.sql import functions as F

from reviewtrust.llm import simhash


def test_sketches_keep_every_link_and_few_other_pairs(spark):
    rng = random.Random(5)
    texts = []
    for size in (0, 1, 4, 30, 300, 3000):
        words = [f"w{rng.randrange(10_000)}" for _ in range(size)]
        texts.append(" ".join(words))
        for share in (0.002, 0.01, 0.02, 0.04, 0.3, 1.0):
            texts.append(" ".join(w if rng.random() >= share else f"x{rng.randrange(10_000)}" for w in words))
    rows = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    ids = rows.select("id")
    pairs = ids.select(F.col("id").alias("l_id")).crossJoin(ids.select(F.col("id").alias("r_id"))).where("l_id < r_id")
    left = {(r["l_id"], r["r_id"]) for r in simhash._sketches_allow(pairs, simhash._sketches(rows)).collect()}
    sets = [set(simhash._shingle_hashes(t).tolist()) for t in texts]
    every = [(a, b) for b in range(len(sets)) for a in range(b)]
    near = {(a, b) for a, b in every if (sets[a] or sets[b]) and len(sets[a] & sets[b]) >= simhash.STAGE_JACCARD * len(sets[a] | sets[b])}
    assert near and near <= left
    short = {p for p in left - near if 0 < min(len(sets[k]) for k in p) and max(len(sets[k]) for k in p) <= 300}
    assert len(short) <= len(near)
