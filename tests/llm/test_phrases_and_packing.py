"""Collocations and packing against brute force, where filters collide and partitions cut families of phrases."""

import numpy as np
import pytest

from reviewtrust.llm import collocations, fill_middle, packing
from pyspark.sql import functions as F
from tests.llm import brute as B

ROWS = [
    ("en", "New York, new  york. New\tYork new york city! York new york city hall"),
    ("en", "the the the the the the\nthe the, of the of the of the"),
    (None, "new york new york new york"),
    ("und", "new york new york\x0bnew york"),
    ("de", ""),
    ("de", None),
    ("en", "é é é. \U0001f600 \U0001f600 \x1c a\x1cb a\x1cb"),
]


def _rows(seed, texts=400):
    """Zipf words in short pieces, with some fixed phrases."""
    rng = np.random.default_rng(seed)
    out = []
    for k in range(texts):
        words = [f"w{x}" for x in np.minimum(rng.zipf(1.3, 60), 300)]
        at = int(rng.integers(0, 50))
        words[at : at + 4] = ["alpha", "beta", "gamma", "delta"]
        out.append((("en", "de", None)[k % 3 if k < 300 else 0], " ".join(w + ("," if rng.random() < 0.1 else "") for w in words)))
    return out


@pytest.mark.parametrize(("bits", "held"), [((16, 26), 300_000), ((16, 16), 40)])
def test_phrases_equal_brute_force(spark, monkeypatch, bits, held):
    monkeypatch.setattr(collocations, "FILTER_BITS", bits)
    monkeypatch.setattr(collocations, "HELD", held)
    for rows, least, top in ((ROWS, 2, 2000), (ROWS, 1, 3), (_rows(1), 4, 2000)):
        docs = spark.createDataFrame([(1, *r) for r in rows], "doc_id int, lang string, text string").repartition(3)
        got = [tuple(r) for r in collocations.collocations(docs, least=least, top=top).collect()]
        assert sorted(got) == sorted(B.collocations(rows, least=least, top=top))


def test_phrases_whose_family_is_cut_by_every_partition(spark):
    """One row a partition: all beginnings of a phrase lie in others."""
    rows = [("en", "a b c d e"), ("en", "a b c d f"), ("en", "a b c"), ("en", "a"), ("de", "b a")]
    counts = {}
    for lang, text in rows:
        w = text.split()
        for i in range(len(w)):
            for j in range(i + 1, len(w) + 1):
                counts[lang, *w[i:j]] = counts.get((lang, *w[i:j]), 0) + 1
    made = spark.createDataFrame([(k[0], list(k[1:]), n) for k, n in counts.items()], "lang string, words array<string>, a bigint")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        got = collocations.along(collocations.along(made, "prefix", "after", "lefts"), "suffix", "before", "rights").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == len(counts)
    for r in got:
        lang, w = r["lang"], r["words"]
        assert r["lefts"] == [counts[lang, *w[:k]] for k in range(1, len(w))]
        assert r["rights"] == [counts[lang, *w[len(w) - k :]] for k in range(1, len(w))]
        assert r["after"] == max([n for k, n in counts.items() if k[0] == lang and list(k[1:-1]) == w], default=0)
        assert r["before"] == max([n for k, n in counts.items() if k[0] == lang and list(k[2:]) == w], default=0)


def test_packer_is_best_fit_decreasing():
    rng = np.random.default_rng(2)
    for size, n in ((7, 200), (64, 500), (2048, 800)):
        lengths = sorted(rng.integers(1, size + 1, n).tolist(), reverse=True)
        packer = packing.Packer(size)
        assert [packer.place(x) for x in lengths] == B.best_fit(lengths, size)


def test_sequences_hold_their_pieces_and_padding(spark):
    import public_tokenizers as P

    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as f:
        content = f.read()
    texts = [" ".join(["word"] * n) for n in (0, 1, 3, 5, 40, 130, 63, 64, 300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    placed, made = packing.pack(docs, content, window=64, shard=4)  # several shards
    rows, made_rows = placed.collect(), {r["piece"]: r["ids"] for r in made.collect()}
    for r in packing.sequences(placed, made, window=64, pad_id=9).collect():
        inside = sorted((p for p in rows if p["sequence_id"] == r["sequence_id"]), key=lambda p: p["offset"])
        ids = b"".join(bytes(made_rows[p["piece"]]) for p in inside)
        n = len(ids) // 4
        assert r["n_tokens"] == n <= 64 and bytes(r["ids"])[: len(ids)] == ids
        rest = np.frombuffer(bytes(r["ids"])[len(ids) :], "<u4")
        assert (rest == 9).all() and len(rest) == (0 if n & (n - 1) == 0 else 64 - n)


def test_fill_middle_with_odd_marks_and_rates(spark):
    rows = [(k, f"line $1 {k}\n\\ two\n\n\U0001f600 end") for k in range(300)] + [(300, "x" * 200_000 + "\n" * 100_000), (None, "a\nb")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    marks = ("$0", "\\1", "[^]")
    done = fill_middle.fill_middle(docs, marks=marks, rate=60, suffix_first=30).select("*", fill_middle.restore(F.col("output"), F.col("form"), marks).alias("back"))
    got = done.collect()
    assert all(r["back"] == r["text"] for r in got) and len(got) == len(rows)
    share = {f: sum(r["form"] == f for r in got) / len(got) for f in ("plain", "psm", "spm")}
    assert 0.3 < share["plain"] < 0.5 and 0.3 < share["psm"] < 0.55 and 0.08 < share["spm"] < 0.3
