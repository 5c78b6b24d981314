"""Cases in which doing a part of an operator's job gives wrong results."""

import numpy as np

from reviewtrust.llm import fingerprints, quality, secrets, simhash
from tests.llm import brute as B


def test_op4_likeness_with_heavy_repeats(spark):
    loop = [f"h{k}" for k in range(5)]
    one, two = [f"a{k}" for k in range(1000)], [f"b{k}" for k in range(1000)]
    pairs = [
        (loop * 600 + one, loop * 600 + two),  # only the light shingles differ
        (loop * 600 + one, one),  # only one text has the heavy ones
        (loop * 600 + one, loop * 200 + one),
        (one[:600] + two, one + two),
    ]
    rows = [(" ".join(a), " ".join(b)) for a, b in pairs]
    made = spark.createDataFrame(rows, "a string, b string").select("a", "b", *(fingerprints.signature(x).alias(f"of_{x}") for x in ("a", "b")))
    got = made.select("a", "b", fingerprints.likeness(*(fingerprints._cells(made[f"of_{x}"]) for x in ("a", "b"))).alias("told")).collect()
    assert len(got) == len(pairs)
    assert all(abs(r["told"] - B.weighted_jaccard(r["a"], r["b"])) < 0.15 for r in got)


def test_op4_leaves_no_sample_out(monkeypatch):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, most, n)) for most, n in ((3, 400), (50, 900), (10**6, 3000), (9, 6))]
    got = [fingerprints.cells_of(t) for t in texts]
    monkeypatch.setattr(fingerprints, "_FIRST", 10**6)  # all pairs at once, none skipped
    assert all(np.array_equal(a, fingerprints.cells_of(t)) for a, t in zip(got, texts, strict=True))
    assert all((g > 0).all() for g in got) and not fingerprints.cells_of(" \n").any()


def _secrets_table(words, seed):
    """Texts with labelled credentials of one format, and the last 40 documents each with an unlabelled one of it."""
    rng = np.random.default_rng(seed)
    key = lambda: "QZ" + "".join(rng.choice(list("ABCDEFGHJK0123456789"), 18))
    word = lambda: "".join(rng.choice(list("aeiourstln"), 14))
    texts = [f"password = {key()} then " + " ".join(word() for _ in range(words // 200)) for _ in range(200)]
    planted = [key() for _ in range(40)]
    return [*texts, *(f"{word()} {k} {word()}" for k in planted)], planted


def test_op5_unlabelled_credentials_come_out_of_small_and_large_tables(spark):
    for words in (600, 6000):  # fewer distinct candidates than MAX_EXAMPLES, and more
        texts, planted = _secrets_table(words, words)
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
        added = {(r["doc_id"], texts[r["doc_id"]][s["start"] : s["end"]]) for r in secrets.secret_spans(docs).collect() for s in r["added"]}
        assert added == {(200 + k, token) for k, token in enumerate(planted)}


def test_pipeline_removes_near_copies_that_fingerprints_miss(spark):
    rng = np.random.default_rng(6)
    rows, groups = [], []
    for k in range(30):
        words = [f"w{x}" for x in rng.integers(0, 5000, 200)]
        other = list(words)
        for at in rng.choice(190, 3 if k < 15 else 12, replace=False):  # 12 changed words are too many
            other[at] = f"x{k}{at}"
        rows += [(2 * k, " ".join(words), "en", "s"), (2 * k + 1, " ".join(other), "en", "s")]
        near = len(_shingles(words) & _shingles(other)) >= 0.8 * len(_shingles(words) | _shingles(other))
        groups += [2 * k] if near else [2 * k, 2 * k + 1]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    assert 15 <= 60 - len(groups) < 30
    prints = [simhash.simhash(r[1]) for r in rows]
    assert any((prints[i] ^ prints[i + 1]).bit_count() > 2 for i in range(0, 30, 2))
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == groups


def _shingles(words):
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_pipeline_family_of_different_near_copies_without_pairwise_rows(spark, monkeypatch):
    rng = np.random.default_rng(8)
    base, rows = [f"w{k}" for k in range(150)], []
    for k in range(2000):
        words = list(base)
        words[int(rng.integers(0, 150))] = f"x{k}"
        rows.append((k, " ".join(words), "en", "s"))
    rows += [(5000 + k, " ".join(f"y{k}.{j}" for j in range(60)), "en", "s") for k in range(40)]
    made = []
    may_reach = simhash._may_reach

    def counting(pairs):
        out = may_reach(pairs)
        made.append(out.count())
        return out

    monkeypatch.setattr(simhash, "_may_reach", counting)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == [0, *range(5000, 5040)]
    assert sum(made) <= 35 * 2000


def test_text_links_join_what_all_pairs_join(spark):
    """Families of several sizes and drifting chains against brute force, every text its own root."""
    rng = np.random.default_rng(9)
    texts = []
    for _ in range(40):
        words = [f"w{x}" for x in rng.integers(0, 400, int(rng.integers(1, 80)))]
        for _ in range(int(rng.integers(1, 12))):
            texts.append(" ".join(words))
            for _ in range(int(rng.integers(0, 3))):
                words[int(rng.integers(0, len(words)))] = f"w{rng.integers(0, 400)}"
    texts = sorted(set(texts))
    rows = spark.createDataFrame([(k, k, t) for k, t in enumerate(texts)], "id bigint, root bigint, text string")
    sets = [set(simhash._shingle_hashes(t).tolist()) for t in texts]
    want, got = list(range(len(texts))), list(range(len(texts)))

    def join(parent, a, b):
        while parent[a] != a:
            a = parent[a]
        while parent[b] != b:
            b = parent[b]
        parent[max(a, b)] = min(a, b)

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                join(want, i, j)
    for r in simhash.text_links(rows).collect():
        join(got, r["a"], r["b"])

    def root(parent, a):
        return a if parent[a] == a else root(parent, parent[a])

    assert [root(want, k) for k in range(len(texts))] == [root(got, k) for k in range(len(texts))]
    assert len({root(want, k) for k in range(len(texts))}) < len(texts)


def test_op1_sees_repeated_windows_at_every_offset():
    rng = np.random.default_rng(12)
    at = quality.STATISTICS.index("repeated_windows")
    for gap in range(9):
        passage, fill = [f"p{k}" for k in range(15)], [f"f{x}" for x in rng.integers(0, 10**6, 40 + gap)]
        words = [*passage, *fill, *passage]
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        got = quality.statistics(" ".join(words))[at]
        assert abs(got - (1 - len(set(windows)) / len(windows))) < 1e-12 and got > 0
    assert quality.statistics("one two")[at] == 0.0


def _op4_texts():
    rng = np.random.default_rng(7)
    made = [" ".join(f"w{x}" for x in rng.integers(0, most, n)) for most, n in ((3, 300), (50, 400), (10**6, 900), (9, 6), (40, 33))]
    return [*made, *made[:2], "", " \n\t", None, "one", " a\x0bb c d e ", "é ü x " * 40, "same line again and again\n" * 200]


def test_op4_runs_no_python_on_the_executors(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(_op4_texts())], "doc_id bigint, text string")
    plan = fingerprints.fingerprints(docs)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "InArrow"))


def test_op4_rows_of_pairs_equal_numpy_with_and_without_cells_left_over(spark, monkeypatch):
    texts = _op4_texts()
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(3, texts[3])], "doc_id bigint, text string")
    want = lambda t: fingerprints.cells_of(t or "").astype(">u2").tobytes().hex()
    for enough in (fingerprints.ENOUGH, 2):  # 2: about 17 of 128 cells have no value below the limit
        monkeypatch.setattr(fingerprints, "ENOUGH", enough)
        got = fingerprints.fingerprints(docs).collect()
        assert len(got) == len(texts) + 1
        assert all(r["fp"] == want(texts[r["doc_id"]]) and r["edited_fp"] == want(r["edited"]) for r in got)
