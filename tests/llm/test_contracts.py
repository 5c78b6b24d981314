"""Every corpus query on whole tables against plain Python, the libraries or held-out labels."""

import math
import zlib
from collections import defaultdict

from tests.llm import brute as B
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from reviewtrust.llm import queries as Q
from reviewtrust.llm import rules, simhash
from reviewtrust.llm.chunks import ChunkEncoder, tokenizer_library, worker_encoder
from reviewtrust.llm.repair import compress, expand, expand_range
from reviewtrust.llm.secrets import Automaton, infer

EDGES = [
    (3, None, "en", "a"),
    (1, "", None, None),
    (2, " \t\n\n \x0b", "en", None),
    (4, "one two", None, "a"),
    (4, "one two", None, "a"),
    (5, "One  two\n three\x1cfour five \n", "en", "b"),
    (6, "the same line " * 4 + "\n" + "The Same Line " * 4 + "\n\n", "en", "a"),
    *((k, "a line that many documents share with each other, over forty\nown %d" % k, "en", "a") for k in range(7, 13)),
    (13, "word%d " * 30000 % tuple(range(30000)), "de", "c"),
    (14, "PassWord = 'abcdefgh1234XYZ' AKIAABCDEFGHIJKLMN2 deadbeefdeadbeef00 token: short ſecret=abcdefghijklmno", "en", "a"),
    (15, "it's <|endoftext|> İ. é̀ \U0001f600!!.. x² 12345 don't 你好", "fr", "a"),
    (16, "z" * 5000 + "aaaa" * 700, "fr", "a"),
    (17, "a b c d e f g h " * 6, "en", "b"),
    (18, "A<|ENDOFTEXT|>b.\n\n<|endoftext|>\n\n <|StartOfText|>x <|startoftext|>\n", "en", "a"),
    (19, "a text with <P> in it\nand <M>", "en", "a"),
    *((k, "copied text of ten words that is here nine times", "es", "hot") for k in range(20, 29)),
]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Folders by name: edge cases with clashing extra columns, an empty table, and the smallest given data."""
    schema = "doc_id bigint, text string, lang string, source string"
    out = {"small": "/root/testdata/sf0.001"}
    for name, rows in (("edges", EDGES), ("empty", [])):
        folder = str(tmp_path_factory.mktemp(name))
        df = spark.createDataFrame(rows, schema)
        clash = ("n_chars", "n", "size", "score", "fp", "kept", "line", "key", "grp", "part", "doc", "tag", "content", "ids", "w")
        df.select("*", *(F.lit("x").alias(c) for c in clash)).write.parquet(f"{folder}/documents.parquet")
        labels = [(7, 1, 0), (8, 0, 0), (7, 1, 0), (9, None, 0), (None, 1, 1)] if rows else []
        spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        out[name] = folder
    return out


def documents(spark, folder):
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "source").collect()
    return [(r[0], r[1], r[2]) for r in rows]


@pytest.fixture(scope="module", params=["small", "edges", "empty"])
def data(request, spark, tables):
    """(rows by plain reading, function that runs a query to sorted rows)."""
    folder = tables[request.param]
    run = lambda name: sorted(tuple(r) for r in Q.QUERIES[name](spark, folder).collect())
    return documents(spark, folder), run


def test_op1_scores_every_row(data):
    rows, run = data
    got = run("op1_quality")
    assert [g[0] for g in got] == sorted(d for d, *_ in rows)
    assert all(0 <= s <= 1 and p == (s >= 0.3) and h == (zlib.crc32(str(d).encode()) % 5 == 0) for d, h, s, p in got)


def test_op1_ranks_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")
    got = Q.QUERIES["op1_quality"](spark, folder).where("held_out").join(labels, "doc_id").collect()
    good, bad = ([r["score"] for r in got if r["quality"] == q] for q in (1, 0))
    assert len(bad) > 5 and np.mean([[g > b for b in bad] for g in good]) > 0.95


def test_op2_counts_as_the_library(data):
    rows, run = data
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    counts = [(d, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for d, x, _ in rows]
    assert run("op2_token_counts") == sorted((d, b, n, n > 512) for d, b, n in counts)


def test_op3_base_counts(data):
    rows, run = data
    got = run("op3_quality_rules")
    assert [g[:7] for g in got] == sorted((d, *B.base_counts(x)) for d, x, _ in rows)
    assert not any(g[6] and g[7] for g in got)


def test_op4_fingerprints(data):
    rows, run = data
    got = run("op4_fingerprints")
    assert [g[0] for g in got] == sorted(d for d, *_ in rows)
    distinct = sorted({(d, x or "") for d, x, _ in rows})
    want = {d: (n, B.sha(e), e) for d, n, e in B.edited(distinct)}
    after = {d: distinct[(k + 1) % len(distinct)][0] for k, (d, _) in enumerate(distinct)}
    prints, texts = {g[0]: g[3] for g in got}, dict(distinct)
    by_text = {}
    for d, n, digest, fp, other, near, far in got:
        assert (n, digest) == want[d][:2]
        assert by_text.setdefault(texts[d], fp) == fp and by_text.setdefault(want[d][2], other) == other
        for a, b, told in ((fp, other, near), (fp, prints[after[d]], far)):
            cells = [(a[i : i + 4], b[i : i + 4]) for i in range(0, 512, 4)]
            filled = [c for c in cells if c != ("0000", "0000")]
            assert math.isclose(told, sum(x == y for x, y in filled) / len(filled) if filled else 1.0)
    errors = [g[5] - B.weighted_jaccard(texts[g[0]], want[g[0]][2]) for g in got if g[1] > 1000]
    assert not errors or np.sqrt(np.mean(np.square(errors))) < 0.1


def test_op5_spans(data):
    rows, run = data
    got = {}
    for d, *numbers, digest, spans in run("op5_secrets"):
        got[d] = (numbers, digest, spans.split(",") if spans else [])
    for d, x, _ in rows:
        want = B.secret_spans(x)
        numbers, digest, spans = got[d]
        assert numbers == [sum(s.startswith(k) for s in want) for k in ("assign", "access", "hex")]
        assert digest == B.sha(",".join(want)) and [s for s in spans if not s.startswith("like_")] == want


def test_op6_lines(data):
    rows, run = data
    assert run("op6_line_dedup") == sorted(B.kept_lines([(d, x) for d, x, _ in rows]))


def test_op7_components(data):
    rows, run = data
    prints = [(d, B.fingerprint(x)) for d, x, _ in rows]
    lowest = B.linked(prints)
    assert run("op7_simhash") == sorted((d, f"{f:016x}", lowest[d]) for d, f in prints)


def test_op8_mix(data):
    rows, run = data
    sizes, taken, source = defaultdict(int), defaultdict(int), {d: s for d, _, s in rows}
    for _, x, s in rows:
        sizes[s] += len(B.WORD.findall(x or ""))
    want, got = B.targets(sizes), run("op8_mix_sources")
    assert got == run("op8_mix_sources") and [g[0] for g in got] == sorted(d for d, *_ in rows)
    for d, size, of_source, target, words in got:
        s = source[d]
        assert of_source == sizes[s] and math.isclose(target, want[s], abs_tol=1e-6) and words <= 2 * size
        taken[s] += words
    assert all(abs(taken[s] - want[s]) <= 64 + 0.01 * want[s] for s in want)


def test_op9_files(data):
    rows, run = data
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    start, want = 0, []
    for d, x, _ in sorted((d, x or "", 0) for d, x, _ in rows):
        ids = [*t.encode(x, add_special_tokens=False).ids, 2]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert run("op9_repair_files") == want


def test_op10_ids_and_round_trip(data):
    rows, run = data
    encoding = B.tiktoken_encoding()
    want = []
    for d, x, _ in rows:
        ids = encoding.encode_ordinary(x or "")
        want.append((d, len(ids), B.sha(" ".join(map(str, ids))), B.sha(x or "")))
    assert run("op10_byte_bpe") == sorted(want)


def test_op11_forms_and_restored_texts(data):
    rows, run = data
    assert run("op11_fill_middle") == sorted(B.filled_middle(d, x) for d, x, _ in rows)


def test_op13_pieces(data):
    rows, run = data
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    whole, places, got = defaultdict(list), defaultdict(list), run("op13_packing")
    for d, x, _ in rows:
        whole[d].append([*t.encode(x or "", add_special_tokens=False).ids, 1])
    want = []
    for d, copies in whole.items():
        for ids in copies:
            cuts = [(a, ids[a : a + 2048]) for a in range(0, len(ids), 2048)]
            want += [(d, a, len(c), zlib.crc32(np.array(c, "<u4").tobytes()), len(ids)) for a, c in cuts]
    assert [g[:5] for g in got] == sorted(want)
    for _, _, length, _, _, sequence, offset in got:
        places[sequence].append((offset, length))
    for pieces in places.values():
        ends = [0, *(a + n for a, n in sorted(pieces))]
        assert [a for a, _ in sorted(pieces)] == ends[:-1] and ends[-1] <= 2048
    full = sum(len(i) for copies in whole.values() for i in copies)
    assert len(places) <= -(-full // 2048) + max(1, 0.02 * len(places))


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_null_ids_and_texts_that_share_one(spark, tmp_path, name):
    rows = [(None, "one text", "en", "a"), (None, "another text", None, "a"), (3, "x y z", "en", None), (3, "u v\nw", "en", "b")]
    rows += [(None, None, None, None), (3, None, "en", "b"), (3, "x y z", "en", None)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = Q.QUERIES[name](spark, str(tmp_path)).collect()
    if name != "op12_collocations":
        assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows)


def test_pipeline_stages(spark, tables):
    import corpus_pipeline as C

    for name, folder in tables.items():
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        columns, count = docs.columns, docs.count()
        for stage, step in C.STAGES:
            before, docs = docs, step(spark, docs, folder)
            if stage != "byte_bpe":
                assert docs.columns == columns and docs.dtypes == before.dtypes
            docs = spark.createDataFrame(docs.collect(), docs.schema)
            now = docs.count()
            if stage == "line_dedup":
                assert now == count
            if stage in ("quality_rules", "simhash_near_dedup"):
                assert now <= count
            if stage == "simhash_near_dedup":
                assert docs.select("text").distinct().count() == now
            count = now
        if name == "small":
            encoding = B.tiktoken_encoding()
            assert count and all(encoding.decode(r["ids"]) is not None for r in docs.collect())


# ------------------------------------------------------------------ parts


def test_outliers_go_and_clean_rows_stay(spark):
    rng = np.random.default_rng(1)
    clean = [" ".join("abcdefgh"[: rng.integers(2, 8)] + str(i) for i in rng.integers(0, 900, 120)) for _ in range(200)]
    junk = [" ".join(f"{w}***" for w in t.split()) for t in clean[:20]]
    rows = [(i, t, "en", "s") for i, t in enumerate(clean + junk)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    kept = {r["doc_id"] for r in rules.keep_good(docs).collect()}
    assert kept == set(range(200))


def test_near_fingerprints_in_crowded_buckets_all_link(spark):
    rng = np.random.default_rng(2)
    prints = {int(x) for x in rng.integers(-(2**62), 2**62, 40)}
    for base in list(prints)[:2]:  # crowds that share most openings, and chains of steps of two bits
        at = base
        for k in range(120):
            prints.add(base ^ (1 << int(rng.integers(0, 63))) ^ (1 << int(rng.integers(0, 63))))
            at ^= (1 << (k % 63)) | (1 << ((k * 7 + 1) % 63))
            prints.add(at)
    df = spark.createDataFrame([(p,) for p in prints], "fp bigint")
    edges = {(r["a"], r["b"]) for r in simhash.links(df).collect()}
    assert all((a ^ b).bit_count() <= 2 for a, b in edges)
    parent = {p: p for p in prints}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for a, b in edges:
        parent[root(a)] = root(b)
    want = B.linked([(p, p % 2**64) for p in prints])
    groups = defaultdict(set)
    for p in prints:
        groups[root(p)].add(want[p])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))


def test_grammar_round_trip_and_random_access():
    rng = np.random.default_rng(3)
    for ids in (rng.integers(0, 40, 20000), np.zeros(5001, int), np.tile([5, 5, 7], 900), np.array([1]), np.array([], int)):
        seq, made, lengths = compress(ids.astype("<u4"), 49408)
        assert np.array_equal(expand(seq, made, 49408), ids)
        for a, b in ((0, 1), (17, 400), (len(ids) // 2, len(ids))):
            if a < b <= len(ids):
                assert np.array_equal(expand_range(seq, made, lengths, 49408, a, b), ids[a:b])


def test_memo_that_overflows_stays_exact():
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        encoder = ChunkEncoder(tokenizer_library(f.read()), True, limit=9000)
    for x in [" ".join(f"w{i}{j}." for j in range(i + 1)) for i in range(60)]:
        assert encoder.encode(x) == np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize(("name", "spaces"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_added_tokens_in_any_case_and_beside_anything(name, spaces):
    rng = np.random.default_rng(11)
    parts = ["<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|StartOfText|>", "<|", "|>", " ", "\n", "\n\n", "  ", "\t", "."]
    parts += ["!", "'s", "'", "word", "Word", "é", "İ", "12", "<", ">", "\x1c", "你", "x²"]
    texts = ["".join(rng.choice(parts, rng.integers(1, 9))) for _ in range(20000)]
    with open(P.path(name), encoding="utf-8") as f:
        content = f.read()
    encoder, want = worker_encoder(content, spaces), Tokenizer.from_str(content).encode_batch(texts, add_special_tokens=False)
    assert [encoder.encode(t) for t in texts] == [np.array(w.ids, "<u4").tobytes() for w in want]


def test_automata_tell_formats_apart():
    rng = np.random.default_rng(4)
    draw = lambda letters, n: "".join(rng.choice(list(letters), n))
    keys = ["QZ" + draw("ABCDEFGHJK0123456789", 18) for _ in range(300)]
    words = [draw("aeiourstln", 14) for _ in range(300)]
    a = Automaton(keys)
    assert sum(s is not None for s in a.states) < 100
    formats = infer({"access": keys[:200], "other": words})
    assert all(formats.score(k)[0] > formats.threshold for k in keys[200:])
