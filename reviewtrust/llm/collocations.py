"""Phrase collocations from count streams in prefix and suffix order.

Counting. Pass by pass over the texts, bounded saturating filters (one for phrases of two words, one for three) tell which phrases
surely are too rare; a last pass emits at each place the longest run of words, up to ``LONGEST``, whose inner phrases all
pass, counted in the map stage. A phrase that is frequent enough covers only such places, so the sums over the runs' beginnings are
its exact counts; the filters only save shuffled rows. Words are counted apart, without a filter.

Estimation. The counts of all orders form one stream sorted by words (prefix order) and one sorted by words from the
last (suffix order), both range-partitioned. Walking a stream keeps the counts of the beginnings of the present phrase on a
stack: a phrase meets the counts of all its left parts in prefix order and of all its right parts in suffix order, and tells
its one-word extensions' counts to them, with no lookup by hash. Where a partition starts inside a family, the few
beginnings it lacks (less than ``LONGEST`` a partition) are read afterwards and filled in.

One-word extensions are enough for the subsumption test: a longer candidate around a phrase occurs no more often than
the phrase extended by one of its neighbours, which is then a candidate too.

Null texts are empty, a null lang is ``und``. Texts are counted row by row, repeated rows included; doc_id and other columns are not
read. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewtrust.llm.common import workspace

LONGEST = 5
LEAST = 100
TOP = 2000
NO_LANG = "und"
#: Buckets of a filter: about one for each FILTER_LOAD words of the corpus, between these powers of two.
FILTER_LOAD = 4
FILTER_BITS = (16, 26)
#: Orders that have a filter.
FILTERED = (2, 3)
#: Buckets of one row of a filter.
SLICE = 1 << 16
#: Entries that a task counts before it passes them on, and bytes of text taken at once.
HELD = 300_000
PART = 4 << 20
#: Rows of each of so many parts are ranked before all of a language's are.
RANK_PARTS = 64

#: The phrases' counts are dealt to one part for each PART_WORDS words of the corpus, but to so many at least.
PARTS = 64
PART_WORDS = 1 << 20

#: No byte of UTF-8 text: stands between pieces.
_BREAK = b"\xff"
_TABLE = bytes.maketrans(
    bytes(range(ord("A"), ord("Z") + 1)) + b".,;:!?\n\x0b\x0c\r", bytes(range(ord("a"), ord("z") + 1)) + _BREAK * 10
)
_ROOM = b" " + _BREAK + b" "


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """(lang, words of many texts, breaks between pieces) for batches of rows (lang, text)."""
    for batch in batches:
        held: dict[str, list[bytes]] = {}
        size: Counter = Counter()
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
            held.setdefault(lang, []).append(text)
            size[lang] += len(text)
            if size[lang] > PART:
                yield lang, _words(held.pop(lang))
                del size[lang]
        for lang, texts in held.items():
            yield lang, _words(texts)


def _words(texts: list[bytes]) -> list[bytes]:
    return _BREAK.join(texts).translate(_TABLE).replace(_BREAK, _ROOM).split()


class _Hashes(dict):
    """Hash of each word, kept while there is room; 0 for a break."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > HELD:
            self.clear()
        self[word] = value = 0 if word == _BREAK else xxhash.xxh3_64_intdigest(word) | 1
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def _buckets(hashes: np.ndarray, lang: str, order: int, bits: int) -> np.ndarray:
    """Filter bucket of the phrase of ``order`` words at each place, over its break or not."""
    mixed = np.full(max(len(hashes) - order + 1, 0), xxhash.xxh3_64_intdigest(lang.encode(), order), np.uint64)
    for k in range(order):
        mixed = (mixed ^ hashes[k : len(hashes) - order + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return ((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - bits)).astype(np.int64)


def _passes(packed: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    return (packed[buckets >> 3] >> (7 - (buckets & 7)).astype(np.uint8)) & 1 > 0


def _runs(hashes: np.ndarray, lang: str, passing: dict[int, np.ndarray], bits: int, longest: int) -> np.ndarray:
    """How many words the run at each place has: all its inner phrases of filtered orders pass, no break in it."""
    n = len(hashes)
    length = (hashes != 0).astype(np.int64)
    for order in range(2, longest + 1):
        # A run of ``order`` words: one less fits here and at the next place, and the whole passes if that order has a filter.
        longer = np.zeros(n, bool)
        longer[:-1] = (length[:-1] >= order - 1) & (length[1:] >= order - 1)
        if order in passing and n >= order:
            at = np.flatnonzero(longer[: n - order + 1])
            fine = _passes(passing[order], _buckets(hashes, lang, order, bits)[at])
            longer[:] = False
            longer[at[fine]] = True
        length[longer] = order
    return length


def _word_counts(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for lang, words in _parts(batches):
            _add(counts, lang, words)
            if len(counts) > HELD:
                yield _counted(counts)
        yield _counted(counts)

    return texts.mapInArrow(run, "lang string, phrase string, n bigint").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _add(counts: Counter, lang: str, words: list[bytes]) -> None:
    for word, n in Counter(words).items():
        counts[lang, word] += n


def _counted(counts: Counter, least: int = 1) -> pa.RecordBatch:
    """The counts from ``least`` on as rows; empties them."""
    items = [(lang, phrase, n) for (lang, phrase), n in counts.items() if n >= least and phrase != _BREAK]
    counts.clear()
    langs, phrases, numbers = zip(*items, strict=True) if items else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(langs, pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(numbers, pa.int64())],
        ["lang", "phrase", "n"],
    )


def _add_saturating(counts: np.ndarray, buckets: np.ndarray, most: int) -> None:
    hit, n = np.unique(buckets, return_counts=True)
    counts[hit] = np.minimum(counts[hit] + n, most)


def _filter(texts: DataFrame, order: int, passing: dict[int, np.ndarray], bits: int, least: int) -> np.ndarray:
    """A bit for each bucket: whether it holds ``least`` phrases of ``order`` words or more, of places where the shorter filters pass.

    Counts stop at ``least`` (at most 255) in each task, which loses nothing. A task sends, slice by slice, the filled
    buckets or, where these are many, all; the driver gets one bit a bucket.
    """
    spark, most = texts.sparkSession, min(least, 255)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, hashes = np.zeros(1 << bits, np.uint8), _Hashes()
        for lang, words in _parts(batches):
            held = hashes.of(words)
            runs = _runs(held, lang, passing, bits, order - 1)
            here = np.zeros(max(len(held) - order + 1, 0), bool)
            if len(here):
                fits = runs >= order - 1
                here = fits[: len(here)] & fits[1 : len(here) + 1]
            _add_saturating(counts, _buckets(held, lang, order, bits)[here], most)
        for first in range(0, 1 << bits, SLICE):
            part = counts[first : first + SLICE]
            full = np.flatnonzero(part)
            if len(full):
                few = 3 * len(full) < len(part)
                places = full.astype("<u2").tobytes() if few else b""
                yield _row([first // SLICE], [places], [(part[full] if few else part).tobytes()])

    def _row(slices: list[int], places: list[bytes], values: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(slices, pa.int32()), pa.array(places, pa.binary()), pa.array(values, pa.binary())], ["slice", "places", "counts"]
        )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, places, values in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                total = sums.setdefault(k, np.zeros(SLICE, np.uint16))
                at = np.frombuffer(places, "<u2") if places else slice(None)
                total[at] = np.minimum(total[at] + np.frombuffer(values, np.uint8), most)
        for k, total in sums.items():
            yield _row([k], [b""], [np.packbits(total >= most).tobytes()])

    schema = "slice int, places binary, counts binary"
    dealt = texts.mapInArrow(count, schema).repartition("slice").mapInArrow(add, schema)
    out = np.zeros((1 << bits) // 8, np.uint8)
    for row in workspace(spark, "collocation-filter").write(dealt).select("slice", "counts").collect():
        out[row["slice"] * SLICE // 8 : (row["slice"] + 1) * SLICE // 8] = np.frombuffer(row["counts"], np.uint8)
    return out


def _run_counts(texts: DataFrame, passing: dict[int, np.ndarray], bits: int, longest: int, least: int, parts: int) -> DataFrame:
    """(lang, phrase, n) of the phrases of two words or more that the longest passing runs begin with, from ``least`` on.

    A task sends its counts by hash in ``parts`` parts, one row for each; the sums are made part by part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, hashes = Counter(), _Hashes()
        for lang, words in _parts(batches):
            runs = _runs(hashes.of(words), lang, passing, bits, longest)
            for size in range(2, longest + 1):
                at = np.flatnonzero(runs >= size).tolist()
                _add(counts, lang, [b" ".join(words[i : i + size]) for i in at])
            if len(counts) > HELD:
                yield from send(counts)
        yield from send(counts)

    def send(counts: Counter) -> Iterator[pa.RecordBatch]:
        dealt: dict[int, list] = {}
        for key, n in counts.items():
            dealt.setdefault(xxhash.xxh3_64_intdigest(key[1], 5) % parts, []).append((*key, n))
        counts.clear()
        for part, items in dealt.items():
            langs, phrases, numbers = zip(*items, strict=True)
            columns = [pa.array([list(langs)]), pa.array([[p.decode() for p in phrases]]), pa.array([list(numbers)])]
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *columns], ["part", "langs", "phrases", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, current = Counter(), None
        for batch in batches:
            for row in range(batch.num_rows):
                part, *lists = (batch.column(c)[row].as_py() for c in range(4))
                if part != current:
                    yield _counted(sums, least)
                    current = part
                for lang, phrase, n in zip(*lists, strict=True):
                    sums[lang, phrase.encode()] += n
        yield _counted(sums, least)

    sent = texts.mapInArrow(run, "part int, langs array<string>, phrases array<string>, counts array<bigint>")
    return sent.repartition("part").sortWithinPartitions("part").mapInArrow(add, "lang string, phrase string, n bigint")


def phrase_counts(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(counts, totals): (lang, words, a) of all phrases of up to ``longest`` words that occur ``least`` times or more;
    (lang, total) with the number of all words."""
    space = workspace(docs.sparkSession, "collocations")
    texts = docs.select(F.coalesce(docs["lang"], F.lit(NO_LANG)).alias("lang"), docs["text"]).where(F.length("text") > 0)
    words = space.write(_word_counts(texts))
    totals = space.write(words.groupBy("lang").agg(F.sum("n").alias("total")))
    corpus = totals.agg(F.sum("total")).first()[0] or 0
    bits = min(max(int(corpus // FILTER_LOAD).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])
    passing: dict[int, np.ndarray] = {}
    for order in FILTERED:
        if order <= longest:
            passing[order] = _filter(texts, order, passing, bits, least)
    counted = _run_counts(texts, passing, bits, longest, least, max(PARTS, corpus // PART_WORDS))
    longer = counted.select("lang", F.split("phrase", " ").alias("words"), F.col("n").alias("a"))
    single = words.where(F.col("n") >= least).select("lang", F.array("phrase").alias("words"), F.col("n").alias("a"))
    return space.write(single.unionByName(longer)), totals


def along(rows: DataFrame, order: str, most: str, parts: str) -> DataFrame:
    """rows(lang, words, a, ...) with ``parts``, the counts of the phrase's beginnings, shortest first, and ``most``, the highest count
    of the phrases one word longer that begin with it (0: none); ``order``: prefix, or suffix for ends instead of beginnings.

    One pass over rows range-partitioned and sorted in that order. A family cut by a partition's edge leaves at most
    ``LONGEST`` - 1 rows a partition without a count; these come to the driver to be filled in.
    """
    spark, forward = rows.sparkSession, order == "prefix"
    extra = [f for f in rows.schema.fields if f.name not in ("lang", "words", "a")]
    carried = [f.name for f in extra]
    names = ["lang", "words", "a", *carried, parts, most]
    schema = "lang string, words array<string>, a bigint, " + "".join(f"{f.name} {f.dataType.simpleString()}, " for f in extra)
    schema += f"{parts} array<bigint>, {most} bigint"

    def turned(words: list[str]) -> list[str]:
        return words if forward else words[::-1]

    def batch_of(done: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.list_(pa.string()), pa.int64(), *kept_types, pa.list_(pa.int64()), pa.int64()]
        columns = zip(*done, strict=True) if done else [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    kept_types = [pa.list_(pa.int64()) if f.dataType.simpleString().startswith("array") else pa.int64() for f in extra]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[list] = []  # [lang, words in walking order, count (None: lies in an earlier partition), carried, highest below]
        done: list[tuple] = []

        def pop() -> None:
            lang, words, a, held, best = stack.pop()
            done.append((lang, turned(words), a, *held, [s[2] for s in stack], best))

        for batch in batches:
            for lang, words, a, *held in zip(*(batch.column(c).to_pylist() for c in ("lang", "words", "a", *carried)), strict=True):
                words = turned(words)
                while stack and not (stack[-1][0] == lang and words[: len(stack[-1][1])] == stack[-1][1]):
                    pop()
                for k in range(len(stack) + 1, len(words)):
                    stack.append([lang, words[:k], None, [None] * len(carried), 0])
                if stack:
                    stack[-1][4] = max(stack[-1][4], a)
                stack.append([lang, words, a, held, 0])
            yield batch_of(done)
            done = []
        while stack:
            pop()
        yield batch_of(done)

    keyed = rows.withColumn("_order", F.col("words") if forward else F.reverse("words"))
    ranged = keyed.repartitionByRange("lang", "_order").sortWithinPartitions("lang", "_order").drop("_order")
    walked = workspace(spark, f"collocation-{order}").write(ranged.mapInArrow(walk, schema))
    lacking = walked.where("a is null").select("lang", "words", most).collect()
    below: dict[tuple, int] = {}
    for r in lacking:
        key = (r["lang"], tuple(r["words"]))
        below[key] = max(below.get(key, 0), r[most])
    known = {}
    if below:
        wanted = spark.createDataFrame([(lang, list(words)) for lang, words in below], "lang string, words array<string>")
        found = walked.where("a is not null").select("lang", "words", "a").join(F.broadcast(wanted), ["lang", "words"], "left_semi")
        known = {(r["lang"], tuple(r["words"])): r["a"] for r in found.collect()}
    if not below:
        return walked

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for lang, words, a, *held, counts, best in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if a is not None:
                    start = [tuple(words[: k + 1]) if forward else tuple(words[len(words) - k - 1 :]) for k in range(len(counts))]
                    counts = [known[lang, s] if c is None else c for c, s in zip(counts, start, strict=True)]
                    done.append((lang, words, a, *held, counts, max(best, below.get((lang, tuple(words)), 0))))
            yield batch_of(done)

    return walked.mapInArrow(fill, schema)


def _least_cut(total: Column) -> Column:
    """(score, k, l, r) of the lowest-scoring cut, of equal ones the first: exact in decimals."""

    def cut(k: Column) -> Column:
        left, right = F.get("lefts", k - 1), F.get("rights", F.size("words") - k - 1)
        wide = [c.cast("decimal(19,0)") for c in (left, right)]
        score = F.call_function("div", F.col("a").cast("decimal(18,0)") * 1000 * total.cast("decimal(15,0)"), wide[0] * wide[1])
        return F.struct(score.alias("score"), k.alias("k"), left.alias("l"), right.alias("r"))

    return F.array_min(F.transform(F.sequence(F.lit(1), F.size("words") - 1), cut))


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, share: int = 100) -> DataFrame:
    """Each language's first ``top`` phrases: lang, rank, phrase, a, l, r, n, score.

    A candidate goes if a longer one around it has ``share`` percent of its count or more.
    """
    counts, totals = phrase_counts(docs, longest, least)
    both = along(along(counts, "prefix", "after", "lefts"), "suffix", "before", "rights")
    several = both.where(F.size("words") > 1).where(100 * F.greatest("after", "before") < share * F.col("a"))
    scored = several.join(totals, "lang").select(
        "lang", F.array_join("words", " ").alias("phrase"), "a", F.col("total").alias("n"), _least_cut(F.col("total")).alias("cut")
    )
    rows = scored.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    first = rows.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best)))
    ranked = first.where(F.col("rank") <= top).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)))
    return ranked.where(F.col("rank") <= top).select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
