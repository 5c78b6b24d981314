"""Text normalization, tokens, word n-grams and set similarity as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewtrust.functions.lexicon import STOP_WORDS

# Unicode white space, written out so that every engine reads it the same way.
SPACE = r"[\s\x0B\x1C-\x1F\x85\p{Z}]+"


def squeeze(text: Column) -> Column:
    """Collapse runs of white space and trim the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def normalize(text: Column) -> Column:
    """Lower case; keep letters, digits and ``' % $ £ € / - _``, everything else one space.

    White space is no kept character, so one pass both replaces and collapses.
    """
    lowered = F.lower(F.coalesce(text, F.lit("")))
    return F.trim(F.regexp_replace(lowered, r"[^\p{L}\p{N}_'%$£€/-]+", " "))


def tokens(text: Column, drop_stop_words: bool = False) -> Column:
    found = F.regexp_extract_all(
        F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z0-9']+"), F.lit(0)
    )
    if drop_stop_words:
        return F.filter(found, lambda t: ~t.isin(STOP_WORDS))
    return found


def _grams(words: Column, size: int, combine) -> Column:
    """``combine`` over every run of ``size`` consecutive words.

    Shifted copies are zipped instead of indexing back into the word array: should the
    optimizer inline the tokenizer here, it runs a few times per row and not per word.
    """
    count = F.greatest(F.size(words) - (size - 1), F.lit(0))
    shifted = [F.slice(words, F.lit(k + 1), count) for k in range(size)]
    if size == 2:
        return F.zip_with(shifted[0], shifted[1], lambda a, b: combine(a, b))
    if size == 3:
        tail = F.zip_with(shifted[1], shifted[2], lambda b, c: F.struct(b.alias("b"), c.alias("c")))
        return F.zip_with(shifted[0], tail, lambda a, t: combine(a, t["b"], t["c"]))
    raise ValueError("word n-grams of two or three words only")


def shingles(words: Column, size: int) -> Column:
    """Distinct word n-grams as text; a shorter text is one whole-text shingle."""
    n = F.size(words)
    grams = _grams(words, size, lambda *run: F.concat_ws(" ", *run))
    return (
        F.when(n == 0, F.array().cast("array<string>"))
        .when(n < size, F.array(F.array_join(words, " ")))
        .otherwise(F.array_distinct(grams))
    )


def hashed_shingles(words: Column, size: int) -> Column:
    """:func:`shingles` as 64-bit hashes: what travels through shuffles and set operations."""
    n = F.size(words)
    # xxhash64 skips nulls, so a short text hashes just the words it has.
    whole = F.xxhash64(*[F.get(words, F.lit(k)) for k in range(size)])
    return (
        F.when(n == 0, F.array().cast("array<bigint>"))
        .when(n < size, F.array(whole))
        .otherwise(F.array_distinct(_grams(words, size, F.xxhash64)))
    )


def hashed_content(words: Column) -> Column:
    kept = F.filter(words, lambda t: ~t.isin(STOP_WORDS))
    return F.array_distinct(F.transform(kept, lambda t: F.xxhash64(t)))


def hashed_words(words: Column) -> Column:
    """One hash a word, in order, the lowest bit 1 for stop words: what travels, and what the sets are made of."""

    def coded(t: Column) -> Column:
        return F.when(t.isin(STOP_WORDS), F.xxhash64(t).bitwiseOR(F.lit(1))).otherwise(F.xxhash64(t).bitwiseAND(F.lit(-2)))

    return F.transform(words, coded)


def content_of_hashes(words: Column) -> Column:
    """:func:`hashed_content` of words that are hashed already."""
    return F.array_distinct(F.filter(words, lambda h: h.bitwiseAND(F.lit(1)) == 0))


def jaccard_from(shared: Column, left_size: Column, right_size: Column) -> Column:
    return F.when(shared > 0, shared / (left_size + right_size - shared)).otherwise(F.lit(0.0))


def dice_from(shared: Column, left_size: Column, right_size: Column) -> Column:
    total = left_size + right_size
    return F.when(
        (left_size > 0) & (right_size > 0), (shared * 2) / total
    ).otherwise(F.lit(0.0))


def jaccard(left: Column, right: Column) -> Column:
    return jaccard_from(F.size(F.array_intersect(left, right)), F.size(left), F.size(right))


def dice(left: Column, right: Column) -> Column:
    return dice_from(F.size(F.array_intersect(left, right)), F.size(left), F.size(right))


def composite(trigram: Column, bigram: Column, content: Column) -> Column:
    """Strongest of the three overlaps, the coarser two discounted."""
    return F.greatest(trigram, F.lit(0.85) * bigram, F.lit(0.75) * content)


def similarity(left: Column, right: Column) -> Column:
    """Composite similarity of two texts, 0..1."""
    lw, rw = tokens(left), tokens(right)
    return composite(
        jaccard(hashed_shingles(lw, 3), hashed_shingles(rw, 3)),
        jaccard(hashed_shingles(lw, 2), hashed_shingles(rw, 2)),
        dice(hashed_content(lw), hashed_content(rw)),
    )


def sentence_count(text: Column) -> Column:
    return F.greatest(F.lit(1), F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[.!?]+")))


def excerpt(text: Column, limit: int) -> Column:
    """Cut at a word boundary within ``limit`` characters and mark the cut."""
    cut = F.regexp_replace(F.left(text, F.lit(limit)), r" [^ ]*$", "")
    return F.when(F.length(text) > limit, F.concat(cut, F.lit(" […truncated]"))).otherwise(text)
