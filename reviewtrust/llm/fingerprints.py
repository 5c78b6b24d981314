"""Document fingerprints by consistent weighted sampling.

Terms are shingles of ``SHINGLE`` words, weighted by their number in the text. Each pair of a term and one of ``CELLS``
cells seeds r, c ~ Gamma(2, 1) and b ~ Uniform(0, 1); with weight w it takes the level t = floor(ln w / r + b) and the value
a = c * exp(-r * (t - b + 1)): the same for every weight that reaches the level, as consistent sampling asks. Each
cell keeps (term, level) of its least a over all terms. A cell of two texts is equal with the probability of
their generalised Jaccard similarity, so the share of equal cells estimates that of the texts, whatever the weights.

No sample is left out, but few are worked out in full. As a >= c * exp(-r) / w, and the leading 16 bits of the four
uniforms behind r and c bound c * exp(-r) from below without a logarithm, the other bits, b and the level are
made only for pairs whose bound does not exceed what can still be a least. ``fingerprints`` does this with rows of (term,
cell): the least of a cell is below ``ENOUGH`` / (number of shingles) but for one cell in exp(ENOUGH), and texts with a cell
that has no value below it are sampled again without a limit, by ``signature``, a column expression. ``cells_of``
is the same signature of one text in numpy.

Null and empty texts, or texts of white space, have the empty signature; two of them are alike (1.0), one of them and
another are not (0.0). A text of SHINGLE words or fewer is one term.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewtrust.llm.common import NO_ID, WHITE, let, text_of, workspace

SHINGLE = 5
CELLS = 128
#: A cell without a term; samples are 1 to 65535.
EMPTY = "0000"
#: Values looked for in a cell, on average: one cell in exp(ENOUGH) has none.
ENOUGH = 14
#: Texts of so few shingles have no limit.
FEW = 32
#: Above every value a.
_NO_LIMIT = 1e6
#: Values, at most 46, are compared in steps of 2 ** -41, beside the 16 bits of their samples, which decide ties.
_STEPS, _SAMPLES = 2.0**41, 2**16
#: Two numbers in one.
_HALF = 2**32
#: Terms that ``cells_of`` takes at a time: few at first, when no cell has a small value yet.
_FIRST, _MOST = 16, 256


def _hashes(x: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of 64-bit numbers."""
    turned = lambda v, n: (v << np.uint64(n)) | (v >> np.uint64(64 - n))
    p1, p2, p3 = np.uint64(0x9E3779B185EBCA87), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
    h = np.uint64(42 + 0x27D4EB2F165667C5 + 8) ^ (turned(x * p2, 31) * p1)
    h = turned(h, 27) * p1 + np.uint64(0x85EBCA77C2B2AE63)
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return h ^ (h >> np.uint64(32))


def _terms(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles and their numbers. Bytes are split at the white space of ``common.WORD``."""
    words = text.encode("utf-8", "surrogatepass").split()
    made = np.empty(max(len(words) - SHINGLE + 1, min(len(words), 1)), np.uint64)
    for k in range(len(made)):
        digest = 42
        for word in words[k : k + SHINGLE]:
            digest = xxhash.xxh64_intdigest(word, digest)
        made[k] = digest
    return np.unique(made, return_counts=True)


def cells_of(text: str) -> np.ndarray:
    """The signature: a number of 1 to 65535 for each cell, all 0 for a text without words."""
    terms, weights = _terms(text)
    least, kept = np.full(CELLS, np.inf), np.zeros(CELLS, np.uint16)
    heavy = np.argsort(-weights, kind="stable")
    terms, weights = terms[heavy], weights[heavy].astype(np.float64)
    at, step = 0, _FIRST
    while at < len(terms):
        term, weight = terms[at : at + step], weights[at : at + step]
        first = _hashes(term[:, None] ^ np.arange(CELLS, dtype=np.uint64)).reshape(-1)
        u = first.view(np.uint16).reshape(-1, 4)
        # exp(-r) = u0 * u1 and c = -ln(u2 * u3) >= 1 - u2 * u3, times 2 ** 64. Numbers of 32 bits round that difference
        # by less than the 1024 taken from it; the other roundings are within the 1e-5 given to the bound.
        a, b, c, d = np.ascontiguousarray(u.T).astype(np.float32)
        c += np.float32(1)
        d += np.float32(1)
        c *= d
        np.subtract(np.float32(2.0**32 - 1024), c, out=c)
        a *= b
        a *= c
        low = a.reshape(-1, CELLS)
        if weight[0] > 1:
            low *= (1 / weight).astype(np.float32)[:, None]
        bound = np.minimum(np.exp(least) * 2.0**64 * (1 + 1e-5), 3e38).astype(np.float32)
        at_pair = np.flatnonzero(low <= bound)
        if len(at_pair):
            i, j = at_pair >> 7, at_pair & (CELLS - 1)
            second = _hashes(first[at_pair])
            # The bits of each uniform: 16 of the first hash, 16 of the second.
            x = u[at_pair] * 65536.0
            x += second.view(np.uint16).reshape(-1, 4)
            x += 0.5
            x *= 2.0**-32
            r, log_c = -np.log(x[:, 0] * x[:, 1]), np.log(-np.log(x[:, 2] * x[:, 3]))
            b = ((_hashes(second) >> np.uint64(11)) + 0.5) * 2.0**-53
            level = np.floor(np.log(weight[i]) / r + b)
            value = np.full(low.shape, np.inf)
            value.reshape(-1)[at_pair] = log_c - r * (level - b + 1.0)
            best = value.argmin(axis=0)
            value = value[best, np.arange(CELLS)]
            cell = np.flatnonzero(value < least)
            least[cell] = value[cell]
            kept_level = level[np.searchsorted(at_pair, best[cell] * CELLS + cell)].astype(np.int64).view(np.uint64)
            sample = _hashes(term[best[cell]] ^ _hashes(kept_level)).view(np.int64)
            kept[cell] = np.mod(sample, 2**16 - 1) + 1
        at, step = at + step, min(step * 2, _MOST)
    return kept


def _sixteen(bits: Column, k: int) -> Column:
    part = F.shiftrightunsigned(bits, 16 * k) if k else bits
    return (part.bitwiseAND(F.lit(65535)) if k < 3 else part).cast("double")


def _first(term: Column, cell: Column) -> Column:
    return F.xxhash64(term.bitwiseXOR(cell))


def _low(first: Column) -> tuple[Column, Column]:
    """Not above x = exp(-r) and c. -ln z >= y + y ** 2 / 2 + y ** 3 / 3, y = 1 - z; roundings are far within the 1e-9."""
    x = _sixteen(first, 0) * _sixteen(first, 1) * (2.0**-32 * (1 - 1e-9))
    y = F.lit(1.0) - (_sixteen(first, 2) + 1.0) * (_sixteen(first, 3) + 1.0) * 2.0**-32
    return x, y * (y * (y * (1 / 3) + 0.5) + 1.0)


def _shift(second: Column) -> Column:
    """b"""
    return (F.shiftrightunsigned(F.xxhash64(second), 11).cast("double") + 0.5) * 2.0**-53


def _uniforms(first: Column, second: Column) -> tuple[Column, Column, Column]:
    """r, c and b of a pair."""
    x = [(_sixteen(first, k) * 65536.0 + _sixteen(second, k) + 0.5) * 2.0**-32 for k in range(4)]
    return -F.ln(x[0] * x[1]), -F.ln(x[2] * x[3]), _shift(second)


def _level(log_weight: Column, r: Column, b: Column) -> Column:
    return F.floor(log_weight / r + b)


def _value(level: Column, r: Column, c: Column, b: Column) -> Column:
    """a"""
    return c * F.exp(r * (b - 1.0 - level.cast("double")))


def _packed(term: Column, level: Column, value: Column) -> Column:
    """A number in order of the values, whose last 16 bits are the sample (term, level)."""
    sample = F.pmod(F.xxhash64(term.bitwiseXOR(F.xxhash64(level))), F.lit(_SAMPLES - 1)) + 1
    return (value * _STEPS).cast("bigint") * _SAMPLES + sample


def _words(text: Column) -> Column:
    """Words of a text that has any: white space is that of ``common.WORD``."""
    return F.split(F.btrim(text, F.lit(WHITE)), r"[\x20\x09-\x0D]+")


def _starts(words: Column, first: Column | int = 0) -> Column:
    return F.sequence(F.lit(first), F.greatest(F.size(words) - SHINGLE, F.lit(0)))


def _shingle(words: Column, at: Column) -> Column:
    return F.xxhash64(*(F.get(words, at + k) for k in range(SHINGLE)))


def _hex(sample: Column) -> Column:
    return F.lower(F.lpad(F.hex(sample), 4, "0"))


def signature(text: Column) -> Column:
    """The fingerprint of a text that is not null: 4 hexadecimal digits for each cell. All pairs are worked out, one by one."""
    some = F.btrim(text, F.lit(WHITE)) != ""
    terms = let(_words(text), lambda w: F.transform(_starts(w), lambda i: _shingle(w, i)))

    def weighted(terms: Column) -> Column:
        """(term, ln weight) of sorted terms, by the places where a new one starts."""
        first = F.filter(F.sequence(F.lit(0), F.size(terms) - 1), lambda i: (i == 0) | (F.get(terms, i) != F.get(terms, i - 1)))
        number = lambda i, end: F.ln((F.coalesce(end, F.size(terms)) - i).cast("double"))
        return let(
            first,
            lambda f: F.transform(f, lambda i, k: F.struct(F.get(terms, i).alias("t"), number(i, F.get(f, k + 1)).alias("w"))),
        )

    def packed(pair: Column, cell: Column) -> Column:
        def full(first: Column) -> Column:
            r, c, b = _uniforms(first, F.xxhash64(first))
            u = F.struct(r.alias("r"), c.alias("c"), b.alias("b"))
            return let(u, lambda u: let(_level(pair["w"], u["r"], u["b"]), lambda t: _packed(pair["t"], t, _value(t, u["r"], u["c"], u["b"]))))

        return let(_first(pair["t"], cell), full)

    cells = F.sequence(F.lit(0).cast("bigint"), F.lit(CELLS - 1).cast("bigint"))
    samples = let(
        let(F.sort_array(terms), weighted),
        lambda pairs: F.transform(cells, lambda j: _hex(F.array_min(F.transform(pairs, lambda p: packed(p, j))) % _SAMPLES)),
    )
    return F.when(some, F.array_join(samples, "")).otherwise(EMPTY * CELLS)


def _cells(signature: Column) -> Column:
    """The cells of a signature in text form."""
    places = F.sequence(F.lit(0), F.lit(CELLS - 1))
    # Of bytes: the place of a character is looked for from the start.
    return let(signature.cast("binary"), lambda s: F.transform(places, lambda i: F.substr(s, i * 4 + 1, F.lit(4)).cast("string")))


def likeness(a: Column, b: Column) -> Column:
    """Equal cells among those that at least one of two arrays of cells fills; 1 if both are empty."""
    states = F.zip_with(a, b, lambda x, y: F.when((x == EMPTY) & (y == EMPTY), 0).when(x == y, 2).otherwise(1))

    def share(s: Column) -> Column:
        filled = F.size(F.filter(s, lambda x: x > 0))
        return F.when(filled == 0, F.lit(1.0)).otherwise(F.size(F.filter(s, lambda x: x == 2)) / filled)

    return let(states, share)


def _sampled(texts: DataFrame) -> DataFrame:
    """(doc, tag, fp, edited_fp) of texts(doc, tag, text, edited), distinct, partitioned by both, alike but for a last quarter.

    A fingerprint is null where a cell has no value below the limit; texts without words may lack a row. Both texts of a
    document share most terms, so the samples of a (term, cell) serve both. Nothing is shuffled.
    """
    sides = ("a", "b")
    white, at = F.lit(WHITE), F.char_length("text") - F.floor(F.char_length("text") / 4).cast("int")
    cut = texts.select(
        "doc", "tag", F.substr("text", F.lit(1), at).alias("same"), *(F.substr(c, at + 1).alias(c) for c in ("text", "edited"))
    )
    split = cut.select("doc", "tag", "same", "text", "edited", _words(F.col("same")).alias("words"))
    # The last word of the part that both have may go on in the rest.
    shared = F.size("words") - 1
    last = F.concat(F.get("words", shared), F.when(F.rtrim("same", white) == F.col("same"), "").otherwise(" "))
    whole = [F.concat(F.slice("words", F.lit(1), shared), _words(F.concat(last, F.col(c)))) for c in ("text", "edited")]
    both = split.select("doc", "tag", shared.alias("shared"), *(w.alias(s) for w, s in zip(whole, sides, strict=True)))
    n = [F.when(F.get(s, F.lit(0)) == "", 0).otherwise(F.greatest(F.size(s) - SHINGLE + 1, F.lit(1))).cast("bigint") for s in sides]
    both = both.select("doc", "tag", "shared", *sides, (n[0] * _HALF + n[1]).alias("n"))
    words = both.select("doc", "tag", "shared", "n", F.posexplode(F.array(*sides)).alias("side", "words"))
    words = words.where(F.get("words", F.lit(0)) != "")
    # Shingles of shared words are made once, for both texts.
    ahead = F.col("shared") - SHINGLE
    places = F.explode(_starts(F.col("words"), F.when(F.col("side") == 0, 0).otherwise(F.greatest(ahead + 1, F.lit(0)))))
    placed = words.select("doc", "tag", "n", "shared", "side", "words", places.alias("at"))
    number = F.when(F.col("side") == 1, 1).when(F.col("at") <= ahead, _HALF + 1).otherwise(_HALF)
    shingles = placed.select("doc", "tag", "n", _shingle(F.col("words"), F.col("at")).alias("term"), number.cast("bigint").alias("number"))
    # Two numbers in one: rows are many, and small ones keep them in memory.
    weights = shingles.groupBy("doc", "tag", "term").agg(F.sum("number").alias("w"), F.max("n").alias("n"))
    halves = [(f"{c}_{s}", F.shiftright(c, 32) if s == "a" else F.col(c).bitwiseAND(F.lit(_HALF - 1))) for c in ("w", "n") for s in sides]
    weights = weights.select("doc", "tag", "term", *(h.alias(name) for name, h in halves))

    def limit(s: str) -> Column:
        """For a; 0 if the text lacks the term."""
        n = F.col(f"n_{s}")
        return F.when(F.col(f"w_{s}") == 0, 0.0).when(n <= FEW, _NO_LIMIT).otherwise(F.lit(float(ENOUGH)) / n)

    bound = F.greatest(*(limit(s) * F.col(f"w_{s}") for s in sides))
    light = F.greatest(*(F.col(f"w_{s}") for s in sides)) == 1
    terms = weights.select(
        "doc",
        "tag",
        "term",
        bound.alias("bound"),
        F.when(light, bound).otherwise(_NO_LIMIT**2).alias("light_bound"),
        *(F.ln(F.greatest(F.col(f"w_{s}"), F.lit(1)).cast("double")).alias(f"log_{s}") for s in sides),
        *((limit(s) - F.when(limit(s) == 0, 1.0).otherwise(0.0)).alias(f"limit_{s}") for s in sides),
    )
    cells = F.explode(F.array(*(F.lit(j).cast("bigint") for j in range(CELLS))))
    # The filters test the number of the partition as well: a Project that has it keeps a filter above it, where the hashes of
    # a pair are made once, and not for every place where the filter names them.
    part = F.spark_partition_id()
    pairs = terms.select("*", cells.alias("cell")).select("*", _first(F.col("term"), F.col("cell")).alias("first"), part.alias("p"))
    x, c = _low(F.col("first"))
    near = pairs.where((x * c <= F.col("bound")) & (F.col("p") >= 0)).drop("p")
    near = near.select("*", F.xxhash64("first").alias("second"), F.sqrt(x).alias("y"), c.alias("low_c"))
    near = near.select("*", _shift(F.col("second")).alias("b"), part.alias("p"))
    # A weight of 1 has level 0, so a = c * x ** (1 - b) = c * y ** (2 - 2 * b); and y ** z >= y / (z + (1 - z) * y) for z up to 1.
    b, y, c = F.col("b"), F.col("y"), F.col("low_c")
    whole = F.when(b > 0.5, 0.0).otherwise(1.0)
    rest = F.lit(2.0) - b * 2.0 - whole
    at_most = c * y * F.when(b > 0.5, 1.0).otherwise(y) <= F.col("light_bound") * (rest * (F.lit(1.0) - y) + y)
    drawn = near.where(at_most & (F.col("p") >= 0)).drop("p", "b")
    r, c, b = _uniforms(F.col("first"), F.col("second"))
    drawn = drawn.select("*", r.alias("r"), c.alias("c"), b.alias("b"))
    drawn = drawn.select("*", *(_level(F.col(f"log_{s}"), F.col("r"), F.col("b")).alias(f"level_{s}") for s in sides))
    drawn = drawn.select("*", *(_value(F.col(f"level_{s}"), F.col("r"), F.col("c"), F.col("b")).alias(f"value_{s}") for s in sides))

    def least(s: str) -> Column:
        value = F.col(f"value_{s}")
        return F.min(F.when(value <= F.col(f"limit_{s}"), _packed(F.col("term"), F.col(f"level_{s}"), value)))

    least = drawn.groupBy("doc", "tag", "cell").agg(*(least(s).alias(s) for s in sides))
    kept = least.select("doc", "tag", "cell", *((F.coalesce(F.col(s), F.lit(0)) % _SAMPLES).alias(s) for s in sides))
    lists = kept.groupBy("doc", "tag").agg(
        *(F.sort_array(F.collect_list(F.when(F.col(s) > 0, F.col("cell") * _SAMPLES + F.col(s)))).alias(s) for s in sides)
    )

    def joined(s: str) -> Column:
        return F.when(F.size(s) == CELLS, F.array_join(F.transform(F.col(s), lambda x: _hex(x % _SAMPLES)), ""))

    return lists.select("doc", "tag", joined("a").alias("fp"), joined("b").alias("edited_fp"))


def _next_ids(ids: DataFrame) -> DataFrame:
    """(doc, tag, next_doc, next_tag) of the distinct ids(part, doc, tag), parts being ranges in their order."""
    following = F.lead(F.struct("doc", "tag")).over(Window.partitionBy("part").orderBy("doc", "tag"))
    # One row a part: the first of the next part follows the last of this one, the very first the very last.
    firsts = ids.groupBy("part").agg(F.min(F.struct("doc", "tag")).alias("first"))
    by_part = Window.orderBy("part")
    ahead = firsts.select(
        F.col("part").alias("_part"),
        F.coalesce(
            F.lead("first").over(by_part),
            F.first("first").over(by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        ).alias("after"),
    )
    joined = ids.withColumn("next", following).join(ahead, F.col("part") == F.col("_part"))
    following = F.coalesce("next", "after")
    return joined.select("doc", "tag", "n", following["doc"].alias("next_doc"), following["tag"].alias("next_tag"))


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Every row's doc_id, n, ``edited``, its edited text, and the signatures ``fp``, ``edited_fp`` and ``next_fp`` as bytes.

    The edited text ends, instead of in its last quarter, in as many characters of the next document in order of doc_id (a
    null id first, rows of one id by a hash of the text); after the last comes the first. Rows equal in id and text
    are one document here and each get its result.

    Texts are shuffled once, by (doc, tag): the exchange serves the beginnings that documents give to the one before, the
    sampling of their terms, and the result. Signatures are shuffled once, to their own document and to the one before.
    """
    space = workspace(docs.sparkSession, "fingerprints")
    text = text_of(docs)
    keyed = docs.select(
        F.coalesce(docs["doc_id"].cast("bigint"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("tag"), text.alias("text")
    )
    ids = keyed.select("doc", "tag", F.char_length("text").alias("n")).distinct().repartitionByRange("doc", "tag")
    # For every document: whose next it is, and how much of it that one needs.
    wanted = space.write(
        _next_ids(space.write(ids.withColumn("part", F.spark_partition_id()))).select(
            F.col("next_doc").alias("doc"),
            F.col("next_tag").alias("tag"),
            F.col("doc").alias("prev_doc"),
            F.col("tag").alias("prev_tag"),
            F.floor(F.col("n") / 4).cast("int").alias("need"),
        )
    )
    given = (
        keyed.join(wanted, ["doc", "tag"])
        .select(
            F.col("prev_doc").alias("doc"),
            F.col("prev_tag").alias("tag"),
            F.substr("text", F.lit(1), F.col("need")).alias("ending"),
        )
        .dropDuplicates(["doc", "tag"])
    )
    n = F.char_length("text")
    edited = F.concat(F.substr("text", F.lit(1), n - F.floor(n / 4).cast("int")), F.col("ending"))
    rows = keyed.join(given, ["doc", "tag"]).select("doc", "tag", "text", edited.alias("edited"))
    texts = rows.dropDuplicates(["doc", "tag"])
    prints = texts.join(_sampled(texts), ["doc", "tag"], "left").select(
        "doc", "tag", *(F.unhex(F.coalesce(fp, signature(F.col(of)))).alias(fp) for fp, of in (("fp", "text"), ("edited_fp", "edited")))
    )
    nothing = F.lit(None).cast("binary")
    own = F.struct("doc", "tag", "fp", "edited_fp", nothing.alias("next_fp"))
    before = F.struct(
        F.col("prev_doc").alias("doc"),
        F.col("prev_tag").alias("tag"),
        nothing.alias("fp"),
        nothing.alias("edited_fp"),
        F.col("fp").alias("next_fp"),
    )
    sent = prints.join(wanted.drop("need"), ["doc", "tag"]).select(F.inline(F.array(own, before)))
    facts = sent.groupBy("doc", "tag").agg(*(F.max(c).alias(c) for c in ("fp", "edited_fp", "next_fp")))
    return rows.join(facts, ["doc", "tag"]).select(
        F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), n.alias("n"), "edited", "fp", "edited_fp", "next_fp"
    )


def _text(fp: Column) -> Column:
    return F.lower(F.hex(fp))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n, edited, fp, edited_fp, near_edited and near_next of every row."""
    signed = edited_pairs(docs).select("doc_id", "n", "edited", *(_text(F.col(c)).alias(c) for c in ("fp", "edited_fp", "next_fp")))
    # Cells are cut first, in a column each: both comparisons share those of fp.
    cut = signed.select("*", *(_cells(F.col(c)).alias(f"{c}_cells") for c in ("fp", "next_fp", "edited_fp")))
    return cut.select(
        "doc_id",
        "n",
        "edited",
        "fp",
        "edited_fp",
        likeness(F.col("fp_cells"), F.col("edited_fp_cells")).alias("near_edited"),
        likeness(F.col("fp_cells"), F.col("next_fp_cells")).alias("near_next"),
    )
