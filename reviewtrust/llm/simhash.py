"""SimHash near-duplicates with pigeonring filtering.

Fingerprints are made once per row; from there on only distinct fingerprints travel, so a
group of exact copies is one item. Two fingerprints link if at most ``DISTANCE`` bits differ.

Pigeonring: the 64 bits are a ring of ``SEGMENTS`` segments. If at most t bits differ in all, some
segment starts a chain in which, for every length l, the first l segments together differ in
at most floor(l * t / segments) bits. For short chains this is 0: the chain's opening must be equal,
so (start, opening bits) is an equi-join key. Pairs that share a key must then meet the budget of every
longer chain from that start before the full Hamming check.

Keys shared by more than ``BUCKET`` fingerprints (many near copies of one text) are not paired at all:
their members go the exact way of ``ball_links``, linear in their number, so no pair is lost.

Null and empty texts have fingerprint zero, linked like any other. A null doc_id is never a component's id
unless all its rows have none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewtrust.llm.common import with_row_key, workspace
from reviewtrust.operators.components import connected_components

SHINGLE = 3
DISTANCE = 2
SEGMENTS = 9
BUCKET = 24
BITS = 64
#: What the pipeline's stage links besides: the Jaccard similarity of sets of so many words.
STAGE_SHINGLE = 5
STAGE_JACCARD = 0.8
#: Bits of a text's sketch.
SKETCH = 1024
#: Shingles are ordered by how often those of their bucket occur.
BUCKETS = 1 << 18


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint, signed. A bit is 1 if it is set in over half of the shingles' hashes, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return int(np.uint64(xxhash.xxh64_intdigest(b" ".join(words), 42)).astype(np.int64))
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    hashes = np.array([digest(joined[a:b], 42) for a, b in spans], dtype="<u8")
    counts = np.zeros(BITS, np.int64)
    for part in range(0, len(hashes), 1 << 16):  # bounded memory, whatever the text's length
        rows = hashes[part : part + (1 << 16)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(rows, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Row key, doc_id and ``fp`` of every row."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame(
                {"doc_id": b["doc_id"], "ka": b["ka"], "kb": b["kb"], "fp": np.array([simhash(t, shingle) for t in b["text"]], np.int64)}
            )

    keyed = with_row_key(docs, ("_ka", "_kb")).select(
        docs["doc_id"].cast("bigint").cast("string").alias("doc_id"), F.col("_ka").alias("ka"), F.col("_kb").alias("kb"), docs["text"]
    )
    # Ids go through Python as strings: pandas would turn a column with a null into floats.
    made = keyed.mapInPandas(scan, "doc_id string, ka bigint, kb bigint, fp bigint")
    return made.withColumn("doc_id", F.col("doc_id").cast("bigint"))


def _ring(segments: int) -> list[tuple[int, int]]:
    """(first bit, width) of each segment."""
    edges = [BITS * i // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _arc(segments: int, start: int, length: int) -> int:
    """Signed mask of the bits of ``length`` segments from ``start`` on, around the ring."""
    ring, mask = _ring(segments), 0
    for k in range(length):
        first, width = ring[(start + k) % segments]
        mask |= ((1 << width) - 1) << first
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _budgets(segments: int, distance: int) -> list[int]:
    return [length * distance // segments for length in range(1, segments + 1)]


def openings(prints: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """A row (start, opening, fp) for each start of a chain; the opening is as long as the budget is 0."""
    free = sum(b == 0 for b in _budgets(segments, distance))
    starts = [
        F.struct(F.lit(s).alias("start"), F.col("fp").bitwiseAND(F.lit(_arc(segments, s, free))).alias("opening"))
        for s in range(segments)
    ]
    return prints.select("fp", F.explode(F.array(*starts)).alias("k")).select("k.start", "k.opening", "fp")


def chain_holds(a: Column, b: Column, start: Column, distance: int = DISTANCE, segments: int = SEGMENTS) -> Column:
    """Every chain from ``start`` stays within its budget; the last one is the full Hamming check."""
    differ, whole = a.bitwiseXOR(b), None
    for s in range(segments):
        holds = F.lit(True)
        for length, budget in enumerate(_budgets(segments, distance), 1):
            if budget > 0:
                holds &= F.bit_count(differ.bitwiseAND(F.lit(_arc(segments, s, length)))) <= budget
        whole = F.when(start == s, holds) if whole is None else whole.when(start == s, holds)
    return whole


def ball_links(prints: DataFrame) -> DataFrame:
    """All links at distance 2 or less, without pairing: fingerprints are that near exactly if the balls of radius 1
    around them meet. A point of a ball belongs to at most 65 fingerprints, all within distance 2 of each other, so
    each one's link to the smallest is enough to connect them."""
    points = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit((1 << b) - ((1 << BITS) if b == BITS - 1 else 0))) for b in range(BITS)))
    met = (
        prints.select("fp", F.explode(points).alias("point"))
        .groupBy("point")
        .agg(F.min("fp").alias("b"), F.max("fp").alias("top"), F.collect_list("fp").alias("all"))
        .where("top > b")
    )
    return met.select(F.explode("all").alias("a"), "b").where("a <> b").distinct()


def links(prints: DataFrame) -> DataFrame:
    """Edges (a, b) between the distinct fingerprints ``prints(fp)`` that join all linked ones."""
    space = workspace(prints.sparkSession, "simhash-links")
    keyed = space.write(openings(prints))
    sizes = keyed.groupBy("start", "opening").agg(F.count("*").alias("n")).where("n > 1")
    shared = space.write(keyed.join(sizes, ["start", "opening"]))
    small = shared.where(F.col("n") <= BUCKET).select("start", "opening", "fp")
    pairs = (
        small.withColumnRenamed("fp", "a")
        .join(small.withColumnRenamed("fp", "b"), ["start", "opening"])
        .where(F.col("a") > F.col("b"))
        .where(chain_holds(F.col("a"), F.col("b"), F.col("start")))
        .select("a", "b")
    )
    crowded = shared.where(F.col("n") > BUCKET).select("fp").distinct()
    return pairs.unionByName(ball_links(crowded)).distinct()


def components(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, row key, ``fp``, ``root`` (a fingerprint that names the component) and ``component_id`` of every row."""
    space = workspace(docs.sparkSession, "simhash")
    rows = space.write(fingerprints(docs, shingle))
    prints = space.write(rows.groupBy("fp").agg(F.min("doc_id").alias("lowest")))
    edges = links(prints.select("fp")).select(F.lit(0).alias("all"), "a", "b")
    found = connected_components(edges, "all").select(F.col("node").alias("fp"), F.col("component").alias("root"))
    rooted = prints.join(found, "fp", "left").select("fp", "lowest", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("lowest").alias("component_id"))
    named = space.write(rooted.join(lowest, "root").select("fp", "root", "component_id"))
    return rows.join(named, "fp")


def _shingle_hashes(text: str, shingle: int = STAGE_SHINGLE) -> np.ndarray:
    """The distinct shingles' hashes, ascending; a text of fewer words is one shingle."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = max(len(words) - shingle + 1, min(len(words), 1))
    joined = (b" ".join(words[i : i + shingle]) for i in range(n))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(x, 7) >> 1 for x in joined), np.int64, n))


def _different_texts(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """id, root and text of every different text, from the rows (ka, kb, root, ta, tb): ids are numbers of a written table."""
    space = workspace(docs.sparkSession, "simhash-texts")
    first = rows.groupBy("ta", "tb").agg(F.min(F.struct("ka", "kb", "root")).alias("r")).select("r.ka", "r.kb", "r.root")
    keyed = with_row_key(docs, ("ka", "kb")).select("ka", "kb", F.coalesce(docs["text"], F.lit("")).alias("text"))
    # A repeated row has its key twice; both are in one task here.
    once = keyed.join(first, ["ka", "kb"]).groupBy("ka", "kb").agg(F.first("root").alias("root"), F.first("text").alias("text"))
    return space.write(once.select(F.monotonically_increasing_id().alias("id"), "root", "text"))


def _bucket_counts(texts: DataFrame) -> np.ndarray:
    """How often the shingles of each bucket occur: BUCKETS numbers come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                np.add.at(counts, _shingle_hashes(text) & (BUCKETS - 1), 1)
        full = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(counts[full], pa.int64())], ["bucket", "n"])

    found = texts.select("text").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(BUCKETS, np.int64)
    counts[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return np.minimum(counts, np.iinfo(np.int32).max).astype(np.int32)


def _prefixes(texts: DataFrame, counts: np.ndarray) -> DataFrame:
    """(element, id, root, n, place) of the first shingles of each text: two texts that reach STAGE_JACCARD share one of them.

    The order is one for all texts: shingles of the least full buckets first, by hash among equals.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                elements, repeats, sizes, places = [], [], [], []
                for text in part.column("text").to_pylist():
                    made = _shingle_hashes(text)
                    n = len(made)
                    made = made[np.argsort(counts[made & (BUCKETS - 1)], kind="stable")]
                    made = made[: n - int(np.ceil(STAGE_JACCARD * n - 1e-9)) + 1] if n else made
                    elements.append(made)
                    repeats.append(len(made))
                    sizes.append(n)
                    places.append(np.arange(len(made), dtype=np.int32))
                ids, roots = (np.repeat(part.column(c).to_numpy(zero_copy_only=False), repeats) for c in ("id", "root"))
                columns = (np.concatenate(elements), ids, roots, np.repeat(np.array(sizes, np.int32), repeats), np.concatenate(places))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["element", "id", "root", "n", "place"])

    return texts.mapInArrow(run, "element bigint, id bigint, root bigint, n int, place int")


def _whole_sets(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = pa.array([_shingle_hashes(x).tolist() for x in batch.column("text").to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("root"), sets], ["id", "root", "elements"])

    return texts.mapInArrow(run, "id bigint, root bigint, elements array<bigint>")


def _sketches(texts: DataFrame) -> DataFrame:
    """(id, n, sketch): for each of SKETCH buckets whether an odd number of the text's shingles falls there.

    A shingle that only one of two texts has turns one bit, so the sketches differ in at most as many bits as the sets do in shingles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, sketches = [], []
            for text in batch.column("text").to_pylist():
                made = _shingle_hashes(text)
                odd = np.bincount((made >> 20) & (SKETCH - 1), minlength=SKETCH) & 1
                sizes.append(len(made))
                sketches.append(np.packbits(odd.astype(np.uint8)).view("<i8").tolist())
            columns = [batch.column("id"), pa.array(sizes, pa.int32()), pa.array(sketches, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "sketch"])

    return texts.select("id", "text").mapInArrow(run, "id bigint, n int, sketch array<bigint>")


def _sketches_allow(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs whose sketches leave room for enough common shingles: all that reach STAGE_JACCARD, and few others."""
    l, r = (sketches.select(*(F.col(c).alias(f"{s}_{c}") for c in ("id", "n", "sketch"))) for s in ("l", "r"))
    differ = sum(
        (F.bit_count(F.get("l_sketch", F.lit(k)).bitwiseXOR(F.get("r_sketch", F.lit(k)))) for k in range(SKETCH // 64)), F.lit(0)
    )
    both = F.col("l_n") + F.col("r_n")
    return pairs.join(l, "l_id").join(r, "r_id").where((both - differ) / 2 * (1 + STAGE_JACCARD) >= (STAGE_JACCARD - 1e-6) * both).select("l_id", "r_id")


def _side(rows: DataFrame, side: str, *more: str) -> DataFrame:
    return rows.select("element", *(F.col(c).alias(f"{side}_{c}") for c in ("id", "root", "n", "place", *more)))


def _may_reach(pairs: DataFrame) -> DataFrame:
    """Distinct pairs of texts whose sizes and places of a common shingle still allow STAGE_JACCARD."""
    possible = F.least(F.col("l_n") - F.col("l_place"), F.col("r_n") - F.col("r_place"))
    return (
        pairs.where(F.least("l_n", "r_n") >= (STAGE_JACCARD - 1e-9) * F.greatest("l_n", "r_n"))
        .where(possible * (1 + STAGE_JACCARD) >= (STAGE_JACCARD - 1e-9) * (F.col("l_n") + F.col("r_n")))
        .select("l_id", "r_id")
        .distinct()
    )


def text_links(texts: DataFrame) -> DataFrame:
    """Edges (a, b) between roots of texts(id, root, text) that join exactly what the links of Jaccard similarity STAGE_JACCARD or
    more in shingles of STAGE_SHINGLE words join: an exact prefix join, then the exact check.

    Shingles that one text alone holds end with the only shuffle of the prefixes. The others' holders are first checked against their
    lowest one; of all other pairs only those are made whose ends then still lie in different components, so a family of near copies
    gives a row a member.
    """
    space = workspace(texts.sparkSession, "simhash-links")
    holders = F.count("*").over(Window.partitionBy("element"))
    prefix = _prefixes(texts, _bucket_counts(texts)).withColumn("holders", holders).where("holders > 1")
    shared = space.write(prefix.drop("holders"))
    sketches = space.write(_sketches(texts))

    def checked(pairs: DataFrame) -> DataFrame:
        # Whole sets travel for what the sketches leave, which is little more than the links.
        pairs = space.write(_sketches_allow(_may_reach(pairs), sketches))
        wanted = pairs.select(F.col("l_id").alias("id")).union(pairs.select("r_id")).distinct()
        sets = space.write(_whole_sets(texts.join(wanted, "id", "left_semi")))
        l, r = (sets.select(*(F.col(c).alias(f"{s}_{c}") for c in ("id", "root", "elements"))) for s in ("l", "r"))
        common = F.size(F.array_intersect("l_elements", "r_elements"))
        near = common >= (STAGE_JACCARD - 1e-9) * (F.size("l_elements") + F.size("r_elements") - common)
        both = pairs.join(l, "l_id").join(r, "r_id").where(near)
        return space.write(both.select(F.greatest("l_root", "r_root").alias("a"), F.least("l_root", "r_root").alias("b")).where("a <> b").distinct())

    fields = ("id", "root", "n", "place")
    low = shared.groupBy("element").agg(F.min(F.struct(*fields)).alias("low")).select("element", *(F.col(f"low.{c}").alias(f"r_{c}") for c in fields))
    stars = checked(_side(shared, "l").join(low, "element").where("l_root <> r_root"))
    found = connected_components(stars.select(F.lit(0).alias("all"), "a", "b"), "all").select(F.col("node").alias("root"), "component")
    held = space.write(shared.join(found, "root", "left").withColumn("component", F.coalesce("component", "root")))
    # Shingles of one component alone, as most of a family's are, make no further pair.
    split = held.groupBy("element").agg(F.min("component").alias("one"), F.max("component").alias("other")).where("one < other")
    open_ = held.join(split.select("element"), "element", "left_semi")
    across = _side(open_, "l", "component").join(_side(open_, "r", "component"), "element").where("l_component < r_component")
    return stars.unionByName(checked(across))


def keep_one(docs: DataFrame) -> DataFrame:
    """The row with the smallest doc_id of each group of near copies (of equal ids, the smallest row key), once.

    Groups are joined by the fingerprints' links and by those of ``text_links``.
    """
    space = workspace(docs.sparkSession, "simhash-stage")
    text = F.coalesce(docs["text"], F.lit(""))
    of_text = with_row_key(docs, ("ka", "kb")).select("ka", "kb", F.xxhash64(F.lit(3), text).alias("ta"), F.xxhash64(F.lit(4), text).alias("tb")).distinct()
    # Equal texts have equal fingerprints, and so one root.
    rows = space.write(components(docs).select("doc_id", "ka", "kb", "root").join(of_text, ["ka", "kb"]))
    edges = text_links(_different_texts(docs, rows)).select(F.lit(0).alias("all"), "a", "b")
    found = connected_components(edges, "all").select(F.col("node").alias("root"), F.col("component").alias("joined"))
    chosen = (
        rows.join(found, "root", "left")
        .groupBy(F.coalesce("joined", "root").alias("group"))
        .agg(F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc"), "ka", "kb")).alias("r"))
        .select(F.col("r.ka").alias("_ka"), F.col("r.kb").alias("_kb"))
    )
    kept = with_row_key(docs, ("_ka", "_kb")).join(chosen, ["_ka", "_kb"], "left_semi")
    once = Window.partitionBy("_ka", "_kb").orderBy("_ka")
    return kept.withColumn("_nth", F.row_number().over(once)).where("_nth = 1").select(*docs.columns)
