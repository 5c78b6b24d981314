"""Mixing sources to target weights by blocks, shards and index permutations.

The words of each source, documents in order of id, are packed into blocks of ``BLOCK`` words. The mix is a
row of slots cut into output shards. Each shard's source counts are a multinomial draw given the totals of
the whole mix (a pseudorandom permutation deals the sources' quotas to the slots), so that the
quotas hold exactly. The k-th slot of a source takes the block at k in a pseudorandom permutation
of the source's block indexes, a new permutation for each pass; a source's quota is at most twice
its blocks, so no block is taken more than twice. Blocks are joined to slots by (source, index).

The permutations are swap-or-not shuffles: computed for one index at a time, on any number of indexes, invertible,
the same on every run. Nothing is sorted by a random key.

Scale: offsets of documents in their source come from a range partitioning and partial sums, so a source that holds a
third of all rows is spread over many tasks. Slots are dealt in chunks. Only the table of sources, one
row each, passes through a single task.

Null texts have size 0, a null source is a source of its own, after all others. Repeated rows are separate documents.
Rows of size 0 take nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewtrust.llm.common import WORD, let, text_of, with_row_key, workspace

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_PASSES = 2
BLOCK = 64
SHARD_SLOTS = 4096
CHUNK = 8192
ROUNDS = 16


def permuted(index: Column, size: Column, key: Column, inverse: bool = False) -> Column:
    """Swap-or-not: a pseudorandom permutation of 0..size-1, chosen by ``key``. Every round is its own inverse."""
    rounds = [F.lit(r) for r in (reversed(range(ROUNDS)) if inverse else range(ROUNDS))]

    def step(x: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(key, r), size) + size - x, size)
        return let(
            partner,
            lambda y: F.when(F.pmod(F.xxhash64(r, key, F.greatest(x, y)), F.lit(2)) == 1, y).otherwise(x),
        )

    return F.aggregate(F.array(*rounds), index.cast("bigint"), step)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """source, sid (rank by code point, null last), source_size and target, from rows (source, size).

    Targets are level * weight, cut at ``MOST_PASSES`` times the source's size, with the level at which they add up to
    ``share`` of all sizes: sharing the excess again by weight until no target is above its limit ends there too.
    """
    order = F.col("source").asc_nulls_last()
    ranked = (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("sid", F.row_number().over(Window.orderBy(order)) - 1)
        .withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.col("sid") % len(weights) + 1))
        .withColumn("limit", F.col("source_size") * float(MOST_PASSES))
        .withColumn("fill", F.col("limit") / F.col("weight"))
    )
    by_fill = Window.orderBy("fill", "sid")
    before, after = by_fill.rowsBetween(Window.unboundedPreceding, -1), by_fill.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    levels = ranked.withColumn(
        "level",
        (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        / F.sum("weight").over(after),
    )
    level = F.min(F.when(F.col("level") <= F.col("fill"), F.struct("fill", "sid", "level"))).over(everything)["level"]
    return levels.withColumn("found", level).select(
        "source",
        "sid",
        F.col("source_size").cast("bigint").alias("source_size"),
        F.least(F.col("limit"), F.coalesce("found", F.lit(0.0)) * F.col("weight")).alias("target"),
    )


def quotas(targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """Adds blocks, slots (the quota) and base (the slots of sources before)."""
    size = F.col("source_size")
    counted = targets.withColumn("blocks", F.ceil(size / block).cast("bigint")).withColumn(
        "slots",
        F.when(size > 0, F.least(F.round(F.col("target") * F.col("blocks") / size).cast("bigint"), F.col("blocks") * MOST_PASSES))
        .otherwise(F.lit(0))
        .cast("bigint"),
    )
    return counted.withColumn("base", F.sum("slots").over(Window.orderBy("sid")) - F.col("slots")).withColumn(
        "all_slots", F.sum("slots").over(Window.partitionBy(F.lit(0)))
    )


def shard_plan(sources: DataFrame, seed: int = 0) -> DataFrame:
    """A row (shard, slot, sid, block) for every slot of the mix."""
    chunks = sources.where("slots > 0").select(
        "sid", "blocks", "slots", "base", "all_slots",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("slots") - 1) / CHUNK))).alias("chunk"),
    )
    # A fixed number: by the size of the chunk table alone Spark would deal them to a few tasks.
    tasks = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = chunks.repartition(tasks, "sid", "chunk")
    first = F.col("chunk") * CHUNK
    ks = dealt.select(
        "sid", "blocks", "base", "all_slots",
        F.explode(F.sequence(first, F.least(first + CHUNK, F.col("slots")) - 1)).alias("k"),
    )
    blocks, k = F.col("blocks"), F.col("k")
    one_pass = F.xxhash64(F.lit(seed), F.col("sid"), F.floor(k / blocks))
    return ks.select(
        "sid",
        permuted(k % blocks, blocks, one_pass).alias("block"),
        permuted(F.col("base") + k, F.col("all_slots"), F.xxhash64(F.lit(seed), F.lit("slots")), inverse=True).alias("slot"),
    ).select(F.floor(F.col("slot") / SHARD_SLOTS).alias("shard"), "slot", "sid", "block")


def placed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with their word offset in their source, and the sources with targets."""
    space = workspace(docs.sparkSession, "mixing")
    keyed = with_row_key(docs, ("_ka", "_kb"))
    sized = keyed.select(
        "doc_id",
        F.col("_ka").alias("ka"),
        F.col("_kb").alias("kb"),
        docs["source"].cast("string").alias("source"),
        F.size(F.regexp_extract_all(text_of(docs), F.lit(WORD), F.lit(0))).cast("bigint").alias("size"),
    )
    # Range partitioning samples its input first, which would count all words twice.
    counted = space.write(sized)
    ranged = space.write(
        counted.repartitionByRange(F.col("source").asc_nulls_last(), "doc_id", "ka", "kb").withColumn("part", F.spark_partition_id())
    )
    sources = space.write(quotas(source_targets(ranged)))
    parts = ranged.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    ahead = Window.partitionBy("source").orderBy("part")
    starts = parts.select(
        F.col("source").alias("_source"), F.col("part").alias("_part"), (F.sum("part_size").over(ahead) - F.col("part_size")).alias("start")
    )
    inside = Window.partitionBy("source", "part").orderBy("doc_id", "ka", "kb").rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.withColumn("upto", F.sum("size").over(inside))
    rows = (
        summed.join(starts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("part") == F.col("_part")))
        .select("doc_id", "ka", "kb", "source", "size", (F.col("start") + F.col("upto") - F.col("size")).alias("first"))
        .alias("r")
        .join(
            sources.select(F.col("source").alias("_source"), "sid", "source_size", "target"),
            F.col("source").eqNullSafe(F.col("_source")),
        )
        .drop("_source")
    )
    return space.write(rows), sources


def mix(docs: DataFrame, seed: int = 0) -> DataFrame:
    """Every row with size, source_size, target and ``taken``, the words of it that the mix holds."""
    rows, sources = placed(docs)
    # Spark's size estimates do not see that slots are generated from a few rows; without the hints it would broadcast.
    uses = shard_plan(sources, seed).groupBy("sid", "block").agg(F.count("*").alias("uses")).hint("merge")
    last = F.col("first") + F.col("size")
    pieces = rows.where("size > 0").select(
        "sid", "first", "size", F.explode(F.sequence(F.floor(F.col("first") / BLOCK), F.floor((last - 1) / BLOCK))).alias("block")
    )
    overlap = F.least(last, (F.col("block") + 1) * BLOCK) - F.greatest(F.col("first"), F.col("block") * BLOCK)
    taken = (
        pieces.join(uses, ["sid", "block"])
        .groupBy("sid", "first")
        .agg(F.sum(F.col("uses") * overlap).alias("words"))
        .select(F.col("sid").alias("_sid"), F.col("first").alias("_first"), "words")
        .hint("merge")
    )
    joined = rows.join(
        taken, (F.col("sid") == F.col("_sid")) & (F.col("first") == F.col("_first")) & (F.col("size") > 0), "left"
    )
    return joined.select(
        "doc_id", "ka", "kb", "source", "size", "source_size", "target", F.coalesce("words", F.lit(0)).cast("bigint").alias("taken")
    )


def mixed_documents(docs: DataFrame, seed: int = 0) -> DataFrame:
    """docs with every row as often as the mix takes its words: taken / size times, the fraction rounded up or down
    by a pseudorandom draw, so that sources keep their targets. Identical rows share one number of copies."""
    draw = F.pmod(F.xxhash64(F.lit(seed), F.lit("copies"), "ka", "kb"), F.lit(2**32)) / float(2**32)
    copies = (
        mix(docs, seed)
        .where("size > 0")
        .groupBy("ka", "kb")
        .agg((F.sum("taken") / F.sum("size")).alias("times"))
        .select(F.col("ka").alias("_ka"), F.col("kb").alias("_kb"), F.floor(F.col("times") + draw).cast("int").alias("_copies"))
        .where("_copies > 0")
    )
    joined = with_row_key(docs, ("_ka", "_kb")).join(copies, ["_ka", "_kb"])
    return joined.select(
        *(joined[c] for c in docs.columns), F.explode(F.array_repeat(F.lit(0), F.col("_copies"))).alias("_copy")
    ).select(*docs.columns)
