"""Token ids in files compressed by Re-Pair grammars.

Documents are range-partitioned and sorted by doc_id; every partition is a shard, written as blocks
of whole documents with about ``BLOCK_IDS`` ids each, a row of a Parquet table. A block's ids are compressed by a
grammar: frequent neighbours become nonterminals, round after round, each round replacing the most frequent
pairs that have no symbol in common. The row holds the rules, every rule's expansion length, the
final sequence and the documents' lengths, so a document can be decoded alone: the cumulated
expansion lengths tell which symbols cover its ids.

Memory is bounded by a block (a longer document is a block of its own). Null and empty texts have the end id
only. Rows of one doc_id follow each other in order of their texts; a null doc_id comes first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewtrust.llm.chunks import worker_encoder
from reviewtrust.llm.common import text_of

BLOCK_IDS = 1 << 20
ROUNDS = 6
#: A pair is worth a rule from so many occurrences on.
MIN_PAIRS = 12
#: Symbols, nonterminals included, fit 16 bits.
SYMBOLS = 1 << 16

BLOCK_SCHEMA = (
    "shard int, block int, n_ids bigint, first_rule int, rules binary, lengths binary, sequence binary, "
    "doc_ids array<bigint>, doc_lengths array<bigint>"
)


def _frequent_pairs(seq: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Most frequent neighbours, at most ``limit``, no symbol in two of them."""
    # A pair of 16-bit symbols is one 32-bit number: sorting them is cheap.
    keys = np.sort(seq[:-1].astype(np.uint32) * np.uint32(SYMBOLS) + seq[1:].astype(np.uint32))
    starts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1))
    counts = np.diff(starts, append=len(keys))
    often = counts >= MIN_PAIRS
    pairs, counts = keys[starts[often]], counts[often]
    chosen, used = [], set()
    for k in np.lexsort((pairs, -counts)):
        if len(chosen) == limit:
            break
        a, b = divmod(int(pairs[k]), SYMBOLS)
        if a not in used and b not in used:
            used.update((a, b))
            chosen.append((a, b))
    return chosen


def compress(ids: np.ndarray, first_rule: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids to (sequence, rules, expansion lengths). Rule k is nonterminal ``first_rule`` + k and made of two symbols."""
    seq, rules = ids.astype(np.int32), []
    lengths = np.ones(SYMBOLS, np.int64)
    for _ in range(ROUNDS):
        pairs = _frequent_pairs(seq, SYMBOLS - first_rule - len(rules)) if len(seq) > 1 else []
        if not pairs:
            break
        partner, name = np.full(SYMBOLS, -1, np.int32), np.zeros(SYMBOLS, np.int32)
        for a, b in pairs:
            partner[a], name[a] = b, first_rule + len(rules)
            lengths[name[a]] = lengths[a] + lengths[b]
            rules.append((a, b))
        hit = partner[seq[:-1]] == seq[1:]
        # In a run of one symbol every second place is taken, counted from the run's start.
        twins = np.flatnonzero(hit & (seq[:-1] == seq[1:]))
        if len(twins):
            starts = np.concatenate(([True], np.diff(twins) > 1))
            run = np.maximum.accumulate(np.where(starts, np.arange(len(twins)), 0))
            hit[twins[(np.arange(len(twins)) - run) % 2 == 1]] = False
        at = np.flatnonzero(hit)
        seq = seq.copy()
        seq[at] = name[seq[at]]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq = seq[keep]
    made = np.array(rules, "<u2").reshape(-1, 2)
    return seq.astype("<u2"), made, lengths[first_rule : first_rule + len(rules)].astype("<u4")


def expand(seq: np.ndarray, rules: np.ndarray, first_rule: int) -> np.ndarray:
    """Symbols back to ids, rules undone from the newest on."""
    left, right = np.full(SYMBOLS, -1, np.int32), np.zeros(SYMBOLS, np.int32)
    left[first_rule : first_rule + len(rules)], right[first_rule : first_rule + len(rules)] = rules[:, 0], rules[:, 1]
    seq = seq.astype(np.int32)
    while (seq >= first_rule).any():
        double = seq >= first_rule
        at = np.arange(len(seq)) + np.concatenate(([0], np.cumsum(double)[:-1]))
        out = np.empty(len(seq) + int(double.sum()), np.int32)
        out[at] = np.where(double, left[seq], seq)
        out[at[double] + 1] = right[seq[double]]
        seq = out
    return seq


def expand_range(seq: np.ndarray, rules: np.ndarray, lengths: np.ndarray, first_rule: int, start: int, end: int) -> np.ndarray:
    """ids start..end of a block without expanding the rest."""
    every = np.ones(SYMBOLS, np.int64)
    every[first_rule : first_rule + len(lengths)] = lengths
    upto = np.cumsum(every[seq])
    a, b = np.searchsorted(upto, start, "right"), np.searchsorted(upto, end, "left") + 1
    before = int(upto[a - 1]) if a else 0
    return expand(seq[a:b], rules, first_rule)[start - before : end - before]


def encode_blocks(docs: DataFrame, tokenizer: str, vocabulary: int, end_id: int = 2, block_ids: int = BLOCK_IDS) -> DataFrame:
    """The rows of the file table. ``vocabulary``: ids are below it."""

    def block(shard: int, number: int, doc_ids: list, parts: list[bytes]) -> pa.RecordBatch:
        ids = np.frombuffer(b"".join(parts), "<u4")
        seq, rules, lengths = compress(ids, vocabulary)
        row = [
            [shard], [number], [len(ids)], [vocabulary], [rules.tobytes()], [lengths.tobytes()], [seq.tobytes()],
            [doc_ids], [[len(p) // 4 for p in parts]],
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, types, strict=True)], names)

    names = [c.split()[0] for c in BLOCK_SCHEMA.split(", ")]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer, False)
        doc_ids, parts, held, number, shard = [], [], 0, 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                shard = part.column(2)[0].as_py()
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    coded = encoder.encode(text) + end
                    if parts and held + len(coded) // 4 > block_ids:
                        yield block(shard, number, doc_ids, parts)
                        doc_ids, parts, held, number = [], [], 0, number + 1
                    doc_ids.append(doc_id)
                    parts.append(coded)
                    held += len(coded) // 4
        if parts:
            yield block(shard, number, doc_ids, parts)

    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), text_of(docs).alias("text"))
    ranged = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return ranged.withColumn("shard", F.spark_partition_id()).mapInArrow(run, BLOCK_SCHEMA)


def decode_blocks(blocks: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ``ids`` (little-endian, 32 bits) of every document."""
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("shard_ids"))  # one row a shard
    ahead = Window.orderBy("shard")
    starts = shards.select(F.col("shard").alias("_shard"), (F.sum("shard_ids").over(ahead) - F.col("shard_ids")).alias("shard_start"))
    inside = Window.partitionBy("shard").orderBy("block")
    places = (
        blocks.select("shard", "block", "n_ids")
        .withColumn("upto", F.sum("n_ids").over(inside))
        .join(starts, F.col("shard") == F.col("_shard"))
        .select(F.col("shard"), F.col("block"), (F.col("shard_start") + F.col("upto") - F.col("n_ids")).alias("start"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                start, first_rule, rules, sequence, doc_ids, lengths = (batch.column(c)[row].as_py() for c in range(6))
                ids = expand(np.frombuffer(sequence, "<u2"), np.frombuffer(rules, "<u2").reshape(-1, 2), first_rule)
                ends = np.cumsum(lengths)
                ids, cuts = ids.astype("<u4"), (ends - lengths).tolist()
                coded = [ids[a:b].tobytes() for a, b in zip(cuts, ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc_ids, pa.int64()), pa.array([start + a for a in cuts], pa.int64()),
                        pa.array(lengths, pa.int64()), pa.array(coded, pa.binary()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    columns = ["start", "first_rule", "rules", "sequence", "doc_ids", "doc_lengths"]
    return blocks.join(places, ["shard", "block"]).select(*columns).mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids binary")
