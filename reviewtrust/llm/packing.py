"""Packing documents into windows of tokens, best fit decreasing.

Documents are encoded where they are read, an end id is appended, and longer ones are cut into full windows and a rest. The pieces are
written once with their ids; only narrow rows go on. They are dealt by hash to shards of about ``SHARD`` pieces, so that a shard fits one
task at any size of the input, and each shard is packed on its own in descending order of length: a segment
tree over the room that open windows have left finds the tightest window a piece fits, else a new one is opened.

A null or empty text has its end id only. Repeated rows are documents of their own (and share their doc_id); a null doc_id stays null.
An empty table gives no rows; other columns are not read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewtrust.llm.chunks import worker_encoder
from reviewtrust.llm.common import text_of, workspace

WINDOW = 2048
#: Pieces a shard has about.
SHARD = 100_000
#: Windows are numbered within their shard below this.
PER_SHARD = 1 << 32

PIECE_SCHEMA = "doc_id bigint, start bigint, length int, doc_tokens bigint, ids binary"


class OpenWindows:
    """Open windows by the room they have left, from 1 to ``size``; a tree above tells which rooms are to be had."""

    def __init__(self, size: int):
        self._leaves = 1 << size.bit_length()
        self._open = bytearray(2 * self._leaves)
        self._windows: list[list[int]] = [[] for _ in range(size + 1)]

    def put(self, window: int, room: int) -> None:
        if not room:
            return
        self._windows[room].append(window)
        node = self._leaves + room
        while node and not self._open[node]:
            self._open[node] = 1
            node >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """The window with the least room of ``length`` or more, and that room."""
        node = self._leaves + length
        while not self._open[node]:
            while node & 1:  # nothing to the right under this parent
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self._leaves:
            node = 2 * node if self._open[2 * node] else 2 * node + 1
        room = node - self._leaves
        window = self._windows[room].pop()
        if not self._windows[room]:
            self._open[node] = 0
            while node > 1 and not (self._open[node] or self._open[node ^ 1]):
                node >>= 1
                self._open[node] = 0
        return window, room


class Packer:
    """``place(length)`` gives the window and the offset of each piece; lengths must not rise."""

    def __init__(self, size: int):
        self._size, self._free, self._next = size, OpenWindows(size), 0

    def place(self, length: int) -> tuple[int, int]:
        found = self._free.take(length)
        if found is None:
            found = self._next, self._size
            self._next += 1
        window, room = found
        self._free.put(window, room - length)
        return window, self._size - room


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = 1) -> DataFrame:
    """The documents' ids (little-endian, 32 bits) in pieces of at most ``window``; ``tokenizer`` is a file's content."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer, False)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part, rows = batch.slice(at, 1000), []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    coded = encoder.encode(text) + end
                    n = len(coded) // 4
                    for a in range(0, n, window):
                        piece = coded[4 * a : 4 * (a + window)]
                        rows.append((doc_id, a, len(piece) // 4, n, piece))
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    names = [c.split()[0] for c in PIECE_SCHEMA.split(", ")]
    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), text_of(docs).alias("text"))
    return rows.mapInArrow(run, PIECE_SCHEMA)


def places(made: DataFrame, count: int, window: int = WINDOW, shard: int = SHARD) -> DataFrame:
    """made(piece, length, ...), ``count`` rows, with the ``sequence_id`` and ``offset`` of each."""
    shards = max(1, -(-count // shard))
    fields = [f for f in made.schema.fields if f.name not in ("shard", "length")]
    kept = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, current = None, None
        for batch in batches:
            found = []
            for of, length in zip(batch.column("shard").to_pylist(), batch.column("length").to_pylist(), strict=True):
                if of != current:
                    packer, current = Packer(window), of
                number, offset = packer.place(length)
                found.append((of * PER_SHARD + number, offset))
            sequence, offset = np.array(found, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), batch.column("length"), pa.array(sequence), pa.array(offset)],
                [*kept, "length", "sequence_id", "offset"],
            )

    dealt = made.withColumn("shard", F.pmod(F.xxhash64("piece"), F.lit(shards))).repartition(shards, "shard")
    ordered = dealt.sortWithinPartitions("shard", F.desc("length"), "piece")
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields) + "length int, sequence_id bigint, offset bigint"
    return ordered.mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = 1, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """(placed, made): every piece with its place and the checksum of its ids; the written pieces with their ids, by ``piece``."""
    space = workspace(docs.sparkSession, "packing")
    coded = pieces(docs, tokenizer, window, end_id)
    # Numbers of rows stand once they are written.
    made = space.write(coded.select("*", F.crc32("ids").alias("ids_crc32"), F.monotonically_increasing_id().alias("piece")))
    narrow = made.select("piece", "doc_id", "start", "length", "doc_tokens", "ids_crc32")
    return places(narrow, made.count(), window, shard), made


def sequences(placed: DataFrame, made: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """sequence_id, n_tokens and the ``ids`` of every window, padded to its size, except at a power of two."""
    one = placed.select("piece", "sequence_id", "offset").join(made.select("piece", "length", "ids"), "piece")
    joined = one.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids")))).alias("parts")
    )
    pad = np.array([pad_id], "<u4").tobytes().hex()
    missing = F.when(F.bit_count("n_tokens") == 1, 0).otherwise(window - F.col("n_tokens")).cast("int")
    ids = F.unhex(F.concat(F.array_join("parts.ids", ""), F.repeat(F.lit(pad), missing)))
    return joined.select("sequence_id", "n_tokens", ids.alias("ids"))
