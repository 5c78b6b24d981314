"""Byte-level BPE encoding and decoding by a sentencepiece model made from the rank file.

Each byte is mapped to one printable character; a rank file's token becomes a piece of such characters with its
negative rank as score, under identity normalisation. Sentencepiece merges the best-scored neighbours first,
which are the lowest ranks. Pre-tokens (matches of the split pattern) are encoded one by one and
remembered; decoding maps ids to pieces and the pieces' characters back to bytes.

Null and empty texts have no ids. Very long texts are encoded in pieces at places that no pre-token crosses, so
whole texts are always encoded.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from reviewtrust.llm.chunks import ChunkEncoder
from reviewtrust.llm.common import text_of


def byte_characters() -> list[str]:
    """The character of each byte: itself if printable Latin-1, else the next one from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """The serialised model: piece i is the token of rank i; an unknown piece, never met, comes last."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    characters, model = byte_characters(), pb.ModelProto()
    for place, (token, rank) in enumerate(sorted(ranks.items(), key=lambda x: x[1])):
        if place != rank:
            raise ValueError("ranks must run from 0 without gaps")
        piece = model.pieces.add()
        piece.piece, piece.score, piece.type = "".join(characters[b] for b in token), -float(rank), pb.ModelProto.SentencePiece.NORMAL
    unknown = model.pieces.add()
    unknown.piece, unknown.score, unknown.type = "<unk>", 0.0, pb.ModelProto.SentencePiece.UNKNOWN
    model.trainer_spec.model_type = pb.TrainerSpec.BPE
    model.trainer_spec.vocab_size = len(model.pieces)
    model.trainer_spec.unk_id, model.trainer_spec.bos_id, model.trainer_spec.eos_id = len(ranks), -1, -1
    model.normalizer_spec.name = "identity"
    model.normalizer_spec.add_dummy_prefix = False
    model.normalizer_spec.remove_extra_whitespaces = False
    model.normalizer_spec.escape_whitespaces = False
    return model.SerializeToString()


def _processor(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def pretoken_library(model: bytes, pattern: str) -> Callable[[list[str]], list[bytes]]:
    """Encodes strings pre-token by pre-token."""
    import regex

    find, processor = regex.compile(pattern).findall, _processor(model)
    to_characters = {b: c for b, c in enumerate(byte_characters())}

    def encode(texts: list[str]) -> list[bytes]:
        split = [find(t) for t in texts]
        mapped = [p.encode("utf-8", "surrogatepass").decode("latin-1").translate(to_characters) for pieces in split for p in pieces]
        ids = iter(processor.encode(mapped, num_threads=1) if mapped else [])
        return [b"".join([np.array(next(ids), "<u4").tobytes() for _ in pieces]) for pieces in split]

    return encode


_KEPT: dict[tuple, object] = {}


def _kept(kind: str, model: bytes, make: Callable[[], object]):
    """One object for each Python worker, kept over its tasks."""
    key = (kind, len(model), hash(model))
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def encode(docs: DataFrame, model: bytes, pattern: str) -> DataFrame:
    """Every row's doc_id and ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _kept("encode", model, lambda: ChunkEncoder(pretoken_library(model, pattern), spaces=True))
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                coded = [encoder.encode(t) for t in part.column(1).to_pylist()]
                offsets = np.concatenate(([0], np.cumsum([len(c) // 4 for c in coded]))).astype(np.int32)
                ids = np.frombuffer(b"".join(coded), "<u4").astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], ["doc_id", "ids"]
                )

    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), text_of(docs).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, model: bytes) -> DataFrame:
    """Adds ``decoded``, the bytes of rows (doc_id, ids)."""

    def table() -> list[bytes]:
        processor = _processor(model)
        back = {c: b for b, c in enumerate(byte_characters())}
        return [bytes(back[c] for c in processor.id_to_piece(i)) for i in range(processor.get_piece_size() - 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = _kept("decode", model, table)
        for batch in batches:
            ids = batch.column(1)
            offsets, values = ids.offsets.to_pylist(), ids.values.to_numpy(zero_copy_only=False)
            decoded = [
                b"".join(map(token.__getitem__, values[a:b].tolist())) for a, b in zip(offsets, offsets[1:], strict=False)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), ids, pa.array(decoded, pa.binary())], ["doc_id", "ids", "decoded"]
            )

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, ids array<int>, decoded binary")
