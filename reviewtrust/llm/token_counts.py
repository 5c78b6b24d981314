"""Token counts through a digest cache.

The cache is a Parquet table (content, tokenizer, n_tokens) in a folder that all machines share. Texts are joined to it
by SHA-256 of their normalised content (null as empty; nothing else may change, since counts depend on every
character) and of the tokenizer's file and library version. Only distinct misses are encoded, one
representative row for each digest, and appended to the cache.

Scale: digests are narrow; texts are shuffled once, by document, to reach the representatives. Digests are counted with map-side
combining before anything is joined to them; counts return to the rows by an equi-join on the digest, in which texts with
very many copies are joined by a broadcast of bounded size. Two runs that append at the same time may both store a digest;
readers take one of the equal counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewtrust.llm.chunks import worker_encoder
from reviewtrust.llm.common import NO_ID, join_hot, mark_hot, text_of, workspace

CACHE_SCHEMA = "content binary, tokenizer string, n_tokens bigint"


def tokenizer_digest(content: str) -> str:
    import tokenizers

    return hashlib.sha256(f"{tokenizers.__version__}\n{content}".encode()).hexdigest()


def _encoded(misses: DataFrame, content: str) -> DataFrame:
    """content digest and n_tokens of rows (content, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(content, True)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                counts = [len(encoder.encode(t)) // 4 for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64())], ["content", "n_tokens"])

    return misses.select("content", "text").mapInArrow(run, "content binary, n_tokens bigint")


def _cache(docs: DataFrame, folder: str) -> DataFrame:
    spark = docs.sparkSession
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(folder)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)


def token_counts(docs: DataFrame, tokenizer: str, folder: str) -> DataFrame:
    """doc_id, n_bytes and n_tokens of every row; ``tokenizer`` is a tokenizer file's content, ``folder`` the cache."""
    spark, version = docs.sparkSession, tokenizer_digest(tokenizer)
    text = text_of(docs)
    keyed = docs.select(
        docs["doc_id"].cast("bigint").alias("doc_id"),
        F.coalesce(docs["doc_id"].cast("bigint"), F.lit(NO_ID)).alias("doc"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("content"),
        text.alias("text"),
    )
    space = workspace(spark, "token-counts")
    rows = space.write(keyed.select("doc_id", "doc", "content", F.octet_length("text").cast("bigint").alias("n_bytes")))
    known = _cache(docs, folder).where(F.col("tokenizer") == version).select("content")
    digests = space.write(rows.groupBy("content").agg(F.min("doc").alias("doc"), F.count("*").alias("n")))
    wanted = space.write(digests.join(known, "content", "left_anti").select("content", "doc"))
    # A repeated row gives its digest twice here: the least of the equal counts is stored.
    misses = keyed.select("doc", "content", "text").join(wanted, ["doc", "content"])
    fresh = _encoded(misses, tokenizer).groupBy("content").agg(F.min("n_tokens").alias("n_tokens"))
    fresh.select("content", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(folder)
    counts = (
        _cache(docs, folder).where(F.col("tokenizer") == version).groupBy("content").agg(F.min("n_tokens").alias("n_tokens"))
    )
    facts = space.write(counts.join(mark_hot(digests.select("content", "n")), "content"))
    return join_hot(rows, facts, ["content"]).select("doc_id", "n_bytes", "n_tokens")
