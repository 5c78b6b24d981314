"""Line dedup: lines that many documents share stay in one of them only.

Keys of lines travel as 128-bit hashes, range-partitioned by (hash, document) and sorted by
(hash, document, row, position): each partition is a stream in which the first row of every
(hash, document) is a first occurrence. A line that a third of all documents hold therefore
spreads over many ranges. First occurrences are summed to document counts with map-side
combining. What goes back to a document is not text but a run-length coded bitmap: the kept line
ranges. Line texts are never shuffled.

Null texts are empty; a text without lines is one empty line. A null doc_id counts as the lowest
id. Rows that share a doc_id are one document. Identical rows are treated alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewtrust.llm.common import NO_ID, WHITE, text_of, workspace

MIN_CHARS = 40
MIN_DOCUMENTS = 5
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, nothing else. lower() is the same, and faster, where all characters are ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, _UPPER, _UPPER.lower())
    )


def _identified(docs: DataFrame) -> tuple[Column, Column]:
    return F.coalesce(docs["doc_id"].cast("bigint"), F.lit(NO_ID)), F.xxhash64(text_of(docs))


def long_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """A row for every line whose key has ``min_chars`` or more: hashes, document, row tag and position."""
    doc, tag = _identified(docs)
    lines = docs.select(doc.alias("doc"), tag.alias("tag"), F.posexplode(F.split(text_of(docs), "\n")).alias("pos", "line"))
    keyed = lines.where(F.char_length("line") >= min_chars).select(
        "doc", "tag", "pos", ascii_lower(F.btrim(F.col("line"), F.lit(WHITE))).alias("key")
    )
    return keyed.where(F.char_length("key") >= min_chars).select(
        F.xxhash64("key").alias("ha"), F.xxhash64(F.lit(7), F.col("key")).alias("hb"), "doc", "tag", "pos"
    )


def shared_lines(lines: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """Hashes found in ``min_documents`` or more, and the document that keeps the line."""
    ranged = lines.repartitionByRange(F.col("ha"), F.col("hb"), F.col("doc"))
    stream = Window.partitionBy("ha", "hb", "doc").orderBy("tag", "pos")
    first = ranged.withColumn("nth", F.row_number().over(stream)).where("nth = 1")
    return (
        first.groupBy("ha", "hb")
        .agg(F.count("*").alias("documents"), F.max("doc").alias("keeper"))
        .where(F.col("documents") >= min_documents)
    )


def _kept_runs(dropped: Column) -> Column:
    """Sorted dropped positions to the kept ranges [from, to) between them; the last is open (to null)."""
    after = F.concat(F.array(F.lit(0)), F.transform(dropped, lambda p: p + 1))
    before = F.concat(dropped, F.array(F.lit(None).cast("int")))
    ranges = F.zip_with(after, before, lambda a, b: F.struct(a.alias("from"), b.alias("to")))
    return F.filter(ranges, lambda r: F.isnull(r["to"]) | (r["to"] > r["from"]))


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """For every row that loses lines: doc, tag, n_dropped and ``keep``, its bitmap as kept ranges of lines."""
    space = workspace(docs.sparkSession, "line-dedup")
    lines = space.write(long_lines(docs, min_chars))
    shared = space.write(shared_lines(lines, min_documents))
    dropped = lines.join(shared, ["ha", "hb"]).where("doc <> keeper").select("doc", "tag", "pos")
    return dropped.groupBy("doc", "tag").agg(
        F.sort_array(F.collect_set("pos")).alias("dropped")
    ).select(
        "doc", "tag", F.size("dropped").cast("bigint").alias("n_dropped"), _kept_runs(F.col("dropped")).alias("keep")
    )


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs with ``_kept`` (the text of the kept lines, null only where the text is and stays so), ``_n_lines``
    and ``_n_dropped``."""
    doc, tag = _identified(docs)
    marked = docs.select("*", doc.alias("_doc"), tag.alias("_tag"))
    maps = bitmaps.select(
        F.col("doc").alias("_doc"), F.col("tag").alias("_tag"), F.col("n_dropped").alias("_n_dropped"), F.col("keep").alias("_keep")
    )
    joined = marked.join(maps, ["_doc", "_tag"], "left")
    lines = F.split(docs["text"], "\n")
    kept = F.array_join(
        F.flatten(
            F.transform(
                F.col("_keep"),
                lambda r: F.slice(lines, r["from"] + 1, F.coalesce(r["to"], F.size(lines)) - r["from"]),
            )
        ),
        "\n",
    )
    text = text_of(docs)
    n_lines = F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return joined.select(
        *(joined[c] for c in docs.columns),
        F.when(F.isnull("_keep"), docs["text"]).otherwise(kept).alias("_kept"),
        n_lines.cast("bigint").alias("_n_lines"),
        F.coalesce("_n_dropped", F.lit(0)).cast("bigint").alias("_n_dropped"),
    )


def drop_shared_lines(docs: DataFrame) -> DataFrame:
    """docs with the kept text; ``n_chars``, where it is a whole number, follows the text."""
    done = apply_bitmaps(docs, keep_bitmaps(docs))
    changed = {"text": F.col("_kept")}
    if "n_chars" in docs.columns and isinstance(docs.schema["n_chars"].dataType, T.IntegralType):
        changed["n_chars"] = (
            F.when(F.col("_n_dropped") > 0, F.char_length("_kept")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
        )
    return done.select(*(changed.get(c, done[c]).alias(c) for c in docs.columns))
