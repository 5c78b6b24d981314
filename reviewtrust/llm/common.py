"""Helpers shared by the corpus operators.

Input tables may have extra columns of any name and nulls in any column, and may repeat rows. The
operators therefore read only the columns they need, and address a row by two hashes of what
they read (``with_row_key``), never by ``doc_id`` alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewtrust.session import Workspace

WORD = r"[^\x20\x09-\x0D]+"
WHITE = " \t\n\x0b\x0c\r"
#: What a null document id counts as where ids are ordered or compared: before all others.
NO_ID = -(2**63)


def read(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_of(docs: DataFrame) -> Column:
    """The text, null as the empty one."""
    return F.coalesce(docs["text"], F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with value computed once a row, also inside lambdas of the body."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _hash(seed: int, *columns: Column) -> Column:
    parts = [p for c in columns for p in (F.isnull(c), c)]
    return F.xxhash64(F.lit(seed), *parts)


def row_key(*columns: Column) -> list[Column]:
    """128 bits of the columns' values, never null; equal rows have equal keys."""
    return [_hash(1, *columns), _hash(2, *columns)]


def with_row_key(docs: DataFrame, names: tuple[str, str] = ("_key_a", "_key_b")) -> DataFrame:
    a, b = row_key(docs["doc_id"], docs["text"], docs["lang"], docs["source"])
    return docs.select("*", a.alias(names[0]), b.alias(names[1]))


#: A key is hot if it holds at least this part of all rows: at most so many keys can.
HOT_KEYS = 1024


def mark_hot(sizes: DataFrame) -> DataFrame:
    """sizes(keys..., n), one row a key, with ``hot`` for n. One number, the sum, comes to the driver."""
    total = sizes.agg(F.sum("n")).first()[0] or 0
    return sizes.withColumn("hot", F.col("n") * HOT_KEYS >= total).drop("n")


def join_hot(rows: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """Inner equi-join of rows to facts, few for each key, that carry the ``hot`` of ``mark_hot``.

    Hot keys meet their facts by broadcast, which is bounded by ``HOT_KEYS``; the others meet in a shuffle, where none of them
    is large. Both tables are read twice and should be written ones.
    """
    heavy = F.broadcast(facts.where("hot").drop("hot"))
    light = facts.where("not hot").drop("hot")
    others = rows.join(heavy.select(*keys), keys, "left_anti")
    return rows.join(heavy, keys).unionByName(others.join(light, keys))


def workspace(spark: SparkSession, label: str) -> Workspace:
    """Tables in the cluster's shared folder: they survive a lost executor and cut lineage."""
    return Workspace(spark, label)
