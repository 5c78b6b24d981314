"""Readers for the input tables, and the review-shaped views derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Short buyer texts, one per label row, that exercise the lexicon rules.
BUYER_TEXTS = [
    "Great product, highly recommend! Amazing quality, love it.",
    "Excellent product and fast shipping, would buy again.",
    "Battery died after 3 weeks, returned it for a refund.",
    "Outstanding quality plus rapid shipping, five stars.",
    "Works great so far; paid $278 and it lasts 30 hours.",
    "Exceptional item",
    "Excellent quality and fast shipping, would buy again.",
    "Good value, although the strap broke after 2 months of daily use.",
    "Love this! Perfect, beautiful, best purchase ever.",
]
BUYER_OFFSET = 1_000_000_000


# Tables whose rows cost far more to process than to read.
HEAVY_TABLES = ["documents", "pages", "part"]


def spread(df: DataFrame) -> DataFrame:
    """Give a small input at least one partition per core.

    Text work is bound by CPU, and a file with one row group is one task. An input that
    already has more splits than the cluster has cores is left as it is: no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(df) if name in HEAVY_TABLES else df


def _day(offset: Column, start: str = "2024-01-01") -> Column:
    return F.date_add(F.to_date(F.lit(start)), offset.cast("int"))


def reviews(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as a whole-text review, plus one short buyer review per label row."""
    d = read_table(spark, folder, "documents").join(
        read_table(spark, folder, "labels").select("doc_id", "quality"), "doc_id", "left"
    )
    doc = F.col("doc_id")
    product = F.floor(doc / 100).cast("bigint")
    written = d.select(
        product.alias("product_id"),
        doc.alias("review_id"),
        "text",
        "source",
        F.when(doc % 13 != 0, ((doc * 7) % 5 + 1).cast("double")).alias("rating"),
        F.when(doc % 11 == 0, F.lit(None).cast("date"))
        .when(doc % 3 == 0, _day(product % 4))
        .otherwise(_day(F.col("n_chars") % 60))
        .alias("review_date"),
        F.when(doc % 17 == 0, F.lit("2 weeks ago")).alias("date_raw"),
        F.when(F.col("quality") == 1, True).when(F.col("quality") == 0, False).alias(
            "verified_purchase"
        ),
        F.concat(F.lit("user"), (doc % 97).cast("string")).alias("author"),
        ((doc * 3) % 60).cast("int").alias("helpful_votes"),
    )
    pick = (doc * 7 + F.col("quality") * 3 + F.col("toxic")) % len(BUYER_TEXTS)
    short = read_table(spark, folder, "labels").select(
        product.alias("product_id"),
        (doc + BUYER_OFFSET).alias("review_id"),
        F.element_at(F.array(*[F.lit(t) for t in BUYER_TEXTS]), (pick + 1).cast("int")).alias("text"),
        F.concat(F.lit("src"), (doc % 3).cast("string")).alias("source"),
        ((doc % 2) * 2 + 3).cast("double").alias("rating"),
        _day(doc % 6, "2024-02-10").alias("review_date"),
        F.lit(None).cast("string").alias("date_raw"),
        F.when(F.col("toxic") == 1, False).when(doc % 4 == 0, True).alias("verified_purchase"),
        F.concat(F.lit("buyer"), (doc % 50).cast("string")).alias("author"),
        (doc % 12).cast("int").alias("helpful_votes"),
    )
    return written.unionByName(short)


def products(spark: SparkSession, folder: str) -> DataFrame:
    """Name and description of every part; some carry no description."""
    key = F.col("p_partkey")
    return read_table(spark, folder, "part").select(
        key.alias("product_id"),
        F.concat_ws(" ", "p_brand", "p_name").alias("product_name"),
        F.when(key % 4 != 0, F.concat_ws(" ", "p_type", "p_name")).alias("description"),
        F.concat(F.lit("https://shop.example.com/p/"), key.cast("string")).alias("url"),
    )


def evidence(spark: SparkSession, folder: str) -> DataFrame:
    doc = F.col("doc_id")
    return read_table(spark, folder, "labels").select(
        F.floor(doc / 100).cast("bigint").alias("product_id"),
        doc.alias("pos"),
        F.element_at(
            F.array(F.lit("evidence"), F.lit("concern"), F.lit("claim_conflict")),
            (doc % 3 + 1).cast("int"),
        ).alias("type"),
        ((doc % 10) / 40.0).alias("severity"),
        (doc % 7).cast("int").alias("review_mentions"),
    )


def listings(spark: SparkSession, folder: str) -> DataFrame:
    """Retail titles with brand, model, capacity and SKU, built from parts."""
    key = F.col("p_partkey")
    return read_table(spark, folder, "part").select(
        key.alias("listing_id"),
        F.concat(
            "p_brand", F.lit(" "), "p_name", F.lit(" WX-"), (1000 + key % 40).cast("string"),
            F.lit(" "), (64 * (1 + key % 3)).cast("string"), F.lit("gb"),
            F.when(key % 23 == 0, F.lit(" case")).otherwise(F.lit("")),
        ).alias("title"),
        F.when(key % 7 != 0, F.col("p_brand")).alias("brand"),
        F.when(
            key % 5 != 0, F.create_map(F.lit("sku"), F.concat(F.lit("SKU"), F.lpad((key - key % 4).cast("string"), 6, "0")))
        ).alias("ids"),
    )


def videos(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("p_partkey")
    suffix = F.element_at(
        F.array(F.lit(" review"), F.lit(" giveaway"), F.lit(" unboxing"), F.lit("")),
        (key % 4 + 1).cast("int"),
    )
    return read_table(spark, folder, "part").select(
        (key % 20).alias("product_id"),
        key.alias("video_key"),
        F.concat(F.lit("v"), (key - key % 2).cast("string")).alias("video_id"),
        F.concat("p_brand", F.lit(" "), "p_name", F.lit(" WX-"), (1000 + key % 40).cast("string"), suffix).alias("title"),
        F.when(key % 9 != 0, (F.col("p_size") * 10).cast("bigint")).alias("duration_seconds"),
        F.when(key % 8 != 0, key * 37).alias("views"),
        F.when(key % 2 == 0, "youtube").otherwise("tiktok").alias("source"),
    )


def events(spark: SparkSession, folder: str) -> DataFrame:
    """The event table, its zone-less times read in the session time zone."""
    return read_table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def event_log(spark: SparkSession, folder: str) -> DataFrame:
    """One job per user; 'purchase' ends a job, 'error' is a failed stage."""
    return events(spark, folder).select(
        F.col("user_id").alias("job_id"),
        F.col("event_id").alias("seq"),
        "ts",
        F.when(F.col("event_type") == "purchase", "done").otherwise(F.col("event_type")).alias("event"),
        F.col("value"),
        F.col("props").alias("data"),
    )


def requests(spark: SparkSession, folder: str) -> DataFrame:
    return events(spark, folder).select(
        F.col("event_id").alias("request_id"),
        "ts",
        F.col("user_id").cast("string").alias("client"),
        F.concat_ws(":", "event_type", (F.col("user_id") % 10).cast("string")).alias("cache_key"),
    )


# ---------------------------------------------------------------- stored inputs and outputs


def read_rows(spark: SparkSession, path: str, schema: str, file_format: str = "parquet") -> DataFrame:
    """Stored rows of a known schema (see ``schemas``), Parquet or JSON lines."""
    return spark.read.schema(schema).format(file_format).load(path)


def write_rows(df: DataFrame, path: str, file_format: str = "parquet", mode: str = "append") -> None:
    df.write.mode(mode).format(file_format).save(path)
