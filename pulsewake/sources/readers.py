"""Readers. Each is a thin, declared-schema call of the Spark reader plus the reshaping that belongs to it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from pulsewake import schemas
from pulsewake.functions.times import date_key, from_millis, shift_zone


def read_posts_csv(spark: SparkSession, path: str, schema: StructType = schemas.POSTS, **options) -> DataFrame:
    """CSV with a header and a fixed schema; rows that do not fit are dropped."""
    return spark.read.csv(path, schema=schema, header=True, mode="DROPMALFORMED", **options)


def read_csv_inferred(spark: SparkSession, path: str) -> DataFrame:
    """For ad-hoc files only: inference reads the data twice."""
    return spark.read.csv(path, header=True, inferSchema=True)


def read_csv_dir(spark: SparkSession, path: str, schema: StructType, header: bool = True) -> DataFrame:
    """All part files of a CSV directory that Spark wrote."""
    return spark.read.csv(path, schema=schema, header=header)


def read_raw_posts(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object per line, nested user."""
    return spark.read.schema(schemas.RAW_POSTS).json(path)


def read_articles_json(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """One pretty-printed article per file, all files of a folder."""
    return spark.read.schema(schemas.ARTICLES).option("multiLine", True).option("pathGlobFilter", pattern).json(path)


def read_parquet(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def read_orc(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.orc(path)


def read_table(spark: SparkSession, fmt: str, options: Mapping[str, str], predicate: str | Column | None = None,
               columns: Sequence[str] | None = None, path: str | None = None) -> DataFrame:
    """Any connector by format name; the predicate is left to the optimizer to push into the scan.

    Serves warehouses, graph stores (relationship or query option) and file formats alike.
    """
    df = spark.read.format(fmt).options(**options).load(path) if path else spark.read.format(fmt).options(**options).load()
    if predicate is not None:
        df = df.where(predicate)
    return df.select(*columns) if columns else df


def read_query(spark: SparkSession, url: str, query: str, partition_column: str, lower: int, upper: int,
               partitions: int, properties: Mapping[str, str] | None = None) -> DataFrame:
    """Rows of a relational query, fetched in parallel ranges of a numeric column."""
    return spark.read.jdbc(
        url, f"({query}) q", column=partition_column, lowerBound=lower, upperBound=upper,
        numPartitions=partitions, properties=dict(properties or {}),
    )


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """Text file to a unique work list: trimmed, no blank lines."""
    return spark.read.text(path).select(F.trim("value").alias("url")).where(F.col("url") != "").distinct()


def read_event_export(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated export whose last column is an address; unique addresses."""
    return spark.read.text(path).select(F.element_at(F.split("value", "\t"), -1).alias("url")).distinct()


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Feed files to one row per item."""
    return spark.read.format("xml").option("rowTag", "item").schema("link string, title string").load(path)


def feed_items(feeds: DataFrame, xml: str = "xml") -> DataFrame:
    """Feed text held in a column to one row per item."""
    items = F.arrays_zip(
        F.xpath(F.col(xml), F.lit("//item/link/text()")).alias("link"),
        F.xpath(F.col(xml), F.lit("//item/title/text()")).alias("title"),
    )
    return feeds.select(*[c for c in feeds.columns if c != xml], F.inline(items))


def follower_pages(payloads: DataFrame, account: str = "account", payload: str = "payload") -> DataFrame:
    """Follower page JSON to ``(account, ids, next_cursor)``."""
    return payloads.select(account, F.from_json(payload, schemas.FOLLOWER_PAGE).alias("p")).select(account, "p.*")


# Order of the numbers in a candle.
CANDLE = ["time", "open", "close", "high", "low", "volume"]


def candles_to_prices(candles: DataFrame, candle: str = "candle", zone: str = "Asia/Singapore") -> DataFrame:
    """Candle arrays to the typed price table in local time, repeated candles removed, in time order."""
    fields = {name: F.col(candle)[i] for i, name in enumerate(CANDLE)}
    local = shift_zone(from_millis(fields["time"].cast("bigint")), "UTC", zone)
    rows = candles.select(
        local.alias("time"), *[fields[c].cast("double").alias(c) for c in CANDLE[1:]], date_key(local).alias("id_date")
    )
    return rows.distinct().orderBy("time")
