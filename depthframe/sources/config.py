"""Subscription and timeout files. They are small JSON documents; every mistake in one is an error that names it.

The files are read and checked with Spark, so a path may lie in any store that Spark reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depthframe.functions.symbols import book_to_string, native_symbol, parse_exchange, parse_market, split_base_quote, venue_to_string

DEFAULT_SECONDS, MAX_SECONDS = 30, 86_400


def _document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The one row of a JSON file; _bad is set if it isn't JSON of that schema."""
    text = spark.read.text(path, wholetext=True)
    options = {"columnNameOfCorruptRecord": "_bad"}
    return text.select(F.from_json("value", schema + ", _bad STRING", options).alias("d")).select("d.*")


def _reject(rows: DataFrame, message) -> None:
    bad = rows.select(message.alias("message")).where("message IS NOT NULL").head(1)
    if bad:
        raise ValueError(bad[0]["message"])


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("times")).where("times > 1")


def read_subscriptions(spark: SparkSession, path: str) -> DataFrame:
    """One row for each venue of each book: exchange, market, base, quote, venue, native_symbol.

    File: {"books": [{"symbol": "BASE_QUOTE", "type": "SPOT" or "PERP", "venues": ["BINANCE", ...]}]}.
    """
    schema = "books ARRAY<STRUCT<symbol STRING, type STRING, venues ARRAY<STRING>>>"
    doc = _document(spark, path, schema)
    _reject(doc, F.when(F.col("_bad").isNotNull() | F.col("books").isNull(), "malformed subscription file"))
    books = doc.select(F.posexplode("books").alias("entry", "b")).select("entry", "b.*")
    field = F.coalesce("symbol", F.lit("?"))
    _reject(books, F.when(F.col("symbol").isNull() | F.col("type").isNull() | F.col("venues").isNull(), F.concat(F.lit("a book needs symbol, type and venues: "), field)))
    _reject(books, F.when(parse_market(F.col("type")).isNull(), F.concat(F.lit("unknown type "), "type", F.lit(" of "), field)))
    _reject(books, F.when(split_base_quote(F.col("symbol")).isNull(), F.concat(F.lit("symbol isn't BASE_QUOTE: "), field)))
    named = books.withColumn("pair", split_base_quote(F.col("symbol"))).withColumn("book", book_to_string(F.col("pair.base"), F.col("pair.quote"), F.col("type")))
    _reject(named, F.when(F.size("venues") == 0, F.concat(F.lit("no venues for "), "book")))
    _reject(duplicates(named, "book"), F.concat(F.lit("book is configured more than once: "), "book"))
    flat = named.select("book", "pair", "type", F.explode("venues").alias("exchange"))
    _reject(flat, F.when(F.col("exchange").isNull() | parse_exchange(F.col("exchange")).isNull(), F.concat(F.lit("unknown venue "), F.coalesce("exchange", F.lit("null")), F.lit(" for "), "book")))
    _reject(duplicates(flat, "book", "exchange"), F.concat(F.lit("venue "), "exchange", F.lit(" is listed twice for "), "book"))
    if not flat.head(1):
        raise ValueError("no books in the subscription file")
    market = F.col("type")
    return flat.select("exchange", market.alias("market"), "pair.base", "pair.quote", venue_to_string(F.col("exchange"), market).alias("venue"), native_symbol(F.col("exchange"), F.col("pair.base"), F.col("pair.quote"), market).alias("native_symbol"))


def read_idle_timeouts(spark: SparkSession, path: str) -> tuple[int, DataFrame]:
    """(default seconds, overrides: exchange, market, venue, seconds).

    File: {"idle_timeout_seconds": 30, "idle_timeout_overrides": [{"venue": ..., "type": ..., "seconds": ...}]}; both may lack.
    """
    schema = "idle_timeout_seconds BIGINT, idle_timeout_overrides ARRAY<STRUCT<venue STRING, type STRING, seconds BIGINT>>"
    doc = _document(spark, path, schema)
    _reject(doc, F.when(F.col("_bad").isNotNull(), "malformed timeout file"))
    outside = lambda c: (F.col(c) < 1) | (F.col(c) > MAX_SECONDS)
    _reject(doc, F.when(outside("idle_timeout_seconds"), F.concat(F.lit("timeout out of range: "), F.col("idle_timeout_seconds").cast("string"))))
    rows = doc.select(F.explode("idle_timeout_overrides").alias("o")).select(F.col("o.venue").alias("exchange"), F.col("o.type").alias("market"), F.col("o.seconds").alias("seconds"))
    _reject(rows, F.when(parse_exchange(F.col("exchange")).isNull() | parse_market(F.col("market")).isNull(), "an override names an unknown venue"))
    _reject(rows, F.when(F.col("seconds").isNull() | outside("seconds"), F.lit("an override's seconds are missing or out of range")))
    _reject(duplicates(rows, "exchange", "market"), F.concat(F.lit("override listed twice: "), "exchange", F.lit(" "), "market"))
    first = doc.select("idle_timeout_seconds").head(1)
    default = first[0][0] if first and first[0][0] is not None else DEFAULT_SECONDS
    return int(default), rows.select("exchange", "market", venue_to_string(F.col("exchange"), F.col("market")).alias("venue"), F.col("seconds").cast("int").alias("seconds"))
