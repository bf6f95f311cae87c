"""Readers of recorded venue messages and writers of results. All schemas are explicit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from depthframe.functions.fixed import fixed_to_decimal
from depthframe.functions.labels import bps_label, notional_label, open_ended
from depthframe.types import NOTIONAL_DECIMALS, PRICE_DECIMALS, RAW_MESSAGES, SIZE_DECIMALS


def read_raw_messages(spark: SparkSession, path: str, fmt: str = "json", stream: bool = False) -> DataFrame:
    """Raw venue texts in the order of recv_seq, from JSON lines or Parquet, in batch or as a stream."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(RAW_MESSAGES).format(fmt).load(path)


def read_rest_snapshots(spark: SparkSession, path: str, fmt: str = "json", stream: bool = False) -> DataFrame:
    """Recorded REST bodies: messages whose symbol is that of the request."""
    return read_raw_messages(spark, path, fmt, stream).where("source = 'REST' AND request_symbol IS NOT NULL")


def write_in_order(rows: DataFrame, order: str, path: str, rows_per_file: int, files: int | None = None, most_rows: int | None = None, parts: int = 1) -> None:
    """Record rows as Parquet files that a stream reads one after another: each a range of ``order``, stamped in that order.

    A recording of more than ``files`` such files gets larger ones, of ``most_rows`` rows at most: what a micro-batch costs beside
    its rows is then paid for about so many times. Each is cut in ``parts`` files, for a stream that takes so many at once and
    reads them in as many tasks. Rows should be a table, as they are counted and sampled before they are written.
    One job writes all files; the file source reads the oldest first, so their times, a second apart, are then set by name.
    """
    spark = rows.sparkSession
    total = rows.count()
    if files:
        rows_per_file = max(rows_per_file, min(-(-total // files), most_rows or total))
    n = max(1, -(-total // rows_per_file)) * parts
    rows.repartitionByRange(n, order).sortWithinPartitions(order).write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    files = sorted((f.getPath() for f in store.listStatus(folder) if f.getPath().getName().startswith("part-")), key=lambda f: f.getName())
    for k, file in enumerate(files):
        store.setTimes(file, (1_000_000_000 + k) * 1000, -1)


def write_table(rows: DataFrame, path: str, by: tuple[str, ...] = ("book",), fmt: str = "parquet", mode: str = "append") -> None:
    """Diffs, snapshots, best prices and bands all go to tables that are partitioned by book, so a book's reader prunes."""
    rows.write.mode(mode).partitionBy(*by).format(fmt).save(path)


def stream_table(rows: DataFrame, path: str, checkpoint: str, by: tuple[str, ...] = ("book",)) -> StreamingQuery:
    return rows.writeStream.outputMode("append").partitionBy(*by).format("parquet").option("path", path).option("checkpointLocation", checkpoint).start()


def nested_snapshot(levels: DataFrame) -> DataFrame:
    """One row for each book: bids and asks as arrays of (price_raw, size_raw), best first."""
    level = lambda side, price: F.when((F.col("side") == side) & (F.col("size_raw") > 0), F.struct(price.alias("order"), F.col("price_raw"), F.col("size_raw")))
    sides = levels.groupBy("book").agg(F.sort_array(F.collect_list(level("BID", -F.col("price_raw")))).alias("bids"), F.sort_array(F.collect_list(level("ASK", F.col("price_raw")))).alias("asks"))
    plain = lambda c: F.transform(c, lambda x: F.struct(x["price_raw"].alias("price_raw"), x["size_raw"].alias("size_raw"))).alias(c)
    return sides.select("book", plain("bids"), plain("asks"))


def nested_diffs(diffs: DataFrame) -> DataFrame:
    """One row for each revision: its changed levels as arrays of (price_raw, size_raw), bids downwards, then asks upwards."""
    level = lambda side, price: F.when(F.col("side") == side, F.struct(price.alias("order"), F.col("price_raw"), F.col("size_raw")))
    sides = diffs.groupBy("book", "seq", "book_seq").agg(F.sort_array(F.collect_list(level("BID", -F.col("price_raw")))).alias("bids"), F.sort_array(F.collect_list(level("ASK", F.col("price_raw")))).alias("asks"))
    plain = lambda c: F.transform(c, lambda x: F.struct(x["price_raw"].alias("price_raw"), x["size_raw"].alias("size_raw"))).alias(c)
    return sides.select("book", "seq", "book_seq", plain("bids"), plain("asks"))


def band_lines(bands: DataFrame) -> DataFrame:
    """Report lines of price bands: book, side, and 'label: size @ boundary' for each band."""
    return _lines(bands, bps_label(F.col("bps")), F.concat(_number("cum_size_raw", SIZE_DECIMALS), F.lit(" @ "), _number("boundary_raw", PRICE_DECIMALS)))


def volume_lines(bands: DataFrame) -> DataFrame:
    """Report lines of notional bands: book, side, and 'label: average price' for each band, the last one open-ended; where
    a side is too thin, the notional that it fills."""
    keys = [c for c in ("book", "book_seq") if c in bands.columns]
    label = open_ended(notional_label(F.col("threshold_raw")), F.col("ord"), *keys, "side")
    thin = F.concat(F.lit("only "), _number("filled_raw", NOTIONAL_DECIMALS))
    return _lines(bands, label, F.coalesce(_number("vwap_raw", PRICE_DECIMALS), thin))


def _number(column: str, decimals: int) -> Column:
    return fixed_to_decimal(F.col(column), decimals).cast("string")


def _lines(bands: DataFrame, label: Column, value: Column) -> DataFrame:
    text = F.concat(label, F.lit(": "), F.when(F.col("status") == "OK", value).otherwise("ERROR"))
    bands = bands.withColumn("text", text)
    keys = [c for c in ("book", "book_seq") if c in bands.columns]
    lines = bands.groupBy(*keys, "side").agg(F.sort_array(F.collect_list(F.struct("ord", "text"))).alias("x"))
    return lines.select(*keys, "side", F.array_join(F.transform("x", lambda x: x["text"]), "  ").alias("line"))
