"""Order-book tables derived from the given tables, with integers only, so that any SQL engine agrees bit for bit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depthframe.sources.shared import tasks

#: The level table as SQL; {div} is integer division. Equal rows of lineitem differ in nothing that counts.
LEVELS_SQL = """
SELECT l_orderkey AS seq, CAST(l_orderkey % 4 AS INT) AS book, CAST((l_orderkey {div} 4) % 3 AS INT) AS venue,
  CASE WHEN l_orderkey % 193 = 0 THEN 'INVALIDATE'
       WHEN l_orderkey % 97 = 0 OR l_orderkey < 12 THEN 'SNAPSHOT' ELSE 'DELTA' END AS kind,
  CAST(row_number() OVER (PARTITION BY l_orderkey
      ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS INT) AS pos,
  CASE WHEN l_linenumber % 2 = 0 THEN 'BID' ELSE 'ASK' END AS side,
  CAST(100000000000 + (CASE WHEN l_linenumber % 2 = 0 THEN -1 ELSE 1 END) * (l_partkey % 40 + 1) * 50000000 AS BIGINT) AS price_raw,
  CASE WHEN l_suppkey % 5 = 0 THEN CAST(0 AS BIGINT) ELSE CAST(l_quantity AS BIGINT) * 10000 END AS size_raw
FROM {lineitem}
"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    items = items.repartition(tasks(items), "l_orderkey")
    return spark.sql(LEVELS_SQL.format(div="div", lineitem="{items}"), items=items)


def faulty_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The level table with some bad levels: a negative size or a price of zero."""
    bad_size = (F.col("seq") % 211 == 0) & (F.col("pos") == 1)
    bad_price = (F.col("seq") % 307 == 0) & (F.col("pos") == 2)
    rows = levels(spark, sf_dir)
    return rows.withColumn("size_raw", F.when(bad_size, F.lit(-1).cast("bigint")).otherwise(F.col("size_raw"))).withColumn("price_raw", F.when(bad_price, F.lit(0).cast("bigint")).otherwise(F.col("price_raw")))


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence ids of one update for each order, and of some snapshots: venue, symbol, conn_epoch, recv_seq, kind, ids.

    Ids grow by three an update; every 50th leaves one out; ``unit_id`` numbers updates one by one, with such a jump too.
    """
    return spark.sql(UPDATES_SQL.format(div="div", orders="{orders}"), orders=read(spark, sf_dir, "orders").select("o_orderkey"))


#: The messages of ``updates`` as SQL.
UPDATES_SQL = """
SELECT 'v' AS venue, CAST(o_orderkey % 4 AS INT) AS symbol, CAST(o_orderkey {div} 1000 AS BIGINT) AS conn_epoch, CAST(o_orderkey * 2 AS BIGINT) AS recv_seq,
  'DELTA' AS kind, CAST(k * 3 + 1 + lost AS BIGINT) AS first_id, CAST(k * 3 + 3 AS BIGINT) AS final_id, CAST(k * 3 + lost AS BIGINT) AS prev_final_id,
  CAST(NULL AS BIGINT) AS last_update_id, CAST(k + k {div} 50 AS BIGINT) AS unit_id
FROM (SELECT o_orderkey, o_orderkey {div} 4 AS k, CASE WHEN (o_orderkey {div} 4) % 50 = 0 THEN 1 ELSE 0 END AS lost FROM {orders})
UNION ALL
SELECT 'v', CAST(o_orderkey % 4 AS INT), CAST(o_orderkey {div} 1000 AS BIGINT), CAST(o_orderkey * 2 + 1 AS BIGINT),
  'SNAPSHOT', NULL, NULL, NULL, CAST((o_orderkey {div} 4) * 3 + 2 AS BIGINT), CAST(NULL AS BIGINT)
FROM {orders} WHERE (o_orderkey {div} 4) % 25 = 2
"""

#: Raw venue texts, one for each order, in all shapes that the normaliser tells apart.
SHAPES = 20


def raw_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from depthframe.functions.symbols import VENUES

    names = F.array(*[F.lit(v) for v in VENUES.values()])
    key = F.col("o_orderkey")
    shape = (F.expr("o_orderkey div 6") % SHAPES).cast("int")
    price = F.concat((key % 1000 + 1).cast("string"), F.lit("."), F.lpad((key % 100).cast("string"), 2, "0"))
    size = F.concat((key % 7).cast("string"), F.lit(".5"))
    quoted = F.concat(F.lit('["'), price, F.lit('","'), size, F.lit('"]'))
    pair = F.when(shape == 2, F.concat(F.lit("["), price, F.lit(","), size, F.lit("]"))).otherwise(quoted)
    bids, first, last = F.concat(F.lit("["), pair, F.lit("]")), (key * 3 + 1).cast("string"), (key * 3 + 3).cast("string")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    rest = F.col("venue").startswith("binance") & (shape == 3)
    binance = F.when(rest, text('{"lastUpdateId":', last, ',"bids":', bids, ',"asks":[]}')).otherwise(text('{"e":"depthUpdate","s":"AB","U":', first, ',"u":', last, ',"pu":', first, ',"b":', bids, ',"a":[]}'))
    kind = F.when(shape == 3, "snapshot")
    bybit = text('{"topic":"orderbook.50.AB","type":"', F.coalesce(kind, F.lit("delta")), '","data":{"s":"AB","b":', bids, ',"a":[],"u":', last, "}}")
    okx = text('{"arg":{"instId":"A-B"},"action":"', F.coalesce(kind, F.lit("update")), '","data":[{"bids":[["', price, '","', size, '","0","1"]],"asks":[],"seqId":', last, ',"prevSeqId":', first, "}]}")
    okx = F.when(shape == 2, text('{"arg":{"instId":"A-B"},"action":"update","data":[]}')).otherwise(okx)
    body = F.when(F.col("venue").startswith("binance"), binance).when(F.col("venue").startswith("bybit"), bybit).otherwise(okx)
    made = F.when(shape == 0, F.concat(F.lit("{broken "), body)).when(shape == 1, F.when(F.col("venue").startswith("okx"), "pong").otherwise('{"result":null,"id":1}')).otherwise(body)
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.element_at(names, (key % 6 + 1).cast("int")).alias("venue"))
    return rows.select(key.alias("recv_seq"), F.lit(None).cast("timestamp").alias("recv_ts"), "venue", F.lit(0).cast("bigint").alias("conn_epoch"), F.when(rest, "REST").otherwise("WS").alias("source"), F.when(rest, "AB").alias("request_symbol"), made.alias("text"))


def client_stream(diffs: DataFrame, drop_every: int = 501) -> DataFrame:
    """What a consumer receives: the book at revision 1, then diffs. Of all books but those that 4 divides, the revision at two thirds
    of the history is lost, and every ``drop_every``th from there on."""
    last = diffs.groupBy("book").agg(F.max("book_seq").alias("last"))
    beyond = F.col("book_seq") - F.expr("2 * last div 3")
    lost = (F.col("book_seq") > 1) & (F.col("book") % 4 != 0) & (beyond >= 0) & (beyond % drop_every == 0)
    kept = diffs.join(last, "book").where(~lost & ((F.col("book_seq") > 1) | (F.col("size_raw") > 0)))
    return kept.select("book", F.col("book_seq").alias("arrival"), "book_seq", F.when(F.col("book_seq") == 1, "SNAPSHOT").otherwise("DIFF").alias("row_kind"), "side", "price_raw", "size_raw", F.lit(1).alias("pos"))
