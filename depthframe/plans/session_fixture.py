"""Raw texts of six venues derived from orders and their line items, and the level table that they lead to as SQL.

Order k is a message of venue k % 6 and symbol k div 6 % 2, at position j = k div 12 of that symbol. A connection lasts 40
positions, r = 0 to 39. Every third connection (j div 40 % 3 = 1) loses an update of symbol 0 before r = 20, and every
third one (= 2) carries a bad level in symbol 1's r = 30. Venues that push snapshots send one at r = 0; the two others
have theirs fetched at r = 2, and two positions after what broke the sequence. Noise stands between: control texts, broken
JSON, and a symbol that nobody asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depthframe.functions.symbols import VENUES, native_symbol

from .fixture import read

NAMES = tuple(VENUES.values())  # binance_spot, binance_futures, bybit_spot, bybit_linear, okx_spot, okx_swap
BASES = ("AAA", "BBB")
EPOCH = 40


def subscriptions(spark: SparkSession) -> DataFrame:
    rows = [(e, m, b, "USDT", v) for (e, m), v in VENUES.items() for b in BASES]
    made = spark.createDataFrame(rows, "exchange string, market string, base string, quote string, venue string")
    return made.withColumn("native_symbol", native_symbol(F.col("exchange"), F.col("base"), F.col("quote"), F.col("market")))


def _texts(*parts) -> F.Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def raw_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = lambda c: F.concat(F.expr(f"{c} div 100").cast("string"), F.lit("."), F.lpad(F.expr(f"{c} % 100").cast("string"), 2, "0"))
    items = read(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS k", "l_linenumber % 2 = 0 AS bid", "struct(l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS place", "10000 + CASE WHEN l_linenumber % 2 = 0 THEN -1 ELSE 1 END * (l_partkey % 40 + 1) * 5 AS price", "CASE WHEN l_suppkey % 5 = 0 THEN 0 ELSE CAST(l_quantity AS BIGINT) END AS size")
    pair = _texts('["', cents("price"), '","', cents("size"), '"]')
    side = lambda bid: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("bid") == bid, F.struct("place", pair.alias("pair"))))), lambda x: x["pair"]), ",")
    levels = items.groupBy("k").agg(side(True).alias("bids"), side(False).alias("asks"))
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")).join(levels, "k", "left")
    rows = rows.selectExpr("k", "CAST(k % 6 AS INT) AS v", "CAST(k div 6 % 2 AS INT) AS s", "k div 12 AS j", "coalesce(bids, '') AS bids", "coalesce(asks, '') AS asks")
    rows = rows.selectExpr("*", f"j div {EPOCH} AS e", f"j % {EPOCH} AS r", f"CASE WHEN j div {EPOCH} % 3 = 1 AND s = 0 THEN 20 WHEN j div {EPOCH} % 3 = 2 AND s = 1 THEN 30 END AS breaks")
    bad = F.expr("e % 3 = 2 AND r = breaks")
    bids = F.concat(F.lit("["), F.when(bad, F.concat(F.lit('["0","1"]'), F.when(F.col("bids") != "", ",").otherwise(""))).otherwise(""), F.col("bids"), F.lit("]"))
    asks = _texts("[", F.col("asks"), "]")
    # Ids: an update at j covers 3j + 1 to 3j + 3; one that follows a fetched snapshot covers six; the lost one leaves out an id.
    fetched = F.expr("v < 2 AND (r = 2 OR r = coalesce(breaks, -9) + 2)")
    after = F.expr("v < 2 AND (r = 3 OR r = coalesce(breaks, -9) + 3)")
    lost = F.expr("CASE WHEN e % 3 = 1 AND r = breaks THEN 1 ELSE 0 END")
    before = F.col("j") * 3 - F.when(after, 3).otherwise(0) + lost
    last = F.col("j") * 3 + 3
    text = lambda c: c.cast("string")
    pick = lambda names, c: F.element_at(F.array(*[F.lit(n) for n in names]), c + 1)
    base = pick(BASES, F.col("s"))
    binance = F.when(fetched, _texts('{"lastUpdateId":', text(F.col("j") * 3 - 1), ',"bids":', bids, ',"asks":', asks, "}")).otherwise(_texts('{"e":"depthUpdate","s":"', base, 'USDT","U":', text(before + 1), ',"u":', text(last), ',"pu":', text(before), ',"b":', bids, ',"a":', asks, "}"))
    kind = lambda first, then: F.when(F.col("r") == 0, first).otherwise(then)
    bybit = _texts('{"topic":"orderbook.50.', base, 'USDT","type":"', kind("snapshot", "delta"), '","data":{"s":"', base, 'USDT","b":', bids, ',"a":', asks, ',"u":', text(F.col("j") + 1 + F.expr(f"CASE WHEN e % 3 = 1 AND s = 0 AND r >= 20 THEN 1 ELSE 0 END")), "}}")
    okx = _texts('{"arg":{"instId":"', base, "-USDT", F.when(F.col("v") == 5, "-SWAP").otherwise(""), '"},"action":"', kind("snapshot", "update"), '","data":[{"bids":', bids, ',"asks":', asks, ',"seqId":', text(last), ',"prevSeqId":', text(before), "}]}")
    body = F.when(F.col("v") < 2, binance).when(F.col("v") < 4, bybit).otherwise(okx)
    made = rows.select("k", "e", pick(NAMES, F.col("v")).alias("venue"), F.when(fetched, "REST").otherwise("WS").alias("source"), F.when(fetched, F.concat(base, F.lit("USDT"))).alias("request_symbol"), body.alias("text"))
    empty = F.lit(None).cast("timestamp").alias("recv_ts")
    columns = lambda seq, source, symbol, text: [seq.alias("recv_seq"), empty, F.col("venue"), F.col("e").alias("conn_epoch"), source.alias("source"), symbol.alias("request_symbol"), text.alias("text")]
    noise = F.when(F.col("k") % 3 == 0, F.concat(F.lit("{broken "), F.col("text"))).when(F.col("k") % 3 == 1, "pong").otherwise(F.regexp_replace("text", "AAA|BBB", "ZZZ"))
    real = made.select(*columns(F.col("k") * 2, F.col("source"), F.col("request_symbol"), F.col("text")))
    other = made.where("k % 17 = 0 AND source = 'WS'").select(*columns(F.col("k") * 2 + 1, F.lit("WS"), F.lit(None).cast("string"), noise))
    return real.unionByName(other)


_NAMES = "[" + ", ".join(f"'{n}'" for n in NAMES) + "]"
#: What of the texts is applied, and when, by the rules of the fixture: trigger, rank, message, kind.
LEVELS_SQL = f"""
m AS (
  SELECT o_orderkey AS k, o_orderkey % 6 AS v, o_orderkey // 6 % 2 AS s, o_orderkey // 12 // {EPOCH} AS e, o_orderkey // 12 % {EPOCH} AS r,
    CASE WHEN o_orderkey // 12 // {EPOCH} % 3 = 1 AND o_orderkey // 6 % 2 = 0 THEN 20 WHEN o_orderkey // 12 // {EPOCH} % 3 = 2 AND o_orderkey // 6 % 2 = 1 THEN 30 END AS breaks FROM orders
), broken AS (SELECT v, e, min(k) AS k FROM m WHERE r = breaks GROUP BY ALL),
conn AS (SELECT v, e, min(k) AS k FROM m GROUP BY ALL),
members AS (SELECT DISTINCT v, e, s FROM m),
snaps AS (
  SELECT v, s, e, r, k FROM m WHERE v < 2 AND (r = 2 OR r = coalesce(breaks, -9) + 2)
), acts AS (
  SELECT m.k, m.k AS trigger, 1 AS rank, CASE WHEN r = 0 THEN 'SNAPSHOT' ELSE 'DELTA' END AS kind, m.v, m.s
  FROM m LEFT JOIN broken b ON m.v = b.v AND m.e = b.e WHERE m.v >= 2 AND (b.k IS NULL OR m.k < b.k)
  UNION ALL SELECT NULL, b.k, 0, 'INVALIDATE', b.v, x.s FROM broken b JOIN members x ON x.v = b.v AND x.e = b.e WHERE b.v >= 2
  UNION ALL SELECT k, k, 1, 'SNAPSHOT', v, s FROM snaps
  UNION ALL SELECT m.k, n.k, 2, 'DELTA', m.v, m.s FROM snaps n JOIN m ON m.v = n.v AND m.s = n.s AND m.e = n.e AND m.r = n.r - 1
  UNION ALL SELECT m.k, m.k, 1, 'DELTA', m.v, m.s FROM m WHERE v < 2 AND r > 2 AND (breaks IS NULL OR r < breaks OR r > breaks + 2)
  UNION ALL SELECT NULL, k, 1, 'INVALIDATE', v, s FROM m WHERE r = breaks
  UNION ALL SELECT NULL, n.k, 0, 'INVALIDATE', x.v, x.s FROM members x JOIN (SELECT v, lag(e) OVER w AS e, k FROM conn WINDOW w AS (PARTITION BY v ORDER BY e)) n ON n.v = x.v AND n.e = x.e
), lv AS (
  SELECT ({list(BASES)})[a.s + 1] || '_USDT.' || CASE WHEN a.v % 2 = 0 THEN 'SPOT' ELSE 'PERP' END AS book, ({_NAMES})[a.v + 1] AS venue, CAST(a.trigger * 2 * 1048576 + a.rank AS BIGINT) AS seq, a.kind,
    row_number() OVER (PARTITION BY a.trigger, a.rank, a.s, a.v ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS pos,
    CASE WHEN l_linenumber % 2 = 0 THEN 'BID' WHEN l_linenumber % 2 = 1 THEN 'ASK' END AS side,
    CAST(100000000000 + (CASE WHEN l_linenumber % 2 = 0 THEN -1 ELSE 1 END) * (l_partkey % 40 + 1) * 50000000 AS BIGINT) AS price_raw,
    CASE WHEN l_suppkey % 5 = 0 THEN CAST(0 AS BIGINT) ELSE CAST(l_quantity AS BIGINT) * 10000 END AS size_raw
  FROM acts a LEFT JOIN lineitem i ON i.l_orderkey = a.k
)"""
