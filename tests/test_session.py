"""Small sessions, message by message; the whole chain on tables is held against SQL by test_queries.py."""

from pyspark.sql import functions as F

from depthframe.operators import blocks, book, session
from depthframe.plans import session_fixture
from depthframe.types import RAW_MESSAGES

SUBSCRIBED = [("BYBIT", "SPOT", "A", "USD", "bybit_spot", "AUSD"), ("BYBIT", "SPOT", "B", "USD", "bybit_spot", "BUSD"), ("BINANCE", "SPOT", "A", "USD", "binance_spot", "AUSD"), ("BINANCE", "SPOT", "B", "USD", "binance_spot", "BUSD")]


def bybit(seq, symbol, u, levels, kind="delta", epoch=0):
    return (seq, None, "bybit_spot", epoch, "WS", None, f'{{"topic":"orderbook.50.{symbol}","type":"{kind}","data":{{"s":"{symbol}","b":{levels},"a":[],"u":{u}}}}}')


def binance(seq, symbol, first, last, levels):
    return (seq, None, "binance_spot", 0, "WS", None, f'{{"e":"depthUpdate","s":"{symbol}","U":{first},"u":{last},"b":{levels},"a":[]}}')


def fetched(seq, symbol, last, levels):
    return (seq, None, "binance_spot", 0, "REST", symbol, f'{{"lastUpdateId":{last},"bids":{levels},"asks":[]}}')


def replay(spark, *rows):
    names = "exchange string, market string, base string, quote string, venue string, native_symbol string"
    found = session.replay(spark.createDataFrame(list(rows), RAW_MESSAGES), spark.createDataFrame(SUBSCRIBED, names)).collect()
    size = lambda x: None if x is None else x // 1_000_000
    return sorted((r.book[:1], r.recv_seq, r.ord + 1, r.kind, size(r.size_raw)) for r in found if r.kind != "INVALIDATE"), sorted((r.book[:1], r.recv_seq) for r in found if r.kind == "INVALIDATE")


ONE, TWO, BAD = '[["5","1"]]', '[["5","2"]]', '[["5","3"],["0","1"]]'


def test_a_gap_drops_the_connection_of_a_pushed_venue(spark):
    applied, void = replay(spark, bybit(1, "AUSD", 7, ONE, "snapshot"), bybit(2, "BUSD", 3, ONE, "snapshot"), bybit(3, "AUSD", 8, TWO), bybit(4, "AUSD", 10, ONE), bybit(5, "BUSD", 4, TWO), bybit(6, "AUSD", 11, ONE, "snapshot"), bybit(7, "BUSD", 9, TWO, "snapshot", 1))
    assert applied == [("A", 1, 1, "SNAPSHOT", 1), ("A", 3, 1, "DELTA", 2), ("B", 2, 1, "SNAPSHOT", 1), ("B", 7, 1, "SNAPSHOT", 2)]
    assert void == [("A", 4), ("A", 4), ("A", 7), ("B", 4), ("B", 7)]


def test_a_bad_level_voids_its_message_and_the_symbol(spark):
    applied, void = replay(spark, binance(1, "AUSD", 1, 5, ONE), fetched(2, "AUSD", 3, TWO), binance(3, "AUSD", 6, 8, BAD), binance(4, "AUSD", 9, 9, ONE), binance(5, "BUSD", 1, 5, ONE), fetched(6, "BUSD", 3, TWO), fetched(7, "AUSD", 8, ONE), binance(8, "AUSD", 10, 12, TWO))
    assert applied == [("A", 2, 1, "SNAPSHOT", 2), ("A", 2, 2, "DELTA", 1), ("A", 7, 1, "SNAPSHOT", 1), ("A", 7, 2, "DELTA", 1), ("A", 8, 1, "DELTA", 2), ("B", 6, 1, "SNAPSHOT", 2), ("B", 6, 2, "DELTA", 1)]
    assert void == [("A", 3)]


def test_the_rest_of_a_batch_is_applied_after_a_bad_message(spark):
    applied, void = replay(spark, binance(1, "AUSD", 1, 5, BAD), binance(2, "AUSD", 6, 7, ONE), fetched(3, "AUSD", 3, TWO), binance(4, "AUSD", 8, 9, ONE))
    assert applied == [("A", 3, 1, "SNAPSHOT", 2), ("A", 3, 3, "DELTA", 1)] and void == [("A", 3)]


def test_noise_and_an_empty_snapshot(spark):
    noise = (3, None, "bybit_spot", 0, "WS", None, "pong")
    other = bybit(4, "ZUSD", 1, ONE, "snapshot")
    broken = (5, None, "bybit_spot", 0, "WS", None, "{")
    applied, void = replay(spark, bybit(1, "AUSD", 7, ONE, "snapshot"), bybit(2, "AUSD", 9, "[]", "snapshot"), noise, other, broken)
    assert applied == [("A", 1, 1, "SNAPSHOT", 1), ("A", 2, 1, "SNAPSHOT", None)] and void == []


def test_a_message_that_is_recorded_twice_counts_once(spark):
    rows = [bybit(1, "AUSD", 7, ONE, "snapshot"), bybit(2, "AUSD", 8, TWO), bybit(3, "AUSD", 9, ONE), bybit(4, "BUSD", 1, ONE, "snapshot"), binance(5, "AUSD", 1, 5, ONE), fetched(6, "AUSD", 3, TWO)]
    once, twice = replay(spark, *rows), replay(spark, *rows, *rows[1:5], rows[5], rows[5])
    assert once == twice and [r[:3] for r in once[0]] == [("A", 1, 1), ("A", 2, 1), ("A", 3, 1), ("A", 6, 1), ("A", 6, 2), ("B", 4, 1)] and once[1] == []


def test_receipts_in_microseconds_at_two_block_widths(spark, testdata):
    """Numbers are dense, so blocks hold messages, and neither large recv_seq nor the blocks' width changes a diff."""
    raw = session_fixture.raw_texts(spark, f"{testdata}/sf0.001").cache()
    subscriptions = session_fixture.subscriptions(spark)
    start, step = 1_800_000_000_000_000, 977
    plain = session.replay(raw, subscriptions).cache()
    late = session.replay(raw.withColumn("recv_seq", F.lit(start) + F.col("recv_seq") * step), subscriptions).cache()
    shown = lambda rows: sorted(map(tuple, rows.collect()))
    wanted = shown(book.l2_diffs(plain))
    assert wanted == shown(book.l2_diffs(late)) == shown(book.l2_diffs(late, block=16))
    received = late.select("book", "seq", "recv_seq", "ord").distinct().withColumn("recv_seq", F.expr(f"(recv_seq - {start}L) div {step}L"))
    assert shown(received) == shown(plain.select("book", "seq", "recv_seq", "ord").distinct())
    n, books, groups = late.select("book", "venue", "seq").distinct().count(), late.select("book").distinct().count(), late.selectExpr("book", f"seq div {book.BLOCK} AS block").distinct().count()
    assert groups <= books * (1 + n // book.BLOCK) and n > 250 * groups
    assert late.groupBy("book").agg(F.max("seq").alias("last"), F.countDistinct("seq").alias("n")).where("last > 2 * n").isEmpty()


def test_dense_numbers(spark):
    rows = spark.range(5000).selectExpr("CASE WHEN id % 3 > 0 THEN 'hot' ELSE concat('b', id % 7) END AS book", "id * 7919 % 1000 AS a", "id % 2 AS b").repartition(9)
    got = blocks.dense_numbers(rows, "book", ["a", "b"], "n").collect()
    by = {}
    for r in got:
        by.setdefault(r.book, []).append((r.n, r.a, r.b))
    wanted = {}
    for r in set(map(tuple, rows.collect())):
        wanted.setdefault(r[0], []).append(r[1:])
    assert {k: sorted(v) for k, v in by.items()} == {k: [(i + 1, *x) for i, x in enumerate(sorted(v))] for k, v in wanted.items()}


def test_ids_beyond_floats_and_many_short_connections(spark):
    """Ids beside missing ones stay whole numbers, so a gap of one is seen; connections of one task don't run into each other."""
    from depthframe.operators import sync

    big = 1 << 60
    one = [("v", 0, 1, "DELTA", big, big + 2, big - 1, None), ("v", 0, 2, "SNAPSHOT", None, None, None, big + 1), ("v", 0, 3, "DELTA", big + 4, big + 5, big + 3, None)]
    rows = [(v, s, e, *rest) for e in range(300) for v, s, *rest in one]
    messages = spark.createDataFrame(rows, "venue string, symbol int, conn_epoch long, recv_seq long, kind string, first_id long, final_id long, prev_final_id long, last_update_id long")
    got = {}
    for r in sync.sync_actions(messages, "futures").collect():
        got.setdefault(r.conn_epoch, []).append((r.recv_seq, r.ord, r.action, r.message_seq))
    wanted = [(1, 0, "REQUEST_SNAPSHOT", None), (2, 0, "SNAPSHOT", 2), (2, 1, "DELTA", 1), (3, 0, "INVALIDATE", None)]
    assert len(got) == 300 and all(sorted(x) == wanted for x in got.values())
