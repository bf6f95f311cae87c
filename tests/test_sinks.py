"""Nested forms and report lines."""

from pyspark.sql import functions as F

from depthframe.functions import fixed, labels
from depthframe.operators import client, sync
from depthframe.sources.messages import band_lines, nested_diffs, nested_snapshot, volume_lines


def test_nested_forms(spark):
    rows = [(1, "BID", 5, 2), (1, "ASK", 9, 1), (1, "BID", 7, 3), (1, "ASK", 8, 0), (2, "ASK", 4, 4)]
    levels = spark.createDataFrame(rows, "book int, side string, price_raw long, size_raw long")
    got = {r.book: ([tuple(x) for x in r.bids], [tuple(x) for x in r.asks]) for r in nested_snapshot(levels).collect()}
    assert got == {1: ([(7, 3), (5, 2)], [(9, 1)]), 2: ([], [(4, 4)])}
    diffs = levels.selectExpr("book", "10L AS seq", "3L AS book_seq", "side", "price_raw", "size_raw")
    got = {r.book: (r.seq, r.book_seq, [tuple(x) for x in r.bids], [tuple(x) for x in r.asks]) for r in nested_diffs(diffs).collect()}
    assert got == {1: (10, 3, [(7, 3), (5, 2)], [(8, 0), (9, 1)]), 2: (10, 3, [], [(4, 4)])}


def test_report_lines(spark):
    price = [(1, "BID", 0, 50, 1_500_000_000, 2_000_000, 3, "OK"), (1, "BID", 1, 100, 1_000_000_000, 2_500_000, 3, "OK"), (1, "ASK", 0, 50, None, None, None, "RESULT_OUT_OF_RANGE")]
    bands = spark.createDataFrame(price, "book int, side string, ord int, bps int, boundary_raw long, cum_size_raw long, cum_notional_raw long, status string")
    assert {r.side: r.line for r in band_lines(bands).collect()} == {"BID": "50bps: 2.000000 @ 1.500000000  100bps: 2.500000 @ 1.000000000", "ASK": "50bps: ERROR"}
    volume = [(1, 4, "ASK", 0, 10**15, 1_250_000_000, 10**15, "OK"), (1, 4, "ASK", 1, 5 * 10**15, None, 2 * 10**9, "OK")]
    bands = spark.createDataFrame(volume, "book int, book_seq long, side string, ord int, threshold_raw long, vwap_raw long, filled_raw long, status string")
    assert [(r.book_seq, r.line) for r in volume_lines(bands).collect()] == [(4, "1M: 1.250000000  5M+: only 2.000000000")]


def test_small_helpers(spark):
    row = spark.sql("SELECT 1500000000L AS raw, 50 AS bps").select(fixed.fixed_to_double(F.col("raw"), 9).alias("x"), labels.bps_label(F.col("bps")).alias("l")).first()
    assert (row.x, row.l) == (1.5, "50bps")
    levels = spark.createDataFrame([(1, "BID", 5, 2), (1, "ASK", 9, 1), (2, "BID", 5, 1)], "book int, side string, price_raw long, size_raw long")
    assert {r.book: r.spread_raw for r in client.spread(levels).collect()} == {1: 4, 2: None}
    actions = spark.createDataFrame([("v", 1, 0, 5, 0, "REQUEST_SNAPSHOT", None), ("v", 1, 0, 6, 0, "DELTA", 6)], "venue string, symbol int, conn_epoch long, recv_seq long, ord int, action string, message_seq long")
    assert [tuple(r) for r in sync.resync_requests(actions).collect()] == [("v", 1, 0, 5)]
