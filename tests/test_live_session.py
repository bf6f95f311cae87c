"""The streaming chain, live subscriptions and the live book's point access, over several micro-batches."""

import random

import pytest
from pyspark.sql import functions as F

from depthframe.operators import book, session
from depthframe.plans import fixture, session_fixture
from depthframe.sources.messages import write_in_order
from depthframe.streaming.book import live_book
from depthframe.streaming.price_index import PriceIndex
from depthframe.streaming.session import live_session
from test_session import ONE, SUBSCRIBED, TWO, binance, bybit, fetched
from test_streaming import rocksdb


class Dict(dict):
    reads = 0

    def get(self, key):
        self.reads += 1
        return super().get(key, 0)

    put = dict.__setitem__


def streamed(spark, folder, source, order, rows_per_file, make):
    write_in_order(source, order, f"{folder}/in", rows_per_file)
    with rocksdb(spark):
        rows = make(spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"))
        run = rows.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/out"), len([p for p in run.recentProgress if p["numInputRows"]])


def shown(rows):
    return sorted(map(tuple, rows.collect()), key=str)


def test_price_index():
    rng, cells, held = random.Random(2), Dict(), set()
    index = PriceIndex(cells)
    for _ in range(4000):
        price = rng.choice([rng.randrange(1, 300), rng.randrange(1, 1 << 62), (1 << 63) - 1 - rng.randrange(99)])
        (index.remove if price in held else index.add)("v", "BID", price)
        held ^= {price}
        assert index.best("v", "BID") == max(held, default=None) and index.best("v", "ASK") is None
    assert list(index.prices("v", "BID")) == sorted(held)
    cells.reads = 0
    index.best("v", "BID")
    assert cells.reads == 11  # whatever is held
    for price in list(held):
        index.remove("v", "BID", price)
    assert index.best("v", "BID") is None and not any(cells.values())


@pytest.mark.parametrize("point", [0, 10**9])
def test_book_by_points_and_as_a_whole(spark, testdata, tmp_path, point):
    rows = fixture.levels(spark, f"{testdata}/sf0.001").where("seq < 500").cache()
    got, batches = streamed(spark, str(tmp_path), rows, "seq", 700, lambda s: live_book(s, point=point))
    columns = ["book", "seq", "book_seq", "side", "price_raw", "size_raw"]
    assert batches >= 3 and shown(got.where("row_kind = 'DIFF'").select(columns)) == shown(book.l2_diffs(rows).select(columns))


def test_prices_beyond_floats(spark, tmp_path):
    """64-bit prices and sizes pass through pandas unchanged, beside rows without any."""
    rows = [(1, 1, 1, "SNAPSHOT", 1, "ASK", (1 << 62) + 1, (1 << 60) + 1), (1, 2, 2, "DELTA", 1, "ASK", (1 << 62) + 3, 7), (1, 1, 3, "INVALIDATE", 1, None, None, None)]
    frame = spark.createDataFrame(rows, "book int, venue int, seq long, kind string, pos int, side string, price_raw long, size_raw long")
    got, _ = streamed(spark, str(tmp_path), frame, "seq", 99, live_book)
    assert shown(got.where("row_kind = 'DIFF'").select("seq", "price_raw", "size_raw")) == [(1, (1 << 62) + 1, (1 << 60) + 1), (2, (1 << 62) + 3, 7), (3, (1 << 62) + 1, 0)]


@pytest.mark.parametrize("rows_per_file", [150, 10**6])
def test_session_stream_equals_the_batch_chain(spark, testdata, tmp_path, rows_per_file):
    raw = session_fixture.raw_texts(spark, f"{testdata}/sf0.001").cache()
    subscriptions = session_fixture.subscriptions(spark)
    levels = session.replay(raw, subscriptions).cache()
    places = levels.select("book", "seq", "recv_seq", "ord").distinct()
    wanted = book.l2_diffs(levels).join(places, ["book", "seq"]).select("book", "recv_seq", "ord", "book_seq", "side", "price_raw", "size_raw")
    got, batches = streamed(spark, str(tmp_path), raw, "recv_seq", rows_per_file, lambda s: live_session(s, subscriptions))
    got = got.where("row_kind = 'DIFF'").select("book", F.col("seq").alias("recv_seq"), "ord", "book_seq", "side", "price_raw", "size_raw")
    assert (batches >= 5) == (rows_per_file < 1000) and shown(got) == shown(wanted)


@pytest.mark.parametrize("rows_per_file", [1, 99])
def test_one_gap_drops_all_symbols_of_the_connection(spark, tmp_path, rows_per_file):
    """A's gap at 4 voids B and what comes later on the connection, also of a symbol that shows up only then; the next connection
    begins anew; a fetched venue's gap is its symbol's own; a message recorded twice counts once."""
    from depthframe.types import RAW_MESSAGES

    rows = [
        bybit(1, "AUSD", 7, ONE, "snapshot"), bybit(2, "BUSD", 3, ONE, "snapshot"), bybit(3, "AUSD", 8, TWO), bybit(3, "AUSD", 8, TWO), bybit(4, "AUSD", 10, ONE), bybit(5, "BUSD", 4, TWO),
        bybit(6, "CUSD", 1, ONE, "snapshot"), bybit(7, "BUSD", 9, TWO, "snapshot", 1), bybit(8, "CUSD", 2, TWO, "snapshot", 1),
        binance(9, "AUSD", 1, 5, ONE), fetched(10, "AUSD", 3, TWO), binance(11, "AUSD", 7, 9, ONE), binance(12, "AUSD", 10, 12, TWO), fetched(13, "AUSD", 10, ONE),
    ]
    names = "exchange string, market string, base string, quote string, venue string, native_symbol string"
    subscriptions = spark.createDataFrame([*SUBSCRIBED, ("BYBIT", "SPOT", "C", "USD", "bybit_spot", "CUSD")], names)
    raw = spark.createDataFrame(rows, RAW_MESSAGES)
    got, _ = streamed(spark, str(tmp_path), raw, "recv_seq", rows_per_file, lambda s: live_session(s, subscriptions))
    live = shown(got.where("row_kind = 'LIVE'").selectExpr("book", "seq", "live_venues"))
    assert [r for r in live if r[0][0] == "B"] == [("B_USD.SPOT", 2, "bybit_spot"), ("B_USD.SPOT", 4, ""), ("B_USD.SPOT", 7, "bybit_spot")]
    assert [r for r in live if r[0][0] == "C"] == [("C_USD.SPOT", 8, "bybit_spot")]
    diffs = got.where("row_kind = 'DIFF' AND book = 'A_USD.SPOT'").selectExpr("seq", "ord", "book_seq", "size_raw div 1000000 AS size").orderBy("seq", "ord")
    assert list(map(tuple, diffs.collect())) == [(1, 0, 1, 1), (3, 0, 2, 2), (4, -1, 3, 0), (10, 0, 4, 2), (10, 1, 5, 1), (11, 0, 6, 0), (13, 0, 7, 1), (13, 1, 8, 2)]


def test_subscription_from_each_books_own_revision(spark, testdata, tmp_path):
    levels = fixture.levels(spark, f"{testdata}/sf0.001").where("seq < 900").cache()
    diffs = book.l2_diffs(levels).cache()
    at = diffs.where("book_seq = 20 + 15 * book").select("book", "seq", "book_seq").distinct().where("book < 3")  # book 3 begins empty
    got, batches = streamed(spark, str(tmp_path), levels, "seq", 1500, lambda s: live_book(s, initial=book.venue_books_at(levels, at)))
    wanted = diffs.join(at.selectExpr("book", "book_seq AS n"), "book", "left").where("n IS NULL OR book_seq > n")
    columns = ["book", "seq", "book_seq", "side", "price_raw", "size_raw"]
    assert batches >= 2 and shown(got.where("row_kind = 'DIFF'").select(columns)) == shown(wanted.select(columns))


def test_batch_subscriptions(spark, testdata):
    diffs = book.l2_diffs(fixture.levels(spark, f"{testdata}/sf0.001").where("seq < 900")).cache()
    at = spark.createDataFrame([(0, 10), (1, 77), (2, 0)], "book int, from_revision long")
    got = shown(book.snapshots_then_diffs(diffs, at))
    assert got == shown(book.snapshot_then_diffs(diffs.where("book = 0"), 10).union(book.snapshot_then_diffs(diffs.where("book = 1"), 77)).union(book.snapshot_then_diffs(diffs.where("book = 2"), 0)))
