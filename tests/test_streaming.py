"""The live book over several micro-batches equals the batch operators."""

import time
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from depthframe.operators import bbo, book, sync
from depthframe.plans import fixture
from depthframe.sources.messages import stream_table, write_in_order
from depthframe.streaming.book import live_book, silent_sessions
from depthframe.streaming.silence import live_silence
from depthframe.streaming.sync import live_sync


@contextmanager
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(key)


def test_live_book_over_batches(spark, testdata, tmp_path):
    rows = fixture.levels(spark, f"{testdata}/sf0.001").where("seq < 600").cache()
    for k in range(3):
        rows.where(f"seq div 200 = {k}").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    with rocksdb(spark):
        source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        live = live_book(source)
        run = live.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        run.awaitTermination()
        assert len(run.recentProgress) >= 3
    got = spark.read.schema(live.schema).parquet(str(tmp_path / "out"))
    diffs = book.l2_diffs(rows)
    columns = ["book", "seq", "book_seq", "side", "price_raw", "size_raw"]
    assert sorted(map(tuple, got.where("row_kind = 'DIFF'").select(columns).collect())) == sorted(map(tuple, diffs.select(columns).collect()))
    side = lambda s: F.max(F.when(F.col("side") == s, F.struct("price_raw", "size_raw")))
    tops = got.where("row_kind = 'BBO'").groupBy("book", "seq", "book_seq").agg(side("BID").alias("b"), side("ASK").alias("a"))
    tops = tops.select("book", "seq", "book_seq", "b.price_raw", "b.size_raw", "a.price_raw", "a.size_raw")
    assert sorted(map(tuple, tops.collect()), key=str) == sorted(map(tuple, bbo.bbo_changes(diffs).collect()), key=str)


def test_bad_levels_and_late_rows(spark, tmp_path):
    """A message with a bad level voids its venue; rows at or before the applied seq are dropped."""
    rows = [
        (0, (1, 1, 10, "SNAPSHOT", 1, "BID", 5, 2)),
        (0, (1, 2, 20, "SNAPSHOT", 1, "BID", 5, 1)),
        (1, (1, 1, 30, "DELTA", 1, "BID", 6, 1)),
        (1, (1, 1, 30, "DELTA", 2, "ASK", 0, 1)),
        (2, (1, 2, 15, "DELTA", 1, "BID", 9, 9)),
        (2, (1, 1, 40, "SNAPSHOT", 1, "BID", 7, 1)),
    ]
    schema = "book int, venue int, seq long, kind string, pos int, side string, price_raw long, size_raw long"
    for k in range(3):
        spark.createDataFrame([r for b, r in rows if b == k], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    with rocksdb(spark):
        live = live_book(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
        run = live.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        run.awaitTermination()
    got = spark.read.schema(live.schema).parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, got.where("row_kind = 'DIFF'").select("seq", "book_seq", "price_raw", "size_raw").collect())) == [(10, 1, 5, 2), (20, 2, 5, 3), (30, 3, 5, 1), (40, 4, 7, 1)]
    assert sorted(map(tuple, got.where("row_kind = 'LIVE'").select("seq", "live_venues").collect())) == [(10, "1"), (20, "1,2"), (30, "2"), (40, "1,2")]


def test_heartbeats_by_the_clock(spark, tmp_path):
    schema = "book int, venue int, seq long, kind string, pos int, side string, price_raw long, size_raw long"
    spark.createDataFrame([(1, 3, 10, "SNAPSHOT", 1, "BID", 5, 2)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    with rocksdb(spark):
        live = live_book(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), heartbeat_ms=200)
        run = live.writeStream.format("memory").queryName("beats").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="200 milliseconds").start()
        try:
            until = time.time() + 90
            while time.time() < until and spark.table("beats").where("row_kind = 'LIVE'").count() < 3:
                time.sleep(0.5)
        finally:
            run.stop()
    beats = spark.table("beats").where("row_kind = 'LIVE'").select("seq", "book_seq", "live_venues").collect()
    assert len(beats) >= 3 and set(map(tuple, beats[1:])) == {(10, 1, "3")}


@pytest.mark.parametrize("policy", ["futures", "bybit"])
def test_live_sync_over_batches(spark, testdata, tmp_path, policy):
    rows = fixture.updates(spark, f"{testdata}/sf0.001").where("recv_seq < 1200").cache()
    for k in range(3):
        rows.where(f"recv_seq div 400 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    with rocksdb(spark):
        live = live_sync(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), policy)
        run = live.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        run.awaitTermination()
    got = spark.read.schema(live.schema).parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, sync.sync_actions(rows, policy).collect()), key=str)


def test_silent_sessions(spark, tmp_path):
    rows = spark.sql("SELECT 1 AS venue, timestamp_seconds(s) AS ts, 30 AS timeout FROM VALUES (0), (10), (100), (105), (500) AS t(s)")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    sessions = silent_sessions(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "1 second")
    run = stream_table(sessions.select("venue", F.unix_seconds("session.start").alias("start"), "messages"), str(tmp_path / "out"), str(tmp_path / "state"), ("venue",))
    try:
        run.processAllAvailable()
    finally:
        run.stop()
    got = sorted((r.start, r.messages) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(0, 2), (100, 2)]


def test_silence_by_event_time(spark, tmp_path):
    """Venue 1 is silent, is heard again, and falls silent for good; venue 2's longer timeout never passes; venue 3 only just lasts."""
    rows = [(1, 0, 30), (2, 0, 900), (1, 10, 30), (3, 10, 40), (3, 50, 40), (1, 100, 30), (2, 100, 900), (3, 91, 40), (2, 400, 900), (3, 130, 40), (3, 400, 40)]
    frame = spark.createDataFrame(rows, "venue int, s long, timeout int").selectExpr("venue", "timestamp_seconds(s) AS ts", "timeout")
    write_in_order(frame, "ts", str(tmp_path / "in"), 2)
    with rocksdb(spark):
        found = live_silence(spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
        run = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        run.awaitTermination()
    got = spark.read.schema(found.schema).parquet(str(tmp_path / "out")).selectExpr("venue", "status", "unix_seconds(silent_from) AS s", "silent_us", "timeout").collect()
    closed = sorted(tuple(r) for r in got if r.status == "CLOSED")
    assert closed == [(1, "CLOSED", 10, 90_000_000, 30), (3, "CLOSED", 50, 41_000_000, 40), (3, "CLOSED", 130, 270_000_000, 40)]
    opened = {(r.venue, r.s) for r in got if r.status == "OPEN"}
    assert (1, 100) in opened and opened <= {(1, 10), (1, 100), (3, 50), (3, 130)}
