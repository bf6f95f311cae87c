"""Books and bands: small cases with known results, and a replay of the whole fixture in plain Python."""

import pytest
from pyspark.sql import functions as F

from depthframe.operators import bands, bbo, book, client, liveness
from depthframe.plans import fixture
from depthframe.sources import shared

P, S = 10**9, 10**6
SCHEMA = "book int, venue int, seq bigint, kind string, pos int, side string, price_raw bigint, size_raw bigint"


def levels(spark, *messages):
    """messages: (venue, kind, bids, asks), with levels as (price, size)."""
    rows = []
    for seq, (venue, kind, bids, asks) in enumerate(messages, 1):
        both = [("BID", *x) for x in bids] + [("ASK", *x) for x in asks]
        rows += [(0, venue, seq, kind, pos, side, int(p * P), int(z * S)) for pos, (side, p, z) in enumerate(both or [("BID", 1, 0)], 1)]
    return spark.createDataFrame(rows, SCHEMA)


def aggregate(df):
    return sorted((r.side, r.price_raw / P, r.size_raw / S) for r in df.collect())


def test_snapshot_replaces_both_sides_of_a_venue(spark):
    df = levels(spark, (0, "SNAPSHOT", [], [(100, 1), (101, 2)]), (1, "SNAPSHOT", [], [(100, 4)]), (0, "SNAPSHOT", [], [(100, 1), (102, 3)]))
    want = [("ASK", 100, 5), ("ASK", 102, 3)]
    assert aggregate(book.aggregate_book(book.venue_book(df))) == want
    assert aggregate(book.book_as_of(book.level_intervals(df), 3)) == want
    assert aggregate(book.book_as_of(book.level_intervals(df), 2)) == [("ASK", 100, 5), ("ASK", 101, 2)]


def test_invalidation_and_net_zero(spark):
    df = levels(spark, (0, "SNAPSHOT", [(99, 1)], [(101, 2)]), (1, "SNAPSHOT", [], [(101, 5)]), (0, "INVALIDATE", [], []), (1, "DELTA", [], [(101, 5)]), (0, "INVALIDATE", [], []))
    got = sorted((r.seq, r.book_seq, r.side, r.price_raw / P, r.size_raw / S) for r in book.l2_diffs(df).collect())
    assert got == [(1, 1, "ASK", 101, 2), (1, 1, "BID", 99, 1), (2, 2, "ASK", 101, 7), (3, 3, "ASK", 101, 5), (3, 3, "BID", 99, 0)]
    assert [tuple(r) for r in liveness.live_venues(df).collect()] == [(0, [1])]


def test_duplicate_prices(spark):
    df = levels(spark, (0, "SNAPSHOT", [(99, 1), (99, 2)], []), (0, "DELTA", [(98, 1), (98, 2)], []))
    assert aggregate(book.venue_book(df)) == [("BID", 98, 2), ("BID", 99, 1)]


def replay(rows):
    """Diffs by walking all messages in order."""
    held, total, out, number = {}, {}, [], {}
    messages = {}
    for r in rows:
        messages.setdefault((r.seq, r.book, r.venue, r.kind), []).append(r)
    for (seq, b, venue, kind), own in sorted(messages.items(), key=lambda x: x[0]):
        old = held.get((b, venue), {})
        new = {} if kind != "DELTA" else dict(old)
        if kind != "INVALIDATE":
            for r in sorted(own, key=lambda r: -r.pos if kind == "SNAPSHOT" else r.pos):
                new[r.side, r.price_raw] = r.size_raw
            new = {k: v for k, v in new.items() if v > 0}
        held[b, venue] = new
        changed = {k: new.get(k, 0) - old.get(k, 0) for k in old.keys() | new.keys() if new.get(k, 0) != old.get(k, 0)}
        if changed:
            number[b] = number.get(b, 0) + 1
        for k, d in changed.items():
            total[b, *k] = total.get((b, *k), 0) + d
            out.append((b, seq, number[b], *k, total[b, *k]))
    return sorted(out)


def test_diffs_equal_a_replay(spark, testdata):
    df = fixture.levels(spark, f"{testdata}/sf0.001")
    want = replay(df.collect())
    diffs = book.l2_diffs(df).cache()
    assert sorted(map(tuple, diffs.collect())) == want
    assert sorted(map(tuple, book.l2_diffs(df, block=64).collect())) == want
    small, large = (sorted(map(tuple, bbo.bbo_changes(diffs, n).collect()), key=str) for n in (37, 100_000))
    assert small == large
    last = {}
    for b, seq, n, side, price, size in want:
        last[b, side, price] = size
    final = sorted((b, s, p, z) for (b, s, p), z in last.items() if z)
    assert sorted(map(tuple, book.aggregate_book(book.venue_book(df)).collect())) == final
    stream = diffs.select("book", F.col("book_seq").alias("arrival"), "book_seq", F.lit("DIFF").alias("row_kind"), "side", "price_raw", "size_raw", F.lit(1).alias("pos"))
    assert sorted(map(tuple, client.client_book(stream).collect())) == final


def side(spark, name, *rows):
    return spark.createDataFrame([(0, name, int(p * P), int(z * S)) for p, z in rows], "book int, side string, price_raw bigint, size_raw bigint")


def price_rows(df):
    return [(r.bps, r.boundary_raw / P, r.cum_size_raw / S, r.cum_notional_raw / P) for r in sorted(df.collect(), key=lambda r: r.ord)]


def test_price_bands(spark):
    ask = side(spark, "ASK", (100, 5), (100.5, 3), (100.8, 2), (101, 4), (101.5, 1), (103, 10))
    assert price_rows(bands.price_bands(ask, [50, 100, 200])) == [(50, 100.5, 8, 801.5), (100, 101, 14, 1407.1), (200, 102, 15, 1508.6)]
    bid = side(spark, "BID", (100, 5), (99.5, 3), (99, 2), (98.5, 1))
    assert price_rows(bands.price_bands(bid, [50, 100])) == [(50, 99.5, 8, 798.5), (100, 99, 10, 996.5)]
    assert [r[0] for r in price_rows(bands.price_bands(bid, [50, 50]))] == [50, 50]
    for bad in ([100, 50], [-1], [10000]):
        with pytest.raises(ValueError):
            bands.price_bands(bid, bad)
    empty = bands.price_bands_at(bid, spark.createDataFrame([(0, 200 * P), (1, 0)], "book int, reference bigint"), [50])
    got = sorted((r.book, r.side, r.status, r.cum_size_raw) for r in empty.collect())
    assert got == [(0, "ASK", "OK", 0), (0, "BID", "OK", 0), (1, "ASK", "ARGUMENT_OUT_OF_DOMAIN", None), (1, "BID", "ARGUMENT_OUT_OF_DOMAIN", None)]


def test_bad_levels_fail_their_side_only(spark):
    ask = side(spark, "ASK", (100, 5), (100.1, -1), (200, 1)).union(side(spark, "BID", (99, 1)))
    got = {(r.side, r.status) for r in bands.price_bands(ask, [50]).collect()}
    assert got == {("ASK", "ARGUMENT_OUT_OF_DOMAIN"), ("BID", "OK")}
    # The walk stops at the first level beyond the widest band, so worse ones are not seen.
    far = side(spark, "ASK", (100, 5), (200, 1), (300, -1))
    assert {r.status for r in bands.price_bands(far, [50]).collect()} == {"OK"}
    got = {(r.side, r.status) for r in bands.volume_bands(far, [P]).collect()}
    assert got == {("ASK", "ARGUMENT_OUT_OF_DOMAIN"), ("BID", "OK")}
    huge = side(spark, "ASK", (9 * 10**9, 9 * 10**9))
    assert {r.status for r in bands.price_bands(huge, [50]).collect()} == {"RESULT_OUT_OF_RANGE"}


def volume_rows(df, name):
    return [(r.threshold_raw / P, r.vwap_raw and r.vwap_raw, r.filled_raw / P) for r in sorted(df.where(F.col("side") == name).collect(), key=lambda r: r.ord)]


def test_volume_bands(spark):
    ask = side(spark, "ASK", (100, 5), (125, 20), (150, 10))
    assert volume_rows(bands.volume_bands(ask, [500 * P, 3000 * P, 10000 * P]), "ASK") == [(500, 100 * P, 500), (3000, 120 * P, 3000), (10000, None, 4500)]
    assert volume_rows(bands.volume_bands(ask, [500 * P]), "BID") == [(500, None, 0)]
    assert volume_rows(bands.volume_bands(side(spark, "ASK", (3, 10)), [P]), "ASK") == [(1, 3 * P, 1)]
    assert volume_rows(bands.volume_bands(side(spark, "ASK", (100, 10), (200, 10)), [2000 * P]), "ASK") == [(2000, 133333333333, 2000)]
    edge = spark.createDataFrame([(0, "BID", 100 * P, S), (0, "BID", 1, 1_500_000)], "book int, side string, price_raw bigint, size_raw bigint")
    assert volume_rows(bands.volume_bands(edge, [100_000_000_002]), "BID")[0][1] == 40_000_000_001
    for bad in ([0], [2, 1]):
        with pytest.raises(ValueError):
            bands.volume_bands(ask, bad)


def test_consumer_gaps(spark):
    rows = [(0, a, n, "SNAPSHOT" if a == 1 else "DIFF", "BID", P, S * a, 1) for a, n in enumerate((5, 6, 6, 8, 7), 1)]
    df = spark.createDataFrame(rows, "book int, arrival bigint, book_seq bigint, row_kind string, side string, price_raw bigint, size_raw bigint, pos int")
    assert sorted((r.arrival, r.expected, r.book_seq) for r in client.gaps(df).collect()) == [(3, 7, 6), (4, 7, 8), (5, 9, 7)]
    assert client.before_first_gap(df).count() == 2
    assert tuple(client.run_summary(df).first()) == (0, 1, 4, 3, 5, 7)


def test_one_level_is_many_tasks(spark):
    """The history of one price of one venue is sorted by spans, not as a whole, and its rows are those of any other span."""
    rows = [(1, 1, i, "DELTA" if i % 50 else "SNAPSHOT", 1, "BID", 100 * P, (i % 7) * S) for i in range(1, 400)]
    df = spark.createDataFrame(rows, "book int, venue int, seq long, kind string, pos int, side string, price_raw long, size_raw long")
    shown = lambda x: sorted(map(tuple, x.collect()), key=str)
    parts = lambda x: x.select(F.spark_partition_id()).distinct().count()
    short, long = book.level_intervals(df, block=1), book.level_intervals(df)
    assert shown(short) == shown(long) and parts(short) > 1
    assert shown(book.changes(short, block=1)) == shown(book.changes(long)) and parts(book.changes(short, block=1)) > 1
    assert shown(book.l2_diffs(df, block=1)) == shown(book.l2_diffs(df))


def test_client_book_is_not_sorted(spark, capsys):
    """The consumer's book is aggregated by hash, from rows that are not dealt by book."""
    rows = [(1, a, a, "SNAPSHOT" if a in (1, 5) else "DIFF", "BID", price, size, pos) for a, price, size, pos in [(1, 9, 1, 1), (1, 8, 2, 2), (2, 9, 3, 1), (5, 7, 4, 1), (5, 7, 5, 2), (6, 6, 0, 1)]] + [(2, 3, 3, "DIFF", "ASK", 4, 1, 1)]
    stream = spark.createDataFrame(rows, "book int, arrival long, book_seq long, row_kind string, side string, price_raw long, size_raw long, pos int")
    found = client.client_book(stream)
    assert sorted(map(tuple, found.collect())) == [(1, "BID", 7, 5), (2, "ASK", 4, 1)]
    found.explain()
    assert "SortAggregate" not in capsys.readouterr().out


def test_tasks_follow_the_rows(spark, testdata, monkeypatch):
    """What is sorted or aggregated by revisions is dealt over as many tasks as its rows ask for, whatever the session's number of them is."""
    parts = lambda x: x.select(F.spark_partition_id()).distinct().count()
    rows = fixture.levels(spark, f"{testdata}/sf0.001")
    diffs = book.l2_diffs(rows, 64)
    want = sorted(map(tuple, diffs.collect()))
    stream = fixture.client_stream(diffs.cache())
    tops = bbo.bbo_changes(diffs, 16).cache()
    made = lambda: [book.l2_diffs(rows, 64), bbo.bbo_changes(diffs, 16), client.bbo_at_diffs(diffs, tops, 16), client.updates(stream, 16)]
    few = made()
    monkeypatch.setattr(shared, "TASK_ROWS", 300)
    many = made()
    assert all(parts(x) <= 4 for x in few) and all(parts(x) > 12 for x in many)
    for a, b in zip(few, many, strict=True):
        assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)
    assert sorted(map(tuple, many[0].collect())) == want


def test_best_prices_at_diffs(spark):
    """A side that became empty stays NULL until the next change; revisions without a change take the last one, over blocks too."""
    diffs = spark.createDataFrame([(0, n) for n in (1, 2, 3, 4, 4, 7, 9)], "book int, book_seq bigint")
    changes = spark.createDataFrame([(0, 1, 5, 1, None, None), (0, 3, None, None, 8, 2), (0, 7, None, None, None, None)], "book int, book_seq bigint, bid_price_raw bigint, bid_size_raw bigint, ask_price_raw bigint, ask_size_raw bigint")
    want = [(0, 1, 5, 1, None, None), (0, 2, 5, 1, None, None), (0, 3, None, None, 8, 2), (0, 4, None, None, 8, 2), (0, 7, None, None, None, None), (0, 9, None, None, None, None)]
    for block in (1, 2, 4096):
        assert sorted(map(tuple, client.bbo_at_diffs(diffs, changes, block).collect())) == want
