"""The registered queries: each operator over tables derived from the given ones, and the same rows as SQL."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depthframe.functions import fixed, labels, symbols
from depthframe.operators import bands, bbo, book, client, liveness, normalize, revision_bands, routing, session, sync, sync_sets, time_travel
from depthframe.sources.messages import read_raw_messages, write_in_order
from depthframe.sources.shared import materialize, scratch
from depthframe.sources.sinks import read_output, stream_outputs
from depthframe.streaming.book import live_book
from depthframe.streaming.session import live_session
from depthframe.streaming.silence import live_silence

from . import fixture, session_fixture
from . import oracles as sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable:
    def add(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[function.__name__] = function
        if oracle:
            ORACLES[function.__name__] = oracle
        return function

    return add


def _diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.l2_diffs(fixture.levels(spark, sf_dir))


def _diffs_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The diffs, written once for what reads them several times or counts them."""
    return materialize(_diffs(spark, sf_dir), "diffs")


def _final(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.aggregate_book(book.venue_book(fixture.levels(spark, sf_dir)))


# Books

BPS = (50, 100, 200, 500, 1000)
#: Notionals of 50, 500, 5,000 and 5,000,000: the last is more than a side holds.
NOTIONALS = tuple(n * 10**9 for n in (50, 500, 5_000, 5_000_000))
TICK = 1000


@query(f"{sql.BASE} SELECT book, venue, side, price_raw, size_raw FROM iv WHERE to_seq IS NULL")
def venue_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.venue_book(fixture.levels(spark, sf_dir))


@query(f"{sql.BASE}, {sql.AGG} SELECT * FROM agg")
def aggregate_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _final(spark, sf_dir)


@query(f"{sql.BASE} SELECT * FROM iv")
def level_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.level_intervals(fixture.levels(spark, sf_dir))


@query(f"{sql.FULL} SELECT * FROM diffs")
def l2_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diffs(spark, sf_dir)


@query(f"{sql.FULL} SELECT book, min(book_seq) AS first_seq, max(book_seq) AS last_seq, count(DISTINCT book_seq) AS revisions, count(DISTINCT book_seq) = max(book_seq) AS contiguous FROM diffs GROUP BY book")
def book_seq_contiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = _diffs(spark, sf_dir).select("book", "book_seq").distinct()
    n = F.count(F.lit(1))
    return once.groupBy("book").agg(F.min("book_seq").alias("first_seq"), F.max("book_seq").alias("last_seq"), n.alias("revisions"), (n == F.max("book_seq")).alias("contiguous"))


@query(f"{sql.BASE}, m AS (SELECT max(seq) // 2 AS n FROM lv) SELECT book, side, price_raw, CAST(sum(size_raw) AS BIGINT) AS size_raw FROM iv, m WHERE from_seq <= n AND (to_seq IS NULL OR to_seq > n) GROUP BY ALL")
def book_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture.levels(spark, sf_dir)
    at = fixture.read(spark, sf_dir, "lineitem").agg(F.expr("max(l_orderkey) div 2").alias("at"))
    intervals = book.level_intervals(rows).crossJoin(F.broadcast(at))  # one row
    return book.book_as_of(intervals, F.col("at"))


_URGENT = "p AS (SELECT CAST(o_orderkey % 4 AS INT) AS book, o_orderkey AS seq FROM orders WHERE o_orderpriority = '1-URGENT')"


def _urgent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in time: a book just after each urgent order."""
    return fixture.read(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").selectExpr("CAST(o_orderkey % 4 AS INT) AS book", "o_orderkey AS seq")


@query(f"""{sql.BASE}, {_URGENT} SELECT p.book, p.seq, side, price_raw, CAST(sum(size_raw) AS BIGINT) AS size_raw
FROM p JOIN iv ON iv.book = p.book AND from_seq <= p.seq AND (to_seq IS NULL OR to_seq > p.seq) GROUP BY ALL""")
def books_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return time_travel.books_as_of(book.level_intervals(fixture.levels(spark, sf_dir)), _urgent(spark, sf_dir))


@query(f"""{sql.FULL}, {_URGENT}, r AS (SELECT DISTINCT d.book, d.seq, book_seq FROM diffs d JOIN p ON d.book = p.book AND d.seq = p.seq)
SELECT r.book, r.book_seq, side, price_raw, CAST(sum(size_raw) AS BIGINT) AS size_raw
FROM r JOIN iv ON iv.book = r.book AND from_seq <= r.seq AND (to_seq IS NULL OR to_seq > r.seq) GROUP BY ALL""")
def books_from_keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The book at the revisions that urgent orders made, from keyframes."""
    diffs = _diffs_table(spark, sf_dir)
    root = f"{scratch(spark)}/keyframes-{uuid.uuid4().hex}"
    time_travel.write_keyframes(diffs, root)
    at = diffs.join(_urgent(spark, sf_dir), ["book", "seq"]).select("book", "book_seq")
    return time_travel.books_from_keyframes(spark.read.parquet(root), at)


@query(f"{sql.FULL}, p AS (SELECT book, max(book_seq) // 3 AS n FROM diffs GROUP BY book), s AS (SELECT d.book, side, price_raw, arg_max(size_raw, book_seq) AS size_raw FROM diffs d JOIN p ON d.book = p.book AND d.book_seq <= p.n GROUP BY ALL) SELECT * FROM s WHERE size_raw > 0")
def book_at_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    diffs = _diffs_table(spark, sf_dir)
    third = diffs.groupBy("book").agg(F.expr("max(book_seq) div 3").alias("third"))
    return book.book_at_revision(diffs.join(third, "book"), F.col("third"))


@query(f"{sql.FULL}, s AS (SELECT book, side, price_raw, arg_max(size_raw, book_seq) AS size_raw FROM diffs WHERE book_seq <= 100 GROUP BY ALL) SELECT book, CAST(100 AS BIGINT) AS book_seq, 'SNAPSHOT' AS row_kind, side, price_raw, size_raw FROM s WHERE size_raw > 0 UNION ALL SELECT book, book_seq, 'DIFF', side, price_raw, size_raw FROM diffs WHERE book_seq > 100")
def snapshot_then_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.snapshot_then_diffs(_diffs_table(spark, sf_dir), 100)


@query(f"{sql.BASE}, {sql.AGG} {sql.BEST.format(keys='book', source='agg')}")
def bbo_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.bbo(_final(spark, sf_dir))


@query(f"{sql.FULL}, {sql.HELD}, {sql.BBO} SELECT * FROM bbo")
def bbo_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bbo.bbo_changes(_diffs_table(spark, sf_dir))


@query(f"""{sql.FULL}, {sql.HELD}, {sql.BBO} SELECT book, seq // 600 * 600 AS window_s, seq, book_seq, bid_price_raw, bid_size_raw, ask_price_raw, ask_size_raw
FROM bbo QUALIFY row_number() OVER (PARTITION BY book, seq // 600 ORDER BY book_seq DESC) = 1""")
def bbo_conflated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest best prices of every book in every ten minutes, seq taken as seconds."""
    rows = bbo.bbo_changes(_diffs_table(spark, sf_dir)).withColumn("ts", F.timestamp_seconds("seq"))
    newest = bbo.conflate(rows, "10 minutes")
    return newest.withColumn("window_s", F.unix_seconds("window_start")).drop("window_start", "ts")


@query(f"{sql.FULL} SELECT d.book, d.seq, count(*) FILTER (size_raw = 0) AS removed, count(*) FILTER (size_raw > 0) AS reduced FROM diffs d JOIN (SELECT DISTINCT book, seq FROM lv WHERE kind = 'INVALIDATE') g ON d.book = g.book AND d.seq = g.seq GROUP BY ALL")
def invalidate_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.invalidations(fixture.levels(spark, sf_dir), _diffs(spark, sf_dir))


@query(f"""WITH {sql.LV}, l AS (SELECT book, venue, (seq + {TICK - 1}) // {TICK} AS t, arg_max(kind, seq) AS kind FROM lv GROUP BY ALL),
s AS (SELECT *, lead(t) OVER (PARTITION BY book, venue ORDER BY t) AS nxt, max(t) OVER (PARTITION BY book) AS e FROM l),
x AS (SELECT book, venue, unnest(range(t, coalesce(nxt - 1, e) + 1)) AS t FROM s WHERE kind <> 'INVALIDATE')
SELECT book, CAST(t * {TICK} AS BIGINT) AS tick, array_to_string(list_sort(list(venue)), ',') AS live_venues FROM x GROUP BY ALL""")
def live_venues_at_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return liveness.live_venues_at_ticks(fixture.levels(spark, sf_dir), TICK).withColumn("live_venues", F.array_join("live_venues", ","))


@query(f"WITH {sql.LV}, l AS (SELECT book, venue, arg_max(kind, seq) AS kind FROM lv GROUP BY ALL) SELECT book, array_to_string(coalesce(list_sort(list(venue) FILTER (kind <> 'INVALIDATE')), []), ',') AS live_venues FROM l GROUP BY book")
def live_venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return liveness.live_venues(fixture.levels(spark, sf_dir)).withColumn("live_venues", F.array_join("live_venues", ","))


# Bands


@query(f"{sql.BASE}, {sql.AGG} {sql.price_bands('agg', 'book', sql.OWN_BEST.format(keys='book'), BPS)}")
def price_bands_bbo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bands.price_bands(_final(spark, sf_dir), BPS)


_MID = f"{sql.BASE}, {sql.AGG}, mid AS (SELECT book, (max(price_raw) FILTER (side = 'BID') + min(price_raw) FILTER (side = 'ASK')) // 2 AS reference FROM agg GROUP BY book), both_sides AS (SELECT m.book, s.side, m.reference, a.price_raw, a.size_raw FROM mid m CROSS JOIN (VALUES ('BID'), ('ASK')) AS s(side) LEFT JOIN agg a ON a.book = m.book AND a.side = s.side WHERE m.reference IS NOT NULL)"


@query(f"{_MID} {sql.price_bands('both_sides', 'book', 'SELECT * FROM {source}', BPS)}")
def price_bands_mid(spark: SparkSession, sf_dir: str) -> DataFrame:
    final = _final(spark, sf_dir)
    return bands.price_bands_at(final, bands.mid_references(book.bbo(final)), BPS)


@query(f"{sql.BASE}, {sql.AGG}, {sql.volume_bands(NOTIONALS)}")
def volume_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bands.volume_bands(_final(spark, sf_dir), NOTIONALS)


_ALIVE = f"{sql.FULL}, {sql.HELD}, every_one AS (SELECT book, book_seq, side, price_raw, size_raw FROM alive)"


@query(f"{_ALIVE} {sql.price_bands('every_one', 'book, book_seq', sql.OWN_BEST.format(keys='book, book_seq'), BPS)}")
def bands_by_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revision_bands.price_bands_by_revision(_diffs_table(spark, sf_dir), BPS)


@query(f"{_ALIVE}, {sql.volume_bands(NOTIONALS, 'every_one', 'book, book_seq')}")
def volume_bands_by_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revision_bands.volume_bands_by_revision(_diffs_table(spark, sf_dir), NOTIONALS)


@query(f"{sql.BASE}, {sql.AGG} SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY book, side ORDER BY CASE WHEN side = 'BID' THEN -price_raw ELSE price_raw END) AS INT) AS depth FROM agg) WHERE depth <= 5")
def top_n_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.top_n(_final(spark, sf_dir), 5)


# Consumers


def _client_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the consumer receives, whose plan names the diffs twice; the chain before them runs once."""
    return fixture.client_stream(_diffs_table(spark, sf_dir))


@query(f"{sql.FULL}, {sql.CLIENT}, held AS (SELECT book, side, price_raw, arg_max(size_raw, arrival) AS size_raw FROM stream GROUP BY ALL) SELECT * FROM held WHERE size_raw > 0")
def client_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    return client.client_book(_client_stream(spark, sf_dir))


@query(f"{sql.FULL}, {sql.CLIENT} SELECT * FROM gap")
def client_gap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return client.gaps(_client_stream(spark, sf_dir))


@query(f"{sql.FULL}, {sql.CLIENT}, stop AS (SELECT book, min(arrival) AS stop FROM gap GROUP BY book) SELECT s.book, arrival, book_seq, side, price_raw, size_raw FROM stream s LEFT JOIN stop ON s.book = stop.book WHERE stop IS NULL OR arrival < stop")
def client_stop_at_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return client.before_first_gap(_client_stream(spark, sf_dir)).drop("row_kind", "pos")


@query(f"""{sql.FULL}, {sql.HELD}, {sql.BBO} SELECT book, book_seq, last_value(b.bid_price_raw IGNORE NULLS) OVER w AS bid_price_raw, last_value(b.ask_price_raw IGNORE NULLS) OVER w AS ask_price_raw
FROM (SELECT r.book, r.book_seq, b.bid_price_raw, b.ask_price_raw FROM revs r LEFT JOIN bbo b ON r.book = b.book AND r.book_seq = b.book_seq) b
WINDOW w AS (PARTITION BY book ORDER BY book_seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def bbo_l2_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    diffs = _diffs_table(spark, sf_dir)
    return client.bbo_at_diffs(diffs, materialize(bbo.bbo_changes(diffs), "diffs-bbo")).select("book", "book_seq", "bid_price_raw", "ask_price_raw")


@query(f"{sql.FULL}, {sql.CLIENT} SELECT book, count(*) FILTER (row_kind = 'SNAPSHOT') AS snapshots, count(*) FILTER (row_kind = 'DIFF') AS diffs, count(*) FILTER (book_seq <> previous + 1) AS gaps, CAST(sum(levels) AS BIGINT) AS levels, max(book_seq) AS last_book_seq FROM upd GROUP BY book")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return client.run_summary(_client_stream(spark, sf_dir))


# Sequence rules

_UPD = f"upd AS ({fixture.UPDATES_SQL.format(div='//', orders='orders')})"
_LAG = "lag(final_id) OVER (PARTITION BY venue, symbol, conn_epoch ORDER BY recv_seq)"
_UNIT = "upd AS (SELECT * REPLACE (unit_id AS final_id, unit_id AS first_id) FROM upd0)"


def _gaps_sql(condition: str, unit: bool = False) -> str:
    source = f"{_UPD.replace('upd AS', 'upd0 AS', 1)}, {_UNIT}" if unit else _UPD
    return f"WITH {source}, g AS (SELECT *, {_LAG} AS previous_id FROM upd WHERE kind = 'DELTA') SELECT venue, symbol, conn_epoch, recv_seq, previous_id, first_id, final_id FROM g WHERE NOT ({condition})"


def _unit_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture.updates(spark, sf_dir).withColumn("final_id", F.col("unit_id")).withColumn("first_id", F.col("unit_id"))


@query(_gaps_sql("prev_final_id = previous_id"))
def seq_gaps_futures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.sequence_gaps(fixture.updates(spark, sf_dir), "futures")


@query(_gaps_sql("first_id = previous_id + 1"))
def seq_gaps_spot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.sequence_gaps(fixture.updates(spark, sf_dir), "spot")


@query(_gaps_sql("final_id = previous_id + 1", unit=True))
def seq_gaps_bybit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.sequence_gaps(_unit_updates(spark, sf_dir), "bybit")


@query(_gaps_sql("prev_final_id = previous_id"))
def seq_gaps_okx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.sequence_gaps(fixture.updates(spark, sf_dir), "okx")


_BRIDGE = f"""{_UPD}, ids AS (SELECT venue, symbol, conn_epoch, recv_seq, unnest(range(first_id, final_id + 1)) AS id FROM upd WHERE kind = 'DELTA'),
bridge AS (SELECT s.venue, s.symbol, s.conn_epoch, s.recv_seq AS snapshot_seq, s.last_update_id, min(i.recv_seq) AS bridge_seq
  FROM upd s JOIN ids i ON s.venue = i.venue AND s.symbol = i.symbol AND s.conn_epoch = i.conn_epoch AND s.last_update_id = i.id WHERE s.kind = 'SNAPSHOT' GROUP BY ALL)"""


@query(f"WITH {_BRIDGE} SELECT * FROM bridge")
def snapshot_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.snapshot_bridges(fixture.updates(spark, sf_dir), "futures")


@query(f"""WITH {_BRIDGE}, g AS (SELECT *, {_LAG} AS previous_id FROM upd WHERE kind = 'DELTA'),
r AS (SELECT *, sum(CASE WHEN prev_final_id <> previous_id THEN 1 ELSE 0 END) OVER (PARTITION BY venue, symbol, conn_epoch ORDER BY recv_seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM g),
n AS (SELECT *, row_number() OVER w AS nth, count(*) OVER (PARTITION BY venue, symbol, conn_epoch, run) AS n, max(recv_seq) OVER (PARTITION BY venue, symbol, conn_epoch, run) AS last_seq FROM r WINDOW w AS (PARTITION BY venue, symbol, conn_epoch, run ORDER BY recv_seq))
SELECT b.venue, b.symbol, b.conn_epoch, b.snapshot_seq, b.last_update_id, b.bridge_seq, n.last_seq, n.n - n.nth + 1 AS updates
FROM bridge b JOIN n ON b.venue = n.venue AND b.symbol = n.symbol AND b.conn_epoch = n.conn_epoch AND b.bridge_seq = n.recv_seq""")
def sync_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.sync_episodes(fixture.updates(spark, sf_dir), "futures")


# The state machine, all connections one message further at each step: held updates as a list, actions as a list.
_ACTIONS = f"""WITH RECURSIVE {_UPD}, m AS (SELECT *, row_number() OVER (PARTITION BY venue, symbol, conn_epoch ORDER BY recv_seq) AS n FROM upd),
st AS (
  SELECT venue, symbol, conn_epoch, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS recv_seq, false AS live, CAST(0 AS BIGINT) AS last,
    CAST([] AS STRUCT(s BIGINT, f BIGINT, e BIGINT, p BIGINT)[]) AS held, CAST([] AS STRUCT(a VARCHAR, m BIGINT)[]) AS acts FROM m GROUP BY venue, symbol, conn_epoch
  UNION ALL
  SELECT venue, symbol, conn_epoch, n, recv_seq,
    CASE WHEN kind = 'DELTA' THEN live AND prev_final_id = last WHEN start = 0 THEN live ELSE cut IS NULL END,
    CASE WHEN kind = 'DELTA' THEN CASE WHEN NOT live THEN last WHEN prev_final_id = last THEN final_id ELSE 0 END WHEN start = 0 THEN last WHEN cut IS NULL THEN rest[len(rest)].e ELSE 0 END,
    CASE WHEN kind = 'DELTA' THEN CASE WHEN NOT live THEN list_append(held, me) WHEN prev_final_id = last THEN [] ELSE [me] END WHEN start = 0 THEN kept WHEN cut IS NULL THEN [] ELSE rest[cut:] END,
    list_concat(CASE WHEN n = 1 THEN [{{'a': 'REQUEST_SNAPSHOT', 'm': CAST(NULL AS BIGINT)}}] ELSE [] END,
      CASE WHEN kind = 'DELTA' THEN CASE WHEN NOT live THEN [] WHEN prev_final_id = last THEN [{{'a': 'DELTA', 'm': recv_seq}}] ELSE [{{'a': 'INVALIDATE', 'm': CAST(NULL AS BIGINT)}}] END
        WHEN start = 0 THEN [{{'a': 'REQUEST_SNAPSHOT', 'm': CAST(NULL AS BIGINT)}}]
        ELSE list_concat([{{'a': 'SNAPSHOT', 'm': recv_seq}}], list_transform(rest[1:coalesce(cut - 1, len(rest))], lambda h: {{'a': 'DELTA', 'm': h.s}}), CASE WHEN cut IS NULL THEN [] ELSE [{{'a': 'INVALIDATE', 'm': CAST(NULL AS BIGINT)}}] END) END)
  FROM (SELECT *, list_filter(range(2, len(rest) + 1), lambda i: rest[i].p <> rest[i - 1].e)[1] AS cut
    FROM (SELECT *, kept[start:] AS rest
      FROM (SELECT *, coalesce(list_position(list_transform(kept, lambda h: h.f <= last_update_id AND last_update_id <= h.e), true), 0) AS start
        FROM (SELECT m.*, st.live, st.last, st.held, list_filter(st.held, lambda h: h.e >= m.last_update_id) AS kept, {{'s': m.recv_seq, 'f': m.first_id, 'e': m.final_id, 'p': m.prev_final_id}} AS me
          FROM st JOIN m ON st.venue = m.venue AND st.symbol = m.symbol AND st.conn_epoch = m.conn_epoch AND m.n = st.n + 1))))
) SELECT venue, symbol, conn_epoch, recv_seq, CAST(i - 1 AS INT) AS ord, acts[i].a AS action, acts[i].m AS message_seq FROM (SELECT *, unnest(range(1, len(acts) + 1)) AS i FROM st)"""


@query(_ACTIONS)
def sync_actions_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.sync_actions(fixture.updates(spark, sf_dir), "futures")


@query(_ACTIONS)
def sync_actions_by_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync_sets.sync_actions_by_sets(fixture.updates(spark, sf_dir), "futures")


@query(f"WITH {_UPD}, f AS (SELECT venue, symbol, conn_epoch, min(recv_seq) AS recv_seq FROM upd GROUP BY ALL) SELECT venue, symbol, recv_seq FROM (SELECT *, lag(conn_epoch) OVER (PARTITION BY venue, symbol ORDER BY conn_epoch) AS p FROM f) WHERE p IS NOT NULL")
def disconnect_resets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.disconnect_resets(fixture.updates(spark, sf_dir))


# The whole chain

_CHAIN = f"WITH {session_fixture.LEVELS_SQL}, {sql.ONCE}, {sql.IV}"


def _replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The level table of the fixture's texts, which are first recorded as files, like those of a real session."""
    root = f"{scratch(spark)}/session-{uuid.uuid4().hex}"
    session_fixture.raw_texts(spark, sf_dir).write.parquet(root)
    return session.replay(read_raw_messages(spark, root, "parquet"), session_fixture.subscriptions(spark))


#: The session's SQL places what is done to a book at its trigger's recv_seq times 2**20, plus its rank among what it triggers.
_PLACE = "recv_seq * 1048576 + ord + 1"


@query(f"{_CHAIN}, {sql.DIFF} SELECT * FROM diffs")
def session_l2_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = materialize(_replayed(spark, sf_dir), "session-levels")
    places = levels.selectExpr("book", "seq", f"{_PLACE} AS place").distinct()
    return book.l2_diffs(levels).join(places, ["book", "seq"]).drop("seq").withColumnRenamed("place", "seq")


@query(f"WITH {session_fixture.LEVELS_SQL} SELECT book, venue, seq, kind, count(price_raw) AS levels FROM lv GROUP BY ALL HAVING kind <> 'DELTA' OR count(price_raw) > 0")
def session_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replayed(spark, sf_dir).groupBy("book", "venue", F.expr(_PLACE).alias("seq"), "kind").agg(F.count("price_raw").alias("levels"))


# Messages

_FAULTY = f"""{sql.LV}, bad AS (SELECT * REPLACE (CASE WHEN seq % 211 = 0 AND pos = 1 THEN -1 ELSE size_raw END AS size_raw, CASE WHEN seq % 307 = 0 AND pos = 2 THEN 0 ELSE price_raw END AS price_raw) FROM lv)"""


@query(f"WITH {_FAULTY} SELECT book, venue, seq, count(*) FILTER (kind <> 'INVALIDATE' AND (price_raw <= 0 OR size_raw < 0)) AS bad_levels, count(*) AS levels FROM bad GROUP BY ALL HAVING count(*) FILTER (kind <> 'INVALIDATE' AND (price_raw <= 0 OR size_raw < 0)) > 0")
def reject_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.split_rejected(fixture.faulty_levels(spark, sf_dir))[1]


_VENUE_NAMES = "['binance_spot', 'binance_futures', 'bybit_spot', 'bybit_linear', 'okx_spot', 'okx_swap']"


@query(f"""WITH m AS (SELECT o_orderkey AS k, ({_VENUE_NAMES})[o_orderkey % 6 + 1] AS venue, (o_orderkey // 6) % 20 AS shape FROM orders),
s AS (SELECT *, CASE WHEN shape = 0 OR shape = 2 THEN 'MALFORMED' WHEN shape = 1 THEN 'IGNORED' WHEN shape = 3 THEN 'SNAPSHOT' ELSE 'DELTA' END AS status FROM m)
SELECT venue, status, count(*) AS n,
  CAST(sum(CASE WHEN status = 'SNAPSHOT' THEN k * 3 + 3 WHEN status = 'DELTA' THEN CASE WHEN venue LIKE 'binance%' THEN k * 3 + 1 ELSE k * 3 + 3 END ELSE 0 END) AS BIGINT) AS ids,
  CAST(sum(CASE WHEN status IN ('SNAPSHOT', 'DELTA') THEN (k % 1000 + 1) * 1000000000 + (k % 100) * 10000000 ELSE 0 END) AS BIGINT) AS prices,
  CAST(sum(CASE WHEN status IN ('SNAPSHOT', 'DELTA') THEN (k % 7) * 1000000 + 500000 ELSE 0 END) AS BIGINT) AS sizes
FROM s GROUP BY ALL""")
def normalize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = normalize.normalize_messages(fixture.raw_messages(spark, sf_dir))
    first = F.get("bids", F.lit(0))
    return rows.groupBy("venue", "status").agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(c).cast("bigint"), F.lit(0)).alias(n) for n, c in (("ids", F.coalesce("last_update_id", "first_id")), ("prices", first["price_raw"]), ("sizes", first["size_raw"]))])


@query(f"WITH {sql.LV} SELECT seq AS recv_seq, CAST(row_number() OVER (PARTITION BY seq ORDER BY side DESC, pos) AS INT) AS pos, side, price_raw, size_raw FROM lv")
def level_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture.levels(spark, sf_dir)
    side = lambda s: F.transform(F.sort_array(F.collect_list(F.when(F.col("side") == s, F.struct("pos", "price_raw", "size_raw")))), lambda x: F.struct(x["price_raw"].alias("price_raw"), x["size_raw"].alias("size_raw")))
    messages = rows.groupBy(F.col("seq").alias("recv_seq")).agg(side("BID").alias("bids"), side("ASK").alias("asks"))
    return normalize.explode_levels(messages)


# Names

_EXCHANGES = "['BINANCE', 'BYBIT', 'OKX']"
_BASES = "['BTC', 'ETH', 'SOL', 'XRP']"


def _instruments(rows: DataFrame, key: str, bases: int) -> DataFrame:
    k = F.col(key)
    pick = lambda names, i: F.element_at(F.array(*[F.lit(n) for n in names]), (i + 1).cast("int"))
    out = rows.select(k, pick(("BINANCE", "BYBIT", "OKX"), k % 3).alias("exchange"), pick(("SPOT", "PERP"), F.expr(f"{key} div 3") % 2).alias("market"), pick(("BTC", "ETH", "SOL", "XRP"), F.expr(f"{key} div 6") % bases).alias("base"), F.lit("USDT").alias("quote"))
    columns = [F.col(c) for c in ("exchange", "base", "quote", "market")]
    return out.withColumn("venue", symbols.venue_to_string(F.col("exchange"), F.col("market"))).withColumn("native_symbol", symbols.native_symbol(*columns))


def _instruments_sql(source: str, key: str, bases: int) -> str:
    return f"""SELECT *, CASE WHEN exchange = 'OKX' THEN base || '-' || quote || CASE WHEN market = 'PERP' THEN '-SWAP' ELSE '' END ELSE base || quote END AS native_symbol,
  CASE exchange WHEN 'BINANCE' THEN CASE market WHEN 'SPOT' THEN 'binance_spot' ELSE 'binance_futures' END WHEN 'BYBIT' THEN CASE market WHEN 'SPOT' THEN 'bybit_spot' ELSE 'bybit_linear' END ELSE CASE market WHEN 'SPOT' THEN 'okx_spot' ELSE 'okx_swap' END END AS venue
  FROM (SELECT {key}, ({_EXCHANGES})[{key} % 3 + 1] AS exchange, (['SPOT', 'PERP'])[({key} // 3) % 2 + 1] AS market, ({_BASES})[({key} // 6) % {bases} + 1] AS base, 'USDT' AS quote FROM {source})"""


@query(f"WITH m AS ({_instruments_sql('orders', 'o_orderkey', 4)}), s AS (SELECT DISTINCT venue, native_symbol, base, quote, market FROM ({_instruments_sql('supplier', 's_suppkey', 3)})) SELECT m.venue, m.native_symbol, s.base, s.quote, s.market, count(*) AS n FROM m JOIN s ON m.venue = s.venue AND m.native_symbol = s.native_symbol GROUP BY ALL")
def route_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = _instruments(fixture.read(spark, sf_dir, "orders"), "o_orderkey", 4).select("venue", "native_symbol")
    books = _instruments(fixture.read(spark, sf_dir, "supplier"), "s_suppkey", 3).select("venue", "native_symbol", "base", "quote", "market").distinct()
    return routing.route_symbols(messages, books).groupBy("venue", "native_symbol", "base", "quote", "market").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT DISTINCT venue FROM ({_instruments_sql('supplier', 's_suppkey', 3)}) WHERE venue NOT IN (SELECT venue FROM ({_instruments_sql('(SELECT r_regionkey AS n FROM region)', 'n', 3)}))")
def venues_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    wired = _instruments(fixture.read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n")), "n", 3)
    return routing.venues_missing(_instruments(fixture.read(spark, sf_dir, "supplier"), "s_suppkey", 3), wired)


@query(f"SELECT DISTINCT base, quote, market FROM ({_instruments_sql('orders', 'o_orderkey', 4)})")
def list_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.list_books(_instruments(fixture.read(spark, sf_dir, "orders"), "o_orderkey", 4))


@query(f"SELECT exchange, market, base, quote, native_symbol, venue, count(*) AS n FROM ({_instruments_sql('customer', 'c_custkey', 4)}) GROUP BY ALL")
def native_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _instruments(fixture.read(spark, sf_dir, "customer"), "c_custkey", 4)
    return rows.groupBy("exchange", "market", "base", "quote", "native_symbol", "venue").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT c_custkey, 'C' || c_custkey || '_N' || c_nationkey || CASE WHEN c_custkey % 3 = 0 THEN '.PERP' WHEN c_custkey % 3 = 1 THEN '.SPOT' ELSE '.OTHER' END AS name,
CASE WHEN c_custkey % 3 < 2 THEN 'C' || c_custkey END AS base, CASE WHEN c_custkey % 3 < 2 THEN 'N' || c_nationkey END AS quote, CASE c_custkey % 3 WHEN 0 THEN 'PERP' WHEN 1 THEN 'SPOT' END AS market FROM customer""")
def book_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture.read(spark, sf_dir, "customer")
    k = F.col("c_custkey") % 3
    name = symbols.book_to_string(F.concat(F.lit("C"), F.col("c_custkey")), F.concat(F.lit("N"), F.col("c_nationkey")), F.when(k == 0, "PERP").when(k == 1, "SPOT").otherwise("OTHER"))
    return rows.select("c_custkey", name.alias("name")).withColumn("id", symbols.parse_book_id(F.col("name"))).select("c_custkey", "name", "id.base", "id.quote", "id.market")


# Numbers


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_linenumber % 6
  WHEN 0 THEN l_orderkey * 1000000000 + l_partkey // 10 + CASE WHEN l_partkey % 10 >= 5 THEN 1 ELSE 0 END
  WHEN 1 THEN -(l_orderkey * 1000000000 + l_partkey // 10 + CASE WHEN l_partkey % 10 >= 5 THEN 1 ELSE 0 END)
  WHEN 2 THEN l_partkey * 1000000000 WHEN 3 THEN NULL WHEN 4 THEN NULL
  ELSE CAST(rpad(CAST(l_suppkey AS VARCHAR), 9, '0') AS BIGINT) END AS raw FROM lineitem""")
def fixed_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    order, part, supplier = (F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey"))
    tenths = F.concat(order, F.lit("."), F.lpad(part, 10, "0"))
    texts = [F.concat(tenths, F.lit("4999")), F.concat(F.lit("-"), tenths), F.concat(part, F.lit(".")), F.concat(order, F.lit("e5")), F.concat(F.lit(" "), order), F.concat(F.lit("."), supplier)]
    text = F.element_at(F.array(*texts), (F.col("l_linenumber") % 6 + 1).cast("int"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", fixed.fixed_from_string(text, 9).alias("raw"))


_V = "(CASE WHEN size_raw > 0 THEN size_raw END)"


@query(f"""WITH {sql.LV} SELECT seq, pos, CAST({sql.NOTIONAL} AS BIGINT) AS notional_raw,
  CAST({sql.half_away('CAST(price_raw AS HUGEINT) * 1000000', _V)} AS BIGINT) AS price_per_size,
  CAST(CASE WHEN side = 'ASK' THEN CAST(price_raw AS HUGEINT) * 10037 // 10000 ELSE (CAST(price_raw AS HUGEINT) * 9963 + 9999) // 10000 END AS BIGINT) AS boundary_raw FROM lv""")
def notional_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, size = F.col("price_raw"), F.col("size_raw")
    return fixture.levels(spark, sf_dir).select("seq", "pos", fixed.notional(price, size).alias("notional_raw"), fixed.over(price, size).alias("price_per_size"), fixed.offset_by_bps(price, F.lit(37), F.col("side")).alias("boundary_raw"))


@query("""WITH t AS (SELECT c_custkey, c_nationkey, CAST(c_custkey AS HUGEINT) * CASE c_custkey % 4 WHEN 0 THEN 1000000000 WHEN 1 THEN 1000000000000 WHEN 2 THEN 500000000 ELSE 1000000000000000 END AS raw FROM customer WHERE c_custkey > 0),
u AS (SELECT *, raw // 1000000000 AS units FROM t),
l AS (SELECT c_custkey, c_nationkey, CASE WHEN raw % 1000000000 <> 0 THEN CAST(units AS VARCHAR) || '.5'
  WHEN units % 1000000000 = 0 THEN CAST(units // 1000000000 AS VARCHAR) || 'B' WHEN units % 1000000 = 0 THEN CAST(units // 1000000 AS VARCHAR) || 'M'
  WHEN units % 1000 = 0 THEN CAST(units // 1000 AS VARCHAR) || 'K' ELSE CAST(units AS VARCHAR) END AS label FROM u)
SELECT c_custkey, label || CASE WHEN lead(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) IS NULL THEN '+' ELSE '' END AS label FROM l""")
def band_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    unit = F.when(k % 4 == 0, 10**9).when(k % 4 == 1, 10**12).when(k % 4 == 2, 5 * 10**8).otherwise(10**15)
    rows = fixture.read(spark, sf_dir, "customer").where("c_custkey > 0").select("c_custkey", "c_nationkey", (k.cast("decimal(19,0)") * unit.cast("decimal(18,0)")).alias("raw"))  # beyond 64 bits for large keys
    return rows.select("c_custkey", labels.open_ended(labels.notional_label(F.col("raw")), k, "c_nationkey").alias("label"))


# Time

_TIMEOUT_SQL = "CASE WHEN venue < 3 THEN 3600 * (venue + 1) ELSE 1800 END"


def _timeouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture.read(spark, sf_dir, "region").where("r_regionkey < 3").select(F.col("r_regionkey").cast("int").alias("venue"), ((F.col("r_regionkey") + 1) * 3600).cast("int").alias("seconds"))


def _talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture.read(spark, sf_dir, "events").select((F.col("user_id") % 6).cast("int").alias("venue"), "ts", "event_id", "value")


@query(f"""WITH e AS (SELECT CAST(user_id % 6 AS INT) AS venue, epoch_us(ts) AS t FROM events), g AS (SELECT venue, t, lag(t) OVER (PARTITION BY venue ORDER BY t) AS p FROM e)
SELECT venue, p AS from_us, t - p AS silent_us, CAST({_TIMEOUT_SQL} AS INT) AS timeout FROM g WHERE t - p > {_TIMEOUT_SQL} * CAST(1000000 AS BIGINT)""")
def silent_venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = liveness.silent_spells(_talk(spark, sf_dir), _timeouts(spark, sf_dir), 1800)
    return found.select("venue", liveness.micros(F.col("silent_from")).alias("from_us"), "silent_us", "timeout")


@query(f"WITH v AS (SELECT DISTINCT CAST(user_id % 6 AS INT) AS venue FROM events) SELECT venue, CAST({_TIMEOUT_SQL} AS INT) AS timeout FROM v")
def idle_timeouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return liveness.with_timeout(_talk(spark, sf_dir).select("venue").distinct(), _timeouts(spark, sf_dir), 1800)


@query("""SELECT CAST(user_id % 4 AS INT) AS book, epoch_us(ts) // 600000000 * 600 AS window_s, max(event_id) AS last_event, arg_max(value, event_id) AS value
FROM (SELECT *, row_number() OVER (PARTITION BY user_id % 4, epoch_us(ts) // 600000000 ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1 GROUP BY ALL""")
def bbo_conflation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture.read(spark, sf_dir, "events").select((F.col("user_id") % 4).cast("int").alias("book"), "ts", "event_id", "value")
    newest = bbo.conflate(rows, "10 minutes", order=("ts", "event_id")).withColumn("window_us", liveness.micros(F.col("window_start")))
    return newest.select("book", F.expr("window_us div 1000000").alias("window_s"), F.col("event_id").alias("last_event"), "value")


# Streams


#: Level rows, or texts, of a micro-batch, about; a recording of more than ``BATCHES`` such batches has larger ones, up to ``MOST_ROWS``.
BATCH_ROWS, BATCHES, MOST_ROWS = 100_000, 8, 2_000_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


_SHUFFLES = "spark.sql.shuffle.partitions"


def _at_once(spark: SparkSession) -> int:
    """Tasks that can run at once, if a shuffle has so many."""
    return max(1, min(int(spark.conf.get(_SHUFFLES)), spark.sparkContext.defaultParallelism))


def _stores(spark: SparkSession, keys: DataFrame | None) -> int:
    """State stores of a stream: as many as tasks can run at once, as every store is opened and committed in every batch, whatever it
    holds. Where few keys have all the work, somewhat fewer if fewer of them fall to one store then."""
    most = _at_once(spark)
    hashes = [] if keys is None else [r[0] for r in keys.distinct().select(F.hash(*keys.columns)).limit(10 * most).collect()]
    if not 0 < len(hashes) < 10 * most:
        return most
    return min(range(max(1, most // 2), most + 1), key=lambda n: (max(Counter(h % n for h in hashes).values()), -n))


@contextmanager
def _stream_settings(spark: SparkSession, stores: int) -> Iterator[None]:
    """State in RocksDB, of which a batch uploads what it changed."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true", _SHUFFLES: str(stores)}
    before = {key: spark.conf.get(key, None) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def _run(spark: SparkSession, source: DataFrame, order: str, make: Callable[[DataFrame], DataFrame], start: Callable | None = None, most_rows: int = MOST_ROWS, keys: DataFrame | None = None) -> DataFrame | None:
    """All rows that a stream makes of a table that is recorded in order of ``order`` and read batch by batch, each of some files.

    ``start`` (rows, checkpoint) starts a query with sinks of its own instead. ``keys``: those of the state with most of the work.
    """
    root, parts = f"{scratch(spark)}/stream-{uuid.uuid4().hex}", _at_once(spark)
    write_in_order(source, order, f"{root}/in", BATCH_ROWS, BATCHES, most_rows, parts)
    with _stream_settings(spark, _stores(spark, keys)):
        rows = make(spark.readStream.schema(source.schema).option("maxFilesPerTrigger", parts).parquet(f"{root}/in"))
        if start:
            run = start(rows, f"{root}/state")
        else:
            run = rows.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    return None if start else spark.read.schema(rows.schema).parquet(f"{root}/out")


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = _levels_table(spark, sf_dir)
    return _run(spark, levels, "seq", live_book, keys=levels.select("book"))


def _levels_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The level table, written once for what counts, samples and records it."""
    return materialize(fixture.levels(spark, sf_dir), "stream-levels")


@query(f"{sql.FULL} SELECT * FROM diffs")
def stream_l2_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir).where("row_kind = 'DIFF'").select("book", "seq", "book_seq", "side", "price_raw", "size_raw")


@query(f"""WITH {sql.LV}, m AS (SELECT DISTINCT book, venue, seq, kind <> 'INVALIDATE' AS live FROM lv),
t AS (SELECT * FROM (SELECT *, coalesce(lag(live) OVER (PARTITION BY book, venue ORDER BY seq), false) AS before FROM m) WHERE live <> before),
f AS (SELECT a.book, a.seq, b.venue, arg_max(b.live, b.seq) AS live FROM t a JOIN t b ON a.book = b.book AND b.seq <= a.seq GROUP BY ALL)
SELECT book, seq, array_to_string(coalesce(list_sort(list(venue) FILTER (live)), []), ',') AS live_venues FROM f GROUP BY book, seq""")
def stream_heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir).where("row_kind = 'LIVE'").select("book", "seq", "live_venues")


@query(ORACLES["session_l2_diffs"])
def stream_session_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The diffs of ``session_l2_diffs``, from raw texts in one stream."""
    texts, subscribed = materialize(session_fixture.raw_texts(spark, sf_dir), "stream-texts"), session_fixture.subscriptions(spark)
    books = subscribed.select(symbols.book_to_string(F.col("base"), F.col("quote"), F.col("market")).alias("book"))
    found = _run(spark, texts, "recv_seq", lambda raw: live_session(raw, subscribed), most_rows=MOST_ROWS // 4, keys=books)  # a text has several levels
    return found.where("row_kind = 'DIFF'").select("book", F.expr(_PLACE.replace("recv_seq", "seq")).alias("seq"), "book_seq", "side", "price_raw", "size_raw")


@query(f"""{sql.FULL}, p AS (SELECT book, max(book_seq) // 3 AS n FROM diffs GROUP BY book),
s AS (SELECT d.book, p.n, side, price_raw, arg_max(size_raw, book_seq) AS size_raw FROM diffs d JOIN p ON d.book = p.book AND d.book_seq <= p.n GROUP BY ALL)
SELECT book, CAST(n AS BIGINT) AS book_seq, 'SNAPSHOT' AS row_kind, side, price_raw, size_raw FROM s WHERE size_raw > 0
UNION ALL SELECT d.book, book_seq, 'DIFF', side, price_raw, size_raw FROM diffs d JOIN p ON d.book = p.book AND d.book_seq > p.n""")
def stream_snapshot_then_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every book at a third of its revisions, then what a stream that begins with it makes of all later messages."""
    levels = _levels_table(spark, sf_dir)
    intervals = materialize(book.level_intervals(levels), "stream-intervals")
    at = materialize(book.messages_of_revisions(intervals, lambda n: F.floor(n / 3)), "stream-at")
    initial = materialize(book.venue_books_at(levels, at, intervals=intervals), "stream-initial")
    later = _run(spark, levels, "seq", lambda rows: live_book(rows, initial=initial), keys=levels.select("book")).where("row_kind = 'DIFF'").select("book", "book_seq", "row_kind", "side", "price_raw", "size_raw")
    first = book.aggregate_book(initial.where("side IS NOT NULL"), "book_seq").withColumn("row_kind", F.lit("SNAPSHOT"))
    return first.select(*later.columns).unionByName(later)


@query(f"{sql.FULL}, {sql.HELD}, {sql.BBO} SELECT * FROM bbo")
def stream_bbo_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best prices of the live book, from one of three tables that its stream writes exactly once."""
    root = f"{scratch(spark)}/outputs-{uuid.uuid4().hex}"
    kinds = {"diffs": "DIFF", "tops": "BBO", "live": "LIVE"}
    outputs = {name: lambda batch, kind=kind: batch.where(F.col("row_kind") == kind) for name, kind in kinds.items()}
    levels = _levels_table(spark, sf_dir)
    _run(spark, levels, "seq", live_book, lambda rows, checkpoint: stream_outputs(rows, root, checkpoint, outputs, availableNow=True), keys=levels.select("book"))
    side = lambda s: F.max(F.when(F.col("side") == s, F.struct("price_raw", "size_raw")))
    tops = read_output(spark, root, "tops").groupBy("book", "seq", "book_seq").agg(side("BID").alias("b"), side("ASK").alias("a"))
    return tops.selectExpr("book", "seq", "book_seq", "b.price_raw AS bid_price_raw", "b.size_raw AS bid_size_raw", "a.price_raw AS ask_price_raw", "a.size_raw AS ask_size_raw")


@query(f"""WITH e AS (SELECT CAST(user_id % 6 AS INT) AS venue, epoch_us(ts) AS t FROM events), g AS (SELECT venue, t, lag(t) OVER (PARTITION BY venue ORDER BY t) AS p FROM e)
SELECT venue, 'CLOSED' AS status, p AS from_us, t - p AS silent_us, CAST({_TIMEOUT_SQL} AS INT) AS timeout FROM g WHERE t - p > {_TIMEOUT_SQL} * CAST(1000000 AS BIGINT)
UNION ALL SELECT venue, 'OPEN', max(t), NULL, CAST({_TIMEOUT_SQL} AS INT) FROM e GROUP BY venue HAVING max(t) + {_TIMEOUT_SQL} * CAST(1000000 AS BIGINT) < (SELECT max(t) - 1000000 FROM e)""")
def stream_silent_venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silences of a stream of messages: those that have ended, and those that still last at its end."""
    talk = liveness.with_timeout(_talk(spark, sf_dir), _timeouts(spark, sf_dir), 1800).select("venue", F.col("ts").cast("timestamp").alias("ts"), "timeout")
    found = materialize(_run(spark, talk, "ts", live_silence), "stream-silence")
    closed = found.where("status = 'CLOSED'")
    rows = closed.unionByName(found.where("status = 'OPEN'").join(closed, ["venue", "silent_from"], "left_anti").select(*found.columns))
    return rows.select("venue", "status", liveness.micros(F.col("silent_from")).alias("from_us"), "silent_us", "timeout")
