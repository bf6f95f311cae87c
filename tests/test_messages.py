"""Venue texts, configuration, routing and the sync rules."""

import json

import pytest

from depthframe.operators import routing, sync
from depthframe.operators.normalize import explode_levels, is_rejected, normalize_messages, status_counts
from depthframe.plans import queries
from depthframe.sources import config, messages
from depthframe.types import RAW_MESSAGES


def raw(spark, *rows):
    return spark.createDataFrame([(i, None, venue, 0, source, symbol, text) for i, (venue, source, symbol, text) in enumerate(rows)], RAW_MESSAGES)


def test_texts(spark):
    futures = '{"e":"depthUpdate","s":"BNBUSDT","U":157,"u":160,"pu":149,"b":[["0.0024","10"]],"a":[["0.0026","100"]]}'
    bybit = '{"topic":"orderbook.50.X","type":"%s","data":{"s":"X","b":[["1","2"]],"a":[],"u":7}}'
    okx = '{"arg":{"instId":"A-B"},"action":"%s","data":[{"asks":[["1","2","0","3"]],"bids":[],"seqId":-1,"prevSeqId":4}]}'
    cases = [
        ("binance_futures", "WS", None, futures, "DELTA"),
        ("binance_futures", "WS", None, futures.replace('"pu":149,', ""), "MALFORMED"),
        ("binance_spot", "WS", None, futures.replace('"pu":149,', ""), "DELTA"),
        ("binance_spot", "WS", None, '{"result":null}', "IGNORED"),
        ("binance_spot", "WS", None, futures.replace("depthUpdate", "trade"), "IGNORED"),
        ("binance_spot", "WS", None, futures.replace('"0.0024"', "0.0024"), "MALFORMED"),
        ("binance_spot", "WS", None, futures.replace('"0.0024"', '"x"'), "MALFORMED"),
        ("binance_spot", "WS", None, futures.replace('["0.0024","10"]', '["0.0024"]'), "MALFORMED"),
        ("binance_spot", "WS", None, "{", "MALFORMED"),
        ("binance_spot", "REST", "AB", '{"lastUpdateId":18446744073709551615,"bids":[["1","2"]],"asks":[]}', "SNAPSHOT"),
        ("binance_spot", "REST", "AB", '{"bids":[],"asks":[]}', "MALFORMED"),
        ("bybit_linear", "WS", None, bybit % "snapshot", "SNAPSHOT"),
        ("bybit_spot", "WS", None, bybit % "delta", "DELTA"),
        ("bybit_spot", "WS", None, bybit % "other", "IGNORED"),
        ("bybit_spot", "WS", None, '{"success":true}', "IGNORED"),
        ("bybit_spot", "WS", None, (bybit % "delta").replace(',"u":7', ""), "MALFORMED"),
        ("okx_swap", "WS", None, okx % "snapshot", "SNAPSHOT"),
        ("okx_spot", "WS", None, okx % "update", "DELTA"),
        ("okx_spot", "WS", None, "pong", "IGNORED"),
        ("okx_spot", "WS", None, okx % "x", "IGNORED"),
        ("okx_spot", "WS", None, '{"arg":{"instId":"A-B"},"action":"update","data":[]}', "MALFORMED"),
        ("okx_spot", "WS", None, '{"event":"subscribe","arg":{"instId":"A-B"}}', "IGNORED"),
        ("unheard_of", "WS", None, futures, "IGNORED"),
    ]
    got = {r.recv_seq: r for r in normalize_messages(raw(spark, *[c[:4] for c in cases])).collect()}
    assert [got[i].status for i in range(len(cases))] == [c[4] for c in cases]
    first = got[0]
    assert (first.native_symbol, int(first.first_id), int(first.final_id), int(first.prev_final_id)) == ("BNBUSDT", 157, 160, 149)
    assert [tuple(x) for x in first.bids + first.asks] == [(2400000, 10000000), (2600000, 100000000)]
    assert (got[9].native_symbol, int(got[9].last_update_id)) == ("AB", 18446744073709551615)
    assert int(got[17].final_id) == 18446744073709551615 and [tuple(x) for x in got[17].asks] == [(10**9, 2 * 10**6)]
    rows = normalize_messages(raw(spark, *[c[:4] for c in cases]))
    assert {(r.venue, r.status): r.n for r in status_counts(rows).collect()}["binance_spot", "MALFORMED"] == 5
    good = rows.where("kind IS NOT NULL")
    assert good.where(is_rejected(good.bids, good.asks)).count() == 0
    assert explode_levels(good).where("recv_seq = 0").count() == 2


def write(tmp_path, doc):
    path = tmp_path / f"{abs(hash(str(doc)))}.json"
    path.write_text(doc if isinstance(doc, str) else json.dumps(doc))
    return str(path)


def test_subscriptions(spark, tmp_path):
    book = {"symbol": "BTC_USDT", "type": "PERP", "venues": ["BINANCE", "OKX"]}
    got = config.read_subscriptions(spark, write(tmp_path, {"books": [book, {**book, "type": "SPOT", "venues": ["BYBIT"]}]})).collect()
    assert sorted((r.venue, r.native_symbol) for r in got) == [("binance_futures", "BTCUSDT"), ("bybit_spot", "BTCUSDT"), ("okx_swap", "BTC-USDT-SWAP")]
    bad = ["{", {"books": []}, {"books": [{**book, "venues": []}]}, {"books": [book, book]}, {"books": [{**book, "venues": ["OKX", "OKX"]}]}, {"books": [{**book, "venues": ["X"]}]}, {"books": [{**book, "type": "FUT"}]}, {"books": [{**book, "symbol": "BTCUSDT"}]}, {"books": [{"symbol": "A_B"}]}, {}]
    for doc in bad:
        with pytest.raises(ValueError):
            config.read_subscriptions(spark, write(tmp_path, doc)).collect()


def test_idle_timeouts(spark, tmp_path):
    assert config.read_idle_timeouts(spark, write(tmp_path, {}))[0] == 30
    own = {"venue": "OKX", "type": "PERP", "seconds": 60}
    default, rows = config.read_idle_timeouts(spark, write(tmp_path, {"idle_timeout_seconds": 10, "idle_timeout_overrides": [own]}))
    assert default == 10 and [tuple(r) for r in rows.collect()] == [("OKX", "PERP", "okx_swap", 60)]
    for doc in ({"idle_timeout_seconds": 0}, {"idle_timeout_seconds": 86401}, {"idle_timeout_overrides": [own, own]}, {"idle_timeout_overrides": [{**own, "venue": "X"}]}, {"idle_timeout_overrides": [{**own, "seconds": 0}]}, "["):
        with pytest.raises(ValueError):
            config.read_idle_timeouts(spark, write(tmp_path, doc))


def test_routing_and_selection(spark):
    subs = spark.createDataFrame([("v", "AB", "A", "B", "SPOT")], "venue string, native_symbol string, base string, quote string, market string")
    found = routing.route_symbols(spark.createDataFrame([("v", "AB"), ("v", "X"), ("w", "AB")], "venue string, native_symbol string"), subs)
    assert found.count() == 1
    assert routing.select_book(found, "A", "B", "SPOT").count() == 1
    with pytest.raises(ValueError):
        routing.select_book(found, "", "B", "SPOT")
    with pytest.raises(KeyError):
        routing.select_book(found, "A", "B", "PERP")


def test_files(spark, tmp_path):
    rows = raw(spark, ("okx_spot", "WS", None, "pong"), ("binance_spot", "REST", "AB", "{}"))
    messages.write_table(rows, str(tmp_path / "t"), ("venue",))
    assert messages.read_raw_messages(spark, str(tmp_path / "t"), "parquet").count() == 2
    assert messages.read_rest_snapshots(spark, str(tmp_path / "t"), "parquet").count() == 1


def script(policy, *events):
    """Actions of one connection; events are ('u', first, final, prev) and ('s', last)."""
    state, out = sync.SyncState(sync.POLICIES[policy]), []
    for k, e in enumerate(events):
        out += state.snapshot(k, e[1]) if e[0] == "s" else state.update(k, *e[1:]) if e[0] == "u" else state.disconnected() if e[0] == "d" else state.connected()
    return [a if m is None else f"{a}{m}" for a, m in out]


def test_sync_rules():
    # One request for a connection, however often it is set up.
    assert script("futures", ("c",), ("c",)) == ["REQUEST_SNAPSHOT"]
    # The update that ends where the snapshot does bridges it; the one before goes.
    assert script("futures", ("u", 40, 47, 39), ("u", 48, 52, 47), ("u", 53, 60, 52), ("s", 52)) == ["SNAPSHOT3", "DELTA1", "DELTA2"]
    # A gap while live, then a snapshot that what came after it bridges.
    assert script("futures", ("u", 7, 7, 6), ("s", 7), ("u", 20, 26, 11), ("s", 23)) == ["SNAPSHOT1", "DELTA0", "INVALIDATE", "SNAPSHOT3", "DELTA2"]
    # No bridge: ask again.
    assert script("futures", ("s", 30), ("u", 44, 44, 43), ("s", 31)) == ["REQUEST_SNAPSHOT", "REQUEST_SNAPSHOT"]
    assert script("spot", ("u", 20, 24, 0), ("u", 25, 31, 0), ("s", 24), ("u", 32, 32, 0), ("u", 34, 35, 0)) == ["SNAPSHOT2", "DELTA1", "DELTA3", "INVALIDATE"]
    # Pushed snapshots need no bridge if nothing came before them.
    assert script("bybit", ("s", 70), ("u", 71, 71, 0), ("u", 74, 74, 0), ("s", 73)) == ["SNAPSHOT0", "DELTA1", "INVALIDATE", "SNAPSHOT3", "DELTA2"]
    assert script("bybit", ("u", 12, 12, 0), ("s", 40)) == ["INVALIDATE"]
    # Ids may repeat and start anew as long as each names the one before.
    assert script("okx", ("s", 200), ("u", 230, 230, 200), ("u", 230, 230, 230), ("u", 9, 9, 230), ("u", 12, 12, 9)) == ["SNAPSHOT0", "DELTA1", "DELTA2", "DELTA3", "DELTA4"]
    assert script("okx", ("u", 9, 9, 230), ("u", 12, 12, 9), ("s", 9)) == ["SNAPSHOT2", "DELTA1"]
    assert script("okx", ("s", 17), ("d",), ("s", 25)) == ["SNAPSHOT0", "INVALIDATE", "SNAPSHOT2"]
    # A gap within what was held: what follows it stays for the next snapshot.
    assert script("futures", ("u", 80, 83, 79), ("u", 90, 92, 88), ("s", 81), ("s", 91)) == ["SNAPSHOT2", "DELTA0", "INVALIDATE", "SNAPSHOT3", "DELTA1"]


def test_actions_and_episodes_agree(spark, testdata):
    from depthframe.plans import fixture

    rows = fixture.updates(spark, f"{testdata}/sf0.001")
    actions = sync.sync_actions(rows, "futures").collect()
    bridged = {r.snapshot_seq for r in sync.snapshot_bridges(rows, "futures").collect()}
    applied = {r.message_seq for r in actions if r.action == "SNAPSHOT"}
    assert applied and applied <= bridged
    episodes = {r.snapshot_seq: r for r in sync.sync_episodes(rows, "futures").collect()}
    deltas = {r.message_seq for r in actions if r.action == "DELTA"}
    assert all(episodes[s].bridge_seq in deltas for s in applied)


def test_long_recordings_have_larger_files(spark, tmp_path):
    """Files in order, about as many as asked for, with no more rows in one than allowed."""
    for name, limits, least, most in (("a", {}, 9, 11), ("b", {"files": 2}, 2, 2), ("c", {"files": 2, "most_rows": 200}, 5, 5), ("d", {"files": 99}, 9, 11)):
        messages.write_in_order(spark.range(1000), "id", str(tmp_path / name), 100, **limits)
        files = sorted((tmp_path / name).glob("part-*"))
        assert least <= len(files) <= most
        assert sorted(r.id for r in spark.read.parquet(str(tmp_path / name)).collect()) == list(range(1000))


def test_stream_settings_come_back(spark):
    keys = ["spark.sql.streaming.stateStore.providerClass", "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "spark.sql.shuffle.partitions"]
    before = [spark.conf.get(k, None) for k in keys]
    with queries._stream_settings(spark):
        assert int(spark.conf.get(keys[2])) <= spark.sparkContext.defaultParallelism
        assert spark.conf.get(keys[1]) == "true"
    assert [spark.conf.get(k, None) for k in keys] == before
