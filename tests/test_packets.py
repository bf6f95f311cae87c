"""Rows on their way to stateful operators in packets, and a symbol's rule over many connections."""

import random
import time
from decimal import Decimal

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from depthframe.functions.fixed import fixed_from_string
from depthframe.operators.session import IDS
from depthframe.plans import session_fixture
from depthframe.sources.messages import write_in_order
from depthframe.streaming import packets
from depthframe.streaming.book import PACKED
from depthframe.streaming.session import SymbolProcessor, session_packets
from test_live_session import streamed
from test_whole_batch import Handle


def test_packets_hold_the_rows_of_their_key(spark):
    rows = spark.range(5000).selectExpr("id % 3 AS book", "concat('v', id % 2) AS venue", "id AS seq", "IF(id % 7 = 0, NULL, 'BID') AS side").coalesce(2)
    got = packets.packed(rows, ["book", "venue"], 900).toPandas()
    assert len(got) <= 2 * 6 * 3
    for (book, venue), part in got.groupby(["book", "venue"]):
        held = packets.opened(iter([part])).to_pydict()
        wanted = rows.where((F.col("book") == int(book)) & (F.col("venue") == venue)).select("seq", "side").collect()
        assert sorted(zip(held["seq"], held["side"], strict=True)) == sorted(map(tuple, wanted))


def test_a_session_stream_hands_on_few_rows(spark, testdata, tmp_path):
    """What costs in Python is the number of rows that an operator is given: packets, neither messages nor levels."""
    raw = session_fixture.raw_texts(spark, f"{testdata}/sf0.001").cache()
    got, _ = streamed(spark, str(tmp_path), raw, "recv_seq", 10**6, lambda s: session_packets(s, session_fixture.subscriptions(spark)))
    assert 0 < got.count() < raw.count() / 5
    assert packets.opened(iter([got.toPandas()])).num_rows > raw.count()


LEVEL = pa.list_(pa.struct([("bid", pa.bool_()), ("price_raw", pa.int64()), ("size_raw", pa.int64())]))
KINDS = {"conn_epoch": pa.int64(), "recv_seq": pa.int64(), "kind": pa.string(), **dict.fromkeys(IDS[1:], pa.decimal128(20, 0)), "bad": pa.bool_(), "book": pa.string(), "levels": LEVEL}


def packet(messages):
    columns = zip(*messages, strict=True)
    return packets.closed(pa.table({c: pa.array(list(x), kind) for (c, kind), x in zip(KINDS.items(), columns, strict=True)}))


def message(epoch, seq, kind, first, final, prev, last, bad=False, levels=1):
    ids = [None if x is None else Decimal(x) for x in (first, final, prev, last)]
    return (epoch, seq, kind, *ids, bad, "A", [{"bid": n % 2 == 0, "price_raw": 10 * seq + n, "size_raw": seq} for n in range(levels)])


def run(venue, batches):
    """Level rows and control rows of messages, and the states that are left."""
    handle, levels, controls = Handle(), [], []
    for batch in batches:
        rule = SymbolProcessor()
        rule.init(handle)
        for frame in rule.handleInputRows((venue, "AUSD", 0), iter([pd.DataFrame({"packet": [packet(batch)]})]), None):
            for route, _, held in frame.itertuples(index=False):
                rows = packets.read(held).to_pylist()
                (levels if route.startswith("book") else controls).extend(tuple(r.values()) for r in rows)
    return sorted(levels, key=str), sorted(controls, key=str), handle.states


def connection(rng, venue, epoch, seq, at):
    """Messages of one connection, with what is held back, gaps, bad levels, repeats and messages without levels."""
    rows = []
    for n in range(rng.randrange(2, 14)):
        seq += rng.randrange(1, 3)
        step = 2 if rng.random() < 0.1 else 1
        snapshot = rng.random() < 0.2 or (n == 0 and venue == "bybit_spot")
        ids = (None, None, None, at - (rng.randrange(4) if venue == "binance_spot" else 0)) if snapshot else (at + step, at + step, 0, None)
        at += 0 if snapshot else step
        rows.append(message(epoch, seq, "SNAPSHOT" if snapshot else "DELTA", *ids, rng.random() < 0.05, rng.randrange(4)))
        if rng.random() < 0.1:
            rows.append(rows[-1])
    return rows, seq, at


@pytest.mark.parametrize("venue", ["binance_spot", "bybit_spot"])
@pytest.mark.parametrize("start", [5, (1 << 64) - 5000])
def test_batches_of_any_size_give_the_same(venue, start):
    applied = set()
    for seed in range(15):
        rng, rows, seq, at = random.Random(seed), [], 0, start
        for epoch in range(6):
            made, seq, at = connection(rng, venue, epoch, seq, at)
            rows += made
        rng.shuffle(one := list(rows))
        cuts = sorted({0, len(rows), *(rng.randrange(len(rows)) for _ in range(5))})
        # A repeat in a later batch than its message comes late, as it does in the same one.
        whole, cut = run(venue, [one]), run(venue, [rows[a:b] for a, b in zip(cuts, cuts[1:], strict=False)])
        assert whole[:2] == cut[:2]
        applied |= {r[PACKED.index("kind")] for r in whole[0]}
        assert dict(whole[2]["newest"]) == dict(cut[2]["newest"])
        assert {k: v[:-1] for k, v in whole[2]["places"].items()} == {k: v[:-1] for k, v in cut[2]["places"].items()}
    assert applied == {"SNAPSHOT", "DELTA", "INVALIDATE"}


def test_many_short_connections_cost_their_messages():
    rows = [message(e, 40 * e + n, "DELTA" if n else "SNAPSHOT", *((n + 1, n + 1, 0, None) if n else (None, None, None, 1)), False, 3) for e in range(1000) for n in range(40)]
    began = time.perf_counter()
    levels, controls, states = run("bybit_spot", [rows])
    assert len(levels) == 120_000 and len(controls) == 1000 == len(states["places"]) and not states["held"]
    assert time.perf_counter() - began < 5  # a pandas frame for each connection took about 10 ms


def test_parts_of_a_recording_keep_its_order(spark, tmp_path):
    write_in_order(spark.range(4000), "id", str(tmp_path / "in"), 1000, parts=3)
    files = sorted((tmp_path / "in").glob("part-*.parquet"), key=lambda f: f.stat().st_mtime)
    ids = [sorted(r.id for r in spark.read.parquet(str(f)).collect()) for f in files]
    assert len(files) == 12 and sum(ids, []) == list(range(4000))


def test_short_numbers_are_read_as_the_others_are(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choices("0123456789", k=rng.randrange(12))) + rng.choice(["", ".", ".", ".", "e1", " ", "\n"]) + "".join(rng.choices("0123456789", k=rng.randrange(12))) for _ in range(3000)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fixed_from_string(F.col("t"), 9).alias("n"), fixed_from_string(F.concat(F.lit("000000000000"), "t"), 9).alias("padded")).collect()
    assert any(r.n for r in got)
    for t, n, padded in got:
        if n is not None or t[:1].isdigit():
            assert n == padded, t
        if n is not None and 0 < len(t.partition(".")[0]) < 10:
            assert n == int((Decimal(t) * 10**9).to_integral_value("ROUND_HALF_UP")), t
