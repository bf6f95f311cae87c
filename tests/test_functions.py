"""Exact arithmetic, names and labels."""

import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from depthframe.functions import fixed, labels, symbols
from depthframe.plans import queries


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).coalesce(1).select(*columns).collect()]


def test_decimal_texts(spark):
    cases = {"1": 10**9, "-1.5": -1_500_000_000, ".5": 500_000_000, "5.": 5 * 10**9, "0.0000000005": 1, "0.00000000049999": 0, "-0.0000000005": -1, "9223372036.854775807": 2**63 - 1, "000000000000000000000000000000000000000000001": 10**9}
    bad = ["", ".", "-", "1e5", "+1", " 1", "1 ", "1,0", "0x1", "1.2.3", "9223372036.854775808", "-9223372036.854775808", "99999999999999999999999999999999999999999999", None, "--1", "nan", "1.5\n", "1\n", "\n1", "1.5\r"]
    got = values(spark, [(t,) for t in [*cases, *bad]], "t string", fixed.fixed_from_string(F.col("t"), 9))
    assert [g[0] for g in got] == [*cases.values(), *[None] * len(bad)]


def test_random_decimal_texts(spark):
    rng = random.Random(1)
    texts = [f"{'-' if rng.random() < 0.5 else ''}{rng.randrange(10 ** rng.randint(1, 9))}.{rng.randrange(10 ** rng.randint(1, 12)):0{rng.randint(1, 12)}d}" for _ in range(2000)]
    # The digit after the last kept one decides, so cut there before rounding.
    want = [int((Decimal(t[: t.index(".") + 11]) * 10**9).quantize(0, ROUND_HALF_UP)) for t in texts]
    assert [g[0] for g in values(spark, [(t,) for t in texts], "t string", fixed.fixed_from_string(F.col("t"), 9))] == want


def test_division_rounds_half_away(spark):
    rng = random.Random(2)
    rows = [(rng.randint(-(10**18), 10**18), rng.randint(1, 10 ** rng.randint(1, 18))) for _ in range(500)] + [(5, 10), (-5, 10), (4, 10), (15, 10), (-15, 10)]
    want = [(abs(n) * 2 + d) // (2 * d) * (1 if n >= 0 else -1) for n, d in rows]
    assert [int(g[0]) for g in values(spark, rows, "n bigint, d bigint", fixed.div_half_away(F.col("n"), F.col("d")))] == want


def test_notionals_and_bounds(spark):
    p, s = F.col("p"), F.col("s")
    top = 2**63 - 1
    got = values(spark, [(100 * 10**9, 5 * 10**6), (top, top), (1, 500_000), (1, 499_999)], "p bigint, s bigint", fixed.notional(p, s))
    assert [g[0] for g in got] == [500 * 10**9, None, 1, 0]
    got = values(spark, [(10, 0), (top, 1), (2000 * 10**9, 15 * 10**6)], "p bigint, s bigint", fixed.over(p, s))
    assert [g[0] for g in got] == [None, None, 133333333333]
    ask, bid = fixed.offset_by_bps(p, F.lit(50), F.lit("ASK")), fixed.offset_by_bps(p, F.lit(50), F.lit("BID"))
    assert values(spark, [(100 * 10**9, 0), (3, 0)], "p bigint, s bigint", ask, bid) == [(100_500_000_000, 99_500_000_000), (3, 3)]
    assert values(spark, [(top, 0)], "p bigint, s bigint", ask) == [(None,)]
    vwap = fixed.vwap_at_partial_fill(F.col("n"), s, F.col("r"), p)
    rows = [(1000 * 10**9, 10 * 10**6, 1000 * 10**9, 200 * 10**9), (0, 0, 10**9, 3 * 10**9), (top, 0, top - 1, top)]
    assert [g[0] for g in values(spark, rows, "n bigint, s bigint, r bigint, p bigint", vwap)] == [133333333333, 3 * 10**9, None]
    assert values(spark, [(1.5, 0), (-0.0000005, 0)], "v double, s bigint", fixed.fixed_from_double(F.col("v"), 6)) == [(1500000,), (-1,)]
    assert [str(g[0]) for g in values(spark, [(1500000001, 0)], "v bigint, s bigint", fixed.fixed_to_decimal(F.col("v"), 9))] == ["1.500000001"]


def test_names(spark):
    t = F.col("t")
    pair, book = symbols.split_base_quote(t), symbols.parse_book_id(t)
    got = values(spark, [("BTC_USDT",), ("_USDT",), ("A_B_C",), ("BTC",), ("BTC_USDT.PERP",), ("BTC_USDT.FUT",), (None,)], "t string", pair["base"], book["market"])
    assert got == [("BTC", None), (None, None), (None, None), (None, None), ("BTC", "PERP"), ("BTC", None), (None, None)]
    assert values(spark, [("A_B\n",), ("A_B.SPOT\n",)], "t string", book["market"]) == [(None,), (None,)]
    assert values(spark, [("A_B\n",)], "t string", symbols.split_base_quote(t)["base"]) == [("A",)]
    e, m = F.col("e"), F.col("m")
    got = values(spark, [("OKX", "PERP"), ("OKX", "SPOT"), ("BYBIT", "PERP"), ("X", "SPOT")], "e string, m string", symbols.venue_to_string(e, m), symbols.native_symbol(e, F.lit("BTC"), F.lit("USDT"), m))
    assert got == [("okx_swap", "BTC-USDT-SWAP"), ("okx_spot", "BTC-USDT"), ("bybit_linear", "BTCUSDT"), (None, None)]


def test_labels(spark):
    rows = [(10**15,), (5 * 10**12,), (2 * 10**18,), (1234 * 10**9,), (10**9 // 2,), (0,)]
    assert [g[0] for g in values(spark, rows, "n bigint", labels.notional_label(F.col("n")))] == ["1M", "5K", "2B", "1234", "0.5", "0"]
    assert labels.parse_notionals("1,5") == [10**9, 5 * 10**9] and labels.parse_bps("0,50") == [0, 50]
    for text in ("", "1,", "2,1", "1,1", "0", "1.5", "1e6", "-1", "99999999999"):
        with pytest.raises(ValueError):
            labels.parse_notionals(text)
    for text in ("", " 5", "+5", "10000", "5,5", "a"):
        with pytest.raises(ValueError):
            labels.parse_bps(text)


def test_labels_beyond_64_bits(spark):
    unit = 10**9
    rows = [(str(n),) for n in (15_000 * 10**6 * unit, 90_000 * 10**6 * unit + 5 * 10**8, 2**63 - 1 - (2**63 - 1) % unit, 9 * 10**20)]
    got = values(spark, rows, "n string", labels.notional_label(F.col("n").cast("decimal(38,0)")))
    assert [g[0] for g in got] == ["15B", "90000000000.5", "9223372036", "900B"]


def test_labels_of_many_customers(spark, tmp_path):
    """Keys whose notionals leave 64 bits: 15,000 is the first of them in the tables' own range."""
    spark.sql("SELECT CAST(id AS BIGINT) AS c_custkey, CAST(0 AS INT) AS c_nationkey FROM VALUES 3L, 9999L, 90003L AS t(id)").write.parquet(str(tmp_path / "customer.parquet"))
    got = {r.c_custkey: r.label for r in queries.band_labels(spark, str(tmp_path)).collect()}
    assert got == {3: "3M", 9999: "9999M", 90003: "90003M+"}
