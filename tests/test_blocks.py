"""Looking back in blocks gives the same rows at any width."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from depthframe.operators import client, liveness
from depthframe.operators.blocks import with_previous


@pytest.mark.parametrize("width", [1, 3, 64, 10**6])
def test_previous(spark, width):
    rng = random.Random(9)
    rows = [(k, t, rng.choice([None, rng.randint(0, 9)])) for k in range(3) for t in sorted(rng.sample(range(200), 40))]
    df = spark.createDataFrame(rows, "k int, t long, v int")
    got = with_previous(df, ["k"], "t", "v", F.expr(f"t div {width}"), "p")
    plain = df.withColumn("p", F.lag("v").over(Window.partitionBy("k").orderBy("t")))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


@pytest.mark.parametrize("width", [1, 5, 4096])
def test_updates(spark, width):
    rows = [(1, a, s, "SNAPSHOT" if a == 3 else "DIFF", "BID", 1, 1, 1) for a, s in ((3, 7), (4, 8), (9, 10), (11, 10), (12, 9), (30, 10))]
    stream = spark.createDataFrame(rows, "book int, arrival long, book_seq long, row_kind string, side string, price_raw long, size_raw long, pos int")
    got = sorted((r.arrival, r.previous) for r in client.updates(stream, width).collect())
    assert got == [(3, None), (4, 7), (9, 8), (11, 10), (12, 10), (30, 9)]


@pytest.mark.parametrize("seconds", [1, 60, 10**6])
def test_silent_spells(spark, seconds):
    rows = spark.sql("SELECT v AS venue, timestamp_seconds(s) AS ts FROM VALUES (1, 0), (1, 10), (1, 100), (2, 5), (2, 500) AS t(v, s)")
    timeouts = spark.createDataFrame([(2, 600)], "venue int, seconds int")
    got = liveness.silent_spells(rows, timeouts, 30, seconds).collect()
    assert [(r.venue, r.silent_us, r.timeout) for r in got] == [(1, 90_000_000, 30)]
