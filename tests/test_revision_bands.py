"""Bands after every revision against the bands of each revision's book."""

import random
import time

import pytest
from pyspark.sql import functions as F

from depthframe.operators import bands
from depthframe.operators.revision_bands import Ladder, price_bands_by_revision, price_rows, volume_bands_by_revision, volume_rows

DIFF = "book int, seq long, book_seq long, side string, price_raw long, size_raw long"
BPS, NOTIONALS = [0, 50, 200, 9999], [10**9, 7 * 10**9, 10**12]


@pytest.fixture(scope="module")
def diffs(spark):
    rng = random.Random(4)
    rows = []
    for book, scale in ((1, 10**7), (2, 10**15), (3, 10**18)):  # the last ones leave 64 bits
        held = {}
        for k in range(1, 90):
            places = {(rng.choice(("BID", "ASK")), rng.randint(1, 9)) for _ in range(rng.randint(1, 4))} if k != 40 else set(held)
            for side, step in places:
                size = 0 if k == 40 or (rng.random() < 0.4 and (side, step) in held) else rng.randint(1, 5_000_000)
                held[side, step] = size
                rows.append((book, k * 10, k, side, (100 + (step if side == "ASK" else -step)) * scale // 100, size))
    rows.append((4, 1, 1, "BID", -5, 3))
    return spark.createDataFrame(rows, DIFF).cache()


def rows(df):
    columns = sorted(df.columns)
    return sorted(map(tuple, df.select(columns).collect()), key=str)


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_price_bands(diffs, block):
    books = bands.at_revisions(diffs, 1)
    got = price_bands_by_revision(diffs, BPS, block)
    assert rows(got) == rows(bands.price_bands(books, BPS, ("book_seq",)))
    assert {r.status for r in got.select("status").distinct().collect()} == {"OK", "RESULT_OUT_OF_RANGE", "ARGUMENT_OUT_OF_DOMAIN"}


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_volume_bands(diffs, block):
    books = bands.at_revisions(diffs, 1)
    got = volume_bands_by_revision(diffs, NOTIONALS, block)
    assert rows(got) == rows(bands.volume_bands(books, NOTIONALS, ("book_seq",)))
    assert got.where(F.col("vwap_raw").isNotNull()).count() > 0


def test_no_rows(diffs):
    assert price_bands_by_revision(diffs.where("false"), BPS).count() == 0
    assert volume_bands_by_revision(diffs.where("false"), NOTIONALS).count() == 0


def test_cost_does_not_follow_depth():
    """4,000 changes of a side and all its bands after each, on 1,000 and on 128,000 levels."""
    took = []
    for depth in (1000, 128_000):
        rng = random.Random(depth)
        ladder = Ladder("ASK", range(10**9, 10**9 + depth))
        for p in range(10**9, 10**9 + depth):
            ladder.put(p, 5)
        began = time.perf_counter()
        for _ in range(4000):
            ladder.put(10**9 + rng.randrange(depth), rng.randrange(9))
            price_rows("ASK", ladder, [0, 50, 9999])
            volume_rows(ladder, [10**6, 10**9, 10**18])
        took.append(time.perf_counter() - began)
    assert took[1] < 8 * took[0]


def test_a_block_of_ordinary_numbers_is_not_walked(spark, monkeypatch):
    """Matrix and ladder give the same rows; small numbers need no ladder."""
    from depthframe.operators import revision_bands

    rng, rows = random.Random(8), []
    held = {}
    for k in range(1, 400):
        for place in {(rng.choice(("BID", "ASK")), rng.randint(1, 12)) for _ in range(3)} if k != 70 else set(held):
            held[place] = 0 if k == 70 or rng.random() < 0.3 else rng.randint(1, 5_000_000)
            rows.append((1, k, k, place[0], 10**9 + (place[1] if place[0] == "ASK" else -place[1]) * 3_000_001, held[place]))
    diffs = spark.createDataFrame(rows, DIFF).cache()
    taken = []
    monkeypatch.setattr(revision_bands, "replay_blocks", lambda rows, n: rows.withColumn("block", F.lit(0)))
    monkeypatch.setattr(type(diffs.groupBy("book")), "applyInArrow", lambda _, run, schema: taken.append(run))
    price_bands_by_revision(diffs, BPS)
    volume_bands_by_revision(diffs, NOTIONALS)
    block = diffs.withColumn("block", F.lit(0)).toArrow()
    shown = lambda: [sorted(map(str, run(block).to_pylist())) for run in taken]
    monkeypatch.setattr(revision_bands, "CELLS", 0)
    walked = shown()
    assert len(walked[0]) > 1000 and len(walked[1]) > 1000
    monkeypatch.undo()

    def refuse(*_):
        raise AssertionError("walked")

    monkeypatch.setattr(revision_bands, "Ladder", refuse)
    assert shown() == walked
