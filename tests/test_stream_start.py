"""Where a subscription begins, from intervals alone, and how a stream's keys are dealt."""

import pytest
from pyspark.sql import functions as F

from depthframe.operators import book
from depthframe.plans import fixture, queries


@pytest.mark.parametrize("block", [64, 4096])
def test_messages_of_revisions(spark, testdata, block):
    levels = fixture.levels(spark, f"{testdata}/sf0.001").cache()
    intervals = book.level_intervals(levels, block).cache()
    diffs = book.l2_diffs(levels).select("book", "seq", "book_seq").distinct().cache()
    last = diffs.groupBy("book").agg(F.max("book_seq").alias("last"))
    for wanted in (lambda n: F.floor(n / 3), lambda n: n, lambda n: n - n + 1, lambda n: n + 1, lambda n: n * 0):
        expected = diffs.join(last, "book").where(F.col("book_seq") == wanted(F.col("last"))).select("book", "seq", "book_seq")
        got = book.messages_of_revisions(intervals, wanted, block)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))


def test_books_at_a_point_from_intervals_at_hand(spark, testdata):
    levels = fixture.levels(spark, f"{testdata}/sf0.001").cache()
    intervals = book.level_intervals(levels).cache()
    at = book.messages_of_revisions(intervals, lambda n: F.floor(n / 3)).cache()
    got, wanted = book.venue_books_at(levels, at, intervals=intervals), book.venue_books_at(levels, at)
    assert got.count() and sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, wanted.collect()), key=str)


def test_few_keys_dont_meet_in_a_store(spark):
    hashes = {r.id: r.h for r in spark.range(200).select("id", F.hash("id").alias("h")).collect()}
    other = next(k for k in hashes if k and (hashes[k] - hashes[0]) % 4 == 0 and (hashes[k] - hashes[0]) % 3)
    assert queries._at_once(spark) == 4 == queries._stores(spark, None) == queries._stores(spark, spark.range(1000))
    assert queries._stores(spark, spark.range(200).where(F.col("id").isin(0, other))) == 3
