"""What a consumer of the diff stream does: gap checks, its own book, summaries, and best prices beside diffs.

``stream`` has one row for each level of each received update: book, arrival (order of receipt), book_seq, row_kind
(SNAPSHOT or DIFF), side, price_raw, size_raw, pos (place in the update).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from depthframe.sources.shared import tasks

from .blocks import with_previous
from .book import BLOCK, bbo


def updates(stream: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row for each update, with the revision before it: book, arrival, book_seq, row_kind, previous.

    The stream is dealt by blocks once, over as many tasks as its number of rows asks for, and stays so.
    """
    dealt = stream.withColumn("block", F.expr(f"arrival div {block}")).repartition(tasks(stream), "book", "block")
    once = dealt.groupBy("book", "block", "arrival").agg(F.max("book_seq").alias("book_seq"), F.max("row_kind").alias("row_kind"), F.count(F.lit(1)).alias("levels"))
    return with_previous(once, ["book"], "arrival", "book_seq", F.col("block"), "previous").drop("block")


def gaps(stream: DataFrame) -> DataFrame:
    """Updates whose revision isn't the next one (a repeat and a step back are gaps too); the first is never one."""
    return updates(stream).where("previous IS NOT NULL AND book_seq <> previous + 1").select("book", "arrival", (F.col("previous") + 1).alias("expected"), "book_seq")


def before_first_gap(stream: DataFrame) -> DataFrame:
    """The rows that a consumer applies: those before its book's first gap."""
    first = gaps(stream).groupBy("book").agg(F.min("arrival").alias("stop"))
    return stream.join(first, "book", "left").where("stop IS NULL OR arrival < stop").drop("stop")


def client_book(stream: DataFrame) -> DataFrame:
    """The consumer's book: a snapshot clears it, a diff replaces or (size 0) deletes; the last of equal prices wins."""
    # Each price's last row is found first, with an order of one number that is aggregated by hash; the last row of all is the last one since
    # a snapshot too, or there is none.
    order = F.col("arrival").cast("decimal(38,0)") * F.lit(1 << 32).cast("decimal(10,0)") + F.col("pos")
    last = stream.groupBy("book", "side", "price_raw").agg(F.max_by("size_raw", order).alias("size_raw"), F.max("arrival").alias("arrival"))
    start = stream.where("row_kind = 'SNAPSHOT'").groupBy("book").agg(F.max("arrival").alias("start"))
    return last.join(start, "book", "left").where("size_raw > 0 AND (start IS NULL OR arrival >= start)").select("book", "side", "price_raw", "size_raw")


def run_summary(stream: DataFrame) -> DataFrame:
    """Counts of each kind of update and of gaps, and the last revision, of every book."""
    gap = F.col("previous").isNotNull() & (F.col("book_seq") != F.col("previous") + 1)
    return updates(stream).groupBy("book").agg(
        F.count_if(F.col("row_kind") == "SNAPSHOT").alias("snapshots"),
        F.count_if(F.col("row_kind") == "DIFF").alias("diffs"),
        F.count_if(gap).alias("gaps"),
        F.sum("levels").alias("levels"),
        F.max_by("book_seq", "arrival").alias("last_book_seq"),
    )


def bbo_at_diffs(diffs: DataFrame, changes: DataFrame, block: int = BLOCK) -> DataFrame:
    """The best prices that hold at every revision: the last change at or before it.

    Revisions and changes are brought together in blocks; what a block starts with comes from a running value over the
    blocks, so a book's history isn't sorted in one task; the tasks are as many as the diffs (a table) ask for.
    """
    values = ["bid_price_raw", "bid_size_raw", "ask_price_raw", "ask_size_raw"]
    kept = [F.lit(None).cast("bigint").alias(c) for c in values]
    both = diffs.select("book", "book_seq", F.lit(False).alias("changed"), *kept).unionByName(changes.select("book", "book_seq", F.lit(True).alias("changed"), *values))
    both = both.withColumn("block", F.expr(f"book_seq div {block}")).repartition(tasks(diffs), "book", "block")
    rows = both.groupBy("book", "block", "book_seq").agg(F.bool_or("changed").alias("changed"), *[F.max(c).alias(c) for c in values])
    rows = rows.select("book", "block", "book_seq", F.when(F.col("changed"), F.struct(*values)).alias("own"))
    ends = rows.groupBy("book", "block").agg(F.max_by("own", F.when(F.col("own").isNotNull(), F.col("book_seq"))).alias("end"))
    carried = F.last("end", ignorenulls=True).over(Window.partitionBy("book").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = ends.select("book", "block", carried.alias("start"))
    inside = F.last("own", ignorenulls=True).over(Window.partitionBy("book", "block").orderBy("book_seq").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("seen", inside).join(starts, ["book", "block"]).select("book", "book_seq", F.coalesce("seen", "start").alias("v")).select("book", "book_seq", *[f"v.{c}" for c in values])


def spread(levels: DataFrame) -> DataFrame:
    """bbo with the distance of the best prices."""
    return bbo(levels).withColumn("spread_raw", F.col("ask_price_raw") - F.col("bid_price_raw"))
