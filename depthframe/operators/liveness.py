"""Which venues feed a book: at ticks, at the end, and by silence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depthframe.types import INVALIDATE

from .blocks import with_previous


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a time, as its clock shows it."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def last_actions(levels: DataFrame) -> DataFrame:
    """book, venue, kind of each venue's last message."""
    return levels.groupBy("book", "venue").agg(F.max_by("kind", "seq").alias("kind"))


def live_venues(levels: DataFrame) -> DataFrame:
    """book, live_venues (sorted): those whose last message isn't an invalidation. A live venue may hold no level."""
    return last_actions(levels).groupBy("book").agg(F.sort_array(F.collect_list(F.when(F.col("kind") != INVALIDATE, F.col("venue")))).alias("live_venues"))


def live_venues_at_ticks(levels: DataFrame, step: int) -> DataFrame:
    """book, tick, live_venues at every multiple of step, from each venue's last message up to it.

    A venue's messages are first cut down to the last one before each tick; that one holds until the tick where another
    takes over, so nothing is compared with all ticks.
    """
    tick = F.ceil(F.col("seq") / F.lit(step)).cast("bigint")
    last = levels.groupBy("book", "venue", tick.alias("tick")).agg(F.max_by("kind", "seq").alias("kind"))
    ends = last.groupBy("book").agg(F.max("tick").alias("end"))
    until = F.lead("tick").over(Window.partitionBy("book", "venue").orderBy("tick")) - 1
    spans = last.withColumn("until", until).join(ends, "book").where(F.col("kind") != INVALIDATE)
    at = spans.select("book", "venue", F.explode(F.sequence("tick", F.coalesce("until", "end"))).alias("tick"))
    return at.groupBy("book", (F.col("tick") * step).alias("tick")).agg(F.sort_array(F.collect_list("venue")).alias("live_venues"))


def silent_spells(messages: DataFrame, timeouts: DataFrame, default_seconds: int, block_seconds: int = 3600) -> DataFrame:
    """venue, silent_from, silent_until, silent_us, timeout: where a venue said nothing for longer than its timeout.

    messages: venue, ts. timeouts: venue, seconds (overrides; others have the default). Messages are sorted within blocks
    of time, so a venue with many isn't sorted in one task.
    """
    block = F.floor(micros(F.col("ts")) / F.lit(block_seconds * 1_000_000))
    gaps = with_previous(messages.select("venue", "ts"), ["venue"], "ts", "ts", block, "silent_from").where("silent_from IS NOT NULL")
    gaps = gaps.withColumn("silent_us", micros(F.col("ts")) - micros(F.col("silent_from")))
    limits = with_timeout(gaps, timeouts, default_seconds)
    return limits.where(F.col("silent_us") > F.col("timeout").cast("bigint") * 1_000_000).select("venue", "silent_from", F.col("ts").alias("silent_until"), "silent_us", "timeout")


def with_timeout(rows: DataFrame, timeouts: DataFrame, default_seconds: int) -> DataFrame:
    """rows with their venue's timeout: the override, or the default."""
    return rows.join(timeouts.select("venue", F.col("seconds").alias("override")), "venue", "left").withColumn("timeout", F.coalesce("override", F.lit(default_seconds))).drop("override")
