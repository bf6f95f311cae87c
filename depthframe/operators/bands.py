"""Depth within price bands and average prices of notional bands, for each side of each book.

``levels`` has book, side, price_raw, size_raw and any further ``keys`` (such as a revision) that tell books apart. Lists
of thresholds are short configuration: they are literals in the plan, and every band is a conditional sum, so levels
aren't multiplied by them. A side that can't be computed has its status in every row and NULL values; the other side
is not affected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depthframe.functions.fixed import narrow, notional, offset_by_bps, over, vwap_at_partial_fill, wide, within_bps
from depthframe.types import OUT_OF_DOMAIN, OUT_OF_RANGE

from .book import is_valid_level, side_order

DEFAULT_BPS = (50, 100, 200, 500, 1000)
DEFAULT_NOTIONALS = tuple(n * 10**15 for n in (1, 5, 10, 25, 50))
SIDES = ("BID", "ASK")
OK = "OK"


def check_bps(bps: list[int]) -> None:
    if list(bps) != sorted(bps) or any(b < 0 or b >= 10000 for b in bps):
        raise ValueError(f"basis points must be in order, from 0 to 9999: {bps}")


def check_thresholds(thresholds: list[int]) -> None:
    if list(thresholds) != sorted(thresholds) or any(t <= 0 for t in thresholds):
        raise ValueError(f"thresholds must be in order and positive: {thresholds}")


def _bands(rows: DataFrame, bps: list[int], group: list[str]) -> DataFrame:
    """rows: group, side, price_raw, size_raw (NULL: no level), reference, visited."""
    side, price, size, reference = (F.col(c) for c in ("side", "price_raw", "size_raw", "reference"))
    there = price.isNotNull()
    rows = rows.withColumn("notional_raw", notional(price, size))
    total = lambda c, inside: F.coalesce(F.sum(F.when(there & inside, wide(c))), F.lit(0))
    sums = []
    for i, b in enumerate(bps):
        inside = within_bps(price, reference, F.lit(b), side)
        sums += [total(size, inside).alias(f"size{i}"), total(F.col("notional_raw"), inside).alias(f"notional{i}")]
    widest = within_bps(price, reference, F.lit(bps[-1]), side)
    bad = F.coalesce(F.bool_or(there & F.col("visited") & ~is_valid_level(price, size)), F.lit(False)) | (F.max("reference") <= 0)
    lost = F.coalesce(F.bool_or(there & widest & F.col("notional_raw").isNull()), F.lit(False))
    sides = rows.groupBy(*group, "side").agg(F.max("reference").alias("reference"), bad.alias("bad"), lost.alias("lost"), *sums)
    bands = [F.struct(F.lit(i).alias("ord"), F.lit(b).alias("bps"), offset_by_bps(reference, F.lit(b), side).alias("boundary_raw"), narrow(F.col(f"size{i}")).alias("cum_size_raw"), narrow(F.col(f"notional{i}")).alias("cum_notional_raw")) for i, b in enumerate(bps)]
    out = sides.withColumn("bands", F.array(*bands))
    hole = F.exists("bands", lambda x: x["boundary_raw"].isNull() | x["cum_size_raw"].isNull() | x["cum_notional_raw"].isNull())
    out = out.withColumn("status", F.when(F.col("bad"), OUT_OF_DOMAIN).when(F.col("lost") | hole, OUT_OF_RANGE).otherwise(OK))
    out = out.select(*group, "side", "status", F.explode("bands").alias("x"))
    value = lambda c: F.when(F.col("status") == OK, F.col(f"x.{c}")).alias(c)
    return out.select(*group, "side", "x.ord", "x.bps", value("boundary_raw"), value("cum_size_raw"), value("cum_notional_raw"), "status")


def _visited(group: list[str], bps: list[int]) -> Column:
    """Whether the walk from the best level reaches this one: it stops after the first one beyond the widest band."""
    order = Window.partitionBy(*group, "side").orderBy(side_order(F.col("side"), F.col("price_raw")))
    return F.coalesce(F.lag(within_bps(F.col("price_raw"), F.col("reference"), F.lit(bps[-1]), F.col("side"))).over(order), F.lit(True))


def price_bands(levels: DataFrame, bps: list[int] = DEFAULT_BPS, keys: tuple[str, ...] = ()) -> DataFrame:
    """Depth within each band of a side's own best price. A side without levels has no rows."""
    check_bps(bps)
    group = ["book", *keys]
    best = F.abs(F.min(side_order(F.col("side"), F.col("price_raw"))).over(Window.partitionBy(*group, "side")))
    rows = levels.select(*group, "side", "price_raw", "size_raw").withColumn("reference", best)
    return _bands(rows.withColumn("visited", _visited(group, bps)), list(bps), group)


def price_bands_at(levels: DataFrame, references: DataFrame, bps: list[int] = DEFAULT_BPS, keys: tuple[str, ...] = ()) -> DataFrame:
    """Depth within each band of a given price, ``reference`` in references (book, *keys). A side without levels has depth 0."""
    check_bps(bps)
    group = ["book", *keys]
    sides = references.select(*group, "reference", F.explode(F.array(*[F.lit(s) for s in SIDES])).alias("side"))
    rows = sides.join(levels.select(*group, "side", "price_raw", "size_raw"), [*group, "side"], "left")
    return _bands(rows.withColumn("visited", _visited(group, bps)), list(bps), group)


def volume_bands(levels: DataFrame, thresholds: list[int] = DEFAULT_NOTIONALS, keys: tuple[str, ...] = ()) -> DataFrame:
    """Average price that fills each notional, walking from the best price; NULL and what there is if a side is too thin."""
    check_thresholds(thresholds)
    group = ["book", *keys]
    price, size = F.col("price_raw"), F.col("size_raw")
    before = Window.partitionBy(*group, "side").orderBy(side_order(F.col("side"), price)).rowsBetween(Window.unboundedPreceding, -1)
    rows = levels.select(*group, "side", "price_raw", "size_raw", notional(price, size).alias("n"))
    rows = rows.withColumn("cum_n", F.coalesce(F.sum(wide(F.col("n"))).over(before), wide(0))).withColumn("cum_s", F.coalesce(F.sum(wide(size)).over(before), wide(0)))
    wanted = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(t).cast("bigint").alias("threshold_raw")) for i, t in enumerate(thresholds)])
    crossed = F.filter(wanted, lambda t: (F.col("cum_n") < t["threshold_raw"]) & (t["threshold_raw"] <= F.col("cum_n") + F.col("n")))

    def filled(t: Column) -> Column:
        rest = t["threshold_raw"] - F.col("cum_n")
        # At the level's far edge its size is known exactly; else it follows from the price.
        exact = over(t["threshold_raw"], F.col("cum_s") + size)
        return F.struct(t["ord"].alias("ord"), F.when(rest == F.col("n"), exact).otherwise(vwap_at_partial_fill(F.col("cum_n"), F.col("cum_s"), rest, price)).alias("vwap_raw"))

    rows = rows.withColumn("crossed", F.coalesce(F.transform(crossed, filled), F.lit([]).cast("array<struct<ord:int,vwap_raw:bigint>>")))
    sides = rows.groupBy(*group, "side").agg(
        F.flatten(F.collect_list("crossed")).alias("crossed"),
        F.sum(wide(F.col("n"))).alias("total"),
        F.bool_or(~is_valid_level(price, size)).alias("bad"),
        F.bool_or(F.col("n").isNull()).alias("lost"),
    )
    every = levels.select(*group).distinct().withColumn("side", F.explode(F.array(*[F.lit(s) for s in SIDES])))
    sides = every.join(sides, [*group, "side"], "left").withColumn("total", F.coalesce("total", F.lit(0)))
    fault = F.coalesce(F.col("lost"), F.lit(False)) | narrow(F.col("total")).isNull() | F.coalesce(F.exists("crossed", lambda x: x["vwap_raw"].isNull()), F.lit(False))
    sides = sides.withColumn("status", F.when(F.col("bad"), OUT_OF_DOMAIN).when(fault, OUT_OF_RANGE).otherwise(OK))
    out = sides.select(*group, "side", "status", "total", "crossed", F.explode(wanted).alias("t"))
    hit = F.get(F.filter("crossed", lambda x: x["ord"] == F.col("t.ord")), F.lit(0))
    out = out.withColumn("hit", hit)
    ok = F.col("status") == OK
    return out.select(
        *group,
        "side",
        F.col("t.ord").alias("ord"),
        F.col("t.threshold_raw").alias("threshold_raw"),
        F.when(ok, F.col("hit.vwap_raw")).alias("vwap_raw"),
        F.when(ok, F.when(F.col("hit").isNotNull(), F.col("t.threshold_raw")).otherwise(narrow(F.col("total")))).alias("filled_raw"),
        "status",
    )


def at_revisions(diffs: DataFrame, every: int) -> DataFrame:
    """The aggregate book at each revision that ``every`` divides: book, book_seq, side, price_raw, size_raw.

    A level stands in the sampled revisions from its own change to the one before the next change of its price.
    """
    following = Window.partitionBy("book", "side", "price_raw").orderBy("book_seq")
    last = diffs.groupBy("book").agg(F.max("book_seq").alias("last_seq"))
    held = diffs.withColumn("next_seq", F.lead("book_seq").over(following)).where("size_raw > 0").join(last, "book")
    first = F.ceil(F.col("book_seq") / F.lit(every))
    final = F.expr(f"(coalesce(next_seq - 1, last_seq)) div {every}")
    held = held.withColumn("first", first).withColumn("final", final).where("first <= final")
    steps = F.transform(F.sequence("first", "final"), lambda k: k * every)
    return held.select("book", F.explode(steps).alias("book_seq"), "side", "price_raw", "size_raw")


def mid_references(bbo: DataFrame) -> DataFrame:
    """(book, reference): the mid price of books that have both sides, rounded down."""
    return bbo.where("bid_price_raw IS NOT NULL AND ask_price_raw IS NOT NULL").select("book", F.expr("(bid_price_raw + ask_price_raw) div 2").alias("reference"))
