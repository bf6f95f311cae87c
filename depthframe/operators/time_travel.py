"""Books at many points of their history at once, without a range join and without reading the history for each point.

``books_as_of`` numbers the points of a book and cuts them in blocks. The aggregate size of a price holds for a run of points: it
meets each block that the run touches by an equality join, once, and takes its points from there. So every piece that is joined
gives a row at least, each row is a result, and a block is met by as many rows as the book is deep or changes within it.

Keyframes are written once: the book before every run of ``every`` revisions, beside the run's diffs, in a folder of
its own. A revision is then read from one folder, its image and a bounded tail, and the scan prunes all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depthframe.sources.shared import materialize

from .bbo import replay_blocks
from .book import BLOCK, SPAN_BLOCKS, changes

#: Revisions between keyframes.
EVERY = 4096
#: Points of a block of ``books_as_of``. Any number gives the same rows.
POINTS_PER_BLOCK = 64


def dyadic_cover(start: Column, end: Column, bits: int) -> Column:
    """The blocks (level, block) that make up start to end - 1, of numbers from 0 under 2**bits.

    At level k the interval still to be covered runs from block ceil(start / 2**k) to floor(end / 2**k); an odd first block, and
    the last one before an odd end, have no partner to form a block of the next level with, so they are taken.
    """

    def at(k: Column) -> Column:
        low, high = F.call_function("shiftright", start + F.call_function("shiftleft", F.lit(1).cast("bigint"), k) - 1, k), F.call_function("shiftright", end, k)
        block = lambda taken, x: F.when(taken, F.struct(k.cast("int").alias("level"), x.alias("block")))
        odd = low % 2 == 1
        return F.array(block(odd & (low < high), low), block((high % 2 == 1) & (low + odd.cast("bigint") < high), high - 1))

    return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(bits)), at)), lambda x: x.isNotNull())


def books_as_of(intervals: DataFrame, points: DataFrame, points_per_block: int = POINTS_PER_BLOCK) -> DataFrame:
    """book, seq, side, price_raw, size_raw: the aggregate book just after message seq, for every distinct (book, seq) of points.

    intervals are as from ``book.level_intervals``. A point where a book is empty gives no rows.
    """
    k, span, level = points_per_block, F.expr(f"seq div {BLOCK * SPAN_BLOCKS}").alias("span"), ["book", "side", "price_raw"]
    points = points.select("book", "seq").where("book IS NOT NULL AND seq IS NOT NULL").distinct()
    # Changes and points in one order, a change before the point that it counts for: both get the number of points so far.
    both = changes(intervals).unionByName(points, allowMissingColumns=True).select("*", span)
    both = materialize(both, "as-of-events")  # its points are counted before they are numbered
    earlier = Window.partitionBy("book").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    before = both.groupBy("book", "span").agg(F.count_if(F.col("side").isNull()).alias("n")).select("book", "span", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    here = Window.partitionBy("book", "span").orderBy("seq", F.col("side").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("n", F.count_if(F.col("side").isNull()).over(here)).join(before, ["book", "span"]).withColumn("n", F.col("n") + F.col("before"))
    both = materialize(both.drop("before"), "as-of-numbered")
    asked = both.where("side IS NULL").groupBy("book", F.expr(f"(n - 1) div {k}").alias("block")).agg(F.sort_array(F.collect_list("seq")).alias("seqs"))
    # A size holds for the points from its own number up to that of the price's next change, in places from 0.
    rows = both.where("side IS NOT NULL")
    begins = rows.groupBy(*level, "span").agg(F.min("n").alias("n"))
    begins = begins.select(*level, "span", F.lead("n").over(Window.partitionBy(*level).orderBy("span")).alias("later"))
    last = asked.groupBy("book").agg(F.sum(F.size("seqs")).alias("points"))
    following = F.lead("n").over(Window.partitionBy(*level, "span").orderBy("seq"))
    held = rows.withColumn("end", following).join(begins, [*level, "span"]).join(last, "book").withColumn("end", F.coalesce("end", "later", "points"))
    held = held.where("size_raw > 0 AND n < end").withColumn("block", F.explode(F.sequence(F.expr(f"n div {k}"), F.expr(f"(end - 1) div {k}"))))
    start, stop = F.greatest(F.col("n") - F.col("block") * k, F.lit(0)), F.least(F.col("end") - F.col("block") * k, F.lit(k))
    return held.join(asked, ["book", "block"]).select("book", F.explode(F.slice("seqs", (start + 1).cast("int"), (stop - start).cast("int"))).alias("seq"), "side", "price_raw", "size_raw")


def write_keyframes(diffs: DataFrame, path: str, every: int = EVERY) -> None:
    """Write diffs by (book, block of ``every`` revisions), each with the book before it as rows of revision 0."""
    rows = replay_blocks(diffs, every).repartition("book", "block").sortWithinPartitions("book", "block", "book_seq")
    rows.write.partitionBy("book", "block").parquet(path)


def book_from_keyframes(frames: DataFrame, book, book_seq: int, every: int = EVERY) -> DataFrame:
    """side, price_raw, size_raw of one book at one revision, read from one folder of ``write_keyframes``."""
    rows = frames.where((F.col("book") == book) & (F.col("block") == (book_seq - 1) // every) & (F.col("book_seq") <= book_seq))
    return rows.groupBy("side", "price_raw").agg(F.max_by("size_raw", "book_seq").alias("size_raw")).where("size_raw > 0")


def books_from_keyframes(frames: DataFrame, at: DataFrame, every: int = EVERY) -> DataFrame:
    """book, book_seq, side, price_raw, size_raw for every distinct (book, book_seq) of ``at``; folders without any are not read.

    A folder's sizes hold for runs of its revisions, and meet the revisions asked for by dyadic blocks: a
    revision costs the depth of its book, however many of the folder's rows come before it.
    """
    wanted = at.select("book", F.col("book_seq").alias("at")).distinct().withColumn("block", F.expr(f"(at - 1) div {every}"))
    rows = frames.join(wanted.select("book", "block").distinct(), ["book", "block"], "left_semi")
    place = F.greatest(F.col("book_seq") - F.col("block") * every, F.lit(0))  # 0: the book before the folder's first revision
    rows = rows.select("book", "block", "side", "price_raw", "size_raw", place.cast("bigint").alias("start"))
    following = F.lead("start").over(Window.partitionBy("book", "block", "side", "price_raw").orderBy("start"))
    held = rows.withColumn("end", F.coalesce(following, F.lit(every + 1))).where("size_raw > 0")
    bits = (every + 1).bit_length()
    held = held.select("book", "block", "side", "price_raw", "size_raw", F.inline(dyadic_cover(F.col("start"), F.col("end"), bits)).alias("level", "run"))
    asked = wanted.select("book", "block", "at", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("level"))
    asked = asked.withColumn("run", F.call_function("shiftright", F.col("at") - F.col("block") * every, F.col("level")))
    return held.join(asked, ["book", "block", "level", "run"]).select("book", F.col("at").alias("book_seq"), "side", "price_raw", "size_raw")
