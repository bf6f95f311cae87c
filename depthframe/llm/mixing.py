"""Mixing sources to target weights, with DataFrame operations only.

Every row gets a hash-random key. Within each source the rows stand in the order of their keys; a prefix sum of their
sizes says which of them the source's budget reaches: whole epochs count for every row, and the last, partial epoch
takes rows in key order and cuts the one that crosses the budget, so a source's total is its budget rounded down.

How it scales. Keys are uniform, so equal ranges of the key are equal shares of a source. Each source is split into
as many key ranges as its row count asks for (``ROWS_PER_RANGE``), so a source with a third of all rows is dealt over
many tasks. Prefix sums take three steps: a sum per (source, range) with partial aggregation, a running sum over those
few rows, and a running sum inside each range. Texts are read once for their sizes; only keys and sizes are shuffled.
Rows whose doc_id isn't theirs alone get keys of their own from id, text and number of the copy, so neither an id nor a
row that makes up much of the table falls into one range.

Defined cases: a null text has size 0; null is a source of its own, after all others; null is a doc_id like any other;
rows with equal doc_id and text are interchangeable; an empty table gives no rows; columns other than
doc_id, text and source are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, word_count

#: Weights of the sources in their order, repeating.
WEIGHTS = (5, 2, 1)
#: All targets together, in hundredths of all sizes.
TOTAL_PERCENT = 150
#: A target stops at so many times its source's size.
MAX_EPOCHS = 2
ROWS_PER_RANGE = 4096

SOURCE = ["no_source", "source_name"]


IDENTITY = ["doc_id", *SOURCE, "size", "tie"]


def random_key(seed: str, *parts: Column) -> Column:
    """60 bits that depend on the parts alone, so that reruns agree."""
    named = [F.coalesce(p.cast("string"), F.lit("null")) for p in parts]
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.concat_ws(":", *named))), 1, 15), 16, 10).cast("long")


def keyed(rows: DataFrame, seed: str) -> DataFrame:
    """Add ``key`` to written rows of IDENTITY: from the id where it is on one row, or else from the row and its copy's number.

    Copies are counted by part of the table first, then numbered through by those counts, and dealt out again by part.
    """
    ids = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select(F.col("doc_id").alias("repeated"), "times")
    marked = materialize(rows.join(ids, F.col("doc_id").eqNullSafe(F.col("repeated")), "left").drop("repeated"), "mix-ids")
    single = marked.where("times IS NULL").select(*IDENTITY, random_key(seed, F.col("doc_id")).alias("key"))
    parts = marked.where("times IS NOT NULL").withColumn("part", F.spark_partition_id()).groupBy(*IDENTITY, "part").agg(F.count(F.lit(1)).alias("copies"))
    so_far = Window.partitionBy(*IDENTITY).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("copies").over(so_far), F.lit(0))).repartition("tie", "part")
    copies = parts.withColumn("copy", F.explode(F.sequence(F.col("before") + 1, F.col("before") + F.col("copies"))))
    row = random_key(seed, *[F.col(c) for c in ("doc_id", *SOURCE, "tie", "copy")])
    return single.unionByName(copies.select(*IDENTITY, row.alias("key")))


def source_targets(sources: DataFrame, weights=WEIGHTS, total_percent: int = TOTAL_PERCENT, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Add ``target`` to one row per source (source_size, no_source, source_name): shares by weight, none above its cap.

    Sharing the excess again and again ends at one level L with target = least(cap, weight * L). In order of cap per
    weight, L is what remains after the caps of all rows before, divided by the weights from this row on, at the first
    row whose own cap isn't reached by it. One row per source: this table doesn't grow with the documents.
    """
    everything = Window.partitionBy(F.lit(0))
    by_name = everything.orderBy(*SOURCE)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1).cast("long")
    ranked = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_epochs)
    by_ratio = everything.orderBy((F.col("cap") / F.col("weight")), *SOURCE)
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum("source_size").over(everything) * total_percent - before * 100) / (rest * 100)
    levels = ranked.withColumn("level", level).withColumn("position", F.row_number().over(by_ratio))
    reached = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct("position", "level"))
    out = levels.withColumn("fill", F.min(reached).over(everything)["level"])
    return out.withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * F.coalesce("fill", F.lit(0.0)))).drop("level", "position", "fill", "cap")


def mix(docs: DataFrame, weights=WEIGHTS, total_percent: int = TOTAL_PERCENT, max_epochs: int = MAX_EPOCHS, seed: str = "") -> DataFrame:
    """doc_id, source, size, source_size, target and taken (words of it in the mix) of every row."""
    doc_id, text, source = F.col("doc_id"), F.col("text"), F.col("source")
    rows = docs.select(
        doc_id.alias("doc_id"),
        source.isNull().cast("int").alias("no_source"),
        F.coalesce(source.cast("string"), F.lit("")).alias("source_name"),
        word_count(text).alias("size"),
        F.xxhash64(text).alias("tie"),
    )
    rows = materialize(keyed(materialize(rows, "mix-sizes"), seed), "mix-rows")
    sources = rows.groupBy(*SOURCE).agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n_rows") / ROWS_PER_RANGE))).cast("int")
    sources = materialize(source_targets(sources, weights, total_percent, max_epochs).withColumn("bits", bits), "mix-sources")

    dealt = rows.join(sources, SOURCE).withColumn("range", F.expr("shiftright(key, 60 - bits)"))
    sums = dealt.groupBy(*SOURCE, "range").agg(F.sum("size").alias("range_size"))
    earlier = Window.partitionBy(*SOURCE).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(sums.select(*SOURCE, "range", F.coalesce(F.sum("range_size").over(earlier), F.lit(0)).alias("range_start")), "mix-offsets")

    inside = Window.partitionBy(*SOURCE, "range").orderBy("key", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.join(offsets, [*SOURCE, "range"]).withColumn("start", F.col("range_start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    part = F.least(F.col("size"), F.greatest(F.lit(0), budget - epochs * F.col("source_size") - F.col("start")))
    return placed.select(
        "doc_id",
        F.when(F.col("no_source") == 0, F.col("source_name")).alias("source"),
        "size",
        "source_size",
        "target",
        (epochs * F.col("size") + part).cast("long").alias("taken"),
    )
