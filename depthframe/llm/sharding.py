"""Contiguous balanced shards, with DataFrame operations only: byte sums of the parts of one global order, cut at equal targets.

Rows are dealt by ranges of doc_id (null first; ties by the text's CRC-32, its size and the row's place) and sorted, so the
parts follow each other. A running sum over the parts' totals gives every part the bytes and rows before it. With
T bytes in all, a row belongs to the shard in whose eighth of T (``n_shards``-th, in general) the middle of its own bytes
lies, so a shard's bytes miss T / n_shards by at most half the sizes of the two rows at its cuts.

How it scales. Texts are read once, for their size and checksum; one shuffle of some fifty bytes a row puts them in order.
The window over totals has one row a part. A part that no cut falls in has one shard; only the parts that hold a cut,
at most n_shards - 1 of them, are summed row by row. Equal ids are split like any others, by text and place.

Defined cases: a null text has size 1 and checksum 0; null ids come first; equal rows are interchangeable; fewer rows than shards
leave shards empty; an empty table gives no rows; columns besides doc_id and text are read by ``write_shards`` alone, and
may have any names. Copies of a text aren't kept together: a group of copies can be larger than a shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_order, materialize

SHARDS = 8
#: The law that the shards obey: their sizes are near equal.
LAW = "bytes"


def _placed(docs: DataFrame, n_shards: int, *carried) -> DataFrame:
    """doc_id, size, text_crc32, carried columns, shard and slot of every row, in parts of the global order."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").alias("doc_id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("place"),
        *carried,
    )
    rows = in_order(rows, ["doc_id", "text_crc32", "size", "place"], "shard-rows").drop("place")

    order = Window.partitionBy(F.lit(0)).orderBy("part")
    before = lambda c: F.coalesce(F.sum(c).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = rows.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    totals = totals.select("part", "bytes", before("bytes").alias("bytes_before"), before("n").alias("rows_before"), F.sum("bytes").over(Window.partitionBy(F.lit(0))).alias("total"))
    shard_of = lambda twice: F.expr(f"CAST(({twice}) * {n_shards}L div (2L * total) AS INT)")
    totals = totals.withColumns({"low": shard_of("2L * bytes_before"), "high": shard_of("2L * (bytes_before + bytes)")})
    totals = materialize(totals, "shard-parts")

    # Where each shard begins: (part, nth, shard), from whole parts and from the rows of the parts that are cut.
    whole = totals.where("low = high").select("part", F.lit(0).cast("long").alias("nth"), F.col("low").alias("shard"))
    cut = rows.select("part", "nth", "size").join(totals.where("low <> high"), "part")
    start = F.coalesce(F.sum("size").over(Window.partitionBy("part").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = cut.withColumn("start", F.col("bytes_before") + start).withColumn("shard", shard_of("2L * start + size"))
    begins = materialize(whole.unionByName(cut.groupBy("part", "shard").agg(F.min("nth").alias("nth"))), "shard-begins")
    first = begins.join(totals.select("part", "rows_before"), "part").groupBy("shard").agg(F.min(F.col("rows_before") + F.col("nth")).alias("first"))
    runs = begins.join(first, "shard").groupBy("part").agg(F.sort_array(F.collect_list(F.struct("nth", "shard", "first"))).alias("runs"))
    runs = materialize(runs.join(totals.select("part", "rows_before"), "part"), "shard-runs")

    found = rows.join(runs, "part").withColumn("run", F.element_at(F.filter("runs", lambda r: r["nth"] <= F.col("nth")), -1))
    return found.withColumn("shard", F.col("run.shard")).withColumn("slot", F.col("rows_before") + F.col("nth") - F.col("run.first"))


def assign(docs: DataFrame, n_shards: int = SHARDS) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text and 1), text_crc32, shard and slot (from 0 in each shard) of every row."""
    return _placed(docs, n_shards).select("doc_id", "size", "text_crc32", "shard", "slot")


def write_shards(docs: DataFrame, folder: str, n_shards: int = SHARDS) -> None:
    """Write whole rows as Parquet below folder/shard=K, each file a run of slots of its shard, named by their order.

    Files hold one struct ``row`` with all columns, and ``slot``. A shard has a file for each part of the order that it covers.
    """
    carried = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    _placed(docs, n_shards, carried).select("row", "slot", "shard").write.partitionBy("shard").parquet(folder)
