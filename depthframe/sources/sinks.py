"""Several tables from one stream, each row in each of them exactly once.

Every micro-batch writes its part of every table to a folder named by the batch's number, replacing what an earlier attempt at
the same batch left there, and then a manifest entry of that number. Spark repeats a batch that didn't end under its old
number and with the same rows, so a repetition changes nothing; readers take the batches that the manifest has, so they see a
batch in all tables or in none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

MANIFEST = "_manifest"


def write_batch(batch: DataFrame, number: int, folder: str, outputs: dict[str, Callable[[DataFrame], DataFrame]]) -> None:
    """One micro-batch to all tables: name -> what the table takes of the batch."""
    batch = batch.persist()
    try:
        for name, take in outputs.items():
            take(batch).write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")
        batch.sparkSession.range(1).selectExpr("current_timestamp() AS committed").write.mode("overwrite").parquet(f"{folder}/{MANIFEST}/batch={number}")
    finally:
        batch.unpersist()


def stream_outputs(rows: DataFrame, folder: str, checkpoint: str, outputs: dict[str, Callable[[DataFrame], DataFrame]], **trigger) -> StreamingQuery:
    """Start a stream that writes ``outputs``; the checkpoint belongs to the folder and is used with no other."""
    writer = rows.writeStream.foreachBatch(lambda batch, number: write_batch(batch, number, folder, outputs)).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def read_output(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table as far as batches are committed, with each row's batch."""
    committed = spark.read.parquet(f"{folder}/{MANIFEST}").select("batch").distinct()
    return spark.read.parquet(f"{folder}/{name}").join(committed, "batch", "left_semi")
