"""Labelled rows for the classifiers: which to learn from, and a bounded sample of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import valid_text

#: Labelled rows that a classifier is fitted on, about; with more labels, ids whose hash is small are taken.
SAMPLE_ROWS = 6_000
#: Rows whose crc32(doc_id as text) leaves this remainder modulo FOLDS are never learnt from.
FOLDS, HELD_OUT = 4, 2


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, text, label as 0 or 1) of labelled rows outside the held-out fold, about ``sample_rows`` of them.

    Labels that are null or not 0 or 1, and ids that are null, teach nothing; an id labelled twice counts by its largest
    label, and an id on several rows by its smallest text, so that copies don't add to the sample. The ids are chosen by a
    hash, so reruns agree and no order of the data matters.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    marks = marks.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    marks = marks.groupBy("doc_id").agg(F.max("label").alias("label"))
    share = min(1.0, sample_rows / max(1, marks.count()))
    marks = marks.where(F.pmod(F.xxhash64(F.lit(label), "doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(valid_text("text"), F.lit("")).alias("text"))
    return texts.join(marks, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
