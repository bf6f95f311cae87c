"""String columns may hold bytes that are no UTF-8: they count as U+FFFD in every operator that reads texts in Python."""

from pyspark.sql import functions as F

from depthframe.llm import fingerprints, near_copies, quality, simhash, substring_dedup, toxicity

BROKEN = "CAST(CAST('some plain words ' AS BINARY) || X'FFC3' || CAST(' and the end of it' AS BINARY) AS STRING)"


def test_bytes_that_are_no_text(spark):
    rows = "SELECT 1L AS doc_id, {0} AS text, 'x' AS source UNION ALL SELECT 2L, make_valid_utf8({0}), 'x' UNION ALL SELECT 3L, 'other words here', 'y'"
    broken = spark.sql(rows.format(BROKEN))
    valid = broken.withColumn("text", F.make_valid_utf8("text"))
    assert broken.where("NOT is_valid_utf8(text)").count() == 1
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in (1, 2, 3)], "doc_id long, quality int, toxic int")
    for run in (
        lambda d: quality.classify(d, labels),
        lambda d: toxicity.classify(d, labels),
        lambda d: simhash.near_duplicates(d),
        lambda d: substring_dedup.substring_dedup(d),
        lambda d: fingerprints.with_next(d),
        lambda d: near_copies.keep_one(d).select("doc_id"),
    ):
        assert sorted(map(str, run(broken).collect())) == sorted(map(str, run(valid).collect()))
