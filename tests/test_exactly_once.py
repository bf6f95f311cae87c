"""A stream that is stopped between two of its outputs and started again."""

import pytest
from pyspark.errors import StreamingQueryException

from depthframe.sources.messages import write_in_order
from depthframe.sources.sinks import read_output, stream_outputs


def test_stopped_between_two_outputs(spark, tmp_path):
    rows = spark.range(400).selectExpr("id AS seq", "id % 7 AS book")
    write_in_order(rows, "seq", str(tmp_path / "in"), 100)
    folder, checkpoint, fail = str(tmp_path / "out"), str(tmp_path / "state"), [True]

    def second(batch):
        if fail[0] and batch.where("seq >= 200").head(1):
            raise RuntimeError("stopped")
        return batch.where("book = 3")

    def start():
        source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        return stream_outputs(source, folder, checkpoint, {"every": lambda b: b, "third": second}, availableNow=True)

    with pytest.raises(StreamingQueryException):
        start().awaitTermination()
    seen = read_output(spark, folder, "every")
    on_disk = spark.read.parquet(f"{folder}/every").count()
    assert 0 < seen.count() < on_disk  # the batch that broke off has left rows that no reader takes
    assert seen.where("book = 3").count() == read_output(spark, folder, "third").count()
    fail[0] = False
    start().awaitTermination()
    for name, wanted in (("every", rows), ("third", rows.where("book = 3"))):
        assert sorted(map(tuple, read_output(spark, folder, name).select("seq", "book").collect())) == sorted(map(tuple, wanted.collect()))
    start().awaitTermination()  # nothing new: nothing changes
    assert read_output(spark, folder, "every").count() == 400
