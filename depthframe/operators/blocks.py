"""Looking back along a long history without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depthframe.sources.shared import materialize


def with_previous(rows: DataFrame, keys: list[str], order: str, value: str, block: Column, name: str) -> DataFrame:
    """rows with column ``name``: the value of the row before, by ``order`` within keys; NULL for a key's first row.

    ``block`` grows with order. Rows are ranked within blocks; the first of a block takes the last value of the blocks
    before it, from a window over as few rows as there are blocks. Any blocks give the same rows.
    """
    here = F.struct(F.col(value).alias("value"))
    rows = rows.withColumn("__block", block)
    inside = F.lag(here).over(Window.partitionBy(*keys, "__block").orderBy(order))
    ends = rows.groupBy(*keys, "__block").agg(F.max_by(here, order).alias("__end"))
    earlier = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select(*keys, "__block", F.last("__end").over(earlier).alias("__start"))
    found = rows.withColumn("__own", inside).join(starts, [*keys, "__block"])
    return found.withColumn(name, F.coalesce("__own", "__start")["value"]).drop("__block", "__own", "__start")


def dense_numbers(rows: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """The distinct (key, *order) of rows with ``name``: 1, 2, ... within key, in that order.

    Rows are dealt and sorted by ranges of (key, *order), and numbered by their place in their range plus what earlier ranges
    hold of their key, so a key with a third of all rows is no task's.
    """
    by = [key, *order]
    found = materialize(rows.select(*by).distinct(), f"{name}-found")  # so that the sampling of ranges doesn't compute it again
    placed = found.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__nth", F.monotonically_increasing_id())
    placed = materialize(placed.withColumn("__part", F.shiftright("__nth", 33)), name)
    runs = placed.groupBy(key, "__part").agg(F.min("__nth").alias("__first"), F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(key, "__part", (F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first") + 1).alias("__shift"))
    return placed.join(runs, [key, "__part"]).select(*by, (F.col("__nth") + F.col("__shift")).alias(name))
