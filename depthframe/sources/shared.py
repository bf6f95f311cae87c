"""The folder that the driver and all executors share, and tables in it."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@cache
def _own_folder(application: str) -> str:
    return f"file://{tempfile.mkdtemp(prefix='depthframe-')}"


def scratch(spark: SparkSession) -> str:
    """Where intermediate tables go: the folder in spark.checkpoint.dir. Where it is unset, a session with a local master gets a
    new folder, as driver and tasks are one process there; any other is refused, for no folder is known to be shared.

    The key can't be set in a running session: it belongs in the session's builder or the cluster's defaults.
    """
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset: name a folder there that the driver and all executors share")
    return _own_folder(spark.conf.get("spark.app.id", ""))


_writing = threading.Lock()
_writers: dict[str, list] = {}


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """CLEANUP on while any thread of the session writes; the session's own value comes back after the last one."""
    key = spark.conf.get("spark.app.id", "")
    with _writing:
        state = _writers.setdefault(key, [0, None])
        if not state[0]:
            state[1] = spark.conf.get(CLEANUP, None)
            spark.conf.set(CLEANUP, "true")
        state[0] += 1
    try:
        yield
    finally:
        with _writing:
            state[0] -= 1
            if not state[0] and state[1] is None:
                spark.conf.unset(CLEANUP)
            elif not state[0]:
                spark.conf.set(CLEANUP, state[1])


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it back. The shuffle files of the write go at once.

    Tables stand in a folder of their application below the shared one; whoever runs the application removes that folder
    when it has ended.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/{spark.conf.get('spark.app.id', 'tables')}/{name}-{uuid.uuid4().hex}"
    with _shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of one task of a shuffle, about.
TASK_ROWS = 500_000


def tasks(rows: DataFrame) -> int:
    """How many tasks a shuffle of rows is dealt over: the session's number, or as many as keep each to ``TASK_ROWS`` rows.

    Rows are counted, so they should be a table, or derived from one by what a count leaves out.
    """
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // TASK_ROWS))
