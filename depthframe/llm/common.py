"""Helpers that several operators share: word counts, slices of batches, hashes. Tables in the shared folder are of ``sources.shared``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depthframe.sources.shared import materialize

__all__ = ["Powers", "RollingHash", "STEP_BYTES", "WORD", "in_order", "materialize", "mix64", "text_slices", "valid_text", "word_count"]

#: A word is a maximal run of anything but ASCII white space, as bytes.split() has it too.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a Python step turns into numpy arrays at once; a longer text is a step of its own.
STEP_BYTES = 1 << 21


def word_count(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def valid_text(column: str) -> Column:
    """A column as text that Python can read: bytes that are no UTF-8 become U+FFFD."""
    return F.make_valid_utf8(F.col(column).cast("string"))


def text_slices(batches: Iterator[pa.RecordBatch], column: str, step: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``step`` bytes of text (or one longer text)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch[column]), 0))
        part = (np.cumsum(sizes.astype(np.int64)) - sizes) // step
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


def in_order(rows: DataFrame, keys: list[str | Column], name: str) -> DataFrame:
    """rows, written in one global order by keys, with ``part`` and ``nth``: the range of the order that a row is in, and its
    place there from 0. Parts follow each other; a part without rows has no number of its own in the result. The rows are
    written once before, so that the sampling of ranges doesn't compute them a second time."""
    at = materialize(rows, f"{name}-found").repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("nth", F.monotonically_increasing_id())
    at = at.withColumns({"part": F.shiftright("nth", 33), "nth": F.col("nth").bitwiseAND(F.lit((1 << 33) - 1))})
    return materialize(at, name)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that every bit depends on all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, as far as asked for."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            self.up, self.down = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)])) for b in (self.base, self.inverse))
        return self.up, self.down


class RollingHash:
    """Polynomial (Rabin-Karp) hashes modulo 2**64 of any spans of a sequence, from one array of prefix sums."""

    def __init__(self, powers: Powers, values: np.ndarray):
        up, self.down = powers.upto(len(values) + 1)
        self.prefix = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=self.prefix[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.prefix[ends] - self.prefix[starts]) * self.down[starts]
