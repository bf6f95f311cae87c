"""Document fingerprints from prefix polynomial hashes.

``PrefixHash`` keeps, for a text, the polynomial hashes of all its prefixes modulo two primes. Any span's hash follows
from two of them, so two spans of any texts are compared at once, and the longest common extension of two places
is found by binary search.

A fingerprint is a short string made from these arrays: the hash of the whole text, its length, the smallest span hash
in each of ``BINS`` classes (a sketch of all spans of ``SPAN`` code points), and the hashes of the prefixes whose lengths
stand on a fixed grid. Likeness of two fingerprints, without the texts, is the larger of two numbers: the share of bins
that agree, and the share of the longer text that the longest agreeing grid prefix covers (found by binary search: equal
prefixes have equal shorter prefixes). Equal texts have equal fingerprints and likeness 1.

``with_next`` also builds each document's edited text from the next document by ascending doc_id. One shuffle puts the
(compressed) texts in order; each task walks its range and holds two documents at a time. A range's last document meets
the first one of the next range in a small second step, two rows for each range.

Defined cases: null text is empty; bytes that are no UTF-8 count as U+FFFD; null doc_id comes first; rows with equal doc_id follow one another in the order of a hash
of their texts; a single row is its own next; an empty table gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, mix64, text_slices, valid_text

PRIMES = (2147483647, 2147483629)
BASES = (911382323, 972663749)
BINS, SPAN = 32, 12
#: Lengths of the prefixes in a fingerprint: 1, 2, 3, 4, 6, 8, 12, ...
GRID = np.array(sorted({k << e for e in range(40) for k in (2, 3)} | {1}), np.int64)


class _Powers:
    def __init__(self, base: int, prime: int):
        self.base, self.inverse, self.prime = base, pow(base, -1, prime), prime
        self.up = self.down = np.ones(1, np.int64)

    def upto(self, n: int) -> None:
        while len(self.up) < n:  # double the table: powers k..2k are powers 0..k times the k-th
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * pow(self.base, k, self.prime) % self.prime])
            self.down = np.concatenate([self.down, self.down * pow(self.inverse, k, self.prime) % self.prime])


_TABLES = [_Powers(b, p) for b, p in zip(BASES, PRIMES, strict=True)]


class PrefixHash:
    """Prefix hashes of a text, in code points."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64) + 1
        self.n = len(codes)
        self.prefix = []
        for t in _TABLES:
            t.upto(self.n + 1)
            sums = np.zeros(self.n + 1, np.int64)
            np.cumsum(codes * t.up[: self.n] % t.prime, out=sums[1:])
            self.prefix.append(sums % t.prime)

    def spans(self, starts: np.ndarray, ends: np.ndarray, k: int = 0) -> np.ndarray:
        """Hashes of many spans modulo the k-th prime; equal spans have equal hashes wherever they stand."""
        t = _TABLES[k]
        return (self.prefix[k][ends] - self.prefix[k][starts]) % t.prime * t.down[starts] % t.prime

    def span(self, start: int, end: int) -> int:
        """Hash of one span modulo both primes."""
        out = 0
        for k, (t, prefix) in enumerate(zip(_TABLES, self.prefix, strict=True)):
            out |= (int(prefix[end]) - int(prefix[start])) % t.prime * int(t.down[start]) % t.prime << (31 * k)
        return out

    def extension(self, start: int, other: PrefixHash, other_start: int) -> int:
        """Length of the longest common extension of self at start and other at other_start, by binary search."""
        low, high = 0, min(self.n - start, other.n - other_start)
        while low < high:
            mid = (low + high + 1) // 2
            if self.span(start, start + mid) == other.span(other_start, other_start + mid):
                low = mid
            else:
                high = mid - 1
        return low

    def common_prefix(self, other: PrefixHash) -> int:
        return self.extension(0, other, 0)

    def common_suffix(self, other: PrefixHash) -> int:
        low, high = 0, min(self.n, other.n)
        while low < high:
            mid = (low + high + 1) // 2
            if self.span(self.n - mid, self.n) == other.span(other.n - mid, other.n):
                low = mid
            else:
                high = mid - 1
        return low

    def fingerprint(self) -> str:
        smallest = np.zeros(BINS, np.uint16)
        if self.n >= SPAN:
            at = np.arange(self.n - SPAN + 1)
            mixed = np.sort(mix64(self.spans(at, at + SPAN).astype(np.uint64)))
            first = np.searchsorted(mixed, np.arange(BINS, dtype=np.uint64) << np.uint64(59))
            last = np.append(first[1:], len(mixed))
            full = first < last
            smallest[full] = (mixed[first[full]] & np.uint64(0xFFFF)).astype(np.uint16) | np.uint16(1)
        grid = GRID[GRID <= self.n]
        steps = mix64(self.prefix[0][grid].astype(np.uint64) << np.uint64(31) | self.prefix[1][grid].astype(np.uint64))
        return f"{self.span(0, self.n):016x}{self.n:08x}" + smallest.astype(">u2").tobytes().hex() + (steps & np.uint64(0xFFFF)).astype(">u2").tobytes().hex()


def likeness(a: str, b: str) -> float:
    """How alike two fingerprints are, from 0 to 1."""
    if a == b:
        return 1.0
    n = max(int(a[16:24], 16), int(b[16:24], 16))
    values = [np.frombuffer(bytes.fromhex(x[24:]), ">u2") for x in (a, b)]
    x, y = (v[:BINS] for v in values)
    either = int(((x > 0) | (y > 0)).sum())
    bins = int(((x == y) & (x > 0)).sum()) / either if either else 0.0
    x, y = (v[BINS:] for v in values)
    low, high = 0, min(len(x), len(y))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if x[mid - 1] == y[mid - 1] else (low, mid - 1)
    covered = int(GRID[low - 1]) / n if low else 0.0
    return max(bins, min(covered, 1.0))


FIELDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix long, common_suffix long"
_NAMES = [f.split()[0] for f in FIELDS.split(", ")]


class _Document:
    def __init__(self, doc_id: int | None, packed: bytes, text: str):
        self.doc_id, self.packed, self.text = doc_id, packed, text
        self.hashes = PrefixHash(text)
        self.fingerprint = self.hashes.fingerprint()

    def beside(self, after: _Document) -> tuple:
        n = len(self.text)
        edited = self.text[: n - n // 2] + after.text[: n // 2]
        hashes = PrefixHash(edited)
        print_ = hashes.fingerprint()
        return (self.doc_id, n, hashlib.sha256(edited.encode()).hexdigest(), self.fingerprint, print_, likeness(self.fingerprint, print_), likeness(self.fingerprint, after.fingerprint), self.hashes.common_prefix(hashes), self.hashes.common_suffix(hashes))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=1)
    for batch in text_slices(batches, "text"):
        packed = [squeeze.compress((t or "").encode()) for t in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["tie"], pa.array(packed, pa.binary())], names=["doc_id", "tie", "packed"])


_ENDS = pa.schema([("kind", pa.string()), ("part", pa.int32()), ("packed", pa.binary())])
_ROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *[(n, pa.string()) for n in _NAMES[2:5]], *[(n, pa.float64()) for n in _NAMES[5:7]], *[(n, pa.int64()) for n in _NAMES[7:]]])


def _emit(rows: list[tuple], ends: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(_ROW)
    return pa.RecordBatch.from_arrays([*[pa.array(c, f.type) for c, f in zip(columns, _ROW, strict=True)], *[pa.array([e[k] for e in ends], f.type) for k, f in enumerate(_ENDS)]], names=[*_ROW.names, *_ENDS.names])


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a range in order, each with the next; and its first and last document, for the ranges beside it."""
    open_, part, last = zstandard.ZstdDecompressor(), TaskContext.get().partitionId(), None
    blank = (None,) * (len(_NAMES) - 1)
    for batch in text_slices(batches, "packed", 1 << 18):
        rows, ends = [], []
        for doc_id, packed in zip(batch["doc_id"].to_pylist(), batch["packed"].to_pylist(), strict=True):
            now = _Document(doc_id, packed, open_.decompress(packed).decode())
            if last is None:
                rows.append((doc_id, *blank))
                ends.append(("head", part, packed))
            else:
                rows.append(last.beside(now))
                ends.append(("row", part, None))
            last = now
        yield _emit(rows, ends)
    if last is not None:
        yield _emit([(last.doc_id, *blank)], [("tail", part, last.packed)])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    open_ = zstandard.ZstdDecompressor()
    for batch in text_slices(batches, "packed", 1 << 18):
        texts = lambda c: [open_.decompress(x).decode() for x in batch[c].to_pylist()]  # noqa: B023, E731
        rows = [_Document(i, b"", a).beside(_Document(None, b"", b)) for i, a, b in zip(batch["doc_id"].to_pylist(), texts("packed"), texts("after"), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ROW, strict=True)], schema=_ROW)


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, digest and fingerprints of the text and of its edited text, likenesses, and the lengths of the
    longest common prefix and suffix of the two texts, of every row."""
    text = F.coalesce(valid_text("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    packed = rows.mapInArrow(_pack, "doc_id long, tie long, packed binary")
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    ranges = packed.repartitionByRange(*order).sortWithinPartitions(*order)
    done = materialize(ranges.mapInArrow(_walk, FIELDS + ", kind string, part int, packed binary"), "fingerprints")

    parts = done.where("kind = 'head'").select("part")
    by_part = Window.partitionBy(F.lit(0)).orderBy("part")
    around = Window.partitionBy(F.lit(0))
    following = parts.select("part", F.coalesce(F.lead("part").over(by_part), F.min("part").over(around)).alias("next"))
    heads = done.where("kind = 'head'").select(F.col("part").alias("next"), F.col("packed").alias("after"))
    tails = done.where("kind = 'tail'").select("doc_id", "part", "packed")
    met = tails.join(following, "part").join(heads, "next").select("doc_id", "packed", "after").mapInArrow(_meet, FIELDS)
    return done.where("kind = 'row'").select(*_NAMES).unionByName(met)
