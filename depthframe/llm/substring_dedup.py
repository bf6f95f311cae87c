"""Substring dedup: Rabin-Karp hashes of every window of ``WINDOW`` words, counted in Spark.

A window is repeated if the same words in the same order also start earlier (smaller doc_id, or the same document
and an earlier start). Every word that a repeated window covers is removed; overlapping windows merge into maximal
intervals.

How it scales. A first pass sends only the *minimizers* of each document: of the 8-word pieces inside a window, the
one with the smallest hash. Equal windows have equal minimizers, so a window whose minimizer occurs once in the corpus
can't be repeated and is never shuffled. Only the windows around repeated minimizers get their full two 64-bit
Rabin-Karp hashes. Both counts are ordinary aggregations with partial sums, and what is joined back is joined on the
hash, where Spark splits hot keys. Of documents with equal word sequences only the one with the smallest doc_id takes
part; all windows of the others start earlier in it, so they follow from its length.

Defined cases: bytes that are no UTF-8 count as U+FFFD; null text has no words; a text under WINDOW words loses nothing; rows with the same doc_id are one
document each, told apart by their text and, if that is equal, by nothing (equal rows give equal results, the first
stays whole only if no row before it says the same); null doc_id sorts first; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Powers, RollingHash, materialize, mix64, text_slices, valid_text

WINDOW = 20
#: Words in a minimizer piece; a window has WINDOW - PIECE + 1 of them.
PIECE = 8

_WORDS = [Powers(0xD6E8FEB86659FD93), Powers(0xA0761D6478BD642F)]


def _word_hashes(words: list[bytes], k: int) -> np.ndarray:
    """Each word as a 64-bit token, by the k-th of two XXH3 seeds. Windows are polynomials over these: a polynomial over
    the words' bytes would give some long words (complementary Thue-Morse words) one hash modulo 2**64 under any base."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words, repeat(k)), np.uint64, len(words))


def _batch_words(texts: list[bytes]) -> tuple[list[list[bytes]], list[bytes], np.ndarray]:
    """The words of each text, those of all texts in one list, and the number of words before each text (and after the last)."""
    each = [t.split() for t in texts]
    return each, [w for words in each for w in words], np.cumsum([0, *map(len, each)])


def _windows(first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Start of every window (as a word of the batch) and the document that it lies in."""
    n = np.maximum(0, np.diff(first) - window + 1)
    doc = np.repeat(np.arange(len(n)), n)
    return first[doc] + np.arange(len(doc)) - (np.cumsum(n) - n)[doc], doc


def _minimizers(words: np.ndarray, starts: np.ndarray, window: int, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window the place (a word of the batch) of its minimizer; and the hash of the piece at every word."""
    at = np.arange(max(0, len(words) - piece + 1))
    pieces = mix64(RollingHash(_WORDS[0], words).spans(at, at + piece))
    if not len(starts):
        return starts, pieces
    within = np.lib.stride_tricks.sliding_window_view(pieces, window - piece + 1)
    return starts + within[starts].argmin(axis=1), pieces


def _scan(window: int, piece: int):
    """Per document: the digest of its words, the words (compressed) and its minimizers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in text_slices(batches, "text"):
            each, words, first = _batch_words([(t or "").encode() for t in batch["text"].to_pylist()])
            win, doc = _windows(first, window)
            low, pieces = _minimizers(_word_hashes(words, 0), win, window, piece)
            new = np.ones(len(low), bool)
            new[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])
            low, doc = low[new], doc[new]
            per = np.searchsorted(doc, np.arange(len(first)))
            joined = [b" ".join(words) for words in each]
            lists = lambda x: pa.ListArray.from_arrays(pa.array(per, pa.int32()), x)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    pa.array(np.diff(first), pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in joined], pa.string()),
                    pa.array([squeeze.compress(x) for x in joined], pa.binary()),
                    lists(pa.array(pieces[low].view(np.int64))),
                    lists(pa.array((low - first[doc]).astype(np.int32))),
                ],
                names=["doc_id", "n_words", "sha256", "packed", "hashes", "places"],
            )

    return run


def _unpack(packed: pa.Array) -> list[bytes]:
    open_ = zstandard.ZstdDecompressor()
    return [open_.decompress(x) for x in packed.to_pylist()]


def _candidates(window: int, piece: int):
    """Full hashes of the windows whose minimizer is listed in ``places``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "packed", 1 << 19):
            _, flat_words, first = _batch_words(_unpack(batch["packed"]))
            win, doc = _windows(first, window)
            words = [_word_hashes(flat_words, k) for k in (0, 1)]
            low, _ = _minimizers(words[0], win, window, piece)
            listed = np.zeros(len(flat_words) + 1, bool)
            places = batch["places"]
            flat = np.asarray(places.flatten())
            counts = np.asarray(pc.list_value_length(places))
            listed[first[np.repeat(np.arange(len(counts)), counts)] + flat] = True
            keep = listed[low] if len(low) else np.zeros(0, bool)
            win, doc = win[keep], doc[keep]
            h = [mix64(RollingHash(_WORDS[k], words[k]).spans(win, win + window)).view(np.int64) for k in (0, 1)]
            doc = pa.array(doc)
            yield pa.RecordBatch.from_arrays([pa.array(h[0]), pa.array(h[1]), batch["doc_id"].take(doc), batch["copy"].take(doc), pa.array((win - first[np.asarray(doc)]).astype(np.int32))], names=["h1", "h2", "doc_id", "copy", "start"])

    return run


def _removed(starts: np.ndarray, n: int, window: int) -> np.ndarray:
    """Mask of the words that the windows at ``starts`` cover."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + window, n), -1)
    return np.cumsum(edge[:n]) > 0


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "packed", 1 << 19):
            gone, digest, spans = [], [], []
            texts = _unpack(batch["packed"])
            for text, starts in zip(texts, batch["starts"].to_pylist(), strict=True):
                words = text.split()
                mask = _removed(np.asarray(starts, np.int64), len(words), window)
                gone.append(int(mask.sum()))
                digest.append(hashlib.sha256(b" ".join(w for w, m in zip(words, mask, strict=True) if not m)).hexdigest())
                edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
                spans.append([{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)])
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_words"], pa.array(gone, pa.int64()), pa.array(digest, pa.string()), pa.array(spans, span)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "removed"])

    return run


def substring_dedup(docs: DataFrame, window: int = WINDOW, piece: int = PIECE) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and the removed intervals (words, end exclusive) of every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), valid_text("text").alias("text"))
    rows = docs.mapInArrow(_scan(window, piece), "doc_id long, n_words long, sha256 string, packed binary, hashes array<bigint>, places array<int>")
    rows = materialize(rows.withColumn("copy", F.monotonically_increasing_id()), "substr-rows")

    # One row of each word sequence takes part: of the smallest doc_id; ``copy`` tells apart rows that share one.
    # Texts that occur once are left out of the join, and its sides are plain shuffles, where Spark splits a text of many copies.
    known = rows.select("doc_id", "copy", "n_words", "sha256")
    lead = known.groupBy("sha256").agg(F.min(F.struct("doc_id", "copy")).alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    several = known.join(materialize(lead, "substr-several"), "sha256", "left")
    flagged = materialize(several.withColumn("is_lead", F.coalesce(F.col("copy") == F.col("lead.copy"), F.lit(True))).drop("lead"), "substr-lead")
    empty = F.lit([]).cast("array<struct<start:bigint,end:bigint>>")
    long_enough = F.col("n_words") >= window
    copies = flagged.where("NOT is_lead").select(
        "doc_id",
        "n_words",
        F.when(long_enough, F.col("n_words")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.when(long_enough, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.col("sha256")).alias("kept_sha256"),
        F.when(long_enough, F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end")))).otherwise(empty).alias("removed"),
    )
    lively = rows.join(flagged.where(~F.col("is_lead") & long_enough).select("copy"), "copy", "left_anti")

    marks = lively.select("copy", F.explode(F.arrays_zip("hashes", "places")).alias("m")).select("copy", "m.hashes", "m.places")
    often = marks.groupBy("hashes").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hashes")
    often = materialize(often, "substr-often")  # both sides of the join are plain shuffles then, which Spark can split
    places = materialize(marks.join(often, "hashes", "left_semi").groupBy("copy").agg(F.collect_list("places").alias("places")), "substr-places")

    windows = rows.select("doc_id", "copy", "packed").join(places, "copy").mapInArrow(_candidates(window, piece), "h1 bigint, h2 bigint, doc_id bigint, copy bigint, start int")
    windows = materialize(windows, "substr-windows")
    here = F.struct("doc_id", "copy", "start")
    earliest = windows.groupBy("h1", "h2").agg(F.min(here).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    earliest = materialize(earliest, "substr-earliest")
    later = windows.join(earliest, ["h1", "h2"]).where(~here.eqNullSafe(F.col("first")))
    starts = materialize(later.groupBy("copy").agg(F.sort_array(F.collect_list("start")).alias("starts")), "substr-starts")

    cut = rows.select("doc_id", "copy", "n_words", "packed").join(starts, "copy").mapInArrow(_cut(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<struct<start:bigint,end:bigint>>")
    untouched = flagged.where("is_lead").join(starts.select("copy"), "copy", "left_anti")
    untouched = untouched.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha256").alias("kept_sha256"), empty.alias("removed"))
    return cut.unionByName(copies).unionByName(untouched)
