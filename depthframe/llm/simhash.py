"""SimHash near-dedup: 64-bit fingerprints over word shingles, linked at Hamming distance 2 or less.

Method: deletion-variant signatures. A fingerprint is cut into two halves, fewer than the three that plain pigeonhole
asks for, so that of two linked ones some half differs in one bit at most. The index holds each half, and each half with
one bit left out; fingerprints whose keys meet another's are candidates, and links among these are verified by bits.

No pairs of a key's holders are made. Two fingerprints within two bits have a midpoint, a value within one bit of both;
and any two within one bit of the same value are within two of each other. So every candidate is written under the 65
values within one bit of it, and linked with the smallest that stands under the same value: what is linked so is within
the distance, all that is within it is connected so, and one value has 65 fingerprints at most.

How it scales. Texts are read once, for their fingerprints. Copies fall together first: only distinct fingerprints
are indexed. A count with partial sums drops the keys that one fingerprint holds, so few fingerprints are candidates. The
work follows the number of fingerprints, whatever keys they share. Groups are connected components over fingerprints;
documents take their group's smallest doc_id in a last join, which Spark can split where one fingerprint holds many
documents. No step holds a group in one task.

Defined cases: bytes that are no UTF-8 count as U+FFFD; null and empty texts have fingerprint zero and are linked like any other; a text under the shingle's
length is one shingle; only A to Z are lower-cased; equal doc_ids are separate rows; a group without any doc_id has a
null component_id; an empty table gives no rows; columns other than those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_slices, valid_text
from .components import connected_components

SHINGLE = 3
SEED = 42
#: Fingerprints that differ in so many bits at most are linked.
DISTANCE = 2


def majority(hashes: np.ndarray) -> int:
    """Bits that over half of the 64-bit hashes have set."""
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 15):
        part = np.ascontiguousarray(hashes[a : a + (1 << 15)], dtype="<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint of a text, 0 without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends + 1).tolist()]
    ends = ends.tolist()
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:n], ends[min(shingle, len(words)) - 1 :], strict=False)
    return majority(np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64))


def _scan(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            prints = [fingerprint(t, shingle) for t in batch["text"].to_pylist()]
            others = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in others], pa.array(prints, pa.int64())], names=[*others, "fingerprint"])

    return run


#: The index keys of ``lo`` and ``hi``, the halves of a fingerprint: each as it is, and the lower with one bit left out.
#: Of fingerprints within 2 bits either the lower halves differ in one bit at most, or the upper halves are equal. A key
#: holds which half and bit it is about above the half's 32 bits.
VARIANTS = "concat(array((32L << 32) | lo, (33L << 32) | hi), transform(sequence(0, 31), j -> (CAST(j AS BIGINT) << 32) | (lo & ~(1L << j))))"
#: All values within one bit of ``fingerprint``.
AROUND = "concat(array(fingerprint), transform(sequence(0, 63), j -> fingerprint ^ (1L << j)))"


def links(prints: DataFrame) -> DataFrame:
    """Links (a, b) within DISTANCE bits that connect all distinct fingerprints that are so near."""
    halves = prints.select("fingerprint").distinct().selectExpr("fingerprint", "fingerprint & 4294967295L AS lo", "shiftrightunsigned(fingerprint, 32) AS hi")
    halves = materialize(halves, "simhash-halves")
    keyed = halves.select("fingerprint", F.explode(F.expr(VARIANTS)).alias("key"))
    shared = materialize(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "simhash-shared")
    candidates = materialize(keyed.join(shared, "key", "left_semi").select("fingerprint").distinct(), "simhash-candidates")
    around = candidates.select("fingerprint", F.explode(F.expr(AROUND)).alias("midpoint"))
    centre = around.groupBy("midpoint").agg(F.min("fingerprint").alias("a"), F.max("fingerprint").alias("last")).where("a <> last").drop("last")
    met = around.join(materialize(centre, "simhash-centres"), "midpoint")
    return met.where(f"a <> fingerprint AND bit_count(a ^ fingerprint) <= {DISTANCE}").select("a", F.col("fingerprint").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fingerprint (long), component_id, component of every row, and the columns named in ``keep``. A component is
    a fingerprint of the group, which tells groups apart where their smallest doc_ids are equal or null."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, valid_text("text").alias("text"))
    schema = ", ".join(["doc_id long", *[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep], "fingerprint long"])
    rows = materialize(rows.mapInArrow(_scan(shingle), schema), "simhash-prints")
    groups = connected_components(links(rows)).withColumnRenamed("node", "fingerprint")
    smallest = rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first")).join(groups, "fingerprint", "left")
    smallest = materialize(smallest.select("fingerprint", "first", F.coalesce("component", "fingerprint").alias("component")), "simhash-first")
    ids = materialize(smallest.groupBy("component").agg(F.min("first").alias("component_id")), "simhash-ids")
    named = materialize(smallest.join(ids, "component").select("fingerprint", "component_id", "component"), "simhash-named")
    return rows.join(named, "fingerprint").select("doc_id", *keep, "fingerprint", "component_id", "component")


def hexadecimal(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def keep_one(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """docs with one row of each group of near copies: of the smallest doc_id (no doc_id: last), and of rows that share
    it, the one whose columns hash lowest (equal rows: one of them)."""
    row = F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in docs.columns])
    found = near_duplicates(docs.withColumn("__row", row), shingle, keep=("__row",))
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "__row")
    lead = found.groupBy("component").agg(F.min(order).alias("lead")).select(F.coalesce("lead.doc_id", F.lit(0).cast("long")).alias("__id"), F.col("lead.__row").alias("__row"))
    lead = materialize(lead.distinct(), "simhash-lead")
    marked = docs.withColumns({"__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")), "__row": row})
    nth = F.row_number().over(Window.partitionBy("__id", "__row").orderBy("__row"))
    return marked.join(lead, ["__id", "__row"]).withColumn("__nth", nth).where("__nth = 1").select(*docs.columns)
