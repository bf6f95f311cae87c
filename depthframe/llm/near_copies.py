"""Near copies by SimHash signatures with deletion variants; a candidate is linked by exact Jaccard similarity of word shingles.

Method: a text's signature is the majority of its distinct shingles' hashes, bit by bit, as in ``simhash``, but longer and cut in
segments, because texts at a similarity of 0.8 differ in 15 to 16 bits of 100. The index holds every segment, and
every segment with one bit left out; two texts are candidates if one of these keys is both's, that is, if some segment differs
in one bit at most. Candidates are verified by the distance of 256 more bits, then by their shingle sets, intersected in a
join. A shingle votes ``VOTES`` times on a bit, so that sets of few shingles differ hardly more than large ones. Segments are as many
as find a pair at the similarity with probability ``RECALL``; more similar pairs are found more surely.

The index. A segment's variants are keys of its distinct values, not of texts, so copies and hot keys cost nothing there: a variant has two
values at most. The half of a segment that no bit is left out of deals the values to tasks, so variants needn't be shuffled, and
a group of such values is bounded by the bits of the other half. Texts with an equal segment are compared and contracted first;
neighbouring values are paired after that. Segments get longer with the table, so that unlike texts meet by chance no
more often.

How it scales. Equal shingle sets are one node, so exact copies cost nothing. Most segments are held by one node and go after
a count. Up to ``hot`` holders of a key are paired with each other. Larger keys go in two steps, so that a group's pairs
grow with its size and nothing is lost:

1. Every holder is compared with two of them, the leads: the one that shares most keys, and the one with the fewest
   shingles of its own. What that links is contracted.
2. Holders of a key that are not all in one component then are compared by prefixes: with shingles in the order of how
   many such holders have them, two similar sets share one of the first fifth of each. If that is a rare shingle, an
   equality join on it finds the pair, among ``RARE`` holders at most. If they share no rare one, all that they share is
   common, so their numbers of common shingles bound the sizes in reach, and most have no partner in reach at all; the
   others meet, key by key, those of a size class in reach.

In step 2 a key costs most if its holders consist of common shingles and still are unlike their leads and each other.
No step holds a group in one task.

Defined cases: bytes that are no UTF-8 count as U+FFFD; null and empty texts have an empty set and are near copies of each other only; a text under the shingle's length
is one shingle; only A to Z are lower-cased; equal doc_ids are separate rows; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import materialize, mix64, text_slices, valid_text
from .components import connected_components
from .simhash import SEED

SHINGLE = 5
#: The similarity from which two texts are near copies, as a fraction.
SIMILARITY = (4, 5)
#: The least probability with which a pair at the similarity is a candidate.
RECALL = 0.9996
VOTES = 3
#: How much likelier a bit differs than for large sets, at most (sets of 4 and 5 shingles; 1.02 from 6 on).
FEW = 1.065
#: Bits of a segment for tables of up to 2**18 rows; two more for every four times as many.
BITS = 24
#: 64-bit words of the signature that verify candidates.
CHECK = 4
#: A key with more holders than this is hot.
HOT = 4
#: A shingle with up to so many holders is rare.
RARE = 32
#: Size classes grow by so much; sizes below its inverse are classes of their own.
CLASS = 0.01
#: Words of votes that are counted at once.
STEP = 1 << 16


def segment_bits(rows: int) -> int:
    return BITS + 2 * max(0, ((rows - 1).bit_length() - 17) // 2)


def differing(similarity: tuple[int, int]) -> float:
    """How likely a bit differs between sets at the similarity, at most."""
    p, q = similarity
    return FEW * math.acos(2 * p / (p + q)) / math.pi


def segment_count(bits: int, similarity: tuple[int, int] = SIMILARITY) -> int:
    """Segments by which a pair at the similarity is found with probability RECALL."""
    d = differing(similarity)
    one = (1 - d) ** bits + bits * d * (1 - d) ** (bits - 1)
    return math.ceil(math.log(1 - RECALL) / math.log(1 - one)) if one < 1 else 1


def check_limit(similarity: tuple[int, int]) -> int:
    """Bits of the check words in which a pair at the similarity differs, exceeded by about one of 100,000."""
    n, d = 64 * CHECK, differing(similarity)
    return math.ceil(n * d + 4.5 * math.sqrt(n * d * (1 - d)))


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct 64-bit hashes of a text's shingles, in order."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends + 1).tolist()]
    ends = ends.tolist()
    spans = zip(starts[: max(1, len(words) - shingle + 1)], ends[min(shingle, len(words)) - 1 :], strict=False)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64))


def _ones(votes: np.ndarray) -> np.ndarray:
    """How many rows of words have each bit set. Three rows make a row of sums and one of carries, until few rows are left to count."""
    ones, weight = np.zeros(64 * votes.shape[1], np.int64), 1
    while len(votes):
        carried = [votes[:0]]
        while len(votes) > 16:
            third = len(votes) // 3
            a, b, c = votes[:third], votes[third : 2 * third], votes[2 * third : 3 * third]
            odd = a ^ b
            carried.append((a & b) | (odd & c))
            votes = np.concatenate([odd ^ c, votes[3 * third :]])
        ones += weight * np.unpackbits(np.ascontiguousarray(votes, "<u8").view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        votes, weight = np.concatenate(carried), 2 * weight
    return ones


def signature(hashes: np.ndarray, words: int) -> np.ndarray:
    """Words of a set's signature: the bits that over half of all its votes have set."""
    stream = mix64(np.arange(1, words * VOTES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    ones, step = np.zeros(64 * words, np.int64), max(1, STEP // (words * VOTES))
    for a in range(0, len(hashes), step):
        ones += _ones(mix64(hashes[a : a + step, None] ^ stream).reshape(-1, words))
    return np.packbits(2 * ones > VOTES * len(hashes), bitorder="little").view("<u8")


def segments(words: np.ndarray, bits: int, count: int) -> np.ndarray:
    """The first segments of a signature, each as its number above its bits."""
    ones = np.unpackbits(words.astype("<u8").view(np.uint8), bitorder="little")[: bits * count].reshape(count, bits)
    return (ones @ (1 << np.arange(bits, dtype=np.int64))) | (np.arange(count, dtype=np.int64) << bits)


def _scan(shingle: int, bits: int, count: int):
    def one(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(hashes):
            return np.zeros(CHECK, np.int64), np.zeros(0, np.int64)
        words = signature(hashes, CHECK + -(-bits * count // 64))
        return words[:CHECK].view(np.int64), segments(words[CHECK:], bits, count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "__text"):
            sets = [shingles(t, shingle) for t in batch["__text"].to_pylist()]
            others = [c for c in batch.schema.names if c != "__text"]
            digests = pa.array([xxhash.xxh3_128_hexdigest(s.astype("<u8").tobytes()) for s in sets], pa.string())
            found = [one(s) for s in sets]
            check, keys = (pa.array([f[k] for f in found], pa.list_(pa.int64())) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in others], digests, pa.array([len(s) for s in sets], pa.int64()), check, keys], names=[*others, "__set", "__size", "__check", "__keys"])

    return run


def _variants(bits: int):
    """From rows (x, holder) in the order of x, a segment's number, which half leads, and the leading and the other half: pairs
    whose other halves are equal with one bit left out."""
    half = bits // 2
    low = (1 << half) - 1

    def value(x: np.ndarray) -> np.ndarray:
        swapped = (x >> (2 * half)) & 1 == 1
        inside = np.where(swapped, ((x & low) << half) | ((x >> half) & low), x & ((1 << bits) - 1))
        return ((x >> (bits + 1)) << bits) | inside

    def pairs(x: np.ndarray, holder: pa.Array) -> Iterator[pa.RecordBatch]:
        for bit in range(half):
            variant = x & ~np.int64(1 << bit)
            order = np.argsort(variant, kind="stable")
            variant = variant[order]
            at = np.flatnonzero(variant[1:] == variant[:-1])
            if len(at):
                left, right = order[at], order[at + 1]
                yield pa.RecordBatch.from_arrays([pa.array(value(x[left])), pa.array(value(x[right])), holder.take(pa.array(left)), holder.take(pa.array(right))], names=["a", "b", "u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, holder = np.zeros(0, np.int64), pa.array([], pa.int64())
        for batch in batches:
            x, holder = np.concatenate([x, batch["x"].to_numpy()]), pa.concat_arrays([holder, batch["holder"]])
            groups = x >> half
            cut = int(np.searchsorted(groups, groups[-1])) if len(groups) else 0
            yield from pairs(x[:cut], holder[:cut])
            x, holder = x[cut:], holder[cut:]
        yield from pairs(x, holder)

    return run


def neighbours(values: DataFrame, bits: int) -> DataFrame:
    """Pairs (a, b) of distinct ``values`` (value, holder) of a segment that differ in one bit, and the holder of each, u and v."""
    half = bits // 2
    number, inside = f"shiftright(value, {bits})", f"(value & {(1 << bits) - 1}L)"
    swapped = f"shiftleft({inside} & {(1 << half) - 1}L, {half}) | shiftright({inside}, {half})"
    x = F.expr(f"explode(array(shiftleft({number} * 2, {bits}) | {inside}, shiftleft({number} * 2 + 1, {bits}) | {swapped}))")
    dealt = values.select(x.alias("x"), "holder").repartition(F.shiftright("x", half)).sortWithinPartitions("x")
    return dealt.mapInArrow(_variants(bits), "a long, b long, u long, v long")


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "__text"):
            sets = pa.array([shingles(t, shingle).view(np.int64) for t in batch["__text"].to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch["node"], sets], names=["node", "hashes"])

    return run


def _enough(similarity: tuple[int, int]) -> str:
    """Whether sets of sizes m and n can be similar enough."""
    return f"{similarity[1]}L * least(m, n) >= {similarity[0]}L * greatest(m, n)"


def _size_class(size: str) -> str:
    return f"CAST(floor(ln(greatest({size}, 1)) / {math.log1p(CLASS)}D) AS BIGINT)"


def verified(pairs: DataFrame, sets: DataFrame, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose sets are similar enough, compared in full."""
    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    both = pairs.join(left, "a").join(right, "b").selectExpr("a", "b", "size(x) AS m", "size(y) AS n", "size(array_intersect(x, y)) AS both")
    return both.where(f"{similarity[1]}L * both >= {similarity[0]}L * (m + n - both)").select("a", "b")


_LEFT = {"node": "u", "size": "m", "check": "x", "part": "p"}
_RIGHT = {"node": "v", "size": "n", "check": "y", "part": "q"}


def _alike(similarity: tuple[int, int]) -> str:
    """Whether texts with m and n shingles and the check words x and y may be similar enough."""
    bits = " + ".join(f"bit_count(x[{k}] ^ y[{k}])" for k in range(CHECK))
    return f"{_enough(similarity)} AND {bits} <= {check_limit(similarity)}"


def _pairs(left: DataFrame, right: DataFrame, condition: str, similarity: tuple[int, int]) -> DataFrame:
    """Distinct pairs of holders of a key in different parts; left has key and the names of _LEFT, right has key and those of _RIGHT."""
    met = left.join(right, "key").where(f"({condition}) AND p <> q AND {_alike(similarity)}")
    return met.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()


def _shingles_of(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    return sets.join(nodes.select("node"), "node", "left_semi").select("node", F.explode("hashes").alias("hash"))


def own_shingles(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, own): how many of a node's shingles no other of the nodes has, where there are any."""
    single = _shingles_of(nodes, sets).groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node")).where("n = 1")
    return single.groupBy("node").agg(F.count(F.lit(1)).alias("own"))


def profiles(nodes: DataFrame, sets: DataFrame, similarity: tuple[int, int], rare: int = RARE) -> DataFrame:
    """nodes (node, size and more) that share shingles with others of them: ``prefix``, the rare shingles among those that a
    similar set must share one of, and ``common``, how many others it may share besides (0: none within that prefix)."""
    p, q = similarity
    each = _shingles_of(nodes, sets)
    counts = materialize(each.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "copies-counts")
    rarest = F.sort_array(F.collect_list(F.when(F.col("n") <= rare, F.struct("n", "hash"))))
    shared = each.join(counts, "hash").groupBy("node").agg(F.count(F.lit(1)).alias("shared"), F.count_if(F.col("n") > rare).alias("common"), rarest.alias("rarest"))
    known = nodes.join(shared, "node").withColumn("left", F.expr(f"size - (size * {p}L + {q - 1}L) div {q}L + 1 - (size - shared)"))
    prefix = F.transform(F.expr("slice(rarest, 1, CAST(greatest(left, 0) AS INT))"), lambda x: x["hash"])
    return known.select(*nodes.columns, prefix.alias("prefix"), F.when(F.expr("size(rarest) < left"), F.col("common")).otherwise(0).alias("common"))


def _leads(many: DataFrame) -> DataFrame:
    """The leads of every key, named by _LEFT."""
    pick = lambda *order: F.min(F.struct(*order, *_LEFT))
    orders = (pick(-F.col("shares")), pick(F.col("own") / F.col("size"), -F.col("size")))
    lead = lambda x: F.struct(*[x[c].alias(n) for c, n in _LEFT.items()])
    leads = many.groupBy("key").agg(*[o.alias(f"o{k}") for k, o in enumerate(orders)])
    return leads.select("key", F.explode(F.array(*[lead(F.col(f"o{k}")) for k in range(len(orders))])).alias("c")).select("key", "c.*").distinct()


def _remaining(open_: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) that may be similar among holders (key, node, size, part, main) of keys with several parts."""
    p, q = similarity
    nodes = open_.groupBy("node").agg(F.max("size").alias("size"), F.max("part").alias("part"), F.bool_or(F.col("part") != F.col("main")).alias("outside"))
    known = materialize(profiles(materialize(nodes, "copies-outside"), sets, similarity), "copies-profiles")
    rows = known.select("node", "size", "part", "outside", F.explode("prefix").alias("hash"))
    left = rows.withColumnsRenamed({"node": "u", "size": "m", "part": "p", "outside": "o"})
    right = rows.withColumnsRenamed({"node": "v", "size": "n", "part": "q", "outside": "i"})
    by_rare = left.join(right, "hash").where(f"u < v AND p <> q AND (o OR i) AND {_enough(similarity)}").select("u", "v").distinct()

    commons = open_.join(known.where("common > 0").select("node", "common"), "node")
    outside = commons.where("part <> main").selectExpr("key", "node AS u", "size AS m", "part AS p", f"(size * {p}L + {q - 1}L) div {q}L AS low", f"least(size * {q}L div {p}L, common * {p + q}L div {p}L - size) AS high")
    outside = outside.where("low <= high").withColumn("class", F.expr(f"explode(sequence({_size_class('low')}, {_size_class('high')}))"))
    every = commons.select("key", F.col("node").alias("v"), F.col("size").alias("n"), F.col("part").alias("q"), "common", F.expr(_size_class("size")).alias("class"))
    by_common = outside.join(every, ["key", "class"]).where(f"p <> q AND n >= low AND n <= high AND {p + q}L * common >= {p}L * (m + n)").select("u", "v").distinct()
    return by_rare.unionByName(by_common).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()


def links(held: DataFrame, fetch: Callable[[DataFrame], DataFrame], similarity: tuple[int, int] = SIMILARITY, hot: int = HOT, more: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """Verified pairs (a, b) that connect all candidates that are similar enough: those of ``held`` (key, node, size, check,
    part, n holders) in different parts, and the pairs ``more``. ``fetch`` gives nodes' shingle sets, parts come from the links ``known``."""
    left, right = held.withColumnsRenamed(_LEFT), held.drop("n").withColumnsRenamed(_RIGHT)
    few = _pairs(left.where(f"n <= {hot}").drop("n"), right, "u < v", similarity)
    few = materialize(few if more is None else few.unionByName(more).distinct(), "copies-few")
    many = held.where(f"n > {hot}")
    nodes = materialize(many.groupBy("node").agg(F.sum("n").alias("shares")), "copies-nodes")
    sets = fetch(few.select(F.explode(F.array("a", "b")).alias("node")).unionByName(nodes.select("node")).distinct())
    if nodes.isEmpty():
        return materialize(verified(few, sets, similarity), "copies-links")

    own = materialize(own_shingles(nodes, sets), "copies-own")
    shares = nodes.join(own, "node", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    many = materialize(many.drop("n").join(shares, "node"), "copies-hot")
    member = many.select("key", *_RIGHT).withColumnsRenamed(_RIGHT)
    first = few.unionByName(_pairs(_leads(many), member, "u <> v", similarity)).distinct()
    first = materialize(first, "copies-pairs")
    found = materialize(verified(first, sets, similarity), "copies-links")

    parts = connected_components(found if known is None else found.unionByName(known))
    many = materialize(many.join(parts, "node", "left").select("key", "node", "size", F.coalesce("component", "node").alias("part")), "copies-parts")
    main = many.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max_by("part", F.struct("n", "part")).alias("main"), F.count(F.lit(1)).alias("parts"))
    main = materialize(main.where("parts > 1").select("key", "main"), "copies-main")  # its join's sides are plain shuffles then, which Spark can split
    open_ = materialize(many.join(main, "key"), "copies-open")
    rest = _remaining(open_, sets, similarity).join(first, ["a", "b"], "left_anti")
    return found.unionByName(materialize(verified(materialize(rest, "copies-pairs"), sets, similarity), "copies-links"))


def simhash_links(signed: DataFrame, fetch: Callable[[DataFrame], DataFrame], bits: int, similarity: tuple[int, int] = SIMILARITY, hot: int = HOT) -> DataFrame:
    """Links (a, b) among nodes of ``signed`` (node, size, check, keys) that share a segment, or a segment with one bit left out."""
    traits = signed.select("node", "size", "check")
    keyed = signed.select("node", F.explode("keys").alias("key"))
    # A value's holder: the node that has it alone, or else minus the number of nodes.
    holder = F.when(F.count(F.lit(1)) == 1, F.min("node")).otherwise(-F.count(F.lit(1)))
    values = materialize(keyed.groupBy("key").agg(holder.alias("holder")), "copies-values")
    holders = materialize(keyed.join(values.where("holder < 0").selectExpr("key", "-holder AS n"), "key"), "copies-holders")
    equal = links(materialize(holders.join(traits, "node").withColumn("part", F.col("node")), "copies-held"), fetch, similarity, hot)

    near = materialize(neighbours(values.select(F.col("key").alias("value"), "holder"), bits), "copies-near")
    left, right = (traits.select(*[F.col(c).alias(n[c]) for c in traits.columns]) for n in (_LEFT, _RIGHT))
    pairs = near.where("u >= 0 AND v >= 0").select("u", "v").distinct().join(left, "u").join(right, "v").where(f"u <> v AND {_alike(similarity)}")
    pairs = materialize(pairs.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct(), "copies-variants")

    # Of other neighbours the value with more nodes is a key, for its nodes and those of all its neighbours with fewer; keys
    # whose nodes are in one component already are left out.
    larger = F.expr("least(u, -1) <= least(v, -1)")
    stars = near.where("u < 0 OR v < 0").select(*[F.when(larger, F.col(x)).otherwise(F.col(y)).alias(n) for x, y, n in (("a", "b", "key"), ("b", "a", "value"), ("v", "u", "node"))])
    stars = materialize(stars, "copies-stars")
    sides = stars.where("node < 0").select("key", "value").unionByName(stars.select("key", F.col("key").alias("value")).distinct())
    shared = sides.join(holders.select(F.col("key").alias("value"), "node"), "value").select("key", "node")
    parts = connected_components(equal)
    held = stars.where("node >= 0").select("key", "node").unionByName(shared).distinct().join(parts, "node", "left").select("key", "node", F.coalesce("component", "node").alias("part"))
    held = materialize(held, "copies-held")
    apart = held.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("part").alias("first"), F.max("part").alias("last")).where("first <> last")
    held = materialize(held.join(materialize(apart.select("key", "n"), "copies-apart"), "key").join(traits, "node"), "copies-held")
    return equal.unionByName(links(held, fetch, similarity, hot, pairs, equal))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY, hot: int = HOT) -> DataFrame:
    """docs with one row of each group of near copies: of the smallest doc_id (no doc_id: last), and of rows that share
    it, the one whose columns hash lowest (equal rows: one of them)."""
    columns = [docs[f"`{c.replace('`', '``')}`"] for c in docs.columns]
    found = docs.select(F.struct(*columns).alias("row"), F.xxhash64(*[c.cast("string") for c in columns]).alias("__row"), valid_text("text").alias("__text"))
    schema = StructType([*[f for f in found.schema if f.name != "__text"], StructField("__set", StringType()), StructField("__size", LongType()), StructField("__check", ArrayType(LongType())), StructField("__keys", ArrayType(LongType()))])
    bits = segment_bits(docs.count())
    rows = found.mapInArrow(_scan(shingle, bits, segment_count(bits, similarity)), schema).withColumn("__at", F.monotonically_increasing_id())
    rows = materialize(rows, "copies-rows")

    # A set's node is the place of the row that leads it.
    order = F.struct(F.col("row.doc_id").isNull().alias("unknown"), F.col("row.doc_id"), F.col("__row"), F.col("__at"))
    leads = rows.groupBy("__set").agg(F.min(order).alias("lead"), F.first("__size").alias("size"), F.first("__check").alias("check"), F.first("__keys").alias("keys"))
    leads = materialize(leads.select(F.col("lead.__at").alias("node"), "lead", "size", "check", "keys"), "copies-leads")

    def fetch(wanted: DataFrame) -> DataFrame:
        wanted = materialize(wanted, "copies-wanted")  # its size is known before the join is planned
        texts = rows.select(F.col("__at").alias("node"), valid_text("row.text").alias("__text")).join(wanted, "node", "left_semi")
        return materialize(texts.mapInArrow(_sets(shingle), "node long, hashes array<bigint>"), "copies-sets")

    found = simhash_links(leads.select("node", "size", "check", "keys"), fetch, bits, similarity, hot)
    groups = connected_components(found)
    kept = leads.select("node", "lead").join(groups, "node", "left").groupBy(F.coalesce("component", "node").alias("component")).agg(F.min("lead").alias("lead"))
    kept = materialize(kept.select("lead.__at"), "copies-kept")
    # Copies are fewer than texts: while they are few, texts stay where they lie.
    gone = materialize(rows.select("__at").join(kept, "__at", "left_anti"), "copies-gone")
    return rows.join(gone, "__at", "left_anti").select("row.*")
