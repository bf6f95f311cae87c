"""Prefix trie of conversations, its subtrees measured by the Euler-tour technique.

A node is a distinct sequence of the first d turns (role, text) of some conversation; the conversations that start with it
are its members. A node's name is (its smallest member, d). Method: every node has an enter and an exit arc; the arcs
follow each other as a walk around the tree does (enter, the first child's enter, ... the last child's exit, exit, the
next sibling's enter), which makes one list. The list is ranked (``list_ranking``), and prefix sums of weights along
the ranks, those at a node's exit less those at its enter, are the sums over its subtree.

How it scales. Turns are put in order by ranges of (conversation, turn), so a long conversation is dealt over many tasks;
only digests and word counts are shuffled, never texts. Prefixes are compared by 144 bits: sums over turns of hashes of place
and digest, running sums by blocks of depth, so no task holds a conversation. Nodes are an aggregation with partial sums;
siblings are linked along one global order, so a node with a third of all nodes as its children is no task's. Sums along the
tour go by blocks of ranks. SHA-256 can't be split: the ids that end at one node are hashed in order by one task,
which reads them as a stream and holds a batch of them.

Defined cases: turns are ordered by turn, null first, equal ones by the digest of role and text; null role or text is empty;
rows without a conv_id belong to no conversation; a repeated row is a turn more; a conversation without turns is a member of the
root alone; an empty table has no nodes; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_order, materialize, word_count
from .list_ranking import BASE, NONE, ranks

#: Depths, and ranks, whose running sums are taken at once. Any width gives the same rows.
DEPTHS, RANKS = 4096, 1 << 16
#: The sums that tell prefixes apart, of 48 bits each and a sign.
LANES = ["h0", "h1", "h2"]
PREFIX = ["depth", *LANES]


def positions(turns: DataFrame) -> DataFrame:
    """conv_id, depth (1, 2, ... in the order of turns), content (digest of role and text), words of the text."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    content = F.md5(F.concat(F.length(text("role")).cast("string"), F.lit(":"), text("role"), text("text")).cast("binary"))
    rows = turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), content.alias("content"), word_count(F.col("text")).alias("words"))
    rows = in_order(rows.withColumn("place", F.monotonically_increasing_id()), ["conv_id", "turn", "content", "place"], "trie-turns")
    runs = rows.groupBy("conv_id", "part").agg(F.min("nth").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("conv_id", "part", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first") + 1).alias("shift"))
    return rows.join(materialize(runs, "trie-runs"), ["conv_id", "part"]).select("conv_id", (F.col("nth") + F.col("shift")).alias("depth"), "content", "words")


def with_shared_heads(rows: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Conversations c (as ``positions``) that begin with the first crc32(c) % most turns of conversation c - c % every
    instead of as many of their own."""
    lengths = materialize(rows.groupBy("conv_id").agg(F.max("depth").alias("n")), "trie-lengths")
    own = lengths.select("conv_id", (F.col("conv_id") - F.col("conv_id") % every).alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("head"))
    bases = lengths.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    heads = own.join(bases, "base", "left").select("conv_id", "base", "head", F.least("head", F.coalesce("base_n", F.lit(0))).alias("taken"))
    heads = materialize(heads, "trie-heads")
    first = rows.where((F.col("conv_id") % every == 0) & (F.col("depth") < most)).withColumnRenamed("conv_id", "base")
    taken = first.join(heads, "base").where("depth <= taken").select("conv_id", "depth", "content", "words")
    kept = rows.join(heads, "conv_id").where("depth > head").select("conv_id", (F.col("depth") - F.col("head") + F.col("taken")).alias("depth"), "content", "words")
    return kept.unionByName(taken)


def prefixes(rows: DataFrame) -> DataFrame:
    """conv_id, PREFIX, words, and the parent's sums (p0, p1, p2) for every conversation and depth."""
    rows = rows.withColumn("block", F.expr(f"depth div {DEPTHS}"))
    rows = rows.withColumns({h: F.shiftright(F.xxhash64(F.lit(k), "depth", "content"), 16) for k, h in enumerate(LANES)})
    inside = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("conv_id", "block").agg(*[F.sum(h).alias(h) for h in LANES])
    blocks = blocks.select("conv_id", "block", *[F.coalesce(F.sum(h).over(earlier), F.lit(0)).alias(f"{h}_before") for h in LANES])
    sums = rows.select("*", *[F.sum(h).over(inside).alias(f"{h}_sum") for h in LANES]).join(blocks, ["conv_id", "block"])
    total = lambda h: F.col(f"{h}_sum") + F.col(f"{h}_before")
    return sums.select("conv_id", "depth", "words", *[total(h).alias(h) for h in LANES], *[(total(h) - F.col(h)).alias(f"p{k}") for k, h in enumerate(LANES)])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the ids of each run of equal PREFIX, comma-joined, from rows sorted by PREFIX and conv_id."""
    key, digest = None, None
    names = [*PREFIX, "ends_sha256"]
    types = [*[pa.int64()] * len(PREFIX), pa.string()]
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)
    for batch in batches:
        out = []
        for *here, conv_id in zip(*[batch[c].to_pylist() for c in [*PREFIX, "conv_id"]], strict=True):
            if here != key:
                if key is not None:
                    out.append((*key, digest.hexdigest()))
                key, digest = here, hashlib.sha256(str(conv_id).encode())
            else:
                digest.update(b",%d" % conv_id)
        yield made(out)
    if key is not None:
        yield made([(*key, digest.hexdigest())])


def nodes(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """The trie's nodes in one global order of families: id, conv_id, depth, parent_conv_id, n_convs, words, ends_sha256, part, nth."""
    found = materialize(prefixes(rows), "trie-prefixes")
    lengths = found.groupBy("conv_id").agg(F.max("depth").alias("depth"))
    members = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).where("conv_id IS NOT NULL").distinct()
    zeros = {h: F.lit(0).cast("long") for h in PREFIX}
    turnless = members.join(lengths, "conv_id", "left_anti").withColumns(zeros)
    ended = found.join(lengths, ["conv_id", "depth"], "left_semi").select("conv_id", *PREFIX).unionByName(turnless)
    ends = ended.repartition(*PREFIX).sortWithinPartitions(*PREFIX, "conv_id").select(*PREFIX, "conv_id")
    ends = ends.mapInArrow(_ends, ", ".join([*[f"{c} long" for c in PREFIX], "ends_sha256 string"]))

    parent = [f"p{k}" for k in range(len(LANES))]
    root = members.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.withColumns(zeros | {"words": F.lit(0).cast("long")} | {p: F.lit(None).cast("long") for p in parent})
    each = found.groupBy(*PREFIX).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"), *[F.max(p).alias(p) for p in parent])
    each = materialize(each.unionByName(root).join(ends, PREFIX, "left"), "trie-named")
    above = each.select((F.col("depth") + 1).alias("depth"), *[F.col(h).alias(p) for h, p in zip(LANES, parent, strict=True)], F.col("conv_id").alias("parent_conv_id"))
    named = each.join(above, ["depth", *parent], "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "words", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
    placed = in_order(named, ["parent_conv_id", "depth", "conv_id"], "trie-nodes")
    return placed.withColumn("id", F.shiftleft("part", 33) + F.col("nth"))


def tour(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes with n_children, arcs (element, pred, succ) of their Euler tour). A node's arcs are 2 * id and 2 * id + 1."""
    family = F.struct("parent_conv_id", "depth", "id")
    ends = placed.groupBy("part").agg(F.min_by(family, "nth").alias("first"), F.max_by(family, "nth").alias("last"))
    parts = Window.partitionBy(F.lit(0)).orderBy("part")
    ends = ends.select("part", F.lag("last").over(parts).alias("before"), F.lead("first").over(parts).alias("behind"))
    inside = Window.partitionBy("part").orderBy("nth")
    near = placed.select("*", F.lag(family).over(inside).alias("own_before"), F.lead(family).over(inside).alias("own_behind")).join(ends, "part")
    same = lambda x: F.when((x["parent_conv_id"] == F.col("parent_conv_id")) & (x["depth"] == F.col("depth")), x["id"])
    beside = lambda c: same(F.coalesce(f"own_{c}", c)).alias(c)
    near = near.select("id", "conv_id", "depth", "parent_conv_id", "n_convs", "words", "ends_sha256", beside("before"), beside("behind"))

    children = placed.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"))
    children = children.agg(F.min("id").alias("first_child"), F.max("id").alias("last_child"), F.count(F.lit(1)).alias("n_children"))
    above = placed.select(F.col("conv_id").alias("parent_conv_id"), (F.col("depth") + 1).alias("depth"), F.col("id").alias("parent"))
    full = near.join(children, ["conv_id", "depth"], "left").join(above, ["parent_conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    full = materialize(full, "trie-linked")
    enter, leave = lambda c: F.col(c) * 2, lambda c: F.col(c) * 2 + 1
    down = F.struct(enter("id").alias("element"), F.coalesce(leave("before"), enter("parent"), F.lit(NONE)).alias("pred"), F.coalesce(enter("first_child"), leave("id")).alias("succ"))
    up = F.struct(leave("id").alias("element"), F.coalesce(leave("last_child"), enter("id")).alias("pred"), F.coalesce(enter("behind"), leave("parent"), F.lit(NONE)).alias("succ"))
    return full, full.select(F.explode(F.array(down, up)).alias("x")).select("x.*")


def subtree_sums(full: DataFrame, ranked: DataFrame, weights: list[str], width: int = RANKS) -> DataFrame:
    """(id, weights): each weight of ``full`` (id, weights) summed over the node's subtree, from prefix sums along the tour."""
    rows = ranked.select(F.expr("element div 2").alias("id"), (F.col("element") % 2).alias("leaves"), "rank").join(full, "id")
    rows = rows.withColumns({w: F.when(F.col("leaves") == 0, F.col(w)).otherwise(0) for w in weights} | {"block": F.expr(f"rank div {width}")})
    blocks = rows.groupBy("block").agg(*[F.sum(w).alias(w) for w in weights])
    earlier = Window.partitionBy(F.lit(0)).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("block", *[F.coalesce(F.sum(w).over(earlier), F.lit(0)).alias(f"{w}_before") for w in weights])
    inside = Window.partitionBy("block").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.select("id", "leaves", "block", *weights, *[F.sum(w).over(inside).alias(f"{w}_sum") for w in weights]).join(blocks, "block")
    upto = lambda w: F.col(f"{w}_sum") + F.col(f"{w}_before")
    return sums.groupBy("id").agg(*[F.sum(F.when(F.col("leaves") == 1, upto(w)).otherwise(F.col(w) - upto(w))).alias(w) for w in weights])


def trie(rows: DataFrame, conversations: DataFrame, base: int = BASE, width: int = RANKS) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    rows are as from ``positions``; conversations lists all conv_ids, those without turns too.
    """
    full, arcs = tour(nodes(rows, conversations))
    own = full.select("id", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    sums = subtree_sums(own, ranks(arcs, base), ["n_leaves", "saved_tokens"], width)
    return full.join(sums, "id").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def prefix_trie(turns: DataFrame) -> DataFrame:
    """The trie of a conversation table (conv_id, turn, role, text)."""
    return trie(positions(turns), turns)
