"""Best bid and offer at every revision, by block replay.

Revisions are cut in blocks of equal length. The book just before a block follows from the levels' validity intervals,
so every block is replayed on its own: long histories of one liquid book spread over many tasks, and a task holds one
block and the depth of one book.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from depthframe.sources.shared import tasks

REVISIONS_PER_BLOCK = 4096
BBO = "book int, seq bigint, book_seq bigint, bid_price_raw bigint, bid_size_raw bigint, ask_price_raw bigint, ask_size_raw bigint"


class Side:
    def __init__(self, sign: int):
        self.sign, self.sizes, self.heap = sign, {}, []

    def load(self, levels: list[tuple[int, int]]) -> None:
        self.sizes = dict(levels)
        self.heap = [self.sign * p for p, _ in levels]
        heapify(self.heap)

    def put(self, price: int, size: int) -> None:
        if size:
            if price not in self.sizes:
                heappush(self.heap, self.sign * price)
            self.sizes[price] = size
        else:
            self.sizes.pop(price, None)

    def best(self) -> tuple[int | None, int | None]:
        while self.heap and self.sign * self.heap[0] not in self.sizes:
            heappop(self.heap)
        if not self.heap:
            return None, None
        price = self.sign * self.heap[0]
        return price, self.sizes[price]


def _replay(block: pd.DataFrame) -> pd.DataFrame:
    """Rows with book_seq 0 are the book before the block."""
    sides = {"BID": Side(-1), "ASK": Side(1)}
    start = block[block.book_seq == 0]
    for name, side in sides.items():
        own = start[start.side == name]
        side.load(list(zip(own.price_raw.tolist(), own.size_raw.tolist(), strict=True)))
    known, out = (*sides["BID"].best(), *sides["ASK"].best()), []
    rows = block[block.book_seq > 0].sort_values("book_seq", kind="stable")
    numbers, seqs = rows.book_seq.tolist(), rows.seq.tolist()
    for k, (name, price, size) in enumerate(zip(rows.side, rows.price_raw.tolist(), rows.size_raw.tolist(), strict=True)):
        sides[name].put(price, size)
        if k + 1 == len(numbers) or numbers[k + 1] != numbers[k]:
            now = (*sides["BID"].best(), *sides["ASK"].best())
            if now != known:
                out.append((seqs[k], numbers[k], *now))
                known = now
    names = ["seq", "book_seq", "bid_price_raw", "bid_size_raw", "ask_price_raw", "ask_size_raw"]
    made = pd.DataFrame(out, columns=names).astype({n: "Int64" for n in names})
    made.insert(0, "book", block.book.iloc[0])
    return made


def replay_blocks(diffs: DataFrame, revisions_per_block: int = REVISIONS_PER_BLOCK) -> DataFrame:
    """The diffs (a table) with their block, and the book before each block as rows with book_seq 0; dealt by block, over as many
    tasks as their number asks for.

    A level's history is looked at by its last size in each block, so what is sorted by level has a row a level and block.
    """
    n = revisions_per_block
    rows = diffs.withColumn("block", F.expr(f"(book_seq - 1) div {n}"))
    ends = rows.groupBy("book").agg(F.max("block").alias("last_block"))
    last = rows.groupBy("book", "side", "price_raw", "block").agg(F.max_by("size_raw", "book_seq").alias("size_raw"))
    following = Window.partitionBy("book", "side", "price_raw").orderBy("block")
    held = last.withColumn("next_block", F.lead("block").over(following)).where("size_raw > 0").join(ends, "book")
    held = held.withColumn("final", F.coalesce("next_block", "last_block")).where("final > block")
    start = held.select("book", F.explode(F.sequence(F.col("block") + 1, F.col("final"))).alias("block"), F.lit(0).cast("bigint").alias("seq"), F.lit(0).cast("bigint").alias("book_seq"), "side", "price_raw", "size_raw")
    return start.unionByName(rows.select(*start.columns)).repartition(tasks(diffs), "book", "block")


def bbo_changes(diffs: DataFrame, revisions_per_block: int = REVISIONS_PER_BLOCK) -> DataFrame:
    """The best bid and ask after every revision that changed the price or size of either."""
    return replay_blocks(diffs, revisions_per_block).groupBy("book", "block").applyInPandas(_replay, BBO)


def conflate(bbo: DataFrame, interval: str = "1 second", time: str = "ts", order: tuple[str, ...] = ("book_seq",)) -> DataFrame:
    """The newest row of every book in every interval."""
    newest = F.max_by(F.struct(*[c for c in bbo.columns if c != "book"]), F.struct(*order)).alias("row")
    return bbo.groupBy("book", F.window(time, interval).alias("window")).agg(newest).select("book", F.col("window.start").alias("window_start"), "row.*")
