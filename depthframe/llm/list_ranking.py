"""Ranks of a linked list that is spread over many tasks: independent sets are taken out, the rest is ranked, they are put back.

Each round takes out every element whose hash under the round's seed is larger than both neighbours', a third of them in
expectation, and links their neighbours; distances add up. So all rounds together shuffle about three times the list,
and their number grows with the logarithm of its length. When at most ``BASE`` elements are left, one task walks them (a
fixed bound, about a megabyte). Then the rounds are undone: an element's rank is that of its predecessor, which outlived
it, plus their distance. Each round is written to the shared folder; a lost executor costs one round.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Elements that are walked at once in the end.
BASE = 1 << 14
#: Stands for no neighbour; elements are not negative.
NONE = -1


def _taken(k: int) -> Column:
    """Whether round k takes an element out: a local maximum that isn't the head."""
    height = lambda c: F.xxhash64(F.lit(k), F.col(c))
    after = (F.col("succ") == NONE) | (height("element") > height("succ"))
    return (F.col("pred") != NONE) & (height("element") > height("pred")) & after


def _without(live: DataFrame, k: int) -> DataFrame:
    """The list that round k leaves. One shuffle: elements meet what their neighbours tell them."""
    none = F.lit(None).cast("bigint")
    gone = live.where(_taken(k))
    told = [
        live.where(~_taken(k)).select("element", "pred", "succ", "distance", none.alias("new_pred"), none.alias("new_succ")),
        gone.select(F.col("pred").alias("element"), none.alias("pred"), none.alias("succ"), F.lit(0).cast("bigint").alias("distance"), none.alias("new_pred"), F.col("succ").alias("new_succ")),
        gone.where(F.col("succ") != NONE).select(F.col("succ").alias("element"), none.alias("pred"), none.alias("succ"), "distance", F.col("pred").alias("new_pred"), none.alias("new_succ")),
    ]
    met = told[0].unionByName(told[1]).unionByName(told[2]).groupBy("element")
    newest = lambda c: F.coalesce(F.max(f"new_{c}"), F.max(c)).alias(c)
    return met.agg(newest("pred"), newest("succ"), F.sum("distance").alias("distance"))


def _walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = pd.concat(frames)
    after = dict(zip(rows.element.tolist(), zip(rows.succ.tolist(), rows.distance.tolist(), strict=True), strict=True))
    at, rank, out = next(iter(rows.element[rows.pred == NONE].tolist()), NONE), 0, []
    while at != NONE:
        out.append((at, rank))
        at = after[at][0]
        rank += after[at][1] if at != NONE else 0
    yield pd.DataFrame(out, columns=["element", "rank"]).astype("int64")


def ranks(links: DataFrame, base: int = BASE) -> DataFrame:
    """(element, rank from 0) of one list given as (element, pred, succ), bigint; ``NONE`` where there is no neighbour."""
    live, rounds = materialize(links.select("element", "pred", "succ", F.lit(1).cast("bigint").alias("distance")), "list"), []
    left = live.count()
    while left > base:
        rounds.append(live)
        live = materialize(_without(live, len(rounds)), "list")
        left = live.count()
    empty = live.select("element", F.col("pred").alias("rank")).where("false")
    known = materialize(live.coalesce(1).mapInPandas(_walk, "element bigint, rank bigint"), "list-ranks") if left else empty
    for k in range(len(rounds), 0, -1):
        before = known.withColumnsRenamed({"element": "pred", "rank": "before"})
        found = rounds[k - 1].where(_taken(k)).join(before, "pred").select("element", (F.col("before") + F.col("distance")).alias("rank"))
        known = known.unionByName(materialize(found, "list-ranks"))
    return known
