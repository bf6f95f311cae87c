"""Connected components of a graph given as a DataFrame of links, by randomised contraction.

Each round, every node picks the neighbour (or itself) whose hash under the round's seed is smallest, and the graph is
contracted along these picks. Any graph shrinks by a constant factor a round in expectation, paths and stars
alike, so rounds grow with the logarithm of its size. Picks are an aggregation with partial minima; links are joined to
them by node, and nothing is gathered on the driver but the question whether links are left. Each round is written to
the shared folder, so plans stay short and lost executors cost one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component): for every node that has a link, a node that stands for its component."""
    edges = links.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a <> b")
    edges = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    rounds = []
    while not edges.isEmpty():
        order = lambda c: F.struct(F.xxhash64(F.lit(len(rounds)), F.col(c)).alias("h"), F.col(c).alias("node"))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        picks = both.groupBy("a").agg(F.min(order("b")).alias("near"))
        picks = materialize(picks.select(F.col("a").alias("node"), F.least(F.col("near"), order("a"))["node"].alias("pick")), "cc-picks")
        moved = edges.join(picks.select(F.col("node").alias("a"), F.col("pick").alias("x")), "a").join(picks.select(F.col("node").alias("b"), F.col("pick").alias("y")), "b").where("x <> y")
        edges = materialize(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "cc-edges")
        rounds.append(picks)
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = rounds.pop()
    while rounds:
        later = found.select(F.col("node").alias("pick"), F.col("pick").alias("final"))
        found = rounds.pop().join(later, "pick", "left").select("node", F.coalesce("final", "pick").alias("pick"))
    return materialize(found.select("node", F.col("pick").alias("component")), "cc-found")
