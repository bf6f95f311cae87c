"""The exact sync rule by sets: windows and joins where a connection's ids behave, the state machine for the others.

A run is a stretch of a connection's updates without a gap. Where ids only grow, a snapshot is bridged, if at all, by the
first update that reaches its id, and it brings the book up to the end of that update's run. What that misses is a snapshot
whose bridge lies before a gap that the book has taken already: the update is no longer held. Connections with such a
snapshot, or with ids that fall, take ``sync.sync_actions``; so do venues that push their snapshots, once one follows a gap.

How it scales. All windows share one shuffle by connection and sort on disk; a connection is held in memory only where it
goes through the state machine. Bridges are found by a sort on ids, so that neither the width of an update's span nor the
number of snapshots multiplies rows.

Defined cases: missing ids count as 0; messages of a connection that share a recv_seq, and connections whose key holds a
null, take the state machine; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from depthframe.operators.sync import KEY, POLICIES, Policy, sync_actions
from depthframe.sources.shared import materialize
from depthframe.types import DELTA, INVALIDATE, REQUEST, SNAPSHOT

IDS = ["first_id", "final_id", "prev_final_id", "last_update_id"]
_OUT = ["recv_seq", "ord", "action", "message_seq"]


def _by_seq() -> WindowSpec:
    return Window.partitionBy(*KEY).orderBy("recv_seq")


def _so_far() -> WindowSpec:
    return _by_seq().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _before() -> WindowSpec:
    return _by_seq().rowsBetween(Window.unboundedPreceding, -1)


def _true(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _any(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, map(_true, conditions))


def _count(condition: Column) -> Column:
    return F.sum(condition.cast("bigint")).over(_so_far())


def _gap(p: Policy, previous: Column) -> Column:
    return _true(~F.col("snap") & ~p.contiguous(F.col("first_id"), F.col("final_id"), F.col("prev_final_id"), previous))


def _fetched(rows: DataFrame, p: Policy) -> DataFrame:
    """Runs of updates, and for each snapshot the update that bridges it (``bridge``) and whether the book takes it."""
    update = lambda c: F.when(~F.col("snap"), c)
    before = lambda c: F.last(update(F.col(c)), ignorenulls=True).over(_before())
    rows = rows.withColumns({"previous_id": before("final_id"), "previous_first": before("first_id"), "nth": _count(~F.col("snap"))})
    falls = _any(F.col("final_id") < F.col("previous_id"), F.col("first_id") < F.col("previous_first")) & ~F.col("snap")
    older = F.col("last_update_id") < F.max(F.when(F.col("snap"), F.col("last_update_id"))).over(_before())
    rows = rows.withColumns({"gap": _gap(p, F.col("previous_id")), "strange": F.col("strange") | falls | _true(F.col("snap") & older)})
    rows = rows.withColumns({"run": _count(F.col("gap")), "id": F.when(F.col("snap"), F.col("last_update_id") + p.at).otherwise(F.col("final_id"))})
    # From the largest id down, updates before snapshots: the last update seen is the first that reaches the snapshot's id.
    down = Window.partitionBy(*KEY).orderBy(F.desc("id"), "snap", F.desc("recv_seq")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = F.last(update(F.struct("recv_seq", "first_id", "run", "nth")), ignorenulls=True).over(down)
    rows = rows.withColumn("reached", reached)
    bridged = F.col("snap") & (F.col("reached.recv_seq") < F.col("recv_seq")) & (F.col("reached.first_id") <= F.col("id"))
    rows = rows.withColumn("bridge", F.when(bridged, F.col("reached"))).withColumn("applied", F.max("bridge.run").over(_before()))
    new = F.col("applied").isNull() | (F.col("bridge.run") > F.col("applied"))
    gone = ~new & (F.col("run") > F.col("bridge.run"))
    return rows.withColumns({"taken": F.col("bridge").isNotNull() & new, "strange": F.col("strange") | _true(gone)}).drop("reached", "applied", "id", "previous_id", "previous_first")


def _pushed(rows: DataFrame, p: Policy) -> DataFrame:
    """Gaps of updates after what came before them, and whether the connection starts with its snapshot."""
    id_ = F.when(F.col("snap"), F.col("last_update_id")).otherwise(F.col("final_id"))
    rows = rows.withColumns({"gap": _gap(p, F.lag(id_).over(_by_seq())), "started": F.first("snap").over(_so_far())})
    rows = rows.withColumn("lost", _count(F.col("gap")))
    return rows.withColumn("strange", F.col("strange") | (F.col("snap") & ((F.col("lost") > 0) | ~F.col("started"))))


def marked(messages: DataFrame, policy: str) -> DataFrame:
    """Messages with what the set form needs to know of them; ``strange`` marks all of a connection that it can't judge."""
    p = POLICIES[policy]
    rows = messages.select(*KEY, "recv_seq", "kind", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in IDS])
    rows = rows.withColumn("snap", _true(F.col("kind") == SNAPSHOT)).withColumn("place", F.row_number().over(_by_seq()))
    rows = rows.withColumn("strange", _any(F.lag("recv_seq").over(_by_seq()) == F.col("recv_seq"), *[F.col(c).isNull() for c in [*KEY, "recv_seq"]]))
    rows = (_pushed if p.pushed else _fetched)(rows, p)
    return rows.withColumn("strange", F.max("strange").over(Window.partitionBy(*KEY)))


def _action(rows: DataFrame, name: str, ord_: Column, message: Column | None = None) -> DataFrame:
    return rows.select(*KEY, "recv_seq", ord_.cast("int").alias("ord"), F.lit(name).alias("action"), (F.lit(None) if message is None else message).cast("bigint").alias("message_seq"))


def _fetched_actions(rows: DataFrame) -> list[DataFrame]:
    seq = F.col("recv_seq")
    taken = rows.where("taken")
    episodes = taken.select(*KEY, F.col("bridge.run").alias("run"), seq.alias("snapshot_seq"), F.col("bridge.nth").alias("from_nth"))
    updates = rows.where(~F.col("snap")).select(*KEY, "run", "recv_seq", "nth", "gap", F.lit(DELTA).alias("action"), seq.alias("message_seq"))
    ends = updates.where("gap").withColumns({"run": F.col("run") - 1, "action": F.lit(INVALIDATE), "message_seq": F.lit(None).cast("bigint")})
    done = updates.unionByName(ends).join(episodes, [*KEY, "run"]).where("nth >= from_nth")
    held = seq < F.col("snapshot_seq")
    place = F.when(held, F.col("nth") - F.col("from_nth") + 1).otherwise(0)
    return [
        _action(rows.where("place = 1"), REQUEST, F.lit(0)),
        _action(rows.where("snap AND NOT taken"), REQUEST, F.col("place") == 1),
        _action(taken, SNAPSHOT, F.lit(0), seq),
        done.select(*KEY, F.greatest("recv_seq", "snapshot_seq").alias("recv_seq"), place.cast("int").alias("ord"), "action", "message_seq"),
    ]


def _pushed_actions(rows: DataFrame) -> list[DataFrame]:
    seq = F.col("recv_seq")
    return [
        _action(rows.where("place = 1"), REQUEST, F.lit(0)),
        _action(rows.where("snap"), SNAPSHOT, F.col("place") == 1, seq),
        _action(rows.where("started AND NOT snap AND lost = 0"), DELTA, F.lit(0), seq),
        _action(rows.where("started AND gap AND lost = 1"), INVALIDATE, F.lit(0)),
    ]


def sync_actions_by_sets(messages: DataFrame, policy: str) -> DataFrame:
    """The rows of ``sync.sync_actions``: KEY, recv_seq (what triggered it), ord, action and the message that it applies."""
    rows = materialize(marked(messages, policy), "sync-marked")
    plain = rows.where("NOT strange")
    made = (_pushed_actions if POLICIES[policy].pushed else _fetched_actions)(plain)
    rest = sync_actions(rows.where("strange").select(*KEY, "recv_seq", "kind", *IDS), policy)
    return reduce(DataFrame.unionByName, [m.select(*KEY, *_OUT) for m in made], rest)
