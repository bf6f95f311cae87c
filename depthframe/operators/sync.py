"""Sequence rules of venues: gaps, snapshots and the updates that bridge them, and the exact sync state machine.

Messages: venue, symbol, conn_epoch, recv_seq (order of receipt), kind (SNAPSHOT or DELTA), first_id, final_id,
prev_final_id, last_update_id. A connection's messages are independent of those before it, so everything is keyed by
(venue, symbol, conn_epoch).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depthframe.types import DELTA, INVALIDATE, REQUEST, SNAPSHOT

KEY = ["venue", "symbol", "conn_epoch"]


@dataclass(frozen=True)
class Policy:
    """A venue's rule. The functions work on columns and on numbers alike: (first, final, prev, last) -> truth."""

    drop: Callable
    bridge: Callable
    contiguous: Callable
    #: Whether the venue pushes its snapshot first on each connection (else it is fetched apart).
    pushed: bool
    #: The id at which the bridge of a snapshot is looked up, from its last_update_id; and whether it lies in a span of ids.
    at: int
    span: bool


POLICIES = {
    "futures": Policy(lambda f, e, p, last: e < last, lambda f, e, p, last: (f <= last) & (last <= e), lambda f, e, p, last: p == last, False, 0, True),
    "spot": Policy(lambda f, e, p, last: e <= last, lambda f, e, p, last: (f <= last + 1) & (last + 1 <= e), lambda f, e, p, last: f == last + 1, False, 1, True),
    "bybit": Policy(lambda f, e, p, last: e <= last, lambda f, e, p, last: e == last + 1, lambda f, e, p, last: e == last + 1, True, 1, False),
    "okx": Policy(lambda f, e, p, last: e < last, lambda f, e, p, last: p == last, lambda f, e, p, last: p == last, True, 0, False),
}
#: Width of the id buckets in which spans are looked up.
BUCKET = 64


def _ids() -> tuple[Column, Column, Column]:
    return F.col("first_id"), F.col("final_id"), F.col("prev_final_id")


def marked_updates(messages: DataFrame, policy: str) -> DataFrame:
    """Updates with the final id before (NULL for a connection's first) and whether that leaves a gap."""
    before = F.lag("final_id").over(Window.partitionBy(*KEY).orderBy("recv_seq"))
    rows = messages.where(F.col("kind") == DELTA).withColumn("previous_id", before)
    return rows.withColumn("gap", F.col("previous_id").isNotNull() & ~POLICIES[policy].contiguous(*_ids(), F.col("previous_id")))


def sequence_gaps(messages: DataFrame, policy: str) -> DataFrame:
    return marked_updates(messages, policy).where("gap").select(*KEY, "recv_seq", "previous_id", "first_id", "final_id")


def snapshot_bridges(messages: DataFrame, policy: str) -> DataFrame:
    """KEY, snapshot_seq, last_update_id, bridge_seq: the earliest update of the connection that bridges each snapshot.

    An equi-join on ids: updates that cover a span of ids are written under each bucket of ids that they touch.
    """
    p = POLICIES[policy]
    updates = messages.where(F.col("kind") == DELTA).select(*KEY, F.col("recv_seq").alias("update_seq"), "first_id", "final_id", "prev_final_id")
    snapshots = messages.where(F.col("kind") == SNAPSHOT).select(*KEY, F.col("recv_seq").alias("snapshot_seq"), "last_update_id")
    wanted = F.col("last_update_id") + p.at
    if p.span:
        bucket = lambda c: F.floor(c / F.lit(BUCKET)).cast("bigint")
        updates = updates.withColumn("spot", F.explode(F.sequence(bucket(F.col("first_id")), bucket(F.col("final_id")))))
        snapshots = snapshots.withColumn("spot", bucket(wanted))
    else:
        updates = updates.withColumn("spot", F.col("final_id") if policy == "bybit" else F.col("prev_final_id"))
        snapshots = snapshots.withColumn("spot", wanted)
    pairs = snapshots.join(updates, [*KEY, "spot"]).where(p.bridge(*_ids(), F.col("last_update_id")))
    return pairs.groupBy(*KEY, "snapshot_seq", "last_update_id").agg(F.min("update_seq").alias("bridge_seq"))


def sync_episodes(messages: DataFrame, policy: str) -> DataFrame:
    """For every bridged snapshot the run of contiguous updates from its bridge on: bridge_seq, last_seq, updates.

    Exact for venues whose ids only grow within a connection; ``sync_actions`` holds for all.
    """
    run = F.sum(F.col("gap").cast("int")).over(Window.partitionBy(*KEY).orderBy("recv_seq").rowsBetween(Window.unboundedPreceding, 0))
    runs = marked_updates(messages, policy).withColumn("run", run)
    nth = F.row_number().over(Window.partitionBy(*KEY, "run").orderBy("recv_seq"))
    runs = runs.select(*KEY, "recv_seq", "run", nth.alias("nth"))
    ends = runs.groupBy(*KEY, "run").agg(F.max("recv_seq").alias("last_seq"), F.max("nth").alias("n"))
    found = snapshot_bridges(messages, policy).withColumnRenamed("bridge_seq", "recv_seq").join(runs, [*KEY, "recv_seq"]).join(ends, [*KEY, "run"])
    return found.select(*KEY, "snapshot_seq", "last_update_id", F.col("recv_seq").alias("bridge_seq"), "last_seq", (F.col("n") - F.col("nth") + 1).cast("bigint").alias("updates"))


def disconnect_resets(messages: DataFrame) -> DataFrame:
    """venue, symbol, recv_seq: the first message of every connection but the first; what was held before is void."""
    first = messages.groupBy(*KEY).agg(F.min("recv_seq").alias("recv_seq"))
    earlier = F.lag("conn_epoch").over(Window.partitionBy("venue", "symbol").orderBy("conn_epoch"))
    return first.withColumn("earlier", earlier).where("earlier IS NOT NULL").select("venue", "symbol", "recv_seq")


class SyncState:
    """One connection of one symbol. Events give (action, message) pairs; a message is (recv_seq, first, final, prev)."""

    def __init__(self, policy: Policy):
        self.policy, self.live, self.held, self.last, self.asked = policy, False, [], 0, False

    def connected(self) -> list[tuple[str, int | None]]:
        if self.live or self.asked:
            return []
        self.asked = True
        return [(REQUEST, None)]

    def _gap(self, rest: list) -> list[tuple[str, int | None]]:
        self.live, self.held, self.last, self.asked = False, rest, 0, False
        return [(INVALIDATE, None)]

    def update(self, seq: int, first: int, final: int, prev: int) -> list[tuple[str, int | None]]:
        message = (seq, first, final, prev)
        if not self.live:
            self.held.append(message)
            return []
        if not self.policy.contiguous(first, final, prev, self.last):
            return self._gap([message])
        self.last = final
        return [(DELTA, seq)]

    def snapshot(self, seq: int, last: int) -> list[tuple[str, int | None]]:
        untouched = not self.held
        self.held = [m for m in self.held if not self.policy.drop(*m[1:], last)]
        start = next((k for k, m in enumerate(self.held) if self.policy.bridge(*m[1:], last)), None)
        if start is None:
            if not self.policy.pushed:
                return [(REQUEST, None)]
            if not untouched:
                return self._gap(self.held)
            self.live, self.last = True, last
            return [(SNAPSHOT, seq)]
        out: list[tuple[str, int | None]] = [(SNAPSHOT, seq)]
        for k in range(start, len(self.held)):
            number, first, final, prev = self.held[k]
            if k > start and not self.policy.contiguous(first, final, prev, self.last):
                return out + self._gap(self.held[k:])
            self.last = final
            out.append((DELTA, number))
        self.live, self.held = True, []
        return out

    def disconnected(self) -> list[tuple[str, int | None]]:
        self.live, self.held, self.last, self.asked = False, [], 0, False
        return [(INVALIDATE, None)]


ACTIONS = "venue string, symbol int, conn_epoch bigint, recv_seq bigint, ord int, action string, message_seq bigint"


def by_connection(messages: DataFrame, fields: list[str], begin: Callable[[str], Callable]) -> DataFrame:
    """``ACTIONS`` of messages taken in the order of recv_seq, then fields, nulls first: ``begin(venue)`` gives a connection's rule,
    a function of (recv_seq, *fields) to (ord, action, message_seq)s.

    A task walks its connections one after another as they come from a sort on disk, so neither many short connections nor a
    long one cost more than their messages; it holds what the rule of one holds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = take = None
        for batch in batches:
            out: list[tuple] = []
            for *own, seq, message in zip(*[batch[c].to_pylist() for c in (*KEY, "recv_seq")], zip(*[batch[c].to_pylist() for c in fields], strict=True), strict=True):
                if own != key:
                    key, take = own, begin(own[0])
                out += [(*own, seq, *made) for made in take(seq, *message)]
            kinds = [pa.string(), batch.schema.field("symbol").type, pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64()]
            columns = list(zip(*out, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=[*KEY, "recv_seq", "ord", "action", "message_seq"])

    rows = messages.select(*KEY, "recv_seq", *fields).repartition(*KEY).sortWithinPartitions(*KEY, "recv_seq", *fields)
    return rows.mapInArrow(run, ACTIONS.replace("symbol int", f"symbol {messages.schema['symbol'].dataType.simpleString()}"))


def sync_actions(messages: DataFrame, policy: str) -> DataFrame:
    """What the book has to do, exactly: KEY, recv_seq (what triggered it), ord, action and the message that it applies.

    Only ids go to Python; levels are joined back by message_seq.
    """
    rule = POLICIES[policy]

    def begin(venue: str) -> Callable:
        state, begun = SyncState(rule), False

        def take(seq: int, kind: str, *ids) -> list[tuple[int, str, int | None]]:
            nonlocal begun
            first, final, prev, last = (0 if x is None else int(x) for x in ids)
            made, begun = [] if begun else state.connected(), True
            made += state.snapshot(seq, last) if kind == SNAPSHOT else state.update(seq, first, final, prev)
            return [(i, a, m) for i, (a, m) in enumerate(made)]

        return take

    return by_connection(messages, ["kind", "first_id", "final_id", "prev_final_id", "last_update_id"], begin)


def resync_requests(actions: DataFrame) -> DataFrame:
    return actions.where(F.col("action") == REQUEST).select(*KEY, "recv_seq")
