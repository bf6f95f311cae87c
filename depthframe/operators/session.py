"""The whole chain of a recorded session: venue texts to the level table, by each venue's own rules.

1. ``normalize`` parses the texts; only good messages of subscribed symbols go on.
2. Each symbol of a connection goes through its venue's sequence rule (``sync.SyncState``), on ids alone. A message that
   should be applied but has a bad level is rejected whole: it invalidates the symbol, as a disconnect does.
3. After a gap or a rejected message, a venue that pushes its snapshots drops its connection: what any symbol gets later
   on that connection is void, and all its symbols are invalidated. Of other venues only the symbol starts anew, with
   the next snapshot that is fetched.
4. A later connection of a venue invalidates all that the earlier one held.
5. What is done to each book is numbered 1, 2, ... in the order of (recv_seq, ord), which is the level table's seq; applied
   messages are joined back for their levels.

How it scales. A task of step 2 walks symbols and connections in order, ids only, and holds what one symbol holds back. Step 3 needs one
row for each connection, step 4 one for each symbol of each. Numbers are dense within a book, whatever recv_seq counts
(messages, microseconds), so blocks of seq hold as many messages as they are wide. Levels are joined by message number.

Defined cases: IGNORED and MALFORMED texts and symbols without a subscription are left out; a snapshot without levels
still voids what was held (a row without a price); messages after a dropped connection's gap count as never received;
messages of one symbol and connection under one recv_seq are one message that was recorded again: the first by kind and ids
counts; equal recv_seq of different symbols are taken in any order.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from depthframe.functions.symbols import book_to_string
from depthframe.sources.shared import materialize
from depthframe.types import DELTA, INVALIDATE, REQUEST, SNAPSHOT

from .blocks import dense_numbers
from .normalize import VENUES, is_rejected, normalize_messages
from .routing import route_symbols
from .sync import KEY, POLICIES, SyncState, by_connection

#: What tells apart the messages under one recv_seq of a symbol.
IDS = ["kind", "first_id", "final_id", "prev_final_id", "last_update_id"]

PUSHED = [v for v, (_, _, policy) in VENUES.items() if POLICIES[policy].pushed]


def session_messages(normal: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Good ones of normalised messages, of subscribed symbols: venue, symbol, conn_epoch, recv_seq, kind, ids, book, bids, asks, bad."""
    good = normal.where(F.col("kind").isNotNull())
    book = book_to_string(F.col("base"), F.col("quote"), F.col("market")).alias("book")
    bad = F.coalesce(is_rejected(F.col("bids"), F.col("asks")), F.lit(False)).alias("bad")
    routed = route_symbols(good, subscriptions)
    return routed.select("venue", F.col("native_symbol").alias("symbol"), "conn_epoch", "recv_seq", "kind", "first_id", "final_id", "prev_final_id", "last_update_id", book, "bids", "asks", bad)


class SymbolRule:
    """What one symbol's rule does with the messages of one connection, given in order of recv_seq.

    A symbol of a venue that pushes snapshots stops at its first INVALIDATE; the others ask for a snapshot after it.
    """

    def __init__(self, venue: str):
        self.state = SyncState(POLICIES[VENUES[venue][2]])
        self.begun = self.stopped = False
        self.bad: set[int] = set()  # of the messages that are held back

    def take(self, seq: int, kind: str, first, final, prev, last, bad: bool) -> list[tuple[int, str, int | None]]:
        """(ord, action, message_seq) of what the message triggers."""
        if self.stopped:
            return []
        state, number = self.state, lambda x: 0 if x is None else int(x)
        if bad:
            self.bad.add(seq)
        asked = [] if self.begun else state.connected()
        self.begun = True
        made = state.snapshot(seq, number(last)) if kind == SNAPSHOT else state.update(seq, number(first), number(final), number(prev))
        done = []
        for action, message in made:
            done += state.disconnected() if message in self.bad else [(action, message)]
        if any(action == INVALIDATE for action, _ in done):
            if state.policy.pushed:
                self.stopped = True
            else:
                done += state.connected()
        if self.bad:
            self.bad &= {m[0] for m in state.held}
        out, rank = [], 0  # a request takes no rank: it changes no book
        for action, message in asked + done:
            out.append((rank, action, message))
            rank += action != REQUEST
        return out


def in_receipt(rows: pd.DataFrame) -> pd.DataFrame:
    """A symbol's messages in the order of recv_seq, each number once."""
    return rows.sort_values(["recv_seq", *IDS, "bad"], na_position="first").drop_duplicates("recv_seq")


def symbol_actions(messages: DataFrame) -> DataFrame:
    """What each symbol's rule does with its own messages: KEY, recv_seq, ord, action, message_seq."""

    def begin(venue: str) -> Callable:
        rule, before = SymbolRule(venue), None

        def take(seq: int, *message) -> list[tuple[int, str, int | None]]:
            nonlocal before
            again, before = seq == before, seq
            return [] if again else rule.take(seq, *message)

        return take

    return by_connection(messages, [*IDS, "bad"], begin)


def session_actions(messages: DataFrame) -> DataFrame:
    """``symbol_actions`` up to the point where their connection is dropped, and INVALIDATE for every symbol that another one's
    gap, or a later connection, voids (ord -1: before anything that the same message triggers)."""
    actions = materialize(symbol_actions(messages), "session-actions")
    connection = ["venue", "conn_epoch"]
    drops = actions.where(F.col("venue").isin(PUSHED) & (F.col("action") == INVALIDATE)).groupBy(*connection).agg(F.min("recv_seq").alias("dropped"))
    kept = actions.join(drops, connection, "left").where("dropped IS NULL OR recv_seq <= dropped").drop("dropped")

    members = messages.groupBy(*KEY).agg(F.min("recv_seq").alias("first_seq"))
    void = lambda rows, at: rows.select(*KEY, F.col(at).alias("recv_seq"), F.lit(-1).alias("ord"), F.lit(INVALIDATE).alias("action"), F.lit(None).cast("bigint").alias("message_seq"))
    begins = members.groupBy(*connection).agg(F.min("first_seq").alias("begins"))
    following = begins.withColumn("ended", F.lead("begins").over(Window.partitionBy("venue").orderBy("conn_epoch"))).where("ended IS NOT NULL")
    dropped = members.join(drops, connection)
    return kept.unionByName(void(dropped, "dropped")).unionByName(void(members.join(following, connection), "ended"))


def session_levels(messages: DataFrame, actions: DataFrame) -> DataFrame:
    """The level table of a session: book, venue, seq, kind, pos, side, price_raw, size_raw, and recv_seq and ord of what seq numbers."""
    books = messages.select("venue", "symbol", "book").distinct()
    acts = materialize(actions.where(F.col("action") != REQUEST).withColumnRenamed("action", "kind").join(books, ["venue", "symbol"]), "session-numbered")
    acts = acts.join(dense_numbers(acts, "book", ["recv_seq", "ord"], "seq"), ["book", "recv_seq", "ord"])
    place = ["book", "venue", "seq", "kind", "recv_seq", "ord"]
    tagged = lambda c, side: F.transform(c, lambda x: F.struct(F.lit(side).alias("side"), x["price_raw"].alias("price_raw"), x["size_raw"].alias("size_raw")))
    body = F.concat(tagged("bids", "BID"), tagged("asks", "ASK"))
    bodies = messages.groupBy(*KEY, F.col("recv_seq").alias("message_seq")).agg(F.min_by(body, F.struct(*IDS, "bad")).alias("levels"))
    applied = acts.where(F.col("kind").isin(SNAPSHOT, DELTA)).join(bodies, [*KEY, "message_seq"]).select(*place, F.posexplode_outer("levels").alias("pos", "x"))
    applied = applied.where("kind = 'SNAPSHOT' OR x IS NOT NULL").select(*place, (F.coalesce("pos", F.lit(0)) + 1).alias("pos"), "x.side", "x.price_raw", "x.size_raw")
    nothing = [F.lit(None).cast(t).alias(n) for n, t in (("side", "string"), ("price_raw", "bigint"), ("size_raw", "bigint"))]
    voided = acts.where(F.col("kind") == INVALIDATE).select(*place, F.lit(1).alias("pos"), *nothing)
    return applied.unionByName(voided.distinct())


def replay(raw: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """The level table of raw venue texts."""
    normal = materialize(normalize_messages(raw), "session-messages")  # read several times below, parsed once
    messages = session_messages(normal, subscriptions)
    return session_levels(messages, session_actions(messages))
