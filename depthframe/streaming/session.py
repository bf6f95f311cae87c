"""The whole chain of a session as one stream: raw venue texts in, diffs of the books out.

Three stateful operators follow each other in a query, all parsing and routing before them in column expressions. Rows reach
each of them in packets (``packets``):

1. ``SymbolProcessor``, keyed by (venue, symbol, lane), as connections are dealt over ``LANES``: the venue's sequence rule, for each
   connection on its own. State of a connection:
   where the rule stands, and packets of the messages held back until a snapshot bridges them, with their levels. Out: what is
   applied, and control rows for the venue: SEEN (a symbol's first message on a connection) and GAP (a pushed venue's
   gap, which drops the connection).
2. ``ConnectionProcessor``, keyed by route. A route is a venue of a book, whose rows pass through, or a venue, whose control rows are
   gathered. State of a venue: its connection and that one's symbols with their books. Out: a gap fans out as DROPPED rows,
   a new connection as INVALIDATE rows, one for the book of each symbol. Only control rows meet at a venue, a few for each
   symbol and connection; levels are dealt by book from the first operator on.
3. ``book.packed_book``, keyed by book: applies levels, leaves out what comes of a dropped connection, emits diffs.

Rows of a micro-batch reach every operator in the same micro-batch and are taken in the order of recv_seq there. So
the source must hand out recv_seq in order from batch to batch; what comes at or before a symbol's last message on a connection is
dropped, and so a message recorded twice counts once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from depthframe.operators.normalize import normalize_messages
from depthframe.operators.session import IDS, SymbolRule, in_receipt, session_messages
from depthframe.types import DELTA, DROPPED, INVALIDATE, REQUEST

from . import packets
from .book import PACKED, POINT, SIDES, packed_book

ROUTED = "route string, book string, packet binary"
BOOKED = "book string, packet binary"
#: Keys that the connections of a symbol are dealt over.
LANES = 8
#: Control rows to a venue, before anything else that the same message triggers.
SEEN, GAP = "SEEN", "GAP"
CONTROL = ["symbol", "book", "conn_epoch", "recv_seq", "kind"]
#: Columns of a message that is held back, in a packet.
HELD = ["recv_seq", *IDS, "bad", "levels"]
_KINDS = dict(zip(PACKED, [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64()], strict=True))


def _table(columns: dict[str, list], kinds: dict[str, pa.DataType] | None = None) -> pa.Table:
    return pa.table({c: pa.array(x, (kinds or {}).get(c)) for c, x in columns.items()})


def _numbers(column: pa.ChunkedArray) -> list[int]:
    """Ids as whole numbers, 0 where there is none; those beyond 63 bits too."""
    filled = pc.fill_null(column, 0)
    try:
        return filled.cast(pa.int64()).to_pylist()
    except pa.ArrowInvalid:
        return [int(x) for x in filled.to_pylist()]


def _sorted(messages: pa.Table) -> pa.Table:
    """A symbol's messages in the order of connections and of recv_seq, each number of a connection once, as ``in_receipt`` has them."""
    epoch, seq = messages["conn_epoch"].to_numpy(), messages["recv_seq"].to_numpy()
    order = np.lexsort((seq, epoch))
    again = (np.diff(epoch[order]) == 0) & (np.diff(seq[order]) == 0)
    if again.any():
        frame = messages.drop_columns(["levels"]).to_pandas()
        order = np.concatenate([in_receipt(part).index.to_numpy() for _, part in frame.groupby("conn_epoch")])
    return messages.take(order)


class SymbolProcessor(StatefulProcessor):
    """Some connections of a symbol: messages with their levels in, routed rows out, all in packets."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "conn_epoch bigint")
        self.places = handle.getMapState("places", "conn_epoch bigint", "seq bigint, live boolean, last string, asked boolean, stopped boolean, parts int")
        self.held = handle.getMapState("held", "conn_epoch bigint, part int", "packet binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        venue, symbol, _ = key
        messages = _sorted(packets.opened(rows))
        book = messages["book"][0].as_py()
        newest = self.newest.get()[0] if self.newest.exists() else None
        epochs = messages["conn_epoch"].to_numpy()
        ends = np.append(np.flatnonzero(np.diff(epochs)) + 1, len(epochs)).tolist()
        bodies, heights = [messages.select(HELD)], messages.num_rows
        columns = list(zip(messages["recv_seq"].to_pylist(), messages["kind"].to_pylist(), *[_numbers(messages[c]) for c in IDS[1:]], messages["bad"].to_pylist(), strict=True))
        controls: list[tuple] = []
        made: list[tuple] = []  # seq, ord, kind, connection, and the place of its levels in bodies
        begin = 0
        for end in ends:
            epoch = int(epochs[begin])
            # A connection that is newer than all before has no state yet.
            place = self.places.getValue((epoch,)) if newest is not None and epoch <= newest else None
            rule, applied, known, parts, at = SymbolRule(venue), None, [], 0, {}
            if place is not None:
                applied, rule.state.live, last, rule.state.asked, rule.stopped, parts = place
                rule.begun, rule.state.last = True, int(last)
                for part in range(parts):
                    table = packets.read(self.held.getValue((epoch, part))[0])
                    first, final, prev = (_numbers(table[c]) for c in ("first_id", "final_id", "prev_final_id"))
                    known += zip(table["recv_seq"].to_pylist(), first, final, prev, strict=True)
                    rule.bad |= {seq for seq, bad in zip(table["recv_seq"].to_pylist(), table["bad"].to_pylist(), strict=True) if bad}
                    at |= {seq: heights + n for n, seq in enumerate(table["recv_seq"].to_pylist())}
                    bodies.append(table)
                    heights += table.num_rows
                rule.state.held = list(known)
            for n in range(begin, end):
                seq, *message = columns[n]
                if applied is not None and seq <= applied:
                    continue
                if applied is None:
                    controls.append((symbol, book, epoch, seq, SEEN))
                applied, at[seq], running = seq, n, not rule.stopped
                for ord_, action, number in rule.take(seq, *message):
                    if action != REQUEST:
                        made.append((seq, ord_, action, epoch, at.get(number)))
                if running and rule.stopped:
                    controls.append((symbol, book, epoch, seq, GAP))
            held = rule.state.held
            kept = 0 if held[: len(known)] != known else len(known)
            if not kept:
                for part in range(parts):
                    self.held.removeKey((epoch, part))
                parts = 0
            if held[kept:]:
                waiting = pa.concat_tables(bodies).take([at[m[0]] for m in held[kept:]])
                self.held.updateValue((epoch, parts), (packets.closed(waiting.combine_chunks()),))
                parts += 1
            self.places.updateValue((epoch,), (applied, rule.state.live, str(rule.state.last), rule.state.asked, rule.stopped, parts))
            newest = epoch if newest is None else max(newest, epoch)
            begin = end
        self.newest.update((newest,))
        out = []
        if made:
            out.append((f"book {book} {venue}", book, packets.closed(_levels(venue, made, pa.concat_tables(bodies)["levels"].combine_chunks()))))
        if controls:
            out.append((f"venue {venue}", book, packets.closed(_table(dict(zip(CONTROL, zip(*controls, strict=True), strict=True))))))
        yield pd.DataFrame(out, columns=["route", "book", "packet"], dtype=object)

    def close(self) -> None:
        pass


def _levels(venue: str, made: list[tuple], bodies: pa.ListArray) -> pa.Table:
    """Level rows, as ``packed_book`` takes them, of what is done to a book; a row without a level for what has none."""
    seq, ord_, kind, epoch, at = zip(*made, strict=True)
    levels = bodies.take(pa.array(at, pa.int64()))
    count = pc.fill_null(pc.list_value_length(levels), 0).to_numpy(zero_copy_only=False)
    none = (count == 0) & (np.array(kind, object) != DELTA)
    of = np.repeat(np.arange(len(made)), np.where(none, 1, count))
    begins = np.cumsum(np.append(0, np.where(none, 1, count)))[:-1]
    pos = np.arange(len(of)) - begins[of]
    # The place of each row's level among all levels, none for a row without one.
    place = pa.array((np.cumsum(count) - count)[of] + pos, mask=none[of])
    level = pc.list_flatten(levels).take(place)
    side = pa.array(SIDES[::-1]).take(level.field("bid").cast(pa.int8())) if len(level) else pa.array([], pa.string())
    side = pc.if_else(pa.array(none[of]), pa.scalar(None, pa.string()), side)
    spread = lambda values, type_: pa.array(values, type_).take(pa.array(of))
    price, size = (pc.if_else(pa.array(none[of]), pa.scalar(0, pa.int64()), level.field(c)) for c in ("price_raw", "size_raw"))
    n = len(of)
    columns = [pa.array([venue] * n, pa.string()), spread(seq, pa.int64()), spread(ord_, pa.int32()), spread(kind, pa.string()), spread(epoch, pa.int64()), pa.array(np.full(n, -1), pa.int64()), pa.array(pos + 1, pa.int32()), side, price, size]
    return pa.table(dict(zip(PACKED, columns, strict=True)))


class ConnectionProcessor(StatefulProcessor):
    """Passes on a book's packets; turns a venue's control rows into rows of all books that they concern."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.connection = handle.getValueState("connection", "epoch bigint, dropped bigint")
        self.members = handle.getMapState("members", "symbol string", "book string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if key[0].startswith("book "):
            for frame in rows:
                yield frame[["book", "packet"]].astype(object)
            return
        venue = key[0].removeprefix("venue ")
        epoch, dropped = self.connection.get() if self.connection.exists() else (None, None)
        members = {k[0]: v[0] for k, v in self.members.iterator()}
        stored, out = dict(members), {}
        frame = packets.opened(rows).to_pandas()
        frame = frame.sort_values(["recv_seq", "kind"], ascending=[True, False], kind="stable")  # SEEN before GAP
        for symbol, book, e, seq, kind in zip(*[frame[c].tolist() for c in CONTROL], strict=True):
            if epoch is not None and e < epoch:
                continue
            if e != epoch:
                for b in members.values():
                    out.setdefault(b, []).append((seq, INVALIDATE, epoch, -1))
                epoch, dropped, members = e, None, {}
            if kind == SEEN:
                members[symbol] = book
                if dropped is not None:
                    out.setdefault(book, []).append((seq, DROPPED, epoch, dropped))
            elif dropped is None:
                dropped = seq
                for b in members.values():
                    out.setdefault(b, []).append((seq, DROPPED, epoch, seq))
        for symbol in stored.keys() - members.keys():
            self.members.removeKey((symbol,))
        for symbol, book in members.items():
            if stored.get(symbol) != book:
                self.members.updateValue((symbol,), (book,))
        self.connection.update((epoch, dropped))
        made = []
        for book, told in out.items():
            seqs, kinds, epochs, since = zip(*told, strict=True)
            n = len(told)
            columns = dict(zip(PACKED, [[venue] * n, seqs, [-1] * n, kinds, epochs, since, [1] * n, [None] * n, [0] * n, [0] * n], strict=True))
            made.append((book, packets.closed(_table(columns, _KINDS))))
        yield pd.DataFrame(made, columns=["book", "packet"], dtype=object)

    def close(self) -> None:
        pass


def session_packets(raw: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """A stream of level rows in packets, as ``packed_book`` takes them, from a stream of raw venue texts."""
    normal = normalize_messages(raw)
    # A generator's output isn't put in place of its columns by the optimiser: a text is parsed once, however many filters follow.
    normal = normal.select(F.inline(F.array(F.struct(*normal.columns))))
    messages = session_messages(normal, subscriptions)
    tagged = lambda c, bid: F.transform(c, lambda x: F.struct(F.lit(bid).alias("bid"), x["price_raw"].alias("price_raw"), x["size_raw"].alias("size_raw")))
    rows = messages.select("venue", "symbol", "conn_epoch", "recv_seq", *IDS, "bad", "book", F.concat(tagged("bids", True), tagged("asks", False)).alias("levels"))
    by = ["venue", "symbol", "lane"]
    ruled = packets.packed(rows.withColumn("lane", F.pmod("conn_epoch", F.lit(LANES))), by).groupBy(*by).transformWithStateInPandas(SymbolProcessor(), ROUTED, "append", "none")
    return ruled.groupBy("route").transformWithStateInPandas(ConnectionProcessor(), BOOKED, "append", "none")


def live_session(raw: DataFrame, subscriptions: DataFrame, point: int = POINT) -> DataFrame:
    """DIFF, BBO and LIVE rows of a stream of raw venue texts; (seq, ord) is a row's trigger's recv_seq, and its rank there."""
    return packed_book(session_packets(raw, subscriptions), "string", point=point)
