"""The live aggregate book as a stateful stream: level rows in, diffs, best prices and live venues out.

State is keyed by book and lives in the state store: what each venue holds at each price, the aggregate size of each
price, an ordered index of the prices of either (``price_index``), the live venues, the revision, and where messages are
applied up to. A micro-batch reads the cells that its messages touch, point by point: a price's sizes, the index where a price
comes or goes, the levels of a venue that is reset. So a batch costs its rows, whatever the depth of the book. Where reading
all in a row costs less than so many points (``POINT``), the batch reads all, and is applied by arrays (``whole_batch``). Only what changed is written back.

Rows reach the state in packets (``packets``), as their number is what costs on the way. Those of a micro-batch are applied in the order of (seq, ord, pos). Batches must not overlap in that order; rows at or before
the applied place come late and are dropped. A message with a bad level on either side is void, and so is what its venue
held: it counts as an invalidation of the venue. A DROPPED row invalidates its venue and says that what comes of that
connection (conn_epoch) after seq ``since`` is void too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from depthframe.operators.bbo import Side
from depthframe.types import DELTA, DROPPED, INVALIDATE, SNAPSHOT

from . import packets, whole_batch
from .price_index import KEY, VALUE, PriceIndex

OUTPUT = "book {book}, seq bigint, ord int, book_seq bigint, row_kind string, side string, price_raw bigint, size_raw bigint, live_venues string"
#: Output rows that are handed on at once.
OUTPUT_ROWS = 50_000
#: Cells that are read in a row in the time of one read by key, about.
POINT = 20
SIDES = ("BID", "ASK")
#: Columns of a level row in a packet.
PACKED = ["venue", "seq", "ord", "kind", "conn_epoch", "since", "pos", "side", "price_raw", "size_raw"]
#: Owner of the index of aggregate prices; a venue owns its own.
ALL = ""
#: Output columns with their pandas types: whole numbers stay exact beside missing ones, and texts are plain objects.
_COLUMNS = {"seq": "int64", "ord": "int64", "book_seq": "int64", "row_kind": object, "side": object, "price_raw": "Int64", "size_raw": "Int64", "live_venues": object}


class Cells:
    """Numbers in a MapState, 0 where there is none: each is read once and written once a batch."""

    def __init__(self, state, whole: bool):
        self.state, self.whole, self.before = state, whole, {}
        self.now = {tuple(k): v[0] for k, v in state.iterator()} if whole else {}

    def get(self, key: tuple) -> int:
        size = self.now.get(key)
        if size is None:
            if self.whole:
                return 0
            found = self.state.getValue(key)
            size = self.now[key] = found[0] if found else 0
        return size

    def put(self, key: tuple, value: int) -> None:
        if key not in self.before:
            self.before[key] = self.get(key)
        self.now[key] = value

    def store(self) -> None:
        for key, before in self.before.items():
            if not self.now[key]:
                if before:
                    self.state.removeKey(key)
            elif self.now[key] != before:
                self.state.updateValue(key, (self.now[key],))


class BookProcessor(StatefulProcessor):
    """Emits DIFF rows (new aggregate size, 0: removed), BBO rows when a best price or its size changed, and LIVE rows
    when the set of live venues changed and, with ``heartbeat_ms``, each time that so long has passed on the clock."""

    def __init__(self, heartbeat_ms: int | None = None, venue: str = "int", point: int = POINT):
        self.heartbeat_ms, self.venue, self.point = heartbeat_ms, venue, point

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", f"venue {self.venue}, side string, price bigint", "size bigint")
        self.total = handle.getMapState("total", "side string, price bigint", "size bigint")
        self.index = handle.getMapState("index", KEY, VALUE)
        self.venues = handle.getMapState("venues", f"venue {self.venue}", "live boolean, epoch bigint, since bigint")
        self.place = handle.getValueState("place", "n bigint, seq bigint, ord int, cells bigint, bid bigint, bid_size bigint, ask bigint, ask_size bigint")

    def _load(self, rows: int) -> None:
        n, seq, ord_, self.count, *best = self.place.get() if self.place.exists() else (0, None, None, 0, None, None, None, None)
        self.number, self.applied = n, None if seq is None else (seq, ord_)
        self.best = {"BID": tuple(best[:2]), "ASK": tuple(best[2:])}
        whole = rows * self.point >= self.count
        self.sizes, self.totals, nodes = Cells(self.held, whole), Cells(self.total, whole), Cells(self.index, whole)
        self.nodes, self.prices = nodes, PriceIndex(nodes)
        self.known = {k[0]: tuple(v) for k, v in self.venues.iterator()}
        self.was_known = dict(self.known)

    def _store(self) -> None:
        for cells in (self.sizes, self.totals, self.nodes):
            cells.store()
        for venue, state in self.known.items():
            if self.was_known.get(venue) != state:
                self.venues.updateValue((venue,), state)
        self.place.update((self.number, *(self.applied or (None, None)), self.count, *self.best["BID"], *self.best["ASK"]))

    def _put(self, venue, side: str, price: int, size: int) -> int | None:
        """What the venue holds at a price from now on; returns the new aggregate size if that changed."""
        before = self.sizes.get((venue, side, price))
        if size == before:
            return None
        self.sizes.put((venue, side, price), size)
        if not size or not before:
            (self.prices.add if size else self.prices.remove)(str(venue), side, price)
            self.count += 1 if size else -1
        old = self.totals.get((side, price))
        new = old + size - before
        self.totals.put((side, price), new)
        if not new or not old:
            (self.prices.add if new else self.prices.remove)(ALL, side, price)
        return new

    def _best(self, side: str, changed: list[int]) -> tuple[int | None, int | None]:
        price, _ = self.best[side]
        if price is None or not self.totals.get((side, price)):
            price = self.prices.best(ALL, side)
        else:
            here = [p for p in changed if self.totals.get((side, p))]
            price = max([price, *here]) if side == "BID" else min([price, *here])
        return (None, None) if price is None else (price, self.totals.get((side, price)))

    def _message(self, venue, kind: str, levels: list[tuple[str, int, int]]) -> dict[tuple[str, int], int]:
        """Apply one message; the aggregate prices that it changed."""
        wanted: dict[tuple[str, int], int] = {}
        if kind in (SNAPSHOT, INVALIDATE):
            wanted = {(side, price): 0 for side in SIDES for price in self.prices.prices(str(venue), side)}
        if kind != INVALIDATE:
            # A snapshot's first row of a price counts, a delta's last.
            wanted |= {(side, price): size for side, price, size in (reversed(levels) if kind == SNAPSHOT else levels)}
        changed = {place: self._put(venue, *place, size) for place, size in wanted.items()}
        return {place: size for place, size in changed.items() if size is not None}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["seq", "ord", "pos"], kind="stable", ignore_index=True)
        first = not self.place.exists()
        self._load(len(frame))
        yield from self._as_a_whole(key[0], frame) if self.nodes.whole else self._by_points(key[0], frame)
        self._store()
        if self.heartbeat_ms and first:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.heartbeat_ms)

    def _accept(self, place: tuple[int, int], venue, kind: str, epoch, since, bad: bool) -> tuple[str | None, bool]:
        """What a message counts as, None if it is void, and whether that changes who is live."""
        live, known_epoch, dropped = self.known.get(venue, (False, None, None))
        if self.applied is not None and place <= self.applied or known_epoch is not None and epoch <= known_epoch and place[0] > dropped:
            return None, False
        self.applied = place
        if kind == DROPPED:
            kind, known_epoch, dropped = INVALIDATE, int(epoch), int(since)
        if bad:
            kind = INVALIDATE
        self.known[venue] = (kind != INVALIDATE, known_epoch, dropped)
        return kind, live != self.known[venue][0]

    def _as_a_whole(self, book, frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """The same rows as ``_by_points``, from arrays of all cells; Python walks messages and best prices alone."""
        start = frame[["seq", "ord", "venue"]].ne(frame[["seq", "ord", "venue"]].shift()).any(axis=1)
        levels = frame.side.isin(SIDES)
        bad = (levels & ((frame.price_raw <= 0) | (frame.size_raw < 0))).groupby(start.cumsum()).any().tolist()
        kinds, resets, live = [], [], []
        heads = frame[start]
        places = list(zip(heads.seq.tolist(), heads.ord.tolist(), strict=True))
        for m, (place, venue, *message) in enumerate(zip(places, *[heads[c].tolist() for c in ("venue", "kind", "conn_epoch", "since")], bad, strict=True)):
            kind, told = self._accept(place, venue, *message)
            kinds.append(kind)
            if kind in (SNAPSHOT, INVALIDATE):
                resets.append((m, venue))
            if told:
                live.append((m, self._live()))
        number = (start.cumsum() - 1).to_numpy()
        kind = np.array(kinds, object)[number]
        rank = np.where(kind == SNAPSHOT, -np.arange(len(frame)), np.arange(len(frame)))  # a snapshot's first row of a price counts, a delta's last
        rows = frame.rename(columns={"price_raw": "price", "size_raw": "size"})[["venue", "side", "price", "size"]].assign(message=number, rank=rank)
        changes, cells, totals = whole_batch.apply(self.sizes.now, rows[levels.to_numpy() & ((kind == SNAPSHOT) | (kind == DELTA))], resets)
        # Revisions, and the best prices after each.
        changed, nth = np.unique(changes.message.to_numpy("int64"), return_inverse=True)
        ladders = {side: Side(-1 if side == "BID" else 1) for side in SIDES}
        for side, ladder in ladders.items():
            ladder.load([(k[1], v) for k, v in self.totals.now.items() if k[0] == side and v])
        tops, ends = [], np.append(np.flatnonzero(np.diff(nth)), len(nth) - 1).tolist()
        sides, prices, sizes, k = *[changes[c].tolist() for c in ("side", "price", "size")], 0
        for n, end in enumerate(ends if len(nth) else []):
            bid, ask, touched = self.best["BID"][0], self.best["ASK"][0], False
            while k <= end:
                ladders[sides[k]].put(prices[k], sizes[k])
                # What lies behind a best price leaves it as it is.
                touched = touched or (bid is None or prices[k] >= bid if sides[k] == "BID" else ask is None or prices[k] <= ask)
                k += 1
            if touched and (now := {side: ladder.best() for side, ladder in ladders.items()}) != self.best:
                tops += [(*places[changed[n]], self.number + n + 1, "BBO", side, *now[side], None) for side in SIDES]
                self.best = now
        seqs, ords = (np.array([p[i] for p in places], "int64") for i in (0, 1))
        beats = [(*places[m], self.number + int(np.searchsorted(changed, m)), "LIVE", None, None, None, text) for m, text in live]
        for begin in range(0, len(changes), OUTPUT_ROWS):
            part, here = changes.iloc[begin : begin + OUTPUT_ROWS], changed[nth[begin : begin + OUTPUT_ROWS]]
            made = {"seq": seqs[here], "ord": ords[here], "book_seq": self.number + 1 + nth[begin : begin + OUTPUT_ROWS], "row_kind": "DIFF", "side": part.side.to_numpy(object), "price_raw": part.price.to_numpy("int64"), "size_raw": part["size"].to_numpy("int64"), "live_venues": None}
            yield pd.DataFrame({"book": pd.Series([book] * len(part), dtype=object), **made}).astype(_COLUMNS)
        others = tops + beats
        for begin in range(0, max(len(others), 1), OUTPUT_ROWS):
            yield _frame(book, others[begin : begin + OUTPUT_ROWS])
        self.number += len(changed)
        for venue, side, price, before, after in cells.itertuples(index=False):
            self.sizes.put((venue, side, int(price)), int(after))
            self._indexed(str(venue), side, int(price), before, after)
            self.count += (after > 0) - (before > 0)
        for side, price, before, after in totals.itertuples(index=False):
            self.totals.put((side, int(price)), int(after))
            self._indexed(ALL, side, int(price), before, after)

    def _indexed(self, owner: str, side: str, price: int, before: int, after: int) -> None:
        if not before or not after:
            (self.prices.add if after else self.prices.remove)(owner, side, price)

    def _by_points(self, book, frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        columns = ["seq", "ord", "venue", "kind", "conn_epoch", "since", "side", "price_raw", "size_raw"]
        seqs, ords, venues, kinds, epochs, since, sides, prices, sizes = (frame[c].tolist() for c in columns)
        end = 0
        while end < len(seqs):
            start, place, venue = end, (seqs[end], ords[end]), venues[end]
            while end < len(seqs) and (seqs[end], ords[end], venues[end]) == (*place, venue):
                end += 1
            levels = [(sides[i], int(prices[i]), int(sizes[i])) for i in range(start, end) if isinstance(sides[i], str)]
            kind, told = self._accept(place, venue, kinds[start], epochs[start], since[start], any(price <= 0 or size < 0 for _, price, size in levels))
            if kind is None:
                continue
            changed = self._message(venue, kind, levels)
            if told:
                out.append((*place, self.number, "LIVE", None, None, None, self._live()))
            if changed:
                self.number += 1
                out += [(*place, self.number, "DIFF", *at, size, None) for at, size in sorted(changed.items())]
                now = {side: self._best(side, [p for s, p in changed if s == side]) for side in SIDES}
                if now != self.best:
                    out += [(*place, self.number, "BBO", side, *now[side], None) for side in SIDES]
                    self.best = now
            if len(out) >= OUTPUT_ROWS:
                yield _frame(book, out)
                out = []
        yield _frame(book, out)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """Begin with a book: its levels by venue (``books_at``), a row without a price for a live venue that holds nothing."""
        if not self.place.exists():  # else a further part of the same book
            seq, number = initialState.seq.iloc[0], initialState.book_seq.iloc[0]
            self.place.update((int(number), int(seq), int(initialState.ord.iloc[0]), 0, None, None, None, None))
            if self.heartbeat_ms:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.heartbeat_ms)
        self._load(len(initialState))
        for venue, side, price, size in zip(*[initialState[c].tolist() for c in ("venue", "side", "price_raw", "size_raw")], strict=True):
            self.known[venue] = (True, None, None)
            if isinstance(side, str):
                self._put(venue, side, int(price), int(size))
        self.best = {side: (None, None) for side in SIDES}
        self.best = {side: self._best(side, []) for side in SIDES}
        self._store()

    def _live(self) -> str:
        return ",".join(map(str, sorted(v for v, state in self.known.items() if state[0])))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """A heartbeat: who is live, and the next one."""
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.heartbeat_ms)
        number, seq, ord_ = self.place.get()[:3]
        self.known = {k[0]: tuple(v) for k, v in self.venues.iterator()}
        yield _frame(key[0], [(seq, ord_, number, "LIVE", None, None, None, self._live())])

    def close(self) -> None:
        pass


class PackedBookProcessor(BookProcessor):
    """The same of rows in packets."""

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        return super().handleInputRows(key, iter([packets.opened(rows).to_pandas()]), timerValues)


def _frame(book, rows: list[tuple]) -> pd.DataFrame:
    columns = zip(*rows, strict=True) if rows else [()] * len(_COLUMNS)
    made = {c: pd.Series(x, dtype=kind) for (c, kind), x in zip(_COLUMNS.items(), columns, strict=True)}
    return pd.DataFrame({"book": pd.Series([book] * len(rows), dtype=object), **made})


def live_book(levels: DataFrame, heartbeat_ms: int | None = None, initial: DataFrame | None = None, point: int = POINT) -> DataFrame:
    """DIFF, BBO and LIVE rows of a stream of level rows.

    ``initial``: the books to begin with, as from ``books_at``; a book that isn't in it begins empty. Its rows' messages
    are those at or before the revisions given there, and come late where the stream holds them too.
    """
    # No nulls: pandas would turn the columns that have any into floats, which don't hold all 64-bit numbers.
    filled = {c: F.coalesce(c, F.lit(-1)) if c in levels.columns else F.lit(-1).cast("bigint") for c in ("conn_epoch", "since")}
    filled |= {c: F.coalesce(c, F.lit(0)) for c in ("price_raw", "size_raw")} | {"ord": F.col("ord") if "ord" in levels.columns else F.lit(0)}
    rows = levels.withColumns(filled).select("book", *PACKED)
    return packed_book(packets.packed(rows, ["book"]), levels.schema["venue"].dataType.simpleString(), heartbeat_ms, initial, point)


def packed_book(rows: DataFrame, venue: str, heartbeat_ms: int | None = None, initial: DataFrame | None = None, point: int = POINT) -> DataFrame:
    """``live_book`` of level rows in packets by book, of the columns ``PACKED`` without nulls in numbers; ``venue``: that column's type."""
    book = rows.schema["book"].dataType.simpleString()
    clock = "processingTime" if heartbeat_ms else "none"
    begun = None
    if initial is not None:
        numbers = {c: F.coalesce(c, F.lit(0)) for c in ("price_raw", "size_raw")}
        begun = initial.withColumns(numbers).select("book", "seq", "ord", "book_seq", "venue", "side", "price_raw", "size_raw").groupBy("book")
    return rows.groupBy("book").transformWithStateInPandas(PackedBookProcessor(heartbeat_ms, venue, point), OUTPUT.format(book=book), "append", clock, initialState=begun)


def silent_sessions(messages: DataFrame, watermark: str = "1 minute", timeout: str = "timeout") -> DataFrame:
    """Spells in which a venue kept talking: a session ends when it was silent for its timeout (a column, in seconds)."""
    gap = F.concat(F.col(timeout).cast("string"), F.lit(" seconds"))
    return messages.withWatermark("ts", watermark).groupBy("venue", F.session_window("ts", gap).alias("session")).agg(F.count(F.lit(1)).alias("messages"))
