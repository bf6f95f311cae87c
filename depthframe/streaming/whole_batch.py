"""What a micro-batch does to a book whose state is at hand, by arrays: the sizes of all cells and prices, message by message.

A cell is a venue's price. A write holds until the cell's next one or its venue's next reset, whichever comes first, as in
``operators.book.level_intervals``; what the writes move a price's total by is summed along the messages.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

CELL = ["venue", "side", "price"]


def _last_of_run(*columns: np.ndarray) -> np.ndarray:
    """Whether a row is the last of its run of equal values."""
    last = np.ones(len(columns[0]), bool)
    last[:-1] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return last


def _first_of_run(*columns: np.ndarray) -> np.ndarray:
    return np.concatenate([[True], _last_of_run(*columns)[:-1]]) if len(columns[0]) else np.ones(0, bool)


def apply(held: dict[tuple, int], writes: pd.DataFrame, resets: list[tuple[int, object]]) -> tuple[pd.DataFrame, pd.DataFrame, pd.DataFrame]:
    """(changes, cells, totals) of messages 0, 1, ...

    held: (venue, side, price) -> size. writes: message, rank, CELL, size; of a message's writes of a price that with the largest rank
    counts. resets: (message, venue) in order. changes: message, side, price, size (new total), in order of the first three; cells and
    totals: those that changed, with size before and after.
    """
    begun = pd.DataFrame([(-1, 0, *cell, size) for cell, size in held.items() if size], columns=["message", "rank", *CELL, "size"])
    rows = pd.concat([begun, writes], ignore_index=True) if len(begun) else writes.reset_index(drop=True)
    if not len(rows):
        return pd.DataFrame(columns=["message", "side", "price", "size"]), pd.DataFrame(columns=[*CELL, "before", "after"]), pd.DataFrame(columns=["side", "price", "before", "after"])
    message, size = rows.message.to_numpy("int64"), rows["size"].to_numpy("int64")
    venue, venues = pd.factorize(rows.venue)
    prices, bid = rows.price.to_numpy("int64"), (rows.side == "BID").to_numpy()
    place = pd.factorize(prices)[0] * 2 + bid
    cell = place * len(venues) + venue
    order = np.lexsort((rows["rank"].to_numpy("int64"), message, cell))
    order = order[_last_of_run(cell[order], message[order])]
    # The venue's next reset, if it comes before the cell's next write, ends a size.
    end = message.max(initial=-1) + max((m for m, _ in resets), default=-1) + 3
    following = np.full(len(order), end)
    same = ~_last_of_run(cell[order])
    following[same] = message[order][1:][same[:-1]]
    codes = {v: k for k, v in enumerate(venues)}
    marks = np.sort(np.array([codes[v] * (end + 1) + m for m, v in resets if v in codes] + [len(venues) * (end + 1)], "int64"))
    reset = marks[np.searchsorted(marks, venue[order] * (end + 1) + message[order], "right")] - venue[order] * (end + 1)
    ended = (reset < following) & (size[order] > 0)
    at, when, now = np.concatenate([order, order[ended]]), np.concatenate([message[order], reset[ended]]), np.concatenate([size[order], np.zeros(ended.sum(), "int64")])
    by = np.lexsort((when, cell[at]))
    at, when, now = at[by], when[by], now[by]
    first, last = _first_of_run(cell[at]), _last_of_run(cell[at])
    delta = now.copy()
    delta[1:][~first[1:]] -= now[:-1][~first[1:]]
    # Of each cell and of each price: what it held before and holds after.
    starts = np.where(when[first] < 0, now[first], 0)
    cells = rows.loc[at[first], CELL].assign(before=starts, after=now[last])
    moved = (when >= 0) & (delta != 0)
    begin = np.zeros(place.max() + 1, "int64")
    np.add.at(begin, place[at[first]], starts)
    at, when, delta = at[moved], when[moved], delta[moved]
    by = np.lexsort((when, place[at]))
    at, when, delta = at[by], when[by], delta[by]
    first, last = _first_of_run(place[at]), _last_of_run(place[at])
    sums = np.cumsum(delta)
    base = (sums - delta)[first]
    new = sums - np.repeat(base, np.diff(np.append(np.flatnonzero(first), len(at)))) + begin[place[at]]
    totals = rows.loc[at[first], ["side", "price"]].assign(before=begin[place[at[first]]], after=new[last])
    by = np.lexsort((prices[at], bid[at], when))
    changes = rows.loc[at[by], ["side", "price"]].assign(message=when[by], size=new[by])
    return changes, cells[cells.before != cells.after], totals[totals.before != totals.after]
