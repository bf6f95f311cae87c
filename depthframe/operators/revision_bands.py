"""Depth bands after every revision of a book, by block replay.

The blocks are those of ``bbo.replay_blocks``: each holds the book before it, so a long history spreads over many tasks and
a task holds one block and one book. A side's prices within a block are known beforehand, so its levels stand in prefix-sum
trees over them: a change, a band's sums and the level that fills a notional each take a few steps for every doubling of
the depth. Where a side's numbers are small enough for 64 bits, and its depth for a matrix of all its states, all its revisions are
computed at once by arrays, with the same rows. A side's bands are computed anew only when the side changed; the arithmetic is that of ``bands`` on plain
integers, so the rows equal ``bands.price_bands`` and ``bands.volume_bands`` of each revision's book.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from depthframe.types import INT64_MAX, INT128_MAX, OUT_OF_DOMAIN, OUT_OF_RANGE, SIZE_SCALE

from .bands import DEFAULT_BPS, DEFAULT_NOTIONALS, OK, SIDES, check_bps, check_thresholds
from .bbo import REVISIONS_PER_BLOCK, replay_blocks

#: What is summed over a side's levels: how many there are, their sizes and notionals, and those with a bad price or size or a
#: notional out of range.
COUNT, SIZE, NOTIONAL, BAD, LOST = range(5)
#: Most revisions x prices of a side of a block that is taken as a matrix.
CELLS = 4_000_000


class Ladder:
    """One side of a book, best price first, as prefix-sum trees over all prices that it will hold."""

    def __init__(self, side: str, prices: Iterable[int]):
        self.sign = 1 if side == "ASK" else -1
        self.keys = sorted({self.sign * p for p in prices})
        self.at = {key: i for i, key in enumerate(self.keys)}
        self.held: list[tuple[int, ...]] = [(0,) * 5] * len(self.keys)
        self.trees = [[0] * (len(self.keys) + 1) for _ in range(5)]
        self.totals = [0] * 5
        self.top = 1 << max(0, len(self.keys).bit_length() - 1)

    def price(self, i: int) -> int:
        return self.sign * self.keys[i]

    def put(self, price: int, size: int) -> None:
        i, new = self.at[self.sign * price], (0,) * 5
        if size:
            n = _notional(price, size)
            new = (1, size, n or 0, int(price <= 0 or size < 0), int(n is None))
        for k, (tree, old, value) in enumerate(zip(self.trees, self.held[i], new, strict=True)):
            if value == old:
                continue
            self.totals[k] += value - old
            j = i + 1
            while j < len(tree):
                tree[j] += value - old
                j += j & -j
        self.held[i] = new

    def first(self, what: int, i: int) -> int:
        """The sum over the first i prices."""
        tree, out = self.trees[what], 0
        while i:
            out += tree[i]
            i &= i - 1
        return out

    def reach(self, what: int, target: int) -> int:
        """The place of the first price with which the sum, of numbers that aren't negative, is target or more."""
        tree, at, step = self.trees[what], 0, self.top
        while step:
            if at + step < len(tree) and tree[at + step] < target:
                at += step
                target -= tree[at]
            step >>= 1
        return at

    def within(self, reference: int, bps: int) -> int:
        """How many prices are at most so many basis points worse than reference."""
        if self.sign > 0:
            return bisect_right(self.keys, reference * (10000 + bps) // 10000)
        return bisect_right(self.keys, -reference * (10000 - bps) // 10000)


def _narrow(n: int | None) -> int | None:
    return n if n is not None and abs(n) <= INT64_MAX else None


def _half_away(n: int, d: int) -> int:
    """n / d to the nearest integer, halves away from zero, for d > 0."""
    q, r = divmod(abs(n), d)
    q += 2 * r >= d
    return q if n >= 0 else -q


def _notional(price: int, size: int) -> int | None:
    return _narrow(_half_away(price * size, SIZE_SCALE))


def price_rows(side: str, ladder: Ladder, bps: list[int]) -> list[tuple]:
    """(ord, bps, boundary_raw, cum_size_raw, cum_notional_raw, status) of each band of a side that has levels."""
    if not ladder.totals[COUNT]:
        return []
    reference = ladder.price(ladder.reach(COUNT, 1))
    rows = []
    for i, b in enumerate(bps):
        inside = ladder.within(reference, b)
        edge = reference * (10000 + b) // 10000 if side == "ASK" else -(-reference * (10000 - b) // 10000)
        rows.append((i, b, _narrow(edge), _narrow(ladder.first(SIZE, inside)), _narrow(ladder.first(NOTIONAL, inside))))
    # What counts besides is whether the levels within the widest band, and the first one beyond, are good.
    widest = ladder.within(reference, bps[-1]) if bps else 0
    bad, there = reference <= 0 or ladder.first(BAD, widest) > 0, ladder.first(COUNT, widest)
    if not bad and there < ladder.totals[COUNT]:
        bad = bool(ladder.held[ladder.reach(COUNT, there + 1)][BAD])
    lost = ladder.first(LOST, widest) > 0
    status = OUT_OF_DOMAIN if bad else OUT_OF_RANGE if lost or any(x is None for r in rows for x in r) else OK
    return [(*r, OK) if status == OK else (*r[:2], None, None, None, status) for r in rows]


def _price_of(notional: int, size: int) -> int | None:
    return _narrow(_half_away(notional * SIZE_SCALE, size)) if size > 0 else None


def _price_within(cum_notional: int, cum_size: int, rest: int, price: int) -> int | None:
    """Average price after ``rest`` more notional at ``price``."""
    whole, divisor = (cum_notional + rest) * price, cum_size * price + rest * SIZE_SCALE
    if whole > INT128_MAX // SIZE_SCALE or max(divisor, whole % divisor * SIZE_SCALE) >= 10**38:
        return None  # beyond what bands computes with
    return _narrow(_half_away(whole * SIZE_SCALE, divisor))


def volume_rows(ladder: Ladder, thresholds: list[int]) -> list[tuple]:
    """(ord, threshold_raw, vwap_raw, filled_raw, status) of each notional of a side; a side without levels fills nothing."""
    total = ladder.totals[NOTIONAL]
    status = OUT_OF_DOMAIN if ladder.totals[BAD] else OUT_OF_RANGE if ladder.totals[LOST] or _narrow(total) is None else OK
    prices: list[int | None] = []
    for t in thresholds if status == OK else []:
        if t > total:
            break
        i = ladder.reach(NOTIONAL, t)
        before, size_before, (_, size, n, _, _) = ladder.first(NOTIONAL, i), ladder.first(SIZE, i), ladder.held[i]
        prices.append(_price_of(t, size_before + size) if t - before == n else _price_within(before, size_before, t - before, ladder.price(i)))
    if None in prices:
        status = OUT_OF_RANGE
    if status != OK:
        return [(i, t, None, None, status) for i, t in enumerate(thresholds)]
    return [(i, t, prices[i], t, OK) if i < len(prices) else (i, t, None, total, OK) for i, t in enumerate(thresholds)]


class Dense:
    """One side of a book over a block as a matrix, a row for each of its revisions (row 0: before the block), a column for each price,
    best first. Only for numbers whose sums and products all stay in 64 bits (``fits``); ``Ladder`` takes any."""

    def __init__(self, side: str, numbers: np.ndarray, prices: np.ndarray, sizes: np.ndarray):
        self.side, self.sign = side, 1 if side == "ASK" else -1
        self.keys = np.unique(self.sign * prices)
        self.revisions = np.unique(numbers[numbers > 0])
        given = np.full((len(self.revisions) + 1, len(self.keys)), -1, "int64")
        given[0] = 0
        given[np.searchsorted(self.revisions, numbers, "right"), np.searchsorted(self.keys, self.sign * prices)] = sizes
        since = np.maximum.accumulate(np.where(given >= 0, np.arange(len(given))[:, None], 0), axis=0)
        self.sizes = np.take_along_axis(given, since, axis=0)
        self.notionals = (self.sizes * (self.sign * self.keys) + SIZE_SCALE // 2) // SIZE_SCALE
        before = lambda x: np.concatenate([np.zeros((len(x), 1), "int64"), np.cumsum(x, axis=1)], axis=1)
        self.size_before, self.notional_before = before(self.sizes), before(self.notionals)
        self.held = (self.sizes > 0).any(axis=1)

    @staticmethod
    def fits(numbers: np.ndarray, prices: np.ndarray, sizes: np.ndarray, bps: int) -> bool:
        if not len(prices):
            return True
        price, size, depth = int(prices.max()), int(sizes.max()), len(np.unique(prices))
        small = max(price * size + SIZE_SCALE, (price * size // SIZE_SCALE + 1) * depth, size * depth, price * (10000 + bps)) < 1 << 62
        return bool(small and prices.min() > 0 and sizes.min() >= 0 and depth * (len(np.unique(numbers)) + 1) <= CELLS)


def price_columns(dense: Dense, bps: list[int]) -> list[np.ndarray]:
    """What ``price_rows`` gives for each row of dense that holds levels: matrices of a column for each band."""
    reference = dense.keys[np.argmax(dense.sizes > 0, axis=1)][:, None] if len(dense.keys) else np.zeros((1, 1), "int64")
    edge = reference * (10000 + dense.sign * np.array(bps, "int64")) // 10000  # of keys, which are negative for bids: rounds up there
    inside = np.searchsorted(dense.keys, edge, "right")
    return [dense.sign * edge, np.take_along_axis(dense.size_before, inside, axis=1), np.take_along_axis(dense.notional_before, inside, axis=1)]


def volume_columns(dense: Dense, thresholds: list[int]) -> list[np.ndarray] | None:
    """What ``volume_rows`` gives for each row of dense, None if a price leaves 64 bits; an average price of -1 is none."""
    total = dense.notional_before[:, -1]
    price, filled = (np.full((len(total), len(thresholds)), -1, "int64") for _ in range(2))
    for k, t in enumerate(thresholds):
        reached = np.flatnonzero(total >= t)
        at = (dense.notional_before[reached, 1:] < t).sum(axis=1)
        parts = [x[reached, at].tolist() for x in (dense.notional_before, dense.size_before, dense.notionals, dense.sizes)]
        made = [_price_of(t, b + size) if t - before == n else _price_within(before, b, t - before, p) for before, b, n, size, p in zip(*parts, (dense.sign * dense.keys[at]).tolist(), strict=True)] if len(reached) else []
        if None in made:
            return None
        price[reached, k] = made
        filled[:, k] = np.minimum(total, t)
    return [price, filled]


def _replayed(diffs: DataFrame, side_rows: Callable[[str, Ladder], list[tuple]], side_columns: Callable[[Dense], list[np.ndarray] | None], bands: list[int], both: bool, fields: str, revisions_per_block: int) -> DataFrame:
    """book, book_seq, side and what side_rows gives, for each side at each revision; ``both``: also an empty side beside one
    that isn't. side_columns gives the same of a side of ordinary numbers at all its revisions."""
    types = [pa.int32(), pa.int64(), pa.string(), *[{"int": pa.int32(), "long": pa.int64(), "string": pa.string()}[f.split()[1]] for f in fields.split(", ")]]
    names = ["book", "book_seq", "side", *[f.split()[0] for f in fields.split(", ")]]
    widest = 0 if both else max(bands, default=0)

    def at_once(block: pa.Table) -> pa.Table | None:
        numbers, prices, sizes = (block[c].to_numpy() for c in ("book_seq", "price_raw", "size_raw"))
        own = {s: block["side"].to_numpy() == s for s in SIDES}
        if not all(Dense.fits(numbers[o], prices[o], sizes[o], widest) for o in own.values()) or any(not 0 < b < 1 << 62 for b in bands if both):
            return None
        sides = {s: Dense(s, numbers[o], prices[o], sizes[o]) for s, o in own.items()}
        revisions = np.unique(numbers[numbers > 0])
        place = {s: np.searchsorted(d.revisions, revisions, "right") for s, d in sides.items()}
        alive = {s: d.held[place[s]] for s, d in sides.items()}
        parts = []
        for s, dense in sides.items():
            found = side_columns(dense)
            if found is None:
                return None
            shown = np.logical_or.reduce(list(alive.values())) if both else alive[s]
            n = int(shown.sum())
            values = [x[place[s][shown]].ravel() for x in found]
            repeated = lambda value, kind, n=n: pa.repeat(pa.scalar(value, kind), n * len(bands))
            columns = [repeated(block["book"][0].as_py(), types[0]), np.repeat(revisions[shown], len(bands)), repeated(s, types[2]), np.tile(np.arange(len(bands)), n), np.tile(np.array(bands, "int64"), n)]
            columns += [pa.array(values[0], mask=values[0] < 0), *values[1:], repeated(OK, types[-1])]
            parts.append(pa.Table.from_arrays([c.cast(t) if isinstance(c, pa.Array) else pa.array(c, pa.int64()).cast(t) for c, t in zip(columns, types, strict=True)], names=names))
        return pa.concat_tables(parts)

    def run(block: pa.Table) -> pa.Table:
        return found if (found := at_once(block)) is not None else one_by_one(block)

    def one_by_one(block: pa.Table) -> pa.Table:
        block = block.sort_by("book_seq")
        numbers, sides, prices, sizes = (block[c].to_pylist() for c in ("book_seq", "side", "price_raw", "size_raw"))
        ladders = {s: Ladder(s, (p for p, own in zip(prices, sides, strict=True) if own == s)) for s in SIDES}
        out: list[tuple] = []
        known = {s: side_rows(s, ladders[s]) for s in SIDES}
        stale = set(SIDES)
        for k, number in enumerate(numbers):
            ladders[sides[k]].put(prices[k], sizes[k])
            stale.add(sides[k])
            if number == 0 or (k + 1 < len(numbers) and numbers[k + 1] == number):
                continue  # the book before the block, or more of this revision
            for s in stale:
                known[s] = side_rows(s, ladders[s])
            stale = set()
            if both and not any(x.totals[COUNT] for x in ladders.values()):
                continue
            out += [(number, s, *r) for s in SIDES for r in known[s]]
        columns = list(zip(*out, strict=True)) or [[]] * (len(names) - 1)
        book = block["book"][0].as_py()
        return pa.Table.from_arrays([pa.array([book] * len(out), types[0]), *[pa.array(c, t) for c, t in zip(columns, types[1:], strict=True)]], names=names)

    return replay_blocks(diffs, revisions_per_block).groupBy("book", "block").applyInArrow(run, f"book int, book_seq long, side string, {fields}")


def price_bands_by_revision(diffs: DataFrame, bps: list[int] = DEFAULT_BPS, revisions_per_block: int = REVISIONS_PER_BLOCK) -> DataFrame:
    """Depth within each band of a side's own best price after every revision. A side without levels has no rows."""
    check_bps(bps)
    wanted = list(bps)
    return _replayed(diffs, lambda s, ladder: price_rows(s, ladder, wanted), lambda dense: price_columns(dense, wanted), wanted, False, "ord int, bps int, boundary_raw long, cum_size_raw long, cum_notional_raw long, status string", revisions_per_block)


def volume_bands_by_revision(diffs: DataFrame, thresholds: list[int] = DEFAULT_NOTIONALS, revisions_per_block: int = REVISIONS_PER_BLOCK) -> DataFrame:
    """Average price that fills each notional after every revision; both sides of every book that isn't empty."""
    check_thresholds(thresholds)
    wanted = list(thresholds)
    return _replayed(diffs, lambda s, ladder: volume_rows(ladder, wanted), lambda dense: volume_columns(dense, wanted), wanted, True, "ord int, threshold_raw long, vwap_raw long, filled_raw long, status string", revisions_per_block)
