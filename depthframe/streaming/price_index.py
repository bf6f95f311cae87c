"""An ordered set of prices that lives in a key-value store and is read point by point.

Prices are cut into digits of six bits. A node is a 64-bit map of the digits that go on below it; its key is (owner, side,
level, price without its last level + 1 digits). Adding or removing a price touches one node, and the ones above only where a
node begins or ceases to be empty. The smallest or largest price is found by one read a level, whatever the number of prices.
"""

from __future__ import annotations

from collections.abc import Iterator

BITS, LEVELS = 6, 11  # 66 bits: any positive 64-bit price
KEY, VALUE = "owner string, side string, level int, node bigint", "bits bigint"


def _unsigned(bits: int) -> int:
    return bits & ((1 << 64) - 1)


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


class PriceIndex:
    """cells has get(key), 0 where there is nothing, and put(key, bits)."""

    def __init__(self, cells):
        self.cells = cells

    def add(self, owner: str, side: str, price: int) -> None:
        for level in range(LEVELS):
            key = (owner, side, level, price >> BITS * (level + 1))
            bits = _unsigned(self.cells.get(key))
            self.cells.put(key, _signed(bits | 1 << (price >> BITS * level & 63)))
            if bits:
                return

    def remove(self, owner: str, side: str, price: int) -> None:
        for level in range(LEVELS):
            key = (owner, side, level, price >> BITS * (level + 1))
            bits = _unsigned(self.cells.get(key)) & ~(1 << (price >> BITS * level & 63))
            self.cells.put(key, _signed(bits))
            if bits:
                return

    def best(self, owner: str, side: str) -> int | None:
        """The largest bid or the smallest ask."""
        node = 0
        for level in range(LEVELS - 1, -1, -1):
            bits = _unsigned(self.cells.get((owner, side, level, node)))
            if not bits:
                return None
            node = node << BITS | (bits.bit_length() - 1 if side == "BID" else (bits & -bits).bit_length() - 1)
        return node

    def prices(self, owner: str, side: str, level: int = LEVELS - 1, node: int = 0) -> Iterator[int]:
        bits = _unsigned(self.cells.get((owner, side, level, node)))
        while bits:
            digit = (bits & -bits).bit_length() - 1
            bits &= bits - 1
            below = node << BITS | digit
            if level:
                yield from self.prices(owner, side, level - 1, below)
            else:
                yield below
