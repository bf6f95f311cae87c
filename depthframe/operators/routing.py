"""Which book a message belongs to, and which venues or books a configuration lacks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depthframe.functions.symbols import MARKETS

#: Subscriptions up to so many rows are sent to every task; more are joined by key.
BROADCAST_ROWS = 100_000


def route_symbols(messages: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """messages with base, quote, market of their book; those that no subscription names are dropped."""
    books = subscriptions.select("venue", "native_symbol", "base", "quote", "market")
    small = books.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return messages.join(F.broadcast(books) if small else books, ["venue", "native_symbol"])


def venues_missing(subscriptions: DataFrame, wired: DataFrame) -> DataFrame:
    """Venues that are subscribed to but not wired."""
    return subscriptions.select("venue").distinct().join(wired.select("venue"), "venue", "left_anti")


def list_books(rows: DataFrame) -> DataFrame:
    return rows.select("base", "quote", "market").distinct().orderBy("base", "quote", "market")


def select_book(rows: DataFrame, base: str, quote: str, market: str) -> DataFrame:
    """The rows of one book. ValueError: not a book id; KeyError: no such book."""
    if not base or not quote or market not in MARKETS:
        raise ValueError(f"not a book: {base!r}, {quote!r}, {market!r}")
    found = rows.where((F.col("base") == base) & (F.col("quote") == quote) & (F.col("market") == market))
    if not found.head(1):
        raise KeyError(f"{base}_{quote}.{market}")
    return found
