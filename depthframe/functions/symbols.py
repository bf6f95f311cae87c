"""Names of assets, books and venues as column expressions. Unknown names are NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The exchanges, the markets, and each venue's name (they must be spelt so).
EXCHANGES = ("BINANCE", "BYBIT", "OKX")
MARKETS = ("SPOT", "PERP")
VENUES = {
    ("BINANCE", "SPOT"): "binance_spot",
    ("BINANCE", "PERP"): "binance_futures",
    ("BYBIT", "SPOT"): "bybit_spot",
    ("BYBIT", "PERP"): "bybit_linear",
    ("OKX", "SPOT"): "okx_spot",
    ("OKX", "PERP"): "okx_swap",
}


def split_base_quote(symbol: Column) -> Column:
    """struct<base, quote> of BASE_QUOTE; NULL unless exactly one underscore parts two non-empty names."""
    parts = F.split(symbol, "_")
    return F.when(symbol.rlike(r"^[^_]+_[^_]+\z"), F.struct(parts[0].alias("base"), parts[1].alias("quote")))


def book_to_string(base: Column, quote: Column, market: Column) -> Column:
    return F.concat(base, F.lit("_"), quote, F.lit("."), market)


def parse_book_id(text: Column) -> Column:
    """struct<base, quote, market> of BASE_QUOTE.SPOT or .PERP."""
    pattern = r"^([^_]+)_([^_]+)\.(SPOT|PERP)\z"
    part = lambda k: F.regexp_extract(text, pattern, k)
    return F.when(text.rlike(pattern), F.struct(part(1).alias("base"), part(2).alias("quote"), part(3).alias("market")))


def parse_exchange(text: Column) -> Column:
    return F.when(text.isin(*EXCHANGES), text)


def parse_market(text: Column) -> Column:
    return F.when(text.isin(*MARKETS), text)


def venue_to_string(exchange: Column, market: Column) -> Column:
    out = F.lit(None).cast("string")
    for (e, m), name in VENUES.items():
        out = F.when((exchange == e) & (market == m), name).otherwise(out)
    return out


def native_symbol(exchange: Column, base: Column, quote: Column, market: Column) -> Column:
    """The venue's own ticker of a pair."""
    okx = F.concat(base, F.lit("-"), quote, F.when(market == "PERP", "-SWAP").otherwise(""))
    return F.when(exchange == "OKX", okx).when(exchange.isin("BINANCE", "BYBIT"), F.concat(base, quote))
