"""Venue texts to one table of level-2 messages, by column expressions only.

Each venue has a JSON schema and a rule; ``VENUES`` holds them, and a new venue is one more entry. A text is SNAPSHOT
or DELTA, IGNORED (something else that the venue says), or MALFORMED (not JSON, a field missing, or a level that
isn't a pair of decimal texts). Prices must be JSON strings: a number would have lost its exact digits.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depthframe.functions.fixed import fixed_from_string
from depthframe.types import DELTA, IGNORED, MALFORMED, PRICE_DECIMALS, SIZE_DECIMALS, SNAPSHOT

ID = "DECIMAL(20,0)"
PAIRS = "ARRAY<ARRAY<STRING>>"
#: A level whose price or size is a number rather than a text.
BARE = r'\[\s*(-?[0-9]|"[^"]*"\s*,\s*-?[0-9])'


@dataclass(frozen=True)
class Message:
    """What a venue's text says: columns over the parsed JSON ``j``; ``kind`` is NULL for what is to be ignored."""

    kind: Column
    symbol: Column
    bids: Column
    asks: Column
    first_id: Column
    final_id: Column
    prev_final_id: Column
    last_update_id: Column
    #: Fields that must be there.
    needed: tuple[Column, ...]
    #: Paths of the level arrays in the text.
    paths: tuple[str, ...]


def _zero() -> Column:
    return F.lit(0).cast(ID)


def _binance(futures: bool) -> Callable[[Column, Column], Message]:
    """Its ids differ by case alone (U and u), so the text is read as a map, whose keys keep theirs."""

    def read(j: Column, raw: Column) -> Message:
        get = lambda k: F.try_element_at(j, F.lit(k))
        number = lambda k: get(k).try_cast(ID)
        pairs = lambda k: F.from_json(get(k), PAIRS)
        rest = raw == "REST"
        kind = F.when(rest, SNAPSHOT).when(get("e") == "depthUpdate", DELTA)
        first, final, before, last = (number(k) for k in ("U", "u", "pu", "lastUpdateId"))
        live = [c.isNotNull() for c in (get("s"), first, final, *([before] if futures else []))]
        needed = [~rest | last.isNotNull(), *[rest | c for c in live]]
        bids, asks = (F.when(rest, pairs(a)).otherwise(pairs(b)) for a, b in (("bids", "b"), ("asks", "a")))
        prev = F.when(~rest, before if futures else _zero())
        return Message(kind, F.when(rest, F.col("request_symbol")).otherwise(get("s")), bids, asks, F.when(~rest, first), F.when(~rest, final), prev, F.when(rest, last), tuple(needed), ("$.b", "$.a", "$.bids", "$.asks"))

    return read


def _bybit(j: Column, raw: Column) -> Message:
    kind = F.when(j["topic"].isNull(), None).when(j["type"] == "snapshot", SNAPSHOT).when(j["type"] == "delta", DELTA)
    d = j["data"]
    snapshot = kind == SNAPSHOT
    return Message(kind, d["s"], d["b"], d["a"], F.when(~snapshot, d["u"]), F.when(~snapshot, d["u"]), F.when(~snapshot, _zero()), F.when(snapshot, d["u"]), (d["s"].isNotNull(), d["u"].isNotNull()), ("$.data.b", "$.data.a"))


def _okx(j: Column, raw: Column) -> Message:
    kind = F.when(j["action"] == "snapshot", SNAPSHOT).when(j["action"] == "update", DELTA)
    d = F.get(j["data"], F.lit(0))
    snapshot = kind == SNAPSHOT
    unsigned = lambda c: F.when(c < 0, c + F.lit("18446744073709551616").cast(ID)).otherwise(c).cast(ID)
    seq, prev = unsigned(d["seqId"]), unsigned(d["prevSeqId"])
    needed = (j["arg"]["instId"].isNotNull(), d["seqId"].isNotNull(), snapshot | d["prevSeqId"].isNotNull())
    return Message(kind, j["arg"]["instId"], d["bids"], d["asks"], F.when(~snapshot, seq), F.when(~snapshot, seq), F.when(~snapshot, prev), F.when(snapshot, seq), needed, ("$.data[0].bids", "$.data[0].asks"))


_BINANCE = "MAP<STRING, STRING>"
_BYBIT = f"topic STRING, type STRING, data STRUCT<s STRING, b {PAIRS}, a {PAIRS}, u {ID}>"
_OKX = f"arg STRUCT<instId STRING>, action STRING, data ARRAY<STRUCT<bids {PAIRS}, asks {PAIRS}, seqId {ID}, prevSeqId {ID}>>"

#: venue -> (JSON schema, rule, sequence policy)
VENUES: dict[str, tuple[str, Callable[[Column, Column], Message], str]] = {
    "binance_futures": (_BINANCE, _binance(True), "futures"),
    "binance_spot": (_BINANCE, _binance(False), "spot"),
    "bybit_linear": (_BYBIT, _bybit, "bybit"),
    "bybit_spot": (_BYBIT, _bybit, "bybit"),
    "okx_spot": (_OKX, _okx, "okx"),
    "okx_swap": (_OKX, _okx, "okx"),
}


def parse_levels(pairs: Column) -> Column:
    """Scaled (price_raw, size_raw) of arrays of texts; more than two entries are allowed."""
    return F.transform(pairs, lambda x: F.struct(fixed_from_string(F.get(x, F.lit(0)), PRICE_DECIMALS).alias("price_raw"), fixed_from_string(F.get(x, F.lit(1)), SIZE_DECIMALS).alias("size_raw")))


FIELDS = ("first_id", "final_id", "prev_final_id", "last_update_id")


def _reading(schema: str, rule: Callable[[Column, Column], Message], parsed: Column) -> Column:
    """What one venue's rule makes of a parsed text, its levels still as texts."""
    m, text = rule(parsed, F.coalesce("source", F.lit("WS"))), F.col("text")
    broken = parsed.isNull() if schema.startswith("MAP") else parsed.isNull() | parsed["_bad"].isNotNull()
    complete = F.lit(True)
    for c in m.needed:
        complete = complete & c
    # Few texts hold a bare number in any array; only in those are the level arrays looked up again.
    arrays = F.concat(*[F.coalesce(F.get_json_object(text, p), F.lit("")) for p in m.paths])
    bare = F.when(text.rlike(BARE), arrays.rlike(BARE)).otherwise(F.lit(False))
    ids = [c.cast(ID).alias(n) for n, c in zip(FIELDS, (m.first_id, m.final_id, m.prev_final_id, m.last_update_id), strict=True)]
    return F.struct(m.kind.alias("kind"), broken.alias("broken"), F.coalesce(complete, F.lit(False)).alias("complete"), bare.alias("bare"), m.symbol.alias("native_symbol"), *ids, m.bids.cast(PAIRS).alias("bids"), m.asks.cast(PAIRS).alias("asks"))


def normalize_messages(raw: DataFrame) -> DataFrame:
    """The L2 message table of raw messages, status included, in one pass. Texts of unknown venues are IGNORED.

    A text is parsed once, with its own venue's schema, and its levels once, whatever the venue.
    """
    schemas = list(dict.fromkeys(schema for schema, _, _ in VENUES.values()))
    parsed = {}
    for k, schema in enumerate(schemas):
        full = schema if schema.startswith("MAP") else schema + ", _bad STRING"
        own = [v for v, (s, _, _) in VENUES.items() if s == schema]
        parsed[f"__{k}"] = F.when(F.col("venue").isin(*own), F.from_json("text", full, {"columnNameOfCorruptRecord": "_bad"}))
    readings: dict[tuple, list[str]] = {}
    for venue, (schema, rule, _) in VENUES.items():
        readings.setdefault((schema, rule), []).append(venue)
    message = F.lit(None)
    for (schema, rule), venues in readings.items():
        message = F.when(F.col("venue").isin(*venues), _reading(schema, rule, F.col(f"__{schemas.index(schema)}"))).otherwise(message)
    rows = raw.withColumns(parsed).select("recv_seq", "recv_ts", "venue", "conn_epoch", (F.trim("text") == "pong").alias("__pong"), message.alias("__m"))
    rows = rows.select("recv_seq", "recv_ts", "venue", "conn_epoch", "__pong", "__m.*")
    rows = rows.withColumns({c: parse_levels(F.col(c)) for c in ("bids", "asks")})
    hole = lambda c: F.col(c).isNull() | F.exists(c, lambda x: x["price_raw"].isNull() | x["size_raw"].isNull())
    faulty = ~F.col("complete") | F.col("bare") | hole("bids") | hole("asks")
    status = F.when(F.coalesce("__pong", F.lit(False)), IGNORED).when(F.col("broken"), MALFORMED).when(F.col("kind").isNull(), IGNORED).when(faulty, MALFORMED).otherwise(F.col("kind"))
    rows = rows.withColumn("status", status)
    good = F.col("status").isin(SNAPSHOT, DELTA)
    keep = lambda n: F.when(good, F.col(n)).alias(n)
    return rows.select("recv_seq", "recv_ts", "venue", "conn_epoch", keep("native_symbol"), "status", F.when(good, F.col("status")).alias("kind"), *[keep(n) for n in FIELDS], keep("bids"), keep("asks"))


def status_counts(messages: DataFrame) -> DataFrame:
    return messages.groupBy("venue", "status").agg(F.count(F.lit(1)).alias("n"))


def is_rejected(bids: Column, asks: Column) -> Column:
    """Whether a level on either side has a price that isn't positive or a negative size: the message is void then."""
    bad = lambda x: (x["price_raw"] <= 0) | (x["size_raw"] < 0)
    return F.exists(bids, bad) | F.exists(asks, bad)


def explode_levels(messages: DataFrame, seq: str = "recv_seq") -> DataFrame:
    """One row for each level: the message's columns, pos from 1 (bids before asks), side, price_raw, size_raw."""
    tagged = lambda c, side: F.transform(c, lambda x: F.struct(F.lit(side).alias("side"), x["price_raw"].alias("price_raw"), x["size_raw"].alias("size_raw")))
    keep = [c for c in messages.columns if c not in ("bids", "asks")]
    rows = messages.select(*keep, F.posexplode(F.concat(tagged("bids", "BID"), tagged("asks", "ASK"))).alias("pos", "x"))
    return rows.select(*keep, (F.col("pos") + 1).alias("pos"), "x.side", "x.price_raw", "x.size_raw")
