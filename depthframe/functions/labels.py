"""Labels of band thresholds, and the lists that they are parsed from."""

from __future__ import annotations

import re

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from depthframe.types import INT64_MAX, NOTIONAL_DECIMALS

UNIT = 10**NOTIONAL_DECIMALS


def notional_label(raw: Column) -> Column:
    """1M, 5K, 2B for round notionals, else the plain number without trailing zeros. raw: 64 bits, or a decimal of up to 28 digits."""
    wide = raw.cast("decimal(28,0)")
    exact = (wide / F.lit(UNIT).cast("decimal(10,0)")).cast(f"decimal(37,{NOTIONAL_DECIMALS})")
    plain = F.regexp_replace(F.regexp_replace(exact.cast("string"), "0+$", ""), "[.]$", "")
    whole = lambda unit: F.call_function("div", wide, F.lit(unit)).cast("string")
    out = F.when(wide % UNIT != 0, plain)
    for size, letter in ((10**9, "B"), (10**6, "M"), (10**3, "K")):
        out = out.when((wide != 0) & (wide % (UNIT * size) == 0), F.concat(whole(UNIT * size), F.lit(letter)))
    return out.otherwise(whole(UNIT))


def bps_label(bps: Column) -> Column:
    return F.concat(bps.cast("string"), F.lit("bps"))


def open_ended(label: Column, ordinal: Column, *partition: str) -> Column:
    """The label, with a plus sign on the last of each list."""
    last = F.lead(ordinal).over(Window.partitionBy(*partition).orderBy(ordinal)).isNull()
    return F.concat(label, F.when(last, "+").otherwise(""))


def _ascending(values: list[int]) -> list[int]:
    if not values or any(b <= a for a, b in zip(values, values[1:], strict=False)):
        raise ValueError(f"not a strictly increasing list: {values}")
    return values


def parse_notionals(text: str) -> list[int]:
    """Scaled thresholds of a comma-separated list of whole, positive, increasing notionals."""
    tokens = text.split(",")
    if any(not re.fullmatch(r"[0-9]+", t) for t in tokens):
        raise ValueError(f"not a list of whole notionals: {text!r}")
    values = _ascending([int(t) * UNIT for t in tokens])
    if values[0] <= 0 or values[-1] > INT64_MAX:
        raise ValueError(f"notional out of range: {text!r}")
    return values


def parse_bps(text: str) -> list[int]:
    """A comma-separated list of increasing basis points, 0 to 9999."""
    tokens = text.split(",")
    if any(not re.fullmatch(r"[0-9]+", t) for t in tokens):
        raise ValueError(f"not a list of basis points: {text!r}")
    values = _ascending([int(t) for t in tokens])
    if values[-1] > 9999:
        raise ValueError(f"basis points out of range: {text!r}")
    return values
