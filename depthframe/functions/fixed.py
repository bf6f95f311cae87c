"""Exact fixed-point arithmetic as column expressions.

Everything is computed on DECIMAL(38,0): a product of two 64-bit numbers has at most 38 digits. Results that leave
the 64-bit range are NULL (the ``try_`` functions), which the operators turn into a status.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from depthframe.types import INT64_MAX, INT128_MAX, SIZE_SCALE

WIDE = "decimal(38,0)"
#: \z, not $, which would let a line end follow.
NUMBER = r"^-?([0-9]+[.]?[0-9]*|[.][0-9]+)\z"


def wide(c: Column | int) -> Column:
    return (F.lit(str(c)) if isinstance(c, int) else c).cast(WIDE)


def narrow(c: Column) -> Column:
    """To BIGINT; NULL outside of plus or minus the largest 64-bit integer."""
    return F.when(F.abs(c) <= wide(INT64_MAX), c).try_cast("bigint")


def div_trunc(n: Column, d: Column) -> Column:
    """n / d towards zero, for d > 0."""
    n, d = wide(n), wide(d)
    return F.try_divide(F.try_subtract(n, n % d), d).cast(WIDE)


def div_half_away(n: Column, d: Column) -> Column:
    """n / d to the nearest integer, halves away from zero, for d > 0."""
    n, d = wide(n), wide(d)
    r = n % d
    up = F.when(F.abs(r) >= d - F.abs(r), F.signum(n)).otherwise(0)
    return F.try_add(div_trunc(n, d), wide(up)).cast(WIDE)


def div_ceil(n: Column, d: int) -> Column:
    """n / d upwards, for n >= 0."""
    return div_trunc(wide(n) + wide(d - 1), wide(d))


def fixed_from_string(text: Column, decimals: int) -> Column:
    """Scaled BIGINT of a plain decimal text; NULL if it isn't one or doesn't fit.

    The digit after the last kept one decides the rounding, so the text is cut there before the cast. A text of few digits, as most
    are, needs no cut, and is cast as it is.
    """
    short = text.rlike(rf"^[0-9]{{1,9}}([.][0-9]{{1,{decimals}}})?\z")
    plain = text.try_cast(f"decimal({9 + decimals},{decimals})") * F.lit(10**decimals).cast("decimal(11,0)")
    cut = F.regexp_replace(text, rf"^(-?[0-9]*[.][0-9]{{{decimals + 1}}})[0-9]+$", "$1")
    # Leading zeros and a bare point are legal; digits beyond the cast's range are out of range anyway.
    number = F.regexp_replace(F.regexp_replace(cut, r"^(-?)0+(?=[0-9])", "$1"), r"^(-?)[.]", "$10.")
    scaled = F.round(number.try_cast(f"decimal(38,{decimals + 1})"), decimals) * F.lit(10**decimals).cast("decimal(11,0)")
    return F.when(short, plain.cast("bigint")).when(text.rlike(NUMBER), narrow(scaled.cast(WIDE)))


def fixed_from_double(value: Column, decimals: int) -> Column:
    half = F.when(value >= 0, 0.5).otherwise(-0.5)
    return (value * F.lit(float(10**decimals)) + half).try_cast("bigint")


def fixed_to_decimal(raw: Column, decimals: int) -> Column:
    return (raw.cast("decimal(19,0)") / F.lit(10**decimals).cast("decimal(11,0)")).cast(f"decimal(19,{decimals})")


def fixed_to_double(raw: Column, decimals: int) -> Column:
    return raw.cast("double") / F.lit(float(10**decimals))


def notional(price: Column, size: Column) -> Column:
    """Scaled notional of a price and a size."""
    return narrow(div_half_away(F.try_multiply(wide(price), wide(size)), wide(SIZE_SCALE)))


def over(numerator: Column, denominator: Column) -> Column:
    """Size of a notional at a price, or price of a notional for a size; NULL if the divisor isn't positive."""
    n = F.try_multiply(wide(numerator), wide(SIZE_SCALE))
    return F.when(denominator > 0, narrow(div_half_away(n, F.when(denominator > 0, denominator))))


def offset_by_bps(price: Column, bps: Column, side: Column) -> Column:
    """The furthest price within bps of price on its side: for asks above it rounded down, for bids below it rounded up."""
    ask = div_trunc(wide(price) * (wide(10000) + wide(bps)), wide(10000))
    bid = div_ceil(wide(price) * (wide(10000) - wide(bps)), 10000)
    return narrow(F.when(side == "ASK", ask).otherwise(bid))


def within_bps(price: Column, reference: Column, bps: Column, side: Column) -> Column:
    """Whether price lies within bps of the reference on its side; the boundary counts."""
    here = wide(price) * wide(10000)
    ask = here <= wide(reference) * (wide(10000) + wide(bps))
    bid = here >= wide(reference) * (wide(10000) - wide(bps))
    return F.when(side == "ASK", ask).otherwise(bid)


def vwap_at_partial_fill(cum_notional: Column, cum_size: Column, remaining: Column, price: Column) -> Column:
    """Average price after remaining more notional at price, rounded once; NULL if out of range.

    The numerator times 10**6 would leave 38 digits, so it is divided in two steps.
    """
    a = F.try_multiply(wide(cum_notional) + wide(remaining), wide(price))
    d = F.try_add(F.try_multiply(wide(cum_size), wide(price)), F.try_multiply(wide(remaining), wide(SIZE_SCALE))).cast(WIDE)
    whole = F.try_multiply(div_trunc(a, d), wide(SIZE_SCALE))
    rest = div_half_away(F.try_multiply((a % d).cast(WIDE), wide(SIZE_SCALE)), d)
    limit = wide(INT128_MAX // SIZE_SCALE)
    return F.when(F.abs(a) <= limit, narrow(F.try_add(whole, rest).cast(WIDE)))
