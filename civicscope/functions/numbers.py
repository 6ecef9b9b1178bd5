"""Rounding, ratios and weighted means.

Two roundings are needed.  Table columns follow SQL ``ROUND`` (half away from
zero); values derived for display follow half-to-even on the exact binary value.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(value: Column, digits: int = 0) -> Column:
    """Half-away-from-zero on a double, by scaling, so 1.005 at two digits is 1.0."""
    if digits == 0:
        return F.round(value, 0)
    scale = float(10**digits)
    return F.round(value * F.lit(scale), 0) / F.lit(scale)


def _tie_errors(digits: int) -> list[int]:
    """Sign of (nearest double - exact decimal) for each tie point (2i+1)/(2*10^digits)."""
    steps = 10**digits
    signs = []
    for i in range(steps):
        exact = Fraction(2 * i + 1, 2 * steps)
        error = Fraction((2 * i + 1) / (2 * steps)) - exact
        signs.append((error > 0) - (error < 0))
    return signs


def round_half_even(value: Column, digits: int = 0) -> Column:
    """Half-to-even on the exact binary value: 2.5 -> 2, 0.25 -> 0.2, but 0.35 -> 0.3.

    ``bround`` rounds the shortest decimal text instead, which turns 0.35 (stored
    slightly below) into 0.4; so for one or two digits the fraction is compared
    with the tie point and equality is settled by a small table.
    """
    value = value.cast("double")
    if digits == 0:
        return F.bround(value, 0)
    steps = 10**digits
    size = F.abs(value)
    whole = F.floor(size)
    part = size - whole
    step = F.least(F.floor(part * F.lit(float(steps))), F.lit(steps - 1))
    tie = (step * 2 + 1) / F.lit(2.0 * steps)
    errors = F.array(*[F.lit(s) for s in _tie_errors(digits)])
    at_tie = F.coalesce(F.get(errors, step.cast("int")), F.lit(0))
    up = (
        F.when(part > tie, 1)
        .when(part < tie, 0)
        .when(at_tie != 0, F.when(at_tie > 0, 1).otherwise(0))
        .otherwise(step % 2)
    )
    rounded = F.signum(value) * ((whole * steps + step + up) / F.lit(float(steps))) + F.lit(0.0)
    return F.when(size < F.lit(float(2**52)), rounded).otherwise(value)


def display_value(value: Column) -> Column:
    """Output form of a number: at most one decimal."""
    return round_half_even(value, 1)


def number_text(value: Column) -> Column:
    """Text of an already cleaned number: integral values print without a point, none with an exponent."""
    plain = F.regexp_replace(F.format_string("%.6f", value), "0+$", "")
    ordinary = (F.abs(value) < 1e7) & (F.abs(value) >= 1e-3)
    return F.when(value == F.floor(value), F.floor(value).cast("string")).when(ordinary, value.cast("string")).when(value.isNotNull(), plain)


def fixed_text(value: Column, digits: int = 0) -> Column:
    """Fixed-point text, rounded half-to-even like a ``.0f`` / ``.1f`` format."""
    return F.when(value.isNotNull(), F.format_string(f"%.{digits}f", round_half_even(value, digits)))


def grouped_text(value: Column, digits: int = 0, prefix: str = "") -> Column:
    """Thousands-separated text with a prefix; a dash stands for a missing value."""
    text = F.concat(F.lit(prefix), F.format_number(round_half_even(value, digits), digits))
    return F.coalesce(text, F.lit("—"))


def signed_delta_text(
    value: Column, other: Column, digits: int = 0, prefix: str = "", suffix: str = ""
) -> Column:
    """``+$1,200 vs avg`` style difference text; NULL when either side is missing."""
    diff = value.cast("double") - other.cast("double")
    return F.concat(
        F.when(diff >= 0, F.lit("+")).otherwise(F.lit("-")),
        F.lit(prefix),
        F.format_number(round_half_even(F.abs(diff), digits), digits),
        F.lit(suffix),
    )


def signed_percent_text(value: Column, suffix: str = "") -> Column:
    """``+12%`` style text of a percentage, NULL stays NULL."""
    sign = F.when(value >= 0, F.lit("+")).otherwise(F.lit("-"))
    return F.concat(sign, fixed_text(F.abs(value)), F.lit("%" + suffix))


def safe_ratio(top: Column, bottom: Column) -> Column:
    """top / bottom as double, NULL when the bottom is zero or missing."""
    return top.cast("double") / F.nullif(bottom.cast("double"), F.lit(0.0))


def per_thousand(count: Column, population: Column, digits: int = 1) -> Column:
    """Rate per 1,000 residents."""
    return round_half_up(safe_ratio(count * F.lit(1000.0), population), digits)


def percent_change(current: Column, previous: Column) -> Column:
    """100 * (current - previous) / |previous|; NULL when previous is zero or missing."""
    return safe_ratio((current - previous) * F.lit(100.0), F.abs(previous))


def weighted_mean(
    value: Column, weight: Column, digits: int | None = None, skip_null_weight: bool = False
) -> Column:
    """Aggregate: sum(v*w) / sum(w).

    By default the weight of a missing value still counts in the denominator;
    ``skip_null_weight`` leaves it out.
    """
    counted = F.when(value.isNotNull(), weight).otherwise(F.lit(0)) if skip_null_weight else weight
    mean = safe_ratio(F.sum(value * weight), F.sum(counted))
    return mean if digits is None else round_half_up(mean, digits)


def share_percent(condition: Column, digits: int = 1, count: Column | None = None) -> Column:
    """Aggregate: share of rows meeting a condition, in percent.

    ``count`` gives the number of originals a pre-aggregated row stands for.
    """
    one = F.lit(1) if count is None else count
    hits = F.sum(F.when(condition, one).otherwise(F.lit(0)))
    return round_half_up(hits * F.lit(100.0) / F.sum(one), digits)


def clamp(value: Column, low: float, high: float) -> Column:
    """Limit a value to [low, high]."""
    return F.greatest(F.lit(low), F.least(F.lit(high), value))
