"""Cleaning of raw text fields, and small text renderings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the marker the demographic source uses for "no estimate".
MISSING_ESTIMATE = -666666666


def digits_only(value: Column) -> Column:
    """Keep the digits of a text."""
    return F.regexp_replace(value, "[^0-9]", "")


def postal_key(value: Column, length: int = 5) -> Column:
    """First ``length`` digits of a postal code; NULL when fewer are present."""
    digits = digits_only(value)
    return F.when(F.length(digits) >= length, F.substring(digits, 1, length))


def parse_date(value: Column, pattern: str = "M/d/yyyy") -> Column:
    """Date from text; one-digit months and days are accepted, bad text gives NULL."""
    return F.try_to_date(F.trim(value), pattern)


def parse_number(value: Column, dtype: str = "int") -> Column:
    """Number from text via double, so '12.6' becomes 13 and bad text NULL."""
    number = value.try_cast("double")
    if dtype in ("int", "bigint", "long"):
        return F.bround(number, 0).try_cast(dtype)
    return number.cast(dtype)


def estimate(value: Column, dtype: str = "int", missing: int = MISSING_ESTIMATE) -> Column:
    """Numeric estimate with the missing marker turned into NULL."""
    number = parse_number(value, dtype)
    return F.nullif(number, F.lit(missing).cast(dtype))


def activity_status(expires: Column, as_of: Column) -> Column:
    """'active' when there is no expiry or it is on or after the as-of date."""
    return F.when(expires.isNull() | (expires >= as_of), F.lit("active")).otherwise(
        F.lit("inactive")
    )


def ordinal(number: Column) -> Column:
    """1st, 2nd, 3rd, 4th, 11th, 21st ..."""
    last_two, last = number % 100, number % 10
    ending = (
        F.when(last_two.between(11, 13), "th")
        .when(last == 1, "st")
        .when(last == 2, "nd")
        .when(last == 3, "rd")
        .otherwise("th")
    )
    return F.concat(number.cast("string"), ending)


def rank_badge(rank: Column, of: Column, sense: Column) -> Column:
    """Caption for a rank: n-th lowest, top p % or plain, by the metric's sense."""
    top = F.greatest(F.lit(1.0), F.bround(rank * F.lit(100.0) / of, 0)).cast("int")
    plain = F.concat(F.lit("rank "), rank.cast("string"), F.lit(" of "), of.cast("string"))
    return (
        F.when(sense == "low", F.concat(ordinal(rank), F.lit(" lowest of "), of.cast("string")))
        .when(
            (sense == "high") & (top <= 50),
            F.concat(F.lit("top "), top.cast("string"), F.lit("% · "), plain),
        )
        .otherwise(plain)
    )


def maturity(age_years: Column) -> Column:
    """Bucket of a median age: emerging < 2, growing < 5, maturing < 8, else established."""
    return (
        F.when(age_years.isNull(), "")
        .when(age_years < 2, "emerging")
        .when(age_years < 5, "growing")
        .when(age_years < 8, "maturing")
        .otherwise("established")
    )
