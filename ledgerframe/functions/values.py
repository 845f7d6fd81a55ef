"""Fact values: stated precision, tolerance, canonical text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def precision(decimals: Column) -> Column:
    """decimals as a double: INF is infinite, unstated or unreadable minus infinity."""
    text = F.upper(F.trim(decimals))
    low = F.lit(float("-inf"))
    return F.when(text == "INF", F.lit(float("inf"))).otherwise(F.coalesce(F.expr("try_cast(NULL AS DOUBLE)") if decimals is None else text.try_cast("double"), low))


def tolerance(decimals: Column) -> Column:
    """Half a unit of the stated place; 0 for INF, 0.5 if unstated."""
    p = precision(decimals)
    return F.when(p == float("inf"), 0.0).when(p == float("-inf"), 0.5).otherwise(F.lit(0.5) * F.pow(F.lit(10.0), -p))


def canonical_number(text: Column) -> Column:
    """Decimal text without sign of zero, exponent, leading or trailing zeros; null if it is no number."""
    number = F.trim(text).try_cast("decimal(38,12)")
    plain = F.regexp_replace(F.regexp_replace(number.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(plain == "-0", "0").otherwise(plain)


def whole_decimals(decimals: Column) -> Column:
    """decimals as an integer; null for INF, unstated or fractional."""
    return F.when(F.trim(decimals).rlike(r"^[+-]?\d+$"), F.trim(decimals).try_cast("int"))
