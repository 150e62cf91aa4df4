"""Odds conversions and edges as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_decimal(c: Column) -> Column:
    """Decimal odds; the input format is read from its size: (0,1] probability, (1,99) decimal, else American."""
    c = c.cast("double")
    return (
        F.when((c > 0) & (c <= 1), F.try_divide(F.lit(1.0), c))
        .when((c > 1) & (c < 99), c)
        .when(c > 0, c / 100 + 1)
        .otherwise(1 - F.try_divide(F.lit(100.0), c))
    )


def convert_odds(c: Column, target: str) -> Column:
    """``c`` in the target format (decimal, probability or american), four decimals."""
    d = to_decimal(c)
    if target == "decimal":
        return F.round(d, 4)
    if target == "probability":
        return F.round(F.try_divide(F.lit(1.0), d), 4)
    if target == "american":
        return F.round(F.when(d >= 2, (d - 1) * 100).otherwise(F.try_divide(F.lit(-100.0), d - 1)), 4)
    raise ValueError(f"unknown odds format {target}")


def american_from_prob(p: Column) -> Column:
    """Whole-number American odds, truncated toward zero."""
    fav = F.try_divide(-100 * p, 1 - p)
    dog = F.try_divide(100 * (1 - p), p)
    return F.when(p > 0.5, fav).otherwise(dog).cast("int")


def prob_from_american(o: Column) -> Column:
    o = o.cast("double")
    return F.when(o < 0, F.abs(o) / (F.abs(o) + 100)).otherwise(100 / (o + 100))


def complement_odds(d: Column) -> Column:
    """Fair decimal odds of the other side: 1 + 1/(d-1), or 2.0 outside the decimal range."""
    return F.when(d > 1, 1 + 1 / (d - 1)).otherwise(2.0)


def implied_prob(d: Column) -> Column:
    return F.when(d > 0, 1 / d).otherwise(0.5)


def edge_points(p: Column, decimal_odds: Column) -> Column:
    """Model probability minus implied probability in percentage points; 0 when either is missing."""
    implied = F.when(decimal_odds > 1, 100 / decimal_odds).otherwise(0.0)
    return F.when(p.isNull(), 0.0).otherwise(p * 100 - implied)


def positive_ev(p: Column, decimal_odds: Column) -> Column:
    """Strictly more likely than the price implies; never for missing or invalid odds."""
    return F.coalesce(F.when(decimal_odds > 1, p > 1 / decimal_odds), F.lit(False))
