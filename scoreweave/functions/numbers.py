"""Scalar functions on numbers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Winitzki's constant (fixed value).
WINITZKI = 0.147


def half_up(x: Column, digits: int = 0) -> Column:
    """Round half toward plus infinity."""
    return F.floor(x * 10**digits + 0.5) / float(10**digits)


def finite(x: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def shortest(x: Column) -> Column:
    """A number as its shortest text: 75, 0.5."""
    return F.when(x == F.floor(x), x.cast("long").cast("string")).otherwise(x.cast("string"))


def inverse_erf(x: Column) -> Column:
    log = F.log(1 - x * x)
    t = F.lit(2 / (3.141592653589793 * WINITZKI)) + log / 2
    return F.signum(x) * F.sqrt(F.sqrt(t * t - log / WINITZKI) - t)


def confidence_interval(std_dev: Column, p: float = 0.99) -> Column:
    """Half width of the interval that holds a share p of a normal distribution."""
    return std_dev * F.sqrt(F.lit(2.0)) * inverse_erf(F.lit(float(p)))


def z_score(x: Column, mean: Column, std_dev: Column) -> Column:
    """(x - mean) / sd; no mean counts as 0, no or zero sd as 1."""
    return (x - F.coalesce(mean, F.lit(0.0))) / F.when(F.coalesce(std_dev, F.lit(0.0)) == 0, 1.0).otherwise(std_dev)


def score_text(score: Column, std_dev: Column, p: float = 0.99) -> Column:
    """Two decimals, with the interval if there is a deviation; empty if there is no score."""
    interval = F.when(std_dev > 0, F.concat(F.lit(" ±"), shortest(half_up(confidence_interval(std_dev, p), 2)))).otherwise("")
    return F.when(score.isNull(), "").otherwise(F.concat(shortest(half_up(score, 2)), interval))
