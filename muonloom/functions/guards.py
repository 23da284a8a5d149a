"""Null, NaN and error-algebra helpers, all plain Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# what numpy's nan_to_num leaves for -inf in a float32 block
FLOAT32_LOWEST = -3.4028235e38


def ratio(num: Column, den: Column) -> Column:
    """num / den; NULL where the denominator is 0 (ANSI mode would raise)."""
    return F.try_divide(num, den)


def ratio_or_zero(num: Column, den: Column) -> Column:
    return F.coalesce(F.try_divide(num, den), F.lit(0.0))


def ratio_error(x: Column, y: Column, ex: Column, ey: Column) -> Column:
    """Propagated error of x / y for independent x and y."""
    return F.sqrt(F.pow(ratio(ex, y), 2) + F.pow(ratio(x * ey, y * y), 2))


def quadrature(*parts: Column) -> Column:
    """Square root of the sum of squares."""
    total = F.lit(0.0)
    for p in parts:
        total = total + p * p
    return F.sqrt(total)


def is_finite(x: Column) -> Column:
    """Neither NULL nor NaN nor infinite; never NULL itself."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < math.inf), F.lit(False))


def finite(x: Column) -> Column:
    """As numpy's nan_to_num on float32: NULL and NaN become 0, infinities the limits of the type."""
    return (
        F.when(is_finite(x), x)
        .when(x == -math.inf, F.lit(FLOAT32_LOWEST))
        .when(x == math.inf, F.lit(-FLOAT32_LOWEST))
        .otherwise(F.lit(0.0))
    )


def log10_feature(x: Column) -> Column:
    """log10 for a feature vector: 0 maps to the float32 floor, NaN to 0."""
    return (
        F.when(F.isnan(x), F.lit(0.0))
        .when(x > 0, F.log10(x))
        .when(x == 0, F.lit(FLOAT32_LOWEST))
        .otherwise(F.lit(0.0))
    )


def log10_floor(x: Column, floor: float = 1e-5) -> Column:
    """log10 with zero replaced by ``floor`` first."""
    return F.log10(F.when(x == 0, F.lit(floor)).otherwise(x))


def failed_zenith(zenith: Column) -> Column:
    """A NaN zenith becomes 1.9 pi (342 degrees), outside every zenith histogram.

    Its cosine is 0.95, so use this for histograms only; a cut on the cosine of
    the raw value already rejects NaN.
    """
    return F.nanvl(zenith, F.lit(1.9 * math.pi))


def between(x: Column, lo: float, hi: float) -> Column:
    """lo <= x <= hi, false for NaN (Spark orders NaN above everything)."""
    return (x >= lo) & (x <= hi)


def clamp(x: Column, lo: float, hi: float) -> Column:
    """x limited to [lo, hi]; NULL and NaN stay (least and greatest would hide them)."""
    return (
        F.when(x.isNull() | F.isnan(x), x)
        .when(x < lo, F.lit(float(lo)))
        .when(x > hi, F.lit(float(hi)))
        .otherwise(x)
    )
