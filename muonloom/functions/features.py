"""Per-event features from the 35-wide arrays."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from muonloom.functions.guards import log10_feature
from muonloom.schema import N_SLOTS
from muonloom.sources.constants import REFERENCE_RADIUS


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def leading_sum(pulses: Column, n: int = 2) -> Column:
    """Sum of the n largest charges (arrays are sorted by charge)."""
    return total(F.slice(pulses, 1, n))


def without_largest(pulses: Column) -> Column:
    return total(F.slice(pulses, 2, N_SLOTS))


def largest(pulses: Column) -> Column:
    return F.get(pulses, F.lit(0))


def tank_radii(tank_x: Column, tank_y: Column, core_x: Column, core_y: Column,
               empty: float = 0.0) -> Column:
    """Tank-core distances, largest first; a slot at (0, 0) is empty."""
    radii = F.zip_with(
        tank_x, tank_y,
        lambda x, y: F.when((x == 0) & (y == 0), F.lit(float(empty))).otherwise(
            F.sqrt((x - core_x) * (x - core_x) + (y - core_y) * (y - core_y))),
    )
    return F.sort_array(radii, asc=False)


def frac_radius(tank_x, tank_y, core_x, core_y, reference: float = REFERENCE_RADIUS,
                empty: float = 0.0) -> Column:
    return F.transform(tank_radii(tank_x, tank_y, core_x, core_y, empty),
                       lambda r: r / reference)


def tank_density(n: Column, max_radius: Column, per_km2: bool = False) -> Column:
    """n / (pi r^2); NULL for a zero radius."""
    unit = 1e-6 if per_km2 else 1.0
    return F.try_divide(n.cast("double"), unit * math.pi * max_radius * max_radius)


def log_array(values: Column) -> Column:
    return F.transform(values, log10_feature)


def pad(values: Column, width: int = N_SLOTS) -> Column:
    """Zero-fill an array of at most ``width`` values to exactly ``width``."""
    return F.concat(values, F.array_repeat(F.lit(0.0), F.lit(width) - F.size(values)))


def zeros(width: int = N_SLOTS) -> Column:
    return F.array_repeat(F.lit(0.0), width)
