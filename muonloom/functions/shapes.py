"""Curve shapes and flux models as Column expressions."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, functions as F

from muonloom.sources.constants import FLUX_MODELS


def sigmoid(x: Column, p0, p1, p2) -> Column:
    return p0 / (1 + F.exp(-p1 * (x - p2)))


def lateral_profile(r: Column, s60, beta) -> Column:
    """Signal at distance r from the axis, normalised to r = 60 m."""
    u = r / 60.0
    return s60 * F.pow(u, -beta - 0.303 * F.log10(u))


def cubic(x: Column, a, b, c, d) -> Column:
    return a + x * (b + x * (c + d * x))


def s125_to_loge(log_s125: Column, slope=0.90603644, offset=6.04892767) -> Column:
    return slope * log_s125 + offset


def balloon_line(log_qtotal: Column) -> Column:
    return 0.2 * log_qtotal * log_qtotal + 0.1 * log_qtotal - 0.3


def flux(model: str, energy: Column, population: int | None = None,
         element: str | None = None) -> Column:
    """dN/dlnE of a flux model, optionally for one population or one element.

    The parameters are literals, so the sum is one generated expression per
    row instead of a join that multiplies rows by the number of components.
    The power is taken as exp(-gamma ln E) inside the cutoff exponential.
    """
    parts = [
        a * F.exp(-g * F.log(energy) - energy / (z * rcut))
        for pop, el, a, g, z, rcut in FLUX_MODELS[model]
        if population in (None, pop) and element in (None, el)
    ]
    return functools.reduce(operator.add, parts)


def scale_flux(energy: Column, scale: float) -> Column:
    """E^(scale-1), the factor that flattens a dN/dlnE spectrum."""
    return F.pow(energy, F.lit(scale - 1.0))
