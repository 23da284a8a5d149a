"""Histogram edges, bin numbers and bin centres."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, functions as F

LN10 = math.log(10.0)


def linspace(lo: float, hi: float, n: int) -> list[float]:
    return [float(v) for v in np.linspace(lo, hi, n)]


def logspace(lo: float, hi: float, n: int) -> list[float]:
    return [float(v) for v in np.logspace(lo, hi, n)]


LOGE_EDGES = linspace(4.0, 7.4, 18)
LOGE_EDGES_FINE = linspace(4.0, 7.4, 35)
RESOLUTION_EDGES = linspace(4.0, 7.6, 19)
CHARGE_EDGES = logspace(-5, 5, 201)
GAP_EDGES = linspace(0.0, 2.0, 153)


def _step(values: np.ndarray) -> float | None:
    """Common step of evenly spaced values, else None."""
    steps = np.diff(values)
    mean = float((values[-1] - values[0]) / len(steps))
    return mean if np.allclose(steps, mean, rtol=0, atol=abs(mean) * 0.01) else None


def _literals(edges: Sequence[float]) -> Column:
    # folds to one array literal
    return F.array(*[F.lit(float(e)) for e in edges])


def bin_index(x: Column, edges: Sequence[float]) -> Column:
    """0-based bin of x, NULL outside; bins are half open but the last holds its upper edge.

    The result follows the edge values exactly.  Evenly spaced edges (in x or
    in log x) give a position that is at most one bin off, which two lookups
    correct; other edges become a balanced tree of comparisons.  Either way no
    edge table is joined, and NaN is outside.
    """
    n = len(edges) - 1
    e = np.asarray(edges, float)
    table = _literals(edges)
    position = None
    if (step := _step(e)) is not None:
        position = (x - F.lit(edges[0])) / F.lit(step)
    elif e[0] > 0 and (step := _step(np.log10(e))) is not None:
        position = (F.log10(x) - F.lit(math.log10(edges[0]))) / F.lit(step)

    def pick(lo: int, hi: int) -> Column:
        if hi - lo == 1:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(x < F.lit(edges[mid]), pick(lo, mid)).otherwise(pick(mid, hi))

    if position is None:
        inside = pick(0, n)
    else:
        near = F.least(F.greatest(F.floor(position), F.lit(0)), F.lit(n - 1)).cast("int")
        inside = (
            F.when(x < F.get(table, near), near - 1)
            .when(x >= F.get(table, near + 1), near + 1)
            .otherwise(near)
        )
    return (
        F.when(x == F.lit(edges[-1]), F.lit(n - 1))
        .when((x >= F.lit(edges[0])) & (x < F.lit(edges[-1])), inside)
    )


def edge_at(edges: Sequence[float], index: Column) -> Column:
    return F.get(_literals(edges), index.cast("int"))


def centre(lo: Column, hi: Column) -> Column:
    return (lo + hi) * 0.5


def dlne(lo: Column, hi: Column) -> Column:
    """Width in ln E of a bin given in log10 E."""
    return (hi - lo) * LN10


def power_law_centre(lo: Column, hi: Column, index: float) -> Column:
    """log10 E where E^-index equals its mean over the bin (index is the integral one)."""
    a, b = lo * LN10, hi * LN10
    mean = (F.exp(-index * a) - F.exp(-index * b)) / (index * (b - a))
    return -F.log(mean) / (index * LN10)


def mean_power_centre(elo: Column, ehi: Column, gamma: float) -> Column:
    """Generalised mean of the two edge energies with exponent 1 - gamma."""
    k = 1.0 - gamma
    return F.pow((F.pow(elo, k) + F.pow(ehi, k)) * 0.5, 1.0 / k)


def spectral_mean_energy(elo: Column, ehi: Column, gamma: float) -> Column:
    """Mean energy of an E^-gamma spectrum between two edges."""
    k = 1.0 - gamma
    top = k * (F.pow(ehi, k + 1) - F.pow(elo, k + 1))
    return top / ((k + 1) * (F.pow(ehi, k) - F.pow(elo, k)))
