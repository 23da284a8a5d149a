"""Distances, directions and the shower frame."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, functions as F

from muonloom.functions.guards import clamp
from muonloom.sources.constants import ARRAY_ALTITUDE, INFILL_TANKS


def distance(x1, y1, x2, y2) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def opening_angle(z1: Column, a1: Column, z2: Column, a2: Column) -> Column:
    """Angle in degrees between two directions; rounding past +-1 is clamped."""
    dot = F.sin(z1) * F.sin(z2) * F.cos(a1 - a2) + F.cos(z1) * F.cos(z2)
    return F.degrees(F.acos(clamp(dot, -1.0, 1.0)))


def _shower_axes(dx, dy, dz, phi, theta):
    along = -F.cos(phi) * dx - F.sin(phi) * dy
    across = F.sin(phi) * dx - F.cos(phi) * dy
    return (
        -F.cos(theta) * along - F.sin(theta) * dz,
        across,
        F.sin(theta) * along - F.cos(theta) * dz,
    )


def shower_depth(dx, dy, dz, phi, theta) -> Column:
    """Coordinate along the shower axis of an offset from the core."""
    return _shower_axes(dx, dy, dz, phi, theta)[2]


def shower_radius(dx, dy, dz, phi, theta) -> Column:
    """Distance from the shower axis of an offset from the core."""
    u, v, _ = _shower_axes(dx, dy, dz, phi, theta)
    return F.sqrt(u * u + v * v)


def plane_residual(time, core_time, dx, dy, dz, phi, theta) -> Column:
    """Arrival time in ns relative to a plane front through the core (c = 3e8 m/s)."""
    return time - (core_time + shower_depth(dx, dy, dz, phi, theta) / 3.0e8 * 1.0e9)


def zsc_average(tank_x, tank_y, tank_z, azimuth, zenith, core_x, core_y,
                core_z: float = ARRAY_ALTITUDE) -> Column:
    """Mean absolute depth of the filled slots of three tank arrays; NULL without hits."""
    # depth = a x + b y + c z - d; the one-element array binds the four
    # coefficients, so that no angle is evaluated per slot
    a = -F.sin(zenith) * F.cos(azimuth)
    b = -F.sin(zenith) * F.sin(azimuth)
    c = -F.cos(zenith)
    plane = F.array(F.struct(a.alias("a"), b.alias("b"), c.alias("c"),
                             (a * core_x + b * core_y + c * core_z).alias("d")))
    hits = F.filter(
        F.arrays_zip(tank_x.alias("x"), tank_y.alias("y"), tank_z.alias("z")),
        lambda t: (t["x"] != 0) | (t["y"] != 0) | (t["z"] != 0))
    mean = F.transform(plane, lambda k: F.try_divide(
        F.aggregate(hits, F.lit(0.0), lambda acc, t: acc + F.abs(
            k["a"] * t["x"] + k["b"] * t["y"] + k["c"] * t["z"] - k["d"])),
        F.size(hits)))
    return F.get(mean, F.lit(0))


def contained(x: Column, y: Column, radius: float = 45.0, tanks=INFILL_TANKS) -> Column:
    """Within ``radius`` of any of the given tanks."""
    limit = radius * radius
    near = [(x - tx) * (x - tx) + (y - ty) * (y - ty) <= limit for tx, ty in tanks]
    return functools.reduce(operator.or_, near)


def in_polygon(x: Column, y: Column, corners) -> Column:
    """Even-odd rule over a closed polygon given by its corners."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(corners, (*corners[1:], corners[0])):
        if y1 == y2:
            continue
        straddles = (F.lit(y1) > y) != (F.lit(y2) > y)
        left = x < (x2 - x1) * (y - y1) / (y2 - y1) + x1
        crossings = crossings + (straddles & left).cast("int")
    return crossings % 2 == 1
