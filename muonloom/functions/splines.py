"""Natural cubic splines as expressions over ordered arrays."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from muonloom.functions.linear import let


def curvatures(x: Column, y: Column) -> Column:
    """Second derivatives at the knots of the natural cubic spline through ascending ``x`` and ``y``.

    The tridiagonal system is solved by one forward sweep, an ``aggregate``
    that appends (c, d) of each inner row, and one backward sweep over the
    reversed rows.  Fewer than three knots give zeros: a straight line.
    """
    n = F.size(x)
    inner = F.when(n > 2, F.sequence(F.lit(1), n - 2)).otherwise(F.array().cast("array<int>"))
    at = lambda a, i: F.get(a, i)

    def forward(s, i):
        left, right = at(x, i) - at(x, i - 1), at(x, i + 1) - at(x, i)
        value = 6.0 * ((at(y, i + 1) - at(y, i)) / right - (at(y, i) - at(y, i - 1)) / left)
        last = F.element_at(s, -1)
        pivot = 2.0 * (left + right) - left * last["c"]
        return F.concat(s, F.array(F.struct((right / pivot).alias("c"), ((value - left * last["d"]) / pivot).alias("d"))))

    zero = F.lit(0.0)
    swept = F.aggregate(inner, F.array(F.struct(zero.alias("c"), zero.alias("d"))), forward)
    # the first entry is the row before the inner ones; curvature is 0 at both ends
    back = F.aggregate(F.reverse(F.slice(swept, F.lit(2), F.greatest(F.size(swept) - 1, F.lit(0)))), F.array(zero),
                       lambda s, q: F.concat(s, F.array(q["d"] - q["c"] * F.element_at(s, -1))))
    return F.concat(F.array(zero), F.reverse(back))


def spline_value(x: Column, y: Column, m: Column, at: Column) -> Column:
    """Spline with curvatures ``m`` at ``at``; NULL outside the knots."""
    n = F.size(x)
    # the last knot not above the point, but for the upper end
    number = F.least(F.size(F.filter(x, lambda v: v <= at)), n - 1) - 1

    def value(i):
        x0, x1, y0, y1 = F.get(x, i), F.get(x, i + 1), F.get(y, i), F.get(y, i + 1)
        h = x1 - x0
        a, b = (x1 - at) / h, (at - x0) / h
        return a * y0 + b * y1 + ((a * a * a - a) * F.get(m, i) + (b * b * b - b) * F.get(m, i + 1)) * h * h / 6.0

    inside = (at >= F.get(x, F.lit(0))) & (at <= F.element_at(x, -1)) & (n > 1)
    return F.when(inside, let(number, value))
