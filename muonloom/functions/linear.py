"""Small linear systems as expressions over columns and arrays."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F

from muonloom.functions.guards import ratio


def cofactors3(a: Sequence[Column]) -> tuple[list[Column], Column]:
    """Cofactors and determinant of a symmetric 3x3 matrix given as (a00, a01, a02, a11, a12, a22)."""
    a00, a01, a02, a11, a12, a22 = a
    c = [a11 * a22 - a12 * a12, a02 * a12 - a01 * a22, a01 * a12 - a02 * a11,
         a00 * a22 - a02 * a02, a01 * a02 - a00 * a12, a00 * a11 - a01 * a01]
    return c, a00 * c[0] + a01 * c[1] + a02 * c[2]


def invert3(a: Sequence[Column]) -> list[Column]:
    """Inverse of a symmetric 3x3 matrix, upper triangle by rows; NULL if it is singular."""
    c, det = cofactors3(a)
    return [ratio(x, det) for x in c]


def solve3(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    """Solution of a symmetric 3x3 system; zeros if it is singular."""
    c, det = cofactors3(a)
    rows = ((0, 1, 2), (1, 3, 4), (2, 4, 5))
    return [F.coalesce(ratio(sum((c[k] * x for k, x in zip(row, b)), F.lit(0.0)), det), F.lit(0.0)) for row in rows]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, inside a row function."""
    return F.transform(F.array(value), body)[0]


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def total(a: Column | str) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def divide_or_zero(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def eliminate(rows: Column, size: int) -> Column:
    """Solution of a positive definite system given as ``size`` rows of coefficients with the right side at the end.

    Gauss-Jordan elimination: one pivot row after another is folded over the rows.
    """

    def pivot(m, k):
        top = F.get(m, k)
        return let(F.transform(top, lambda v: v / F.get(top, k)), lambda p: F.transform(
            m, lambda r, i: F.when(i == k, p).otherwise(F.zip_with(r, p, lambda v, q: v - q * F.get(r, k)))))

    done = F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), rows, pivot)
    return F.transform(done, lambda r: F.get(r, F.lit(size)))


def polynomial_fit(points: Column, degree: int) -> Column:
    """Coefficients, lowest first, of weighted least squares through an array of (x, y, w).

    NULL if there are no more points than the degree.  The moment sums of the
    normal equations are one fold over the points.
    """
    n_powers, size = 2 * degree + 1, degree + 1

    def terms(q):
        powers = [q["w"] if k == 0 else q["w"] * F.pow(q["x"], F.lit(float(k))) for k in range(n_powers)]
        return F.array(*powers, *[powers[k] * q["y"] for k in range(size)])

    sums = F.aggregate(points, F.array(*[F.lit(0.0)] * (n_powers + size)),
                       lambda s, q: F.zip_with(s, terms(q), lambda a, b: a + b))
    solved = let(sums, lambda s: eliminate(F.array(*[
        F.array(*[s[a + b] for b in range(size)], s[n_powers + a]) for a in range(size)]), size))
    return F.when(F.size(points) > degree, solved)


def polynomial(coefficients: Column, x: Column) -> Column:
    """Value of a polynomial, coefficients lowest first."""
    return F.aggregate(F.reverse(coefficients), F.lit(0.0), lambda s, c: s * x + c)
