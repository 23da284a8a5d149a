"""Curve fits to binned spectra: aggregates and expressions, no Python on the workers.

A linear fit is one aggregate of moment sums.  A non-linear one packs the bins
of a variant into one row; its steps are folded inside the row, each summing
the normal equations over the bins and solving three equations.  Variants are
independent rows of one job.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from muonloom.functions.guards import ratio
from muonloom.functions.linear import invert3, let, solve3


def log_parabola(hist: DataFrame, by: Sequence[str], x: Column, counts: Column) -> DataFrame:
    """Gaussian through ln(counts) = c + b x + a x^2, weighted by the counts.

    Needs only moment sums, so the whole fit is an aggregate: mean = -b / 2a,
    sigma = sqrt(-1 / 2a).  Groups with fewer than three filled bins, or that
    curve upwards, give NULL.
    """
    rows = hist.select(*by, x.alias("x"), counts.alias("w")).filter("w > 0").withColumn(
        "y", F.log("w"))
    powers = {f"s{k}": F.sum(F.col("w") * F.pow("x", F.lit(float(k)))) for k in range(5)}
    moments = {f"t{k}": F.sum(F.col("w") * F.col("y") * F.pow("x", F.lit(float(k))))
               for k in range(3)}
    m = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_bins"),
        *[v.alias(k) for k, v in {**powers, **moments}.items()])
    s0, s1, s2, s3, s4, t0, t1, t2 = (
        F.col(c) for c in ("s0", "s1", "s2", "s3", "s4", "t0", "t1", "t2"))
    det = s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2)
    top_b = s0 * (t1 * s4 - s3 * t2) - t0 * (s1 * s4 - s2 * s3) + s2 * (s1 * t2 - t1 * s2)
    top_a = s0 * (s2 * t2 - t1 * s3) - s1 * (s1 * t2 - t1 * s2) + t0 * (s1 * s3 - s2 * s2)
    ok = F.col("n_bins") >= 3
    m = m.withColumns({"b": F.when(ok, ratio(top_b, det)), "a": F.when(ok, ratio(top_a, det))})
    down = F.col("a") < 0
    return m.select(
        *by, "n_bins",
        F.when(down, -F.col("b") / (2 * F.col("a"))).alias("mean"),
        F.when(down, F.sqrt(-1 / (2 * F.col("a")))).alias("sigma"))


def exponential_livetime(gaps: DataFrame, by: Sequence[str] = (), t: str = "lo",
                         n: str = "n") -> DataFrame:
    """Livetime N * tau from a gap histogram, tau from ln(counts) = ln I0 - t / tau.

    The errors are those of the weighted line: ln(counts) has variance 1 / counts.
    """
    w, x, y = F.col(n).cast("double"), F.col(t), F.log(n)
    m = gaps.filter(F.col(n) > 0).groupBy(*by).agg(
        F.sum(w).alias("s0"), F.sum(w * x).alias("s1"), F.sum(w * x * x).alias("s2"),
        F.sum(w * y).alias("t0"), F.sum(w * x * y).alias("t1"))
    slope = ratio(F.col("s0") * F.col("t1") - F.col("s1") * F.col("t0"),
                  F.col("s0") * F.col("s2") - F.col("s1") * F.col("s1"))
    m = m.withColumn("slope", slope)
    tau = ratio(F.lit(-1.0), F.col("slope"))
    slope_err = F.sqrt(ratio(F.col("s0"), F.col("s0") * F.col("s2") - F.col("s1") * F.col("s1")))
    return m.select(*by, F.col("s0").alias("n_gaps"), tau.alias("tau"),
                    (tau * tau * slope_err).alias("tau_err"), (F.col("s0") * tau).alias("livetime"),
                    (F.col("s0") * tau * tau * slope_err).alias("livetime_err"))


#: Steps of a fit, damping at its start, and the factors it changes by after a worse and a better step.
STEPS, DAMP, UP, DOWN = 60, 1e-3, 10.0, 0.1
#: A fit has converged when the undamped step from its end is shorter than this share of its parameters.
CLOSE = 1e-6

#: A curve of x and three parameters: its value and its three derivatives.
Curve = Callable[[Column, Column, Column, Column], tuple[Column, Column, Column, Column]]


def gauss_curve(x: Column, a: Column, m: Column, s: Column):
    z = (x - m) / s
    e = F.exp(-z * z / 2.0)
    return a * e, e, a * e * z / s, a * e * z * z / s


def sigmoid_curve(x: Column, p0: Column, p1: Column, p2: Column):
    e = 1.0 / (1.0 + F.exp(F.least(F.lit(700.0), F.greatest(F.lit(-700.0), -p1 * (x - p2)))))
    slope = p0 * e * (1.0 - e)
    return p0 * e, e, slope * (x - p2), -slope * p1


def least_squares(points: DataFrame, start: DataFrame, curve: Curve, by: str, steps: int = STEPS) -> DataFrame:
    """Damped least squares of a three-parameter curve, one fit per value of ``by``.

    ``points``: (by, x, y, w), a few bins per variant; ``start``: (by, p0, p1, p2).
    Returns by, n, converged, cost, p0..p2 and their standard errors e0..e2 and
    covariances c01, c02, c12 from the curvature at the end, scaled by cost / (n - 3).

    The bins of a variant are packed into one array, so a step is arithmetic in
    one row: the sums of J'J and J'r run over the array, the three equations
    are solved with their diagonal raised by the damping, and the step is taken
    if the cost does not rise.  Steps are folded in ``aggregate``: there is one
    shuffle for the whole fit.

    The undamped step from the end, each parameter measured by its column of the
    Jacobian, tells whether there is a minimum there.  A variant whose parameters
    still run (no peak among its bins, a flat valley), whose equations are singular,
    or that has fewer points than parameters, has ``converged`` false and NULL results.
    """
    packed = points.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.array_sort(
        F.collect_list(F.struct("x", "y", "w"))).alias("points")).join(start, by)

    def normal(p: Sequence[Column]):
        """Array of cost, J'J (upper triangle by rows) and J'r."""

        def add(s, q):
            f, *j = curve(q["x"], *p)
            r, w = q["y"] - f, q["w"]
            terms = [w * r * r] + [w * j[a] * j[b] for a in range(3) for b in range(a, 3)] + [w * j[a] * r for a in range(3)]
            return F.array(*[s[i] + t for i, t in enumerate(terms)])

        return F.aggregate("points", F.array(*[F.lit(0.0)] * 10), add)

    # state: p0..p2, damping, then the sums at p (10 numbers)
    first = F.concat(F.array("p0", "p1", "p2", F.lit(DAMP)), normal([F.col(f"p{i}") for i in range(3)]))

    def step(s, _):
        damp = s[3]
        a = [s[5] * (1.0 + damp), s[6], s[7], s[8] * (1.0 + damp), s[9], s[10] * (1.0 + damp)]
        move = solve3(a, [s[11], s[12], s[13]])
        tried = F.array(*[s[i] + move[i] for i in range(3)])
        # a let-binding: the trial point is computed once and its sums from it
        both = F.transform(F.array(tried), lambda p: F.struct(p.alias("p"), normal([p[i] for i in range(3)]).alias("n")))
        return F.transform(both, lambda t: F.when(
            t["n"][0] <= s[4], F.concat(t["p"], F.array(F.greatest(damp * DOWN, F.lit(1e-12))), t["n"])).otherwise(
            F.concat(F.slice(s, 1, 3), F.array(F.least(damp * UP, F.lit(1e12))), F.slice(s, 5, 10))))[0]

    last = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), first, step)

    def ending(s):
        """Figures at the end of the steps, each computed once: a filter on one of them may repeat the expression."""
        scale = ratio(s[4], F.greatest(F.col("n") - 3, F.lit(1)).cast("double"))
        length = lambda v: sum((s[i] * x * x for i, x in zip((5, 8, 10), v)), F.lit(0.0))

        def figures(inverse, ahead):
            done = F.coalesce(length([ahead[i] for i in range(3)]) <= CLOSE * CLOSE * length([s[i] for i in range(3)]), F.lit(False))
            values = {"cost": s[4], **{f"p{i}": s[i] for i in range(3)},
                      **{f"e{i}": F.sqrt(F.greatest(inverse[k] * scale, F.lit(0.0))) for i, k in enumerate((0, 3, 5))},
                      **{name: inverse[k] * scale for name, k in (("c01", 1), ("c02", 2), ("c12", 4))}}
            return let(done, lambda ok: F.struct(
                ok.alias("converged"), *[F.when(ok, v).alias(name) for name, v in values.items()]))

        step = lambda v: F.array(*[sum((v[k] * s[11 + i] for i, k in enumerate(row)), F.lit(0.0))
                                   for row in ((0, 1, 2), (1, 3, 4), (2, 4, 5))])
        return let(F.array(*invert3([s[i] for i in range(5, 11)])), lambda v: let(step(v), lambda m: figures(v, m)))

    fitted = packed.withColumn("fit", F.when(F.col("n") >= 3, let(last, ending)))
    return fitted.select(by, "n", F.coalesce("fit.converged", F.lit(False)).alias("converged"), *[
        F.col(f"fit.{c}").alias(c) for c in ("cost", "p0", "p1", "p2", "e0", "e1", "e2", "c01", "c02", "c12")])


def gaussian_fit(hist: DataFrame, key: str, x: str, counts: str, steps: int = STEPS) -> DataFrame:
    """Least-squares Gaussian per group of filled bins: converged, amplitude, mean, sigma and their errors."""
    use = hist.filter(F.col(counts) > 0).select(
        key, F.col(x).cast("double").alias("x"), F.col(counts).cast("double").alias("y"), F.lit(1.0).alias("w"))
    m = use.groupBy(key).agg(F.max("y").alias("p0"), F.sum("y").alias("_n"), F.sum(F.col("x") * F.col("y")).alias("_x"),
                             F.sum(F.col("x") * F.col("x") * F.col("y")).alias("_xx"))
    mean = F.col("_x") / F.col("_n")
    spread = F.sqrt(F.greatest(F.col("_xx") / F.col("_n") - mean * mean, F.lit(0.0)))
    start = m.select(key, "p0", mean.alias("p1"), F.when(spread > 0, spread).otherwise(F.lit(1.0)).alias("p2"))
    f = least_squares(use, start, gauss_curve, key, steps)
    return f.select(key, "converged", F.col("p0").alias("amplitude"), F.col("p1").alias("mean"), F.abs("p2").alias("sigma"),
                    F.col("e0").alias("amplitude_err"), F.col("e1").alias("mean_err"), F.col("e2").alias("sigma_err"))


def sigmoid_fit(bins: DataFrame, lo: float = 5.4, hi: float = 7.0, steps: int = STEPS) -> DataFrame:
    """Sigmoid through the effective area of each variant, with parameter errors and covariances.

    ``bins``: (variant, log_energy, aeff, aeff_err); bins without an error and
    those outside [lo, hi] are not fitted.  The fit starts at the largest area.
    """
    good = F.col("log_energy").between(lo, hi) & (F.col("aeff_err") > 0)
    use = bins.filter(good).select("variant", F.col("log_energy").alias("x"), F.col("aeff").alias("y"),
                                   (1.0 / (F.col("aeff_err") * F.col("aeff_err"))).alias("w"))
    start = bins.groupBy("variant").agg(F.max("aeff").alias("p0")).select(
        "variant", "p0", F.lit(5.0).alias("p1"), F.lit(5.0).alias("p2"))
    return least_squares(use, start, sigmoid_curve, "variant", steps).drop("cost")
