"""Iterative Bayesian unfolding of many spectra at once.

One spectrum is a handful of bins; the work that grows is the number of
variants (model x particle x zenith band x season x tolerance).  A variant is
one row of arrays, and ``unfold`` iterates by expressions inside the row.  Its
history and the mixing matrix come from small groups.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from muonloom.functions import linear
from muonloom.functions.guards import ratio
from muonloom.session import cut_lineage

# group functions travel to the workers whole, so these need no installed copy
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MATRIX = "variant string, cause int, effect int, share double"
HISTORY = "variant string, iteration int, bin int, unfolded double, ks double"


def prior_column(kind: str, lo: Column, hi: Column, counts: Column | None = None,
                 model: Column | None = None) -> Column:
    """Unnormalised prior per bin."""
    if kind == "uniform":
        return F.lit(1.0)
    if kind == "jeffreys":
        return 1.0 / ((lo + hi) * 0.5)
    if kind == "counts":
        return counts.cast("double")
    if kind == "model":
        return model
    raise ValueError(kind)


def with_prior(bins: DataFrame, value: Column, name: str = "prior") -> DataFrame:
    """Normalise a prior over the bins of each variant."""
    out = bins.withColumn("_p", value)
    total = F.sum("_p").over(Window.partitionBy("variant"))
    return out.withColumn(name, ratio(F.col("_p"), total)).drop("_p")


def lift_empty_head(bins: DataFrame, value: str, empty: int = 2) -> DataFrame:
    """Give the first ``empty`` bins the value of the one after them (avoids log 0)."""
    anchor = F.max(F.when(F.col("bin") == empty, F.col(value))).over(
        Window.partitionBy("variant"))
    return bins.withColumn(value, F.when(F.col("bin") < empty, anchor).otherwise(F.col(value)))


def _divide(a, b):
    return np.divide(a, b, out=np.zeros(np.broadcast(a, b).shape), where=b != 0)


def smooth_log(n: np.ndarray, degree: int, groups: np.ndarray) -> np.ndarray:
    """Replace log10 n by a polynomial in the bin number, separately per group."""
    out = n.copy()
    x = np.arange(len(n), dtype=float)
    for g in np.unique(groups):
        use = (groups == g) & (n > 0)
        if use.sum() > degree:
            fit = np.polyfit(x[use], np.log10(n[use]), degree)
            out[use] = 10.0 ** np.polyval(fit, x[use])
    return out


def mixing(response: np.ndarray, eff: np.ndarray, n: np.ndarray) -> np.ndarray:
    """M[i, j]: share of effect j credited to cause i, for P[j, i] = response."""
    seen = response @ n
    top = (response * n).T
    return _divide(top, np.outer(eff, seen))


def ks_distance(a: np.ndarray, b: np.ndarray) -> float:
    sa, sb = a.sum(), b.sum()
    if sa == 0 or sb == 0:
        return 0.0
    return float(np.abs(np.cumsum(a) / sa - np.cumsum(b) / sb).max())


def iterate(response, eff, data, prior, tol: float, max_iter: int,
            smoother: Callable[[np.ndarray], np.ndarray] | None = None):
    """Yield (iteration, estimate, mixing matrix, ks) until ks < tol or max_iter."""
    n = prior * data.sum()
    for it in range(1, max_iter + 1):
        m = mixing(response, eff, n)
        new = m @ data
        ks = ks_distance(new, n)
        yield it, new, m, ks
        if ks < tol:
            return
        n = smoother(new) if smoother is not None else new


def unfolding_matrix(cells: DataFrame, bins: DataFrame, tol: float = 1e-3,
                     max_iter: int = 100) -> DataFrame:
    """(variant, cause, effect, share): the last iteration's share of each effect credited to each cause."""

    def solve(key: tuple, c: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if b.empty:
            return pd.DataFrame()
        response, _, eff, data, _, prior, b = _matrices(c, b)
        for _, _, m, _ in iterate(response, eff, data, prior, _settings(b, tol), max_iter):
            pass
        cause, effect = np.nonzero(m)
        names = b["bin"].to_numpy()
        return pd.DataFrame({"variant": key[0], "cause": names[cause], "effect": names[effect],
                             "share": m[cause, effect]})

    return _pair(cells, bins).applyInPandas(solve, MATRIX)


def _matrices(cells: pd.DataFrame, bins: pd.DataFrame):
    bins = bins.sort_values("bin")
    k = len(bins)
    response = np.zeros((k, k))
    error = np.zeros((k, k))
    response[cells["effect"], cells["cause"]] = cells["p"]
    error[cells["effect"], cells["cause"]] = cells["p_err"]
    vec = lambda c: bins[c].to_numpy(float)
    return response, error, vec("eff"), vec("data"), vec("data_err"), vec("prior"), bins


def _settings(bins: pd.DataFrame, tol: float) -> float:
    return float(bins["tol"].iloc[0]) if "tol" in bins else tol


def _pair(cells: DataFrame, bins: DataFrame):
    """Both tables grouped by variant; the aliases keep a shared origin unambiguous."""
    left = cells.select(F.col("variant").alias("variant"), "cause", "effect", "p", "p_err")
    rest = [c for c in bins.columns if c != "variant"]
    right = bins.select(F.col("variant").alias("variant"), *rest)
    return left.groupBy("variant").cogroup(right.groupBy("variant"))


def smooth_log_array(n: Column, flags: Column, degree: int) -> Column:
    """``n`` with log10 n replaced by a polynomial in the bin number, separately per value of ``flags``.

    Bins at or below 0 are neither fitted nor replaced; nor are groups without
    more such bins than the degree.  Bin numbers are centred and scaled.
    """
    middle = F.greatest((F.size(n) - 1) / F.lit(2.0), F.lit(1.0))
    place = lambda i: (i - middle) / middle
    points = F.transform(n, lambda v, i: F.struct(
        place(i).alias("x"), F.when(v > 0, F.log10(v)).alias("y"), F.lit(1.0).alias("w"), F.get(flags, i).alias("flag")))
    fitted = linear.let(points, lambda p: F.transform(F.array_distinct(flags), lambda g: F.struct(
        g.alias("flag"),
        linear.polynomial_fit(F.filter(p, lambda q: (q["flag"] == g) & q["y"].isNotNull()), degree).alias("c"))))
    return linear.let(fitted, lambda fs: F.transform(n, lambda v, i: linear.let(
        F.get(F.filter(fs, lambda f: f["flag"] == F.get(flags, i)), F.lit(0))["c"],
        lambda c: F.when((v > 0) & c.isNotNull(), F.pow(F.lit(10.0), linear.polynomial(c, place(i)))).otherwise(v))))


def _packed(cells: DataFrame, bins: DataFrame, tol: float, groups: str | None) -> DataFrame:
    """One row per variant: arrays over its bins and the response by effect and by cause, with its variance."""
    value = lambda c: F.col(c).cast("double")
    columns = {"data": value("data"), "data_err": value("data_err"), "prior": value("prior"), "eff": value("eff"),
               "tol": value("tol") if "tol" in bins.columns else F.lit(float(tol)),
               "eff_err": value("eff_err") if "eff_err" in bins.columns else F.lit(None).cast("double"),
               "flag": F.col(groups).cast("long") if groups else F.lit(1).cast("long")}
    rows = bins.groupBy("variant").agg(F.array_sort(F.collect_list(F.struct(
        F.col("bin").cast("int").alias("bin"), *[c.alias(n) for n, c in columns.items()]))).alias("b"))
    rows = rows.select("variant", *[F.col(f"b.{n}").alias(n) for n in ("bin", *columns)])
    entries = cells.groupBy("variant").agg(F.map_from_entries(F.collect_list(F.struct(
        F.struct(F.col("effect").cast("int").alias("e"), F.col("cause").cast("int").alias("c")),
        F.struct(value("p").alias("p"), value("p_err").alias("err"))))).alias("m"))
    k = F.sequence(F.lit(0), F.size("bin") - 1)
    at = lambda e, c, name: F.coalesce(F.col("m")[F.struct(e.alias("e"), c.alias("c"))][name], F.lit(0.0))
    square = lambda x: x * x
    return rows.join(entries, "variant", "left").withColumns({
        "by_effect": F.transform(k, lambda e: F.transform(k, lambda c: at(e, c, "p"))),
        "by_cause": F.transform(k, lambda c: F.transform(k, lambda e: at(e, c, "p"))),
        "var_by_effect": F.transform(k, lambda e: F.transform(k, lambda c: square(at(e, c, "err")))),
        "var_by_cause": F.transform(k, lambda c: F.transform(k, lambda e: square(at(e, c, "err"))))}).drop("m")


def _ks(a: Column, b: Column) -> Column:
    """Largest distance of two cumulated, normalised arrays; 0 if one of them sums to 0."""
    sa, sb = linear.total(a), linear.total(b)
    pairs = F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y")))

    def add(s, q):
        x, y = s["x"] + q["x"], s["y"] + q["y"]
        return F.struct(x.alias("x"), y.alias("y"), F.greatest(
            s["d"], F.abs(linear.divide_or_zero(x, s["sa"]) - linear.divide_or_zero(y, s["sb"]))).alias("d"),
            s["sa"].alias("sa"), s["sb"].alias("sb"))

    zero = F.lit(0.0)
    start = F.struct(zero.alias("x"), zero.alias("y"), zero.alias("d"), sa.alias("sa"), sb.alias("sb"))
    return linear.let(F.aggregate(pairs, start, add), lambda s: F.when(
        (s["sa"] == 0) | (s["sb"] == 0), F.lit(0.0)).otherwise(s["d"]))


def unfold(cells: DataFrame, bins: DataFrame, tol: float = 1e-3, max_iter: int = 100,
           degree: int | None = None, groups: str | None = None) -> DataFrame:
    """Unfold every variant.

    ``cells``: (variant, cause, effect, p, p_err).  ``bins``: (variant, bin,
    data, data_err, prior, eff) with bins numbered from 0, and optionally
    ``tol`` and ``eff_err``, which adds the efficiency's relative error to
    ``sys_err``.  With ``degree`` each estimate but the last is smoothed by a
    polynomial in log counts, per value of the ``groups`` column (whole numbers).

    A variant is one row of arrays; iterations are folded over its bins inside
    the row until the distance falls below the tolerance, so nothing leaves the
    engine and the whole job has one shuffle per table.
    """
    v = cut_lineage(_packed(cells, bins, tol, groups))
    start = F.transform("prior", lambda p: p * linear.total("data"))
    gain_of = lambda n: F.zip_with(n, "eff", linear.divide_or_zero)
    state = lambda it, est, used, last, ks: F.struct(
        it.alias("it"), est.alias("est"), used.alias("used"), last.alias("last"), ks.alias("ks"))

    def step(s, _):
        used = s["used"]
        pull = F.zip_with("data", F.transform("by_effect", lambda row: linear.dot(row, used)), linear.divide_or_zero)
        credit = linear.let(pull, lambda p: F.transform("by_cause", lambda column: linear.dot(column, p)))
        new = F.zip_with(gain_of(used), credit, lambda a, b: a * b)
        smooth = (lambda e: smooth_log_array(e, F.col("flag"), degree)) if degree is not None else (lambda e: e)
        after = linear.let(new, lambda e: state(s["it"] + 1, e, smooth(e), used, _ks(e, used)))
        return F.when(s["ks"] < F.get("tol", F.lit(0)), s).otherwise(after)

    first = state(F.lit(0), start, start, start, F.lit(math.inf))
    v = v.withColumn("s", F.aggregate(F.sequence(F.lit(1), F.lit(max_iter)), first, step))
    v = v.withColumns({"est": F.col("s.est"), "last": F.col("s.last"), "iterations": F.col("s.it"), "ks": F.col("s.ks")})
    v = cut_lineage(v.drop("s"))
    v = v.withColumn("seen", F.transform("by_effect", lambda row: linear.dot(row, "last")))
    v = v.withColumns({"pull": F.zip_with("data", "seen", linear.divide_or_zero), "gain": gain_of("last"),
                       # first-order change of what is seen with each response element of an effect
                       "through": F.transform("var_by_effect", lambda row: linear.dot(
                           row, F.transform("last", lambda n: n * n)))})
    v = v.withColumn("pull_seen", F.zip_with("pull", "seen", linear.divide_or_zero))
    indices = F.sequence(F.lit(0), F.size("bin") - 1)
    get = lambda name, i: F.get(name, i)

    def stat(i):
        share = lambda j: linear.divide_or_zero(get(get("by_cause", i), j) * get("last", i), get("eff", i) * get("seen", j))
        return F.sqrt(linear.total(F.transform(indices, lambda j: F.pow(share(j) * get("data_err", j), 2))))

    def response_error(i):
        def part(j):
            shared = get(get("by_cause", i), j) * get("pull_seen", j) * get("gain", i)
            direct = get("pull", j) * get("gain", i)
            own = (direct * direct - 2.0 * direct * shared * get("last", i)) * get(get("var_by_cause", i), j)
            return own + get("through", j) * shared * shared

        return F.sqrt(F.greatest(linear.total(F.transform(indices, part)), F.lit(0.0)))

    eff_part = lambda i: F.coalesce(get("est", i) * linear.divide_or_zero(get("eff_err", i), get("eff", i)), F.lit(0.0))
    rows = F.transform(indices, lambda i: F.struct(
        get("bin", i).alias("bin"), get("est", i).alias("unfolded"), stat(i).alias("stat_err"),
        F.hypot(response_error(i), eff_part(i)).alias("sys_err")))
    return v.select("variant", F.inline(rows), "iterations", "ks").select(
        "variant", "bin", "unfolded", "stat_err", "sys_err", "iterations", "ks")


def unfold_history(cells: DataFrame, bins: DataFrame, tol: float = 1e-3,
                   max_iter: int = 100) -> DataFrame:
    """The estimate after every iteration."""

    def solve(key: tuple, c: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if b.empty:
            return pd.DataFrame()
        response, _, eff, data, _, prior, b = _matrices(c, b)
        return pd.concat([
            pd.DataFrame({"variant": key[0], "iteration": it, "bin": b["bin"].to_numpy(),
                          "unfolded": n, "ks": ks})
            for it, n, _, ks in iterate(response, eff, data, prior, _settings(b, tol), max_iter)])

    return _pair(cells, bins).applyInPandas(solve, HISTORY)


def tolerance_variants(table: DataFrame, tolerances) -> DataFrame:
    """One copy of a (small, binned) variant per stopping tolerance, named by its number."""
    options = F.array(*[F.lit(float(t)) for t in tolerances])
    out = table.select("*", F.posexplode(options).alias("_number", "tol"))
    return out.withColumn("variant", F.concat_ws("|", "variant", "_number")).drop("_number")
