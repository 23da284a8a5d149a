"""Histograms, spectra, unfolding, fits and systematics on small tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from muonloom.functions import edges
from muonloom.operators import fits, hist, spectrum, systematics, unfold

E4 = [0.0, 1.0, 2.0, 3.0, 4.0]


def test_hist1d_edges_and_empty_bins(spark):
    data = [(0.0, 1.0), (0.5, 2.0), (4.0, 3.0), (-0.1, 9.0), (4.1, 9.0), (float("nan"), 9.0)]
    df = spark.createDataFrame(data, "x double, w double")
    h = {r.bin: r for r in hist.hist1d(df, F.col("x"), E4, F.col("w")).collect()}
    assert [h[b].sum_w for b in range(4)] == [3.0, 0.0, 0.0, 3.0]
    assert h[0].err == pytest.approx(math.sqrt(5)) and h[0].n == 2 and h[1].n == 0
    assert (h[3].lo, h[3].hi) == (3.0, 4.0)


def test_hist_does_not_depend_on_partitioning(spark, rows):
    df = spark.range(1000).select((F.col("id") % 37 / 9.0).alias("x"), F.lit(0.5).alias("w"))
    one = rows(hist.hist1d(df.coalesce(1), F.col("x"), E4, F.col("w")))
    many = rows(hist.hist1d(df.repartition(7), F.col("x"), E4, F.col("w")))
    assert one == many


def test_identical_samples_compare_to_one(spark):
    df = spark.range(500).select((F.col("id") % 40 / 10.0).alias("x"), F.lit(2.0).alias("w"))
    h = hist.normalise(hist.hist_many(df, {"x": (F.col("x"), E4)}, F.col("w")), ["var"])
    c = hist.compare(h, h, ["var", "bin"]).collect()
    assert len(c) == 4 and all(r.ratio == 1.0 for r in c)
    both = h.withColumn("sample", F.lit("data")).unionByName(h.withColumn("sample", F.lit("mc")))
    assert all(r.ratio == 1.0 for r in hist.compare_samples(both, ["var", "bin"], "sample").collect())


def test_spread_drops_small_bins(spark):
    rng = np.random.default_rng(4)
    v, w = rng.normal(2, 0.5, 6), rng.uniform(1, 2, 6)
    data = [(4.1, float(a), float(b)) for a, b in zip(v, w)] + [(4.3, 1.0, 1.0)] * 5
    df = spark.createDataFrame(data, "loge double, v double, w double")
    got = hist.resolution(df, F.col("loge"), F.col("v"), F.col("w"), edges.RESOLUTION_EDGES).collect()
    mean = np.average(v, weights=w)
    assert len(got) == 1 and got[0].n == 6
    assert got[0].sigma == pytest.approx(math.sqrt(np.average((v - mean) ** 2, weights=w)))


def test_mean_energy_falls_back_to_the_centre(spark):
    df = spark.createDataFrame([(4.1, 2.0), (4.15, 1.0)], "e double, w double")
    got = {r.bin: r.mean_e for r in spectrum.mean_true_energy(
        df, F.col("e"), F.col("w"), edges.LOGE_EDGES).collect()}
    assert got[0] == pytest.approx((2 * 10 ** 4.1 + 10 ** 4.15) / 3)
    assert got[1] == pytest.approx(10 ** 4.3) and len(got) == 17


def test_generated_weights_return_the_flux(spark):
    rng = np.random.default_rng(8)
    e = 10 ** rng.uniform(5.0, 7.0, 20000)
    df = spark.createDataFrame([(2212, float(v)) for v in e], "pdg long, energy double")
    w = spectrum.composition_weights(df, df, edges.LOGE_EDGES_FINE, ["h4a"])
    check = spectrum.generator_check(w, edges.LOGE_EDGES_FINE, "h4a", "weight_all_h4a")
    assert all(0.95 < r.ratio < 1.1 for r in check.collect())


def test_response_columns_sum_to_efficiency(spark):
    rng = np.random.default_rng(9)
    t = rng.uniform(0, 4, 3000)
    data = [(float(a), float(b), 1.5) for a, b in zip(t, t + rng.normal(0, 0.6, 3000))]
    df = spark.createDataFrame(data, "t double, p double, w double").withColumn("v", F.lit("a"))
    m = spectrum.response_matrix(df, F.col("p"), F.col("t"), F.col("w"), E4, by=["v"])
    for r in m.groupBy("cause").agg(F.sum("p").alias("s"), F.max("eff").alias("e")).collect():
        assert r.s == pytest.approx(r.e) and r.e <= 1.0


def _bins(spark, data, eff, prior, variant="v"):
    k = len(data)
    return spark.createDataFrame(
        [(variant, i, float(data[i]), math.sqrt(data[i]), float(prior[i]), float(eff[i]))
         for i in range(k)],
        "variant string, bin int, data double, data_err double, prior double, eff double")


def _cells(spark, p, variant="v"):
    k = len(p)
    return spark.createDataFrame(
        [(variant, c, e, float(p[e][c]), 0.01) for c in range(k) for e in range(k)],
        "variant string, cause int, effect int, p double, p_err double")


def test_identity_response_returns_the_data(spark):
    data = [100.0, 50.0, 20.0]
    out = unfold.unfold(_cells(spark, np.eye(3)), _bins(spark, data, [1] * 3, [1 / 3] * 3)).collect()
    assert [r.unfolded for r in sorted(out, key=lambda r: r.bin)] == pytest.approx(data)
    assert all(r.stat_err == pytest.approx(math.sqrt(data[r.bin])) for r in out)


def test_closure_and_tolerance_order(spark):
    truth = np.array([1000.0, 600.0, 300.0, 100.0])
    p = np.array([[0.7, 0.15, 0, 0], [0.2, 0.6, 0.2, 0], [0, 0.15, 0.6, 0.2], [0, 0, 0.1, 0.7]])
    eff = p.sum(axis=0)
    cells = _cells(spark, p)
    bins = _bins(spark, p @ truth, eff, [0.25] * 4)
    exact = unfold.unfold(cells, bins, tol=1e-12, max_iter=5000).collect()
    assert [r.unfolded for r in sorted(exact, key=lambda r: r.bin)] == pytest.approx(truth, rel=1e-3)
    tols = [1e-2, 1e-3, 1e-4, 1e-5]
    scan = unfold.unfold(unfold.tolerance_variants(cells, tols), unfold.tolerance_variants(bins, tols))
    its = {r.variant: r.iterations for r in scan.collect()}
    ordered = [its[f"v|{i}"] for i in range(len(tols))]
    assert ordered == sorted(ordered) and ordered[0] < ordered[-1]
    history = unfold.unfold_history(cells, bins, tol=0.0, max_iter=4)
    assert history.select("iteration").distinct().count() == 4


def test_unfolding_errors_match_finite_differences(spark):
    truth = np.array([500.0, 200.0, 80.0])
    p = np.array([[0.7, 0.2, 0.05], [0.2, 0.6, 0.2], [0.05, 0.1, 0.6]])
    eff, data, prior = p.sum(axis=0), None, np.full(3, 1 / 3)
    data = p @ truth
    row = {r.bin: r for r in unfold.unfold(_cells(spark, p), _bins(spark, data, eff, prior),
                                           tol=0.0, max_iter=1).collect()}
    n0 = prior * data.sum()
    base = unfold.mixing(p, eff, n0) @ data
    var = np.zeros(3)
    for j in range(3):
        for i in range(3):
            q = p.copy()
            q[j, i] += 1e-6
            var += ((unfold.mixing(q, eff, n0) @ data - base) / 1e-6 * 0.01) ** 2
    for i in range(3):
        assert row[i].unfolded == pytest.approx(base[i])
        assert row[i].sys_err == pytest.approx(math.sqrt(var[i]), rel=1e-3)


def test_smoothing_keeps_a_power_law():
    n = 1000.0 * 10.0 ** (-0.3 * np.arange(10))
    noisy = n * (1 + 0.05 * (-1.0) ** np.arange(10))
    assert np.abs(np.log(unfold.smooth_log(n, 3, np.ones(10)) / n)).max() < 1e-9
    smooth = unfold.smooth_log(noisy, 2, np.ones(10))
    assert np.abs(np.log(smooth / n)).max() < np.abs(np.log(noisy / n)).max()


def test_gaussian_and_sigmoid_fits(spark):
    x = np.linspace(-2, 2, 41)
    y = 30 * np.exp(-((x - 0.3) ** 2) / (2 * 0.4 ** 2))
    h = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(x, y)],
                              "k int, x double, n double")
    g = fits.gaussian_fit(h, "k", "x", "n").first()
    assert (g["mean"], g.sigma, g.amplitude) == pytest.approx((0.3, 0.4, 30.0), rel=1e-6)
    q = fits.log_parabola(h, ["k"], F.col("x"), F.col("n")).first()
    assert (q["mean"], q.sigma) == pytest.approx((0.3, 0.4), rel=1e-6)
    e = np.linspace(5.5, 6.9, 8)
    a = 2e5 / (1 + np.exp(-6 * (e - 5.9)))
    b = spark.createDataFrame([("s", float(u), float(v), 10.0) for u, v in zip(e, a)],
                              "variant string, log_energy double, aeff double, aeff_err double")
    s = fits.sigmoid_fit(b).first()
    assert (s.p0, s.p1, s.p2) == pytest.approx((2e5, 6.0, 5.9), rel=1e-5)


def test_livetime_of_an_exponential(spark):
    lo = np.linspace(0, 2, 153)[:-1]
    n = np.round(1e6 * np.exp(-lo / 0.2)).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(lo, n) if b > 0],
                               "lo double, n long")
    r = fits.exponential_livetime(df).first()
    assert r.tau == pytest.approx(0.2, rel=1e-3)
    assert r.livetime == pytest.approx(n.sum() * r.tau)


def test_envelope_and_totals(spark):
    s = spark.createDataFrame([(0, "a", -0.2), (0, "b", 0.1), (1, "a", 0.3), (1, "b", 0.1)],
                              "bin int, variant string, shift double")
    e = {r.bin: (r.sys_low, r.sys_high) for r in systematics.envelope(s, "shift").collect()}
    assert e == {0: (0.2, 0.1), 1: (0.0, 0.3)}
    src = spark.createDataFrame(
        [(0, "area", 3.0, 3.0), (0, "pressure", 1.0, 1.0), (0, "temperature", -3.0, 3.0)],
        "bin int, source string, sys_low double, sys_high double")
    t = systematics.total(src).first()
    assert (t.sys_low, t.sys_high) == (5.0, 5.0)


def test_temperature_and_pressure(spark):
    rows = [(0, "a", 10.0, 1.0), (0, "b", 11.0, 1.0), (0, "c", 12.0, 2.0)]
    df = spark.createDataFrame(rows, "bin int, season string, flux double, stat double")
    t = systematics.temperature(df, ["a", "b", "c"]).first()
    assert t.sys_low == pytest.approx(-1 / 11) and t.sys_high == pytest.approx(1 / 11)
    p = systematics.pressure(df, "b", "a").first()
    assert p.change == pytest.approx(-1 / 11) and p.correction == pytest.approx(1 - 1 / 11)


def test_area_shift_covers_all_sign_choices(spark):
    bins = spark.createDataFrame([("v", 0, 5.5, 90.0)],
                                 "variant string, bin int, log_energy double, aeff double")
    par = spark.createDataFrame([("v", 100.0, 5.0, 5.0, 10.0, 0.5, 0.1)],
                                "variant string, p0 double, p1 double, p2 double, "
                                "e0 double, e1 double, e2 double")
    r = systematics.area_shift(bins, par).first()
    curve = lambda a, b, c: a / (1 + math.exp(-b * (5.5 - c)))
    every = [90.0] + [curve(100 + s * i * 10, 5 + s * j * 0.5, 5 + s * k * 0.1)
                      for i in (0, 1) for j in (0, 1) for k in (0, 1) for s in (1, -1)]
    assert r.sys_low == pytest.approx(90 / min(every) - 1)
    assert r.sys_high == pytest.approx(1 - 90 / max(every))


def test_half_bins(spark, rows):
    df = spark.createDataFrame([("v", 0, 1.0), ("v", 1, 3.0)], "v string, bin int, y double")
    assert rows(spectrum.half_bins(df, ["v"], "y")) == [
        ("v", 0, 1.0), ("v", 1, 2.0), ("v", 2, 3.0), ("v", 3, 3.0)]


def test_log_log_interpolation(spark):
    tab = spark.createDataFrame([(x, 10 ** (-2.7 * x)) for x in (4.0, 4.3, 5.1, 6.0)],
                                "log_energy double, flux double")
    at = spark.createDataFrame([(4.0,), (4.29,), (5.5,), (6.0,), (3.9,)], "log_energy double")
    got = {r.log_energy: r.flux_at for r in spectrum.log_log_interpolate(at, tab).collect()}
    assert set(got) == {4.0, 4.29, 5.5}
    assert all(v == pytest.approx(10 ** (-2.7 * x)) for x, v in got.items())


def test_flux_and_its_error_by_hand(spark):
    """100 events, area 1000 m2, cosine 0.8..1, 50 s, one bin of width 0.2."""
    from muonloom.operators.spectrum import ZenithWindow, flux_error, flux_from_counts

    window = ZenithWindow(0.8, 1.0)
    assert window.solid_angle == pytest.approx(math.pi * 0.36)
    n, lo, hi = F.lit(100.0), F.lit(5.0), F.lit(5.2)
    row = spark.range(1).select(
        flux_from_counts(n, lo, hi, F.lit(1000.0), window, 50.0).alias("f"),
        flux_error(n, F.lit(10.0), F.lit(1000.0), F.lit(30.0), lo, hi, window, 50.0).alias("e")).first()
    flux = 100 / (0.2 * math.log(10) * 1000 * math.pi * 0.36 * 50)
    assert row.f == pytest.approx(flux)
    assert row.e == pytest.approx(flux * math.sqrt(0.1 ** 2 + 0.03 ** 2))


def test_response_errors_are_standard_errors(spark):
    from muonloom.operators.spectrum import response_matrix

    df = spark.createDataFrame([(4.1, 4.1, 2.0), (4.1, 4.1, 4.0), (4.3, 4.1, 4.0)], "r double, t double, w double")
    cells = lambda **k: {(c.cause, c.effect): (c.p, c.p_err) for c in response_matrix(
        df, F.col("r"), F.col("t"), F.col("w"), [4.0, 4.2, 4.4], **k).filter("p > 0").collect()}
    assert np.allclose([cells()[0, 0], cells()[0, 1]], [[0.6, math.sqrt(20) / 10], [0.4, 0.4]])
    assert np.allclose(cells(legacy_error=True)[0, 1], [0.4, 1.6])


def test_spread_of_large_values(spark):
    df = spark.createDataFrame([(1, 1e9 + i, 1.0 + i % 2) for i in range(10)], "g int, v double, w double")
    r = hist.weighted_spread(df, ["g"], F.col("v"), F.col("w")).first()
    v, w = np.arange(10.0), 1.0 + np.arange(10) % 2
    mean = (v * w).sum() / w.sum()
    assert r.mean == pytest.approx(1e9 + mean, rel=1e-15)
    assert r.sigma == pytest.approx(math.sqrt((w * (v - mean) ** 2).sum() / w.sum()), rel=1e-9)


def test_array_variables(spark):
    df = spark.createDataFrame([(0.5, [0.5, 1.5, None], 2.0), (1.5, [], 3.0), (9.0, None, 1.0)],
                               "x double, a array<double>, w double")
    h = hist.hist_many(df, {"x": (F.col("x"), E4)}, F.col("w"), arrays={"a": (F.col("a"), E4)})
    got = sorted((r["var"], r.bin, r.lo, r.sum_w, r.n) for r in h.collect())
    assert got == [("a", 0, 0.0, 2.0, 1), ("a", 1, 1.0, 2.0, 1), ("x", 0, 0.0, 2.0, 1), ("x", 1, 1.0, 3.0, 1)]


def test_unfolding_matrix_and_efficiency_error(spark):
    cells = spark.createDataFrame([("v", i, i, 0.5, 0.0) for i in range(3)],
                                  "variant string, cause int, effect int, p double, p_err double")
    bins = spark.createDataFrame([("v", i, 10.0 * (i + 1), 1.0, 1 / 3, 0.5, 0.05) for i in range(3)],
                                 "variant string, bin int, data double, data_err double, prior double, eff double, "
                                 "eff_err double")
    m = {(r.cause, r.effect): r.share for r in unfold.unfolding_matrix(cells, bins).collect()}
    assert m == {(i, i): pytest.approx(2.0) for i in range(3)}
    out = {r.bin: r for r in unfold.unfold(cells, bins).collect()}
    assert [out[i].unfolded for i in range(3)] == pytest.approx([20.0, 40.0, 60.0])
    assert [out[i].sys_err for i in range(3)] == pytest.approx([2.0, 4.0, 6.0])


def test_tolerances_keep_apart(spark):
    names = unfold.tolerance_variants(spark.createDataFrame([("a",)], "variant string"), (1.5e-3, 2e-3))
    assert names.select("variant").distinct().count() == 2


def _curve_fit(f, jac, x, y, w, p):
    """Plain Gauss-Newton to convergence; parameters and covariance by numpy.linalg.inv."""
    p = np.array(p, float)
    for _ in range(200):
        j = jac(x, *p)
        p = p + np.linalg.solve(j.T @ (w[:, None] * j), j.T @ (w * (y - f(x, *p)))) * 0.5
    j = jac(x, *p)
    cost = (w * (y - f(x, *p)) ** 2).sum()
    return p, np.linalg.inv(j.T @ (w[:, None] * j)) * cost / (len(x) - 3)


def test_sigmoid_fit_errors_are_those_of_the_inverse(spark):
    rng = np.random.default_rng(3)
    f = lambda x, a, b, c: a / (1 + np.exp(-b * (x - c)))

    def jac(x, a, b, c):
        s = 1 / (1 + np.exp(-b * (x - c)))
        return np.column_stack([s, a * s * (1 - s) * (x - c), -a * s * (1 - s) * b])

    x = np.linspace(4.2, 6.9, 15)
    rows, want = [], {}
    for name, true in (("a", (3e5, 4.0, 5.6)), ("b", (2e5, 6.0, 5.2))):
        e = 0.03 * f(x, *true) + 100
        y = f(x, *true) + rng.normal(size=15) * e
        want[name] = _curve_fit(f, jac, x, y, 1 / e ** 2, true)
        rows += [(name, float(u), float(v), float(q)) for u, v, q in zip(x, y, e)]
    rows += [("few", 5.0, 1.0, 1.0), ("few", 5.5, 2.0, 1.0), ("none", 5.0, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "variant string, log_energy double, aeff double, aeff_err double")
    got = {r.variant: r for r in fits.sigmoid_fit(df, 4.0, 7.0).collect()}
    assert set(got) == {"a", "b", "few"} and got["few"].p0 is None and got["few"].e2 is None
    for name, (p, cov) in want.items():
        g = got[name]
        assert (g.p0, g.p1, g.p2) == pytest.approx(tuple(p), rel=1e-6)
        assert (g.e0, g.e1, g.e2) == pytest.approx(tuple(np.sqrt(np.diag(cov))), rel=1e-5)
        assert (g.c01, g.c02, g.c12) == pytest.approx((cov[0, 1], cov[0, 2], cov[1, 2]), rel=1e-4)


def test_a_fit_without_a_minimum_says_so(spark):
    """A slope without a peak and two points give no figures; a peak beside them does."""
    x = np.linspace(-1, 1, 9)
    shapes = {"slope": np.exp(-3 * x), "peak": 9 * np.exp(-x * x / 0.18) + 0.1 * np.cos(9 * x) + 0.2}
    rows = [(k, float(a), float(b)) for k, y in shapes.items() for a, b in zip(x, y)] + [("two", 0.0, 1.0), ("two", 1.0, 2.0)]
    f = fits.gaussian_fit(spark.createDataFrame(rows, "k string, x double, n double"), "k", "x", "n")
    got = {r.k: r for r in f.collect()}
    assert {k: r.converged for k, r in got.items()} == {"slope": False, "peak": True, "two": False}
    figures = ("amplitude", "mean", "sigma", "amplitude_err", "mean_err", "sigma_err")
    for k, r in got.items():
        assert all((r[c] is not None) == (k == "peak") for c in figures)


def test_fits_and_unfolding_run_without_python_workers(spark):
    b = spark.createDataFrame([("s", 5.0 + i / 10, 1.0 + i, 1.0) for i in range(5)],
                              "variant string, log_energy double, aeff double, aeff_err double")
    h = spark.createDataFrame([(1, i / 10, float(i)) for i in range(5)], "k int, x double, n double")
    u = unfold.unfold(_cells(spark, np.eye(3)), _bins(spark, [1.0, 2, 3], [1] * 3, [1 / 3] * 3), degree=1)
    for df in (fits.sigmoid_fit(b), fits.gaussian_fit(h, "k", "x", "n"), u):
        assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("degree", [None, 2])
def test_unfolding_by_expressions_matches_numpy(spark, degree):
    rng, k = np.random.default_rng(1), 9
    cells, bins, want, zone = [], [], {}, np.arange(k) // 5
    for v in "abc":
        p = np.eye(k) * 0.6 + rng.random((k, k)) * 0.06
        if v == "c":
            p[:, 3] = 0  # a cause that is never seen
        eff, err = p.sum(axis=0), p * 0.1
        data = np.round(p @ (1e4 * np.exp(-np.arange(k) * 0.6)))
        if v == "b":
            data[-1] = 0
        prior = np.full(k, 1 / k)
        cells += [(v, c, e, float(p[e, c]), float(err[e, c])) for c in range(k) for e in range(k) if p[e, c] > 0]
        bins += [(v, i, float(data[i]), float(data[i] ** 0.5), float(prior[i]), float(eff[i]), float(eff[i] * 0.05),
                  int(zone[i])) for i in range(k)]
        smooth = (lambda n: unfold.smooth_log(n, degree, zone)) if degree else (lambda n: n)
        used = prior * data.sum()
        for it, n, m, ks in unfold.iterate(p, eff, data, prior, 1e-4, 40, smooth):
            last, used = used, smooth(n)
        # errors from numerical derivatives of one step
        step = lambda r: unfold.mixing(r, eff, last) @ data
        var = np.zeros(k)
        for e, c in zip(*np.nonzero(p)):
            up, down = p.copy(), p.copy()
            up[e, c] += 1e-6
            down[e, c] -= 1e-6
            var += ((step(up) - step(down)) / 2e-6 * err[e, c]) ** 2
        stat = np.sqrt((m ** 2) @ data)
        part = n * unfold._divide(eff * 0.05, eff)
        want[v] = it, ks, n, stat, np.sqrt(var + part ** 2)
    out = unfold.unfold(
        spark.createDataFrame(cells, "variant string, cause int, effect int, p double, p_err double"),
        spark.createDataFrame(bins, "variant string, bin int, data double, data_err double, prior double, eff double, "
                                    "eff_err double, zone int"),
        1e-4, 40, degree, "zone" if degree else None).orderBy("variant", "bin").collect()
    for v, (it, ks, *arrays) in want.items():
        got = [r for r in out if r.variant == v]
        assert [r.bin for r in got] == list(range(k)) and {r.iterations for r in got} == {it}
        assert got[0].ks == pytest.approx(ks, rel=1e-9, abs=1e-12)
        for name, values, rel in zip(("unfolded", "stat_err", "sys_err"), arrays, (1e-9, 1e-9, 1e-4)):
            assert [r[name] for r in got] == pytest.approx(list(values), rel=rel, abs=1e-6)


def _natural_spline(x, y, at):
    """Plain version: the whole tridiagonal system by numpy."""
    n, h = len(x), np.diff(x)
    a, b = np.eye(n), np.zeros(n)
    for i in range(1, n - 1):
        a[i, i - 1:i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        b[i] = 6 * ((y[i + 1] - y[i]) / h[i] - (y[i] - y[i - 1]) / h[i - 1])
    m = np.linalg.solve(a, b)
    i = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
    u, v = (x[i + 1] - at) / h[i], (at - x[i]) / h[i]
    return u * y[i] + v * y[i + 1] + ((u ** 3 - u) * m[i] + (v ** 3 - v) * m[i + 1]) * h[i] ** 2 / 6


def test_spline_is_natural_and_cubic(spark):
    rng = np.random.default_rng(8)
    x = np.sort(rng.uniform(4, 7, 12))
    flux = 10 ** (-2.7 * x + np.sin(3 * x) + 10)
    tables = [("long", float(a), float(b)) for a, b in zip(x, flux)][::-1]
    tables += [("two", 5.0, 1e-3), ("two", 6.0, 1e-5), ("one", 5.0, 1.0)]
    at = np.concatenate([np.linspace(x[0], x[-1], 40), [x[5], x[0] - 0.1, x[-1] + 0.1]])
    points = [(n, float(a)) for n in ("long", "two", "one") for a in at]
    out = spectrum.spline_interpolate(
        spark.createDataFrame(points, "name string, log_energy double"),
        spark.createDataFrame(tables, "name string, log_energy double, flux double"), ["name"])
    got = {(r.name, r.log_energy): r.flux_at for r in out.collect()}
    inside = [a for a in at if x[0] <= a <= x[-1]]
    want = _natural_spline(x, np.log10(flux), np.array(inside))
    for a, v in zip(inside, want):
        assert got["long", a] == pytest.approx(10 ** v, rel=1e-9)
    straight = {a: 10 ** (-3 - 2 * (a - 5)) for a in at if 5 <= a <= 6}
    assert {a: v for (n, a), v in got.items() if n == "two"} == pytest.approx(straight, rel=1e-9)
    assert not any(n == "one" for n, _ in got) and len(got) == len(set(inside)) + len(straight)
