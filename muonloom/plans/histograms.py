"""Registered queries: histograms, data/simulation comparison, resolutions, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from muonloom.functions import directions, edges
from muonloom.operators import fits, hist, ml, pulses, spectrum
from muonloom.plans.fit_sql import GAUSS, fit_ctes
from muonloom.plans.registry import edges_sql, G, g, in_bin, query, R, r
from muonloom.plans.views import KEY, TIES

LOGE = edges.LOGE_EDGES
_B = edges_sql(LOGE)


@query("hist1d", f"""
    WITH b AS {_B}
    SELECT bin, lo, hi, {G('coalesce(SUM(w), 0)')} AS sum_w, {G('coalesce(sqrt(SUM(w * w)), 0)')} AS err,
           COUNT(event_id) AS n
    FROM b LEFT JOIN evt ON {in_bin('loge')} GROUP BY bin, lo, hi""", "evt")
def hist1d(t):
    h = hist.hist1d(t.evt, F.col("loge"), LOGE, F.col("w"))
    return h.select("bin", "lo", "hi", g("sum_w").alias("sum_w"), g("err").alias("err"), "n")


@query("hist2d", f"""
    WITH b AS {_B}
    SELECT b.bin AS bin_x, c.bin AS bin_y, {G('SUM(w)')} AS sum_w, {G('SUM(w * w)')} AS sum_w2,
           COUNT(*) AS n
    FROM evt JOIN b ON {in_bin('loge_p')} JOIN b c ON {in_bin('loge', 'c')} GROUP BY b.bin, c.bin
    """, "evt")
def hist2d(t):
    h = hist.hist2d(t.evt, F.col("loge_p"), F.col("loge"), LOGE, LOGE, F.col("w"))
    return h.select("bin_x", "bin_y", g("sum_w").alias("sum_w"), g("sum_w2").alias("sum_w2"), "n")


@query("hist_pulse", f"""
    WITH b AS {edges_sql(edges.CHARGE_EDGES)}
    SELECT bin, lo, hi, {G('SUM(w)')} AS sum_w, {G('sqrt(SUM(w * w))')} AS err, COUNT(*) AS n
    FROM pulse JOIN evt USING (event_id) JOIN b ON {in_bin('charge')} GROUP BY bin, lo, hi
    """, "pulse evt")
def hist_pulse(t):
    h = hist.hist_pulses(t.pulse, t.evt, edges.CHARGE_EDGES, KEY, "w")
    return h.select("bin", "lo", "hi", g("sum_w").alias("sum_w"), g("err").alias("err"), "n")


_VARS = {
    "cogx": ("x", "x", edges.linspace(-600, 600, 81)),
    "cogy": ("y", "y", edges.linspace(-600, 600, 81)),
    "planezen": ("degrees(zenith)", "degrees(zenith)", edges.linspace(-5, 90, 20)),
    "planeazi": ("degrees(azimuth) + 0.5e0", "degrees(azimuth) + 0.5D", edges.linspace(0, 360, 37)),
    "czenith": ("cos(zen_p)", "cos(zen_p)", edges.linspace(-0.01, 1, 102)),
    "x": ("x_p", "x_p", edges.linspace(-600, 600, 81)),
    "y": ("y_p", "y_p", edges.linspace(-600, 600, 81)),
    "ntanks": ("CAST(ntanks AS DOUBLE)", "CAST(ntanks AS DOUBLE)", edges.linspace(0, 120, 121)),
    "nslc": ("CAST(nslc AS DOUBLE)", "CAST(nslc AS DOUBLE)", edges.linspace(0, 80, 81)),
    "qsum2": ("log10(qsum2)", "log10(qsum2)", edges.linspace(-3, 5, 41)),
    "qtotal": ("log10(qtotal)", "log10(qtotal)", edges.linspace(-3, 5, 41)),
    "energy": ("loge_p", "loge_p", LOGE),
}


#: Variables of the comparison only; pairs leave them out.
_MORE = {
    "zenith": ("degrees(zen_p)", "degrees(zen_p)", edges.linspace(-5, 90, 20)),
    "nsta": ("CAST(nsta AS DOUBLE)", "CAST(nsta AS DOUBLE)", edges.linspace(0, 80, 81)),
    "qtotalhlc": ("log10(CASE WHEN qtotalhlc > 0 THEN qtotalhlc END)",
                  "log10(CASE WHEN qtotalhlc > 0 THEN qtotalhlc END)", edges.linspace(-3, 5, 41)),
}
#: Variables of the 35 slots of an event, for slots of enough charge.
_SLOTS = {
    "tankx": ("k.x", lambda s: s["tank_x"], edges.linspace(-600, 600, 81)),
    "tanky": ("k.y", lambda s: s["tank_y"], edges.linspace(-600, 600, 81)),
    "radius": ("sqrt(k.x * k.x + k.y * k.y)",
               lambda s: F.sqrt(s["tank_x"] * s["tank_x"] + s["tank_y"] * s["tank_y"]), edges.linspace(0, 800, 81)),
    "pulse": ("log10(charge)", lambda s: F.log10(s["pulses"]), edges.linspace(-3, 5, 81)),
}


def _variables(of=_VARS):
    return {v: (F.expr(x), e) for v, (_, x, e) in of.items()}


def _slots():
    filled = F.filter(F.arrays_zip("pulses", "tank_x", "tank_y"), lambda s: s["pulses"] >= 0.1)
    return {v: (F.transform(filled, x), e) for v, (_, x, e) in _SLOTS.items()}


def _compared(t):
    """The comparison batch: scalars and the 35 slots of every booked event, in one pass."""
    events = t.booked.join(pulses.pulse_arrays(t.pulse, t.tank, KEY, ties=TIES), KEY, "left")
    return hist.hist_many(events, _variables({**_VARS, **_MORE}), F.col("sw"), ["sample"], _slots())


_MANY_SQL = "\nUNION ALL\n".join(f"""
    SELECT sample, '{v}' AS var, bin, lo, hi, SUM(sw) AS sum_w, sqrt(SUM(sw * sw)) AS err, COUNT(*) AS n
    FROM booked JOIN {edges_sql(e)} b ON {in_bin(x)} GROUP BY sample, bin, lo, hi"""
                                 for v, (x, _, e) in {**_VARS, **_MORE}.items())
_MANY_SQL += "".join(f"""
    UNION ALL
    SELECT sample, '{v}' AS var, bin, lo, hi, SUM(sw) AS sum_w, sqrt(SUM(sw * sw)) AS err, COUNT(*) AS n
    FROM booked JOIN top35 USING (event_id) JOIN tank k USING (station, tank)
      JOIN {edges_sql(e)} b ON {in_bin(x)}
    WHERE charge >= 0.1e0 GROUP BY sample, bin, lo, hi""" for v, (x, _, e) in _SLOTS.items())


@query("hist_many", f"""
    SELECT sample, var, bin, lo, hi, {G('sum_w')} AS sum_w, {G('err')} AS err, n FROM ({_MANY_SQL})
    """, "booked top35 tank")
def hist_many(t):
    return _compared(t).select("sample", "var", "bin", "lo", "hi", g("sum_w").alias("sum_w"),
                    g("err").alias("err"), "n")


@query("data_mc_ratio", f"""
    WITH h AS (SELECT sample, var, bin, sum_w / SUM(sum_w) OVER (PARTITION BY sample, var) AS norm,
                      err / SUM(sum_w) OVER (PARTITION BY sample, var) AS norm_err FROM ({_MANY_SQL})),
         d AS (SELECT * FROM h WHERE sample = 'data'), m AS (SELECT * FROM h WHERE sample = 'mc')
    SELECT var, bin, {G('d.norm')} AS data, {G('m.norm')} AS mc, {G('d.norm / m.norm')} AS ratio,
           {G('sqrt(pow(d.norm_err / m.norm, 2) + pow(d.norm * m.norm_err / (m.norm * m.norm), 2))')}
           AS ratio_err
    FROM d FULL JOIN m USING (var, bin)""", "booked top35 tank")
def data_mc_ratio(t):
    h = hist.normalise(_compared(t), ["sample", "var"])
    c = hist.compare_samples(h, ["var", "bin"], "sample")
    return c.select("var", "bin", *[g(x).alias(x) for x in ("data", "mc", "ratio", "ratio_err")])


_PAIR_VARS = tuple(_VARS)
_PAIR_SQL = "\nUNION ALL\n".join(f"""
    SELECT sample, '{a}' AS var_x, '{c}' AS var_y, b.bin AS bin_x, b2.bin AS bin_y, SUM(sw) AS sum_w
    FROM booked JOIN {edges_sql(_VARS[a][2])} b ON {in_bin(_VARS[a][0])}
      JOIN {edges_sql(_VARS[c][2])} b2 ON {in_bin(_VARS[c][0], 'b2')}
    GROUP BY sample, b.bin, b2.bin"""
                                 for i, a in enumerate(_PAIR_VARS) for c in _PAIR_VARS[i + 1:])


@query("hist2d_pairs", f"""
    SELECT var_x, var_y, bin_x, bin_y,
           {G('''abs(coalesce(MAX(CASE WHEN sample = 'data' THEN sum_w END), 0)
               - coalesce(MAX(CASE WHEN sample = 'mc' THEN sum_w END), 0))''')} AS difference
    FROM ({_PAIR_SQL}) GROUP BY var_x, var_y, bin_x, bin_y""", "booked")
def hist2d_pairs(t):
    cells = hist.hist2d_pairs(t.booked, _variables(), F.col("sw"), ["sample"])
    d = hist.absolute_difference(cells, ["var_x", "var_y", "bin_x", "bin_y"], "sample")
    return d.withColumn("difference", g("difference"))


_TIME_EDGES = edges.linspace(0.0, 3.0e6, 31)


@query("hist_exploded", f"""
    WITH s AS (SELECT event_id, time - MIN(time) OVER (PARTITION BY event_id) AS v,
                      row_number() OVER (PARTITION BY event_id ORDER BY time) AS r,
                      COUNT(*) OVER (PARTITION BY event_id) AS n FROM pulse_dense),
         b AS {edges_sql(_TIME_EDGES)}
    SELECT bin, {G('SUM(w)')} AS sum_w, {G('sqrt(SUM(w * w))')} AS err, COUNT(*) AS n
    FROM s JOIN evt USING (event_id) JOIN b ON {in_bin('v')}
    WHERE r < least(n, 35) AND v > 0 GROUP BY bin""", "pulse_dense evt")
def hist_exploded(t):
    times = pulses.relative_times(t.pulse_dense, KEY).join(t.evt.select("event_id", "w"), KEY)
    slots = pulses.explode_slots(times, "hits_time", F.col("w")).filter("value > 0")
    h = hist.hist1d(slots, F.col("value"), _TIME_EDGES, F.col("weight"), fill=False)
    return h.select("bin", g("sum_w").alias("sum_w"), g("err").alias("err"), "n")


_ANGLE_EDGES = edges.linspace(0, 60, 121)


@query("hist_angle", f"""
    WITH a AS (SELECT w, degrees(acos(least(1.0e0, greatest(-1.0e0,
                   sin(zenith) * sin(zen_p + 0.001e0) * cos(azimuth - (azimuth + 0.0123e0))
                   + cos(zenith) * cos(zen_p + 0.001e0))))) AS angle FROM evt),
         b AS {edges_sql(_ANGLE_EDGES)}
    SELECT bin, {G('SUM(w)')} AS sum_w, COUNT(*) AS n FROM a JOIN b ON {in_bin('angle')} GROUP BY bin
    """, "evt")
def hist_angle(t):
    angle = directions.opening_angle(F.col("zenith"), F.col("azimuth"), F.col("zen_p") + 0.001,
                                     F.col("azimuth") + 0.0123)
    h = hist.hist1d(t.evt.withColumn("angle", angle), F.col("angle"), _ANGLE_EDGES, F.col("w"),
                    fill=False)
    return h.select("bin", g("sum_w").alias("sum_w"), "n")


_CORE_EDGES = edges.linspace(-600, 600, 25)


@query("hist2d_decade", f"""
    WITH b AS {edges_sql(_CORE_EDGES)}
    SELECT CAST(floor(loge) AS INTEGER) AS decade, b.bin AS bin_x, c.bin AS bin_y, COUNT(*) AS n,
           {G('SUM(w)')} AS sum_w
    FROM evt JOIN b ON {in_bin('x')} JOIN b c ON {in_bin('y', 'c')}
    GROUP BY floor(loge), b.bin, c.bin""", "evt")
def hist2d_decade(t):
    events = t.evt.withColumn("decade", F.floor("loge").cast("int"))
    h = hist.hist2d(events, F.col("x"), F.col("y"), _CORE_EDGES, _CORE_EDGES, F.col("w"),
                    ["decade"])
    return h.select("decade", "bin_x", "bin_y", "n", g("sum_w").alias("sum_w"))


# --- per-bin statistics ----------------------------------------------------------

@query("mean_e_true", f"""
    WITH b AS {_B}
    SELECT bin, {G('coalesce(SUM(w * pow(1e1, loge)) / SUM(w), pow(1e1, MAX((lo + hi) * 0.5e0)))')} AS mean_e
    FROM b LEFT JOIN evt ON loge >= lo AND loge < hi GROUP BY bin""", "evt")
def mean_e_true(t):
    m = spectrum.mean_true_energy(t.evt, F.col("loge"), F.col("w"), LOGE)
    return m.select("bin", g("mean_e").alias("mean_e"))


_RES = edges.RESOLUTION_EDGES


def _resolution_sql(residual: str) -> str:
    return f"""
    WITH b AS {edges_sql(_RES)},
         d AS (SELECT bin, lo, hi, w, {residual} AS v FROM evt JOIN b ON loge >= lo AND loge < hi),
         m AS (SELECT bin, SUM(w * v) / SUM(w) AS mean FROM d GROUP BY bin)
    SELECT bin, {R('MAX((lo + hi) * 0.5e0)')} AS log_energy, COUNT(*) AS n, {R('MAX(mean)')} AS mean,
           {R('sqrt(SUM(w * (v - mean) * (v - mean)) / SUM(w))')} AS sigma
    FROM d JOIN m USING (bin) GROUP BY bin HAVING COUNT(*) > 5"""


def _resolution(t, residual):
    out = hist.resolution(t.evt, F.col("loge"), residual, F.col("w"), _RES)
    return out.select("bin", r("log_energy").alias("log_energy"), "n", r("mean").alias("mean"),
                      r("sigma").alias("sigma"))


@query("resolution_energy", _resolution_sql("loge - loge_p"), "evt")
def resolution_energy(t):
    return _resolution(t, F.col("loge") - F.col("loge_p"))


@query("resolution_zenith", _resolution_sql("zenith - zen_p"), "evt")
def resolution_zenith(t):
    return _resolution(t, F.col("zenith") - F.col("zen_p"))


@query("resolution_core", _resolution_sql(
    "sqrt((x - x_p) * (x - x_p) + (y - y_p) * (y - y_p))"), "evt")
def resolution_core(t):
    return _resolution(t, directions.distance(*[F.col(c) for c in ("x", "y", "x_p", "y_p")]))


@query("regression_metrics", """
    SELECT pdg, COUNT(*) AS n, """ + R("sqrt(SUM(pow(loge - loge_p, 2)) / COUNT(*))") + """ AS rmse,
           """ + R("1 - SUM(pow(loge - loge_p, 2)) / (var_pop(loge) * COUNT(*))") + """ AS r2
    FROM evt GROUP BY pdg""", "evt")
def regression_metrics(t):
    m = ml.evaluate(t.evt, "loge", "loge_p", ["pdg"])
    return m.select("pdg", "n", r("rmse").alias("rmse"), r("r2").alias("r2"))


_SPANS = [("cogx", 0, 1), ("cogy", 1, 2), ("lognsta", 2, 3), ("coszen", 3, 4), ("pulses", 4, 34),
          ("rhit", 34, 64)]
_FI_SQL = """
    SELECT vec_id, feature, SUM(v) AS importance FROM (
        SELECT vec_id, v, CASE """ + " ".join(
    f"WHEN i >= {lo} AND i < {hi} THEN '{n}'" for n, lo, hi in _SPANS) + """ END AS feature
        FROM (SELECT vec_id, abs(CAST(unnest(embedding) AS DOUBLE)) AS v,
                     generate_subscripts(embedding, 1) - 1 AS i FROM embeddings))
    GROUP BY vec_id, feature"""


def _importance(t):
    vec = F.transform(F.col("embedding").cast("array<double>"), F.abs)
    table = ml.vector_table(t.raw("embeddings").select("vec_id", vec.alias("importance")),
                            ["vec_id"])
    return ml.group_importance(table, _SPANS, ["vec_id"])


@query("fi_group", f"SELECT vec_id, feature, {R('importance')} AS importance FROM ({_FI_SQL})")
def fi_group(t):
    return _importance(t).withColumn("importance", r("importance"))


@query("fi_mean", f"""
    SELECT feature, {R('AVG(importance)')} AS importance FROM ({_FI_SQL}) GROUP BY feature""")
def fi_mean(t):
    return ml.mean_importance(_importance(t)).withColumn("importance", r("importance"))


# --- fits ------------------------------------------------------------------------

_RES_EDGES = edges.linspace(-2, 2, 41)
_RESIDUAL = """(loge - loge_p + ((event_id * 17) % 21 - 10) / {0} + ((event_id * 23) % 41 - 20) / {1})"""


def _slices(t):
    value = F.expr(_RESIDUAL.format("20.0D", "40.0D"))
    h = hist.hist2d(t.evt, F.col("loge"), value, LOGE, _RES_EDGES, F.col("w"))
    mid = edges.centre(edges.edge_at(_RES_EDGES, F.col("bin_y")),
                       edges.edge_at(_RES_EDGES, F.col("bin_y") + 1))
    return h.withColumn("mid", mid)


@query("gauss_bias", f"""
    WITH b AS {_B}, c AS {edges_sql(_RES_EDGES)},
         v AS (SELECT loge, w, {_RESIDUAL.format('20.0e0', '40.0e0')} AS v FROM evt),
         h AS (SELECT b.bin AS bin_x, (c.lo + c.hi) * 0.5e0 AS x, SUM(w) AS w, ln(SUM(w)) AS y
               FROM v JOIN b ON {in_bin('loge')} JOIN c ON {in_bin('v', 'c')}
               GROUP BY b.bin, c.lo, c.hi),
         m AS (SELECT bin_x, COUNT(*) AS n_bins, {', '.join(
             f'SUM(w * pow(x, {k})) AS s{k}' for k in range(5))}, {', '.join(
             f'SUM(w * y * pow(x, {k})) AS t{k}' for k in range(3))} FROM h GROUP BY bin_x),
         f AS (SELECT bin_x, n_bins,
                  (s0 * (t1 * s4 - s3 * t2) - t0 * (s1 * s4 - s2 * s3) + s2 * (s1 * t2 - t1 * s2))
                  / (s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2)) AS b,
                  (s0 * (s2 * t2 - t1 * s3) - s1 * (s1 * t2 - t1 * s2) + t0 * (s1 * s3 - s2 * s2))
                  / (s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2)) AS a
               FROM m WHERE n_bins >= 3)
    SELECT bin_x, n_bins, CASE WHEN a < 0 THEN {R('-b / (2 * a)')} END AS mean,
           CASE WHEN a < 0 THEN {R('sqrt(abs(-1 / (2 * a)))')} END AS sigma FROM f""", "evt")
def gauss_bias(t):
    f = fits.log_parabola(_slices(t), ["bin_x"], F.col("mid"), F.col("sum_w"))
    return f.select("bin_x", "n_bins", r("mean").alias("mean"), r("sigma").alias("sigma"))


@query("gauss_fit", f"""
    WITH RECURSIVE b AS {_B}, c AS {edges_sql(_RES_EDGES)},
         v AS (SELECT loge, w, {_RESIDUAL.format('20.0e0', '40.0e0')} AS v FROM evt),
         h AS (SELECT b.bin AS bin_x, (c.lo + c.hi) * 0.5e0 AS x, SUM(w) AS y, 1.0e0 AS w
               FROM v JOIN b ON {in_bin('loge')} JOIN c ON {in_bin('v', 'c')}
               GROUP BY b.bin, c.lo, c.hi HAVING SUM(w) > 0),
    {fit_ctes('bin_x', 'SELECT * FROM h', """
        SELECT bin_x, MAX(y) AS p0, SUM(x * y) / SUM(y) AS p1,
               CASE WHEN SUM(x * x * y) / SUM(y) - pow(SUM(x * y) / SUM(y), 2) > 0
                    THEN sqrt(SUM(x * x * y) / SUM(y) - pow(SUM(x * y) / SUM(y), 2)) ELSE 1 END AS p2
        FROM h GROUP BY bin_x""", GAUSS)}
    SELECT bin_x, converged, {G('p0', 6)} AS amplitude, {R('p1', 5)} AS mean, {R('abs(p2)', 5)} AS sigma,
           {G('e0', 5)} AS amplitude_err, {G('e1', 5)} AS mean_err, {G('e2', 5)} AS sigma_err FROM fit""", "evt")
def gauss_fit(t):
    f = fits.gaussian_fit(_slices(t), "bin_x", "mid", "sum_w")
    return f.select("bin_x", "converged", g("amplitude", 6).alias("amplitude"), r("mean", 5).alias("mean"), r("sigma", 5).alias("sigma"),
                    *[g(c, 5).alias(c) for c in ("amplitude_err", "mean_err", "sigma_err")])
