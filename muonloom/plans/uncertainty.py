"""Registered queries: systematic uncertainties and final spectra."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from muonloom.functions import edges
from muonloom.functions.shapes import flux as model_flux
from muonloom.operators import fits, hist, spectrum, summary, systematics
from muonloom.plans.booking import WEIGHT_SQL, FINE, flux_sql
from muonloom.plans.hits import LIVETIME_SQL, livetimes
from muonloom.plans.registry import G, ORACLES, R, edges_sql, g, in_bin, query, r
from muonloom.plans.spectra import AREA, AREA_FIT_SQL, B, LN10, LOGE, SEEN, SOLID, WINDOW, area_bins, seen
from muonloom.session import cut_lineage

_SEASON = "'s' || CAST(run % 3 AS VARCHAR)"


def season_spectra(t):
    """(season, bin, flux, stat) of three run seasons."""
    name = F.concat(F.lit("s"), (F.col("run") % 3).cast("string"))
    h = hist.hist1d(seen(t).withColumn("season", name), F.col("loge_p"), LOGE,
                    by=["season"], fill=False)
    live = summary.exposure(t.run_dim.withColumn("season", name), ["season"])
    lo, hi = F.col("lo"), F.col("hi")
    area = spectrum.generation_area(lo)
    scaled = lambda c: spectrum.flux_from_counts(c, lo, hi, area, WINDOW, F.col("duration"))
    return h.join(live, "season").select(
        "season", "bin", scaled(F.col("n")).alias("flux"), scaled(F.sqrt("n")).alias("stat"))


_SEASON_SQL = f"""
    spec AS (SELECT season, bin, COUNT(*) / ((hi - lo) * {LN10} * {AREA} * {SOLID} * MAX(d.duration)) AS flux,
                    sqrt(COUNT(*)) / ((hi - lo) * {LN10} * {AREA} * {SOLID} * MAX(d.duration)) AS stat
             FROM (SELECT *, {_SEASON} AS season FROM evt WHERE {SEEN}) e JOIN {B} b ON {in_bin('loge_p')}
             JOIN (SELECT {_SEASON} AS season, SUM(duration) AS duration FROM run_dim GROUP BY ALL) d
               USING (season)
             GROUP BY season, bin, lo, hi),
    wide AS (SELECT bin, {', '.join(f"MAX(CASE WHEN season = 's{i}' THEN flux END) AS f{i}, "
                                    f"MAX(CASE WHEN season = 's{i}' THEN stat END) AS e{i}"
                                    for i in range(3))} FROM spec GROUP BY bin)"""


@query("sys_pressure", f"""
    WITH {_SEASON_SQL}
    SELECT bin, {R('(f1 - f0) / f0', 8)} AS change,
           {R('sqrt(pow((e1 - e0) / f0, 2) + pow((f1 - f0) * e0 / (f0 * f0), 2))', 8)} AS sys,
           {R('-least((f1 - f0) / f0, 0)', 8)} AS flux_shift,
           {R('1 + least((f1 - f0) / f0, 0)', 8)} AS correction FROM wide""", "evt run_dim")
def sys_pressure(t):
    p = systematics.pressure(season_spectra(t), "s0", "s1")
    return p.select("bin", *[r(c, 8).alias(c) for c in ("change", "sys", "flux_shift",
                                                        "correction")])


_ERR = "sqrt(pow(sqrt(e{i} * e{i} + me * me) / m, 2) + pow((f{i} - m) * me / (m * m), 2))"


@query("sys_temperature", f"""
    WITH {_SEASON_SQL},
         mid AS (SELECT *, (f0 + f1 + f2) / 3 AS m, sqrt(e0 * e0 + e1 * e1 + e2 * e2) / 3 AS me FROM wide)
    SELECT bin, {R('least((f0 - m) / m, (f1 - m) / m, (f2 - m) / m, 0)', 8)} AS sys_low,
           {R('greatest((f0 - m) / m, (f1 - m) / m, (f2 - m) / m, 0)', 8)} AS sys_high,
           {R('greatest(' + ', '.join(_ERR.format(i=i) for i in range(3)) + ')', 8)} AS sys_err
    FROM mid""", "evt run_dim")
def sys_temperature(t):
    s = systematics.temperature(season_spectra(t), ["s0", "s1", "s2"])
    return s.select("bin", *[r(c, 8).alias(c) for c in ("sys_low", "sys_high", "sys_err")])


@query("sys_envelope", f"""
    WITH {_SEASON_SQL}, m AS (SELECT bin, AVG(flux) AS m FROM spec GROUP BY bin)
    SELECT bin, {R('-least(MIN(flux / m - 1), 0)', 8)} AS sys_low,
           {R('greatest(MAX(flux / m - 1), 0)', 8)} AS sys_high
    FROM spec JOIN m USING (bin) GROUP BY bin""", "evt run_dim")
def sys_envelope(t):
    spec = season_spectra(t)
    mean = spec.groupBy("bin").agg(F.avg("flux").alias("m"))
    shifts = spec.join(mean, "bin").withColumn("shift", F.col("flux") / F.col("m") - 1.0)
    e = systematics.envelope(shifts, "shift")
    return e.select("bin", r("sys_low", 8).alias("sys_low"), r("sys_high", 8).alias("sys_high"))


@query("sys_duration", LIVETIME_SQL + f"""
    , moved AS (SELECT run, s0 * tau AS t, s0 * tau * tau * slope_err AS e FROM f)
    SELECT run, {G('(1 / (t - e) - 1 / t) * t', 7)} AS sys_low, {G('(1 / t - 1 / (t + e)) * t', 7)} AS sys_high
    FROM moved""")
def sys_duration(t):
    """Change of the flux when the fitted livetime moves by its error."""
    live, err = F.col("livetime"), F.col("livetime_err")
    low, high = systematics.duration_shift(live, live - err, live + err)
    return livetimes(t).select("run", g(low, 7).alias("sys_low"), g(high, 7).alias("sys_high"))


_MODELS = ("h4a", "h3a", "poly")
_FB = edges_sql(FINE)


@query("sys_composition", f"""
    WITH w AS ({WEIGHT_SQL}), b AS {_FB},
         s AS (""" + " UNION ALL ".join(f"""
             SELECT '{m}' AS variant, bin, SUM({flux_sql(m, 'energy')} * norm) AS sw
             FROM (SELECT w.* FROM w JOIN evt USING (event_id) WHERE {SEEN.replace('filt', 'evt.filt').replace('zen_p', 'evt.zen_p')}) GROUP BY bin"""
                                         for m in _MODELS) + f"""),
         d AS (SELECT variant, bin, sw / ((hi - lo) * {LN10} * {AREA} * {SOLID}) AS f,
                      CASE variant """ + " ".join(
    f"WHEN '{m}' THEN {flux_sql(m, 'pow(1e1, (lo + hi) * 0.5e0)')}" for m in _MODELS) + f""" END AS m
               FROM s JOIN b USING (bin)),
         x AS (SELECT d.bin, (d.f - d.m) / d.m - (r.f - r.m) / r.m AS shift
               FROM d JOIN d r ON r.bin = d.bin AND r.variant = 'h4a')
    SELECT bin, {R('-least(MIN(shift), 0)', 8)} AS sys_low, {R('greatest(MAX(shift), 0)', 8)} AS sys_high
    FROM x GROUP BY bin""", "evt")
def sys_composition(t):
    w = spectrum.composition_weights(t.evt, t.evt, FINE, _MODELS).filter(F.col("filt") & WINDOW.holds("zen_p"))
    sums = w.groupBy("bin").agg(*[F.sum(f"weight_all_{m}").alias(m) for m in _MODELS])
    long = sums.select("bin", F.inline(F.array(*[
        F.struct(F.lit(m).alias("variant"), F.col(m).alias("sw")) for m in _MODELS])))
    lo, hi = edges.edge_at(FINE, F.col("bin")), edges.edge_at(FINE, F.col("bin") + 1)
    middle = F.pow(F.lit(10.0), edges.centre(lo, hi))
    model = F.when(F.lit(False), F.lit(0.0))
    for m in _MODELS:
        model = model.when(F.col("variant") == m, model_flux(m, middle))
    area = spectrum.generation_area(lo)
    fluxes = long.select("variant", "bin",
                         spectrum.flux_from_counts(F.col("sw"), lo, hi, area, WINDOW).alias("flux"),
                         model.alias("model"))
    e = systematics.envelope(systematics.composition_shift(fluxes, "h4a"), "shift")
    return e.select("bin", r("sys_low", 8).alias("sys_low"), r("sys_high", 8).alias("sys_high"))


_SIG = "(p0 + {a}) / (1 + exp(-(p1 + {b}) * (log_energy - (p2 + {c}))))"


def _curve(i, j, k, s) -> str:
    return _SIG.format(a=f"{s * i} * e0", b=f"{s * j} * e1", c=f"{s * k} * e2")


_CURVES = ", ".join(_curve(i, j, k, s) for i in (0, 1) for j in (0, 1) for k in (0, 1) for s in (1, -1))


@query("sys_aeff", f"""
    WITH RECURSIVE {AREA_FIT_SQL},
         c AS (SELECT a.*, least(aeff, {_CURVES}) AS lowest, greatest(aeff, {_CURVES}) AS highest
               FROM area a JOIN fit USING (variant) WHERE aeff > 0 AND p0 IS NOT NULL)
    SELECT variant, bin, {G('aeff / lowest - 1', 5)} AS sys_low, {R('1 - aeff / highest', 5)} AS sys_high
    FROM c""", "evt booked")
def sys_aeff(t):
    """Effect of the errors of the fitted sigmoid on the effective area."""
    bins = cut_lineage(area_bins(t))  # a few rows: the fit and the shifts share one pass over the events
    s = systematics.area_shift(bins.filter("aeff > 0"), fits.sigmoid_fit(bins, 4.0, 7.0))
    return s.select("variant", "bin", g("sys_low", 5).alias("sys_low"), r("sys_high", 5).alias("sys_high"))


def _as_sources() -> str:
    """Sources per bin from the queries above: finer bins and particles by their largest value."""
    return f"""
    src AS (SELECT bin // 2 AS bin, 'composition' AS source, MAX(sys_low) AS sys_low, MAX(sys_high) AS sys_high
            FROM ({ORACLES['sys_composition']}) GROUP BY bin // 2
            UNION ALL SELECT bin, 'area', MAX(sys_low), MAX(sys_high) FROM ({ORACLES['sys_aeff']}) GROUP BY bin
            UNION ALL SELECT bin, 'pressure', flux_shift, coalesce(sys, 0) FROM ({ORACLES['sys_pressure']})
            UNION ALL SELECT bin, 'temperature', sys_low, sys_high FROM ({ORACLES['sys_temperature']})),
    merged AS (SELECT bin, CASE WHEN source IN ('pressure', 'temperature') THEN 'pt' ELSE source END AS s,
                      SUM(CASE WHEN source = 'temperature' THEN -sys_low ELSE sys_low END) AS sys_low,
                      SUM(sys_high) AS sys_high FROM src GROUP BY ALL),
    tot AS (SELECT bin, sqrt(SUM(sys_low * sys_low)) AS sys_low, sqrt(SUM(sys_high * sys_high)) AS sys_high
            FROM merged GROUP BY bin)"""


_SOURCE_SQL = _as_sources()


def total_systematics(t):
    """Quadrature total of composition, area, pressure and temperature per bin."""
    most = [F.max("sys_low").alias("sys_low"), F.max("sys_high").alias("sys_high")]
    parts = {
        "composition": sys_composition(t).groupBy(F.floor(F.col("bin") / 2).cast("int").alias("bin")).agg(*most),
        "area": sys_aeff(t).groupBy("bin").agg(*most),
        "pressure": sys_pressure(t).select("bin", F.col("flux_shift").alias("sys_low"),
                                           F.coalesce("sys", F.lit(0.0)).alias("sys_high")),
        "temperature": sys_temperature(t).select("bin", "sys_low", "sys_high"),
    }
    rows = [df.select("bin", F.lit(name).alias("source"), "sys_low", "sys_high") for name, df in parts.items()]
    return systematics.total(functools.reduce(lambda a, b: a.unionByName(b), rows))


@query("sys_quadrature", f"""
    WITH {_SOURCE_SQL} SELECT bin, {R('sys_low', 9)} AS sys_low, {R('sys_high', 9)} AS sys_high FROM tot
    """, "evt run_dim booked")
def sys_quadrature(t):
    return total_systematics(t).select("bin", r("sys_low", 9).alias("sys_low"),
                            r("sys_high", 9).alias("sys_high"))


_FLUX_SQL = f"""
    fx AS (SELECT bin, (lo + hi) * 0.5e0 AS x,
                  COUNT(*) / ((hi - lo) * {LN10} * {AREA} * {SOLID} * (SELECT SUM(duration) FROM run_dim)) AS flux,
                  sqrt(COUNT(*)) / ((hi - lo) * {LN10} * {AREA} * {SOLID} * (SELECT SUM(duration) FROM run_dim)) AS stat
           FROM evt JOIN {B} b ON {in_bin('loge_p')} WHERE {SEEN} GROUP BY bin, lo, hi)"""


def _flux(t, events):
    h = hist.hist1d(events, F.col("loge_p"), LOGE, fill=False)
    duration = summary.exposure(t.run_dim).select("duration").scalar()
    lo, hi = F.col("lo"), F.col("hi")
    area = spectrum.generation_area(lo)
    scaled = lambda c: spectrum.flux_from_counts(c, lo, hi, area, WINDOW, duration)
    return h.select("bin", edges.centre(lo, hi).alias("log_energy"),
                    scaled(F.col("n")).alias("flux"), scaled(F.sqrt("n")).alias("stat"))


@query("final_spectrum", f"""
    WITH {_FLUX_SQL}, {_SOURCE_SQL},
         k AS (SELECT *, pow(pow(1e1, x), 1.65e0) AS k FROM fx JOIN (SELECT bin, sys_low, sys_high FROM tot) USING (bin)
               WHERE x BETWEEN 5.4e0 AND 7.0e0)
    SELECT bin, {R('x')} AS log_energy, {G('k * flux')} AS flux, {G('k * stat')} AS stat,
           {G('k * flux * sqrt(pow(0.03e0, 2) + sys_low * sys_low)')} AS sys_low,
           {G('k * flux * sqrt(pow(0.03e0, 2) + sys_high * sys_high)')} AS sys_high FROM k""",
       "evt run_dim booked")
def final_spectrum(t):
    flux = _flux(t, seen(t)).withColumn("unfold_sys", 0.03 * F.col("flux"))
    s = systematics.final_spectrum(flux, total_systematics(t))
    return s.select("bin", r("log_energy").alias("log_energy"),
                    *[g(c).alias(c) for c in ("flux", "stat", "sys_low", "sys_high")])


@query("model_ratio", f"""
    WITH n AS (SELECT bin, COUNT(*) FILTER (WHERE pdg = 2212) AS a,
                      COUNT(*) FILTER (WHERE pdg = 1000260560) AS c
               FROM evt JOIN {B} b ON {in_bin('loge_p')} WHERE {SEEN} GROUP BY bin)
    SELECT bin, {R('a / c', 8)} AS ratio,
           {R('sqrt(pow(0.05e0 * a / c, 2) + pow(a * 0.05e0 / c, 2))', 8)} AS err_low,
           {R('sqrt(a / (c * c) + a * a * c / (c * c * c * c))', 8)} AS err_high
    FROM (SELECT bin, CAST(a AS DOUBLE) AS a, CAST(c AS DOUBLE) AS c FROM n) WHERE a > 0 AND c > 0""",
       "evt")
def model_ratio(t):
    def one(pdg):
        s = _flux(t, seen(t).filter(F.col("pdg") == pdg))
        return s.withColumns({"sys_low": 0.05 * F.col("flux"), "sys_high": F.col("stat")})

    m = systematics.spectrum_ratio(one(2212), one(1000260560))
    return m.select("bin", *[r(c, 8).alias(c) for c in ("ratio", "err_low", "err_high")])
