"""Registered queries: generated counts to efficiency, response, flux and unfolding."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from muonloom.functions import cuts, edges
from muonloom.functions.guards import ratio_or_zero
from muonloom.functions.shapes import flux as model_flux
from muonloom.operators import fits, hist, spectrum, summary, unfold
from muonloom.plans.booking import flux_sql
from muonloom.plans.fit_sql import SIGMOID, fit_ctes
from muonloom.plans.registry import G, R, edges_sql, g, in_bin, num, query, r
from muonloom.sources.constants import HAWC_FLUX, THREE_YEAR_FLUX, THREE_YEAR_LOGE, outside_spectra

LOGE = edges.LOGE_EDGES
B = edges_sql(LOGE)
N_BINS = len(LOGE) - 1
LN10 = num(math.log(10.0))
AREA = """(pi() * pow(CASE WHEN lo < 5 THEN 200 WHEN lo < 6 THEN 400 WHEN lo < 7 THEN 600 ELSE 800 END, 2))"""
WINDOW = spectrum.ZenithWindow(0.8, 1.0)
SOLID = f"(pi() * ({num(WINDOW.cos_hi)} * {num(WINDOW.cos_hi)} - {num(WINDOW.cos_lo)} * {num(WINDOW.cos_lo)}))"
SEEN = f"filt AND cos(zen_p) BETWEEN {num(WINDOW.cos_lo)} AND {num(WINDOW.cos_hi)}"
#: All quality cuts; the charge of the benchmark events stands for the coincident charge.
CUT = f"""{SEEN} AND nsta <= 42 AND qtotal BETWEEN {num(10.0 ** -0.2)} AND {num(10.0 ** 3.8)}
    AND qmax <= 0.75e0 * qtotal AND qsum2 <= 0.9e0 * qtotal"""


def seen(t):
    """Triggered events reconstructed inside the zenith window."""
    return t.evt.filter(F.col("filt") & WINDOW.holds("zen_p"))


def selected(t):
    events = t.booked.withColumn("qtotalhlc", F.col("qtotal"))
    return events.filter(F.col("filt") & cuts.quality(WINDOW.cos_lo, WINDOW.cos_hi, "zen_p"))


_GEN_SQL = f"""
    SELECT bin, lo, hi, coalesce(SUM(w), 0) AS sw, coalesce(SUM(w * w), 0) AS sw2, COUNT(event_id) AS n
    FROM ({B}) b LEFT JOIN evt ON {in_bin('loge')} AND cos(zenith) BETWEEN 0.8e0 AND 1
    GROUP BY bin, lo, hi"""


def _generated(t):
    return spectrum.n_generated(t.evt, LOGE, F.col("w"), WINDOW)


@query("n_generated", f"""
    SELECT bin, {G('sw')} AS sum_w, {G('sqrt(sw2)')} AS err, n, {G('sw2')} AS legacy_err FROM ({_GEN_SQL})
    """, "evt")
def n_generated(t):
    legacy = spectrum.n_generated(t.evt, LOGE, F.col("w"), WINDOW, legacy_error=True).select(
        "bin", g("err").alias("legacy_err"))
    return _generated(t).select("bin", g("sum_w").alias("sum_w"), g("err").alias("err"), "n").join(
        legacy, "bin")


_EFF_SQL = f"""
    WITH gen AS ({_GEN_SQL}),
         sel AS (SELECT bin, SUM(w) AS s, sqrt(SUM(w * w)) AS se FROM booked JOIN {B} b
                 ON {in_bin('loge')} WHERE {CUT} GROUP BY bin)
    SELECT bin, lo, hi, CASE WHEN sw > 0 THEN coalesce(s, 0) / sw ELSE 0 END AS eff,
           CASE WHEN sw > 0 THEN sqrt(pow(coalesce(se, 0) / sw, 2)
                + pow(coalesce(s, 0) * sqrt(sw2) / (sw * sw), 2)) ELSE 0 END AS eff_err
    FROM gen LEFT JOIN sel USING (bin)"""


def efficiencies(t):
    s = hist.hist1d(selected(t), F.col("loge"), LOGE, F.col("w"), fill=False)
    return spectrum.efficiency(s, _generated(t))


@query("efficiency", f"SELECT bin, {G('eff')} AS eff, {G('eff_err')} AS eff_err FROM ({_EFF_SQL})",
       "evt booked")
def efficiency(t):
    return efficiencies(t).select("bin", g("eff").alias("eff"), g("eff_err").alias("eff_err"))


@query("effective_area", f"""
    SELECT bin, {G(f'eff * {AREA}')} AS aeff, {G(f'eff_err * {AREA}')} AS aeff_err FROM ({_EFF_SQL})
    """, "evt booked")
def effective_area(t):
    a = spectrum.effective_area(efficiencies(t))
    return a.select("bin", g("aeff").alias("aeff"), g("aeff_err").alias("aeff_err"))


@query("cr_flux", f"""
    WITH a AS (SELECT *, eff * {AREA} AS aeff, eff_err * {AREA} AS aeff_err FROM ({_EFF_SQL})),
         c AS (SELECT bin, COUNT(*) AS n FROM booked JOIN {B} b ON {in_bin('loge_p')}
               WHERE {CUT} GROUP BY bin)
    SELECT bin, n, CASE WHEN aeff > 0 THEN {G(f'n / ((hi - lo) * {LN10} * aeff * {SOLID} * (SELECT SUM(duration) FROM run_dim))')} END AS flux,
           CASE WHEN aeff > 0 THEN {G(f'sqrt(pow(sqrt(n) / aeff, 2) + pow(n * aeff_err / (aeff * aeff), 2)) / ((hi - lo) * {LN10} * {SOLID} * (SELECT SUM(duration) FROM run_dim))')} END AS err
    FROM c JOIN a USING (bin)""", "evt booked run_dim")
def cr_flux(t):
    counts = hist.hist1d(selected(t), F.col("loge_p"), LOGE, fill=False).select("bin", "n")
    j = counts.join(spectrum.effective_area(efficiencies(t)), "bin")
    duration = summary.exposure(t.run_dim).select("duration").scalar()
    n, lo, hi = F.col("n"), F.col("lo"), F.col("hi")
    flux = spectrum.flux_from_counts(n, lo, hi, F.col("aeff"), WINDOW, duration)
    err = spectrum.flux_error(n, F.sqrt(n), F.col("aeff"), F.col("aeff_err"), lo, hi, WINDOW, duration)
    return j.select("bin", "n", g(flux).alias("flux"), g(err).alias("err"))


_RESPONSE_SQL = f"""
    SELECT variant, cause, effect, sw / tw AS p, sqrt(sw2) / tw AS p_err,
           SUM(sw) OVER (PARTITION BY variant, cause) / tw AS eff
    FROM (SELECT CAST(pdg AS VARCHAR) AS variant, c.bin AS cause, b.bin AS effect, SUM(w) AS sw,
                 SUM(w * w) AS sw2
          FROM evt JOIN {B} b ON {in_bin('loge_p')} JOIN {B} c ON {in_bin('loge', 'c')}
          WHERE sample = 'mc' GROUP BY pdg, b.bin, c.bin)
    JOIN (SELECT CAST(pdg AS VARCHAR) AS variant, c.bin AS cause, SUM(w) AS tw
          FROM evt JOIN {B} c ON {in_bin('loge', 'c')} WHERE sample = 'mc' GROUP BY pdg, c.bin)
      USING (variant, cause)"""


def response_cells(t):
    mc = t.evt.filter("sample = 'mc'").withColumn("variant", F.col("pdg").cast("string"))
    return spectrum.response_matrix(mc, F.col("loge_p"), F.col("loge"), F.col("w"), LOGE,
                                    by=["variant"])


@query("response_matrix", f"""
    SELECT variant, cause, effect, {G('p')} AS p, {G('p_err')} AS p_err, {G('eff')} AS eff
    FROM ({_RESPONSE_SQL})""", "evt")
def response_matrix(t):
    return response_cells(t).select("variant", "cause", "effect", g("p").alias("p"),
                                    g("p_err").alias("p_err"), g("eff").alias("eff"))


# --- unfolding -------------------------------------------------------------------

def unfolding_bins(t, cells, reco=None, weight=None, prior="uniform"):
    """Observed spectrum of the data sample per particle, with efficiency and prior."""
    data = t.evt.filter("sample = 'data'") if reco is None else reco
    data = data.withColumn("variant", F.col("pdg").cast("string"))
    seen = hist.hist1d(data, F.col("loge_p"), LOGE, weight, by=["variant"])
    eff = cells.groupBy("variant", F.col("cause").alias("bin")).agg(F.max("eff").alias("eff"))
    bins = seen.join(eff, ["variant", "bin"], "left").select(
        "variant", "bin", "lo", "hi", F.col("sum_w").alias("data"), F.col("err").alias("data_err"),
        F.coalesce("eff", F.lit(0.0)).alias("eff"))
    value = unfold.prior_column(prior, F.col("lo"), F.col("hi"), counts=F.col("data"))
    return unfold.with_prior(bins, value)


_SEEN_SQL = f"""
    SELECT v.variant, b.bin, b.lo, b.hi, coalesce(n, 0) AS n
    FROM (SELECT DISTINCT CAST(pdg AS VARCHAR) AS variant FROM evt) v, ({B}) b
    LEFT JOIN (SELECT CAST(pdg AS VARCHAR) AS variant, b.bin, COUNT(*) AS n FROM evt JOIN {B} b
               ON {in_bin('loge_p')} WHERE sample = 'data' GROUP BY pdg, b.bin) d
      ON d.variant = v.variant AND d.bin = b.bin"""


@query("unfold_prior", f"""
    WITH s AS ({_SEEN_SQL}),
         l AS (SELECT *, CASE WHEN bin < 2 THEN MAX(CASE WHEN bin = 2 THEN n END) OVER (PARTITION BY variant)
                         ELSE n END AS lifted, {flux_sql('h4a', 'pow(1e1, (lo + hi) * 0.5e0)')} AS m FROM s)
    SELECT variant, bin, {R('1.0e0 / COUNT(*) OVER (PARTITION BY variant)')} AS uniform,
           {R('2 / (lo + hi) / SUM(2 / (lo + hi)) OVER (PARTITION BY variant)')} AS jeffreys,
           {R('lifted / SUM(lifted) OVER (PARTITION BY variant)')} AS counts,
           {G('m / SUM(m) OVER (PARTITION BY variant)')} AS model FROM l""", "evt")
def unfold_prior(t):
    data = t.evt.filter("sample = 'data'").withColumn("variant", F.col("pdg").cast("string"))
    h = hist.hist1d(data, F.col("loge_p"), LOGE, by=["variant"])
    h = unfold.lift_empty_head(h, "n")
    model = model_flux("h4a", F.pow(F.lit(10.0), edges.centre(F.col("lo"), F.col("hi"))))
    for kind in ("uniform", "jeffreys", "counts", "model"):
        value = unfold.prior_column(kind, F.col("lo"), F.col("hi"), F.col("n"), model)
        h = unfold.with_prior(h, value, kind)
    return h.select("variant", "bin", *[r(k).alias(k) for k in ("uniform", "jeffreys", "counts")],
                    g("model").alias("model"))


_STEP = """
    s{n} AS (SELECT variant, effect, SUM(p * n{m}) AS seen FROM resp JOIN i{m} USING (variant, cause)
             GROUP BY variant, effect),
    i{n} AS (SELECT i.variant, i.cause,
                    coalesce(SUM(r.p * i.n{m} / nullif(r.eff * s.seen, 0) * d.n), 0) AS n{n},
                    sqrt(coalesce(SUM(pow(r.p * i.n{m} / nullif(r.eff * s.seen, 0), 2) * d.n), 0)) AS e{n}
             FROM i{m} i LEFT JOIN resp r ON r.variant = i.variant AND r.cause = i.cause AND r.eff > 0
             LEFT JOIN s{n} s ON s.variant = r.variant AND s.effect = r.effect
             LEFT JOIN obs d ON d.variant = r.variant AND d.bin = r.effect
             GROUP BY i.variant, i.cause)"""


@query("unfold", f"""
    WITH resp AS ({_RESPONSE_SQL}), obs AS ({_SEEN_SQL}),
         i0 AS (SELECT variant, bin AS cause, SUM(n) OVER (PARTITION BY variant) / {N_BINS}.0e0 AS n0
                FROM obs),
    {_STEP.format(n=1, m=0)}, {_STEP.format(n=2, m=1)}, {_STEP.format(n=3, m=2)}
    SELECT variant, cause AS bin, {R('n3')} AS unfolded, {R('e3')} AS stat_err FROM i3""", "evt")
def unfold_three(t):
    cells = response_cells(t)
    out = unfold.unfold(cells, unfolding_bins(t, cells), tol=0.0, max_iter=3)
    return out.select("variant", "bin", r("unfolded").alias("unfolded"),
                      r("stat_err").alias("stat_err"))


def _smooth_sql(degree: int) -> str:
    """Aliases up to ``smooth``: log10 of the list ``new`` replaced by a polynomial in the bin number."""
    middle = (N_BINS - 1) / 2
    x, size = f"((i - 1 - {num(middle)}) / {num(middle)})", degree + 1
    each = f"range(1, {N_BINS + 1})"
    moment = lambda k, y: (f"list_sum(list_transform({each}, lambda i: CASE WHEN new[i] > 0 "
                           f"THEN pow({x}, {k}){y} ELSE 0e0 END))")
    out = [f"{moment(k, '')} AS m{k}" for k in range(2 * degree + 1)]
    out += [f"{moment(k, ' * log10(new[i])')} AS t{k}" for k in range(size)]
    for j in range(size):  # a = l d l'
        inner = "".join(f" - l{j}_{k} * l{j}_{k} * d{k}" for k in range(j))
        out.append(f"m{2 * j}{inner} AS d{j}")
        for i in range(j + 1, size):
            inner = "".join(f" - l{i}_{k} * l{j}_{k} * d{k}" for k in range(j))
            out.append(f"(m{i + j}{inner}) / nullif(d{j}, 0) AS l{i}_{j}")
    for j in range(size):
        out.append(f"t{j}{''.join(f' - l{j}_{k} * z{k}' for k in range(j))} AS z{j}")
    for j in reversed(range(size)):
        out.append(f"z{j} / nullif(d{j}, 0){''.join(f' - l{k}_{j} * c{k}' for k in range(j + 1, size))} AS c{j}")
    value = " + ".join(f"c{k} * pow({x}, {k})" for k in range(size))
    out.append(f"list_transform({each}, lambda i: CASE WHEN m0 > {degree} AND new[i] > 0 THEN pow(1e1, {value}) "
               "ELSE new[i] END) AS smooth")
    return ", ".join(out)


def _iterated_sql(data: str, prior: str, runs: str, most: int, degree: int | None = None,
                  resp: str = _RESPONSE_SQL) -> str:
    """Unfolding to a stopping rule: one row per run with lists over the bins.

    ``data``: (variant, bin, n); ``prior``: an expression of lo and hi; ``runs``:
    (run, tol).  Ends with ``done`` (variant, run, k, n, ks, est, last): what goes into
    the next iteration, the estimate, and what went into this one.
    """
    bins = f"range({N_BINS})"
    each = f"range(1, {N_BINS + 1})"
    lists = lambda outer, inner: f"""(SELECT variant, list(l ORDER BY {outer}) AS by_{outer}, list(q ORDER BY {outer}) AS err_by_{outer},
                list(e ORDER BY {outer}) AS sum_by_{outer} FROM
            (SELECT variant, {outer}, list(p ORDER BY {inner}) AS l, list(p_err ORDER BY {inner}) AS q, SUM(p) AS e
             FROM grid GROUP BY ALL) GROUP BY variant)"""
    new = f"""(SELECT *, list_transform({each}, lambda i: CASE WHEN eff[i] = 0 THEN 0e0
                            ELSE n[i] / eff[i] * list_dot_product(by_cause[i], pull) END) AS new
                 FROM (SELECT *, list_transform({each}, lambda j:
                              CASE WHEN list_dot_product(by_effect[j], n) = 0 THEN 0e0
                                   ELSE data[j] / list_dot_product(by_effect[j], n) END) AS pull
                       FROM it JOIN m USING (variant) WHERE ks >= tol AND k < {most}))"""
    if degree is not None:
        new = f"(SELECT *, {_smooth_sql(degree)} FROM {new})"
    return f"""
    resp AS ({resp}), obs AS ({data}),
    grid AS (SELECT v.variant, e.b AS effect, c.b AS cause, coalesce(r.p, 0) AS p, coalesce(r.p_err, 0) AS p_err
             FROM (SELECT DISTINCT variant FROM obs) v, {bins} e(b), {bins} c(b)
             LEFT JOIN resp r ON r.variant = v.variant AND r.effect = e.b AND r.cause = c.b),
    m AS (SELECT *, sum_by_cause AS eff FROM {lists('effect', 'cause')} JOIN {lists('cause', 'effect')} USING (variant)
        JOIN (SELECT variant, list(CAST(n AS DOUBLE) ORDER BY bin) AS data,
                     list({prior} ORDER BY bin) AS prior FROM obs JOIN {B} b USING (bin) GROUP BY variant)
            USING (variant)),
    it AS (SELECT variant, run, tol, 0 AS k, 1e9 AS ks,
                  list_transform(prior, lambda x: x / list_sum(prior) * list_sum(data)) AS n, n AS est, n AS last
           FROM m, ({runs})
           UNION ALL
           SELECT variant, run, tol, k + 1, list_max(list_transform({each}, lambda i:
                      abs(list_sum(new[1:i]) / list_sum(new) - list_sum(n[1:i]) / list_sum(n)))),
                  {'new' if degree is None else 'smooth'}, new, n
           FROM {new}),
    done AS (SELECT * FROM it QUALIFY k = MAX(k) OVER (PARTITION BY variant, run))"""


def _unfolded_sql(eff_err: str = "0e0") -> str:
    """SELECT of variant, bin, unfolded, stat_err, sys_err, iterations, ks after ``_iterated_sql``."""
    each = f"range(1, {N_BINS + 1})"
    div = lambda a, b: f"(CASE WHEN {b} = 0 THEN 0e0 ELSE {a} / ({b}) END)"
    sh = f"(by_cause[i][j] * {div(div('data[j]', 'seen[j]'), 'seen[j]')} * {div('last[i]', 'eff[i]')})"
    di = f"({div('data[j]', 'seen[j]')} * {div('last[i]', 'eff[i]')})"
    return f"""
    SELECT variant, CAST(i - 1 AS INTEGER) AS bin, est[i] AS unfolded, k AS iterations, ks,
           sqrt(list_sum(list_transform({each}, lambda j: pow({div('by_cause[i][j] * last[i]', 'eff[i] * seen[j]')}, 2) * data[j])))
               AS stat_err,
           sqrt(greatest(0e0, list_sum(list_transform({each}, lambda j:
                   ({di} * {di} - 2e0 * {di} * {sh} * last[i]) * err_by_cause[i][j] * err_by_cause[i][j]
                   + list_sum(list_transform({each}, lambda c: pow(err_by_effect[j][c] * last[c], 2))) * {sh} * {sh})))
               + pow({eff_err}, 2)) AS sys_err
    FROM (SELECT *, list_transform({each}, lambda j: list_dot_product(by_effect[j], last)) AS seen
          FROM done JOIN m USING (variant)), {each} x(i)"""


TOLERANCES = (1e-2, 5e-3, 3e-3, 2e-3, 1e-3, 5e-4, 1e-4, 1e-5)
_RUNS = "SELECT * FROM (VALUES " + ", ".join(f"({i}, {num(x)})" for i, x in enumerate(TOLERANCES)) + ") r(run, tol)"


@query("unfold_tol_scan", f"""
    WITH RECURSIVE {_iterated_sql("SELECT variant, bin, n FROM (" + _SEEN_SQL + ")", "2 / (lo + hi)", _RUNS, 100)}
    SELECT variant || '|' || CAST(run AS VARCHAR) AS variant, k AS iterations, {R('ks', 9)} AS ks
    FROM done""", "evt")
def unfold_tol_scan(t):
    cells = response_cells(t)
    bins = unfolding_bins(t, cells, prior="jeffreys")
    out = unfold.unfold(unfold.tolerance_variants(cells, TOLERANCES),
                        unfold.tolerance_variants(bins, TOLERANCES))
    return out.groupBy("variant").agg(F.max("iterations").alias("iterations"),
                                      r(F.max("ks"), 9).alias("ks"))


@query("unfold_regularised", f"""
    WITH RECURSIVE {_iterated_sql("SELECT variant, bin, n FROM (" + _SEEN_SQL + ")", "2 / (lo + hi)",
                                  "SELECT 0 AS run, 1e-3 AS tol", 100, degree=3)}
    SELECT variant, bin, iterations, {R('ks', 9)} AS ks, {G('unfolded', 6)} AS unfolded, {G('stat_err', 6)} AS stat_err,
           {G('sys_err', 6)} AS sys_err FROM ({_unfolded_sql()})""", "evt")
def unfold_regularised(t):
    """Unfolding with a cubic in log counts between iterations."""
    cells = response_cells(t)
    out = unfold.unfold(cells, unfolding_bins(t, cells, prior="jeffreys"), degree=3)
    return out.select("variant", "bin", "iterations", r("ks", 9).alias("ks"),
                      *[g(c, 6).alias(c) for c in ("unfolded", "stat_err", "sys_err")])


_MC_SEEN_SQL = f"""
    SELECT v.variant, b.bin, coalesce(d.n, 0) AS n
    FROM (SELECT DISTINCT CAST(pdg AS VARCHAR) AS variant FROM evt WHERE sample = 'mc') v, ({B}) b
    LEFT JOIN (SELECT CAST(pdg AS VARCHAR) AS variant, b.bin, SUM(w) AS n FROM evt JOIN {B} b
               ON {in_bin('loge_p')} WHERE sample = 'mc' GROUP BY pdg, b.bin) d
      ON d.variant = v.variant AND d.bin = b.bin"""


@query("unfold_closure", f"""
    WITH RECURSIVE {_iterated_sql(_MC_SEEN_SQL, "1e0", "SELECT 0 AS run, 1e-6 AS tol", 200)},
    u AS (SELECT variant, unnest(range({N_BINS})) AS bin, unnest(n) AS unfolded FROM done),
    truth AS (SELECT CAST(pdg AS VARCHAR) AS variant, bin, SUM(w) AS truth FROM evt JOIN {B} b
              ON {in_bin('loge')} WHERE sample = 'mc' GROUP BY pdg, bin)
    SELECT variant, CAST(bin AS INTEGER) AS bin, {G('unfolded', 6)} AS unfolded, {G('coalesce(truth, 0)', 6)} AS truth,
           CASE WHEN coalesce(truth, 0) > 0 THEN {G('unfolded / truth', 6)} ELSE 0 END AS closure
    FROM u LEFT JOIN truth USING (variant, bin)""", "evt")
def unfold_closure(t):
    """Unfold the simulated reconstruction and compare with the simulated truth."""
    mc = t.evt.filter("sample = 'mc'")
    cells = response_cells(t)
    bins = unfolding_bins(t, cells, reco=mc, weight=F.col("w"))
    out = unfold.unfold(cells, bins, tol=1e-6, max_iter=200)
    truth = hist.hist1d(mc.withColumn("variant", F.col("pdg").cast("string")), F.col("loge"),
                        LOGE, F.col("w"), by=["variant"])
    return out.join(truth.select("variant", "bin", F.col("sum_w").alias("truth")),
                    ["variant", "bin"]).select(
        "variant", "bin", g("unfolded", 6).alias("unfolded"), g("truth", 6).alias("truth"),
        g(ratio_or_zero(F.col("unfolded"), F.col("truth")), 6).alias("closure"))


# --- spectra as tables -----------------------------------------------------------

@query("interp_bins", f"""
    WITH h AS (SELECT pdg, b.bin, coalesce(SUM(w), 0) AS v
               FROM (SELECT DISTINCT pdg FROM evt) p, ({B}) b
               LEFT JOIN evt e ON e.pdg = p.pdg AND {in_bin('loge')} GROUP BY ALL),
         n AS (SELECT *, lead(v) OVER (PARTITION BY pdg ORDER BY bin) AS nxt FROM h)
    SELECT pdg, 2 * bin AS bin, {G('v')} AS value FROM n
    UNION ALL SELECT pdg, 2 * bin + 1, {G('coalesce((v + nxt) * 0.5e0, v)')} FROM n""".replace(
        "SELECT pdg, b.bin, coalesce", "SELECT p.pdg, b.bin, coalesce"), "evt")
def interp_bins(t):
    h = hist.hist1d(t.evt, F.col("loge"), LOGE, F.col("w"), by=["pdg"])
    return spectrum.half_bins(h.withColumnRenamed("sum_w", "value"), ["pdg"], "value").select(
        "pdg", "bin", g("value").alias("value"))


_HAWC_SQL = """
    tab AS (SELECT log_energy AS x0, log10(flux) AS y0, lead(log_energy) OVER (ORDER BY log_energy) AS x1,
                   lead(log10(flux)) OVER (ORDER BY log_energy) AS y1
            FROM (VALUES {rows}) AS v(log_energy, flux))"""


def _hawc_rows() -> str:
    return ", ".join(f"({num(round(4.05 + 0.1 * i, 2))}, {num(f)})" for i, f in enumerate(HAWC_FLUX))


@query("spectrum_compare", f"""
    WITH f AS (SELECT bin, (lo + hi) * 0.5e0 AS x,
                      COUNT(*) / ((hi - lo) * {LN10} * {AREA} * {SOLID} * (SELECT SUM(duration) FROM run_dim)) AS flux
               FROM evt JOIN {B} b ON {in_bin('loge_p')} WHERE {SEEN} GROUP BY bin, lo, hi),
    {_HAWC_SQL.format(rows=_hawc_rows())}
    SELECT bin, {G('flux')} AS flux, {G('pow(1e1, y0 + (y1 - y0) / (x1 - x0) * (x - x0))', 8)} AS other,
           {G('100 * (flux / pow(1e1, y0 + (y1 - y0) / (x1 - x0) * (x - x0)) - 1)', 8)} AS difference
    FROM f JOIN tab ON x >= x0 AND x < x1""", "evt run_dim")
def spectrum_compare(t):
    h = hist.hist1d(seen(t), F.col("loge_p"), LOGE, fill=False)
    duration = summary.exposure(t.run_dim).select("duration").scalar()
    lo, hi = F.col("lo"), F.col("hi")
    flux = spectrum.flux_from_counts(F.col("n"), lo, hi, spectrum.generation_area(lo), WINDOW, duration)
    ours = h.select("bin", edges.centre(lo, hi).alias("log_energy"), flux.alias("flux"))
    other = outside_spectra(t.spark).filter("name = 'hawc'").select("log_energy", "flux")
    j = spectrum.log_log_interpolate(ours, other, out="other")
    return j.select("bin", g("flux").alias("flux"), g("other", 8).alias("other"),
                    g(100.0 * (F.col("flux") / F.col("other") - 1.0), 8).alias("difference"))


def _published_sql() -> str:
    rows = [("hawc", round(4.05 + 0.1 * i, 2), f) for i, f in enumerate(HAWC_FLUX)]
    rows += [("three_year", e, f) for e, f in zip(THREE_YEAR_LOGE, THREE_YEAR_FLUX)]
    return ", ".join(f"('{n}', {num(x)}, {num(f)})" for n, x, f in rows)


_SPLINE_SQL = f"""
    tab AS (SELECT name, row_number() OVER (PARTITION BY name ORDER BY x) - 1 AS i, x, log10(flux) AS y,
                   COUNT(*) OVER (PARTITION BY name) AS n
            FROM (VALUES {_published_sql()}) AS v(name, x, flux)),
    gap AS (SELECT *, lead(x) OVER w - x AS h, (lead(y) OVER w - y) / (lead(x) OVER w - x) AS slope FROM tab
            WINDOW w AS (PARTITION BY name ORDER BY i)),
    fwd AS (SELECT DISTINCT name, n, 0::BIGINT AS i, 0e0 AS c, 0e0 AS d FROM tab
            UNION ALL
            SELECT name, f.n, f.i + 1, b.h / (2 * (a.h + b.h) - a.h * c),
                   (6 * (b.slope - a.slope) - a.h * d) / (2 * (a.h + b.h) - a.h * c)
            FROM fwd f JOIN gap a USING (name) JOIN gap b USING (name)
            WHERE a.i = f.i AND b.i = f.i + 1 AND f.i + 1 < f.n - 1),
    bwd AS (SELECT DISTINCT name, n - 1 AS i, 0e0 AS m FROM tab
            UNION ALL
            SELECT name, b.i - 1, f.d - f.c * m FROM bwd b JOIN fwd f USING (name) WHERE f.i = b.i - 1 AND f.i > 0),
    curve AS (SELECT g.*, coalesce(m.m, 0) AS m0, coalesce(k.m, 0) AS m1, g.x + g.h AS x1, y + slope * g.h AS y1 FROM gap g
              LEFT JOIN bwd m ON m.name = g.name AND m.i = g.i LEFT JOIN bwd k ON k.name = g.name AND k.i = g.i + 1
              WHERE g.h IS NOT NULL)"""


@query("spline_compare", f"""
    WITH RECURSIVE {_SPLINE_SQL},
    f AS (SELECT bin, (lo + hi) * 0.5e0 AS e,
                 COUNT(*) / ((hi - lo) * {LN10} * {AREA} * {SOLID} * (SELECT SUM(duration) FROM run_dim)) AS flux
          FROM evt JOIN {B} b ON {in_bin('loge_p')} WHERE {SEEN} GROUP BY bin, lo, hi),
    o AS (SELECT name, bin, flux, pow(1e1, (x1 - e) / h * y + (e - x) / h * y1
                 + ((pow((x1 - e) / h, 3) - (x1 - e) / h) * m0 + (pow((e - x) / h, 3) - (e - x) / h) * m1) * h * h / 6) AS other
          FROM f JOIN curve ON e >= x AND e < x1)
    SELECT name, bin, {G('flux')} AS flux, {G('other', 8)} AS other, {G('100 * (flux / other - 1)', 8)} AS difference FROM o""",
       "evt run_dim")
def spline_compare(t):
    """Difference from every published spectrum at our energies, by natural cubic splines."""
    h = hist.hist1d(seen(t), F.col("loge_p"), LOGE, fill=False)
    duration = summary.exposure(t.run_dim).select("duration").scalar()
    lo, hi = F.col("lo"), F.col("hi")
    flux = spectrum.flux_from_counts(F.col("n"), lo, hi, spectrum.generation_area(lo), WINDOW, duration)
    ours = h.select("bin", edges.centre(lo, hi).alias("log_energy"), flux.alias("flux"),
                    F.explode(F.array(F.lit("hawc"), F.lit("three_year"))).alias("name"))
    j = spectrum.spline_interpolate(ours, outside_spectra(t.spark), ["name"], out="other")
    return j.select("name", "bin", g("flux").alias("flux"), g("other", 8).alias("other"),
                    g(100.0 * (F.col("flux") / F.col("other") - 1.0), 8).alias("difference"))


#: CTEs up to ``fit``, the sigmoid through the effective area ``area`` of every particle.
AREA_FIT_SQL = f"""
    gen AS (SELECT CAST(pdg AS VARCHAR) AS variant, bin, lo, hi, SUM(w) AS sw, sqrt(SUM(w * w)) AS se FROM evt JOIN {B} b
            ON {in_bin('loge')} WHERE cos(zenith) BETWEEN 0.8e0 AND 1 GROUP BY pdg, bin, lo, hi),
    sel AS (SELECT CAST(pdg AS VARCHAR) AS variant, bin, SUM(w) AS s, sqrt(SUM(w * w)) AS se FROM booked JOIN {B} b
            ON {in_bin('loge')} WHERE {CUT} GROUP BY pdg, bin),
    area AS (SELECT variant, bin, (lo + hi) * 0.5e0 AS log_energy, coalesce(s, 0) / sw * {AREA} AS aeff,
                    sqrt(pow(coalesce(sel.se, 0) / sw, 2) + pow(coalesce(s, 0) * gen.se / (sw * sw), 2)) * {AREA} AS aeff_err
             FROM gen LEFT JOIN sel USING (variant, bin)),
    {fit_ctes('variant', """SELECT variant, log_energy AS x, aeff AS y, 1.0e0 / (aeff_err * aeff_err) AS w FROM area
                            WHERE log_energy BETWEEN 4.0e0 AND 7.0e0 AND aeff_err > 0""",
              "SELECT variant, MAX(aeff) AS p0, 5.0e0 AS p1, 5.0e0 AS p2 FROM area GROUP BY variant", SIGMOID)}"""


@query("sigmoid_aeff", f"""
    WITH RECURSIVE {AREA_FIT_SQL}
    SELECT variant, n, converged, {', '.join(f"{G(c, 6)} AS {c}" for c in ('p0', 'p1', 'p2'))},
           {', '.join(f"{G(c, 5)} AS {c}" for c in ('e0', 'e1', 'e2', 'c01', 'c02', 'c12'))} FROM fit""", "evt booked")
def sigmoid_aeff(t):
    f = fits.sigmoid_fit(area_bins(t), 4.0, 7.0)
    return f.select("variant", "n", "converged", *[g(c, 6).alias(c) for c in ("p0", "p1", "p2")],
                    *[g(c, 5).alias(c) for c in ("e0", "e1", "e2", "c01", "c02", "c12")])


def area_bins(t):
    """(variant, bin, log_energy, aeff, aeff_err) of the effective area per particle."""
    gen = spectrum.n_generated(t.evt, LOGE, F.col("w"), WINDOW, by=["pdg"])
    sel = hist.hist1d(selected(t), F.col("loge"), LOGE, F.col("w"), by=["pdg"], fill=False)
    a = spectrum.effective_area(spectrum.efficiency(sel, gen, ["pdg", "bin"]))
    return a.select(F.col("pdg").cast("string").alias("variant"), "bin",
                    edges.centre(F.col("lo"), F.col("hi")).alias("log_energy"), "aeff", "aeff_err")
