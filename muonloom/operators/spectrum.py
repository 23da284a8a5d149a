"""From weighted events to efficiency, effective area, response and flux."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from muonloom.functions import splines
from muonloom.functions.edges import bin_index, centre, dlne, edge_at
from muonloom.functions.guards import ratio, ratio_error, ratio_or_zero
from muonloom.functions.shapes import flux
from muonloom.operators.hist import fill_bins, hist1d, hist2d
from muonloom.sources.constants import PDG, RESAMPLE_RADIUS


@dataclass(frozen=True)
class ZenithWindow:
    """Cosine window of an analysis: what selects the events also gives the solid angle."""

    cos_lo: float = 0.8
    cos_hi: float = 1.0

    def holds(self, zenith: Column | str) -> Column:
        return F.cos(zenith).between(self.cos_lo, self.cos_hi)

    @property
    def solid_angle(self) -> float:
        """Projected solid angle of a flat detector."""
        return math.pi * (self.cos_hi * self.cos_hi - self.cos_lo * self.cos_lo)


def resample_radius(lo: Column) -> Column:
    """Radius in metres of the simulated disc by the decade of the lower bin edge."""
    out = F.when(F.lit(False), F.lit(0.0))
    for decade, radius in RESAMPLE_RADIUS.items():
        out = out.when((lo >= decade) & (lo < decade + 1), F.lit(radius))
    return out.otherwise(F.lit(0.0))


def generation_area(lo: Column) -> Column:
    r = resample_radius(lo)
    return math.pi * r * r


def max_zenith(pdg: Column, lo: Column) -> Column:
    """Largest generated zenith in degrees: 40 for helium and oxygen below 1e5 GeV, else 65."""
    narrow = pdg.isin(PDG["helium"], PDG["oxygen"]) & (lo < 5.0)
    return F.when(narrow, F.lit(40.0)).otherwise(F.lit(65.0))


def acceptance(pdg: Column, lo: Column) -> Column:
    """Area times projected solid angle of the generator."""
    c = F.cos(F.radians(max_zenith(pdg, lo)))
    return math.pi * generation_area(lo) * (1.0 - c * c)


def element_flux(model: str, pdg: Column, energy: Column) -> Column:
    """Flux of the particle's own element group."""
    out = F.when(F.lit(False), F.lit(0.0))
    for name, code in PDG.items():
        out = out.when(pdg == code, flux(model, energy, element=name))
    return out


def composition_weights(events: DataFrame, generated: DataFrame, edges: Sequence[float],
                        models: Sequence[str] = ("h4a", "poly"),
                        energy: str = "energy") -> DataFrame:
    """Event weights per flux model, for the own-element and the all-particle assumption.

    weight = J(E) * area * solid angle * dlnE / N_generated(pdg, bin).  The
    generated counts have at most 4 particles x len(edges) rows, a proven bound,
    so they are broadcast and events are neither shuffled nor multiplied.
    """
    log_e = F.log10(F.col(energy))
    known = F.col("pdg").isin(*PDG.values())
    counts = (
        generated.filter(known)
        .select("pdg", bin_index(log_e, edges).alias("bin"))
        .filter(F.col("bin").isNotNull())
        .groupBy("pdg", "bin").agg(F.count(F.lit(1)).alias("n_gen"))
    )
    lo = edge_at(edges, F.col("bin"))
    hi = edge_at(edges, F.col("bin") + 1)
    norm = F.try_divide(acceptance(F.col("pdg"), lo) * dlne(lo, hi), F.col("n_gen"))
    joined = (
        events.filter(known).withColumn("bin", bin_index(log_e, edges))
        .join(F.broadcast(counts), ["pdg", "bin"])
        .withColumn("_norm", norm)
    )
    e = F.col(energy)
    columns = {}
    for m in models:
        columns[f"weight_{m}"] = element_flux(m, F.col("pdg"), e) * F.col("_norm")
        columns[f"weight_all_{m}"] = flux(m, e) * F.col("_norm")
    return joined.withColumns(columns).drop("_norm", "n_gen")


def n_generated(generated: DataFrame, edges: Sequence[float], weight: Column,
                window: ZenithWindow = ZenithWindow(), by: Sequence[str] = (),
                energy: str = "energy", zenith: str = "zenith",
                legacy_error: bool = False) -> DataFrame:
    """Weighted and raw generated counts per bin inside a zenith window, all particles at once.

    ``legacy_error`` returns the sum of squared weights in place of its root.
    """
    h = hist1d(generated.filter(window.holds(zenith)), F.log10(F.col(energy)), edges, weight, by)
    err = F.col("err") * F.col("err") if legacy_error else F.col("err")
    return h.withColumn("err", F.when(F.isnan(err) | (F.abs(err) == float("inf")), F.lit(0.0))
                        .otherwise(err))


def efficiency(selected: DataFrame, generated: DataFrame, on: Sequence[str] = ("bin",)) -> DataFrame:
    """Selected over generated per bin; bins with nothing generated have efficiency 0."""
    s = selected.select(*on, F.col("sum_w").alias("_s"), F.col("err").alias("_se"))
    j = generated.join(s, list(on), "left")
    sel, sel_err = F.coalesce("_s", F.lit(0.0)), F.coalesce("_se", F.lit(0.0))
    return j.select(
        *on, "lo", "hi",
        ratio_or_zero(sel, F.col("sum_w")).alias("eff"),
        F.coalesce(ratio_error(sel, F.col("sum_w"), sel_err, F.col("err")), F.lit(0.0))
        .alias("eff_err"))


def effective_area(eff: DataFrame) -> DataFrame:
    area = generation_area(F.col("lo"))
    return eff.withColumns({"aeff": F.col("eff") * area, "aeff_err": F.col("eff_err") * area})


def flux_from_counts(counts: Column, lo: Column, hi: Column, aeff: Column,
                     window: ZenithWindow, duration=1.0) -> Column:
    """counts / (dlnE * Aeff * solid angle * T); NULL without area.  Counts were selected by ``window``."""
    return F.try_divide(counts, dlne(lo, hi) * aeff * window.solid_angle * duration)


def flux_error(counts, err, aeff, aeff_err, lo, hi, window: ZenithWindow, duration=1.0) -> Column:
    """Error of counts / Aeff in the unit of the flux."""
    return ratio_error(counts, aeff, err, aeff_err) / (dlne(lo, hi) * window.solid_angle * duration)


def response_matrix(df: DataFrame, reco: Column, true: Column, weight: Column,
                    edges: Sequence[float], efficiencies: DataFrame | None = None,
                    by: Sequence[str] = (), legacy_error: bool = False) -> DataFrame:
    """P(reconstructed bin = effect | true bin = cause), columns summing to the efficiency.

    Without ``efficiencies`` (by..., bin, eff) the efficiency of a cause is the
    share of its weight that was reconstructed inside the range.  ``p_err`` is
    the standard error; ``legacy_error`` gives the scaled sum of squared weights,
    as older tables had it.
    """
    cells = hist2d(df, reco, true, edges, edges, weight, by).select(
        *by, F.col("bin_x").alias("effect"), F.col("bin_y").alias("cause"), "sum_w", "sum_w2")
    # spans the effects of one cause: at most len(edges) rows
    column = F.sum("sum_w").over(Window.partitionBy(*by, "cause"))
    cells = cells.withColumn("column_sum", column)
    if efficiencies is None:
        truth = hist1d(df, true, edges, weight, by).select(
            *by, F.col("bin").alias("cause"), F.col("sum_w").alias("true_sum"))
        cells = cells.join(truth, [*by, "cause"]).withColumn(
            "eff", ratio_or_zero(F.col("column_sum"), F.col("true_sum"))).drop("true_sum")
    else:
        cells = cells.join(
            efficiencies.select(*by, F.col("bin").alias("cause"), "eff"), [*by, "cause"])
    norm = ratio(F.col("eff"), F.col("column_sum"))
    err = F.col("sum_w2") if legacy_error else F.sqrt("sum_w2")
    return cells.select(
        *by, "cause", "effect",
        F.coalesce(F.col("sum_w") * norm, F.lit(0.0)).alias("p"),
        F.coalesce(err * norm, F.lit(0.0)).alias("p_err"), "eff")


def mean_true_energy(df: DataFrame, log_energy: Column, weight: Column,
                     edges: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Weighted mean energy per bin; the bin centre where the weights sum to 0."""
    rows = df.select(*by, F.when(log_energy < F.lit(edges[-1]),
                                 bin_index(log_energy, edges)).alias("bin"),
                     weight.alias("_w"), F.pow(F.lit(10.0), log_energy).alias("_e"))
    sums = rows.filter(F.col("bin").isNotNull()).groupBy(*by, "bin").agg(
        F.sum("_w").alias("sw"), F.sum(F.col("_w") * F.col("_e")).alias("swe"))
    full = fill_bins(sums, by, len(edges) - 1, ["sw", "swe"])
    mid = centre(edge_at(edges, F.col("bin")), edge_at(edges, F.col("bin") + 1))
    mean = F.when(F.col("sw") > 0, F.col("swe") / F.col("sw"))
    return full.select(*by, "bin", F.coalesce(mean, F.pow(F.lit(10.0), mid)).alias("mean_e"))


def generator_check(generated: DataFrame, edges: Sequence[float], model: str,
                    weight: str, energy: str = "energy") -> DataFrame:
    """Flux rebuilt from the weights over the model flux at the bin centre, per particle."""
    known = generated.filter(F.col("pdg").isin(*PDG.values()))
    h = hist1d(known, F.log10(F.col(energy)), edges, F.col(weight), by=["pdg"], fill=False)
    rebuilt = F.try_divide(F.col("sum_w"), dlne(F.col("lo"), F.col("hi"))
                           * acceptance(F.col("pdg"), F.col("lo")))
    at_centre = flux(model, F.pow(F.lit(10.0), centre(F.col("lo"), F.col("hi"))))
    return h.select("pdg", "bin", rebuilt.alias("flux"), at_centre.alias("model"),
                    F.try_divide(rebuilt, at_centre).alias("ratio"))


def half_bins(table: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Values at half the bin width: each value, then its mean with the next (the last repeats)."""
    nxt = F.lead(value).over(Window.partitionBy(*by).orderBy("bin"))
    mid = F.coalesce((F.col(value) + nxt) * 0.5, F.col(value))
    return table.withColumn("_pair", F.array(F.col(value), mid)).select(
        *by, F.posexplode("_pair").alias("_p", value), "bin").select(
        *by, (F.col("bin") * 2 + F.col("_p")).alias("bin"), value)


def log_log_interpolate(at: DataFrame, spectrum: DataFrame, x: str = "log_energy",
                        y: str = "flux", out: str = "flux_at") -> DataFrame:
    """Values of a tabulated spectrum at other log-energies, straight in log-log.

    The table becomes one segment per pair of neighbours; points outside get
    no row.  Segments are put on an integer grid so that the range condition
    becomes an equi-join.
    """
    order = Window.partitionBy(F.lit(0)).orderBy(x)  # a spectrum: tens of points
    step = 0.25
    seg = spectrum.select(
        F.col(x).alias("_x0"), F.log10(F.col(y)).alias("_y0"),
        F.lead(x).over(order).alias("_x1"), F.lead(F.log10(F.col(y))).over(order).alias("_y1"),
    ).filter(F.col("_x1").isNotNull())
    seg = seg.withColumn("_cell", F.explode(F.sequence(
        F.floor(F.col("_x0") / step), F.floor(F.col("_x1") / step))))
    slope = (F.col("_y1") - F.col("_y0")) / (F.col("_x1") - F.col("_x0"))
    hit = (F.col(x) >= F.col("_x0")) & (F.col(x) < F.col("_x1"))
    return (
        at.withColumn("_cell", F.floor(F.col(x) / step))
        .join(seg, "_cell").filter(hit)
        .withColumn(out, F.pow(F.lit(10.0), F.col("_y0") + slope * (F.col(x) - F.col("_x0"))))
        .drop("_cell", "_x0", "_x1", "_y0", "_y1")
    )



def spline_interpolate(at: DataFrame, spectra: DataFrame, by: Sequence[str], x: str = "log_energy",
                       y: str = "flux", out: str = "flux_at") -> DataFrame:
    """Values of tabulated spectra at other log-energies by a natural cubic spline through log10 of the flux.

    A spectrum, named by ``by``, is tens of points: it becomes one row of
    ordered arrays with its curvatures, and rows of ``at`` (which has ``by``
    too) meet it by name.  Points outside a spectrum get no row.
    """
    knots = spectra.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(
        F.col(x).alias("x"), F.log10(F.col(y)).alias("y")))).alias("_k"))
    knots = knots.select(*by, F.col("_k.x").alias("_x"), F.col("_k.y").alias("_y"))
    knots = knots.withColumn("_m", splines.curvatures(F.col("_x"), F.col("_y")))
    value = splines.spline_value(F.col("_x"), F.col("_y"), F.col("_m"), F.col(x))
    return (at.join(knots, list(by)).withColumn(out, F.pow(F.lit(10.0), value))
            .filter(F.col(out).isNotNull()).drop("_x", "_y", "_m"))
