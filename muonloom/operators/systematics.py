"""Systematic uncertainties: small tables keyed by bin, built from many variants."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, functions as F

from muonloom.functions.guards import quadrature, ratio, ratio_error
from muonloom.functions.shapes import scale_flux, sigmoid


def envelope(shifts: DataFrame, value: str, by: Sequence[str] = ("bin",)) -> DataFrame:
    """Lowest and highest shift over all variants, clipped at 0; low is returned positive."""
    return shifts.groupBy(*by).agg(
        (-F.least(F.min(value), F.lit(0.0))).alias("sys_low"),
        F.greatest(F.max(value), F.lit(0.0)).alias("sys_high"))


def add_in_quadrature(sources: DataFrame, by: Sequence[str] = ("bin",),
                      low: str = "sys_low", high: str = "sys_high") -> DataFrame:
    """Total of independent sources given as rows."""
    sq = lambda c: F.sqrt(F.sum(F.col(c) * F.col(c)))
    return sources.groupBy(*by).agg(sq(low).alias(low), sq(high).alias(high))


def picked(df: DataFrame, key: str, names: Sequence[str], values: Sequence[str],
           by: Sequence[str] = ("bin",)) -> DataFrame:
    """Values of chosen variants side by side: one row per bin, columns value_name."""
    return df.groupBy(*by).agg(*[
        F.max(F.when(F.col(key) == n, F.col(v))).alias(f"{v}_{n}")
        for v in values for n in names])


def composition_shift(fluxes: DataFrame, reference: str, by: Sequence[str] = ("bin",)) -> DataFrame:
    """Deviation (flux - model) / model of every variant minus that of the reference.

    ``fluxes``: (variant, bin, flux, model).
    """
    dev = fluxes.withColumn("dev", ratio(F.col("flux") - F.col("model"), F.col("model")))
    ref = dev.filter(F.col("variant") == reference).select(*by, F.col("dev").alias("_ref"))
    return dev.join(ref, list(by)).select(
        *by, "variant", (F.col("dev") - F.col("_ref")).alias("shift"))


def pressure(spectra: DataFrame, reference: str, other: str, key: str = "season",
             by: Sequence[str] = ("bin",)) -> DataFrame:
    """Relative change between two pressure seasons, its error, and the correction 1 - shift."""
    p = picked(spectra, key, [reference, other], ["flux", "stat"], by)
    f0, f1 = F.col(f"flux_{reference}"), F.col(f"flux_{other}")
    e0, e1 = F.col(f"stat_{reference}"), F.col(f"stat_{other}")
    change = ratio(f1 - f0, f0)
    shift = -F.least(change, F.lit(0.0))
    return p.select(*by, change.alias("change"),
                    ratio_error(f1 - f0, f0, e1 - e0, e0).alias("sys"),
                    shift.alias("flux_shift"), (1.0 - shift).alias("correction"))


def temperature(spectra: DataFrame, seasons: Sequence[str], key: str = "season",
                by: Sequence[str] = ("bin",)) -> DataFrame:
    """Envelope of three seasons around their mean, and the error of each deviation."""
    p = picked(spectra, key, seasons, ["flux", "stat"], by)
    k = float(len(seasons))
    mean = sum((F.col(f"flux_{s}") for s in seasons), F.lit(0.0)) / k
    mean_err = quadrature(*[F.col(f"stat_{s}") for s in seasons]) / k
    p = p.withColumns({"_m": mean, "_e": mean_err})
    shift = {s: ratio(F.col(f"flux_{s}") - F.col("_m"), F.col("_m")) for s in seasons}
    err = {
        s: ratio_error(F.col(f"flux_{s}") - F.col("_m"), F.col("_m"),
                       quadrature(F.col(f"stat_{s}"), F.col("_e")), F.col("_e"))
        for s in seasons
    }
    return p.select(
        *by,
        F.least(F.least(*shift.values()), F.lit(0.0)).alias("sys_low"),
        F.greatest(F.greatest(*shift.values()), F.lit(0.0)).alias("sys_high"),
        F.greatest(*err.values()).alias("sys_err"))


def duration_shift(t: Column, t_minus: Column, t_plus: Column) -> tuple[Column, Column]:
    """Relative flux change (low, high) when the livetime moves by one sigma."""
    return (1 / t_minus - 1 / t) * t, (1 / t - 1 / t_plus) * t


def area_shift(bins: DataFrame, params: DataFrame, on: Sequence[str] = ("variant",)) -> DataFrame:
    """Effect of the fitted-area errors: every on/off choice of the three parameter errors, +-.

    ``bins``: (variant, bin, log_energy, aeff); ``params``: (variant, p0..2, e0..2).
    Variants whose fit failed (NULL parameters) have no row.
    """
    j = bins.join(params.filter(F.col("p0").isNotNull()), list(on))
    x = F.col("log_energy")
    curves = [
        sigmoid(x, *[F.col(f"p{i}") + s * f * F.col(f"e{i}") for i, f in enumerate(flags)])
        for flags in product((0, 1), repeat=3) for s in (1, -1)
    ]
    lowest, highest = F.least(F.col("aeff"), *curves), F.greatest(F.col("aeff"), *curves)
    inv = ratio(F.lit(1.0), F.col("aeff"))
    return j.select(
        *on, "bin",
        (ratio(ratio(F.lit(1.0), lowest) - inv, inv)).alias("sys_low"),
        (ratio(inv - ratio(F.lit(1.0), highest), inv)).alias("sys_high"))


def total(sources: DataFrame, by: Sequence[str] = ("bin",)) -> DataFrame:
    """Quadrature total where pressure and temperature first add linearly.

    ``sources``: (bin, source, sys_low, sys_high) with low given as stored, so
    a negative temperature low widens the pressure low.
    """
    merged = F.col("source").isin("pressure", "temperature")
    group = F.when(merged, F.lit("pressure+temperature")).otherwise(F.col("source"))
    low = F.when(F.col("source") == "temperature", -F.col("sys_low")).otherwise(F.col("sys_low"))
    linear = sources.select(*by, group.alias("source"), low.alias("sys_low"), "sys_high") \
        .groupBy(*by, "source").agg(F.sum("sys_low").alias("sys_low"),
                                    F.sum("sys_high").alias("sys_high"))
    return add_in_quadrature(linear, by)


def final_spectrum(flux: DataFrame, sys: DataFrame, unfolding: str = "unfold_sys",
                   scale: float = 2.65, window=(5.4, 7.0), on: Sequence[str] = ("bin",)) -> DataFrame:
    """Flux with statistical and total systematic errors, scaled by E^(scale-1), inside a window.

    ``flux``: (bin, log_energy, flux, stat, unfold_sys as a flux).
    """
    j = flux.join(sys, list(on), "left")
    f = F.col("flux")
    frac = lambda c: quadrature(F.coalesce(ratio(F.col(unfolding), f), F.lit(0.0)),
                                F.coalesce(F.col(c), F.lit(0.0)))
    k = scale_flux(F.pow(F.lit(10.0), F.col("log_energy")), scale)
    return j.filter(F.col("log_energy").between(*window)).select(
        *on, "log_energy", (k * f).alias("flux"), (k * F.col("stat")).alias("stat"),
        (k * f * frac("sys_low")).alias("sys_low"),
        (k * f * frac("sys_high")).alias("sys_high"))


def spectrum_ratio(a: DataFrame, b: DataFrame, on: Sequence[str] = ("bin",)) -> DataFrame:
    """Ratio a / b per bin with the low and high systematic errors propagated."""
    x = a.select(*on, F.col("flux").alias("xa"), F.col("sys_low").alias("la"),
                 F.col("sys_high").alias("ha"))
    y = b.select(*on, F.col("flux").alias("xb"), F.col("sys_low").alias("lb"),
                 F.col("sys_high").alias("hb"))
    err = lambda e1, e2: ratio_error(F.col("xa"), F.col("xb"), F.col(e1), F.col(e2))
    return x.join(y, list(on)).select(
        *on, ratio(F.col("xa"), F.col("xb")).alias("ratio"),
        err("la", "lb").alias("err_low"), err("ha", "hb").alias("err_high"))
