"""The whole chain in one query; importing this module registers every query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from muonloom.functions import edges, features
from muonloom.operators import hist, pulses
from muonloom.plans import (  # noqa: F401  (they register)
    arrivals, booking, chains, histograms, hits, learning, selection, spectra, uncertainty)
from muonloom.plans.registry import g, query
from muonloom.plans.views import KEY, TIES, Tables


def energy_spectrum(spark: SparkSession, folder: str) -> DataFrame:
    """Hits and tanks to arrays, features, cuts and a weighted histogram of log-energy."""
    t = Tables(spark, folder)
    booked = pulses.event_arrays(t.evt, t.pulse, t.tank, KEY, ties=TIES)
    p = F.col("pulses")
    cut = booked.withColumns({
        "qsum2": features.leading_sum(p),
        "q": features.total(p),
        "reach": F.get(features.frac_radius(F.col("tank_x"), F.col("tank_y"), F.col("x_p"),
                                            F.col("y_p")), F.lit(0)),
    }).filter(F.col("filt") & (F.col("qsum2") <= 0.9 * F.col("q")) & (F.col("reach") > 0))
    h = hist.hist1d(cut, F.col("loge"), edges.LOGE_EDGES, F.col("w"))
    return h.select("bin", "lo", "hi", g("sum_w").alias("sum_w"), g("err").alias("err"), "n")
