"""Whole chains: raw hits to event records, and events to a measured spectrum."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from muonloom.functions import edges
from muonloom.operators import geometry, hist, pulses, spectrum, summary, systematics, unfold
from muonloom.plans.booking import FINE
from muonloom.plans.hits import CLEAN_SQL
from muonloom.plans.registry import R, g, query, r
from muonloom.plans.spectra import WINDOW, selected
from muonloom.plans.uncertainty import sys_pressure, total_systematics
from muonloom.plans.views import KEY
from muonloom.session import cut_lineage

LOGE = edges.LOGE_EDGES


def event_records(events: DataFrame, hlc: DataFrame, slc: DataFrame, bad_tanks: DataFrame,
                  tanks: DataFrame, keys=KEY, radius: float = 180.0, window: float = 450.0) -> DataFrame:
    """Merge, exclude, clean, split and summarise: one record per event of ``events``.

    Events without any hit left have zero counts and charges and no centre or
    direction.  The cleaned hits feed several summaries, so they are written once.
    """
    merged = pulses.union_pulses(hlc, slc)
    good = pulses.exclude_tanks(merged, bad_tanks)
    cleaned = pulses.seeded_clean(good, tanks, radius, window, keys=keys).filter("kept").drop("kept")
    cleaned = cut_lineage(cleaned)
    located = geometry.locate(cleaned, tanks)
    none = {c: 0 for c in ("nsta", "nslc", "ntanks", "qtotalhlc", "qtotal", "qmax", "qhillas")}
    return (
        events.select(*keys)
        .join(summary.event_summary(cleaned, keys), keys, "left")
        .join(summary.centre_of_gravity(located, keys), keys, "left")
        .join(summary.plane_front(located, keys).drop("n"), keys, "left")
        .na.fill(none)
    )


@query("event_records", f"""
    WITH RECURSIVE hits_in AS (
        SELECT * FROM pulse p WHERE (hit % 2 = 0 OR charge > 0.8e0)
        AND NOT EXISTS (SELECT 1 FROM tank b WHERE b.x < -400 AND b.station = p.station
                        AND b.tank = p.tank)), {CLEAN_SQL},
         st AS (SELECT event_id, station, SUM(charge) AS q, MAX(charge) AS q_max,
                       COUNT(DISTINCT tank) >= 2 AS hlc, COUNT(DISTINCT om) AS n_om
                FROM clean WHERE kept GROUP BY event_id, station),
         ev AS (SELECT event_id, COUNT(*) FILTER (WHERE hlc) AS nsta,
                       CAST(SUM(CASE WHEN hlc THEN 0 ELSE n_om END) AS BIGINT) AS nslc,
                       SUM(q) AS qtotal, MAX(q_max) AS qmax FROM st GROUP BY event_id),
         cg AS (SELECT event_id, SUM(x * sqrt(charge)) / SUM(sqrt(charge)) AS cogx,
                       SUM(time * sqrt(charge)) / SUM(sqrt(charge)) AS t0
                FROM clean WHERE kept GROUP BY event_id)
    SELECT o_orderkey AS event_id, coalesce(nsta, 0) AS nsta, coalesce(nslc, 0) AS nslc,
           coalesce({R('qtotal')}, 0) AS qtotal, coalesce({R('qmax')}, 0) AS qmax, {R('cogx')} AS cogx,
           {R('t0')} AS t0
    FROM orders LEFT JOIN ev ON ev.event_id = o_orderkey LEFT JOIN cg ON cg.event_id = o_orderkey
    """, "pulse tank")
def records(t):
    hlc, slc = t.pulse.filter(F.col("hit") % 2 == 0), t.pulse.filter(F.col("hit") % 2 == 1)
    out = event_records(t.evt, hlc, slc, t.tank.filter("x < -400"), t.tank)
    return out.select("event_id", "nsta", "nslc", *[r(c).alias(c) for c in (
        "qtotal", "qmax", "cogx", "t0")])


def measured_spectrum(generated: DataFrame, mc: DataFrame, data: DataFrame, livetime: float,
                      correction: DataFrame, sources: DataFrame, window: spectrum.ZenithWindow,
                      weight: str = "w", edges_: list[float] = LOGE) -> DataFrame:
    """Generated, selected simulated and selected measured events to the final spectrum, per variant.

    Efficiency with its error from generated and selected simulation, response
    from the selected, unfolding of the data with both, flux over the
    generation area and livetime, corrected per bin (bin, correction), with the
    systematic total of ``sources`` (bin, sys_low, sys_high).  All variants are
    unfolded in one job.
    """
    true, reco, w = F.col("loge"), F.col("loge_p"), F.col(weight)
    on = ["variant", "bin"]
    # binned tables of a few kilobytes from here on, written once: the scans end with them
    eff = cut_lineage(spectrum.efficiency(
        hist.hist1d(mc, true, edges_, w, by=["variant"], fill=False),
        spectrum.n_generated(generated, edges_, w, window, by=["variant"]), on))
    cells = cut_lineage(spectrum.response_matrix(mc, reco, true, w, edges_, eff, by=["variant"]))
    seen = cut_lineage(hist.hist1d(data, reco, edges_, by=["variant"]))
    bins = seen.join(eff.drop("lo", "hi"), on).select(
        *on, "lo", "hi", F.col("sum_w").alias("data"), F.col("err").alias("data_err"), "eff", "eff_err")
    bins = unfold.with_prior(bins, unfold.prior_column("jeffreys", F.col("lo"), F.col("hi")))
    unfolded = unfold.unfold(cells, bins, degree=3)
    lo, hi = edges.edge_at(edges_, F.col("bin")), edges.edge_at(edges_, F.col("bin") + 1)
    scaled = lambda c: F.coalesce("correction", F.lit(1.0)) * spectrum.flux_from_counts(
        F.col(c), lo, hi, spectrum.generation_area(lo), window, livetime)
    flux = unfolded.join(correction.select("bin", "correction"), "bin", "left").select(
        *on, edges.centre(lo, hi).alias("log_energy"),
        scaled("unfolded").alias("flux"), scaled("stat_err").alias("stat"),
        scaled("sys_err").alias("unfold_sys"))
    per_variant = flux.select(*on).join(sources, "bin", "left")
    return systematics.final_spectrum(flux, per_variant, on=on)


def by_model(events: DataFrame, models=("h4a", "poly")) -> DataFrame:
    """Events once per flux model, with the variant model|particle; simulated ones with the model's weight."""
    names = [F.struct(F.lit(m).alias("model"), F.col(f"weight_{m}").alias("w_model")) for m in models]
    return events.select("*", F.inline(F.array(*names))).withColumn(
        "variant", F.concat_ws("|", "model", F.col("pdg").cast("string")))


@query("measured_spectrum")
def spectrum_query(t):
    mc_only = F.col("sample") == "mc"
    generated = t.evt.filter(mc_only)
    weights = spectrum.composition_weights(generated, generated, FINE, ("h4a", "poly"))
    chosen = selected(t)
    mc = chosen.filter(mc_only).join(weights.select("event_id", "weight_h4a", "weight_poly"), "event_id")
    data = chosen.filter(~mc_only).withColumns({"weight_h4a": F.lit(1.0), "weight_poly": F.lit(1.0)})
    livetime = summary.exposure(t.run_dim).select("duration").scalar()
    out = measured_spectrum(by_model(weights), by_model(mc), by_model(data), livetime, sys_pressure(t),
                            cut_lineage(total_systematics(t)), WINDOW, "w_model")
    return out.select("variant", "bin", "log_energy",
                      *[g(c).alias(c) for c in ("flux", "stat", "sys_low", "sys_high")])
