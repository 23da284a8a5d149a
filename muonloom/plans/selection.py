"""Registered queries: event and hit selections, filter decisions on frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from muonloom.functions import cuts, directions
from muonloom.operators import frames, pulses
from muonloom.plans.registry import R, num, query, r
from muonloom.plans.views import KEY
from muonloom.sources.constants import INFILL_TANKS, OUTSIDE_BOUNDARY, PDG


@query("f_trigger", "SELECT event_id FROM evt WHERE filt", "evt")
def f_trigger(t):
    return t.evt.filter(cuts.trigger()).select("event_id")


@query("f_train", "SELECT event_id FROM booked WHERE filt AND qsum2 <= 0.95e0 * qtotal", "booked")
def f_train(t):
    return t.booked.filter(cuts.training(0.95, qtotalhlc="qtotal")).select("event_id")


@query("f_energy_mask", """
    SELECT event_id, (filt AND coalesce(loudest_station IN (26, 36, 46, 79, 80, 81), FALSE)
           AND qsum2 <= 0.9e0 * qtotalhlc AND cos(zen_p) BETWEEN 0.8e0 AND 1.0e0) AS mask
    FROM booked""", "booked")
def f_energy_mask(t):
    return t.booked.select("event_id", cuts.energy_training(zenith="zen_p").alias("mask"))


@query("f_quality", f"""
    SELECT event_id, sample FROM booked
    WHERE cos(zen_p) BETWEEN 0.8e0 AND 1.0e0 AND nsta <= 42
      AND qtotal BETWEEN {num(10.0 ** -0.2)} AND {num(10.0 ** 3.8)}
      AND qmax <= 0.75e0 * qtotal AND qsum2 <= 0.9e0 * qtotal""", "booked")
def f_quality(t):
    events = t.booked.withColumn("qtotalhlc", F.col("qtotal"))
    return events.filter(cuts.quality(cos_lo=0.8, zenith="zen_p")).select("event_id", "sample")


@query("f_balloon", """
    SELECT event_id FROM booked
    WHERE qhillas > 0 AND log10(qhillas) >= 0.2e0 * log10(qtotal) * log10(qtotal)
                                            + 0.1e0 * log10(qtotal) - 0.3e0
      AND nsta <= 50 AND nslc <= 40 AND ntanks <= 112 AND qtotal <= 1e4""", "booked")
def f_balloon(t):
    return t.booked.filter(cuts.balloon() & cuts.multiplicity()).select("event_id")


_FLAGS = {
    "s1": "event_id % 2 = 0", "s2": "event_id % 3 <> 0", "s3": "filt", "s4": "energy > 1e5",
    "s5": "abs(x) < 250", "s6": "abs(y) < 250",
}


@query("f_std_cuts", "SELECT event_id FROM evt WHERE " + " AND ".join(_FLAGS.values()), "evt")
def f_std_cuts(t):
    flagged = t.evt.withColumns({k: F.expr(v) for k, v in _FLAGS.items()})
    return flagged.filter(cuts.all_of(*_FLAGS)).select("event_id")


@query("f_substream", """
    SELECT event_id FROM booked
    WHERE event_id % 2 = 0 AND filt AND loudest_station IN (26, 36, 46, 79, 80, 81)""", "booked")
def f_substream(t):
    events = t.booked.withColumn("sub_event_stream", F.col("event_id") % 2)
    return events.filter(cuts.physics_substream()).select("event_id")


@query("f_containment", "SELECT event_id FROM evt WHERE " + " OR ".join(
    f"pow(x_p - {num(x)}, 2) + pow(y_p - {num(y)}, 2) <= 2025" for x, y in INFILL_TANKS), "evt")
def f_containment(t):
    return t.evt.filter(directions.contained(F.col("x_p"), F.col("y_p"), 45.0)).select("event_id")


@query("f_particle", f"""
    SELECT event_id, energy FROM evt WHERE pdg = {PDG['iron']} AND loge BETWEEN 5.4e0 AND 7.0e0""",
       "evt")
def f_particle(t):
    return t.evt.filter(cuts.particle("iron") & cuts.energy_window("loge")).select(
        "event_id", "energy")


def _polygon_sql(corners) -> str:
    parts = []
    for (x1, y1), (x2, y2) in zip(corners, (*corners[1:], corners[0])):
        parts.append(
            f"(CASE WHEN ({num(y1)} > 1.5e0 * y) <> ({num(y2)} > 1.5e0 * y) AND 1.5e0 * x < "
            f"({num(x2)} - {num(x1)}) * (1.5e0 * y - {num(y1)}) / ({num(y2)} - {num(y1)}) + {num(x1)} "
            "THEN 1 ELSE 0 END)")
    return "(" + " + ".join(parts) + ") % 2 = 1"


@query("f_polygon", f"SELECT event_id FROM evt WHERE {_polygon_sql(OUTSIDE_BOUNDARY)}", "evt")
def f_polygon(t):
    inside = directions.in_polygon(1.5 * F.col("x"), 1.5 * F.col("y"), OUTSIDE_BOUNDARY)
    return t.evt.filter(inside).select("event_id")


@query("pulse_threshold", """
    SELECT event_id, hit, charge FROM pulse WHERE charge > 0.8e0""", "pulse")
def pulse_threshold(t):
    return t.pulse.filter(cuts.pulse_threshold()).select("event_id", "hit", "charge")


@query("pulse_triage", """
    SELECT p.event_id, p.hit, p.charge,
           CASE WHEN p.charge < 2 THEN 'removed' WHEN k.n >= 2 THEN 'hlc' ELSE 'slc' END AS hit_class
    FROM pulse p LEFT JOIN (SELECT event_id, station, COUNT(DISTINCT tank) AS n FROM pulse
                            WHERE charge >= 2 GROUP BY event_id, station) k
      USING (event_id, station)""", "pulse")
def pulse_triage(t):
    return pulses.triage(t.pulse, 2.0, KEY).select("event_id", "hit", "charge", "hit_class")


@query("f_frame", """
    SELECT event_id, sub_id FROM (
        SELECT *, CASE WHEN sub_id % 3 = 0 THEN 'DAQ' ELSE 'Physics' END AS stop,
               CASE WHEN passed THEN sub_id END AS payload FROM flags)
    WHERE stop = 'Physics' AND payload IS NOT NULL""", "flags")
def f_frame(t):
    rec = t.flags.withColumns({
        "stop": F.when(F.col("sub_id") % 3 == 0, F.lit("DAQ")).otherwise(F.lit("Physics")),
        "payload": F.when(F.col("passed"), F.col("sub_id")),
    })
    return frames.only_stream(rec, "Physics").filter(frames.has_frame("payload")).select(
        "event_id", "sub_id")


_DRAW = "(sub_id * 7919 + 104729) % 1000003"


@query("prescale", f"""
    SELECT event_id, sub_id, filter FROM flags
    WHERE passed AND {_DRAW} % (CASE filter WHEN 'click' THEN 10 WHEN 'view' THEN 4
                                WHEN 'error' THEN 2 ELSE 1 END) = 0""", "flags")
def prescale(t):
    kept = frames.prescale(t.flags.filter("passed"), {"click": 10, "view": 4, "error": 5},
                           key=F.expr(_DRAW), override={"error": 2})
    return kept.select("event_id", "sub_id", "filter")


@query("keep_decision", """
    SELECT sub_id, CASE WHEN a THEN 'all' WHEN a IS NULL THEN 'all'
                        WHEN s IS NULL OR s THEN 'archive' ELSE 'summary' END AS decision
    FROM (SELECT sub_id, CASE WHEN sub_id % 11 <> 0 THEN passed END AS a,
                 CASE WHEN sub_id % 13 <> 0 THEN sub_id % 2 = 0 END AS s FROM flags)""", "flags")
def keep_decision(t):
    rec = t.flags.select(
        "sub_id", F.when(F.col("sub_id") % 11 != 0, F.col("passed")).alias("a"),
        F.when(F.col("sub_id") % 13 != 0, F.col("sub_id") % 2 == 0).alias("s"))
    return rec.select("sub_id", frames.keep_decision(F.col("a"), F.col("s")).alias("decision"))


@query("mask_or", """
    SELECT event_id, filter, bool_or(passed) AS passed FROM flags GROUP BY event_id, filter""",
       "flags")
def mask_or(t):
    return frames.parent_masks(t.flags, KEY)


@query("mask_any", """
    SELECT event_id, bool_or(passed AND v > 150 AND filter IN ('click', 'error')) AS passed_any
    FROM (SELECT user_id AS event_id, event_type AS filter, TRUE AS passed, value AS v FROM events)
    GROUP BY event_id""")
def mask_any(t):
    loud = t.raw("events").select(F.col("user_id").alias("event_id"),
                                  F.col("event_type").alias("filter"),
                                  (F.col("value") > 150).alias("passed"))
    sets = frames.passed_filters(loud, KEY)
    return sets.select("event_id",
                       frames.passed_any(F.col("filters"), ["click", "error"]).alias("passed_any"))


@query("conditional_keep", """
    SELECT event_id, run, CASE WHEN filt THEN energy END AS energy,
           CASE WHEN filt THEN x END AS x, pdg FROM evt""", "evt")
def conditional_keep(t):
    df = t.evt.select("event_id", "run", "energy", "x", "pdg", "filt")
    return frames.keep_columns(df, ["pdg"], ~F.col("filt"), always=["event_id", "run", "filt"]) \
        .drop("filt")


@query("raw_clean", """
    SELECT event_id, CASE WHEN filt OR event_id % 5 = 0 THEN energy END AS raw_a,
           CASE WHEN filt OR event_id % 5 = 0 THEN """ + R("zenith") + """ END AS raw_b FROM evt""",
       "evt")
def raw_clean(t):
    df = t.evt.select("event_id", F.col("energy").alias("raw_a"), r("zenith").alias("raw_b"),
                      F.when(F.col("filt"), F.lit(True)).alias("ok"),
                      (F.col("event_id") % 5 == 0).alias("trim"))
    return frames.drop_raw(df, ["raw_a", "raw_b"], F.col("ok"), F.col("trim")).drop("ok", "trim")
