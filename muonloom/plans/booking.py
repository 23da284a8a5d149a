"""Registered queries: scans, provenance, derived columns."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F, types as T

from muonloom.functions import directions, edges, features, shapes
from muonloom.functions.guards import log10_feature
from muonloom.operators import hist, pulses, spectrum, summary
from muonloom.operators.ml import core_layout
from muonloom.plans.registry import G, R, edges_sql, g, in_bin, num, query, r
from muonloom.plans.views import KEY, TIES
from muonloom.schema import N_SLOTS
from muonloom.session import cut_lineage, shared_dir, write_table
from muonloom.sources import aligned, sinks
from muonloom.sources import book as src
from muonloom.sources.constants import DATASET_PARTICLE, FLUX_MODELS, PDG

ORDERS = T.StructType([
    T.StructField("o_orderkey", T.LongType()),
    T.StructField("o_totalprice", T.DoubleType()),
    T.StructField("o_orderdate", T.TimestampNTZType()),
])


@query("scan_book", """
    SELECT run, COUNT(*) AS n, """ + R("SUM(energy)", 2) + """ AS energy FROM evt GROUP BY run""",
       "evt")
def scan_book(t):
    df = src.book(t.spark, f"{t.folder}/orders*.parquet", ORDERS)
    return (df.select(F.year("o_orderdate").alias("run"),
                      (F.col("o_totalprice") * 20).alias("energy"))
            .groupBy("run").agg(F.count("*").alias("n"), r(F.sum("energy"), 2).alias("energy")))


@query("scan_skip_missing", """
    SELECT event_id, energy FROM evt
    WHERE filt AND event_id IN (SELECT event_id FROM pulse)""", "evt pulse")
def scan_skip_missing(t):
    manifest = (t.evt.filter("filt").select("event_id", F.lit("truth").alias("table"))
                .unionByName(t.pulse.select("event_id", F.lit("pulses").alias("table"))))
    return src.select_complete(t.evt, manifest, ["truth", "pulses"], "event_id").select(
        "event_id", "energy")


_NUMBERS = list(DATASET_PARTICLE)


@query("provenance", """
    SELECT event_id, dataset, run_number,
           CASE """ + " ".join(f"WHEN dataset = '{d}' THEN '{p}'"
                               for d, p in DATASET_PARTICLE.items()) + """ END AS particle,
           CAST(CASE """ + " ".join(f"WHEN dataset = '{d}' THEN {PDG[p]}"
                                    for d, p in DATASET_PARTICLE.items()) + """ END AS BIGINT) AS pdg
    FROM (SELECT o_orderkey AS event_id, CAST(o_orderkey AS INTEGER) AS run_number,
                 [""" + ", ".join(f"'{d}'" for d in _NUMBERS) + """][o_custkey % 16 + 1] AS dataset
          FROM orders)""")
def provenance(t):
    number = F.element_at(F.array(*[F.lit(d) for d in _NUMBERS]),
                          (F.col("o_custkey") % 16 + 1).cast("int"))
    files = t.raw("orders").select(
        F.col("o_orderkey").alias("event_id"),
        F.format_string("/sim/%s/Level2_corsika_Run%08d_x.parquet", number,
                        F.col("o_orderkey")).alias("path"))
    out = src.with_provenance(files, F.col("path"))
    return out.withColumn("run_number", src.run_of(F.col("path"))).drop("path")


@query("run_pattern", "SELECT event_id, run FROM evt WHERE run % 10 = 0", "evt")
def run_pattern(t):
    return src.runs_ending_in(t.evt, 0).select("event_id", "run")


@query("ragged_slice", """
    SELECT p.event_id AS pos, i.o_orderkey AS owner, p.value AS charge
    FROM events p JOIN orders i
      ON p.event_id >= i.o_orderkey * 3
     AND p.event_id < i.o_orderkey * 3 + i.o_custkey % 4""")
def ragged_slice(t):
    hits = t.raw("events").select(F.lit(0).alias("run"), F.col("event_id").alias("pos"),
                                  F.col("value").alias("charge"))
    start = F.col("o_orderkey") * 3
    index = t.raw("orders").select(F.lit(0).alias("run"), F.col("o_orderkey").alias("owner"),
                                   start.alias("start"),
                                   (start + F.col("o_custkey") % 4).alias("stop"))
    return src.ragged_slice(hits, index).select("pos", "owner", "charge")


@query("write_back", """
    SELECT e.event_id, CASE WHEN e.filt THEN """ + R("e.loge_p") + """ END AS predicted
    FROM evt e""", "evt")
def write_back(t):
    scored = t.evt.filter("filt").select("event_id", r("loge_p").alias("predicted"))
    return sinks.attach_column(t.evt.select("event_id"), scored, KEY)


@query("aligned_columns", """
    SELECT e.event_id, """ + R("e.loge") + """ AS loge, h.n_hits, CASE WHEN e.filt THEN """ + R("e.loge_p") + """ END
      AS predicted
    FROM evt e LEFT JOIN (SELECT event_id, COUNT(*) AS n_hits FROM pulse GROUP BY event_id) h
      ON h.event_id = e.event_id""", "evt pulse")
def aligned_columns(t):
    """Events, their hit counts and predictions, each written in the same buckets, then joined and written back."""
    root = f"{shared_dir(t.spark)}/aligned-{uuid.uuid4().hex}"
    buckets = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    parts = {"events": t.evt.select("event_id", r("loge").alias("loge")),
             "hits": t.pulse.groupBy(*KEY).agg(F.count("*").alias("n_hits")),
             "scores": t.evt.filter("filt").select("event_id", r("loge_p").alias("predicted"))}
    at = {name: aligned.write_aligned(df, f"{root}/{name}", KEY, buckets) for name, df in parts.items()}
    hits, scores = (aligned.read_aligned(t.spark, at[name], KEY, parts[name].schema) for name in ("hits", "scores"))
    events = parts["events"].schema
    with_hits = aligned.write_back(t.spark, at["events"], hits, f"{root}/with_hits", KEY, events)
    both = T.StructType([*events, hits.schema["n_hits"]])
    return aligned.aligned_join(aligned.read_aligned(t.spark, with_hits, KEY, both), scores, keys=KEY)


@query("incomplete_runs", """
    SELECT event_id FROM evt WHERE event_id NOT IN (SELECT event_id FROM pulse)""", "evt pulse")
def incomplete(t):
    return src.incomplete_runs(t.evt, t.pulse, "event_id")


@query("run_season", """
    SELECT e.run, COUNT(*) AS n, MAX(d.duration) AS duration FROM evt e JOIN run_dim d USING (run)
    WHERE run BETWEEN 1995 AND 1996 OR run BETWEEN 1999 AND 2000 GROUP BY e.run""", "evt run_dim")
def run_season(t):
    ranges = [(1995, 1996), (1999, 2000)]
    n = summary.season(t.evt, t.run_dim, ranges).groupBy("run").agg(F.count("*").alias("n"))
    return n.join(t.run_dim, "run")


def partitioned_events(t):
    """A copy of the events in one folder per run."""
    return t.spark.read.parquet(write_table(t.evt.select("event_id", "run", "energy", "filt"), ["run"]))


@query("long_runs", f"""
    SELECT run, COUNT(*) AS n, {R('SUM(energy)', 2)} AS energy, MAX(duration) AS duration
    FROM evt JOIN run_dim USING (run) WHERE duration >= 28950 GROUP BY run""", "evt run_dim")
def long_runs(t):
    """Events and energy of the runs that lasted long enough; other runs' folders are not read."""
    kept = src.selected_runs(partitioned_events(t), cut_lineage(t.run_dim), F.col("duration") >= 28950)
    return kept.groupBy("run").agg(F.count("*").alias("n"), r(F.sum("energy"), 2).alias("energy"),
                                   F.max("duration").alias("duration"))


# --- derived columns ------------------------------------------------------------

_FLOOR = "-3.4028235e38"
_LOGF = "CASE WHEN {0} > 0 THEN round(log10({0}), 6) ELSE " + _FLOOR + " END"


@query("feature_block", """
    WITH top AS (SELECT t.*, k.x AS tx, k.y AS ty FROM top35 t JOIN tank k USING (station, tank))
    SELECT e.event_id, 109 AS size, e.x AS f0, e.y AS f1,
           """ + _LOGF.format("MAX(e.nsta)") + """ AS f2, """ + R("cos(e.zenith)") + """ AS f3,
           """ + R("SUM(t.charge)") + """ AS pulses, """ + R("SUM(t.tx)", 4) + """ AS tank_x,
           """ + R("SUM(t.ty)", 4) + """ AS tank_y
    FROM booked e JOIN top t USING (event_id) GROUP BY e.event_id, e.x, e.y, e.zenith""",
       "top35 tank booked")
def feature_block(t):
    arrays = pulses.pulse_arrays(t.pulse, t.tank, KEY, ties=TIES)
    df = t.evt.join(t.summary.select("event_id", "nsta"), KEY).join(arrays, KEY)
    df = df.withColumns({"cogx": F.col("x"), "cogy": F.col("y"), "plane_zenith": F.col("zenith")})
    f = F.col("f")
    part = lambda i: features.total(F.slice(f, 5 + i * N_SLOTS, N_SLOTS))
    return df.select("event_id", core_layout().as_array().alias("f")).select(
        "event_id", F.size(f).alias("size"), f[0].alias("f0"), f[1].alias("f1"),
        F.round(f[2], 6).alias("f2"), r(f[3]).alias("f3"), r(part(0)).alias("pulses"),
        r(part(1), 4).alias("tank_x"), r(part(2), 4).alias("tank_y"))


@query("log_features", "SELECT event_id, " + _LOGF.format("nsta") + " AS lognsta, "
       + _LOGF.format("qtotalhlc") + " AS logqtotal, " + R("cos(zen_p)")
       + " AS costheta FROM booked", "booked")
def log_features(t):
    six = lambda c: F.round(log10_feature(F.col(c)), 6)
    return t.booked.select("event_id", six("nsta").alias("lognsta"),
                           six("qtotalhlc").alias("logqtotal"), r(F.cos("zen_p")).alias("costheta"))


@query("charge_sums", """
    SELECT event_id, """ + R("SUM(CASE WHEN rank <= 2 THEN charge ELSE 0 END)") + """ AS qsum2,
           """ + R("MAX(charge)") + """ AS qmax,
           """ + R("SUM(CASE WHEN rank > 1 THEN charge ELSE 0 END)") + """ AS qhillas
    FROM top35_dense GROUP BY event_id""", "top35_dense")
def charge_sums(t):
    arrays = pulses.pulse_arrays(t.pulse_dense, t.tank_dense, KEY, ties=TIES)
    p = F.col("pulses")
    return arrays.select("event_id", r(features.leading_sum(p)).alias("qsum2"),
                         r(features.largest(p)).alias("qmax"),
                         r(features.without_largest(p)).alias("qhillas"))


_RADIUS_SQL = """CASE WHEN k.x = 0 AND k.y = 0 THEN 0
        ELSE sqrt((k.x - e.x_p) * (k.x - e.x_p) + (k.y - e.y_p) * (k.y - e.y_p)) / 60 END"""


@query("frac_radius", f"""
    WITH radii AS (SELECT t.event_id, {_RADIUS_SQL} AS v
                   FROM top35_dense t JOIN tank_dense k USING (station, tank)
                   JOIN evt e USING (event_id)),
         slots AS (SELECT event_id, CAST(row_number() OVER (PARTITION BY event_id ORDER BY v DESC) - 1
                          AS INTEGER) AS slot, v FROM radii),
         grid AS (SELECT event_id, CAST(s AS INTEGER) AS slot
                  FROM (SELECT DISTINCT event_id FROM radii), range(35) AS g(s))
    SELECT event_id, slot, {R("coalesce(v, 0)")} AS frac_radius
    FROM grid LEFT JOIN slots USING (event_id, slot)""", "top35_dense tank_dense evt")
def frac_radius(t):
    arrays = pulses.pulse_arrays(t.pulse_dense, t.tank_dense, KEY, ties=TIES).join(t.evt, KEY)
    radii = features.frac_radius(F.col("tank_x"), F.col("tank_y"), F.col("x_p"), F.col("y_p"))
    return arrays.select("event_id", F.posexplode(radii).alias("slot", "v")).select(
        "event_id", "slot", r("v").alias("frac_radius"))


@query("tank_density", f"""
    WITH radii AS (SELECT t.event_id, MAX({_RADIUS_SQL} * 60) AS v, MAX(e.ntanks) AS n
                   FROM top35 t JOIN tank k USING (station, tank) JOIN booked e USING (event_id)
                   GROUP BY t.event_id)
    SELECT event_id, {R("v")} AS max_radius, {R("n / (1e-6 * pi() * v * v)", 4)} AS density FROM radii
    """, "top35 tank booked")
def tank_density(t):
    arrays = pulses.pulse_arrays(t.pulse, t.tank, KEY, ties=TIES)
    df = t.evt.join(t.summary.select("event_id", "ntanks"), KEY).join(arrays, KEY)
    radii = features.tank_radii(F.col("tank_x"), F.col("tank_y"), F.col("x_p"), F.col("y_p"))
    df = df.select("event_id", "ntanks", F.array_max(radii).alias("v"))
    density = features.tank_density(F.col("ntanks"), F.col("v"), per_km2=True)
    return df.select("event_id", r("v").alias("max_radius"), r(density, 4).alias("density"))


_DEPTH_SQL = """(sin(e.zenith) * (-cos(e.azimuth) * (k.x - e.x) - sin(e.azimuth) * (k.y - e.y))
        - cos(e.zenith) * (k.z - 1946))"""


@query("zsc_avg", f"""
    SELECT t.event_id, {R(f"avg(abs({_DEPTH_SQL}))")} AS zsc_avg
    FROM top35 t JOIN tank k USING (station, tank) JOIN evt e USING (event_id)
    GROUP BY t.event_id""", "top35 tank evt")
def zsc_avg(t):
    arrays = pulses.pulse_arrays(t.pulse, t.tank, KEY, ties=TIES).join(t.evt, KEY)
    z = directions.zsc_average(*[F.col(c) for c in (
        "tank_x", "tank_y", "tank_z", "azimuth", "zenith", "x", "y")])
    return arrays.select("event_id", r(z).alias("zsc_avg"))


_U = "(-cos(e.azimuth) * (k.x - e.x) - sin(e.azimuth) * (k.y - e.y))"
_UX = f"(-cos(e.zenith) * {_U} - sin(e.zenith) * (k.z - 1946))"
_UY = "(sin(e.azimuth) * (k.x - e.x) - cos(e.azimuth) * (k.y - e.y))"


@query("plane_residual", f"""
    SELECT p.event_id, p.hit, {R(f"sqrt({_UX} * {_UX} + {_UY} * {_UY})")} AS radius,
           {R(f"p.time - (500 + {_DEPTH_SQL} / 3e8 * 1e9)")} AS residual
    FROM pulse p JOIN tank k USING (station, tank) JOIN evt e USING (event_id)""", "pulse tank evt")
def plane_residual(t):
    showers = t.evt.select("event_id", F.col("x").alias("cx"), F.col("y").alias("cy"),
                           "zenith", "azimuth")
    hits = pulses.shower_frame(t.pulse, t.tank, showers, KEY)
    off = (F.col("x") - F.col("cx"), F.col("y") - F.col("cy"), F.col("z") - 1946.0,
           F.col("azimuth"), F.col("zenith"))
    return hits.select(
        "event_id", "hit", r(directions.shower_radius(*off)).alias("radius"),
        r(directions.plane_residual(F.col("time"), F.lit(500.0), *off)).alias("residual"))


@query("opening_angle", """
    SELECT event_id, """ + R("""degrees(acos(least(1.0e0, greatest(-1.0e0,
        sin(zenith) * sin(zen_p) * cos(azimuth - (azimuth + 0.01e0)) + cos(zenith) * cos(zen_p)))))""", 4)
       + " AS angle FROM evt", "evt")
def opening_angle(t):
    a = directions.opening_angle(F.col("zenith"), F.col("azimuth"), F.col("zen_p"),
                                 F.col("azimuth") + 0.01)
    return t.evt.select("event_id", r(a, 4).alias("angle"))


@query("core_distance", "SELECT event_id, "
       + R("sqrt((x - x_p) * (x - x_p) + (y - y_p) * (y - y_p))") + " AS distance FROM evt", "evt")
def core_distance(t):
    d = directions.distance(*[F.col(c) for c in ("x", "y", "x_p", "y_p")])
    return t.evt.select("event_id", r(d).alias("distance"))


def flux_sql(model: str, e: str, element: str | None = None, population: int | None = None) -> str:
    parts = [
        f"{num(a)} * pow({e}, {num(-gm)}) * exp(-({e}) / {num(z * rc)})"
        for pop, el, a, gm, z, rc in FLUX_MODELS[model]
        if element in (None, el) and population in (None, pop)]
    return "(" + " + ".join(parts) + ")"


_SCALE = "pow(energy, 1.65e0)"


@query("scaled_flux", "SELECT event_id, " + R(flux_sql("h4a", "energy") + " * " + _SCALE, 2)
       + " AS scaled FROM evt", "evt")
def scaled_flux(t):
    e = F.col("energy")
    return t.evt.select(
        "event_id", r(shapes.flux("h4a", e) * shapes.scale_flux(e, 2.65), 2).alias("scaled"))


_MODELS = (("h4a", None), ("h4a", 1), ("h4a", 2), ("h4a", 3), ("h3a", None), ("h3a", 3),
           ("poly", None))


@query("flux_model", "SELECT event_id, " + ", ".join(
    R(f"{flux_sql(m, 'energy', population=p)} * {_SCALE}", 2) + f" AS {m}_{p or 'all'}"
    for m, p in _MODELS) + " FROM evt", "evt")
def flux_model(t):
    e = F.col("energy")
    return t.evt.select("event_id", *[
        r(shapes.flux(m, e, population=p) * shapes.scale_flux(e, 2.65), 2).alias(f"{m}_{p or 'all'}")
        for m, p in _MODELS])


@query("lateral_profile", """
    SELECT p.event_id, p.hit,
           """ + R("p.charge * pow(d.u, -2.5e0 - 0.303e0 * log10(d.u))", 6) + """ AS signal,
           """ + R("0.5e0 + 0.2e0 * d.u + 0.1e0 * d.u * d.u - 0.01e0 * d.u * d.u * d.u") + """ AS proxy,
           """ + R("0.90603644e0 * log10(p.charge) + 6.04892767e0") + """ AS loge
    FROM pulse p JOIN tank k USING (station, tank) JOIN evt e USING (event_id),
         LATERAL (SELECT greatest(sqrt((k.x - e.x) * (k.x - e.x) + (k.y - e.y) * (k.y - e.y)), 1e0)
                         / 60 AS u) d""", "pulse tank evt")
def lateral_profile(t):
    showers = t.evt.select("event_id", F.col("x").alias("cx"), F.col("y").alias("cy"))
    hits = pulses.shower_frame(t.pulse, t.tank, showers, KEY)
    d = F.greatest(directions.distance(*[F.col(c) for c in ("x", "y", "cx", "cy")]), F.lit(1.0))
    hits = hits.withColumn("d", d)
    u = F.col("d") / 60.0
    return hits.select(
        "event_id", "hit",
        r(shapes.lateral_profile(F.col("d"), F.col("charge"), 2.5), 6).alias("signal"),
        r(shapes.cubic(u, 0.5, 0.2, 0.1, -0.01)).alias("proxy"),
        r(shapes.s125_to_loge(F.log10("charge"))).alias("loge"))


LOGE = edges.LOGE_EDGES
_LN10 = num(math.log(10.0))


@query("bin_centers", f"""
    WITH b AS {edges_sql(LOGE)},
         h AS (SELECT b.bin, b.lo, b.hi, COUNT(*) AS n FROM evt JOIN b ON {in_bin('loge')}
               GROUP BY b.bin, b.lo, b.hi)
    SELECT bin, n, {R('(lo + hi) * 0.5e0')} AS mid,
           {R(f'''-ln((exp(-1.65e0 * lo * {_LN10}) - exp(-1.65e0 * hi * {_LN10}))
               / (1.65e0 * (hi - lo) * {_LN10})) / (1.65e0 * {_LN10})''')} AS power_mid,
           {G('''pow(0.5e0 * (pow(pow(1e1, lo), -1.65e0) + pow(pow(1e1, hi), -1.65e0)),
               1 / -1.65e0)''')} AS mean_centre,
           {G('''-1.65e0 * (pow(pow(1e1, hi), -0.65e0) - pow(pow(1e1, lo), -0.65e0))
               / (-0.65e0 * (pow(pow(1e1, hi), -1.65e0) - pow(pow(1e1, lo), -1.65e0)))''')}
               AS spectral_mean
    FROM h""", "evt")
def bin_centers(t):
    h = hist.hist1d(t.evt, F.col("loge"), LOGE, fill=False)
    lo, hi = F.col("lo"), F.col("hi")
    elo, ehi = F.pow(F.lit(10.0), lo), F.pow(F.lit(10.0), hi)
    return h.select(
        "bin", "n", r(edges.centre(lo, hi)).alias("mid"),
        r(edges.power_law_centre(lo, hi, 1.65)).alias("power_mid"),
        g(edges.mean_power_centre(elo, ehi, 2.65)).alias("mean_centre"),
        g(edges.spectral_mean_energy(elo, ehi, 2.65)).alias("spectral_mean"))


def _case_pdg(text) -> str:
    return "CASE pdg " + " ".join(f"WHEN {c} THEN {text(n)}" for n, c in PDG.items()) + " END"


ACCEPT_SQL = """(pi() * pi() * pow(CASE WHEN lo < 5 THEN 200 WHEN lo < 6 THEN 400 WHEN lo < 7 THEN 600
        ELSE 800 END, 2) * (1 - pow(cos(radians(CASE WHEN pdg IN (1000020040, 1000080160) AND lo < 5
        THEN 40.0e0 ELSE 65.0e0 END)), 2)))"""
FINE = edges.LOGE_EDGES_FINE
WEIGHT_SQL = f"""
    WITH b AS {edges_sql(FINE)},
         e AS (SELECT evt.*, b.* FROM evt JOIN b ON {in_bin('loge')}),
         c AS (SELECT pdg, bin, COUNT(*) AS n_gen FROM e GROUP BY pdg, bin)
    SELECT e.event_id, e.pdg, e.bin, e.energy, e.loge,
           {ACCEPT_SQL} * (e.hi - e.lo) * {_LN10} / c.n_gen AS norm
    FROM e JOIN c USING (pdg, bin)"""


@query("composition_weight", f"""
    SELECT event_id, bin, {R(_case_pdg(lambda n: flux_sql('h4a', 'energy', n)) + ' * norm', 7)} AS weight_h4a,
           {R(flux_sql('h4a', 'energy') + ' * norm', 7)} AS weight_all_h4a,
           {R(_case_pdg(lambda n: flux_sql('poly', 'energy', n)) + ' * norm', 7)} AS weight_poly,
           {R(flux_sql('poly', 'energy') + ' * norm', 7)} AS weight_all_poly
    FROM ({WEIGHT_SQL})""", "evt")
def composition_weight(t):
    w = spectrum.composition_weights(t.evt, t.evt, FINE)
    return w.select("event_id", "bin", *[
        r(c, 7).alias(c) for c in ("weight_h4a", "weight_all_h4a", "weight_poly", "weight_all_poly")])


@query("generator_check", f"""
    WITH w AS ({WEIGHT_SQL}), b AS {edges_sql(FINE)},
         s AS (SELECT pdg, bin, SUM({flux_sql('h4a', 'energy')} * norm) AS sw FROM w GROUP BY pdg, bin),
         f AS (SELECT s.pdg, s.bin, sw / ((hi - lo) * {_LN10} * {ACCEPT_SQL}) AS flux,
                      {flux_sql('h4a', 'pow(1e1, (lo + hi) * 0.5e0)')} AS model
               FROM s JOIN b USING (bin))
    SELECT pdg, bin, {G('flux')} AS flux, {G('model')} AS model, {G('flux / model')} AS ratio FROM f
    """, "evt")
def generator_check(t):
    w = spectrum.composition_weights(t.evt, t.evt, FINE, ["h4a"])
    out = spectrum.generator_check(w, FINE, "h4a", "weight_all_h4a")
    return out.select("pdg", "bin", *[g(c).alias(c) for c in ("flux", "model", "ratio")])
