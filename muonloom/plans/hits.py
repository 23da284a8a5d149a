"""Registered queries: geometry joins, hit cleaning, per-event aggregates and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from muonloom.functions import edges
from muonloom.operators import fits, geometry, hist, pulses, ranking, summary
from muonloom.plans.registry import G, R, edges_sql, g, in_bin, query, r
from muonloom.plans.views import KEY, TIES
from muonloom.schema import N_SLOTS


@query("j_geometry", """
    SELECT p.event_id, p.hit, k.tank_index, k.x, k.y, k.z
    FROM pulse p JOIN tank k USING (station, tank)""", "pulse tank")
def j_geometry(t):
    located = geometry.locate(t.pulse.drop("tank"), t.tank)
    index = geometry.tank_index(F.col("station"), F.col("tank")).cast("int")
    return located.select("event_id", "hit", index.alias("tank_index"), "x", "y", "z")


@query("pulse_union", """
    SELECT event_id, station, om, COUNT(*) AS n, """ + R("SUM(charge)") + """ AS q FROM (
        SELECT event_id, station, om, charge FROM pulse WHERE hit % 2 = 0
        UNION ALL
        SELECT event_id, station, om, charge FROM pulse WHERE hit % 2 = 1 AND charge > 0.8e0)
    GROUP BY event_id, station, om""", "pulse")
def pulse_union(t):
    hlc, slc = t.pulse.filter(F.col("hit") % 2 == 0), t.pulse.filter(F.col("hit") % 2 == 1)
    both = pulses.union_pulses(hlc, slc)
    return both.groupBy("event_id", "station", "om").agg(
        F.count("*").alias("n"), r(F.sum("charge")).alias("q"))


@query("j_exclude", """
    SELECT p.event_id, p.hit FROM pulse p
    WHERE NOT EXISTS (SELECT 1 FROM tank k WHERE k.x < -300 AND k.station = p.station
                      AND k.tank = p.tank)""", "pulse tank")
def j_exclude(t):
    return pulses.exclude_tanks(t.pulse, t.tank.filter("x < -300")).select("event_id", "hit")


@query("j_tank_distance", """
    SELECT a.station, """ + R("sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))") + """ AS distance
    FROM tank a JOIN tank b ON a.station = b.station AND a.tank < b.tank""", "tank")
def j_tank_distance(t):
    return geometry.station_spacing(t.tank).select("station", r("distance").alias("distance"))


@query("j_station_distance", """
    WITH c AS (SELECT station, AVG(x) AS x, AVG(y) AS y FROM tank GROUP BY station)
    SELECT """ + R("sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))") + """ AS distance
    FROM c a JOIN c b ON a.station = 1 AND b.station = 4""", "tank")
def j_station_distance(t):
    return geometry.station_distance(t.tank, 1, 4).select(r("distance").alias("distance"))


#: Cleaning to the fixed point; ``clean`` has every hit of ``hits_in`` with its flag.
CLEAN_SQL = """
    k0 AS (SELECT p.event_id, p.hit, p.station, p.tank, p.om, p.charge, p.time, k.x, k.y,
                  s.n >= 2 AS seed, row_number() OVER () AS id
           FROM hits_in p JOIN tank k USING (station, tank)
           JOIN (SELECT event_id, station, COUNT(DISTINCT tank) AS n FROM hits_in
                 GROUP BY event_id, station) s USING (event_id, station)),
    grown AS (SELECT event_id, id, x, y, time FROM k0 WHERE seed
              UNION
              SELECT p.event_id, p.id, p.x, p.y, p.time FROM grown q JOIN k0 p USING (event_id)
              WHERE NOT p.seed AND abs(p.time - q.time) <= 450
                AND sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) <= 180),
    clean AS (SELECT k0.*, g.id IS NOT NULL AS kept FROM k0 LEFT JOIN (SELECT DISTINCT id FROM grown) g
              USING (id))"""


@query("j_seeded_clean", f"""
    WITH RECURSIVE hits_in AS (SELECT * FROM pulse), {CLEAN_SQL}
    SELECT event_id, hit, kept FROM clean""", "pulse tank")
def j_seeded_clean(t):
    return pulses.seeded_clean(t.pulse, t.tank, 180.0, 450.0, KEY).select(
        "event_id", "hit", "kept")


@query("two_station_filter", """
    WITH hlc AS (SELECT event_id, station FROM pulse_dense
                 WHERE station IN (26, 36, 46, 79, 80, 81)
                 GROUP BY event_id, station HAVING COUNT(DISTINCT tank) >= 2)
    SELECT DISTINCT a.event_id FROM hlc a JOIN hlc b USING (event_id)
      JOIN tank_dense ka ON ka.station = a.station JOIN tank_dense kb ON kb.station = b.station
    WHERE a.station < b.station
      AND sqrt((ka.x - kb.x) * (ka.x - kb.x) + (ka.y - kb.y) * (ka.y - kb.y)) <= 130""",
       "pulse_dense tank_dense")
def two_station_filter(t):
    return summary.two_station(t.pulse_dense, t.tank_dense, 130.0, KEY)


@query("two_station_all", """
    WITH hlc AS (SELECT event_id, station FROM pulse
                 GROUP BY event_id, station HAVING COUNT(DISTINCT tank) >= 2)
    SELECT DISTINCT a.event_id FROM hlc a JOIN hlc b USING (event_id)
      JOIN tank ka ON ka.station = a.station JOIN tank kb ON kb.station = b.station
    WHERE a.station < b.station
      AND sqrt((ka.x - kb.x) * (ka.x - kb.x) + (ka.y - kb.y) * (ka.y - kb.y)) <= 300""",
       "pulse tank")
def two_station_all(t):
    return summary.two_station(t.pulse, t.tank, 300.0, KEY, F.lit(True))


@query("event_summary", """
    SELECT event_id, nsta, nslc, ntanks, """ + ", ".join(
    R(c) + f" AS {c}" for c in ("qtotalhlc", "qtotal", "qmax", "qhillas")) + """,
           coalesce(loudest_station IN (26, 36, 46, 79, 80, 81), FALSE) AS loud_sta
    FROM summary""", "summary")
def event_summary(t):
    return t.summary.select(
        "event_id", "nsta", "nslc", "ntanks",
        *[r(c).alias(c) for c in ("qtotalhlc", "qtotal", "qmax", "qhillas")], "loud_sta")


@query("loudest_station", """
    SELECT event_id, m.s AS station, m.s IN (26, 36, 46, 79, 80, 81) AS loud_sta
    FROM (SELECT event_id, MAX({'q': charge, 's': station}) AS m FROM pulse_dense GROUP BY event_id)
    """, "pulse_dense")
def loudest_station(t):
    return summary.loudest_station(t.pulse_dense, KEY)


@query("cog", """
    SELECT p.event_id, """ + ", ".join(
    R(f"SUM({c} * sqrt(charge)) / SUM(sqrt(charge))") + f" AS {a}"
    for c, a in (("k.x", "cogx"), ("k.y", "cogy"), ("k.z", "cogz"), ("p.time", "t0"))) + """
    FROM pulse p JOIN tank k USING (station, tank) GROUP BY p.event_id""", "pulse tank")
def cog(t):
    c = summary.centre_of_gravity(geometry.locate(t.pulse, t.tank), KEY)
    return c.select("event_id", *[r(n).alias(n) for n in ("cogx", "cogy", "cogz", "t0")])


@query("plane_fit", """
    WITH m AS (SELECT p.event_id, COUNT(*) AS n, var_pop(k.x) AS xx, var_pop(k.y) AS yy,
                      covar_pop(k.x, k.y) AS xy, covar_pop(k.x, p.time) AS xt,
                      covar_pop(k.y, p.time) AS yt
               FROM pulse_dense p JOIN tank_dense k USING (station, tank) GROUP BY p.event_id),
         s AS (SELECT event_id, n,
                      -0.299792458e0 * (xt * yy - yt * xy) / (xx * yy - xy * xy) AS nx,
                      -0.299792458e0 * (yt * xx - xt * xy) / (xx * yy - xy * xy) AS ny
               FROM m WHERE n >= 3 AND xx * yy - xy * xy > 1e-6)
    SELECT event_id, n, """ + R("asin(least(1.0e0, sqrt(nx * nx + ny * ny) * 1e-4))") + """ AS zenith,
           """ + R("CASE WHEN atan2(ny, nx) < 0 THEN atan2(ny, nx) + 2 * pi() ELSE atan2(ny, nx) END")
       + " AS azimuth FROM s", "pulse_dense tank_dense")
def plane_fit(t):
    hits = geometry.locate(t.pulse_dense, t.tank_dense).withColumn("time", F.col("time") * 1e-4)
    return summary.plane_front(hits, KEY).select(
        "event_id", "n", r("zenith").alias("zenith"), r("azimuth").alias("azimuth"))


@query("hlc_slc_split", """
    SELECT event_id, hit, station, n >= 2 AS hlc FROM pulse JOIN
        (SELECT event_id, station, COUNT(DISTINCT tank) AS n FROM pulse GROUP BY event_id, station)
        USING (event_id, station)""", "pulse")
def hlc_slc_split(t):
    return pulses.split_hlc(t.pulse, KEY).select("event_id", "hit", "station", "hlc")


_INFILL_HITS = """SELECT station, """ + R("SUM(w)", 4) + """ AS hits, COUNT(*) AS n
    FROM (SELECT DISTINCT event_id, station FROM pulse_dense
          WHERE station IN (26, 36, 46, 79, 80, 81)) JOIN evt USING (event_id) GROUP BY station"""


@query("station_hits", _INFILL_HITS, "pulse_dense evt")
def station_hits(t):
    weighted = summary.station_hits(t.pulse_dense, t.evt, KEY, "w")
    plain = summary.station_hits(t.pulse_dense, None, KEY).select(
        "station", F.col("hits").cast("long").alias("n"))
    return weighted.select("station", r("hits", 4).alias("hits")).join(plain, "station")


@query("station_rate", f"""
    WITH h AS ({_INFILL_HITS})
    SELECT station, n / (SELECT n FROM h WHERE station = 80) AS rate FROM h""", "pulse_dense evt")
def station_rate(t):
    return summary.station_rate(summary.station_hits(t.pulse_dense, None, KEY)).select(
        "station", "rate")


@query("exposure", """
    SELECT SUM(duration) AS duration, COUNT(*) AS n_runs FROM run_dim WHERE run BETWEEN 1996 AND 1999
    """, "run_dim")
def exposure(t):
    return summary.exposure(summary.runs_in(t.run_dim, [(1996, 1999)]))


@query("station_mean", """
    SELECT station, """ + R("AVG(CASE WHEN hit % 2 = 1 THEN charge END)") + """ AS data,
           """ + R("AVG(CASE WHEN hit % 2 = 0 THEN charge END)") + """ AS mc,
           """ + R("AVG(CASE WHEN hit % 2 = 0 THEN charge END) - AVG(CASE WHEN hit % 2 = 1 THEN charge END)")
       + " AS difference FROM pulse GROUP BY station", "pulse")
def station_mean(t):
    df = t.pulse.withColumn("sample", F.when(F.col("hit") % 2 == 1, F.lit("data"))
                            .otherwise(F.lit("mc")))
    m = summary.station_means(df, "charge", "sample")
    return m.select("station", *[r(c).alias(c) for c in ("data", "mc", "difference")])


_RATE_EDGES = edges.LOGE_EDGES


@query("rate", f"""
    WITH b AS {edges_sql(_RATE_EDGES)}
    SELECT bin, COUNT(event_id) AS n, {G("COUNT(event_id) / (SELECT SUM(duration) FROM run_dim)")} AS rate,
           {G("sqrt(COUNT(event_id)) / (SELECT SUM(duration) FROM run_dim)")} AS err
    FROM b LEFT JOIN evt ON {in_bin("loge_p")} AND filt GROUP BY bin""", "evt run_dim")
def rate(t):
    h = hist.hist1d(t.evt.filter("filt"), F.col("loge_p"), _RATE_EDGES)
    total = summary.exposure(t.run_dim).select("duration").scalar()
    value, err = summary.event_rate(F.col("n"), total)
    return h.select("bin", "n", g(value).alias("rate"), g(err).alias("err"))


# --- windows --------------------------------------------------------------------

@query("topk_pulses", """
    SELECT event_id, CAST(rank AS INTEGER) AS rank, hit, charge, k.x, k.y
    FROM top35_dense JOIN tank_dense k USING (station, tank)""", "top35_dense tank_dense")
def topk_pulses(t):
    top = pulses.top_pulses(t.pulse_dense, KEY, N_SLOTS, TIES)
    return geometry.locate(top, t.tank_dense).select("event_id", "rank", "hit", "charge", "x", "y")


_TIME_SQL = """
    WITH s AS (SELECT event_id, time, {value} AS v,
                      row_number() OVER (PARTITION BY event_id ORDER BY time) AS r,
                      COUNT(*) OVER (PARTITION BY event_id) AS n FROM {view}),
         g AS (SELECT event_id, CAST(i AS INTEGER) AS slot
               FROM (SELECT DISTINCT event_id FROM s), range(35) AS t(i))
    SELECT g.event_id, g.slot, """ + R("coalesce(s.v, 0)", 6) + """ AS value
    FROM g LEFT JOIN s ON s.event_id = g.event_id AND s.r = g.slot + {shift}
        AND g.slot < least(s.n, 35) - 1"""


@query("hits_time_rel", _TIME_SQL.format(
    view="pulse", value="time - MIN(time) OVER (PARTITION BY event_id)", shift=1), "pulse")
def hits_time_rel(t):
    rel = pulses.relative_times(t.pulse, KEY)
    return rel.select("event_id", F.posexplode("hits_time").alias("slot", "v")).select(
        "event_id", "slot", r("v").alias("value"))


@query("hits_time_diff", _TIME_SQL.format(
    view="pulse_dense", value="time - lag(time) OVER (PARTITION BY event_id ORDER BY time)",
    shift=2), "pulse_dense")
def hits_time_diff(t):
    diff = pulses.successive_times(t.pulse_dense, KEY)
    return diff.select("event_id", F.posexplode("hits_time").alias("slot", "v")).select(
        "event_id", "slot", r("v").alias("value"))


GAP_EDGES = edges.linspace(0.0, 3000.0, 153)
_GAPS_SQL = f"""
    WITH d AS (SELECT event_type AS run, date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 1e6 AS t
               FROM events),
         gaps AS (SELECT run, t - lag(t) OVER (PARTITION BY run ORDER BY t) AS gap FROM d),
         b AS {edges_sql(GAP_EDGES)},
         h AS (SELECT run, bin, lo, COUNT(*) AS n FROM gaps JOIN b ON {in_bin('gap')}
               GROUP BY run, bin, lo)"""


def seconds():
    """Seconds since 2024 of an event."""
    return F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', "
                  "CAST(ts AS TIMESTAMP_NTZ))") / 1e6


def _gap_hist(t):
    times = t.raw("events").select(F.col("event_type").alias("run"), seconds().alias("t"))
    gaps = pulses.ordered_gaps(times, ["run"], "t")
    return hist.hist_gaps(gaps, GAP_EDGES, ["run"])


@query("event_gaps", _GAPS_SQL + "SELECT run, bin, n FROM h")
def event_gaps(t):
    return _gap_hist(t).select("run", "bin", "n")


LIVETIME_SQL = _GAPS_SQL + """,
    m AS (SELECT run, SUM(n) AS s0, SUM(n * lo) AS s1, SUM(n * lo * lo) AS s2, SUM(n * ln(n)) AS t0,
                 SUM(n * lo * ln(n)) AS t1 FROM h GROUP BY run),
    f AS (SELECT run, s0, -(s0 * s2 - s1 * s1) / (s0 * t1 - s1 * t0) AS tau,
                 sqrt(s0 / (s0 * s2 - s1 * s1)) AS slope_err FROM m)"""


def livetimes(t):
    """Livetime per run with its error, from the gaps between events."""
    return fits.exponential_livetime(_gap_hist(t), ["run"])


@query("livetime", LIVETIME_SQL + f"""
    SELECT run, CAST(s0 AS DOUBLE) AS n_gaps, {G('tau', 8)} AS tau, {G('tau * tau * slope_err', 8)} AS tau_err,
           {G('s0 * tau', 8)} AS livetime FROM f""")
def livetime(t):
    return livetimes(t).select("run", "n_gaps", *[g(c, 8).alias(c) for c in ("tau", "tau_err", "livetime")])


@query("kfold", """
    SELECT event_id, CAST(ntile(3) OVER (ORDER BY event_id) - 1 AS INTEGER) AS fold FROM evt""", "evt")
def kfold(t):
    return ranking.contiguous_folds(t.evt.select("event_id"), "event_id", 3)


_DRAW = "(event_id * 7919 + 104729) % 1000003"


def _halves(t):
    draw = F.expr(_DRAW)
    return ranking.split_half(t.evt.select("event_id", "energy"), [draw, F.col("event_id")])


_HALVES_SQL = f"""
    SELECT event_id, energy, CASE WHEN r <= n // 2 THEN 1 ELSE 2 END AS half
    FROM (SELECT *, row_number() OVER (ORDER BY {_DRAW}, event_id) AS r, COUNT(*) OVER () AS n
          FROM evt)"""


@query("split_half", _HALVES_SQL, "evt")
def split_half(t):
    return _halves(t)


@query("merge_half", f"""
    SELECT half, COUNT(*) AS n, {R("SUM(energy)", 2)} AS energy, COUNT(extra) AS n_extra
    FROM (SELECT *, CASE WHEN half = 1 THEN energy END AS extra FROM ({_HALVES_SQL}))
    GROUP BY half""", "evt")
def merge_half(t):
    halves = _halves(t)
    first = halves.filter("half = 1").withColumn("extra", F.col("energy"))
    merged = first.unionByName(halves.filter("half = 2"), allowMissingColumns=True)
    return merged.groupBy("half").agg(F.count("*").alias("n"),
                                      r(F.sum("energy"), 2).alias("energy"),
                                      F.count("extra").alias("n_extra"))


_DRAW2 = "(event_id * 104723 + 7907) % 999983"


@query("permute_column", f"""
    WITH a AS (SELECT event_id, energy, row_number() OVER (ORDER BY {_DRAW}, event_id) AS r FROM evt),
         b AS (SELECT energy AS energy_perm, row_number() OVER (ORDER BY {_DRAW2}, event_id) AS r FROM evt)
    SELECT event_id, energy, energy_perm FROM a JOIN b USING (r)""", "evt")
def permute_column(t):
    a, b = F.expr(_DRAW), F.expr(_DRAW2)
    return ranking.permute(t.evt.select("event_id", "energy"), ["energy"],
                           [a, F.col("event_id")], [b, F.col("event_id")])
