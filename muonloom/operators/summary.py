"""Per-event and per-station summaries."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from muonloom.functions.cuts import infill
from muonloom.functions.directions import distance
from muonloom.functions.guards import clamp
from muonloom.operators.geometry import tank_of
from muonloom.operators.pulses import EVENT_KEY
from muonloom.sources.constants import OM_TANK, SPEED_OF_LIGHT


def station_summary(pulses: DataFrame, keys: Sequence[str] = EVENT_KEY) -> DataFrame:
    """(event, station) totals: charge, largest charge, tanks and modules hit.

    Everything is a fixed-width buffer (bit masks for the distinct counts), so
    the map side combines the hits of a station before they are shuffled.
    """
    p = pulses if "tank" in pulses.columns else pulses.withColumn("tank", tank_of(F.col("om")))
    tank_bit = F.when(F.col("tank") == "A", F.lit(1)).when(F.col("tank") == "B", F.lit(2))
    om_bit = F.when(F.col("om").isin(*OM_TANK), F.call_function(
        "shiftleft", F.lit(1), (F.col("om") - min(OM_TANK)).cast("int")))
    return p.groupBy(*keys, "station").agg(
        F.sum("charge").alias("q"),
        F.max("charge").alias("q_max"),
        (F.coalesce(F.bit_count(F.bit_or(tank_bit)), F.lit(0)) >= 2).alias("hlc"),
        F.coalesce(F.bit_count(F.bit_or(om_bit)), F.lit(0)).alias("n_om"),
    )


def event_summary(pulses: DataFrame, keys: Sequence[str] = EVENT_KEY) -> DataFrame:
    """Multiplicities and charge sums of every event.

    qtotalhlc sums the hits of coincident stations, qtotal all hits, qhillas is
    qtotal without the largest hit; the loudest station is the coincident one
    with the largest hit, ties going to the larger station number.
    """
    s = station_summary(pulses, keys)
    loud = F.max(F.when(F.col("hlc"), F.struct("q_max", "station")))["station"]
    out = s.groupBy(*keys).agg(
        F.count_if(F.col("hlc")).alias("nsta"),
        F.sum(F.when(F.col("hlc"), 0).otherwise(F.col("n_om"))).alias("nslc"),
        F.sum("n_om").alias("ntanks"),
        F.sum(F.when(F.col("hlc"), F.col("q")).otherwise(F.lit(0.0))).alias("qtotalhlc"),
        F.sum("q").alias("qtotal"),
        F.max("q_max").alias("qmax"),
        loud.alias("loudest_station"),
    )
    return out.withColumns({
        "qhillas": F.col("qtotal") - F.col("qmax"),
        "loud_sta": F.coalesce(infill(F.col("loudest_station")), F.lit(False)),
    })


def loudest_station(pulses: DataFrame, keys: Sequence[str] = EVENT_KEY) -> DataFrame:
    """Station of the largest hit per event and whether it belongs to the infill.

    Stations are reduced first by a hash aggregate on a plain number, so the
    comparison of (charge, station) pairs sees each station once per event.
    """
    per_station = pulses.groupBy(*keys, "station").agg(F.max("charge").alias("charge"))
    best = per_station.groupBy(*keys).agg(F.max(F.struct("charge", "station")).alias("_b"))
    return best.select(*keys, F.col("_b.station").alias("station"),
                       infill(F.col("_b.station")).alias("loud_sta"))


def centre_of_gravity(hits: DataFrame, keys: Sequence[str] = EVENT_KEY,
                      power: float = 0.5) -> DataFrame:
    """Charge-weighted mean position and time of located hits; NULL when the weights sum to 0."""
    w = F.pow(F.col("charge"), power)
    total = F.sum(w)
    mean = lambda c: F.try_divide(F.sum(F.col(c) * w), total)
    return hits.groupBy(*keys).agg(
        mean("x").alias("cogx"), mean("y").alias("cogy"), mean("z").alias("cogz"),
        mean("time").alias("t0"))


def plane_front(hits: DataFrame, keys: Sequence[str] = EVENT_KEY,
                speed: float = SPEED_OF_LIGHT, singular: float = 1e-6) -> DataFrame:
    """Least-squares plane t = t0 + a x + b y through located hits, as zenith and azimuth.

    Uses centred moments, which Spark merges stably.  NULL with fewer than
    three hits or when the hits lie on a line.
    """
    m = hits.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.var_pop("x").alias("xx"), F.var_pop("y").alias("yy"),
        F.covar_pop("x", "y").alias("xy"),
        F.covar_pop("x", "time").alias("xt"), F.covar_pop("y", "time").alias("yt"))
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    ok = (F.col("n") >= 3) & (F.col("det") > singular)
    slope = lambda top: F.when(ok, F.try_divide(top, F.col("det")))
    a = slope(F.col("xt") * F.col("yy") - F.col("yt") * F.col("xy"))
    b = slope(F.col("yt") * F.col("xx") - F.col("xt") * F.col("xy"))
    m = m.withColumn("det", det).withColumns({"nx": -speed * a, "ny": -speed * b})
    norm = F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny"))
    return m.select(
        *keys, "n",
        F.asin(clamp(norm, 0.0, 1.0)).alias("zenith"),
        F.pmod(F.atan2("ny", "nx"), F.lit(2 * math.pi)).alias("azimuth"),
    )


def station_hits(pulses: DataFrame, weights: DataFrame | None = None,
                 keys: Sequence[str] = EVENT_KEY, weight: str = "weight",
                 stations: Column | None = None) -> DataFrame:
    """How often each infill station was hit, once per event, optionally weighted by event.

    Hits shrink to one row per (event, station) before the weight join.
    """
    chosen = infill(F.col("station")) if stations is None else stations
    once = pulses.filter(chosen).groupBy(*keys, "station").agg(F.lit(1).alias("_one"))
    if weights is None:
        return once.groupBy("station").agg(F.count(F.lit(1)).cast("double").alias("hits"))
    return once.join(weights.select(*keys, weight), list(keys)).groupBy("station").agg(
        F.sum(weight).alias("hits"))


def station_rate(hits: DataFrame, reference: int = 80, value: str = "hits") -> DataFrame:
    """Hits relative to those of the reference station (one row per station)."""
    ref = hits.filter(F.col("station") == reference).agg(F.max(value)).scalar()
    return hits.withColumn("rate", F.try_divide(F.col(value), ref))


def station_means(df: DataFrame, value: str, sample: str, names=("data", "mc")) -> DataFrame:
    """Mean per station in two samples and their difference."""
    a, b = names
    mean = lambda s: F.avg(F.when(F.col(sample) == s, F.col(value)))
    out = df.groupBy("station").agg(mean(a).alias(a), mean(b).alias(b))
    return out.withColumn("difference", F.col(b) - F.col(a))


def exposure(runs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Total livetime and number of runs."""
    return runs.groupBy(*by).agg(F.sum("duration").alias("duration"),
                                 F.count(F.lit(1)).alias("n_runs"))


def runs_in(runs: DataFrame, ranges: Sequence[tuple[int, int]]) -> DataFrame:
    """Runs inside any of the closed ranges."""
    cond = F.lit(False)
    for lo, hi in ranges:
        cond = cond | F.col("run").between(lo, hi)
    return runs.filter(cond)


def season(events: DataFrame, runs: DataFrame, ranges: Sequence[tuple[int, int]]) -> DataFrame:
    """Events of the selected runs.  The run list prunes partitions when run is one."""
    return events.join(runs_in(runs, ranges).select("run"), "run", "left_semi")


def event_rate(counts: Column, duration: Column) -> tuple[Column, Column]:
    """Rate and its Poisson error."""
    return F.try_divide(counts, duration), F.try_divide(F.sqrt(counts), duration)


def two_station(pulses: DataFrame, tanks: DataFrame, radius: float,
                keys: Sequence[str] = EVENT_KEY, stations: Column | None = None) -> DataFrame:
    """Events with two coincident stations (infill ones by default) that are neighbours.

    Stations are neighbours when tanks of theirs are at most ``radius`` apart.
    Tanks of coincident stations meet through space cells of that side within
    their event, so no table of neighbours of the whole geometry is made.
    """
    chosen = infill(F.col("station")) if stations is None else stations
    hlc = station_summary(pulses.filter(chosen), keys).filter("hlc").select(*keys, "station")
    side = lambda c: F.floor(F.col(c) / radius).cast("long")
    spots = hlc.join(tanks.select("station", "x", "y"), "station").withColumns(
        {"cx": side("x"), "cy": side("y")})
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"))
                      for i in (-1, 0, 1) for j in (-1, 0, 1)])
    around = spots.withColumn("step", F.explode(steps)).select(
        *keys, F.col("station").alias("other"), F.col("x").alias("x0"), F.col("y").alias("y0"),
        (F.col("cx") + F.col("step.i")).alias("cx"), (F.col("cy") + F.col("step.j")).alias("cy"))
    apart = distance(*[F.col(c) for c in ("x", "y", "x0", "y0")])
    return (
        spots.join(around, [*keys, "cx", "cy"])
        .filter((F.col("station") < F.col("other")) & (apart <= radius))
        .select(*keys).distinct()
    )
