"""Hit-level operators: union, exclusion, cleaning, HLC/SLC split and the 35-wide arrays."""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from muonloom.functions.directions import distance
from muonloom.functions.features import pad, zeros
from muonloom.operators.geometry import locate, tank_of
from muonloom.operators.skew import key_counts, mark, salted_join
from muonloom.schema import N_SLOTS
from muonloom.session import cut_lineage

EVENT_KEY = ("run", "event_id")


def union_pulses(hlc: DataFrame, slc: DataFrame, limit: float = 0.8) -> DataFrame:
    """All coincident hits plus the single hits above ``limit``; hits of a shared module append."""
    return hlc.unionByName(slc.filter(F.col("charge") > limit))


def exclude_tanks(pulses: DataFrame, bad: DataFrame,
                  on: Sequence[str] = ("station", "tank")) -> DataFrame:
    """Drop hits in excluded tanks.  The bad list is broadcast only if Spark measures it small."""
    return pulses.join(bad.select(*on).distinct(), list(on), "left_anti")


def station_multiplicity(pulses: DataFrame, keys: Sequence[str] = EVENT_KEY) -> DataFrame:
    """(event, station) -> number of tanks hit and of hits, as one map-side combined aggregate.

    Hits of an unknown tank count as hits only.
    """
    p = pulses if "tank" in pulses.columns else pulses.withColumn("tank", tank_of(F.col("om")))
    hit = F.when(F.col("tank") == "A", F.lit(1)).when(F.col("tank") == "B", F.lit(2))
    return p.groupBy(*keys, "station").agg(
        F.coalesce(F.bit_count(F.bit_or(hit)), F.lit(0)).alias("n_tanks"),
        F.count(F.lit(1)).alias("n_hits"))


def _with_multiplicity(pulses: DataFrame, kept: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Hits with the number of tanks hit at their station among ``kept``.

    Aggregate and join back instead of a window, so that the hits of one huge
    event never have to meet in one task; the aggregate also says which keys
    are hot.
    """
    dim, on = station_multiplicity(kept, keys), [*keys, "station"]
    counts = dim.select(*on, F.col("n_hits").alias("_n"))
    return salted_join(pulses, dim.drop("n_hits"), on, how, counts=counts)


def split_hlc(pulses: DataFrame, keys: Sequence[str] = EVENT_KEY) -> DataFrame:
    """Add ``hlc``: both tanks of the station were hit in this event."""
    return _with_multiplicity(pulses, pulses, keys, "inner").withColumn(
        "hlc", F.col("n_tanks") >= 2).drop("n_tanks")


def triage(pulses: DataFrame, limit: float = 0.1, keys: Sequence[str] = EVENT_KEY) -> DataFrame:
    """Class of every hit: 'removed' below the charge limit, else 'hlc' or 'slc' by station."""
    joined = _with_multiplicity(pulses, pulses.filter(F.col("charge") >= limit), keys, "left")
    return joined.withColumn(
        "hit_class",
        F.when(F.col("charge") < limit, F.lit("removed"))
        .when(F.col("n_tanks") >= 2, F.lit("hlc"))
        .otherwise(F.lit("slc")),
    ).drop("n_tanks")


def _reach(kept: DataFrame, rest: DataFrame, radius: float, keys: Sequence[str]) -> DataFrame:
    """What the kept hits reach of the others: per (event, tank, time slice) three numbers.

    Slices are one time window wide.  A hit in the same slice as a kept hit of
    a neighbouring tank is always within the window; for the slices before and
    after only the latest and the earliest kept time matter.  Kept hits shrink
    to one row per event, tank and slice.  They meet the tanks that other hits
    of the same event lie in through space cells two radii wide, of which a kept
    hit reaches at most four; the slices before and after are asked for by the
    other side.  Pairs of tanks exist only where both were hit, never for the
    geometry as a whole.  A tank reaches itself, also when its position is unknown.
    """
    shift = F.explode(F.array(*[F.lit(n) for n in (-1, 0, 1)]))
    spread = kept.groupBy(*keys, "tank_id", "slice").agg(
        F.min("time").alias("t_min"), F.max("time").alias("t_max"),
        F.first("_x").alias("x0"), F.first("_y").alias("y0"))
    reach = radius * (1 + 1e-6)  # cells may be one too many: distances are compared below
    cell = lambda c: F.floor(c / (2 * radius)).cast("long")
    span = lambda c: F.explode(F.sequence(cell(F.col(c) - reach), cell(F.col(c) + reach)))
    around = spread.drop("tank_id").withColumn("cx", span("x0")).withColumn("cy", span("y0"))
    wanted = (
        rest.select(*keys, "tank_id", F.col("slice").alias("_own"), "_x", "_y").distinct()
        .withColumns({"cx": cell(F.col("_x")), "cy": cell(F.col("_y"))})
        .withColumn("shift", shift).withColumn("slice", F.try_add("_own", "shift"))
    )
    apart = distance(*[F.col(c) for c in ("_x", "_y", "x0", "y0")])
    # Spark sizes tables before they are exploded: neither side may be broadcast for that
    near = (
        around.join(wanted.hint("merge"), [*keys, "slice", "cx", "cy"]).filter(apart <= radius)
        .select(*keys, "tank_id", F.col("_own").alias("slice"), "shift", "t_min", "t_max")
    )
    itself = spread.withColumn("shift", shift).select(
        *keys, "tank_id", F.try_subtract("slice", "shift").alias("slice"), "shift", "t_min", "t_max")
    at = lambda n, value: F.when(F.col("shift") == n, value)
    return near.unionByName(itself).groupBy(*keys, "tank_id", "slice").agg(
        F.max(at(0, F.lit(1))).alias("same"), F.max(at(-1, F.col("t_max"))).alias("before"),
        F.min(at(1, F.col("t_min"))).alias("after"))


def seeded_clean(pulses: DataFrame, tanks: DataFrame, radius: float = 180.0,
                 window: float = 450.0, keys: Sequence[str] = EVENT_KEY,
                 rounds: int | None = None) -> DataFrame:
    """Space-time cleaning seeded by HLC hits.

    Start from the HLC hits and, round by round, keep every hit within
    ``radius`` and ``window`` of a kept hit of the same event, until a round
    keeps nothing new (or ``rounds`` are over, if given).  Returns all hits with
    a ``kept`` flag.

    Only events with a seed can change, so rounds work on the distinct (event,
    tank, time) of those alone, each from a written table; a round asks what the
    ones kept by the round before reach of the others in the same events.  The
    hits themselves are never written: at the end they meet the kept keys,
    which Spark broadcasts while they are few.
    """
    p = pulses if "tank" in pulses.columns else pulses.withColumn("tank", tank_of(F.col("om")))
    on = [*keys, "station"]
    p = p.filter(functools.reduce(operator.and_, [F.col(c).isNotNull() for c in on]))
    tank_id = F.concat_ws("|", F.col("station"), F.col("tank"))
    spots = tanks.select("station", "tank", F.col("x").alias("_x"), F.col("y").alias("_y"))
    seeds = cut_lineage(station_multiplicity(p, keys).filter("n_tanks >= 2").select(*on, F.col("n_hits").alias("_n")))
    state = cut_lineage(
        p.select(*on, "tank", "time").join(seeds.select(*keys).distinct(), list(keys), "left_semi")
        .groupBy(*on, "tank", "time").agg(F.count(F.lit(1)).alias("_hits"))
        .join(spots, ["station", "tank"], "left")
        .join(seeds.select(*on, F.lit(True).alias("kept")), on, "left")
        .select(*keys, tank_id.alias("tank_id"), "time", "_x", "_y", "_hits",
                F.floor(F.col("time") / window).cast("long").alias("slice"),
                F.coalesce("kept", F.lit(False)).alias("kept"))
    )
    within = (
        (F.col("same") == 1)
        | (F.col("time") - F.col("before") <= window)
        | (F.col("after") - F.col("time") <= window)
    )
    reached, passed = [], 0
    while rounds is None or passed < rounds:
        new, rest = state.filter("kept"), state.filter("NOT kept")
        if new.isEmpty():
            break
        rest = rest.join(new.select(*keys).distinct(), list(keys), "left_semi")
        state = cut_lineage(salted_join(
            rest, _reach(new, rest, radius, keys), [*keys, "tank_id", "slice"], "left"
        ).withColumn("kept", F.coalesce(within, F.lit(False))).drop("same", "before", "after"))
        reached.append(state.filter("kept"))
        passed += 1
    out = p.join(spots.select("station", "tank"), ["station", "tank"], "left").withColumn("tank_id", tank_id)
    out, kept = mark(out, seeds, on, "_seed"), F.col("_seed")
    if reached:
        spot = [*keys, "tank_id", "time"]
        found = functools.reduce(DataFrame.unionByName, reached).groupBy(*spot).agg(F.max("_hits").alias("_n"))
        out, kept = mark(out, cut_lineage(found), spot, "_reached"), F.coalesce("_seed", "_reached")
    return out.select(*p.columns, F.coalesce(kept, F.lit(False)).alias("kept"))


def top_pulses(pulses: DataFrame, keys: Sequence[str] = EVENT_KEY, n: int = N_SLOTS,
               ties: Sequence[str] = ("station", "om", "time")) -> DataFrame:
    """The n largest hits of every event with their rank.

    ``row_number() <= n`` lets Spark keep only n rows per event in each map
    task before the shuffle, so an event of any size arrives already cut.
    """
    order = [F.col("charge").desc(), *[F.col(c).asc() for c in ties]]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return pulses.withColumn("rank", rank).filter(F.col("rank") <= n)


def pulse_arrays(pulses: DataFrame, tanks: DataFrame, keys: Sequence[str] = EVENT_KEY,
                 n: int = N_SLOTS, ties: Sequence[str] = ("station", "om", "time")) -> DataFrame:
    """Zero-padded arrays of the n largest charges and their tank positions, largest first."""
    top = locate(top_pulses(pulses, keys, n, ties), tanks)
    slots = F.array_sort(F.collect_list(F.struct("rank", "charge", "x", "y", "z")))
    packed = top.groupBy(*keys).agg(slots.alias("_s"))
    return packed.select(
        *keys,
        pad(F.col("_s.charge"), n).alias("pulses"),
        pad(F.col("_s.x"), n).alias("tank_x"),
        pad(F.col("_s.y"), n).alias("tank_y"),
        pad(F.col("_s.z"), n).alias("tank_z"),
    )


def first_times(pulses: DataFrame, keys: Sequence[str] = EVENT_KEY, n: int = N_SLOTS) -> DataFrame:
    """The n earliest hit times of every event, sorted, unpadded."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("time")))
    early = pulses.select(*keys, "time").withColumn("_r", rank).filter(F.col("_r") <= n)
    return early.groupBy(*keys).agg(F.sort_array(F.collect_list("time")).alias("times"))


def relative_times(pulses: DataFrame, keys: Sequence[str] = EVENT_KEY, n: int = N_SLOTS) -> DataFrame:
    """Hit times after the first hit, ascending.

    With m = min(hits, n) only m-1 values are kept: the last one is dropped,
    which is part of the booked definition.
    """
    t = F.col("times")
    rel = F.transform(F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))),
                      lambda v: v - F.get(t, F.lit(0)))
    return first_times(pulses, keys, n).select(*keys, pad(rel, n).alias("hits_time"))


def successive_times(pulses: DataFrame, keys: Sequence[str] = EVENT_KEY, n: int = N_SLOTS) -> DataFrame:
    """Older definition: differences between successive hit times, m-1 values with m = min(hits, n)."""
    t = F.col("times")
    later = F.slice(t, 2, n)
    earlier = F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0)))
    diff = F.zip_with(later, earlier, lambda a, b: a - b)
    return first_times(pulses, keys, n).select(*keys, pad(diff, n).alias("hits_time"))


def event_arrays(events: DataFrame, pulses: DataFrame, tanks: DataFrame,
                 keys: Sequence[str] = EVENT_KEY, n: int = N_SLOTS,
                 ties: Sequence[str] = ("station", "om", "time")) -> DataFrame:
    """Booked events: the event columns plus five arrays; events without hits get zeros.

    All three inputs are hash-partitioned on the event key, so the two joins
    add no shuffle beyond the one of ``events``.
    """
    names = ("pulses", "tank_x", "tank_y", "tank_z", "hits_time")
    out = (
        events.join(pulse_arrays(pulses, tanks, keys, n, ties), list(keys), "left")
        .join(relative_times(pulses, keys, n), list(keys), "left")
    )
    return out.withColumns({c: F.coalesce(F.col(c), zeros(n)) for c in names})


ROWS_PER_SLICE = 100_000


def ordered_gaps(df: DataFrame, part: Sequence[str], time: str,
                 rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Gaps between consecutive times of each group: (part, time, gap, n).

    Groups may be arbitrarily large: the times of each are cut into slices, as
    many as its number of rows asks for over its span, gaps inside a slice are
    found in parallel, and the gap across slices comes from a table with one
    row per slice.  Equal times give ``n`` gaps of 0.
    """
    t = F.col(time).cast("double")
    spans = df.groupBy(*part).agg(F.min(t).alias("_t0"), F.max(t).alias("_t1"),
                                  F.ceil(F.count(F.lit(1)) / rows_per_slice).alias("_slices"))
    times = df.groupBy(*part, F.col(time).alias("time")).agg(F.count(F.lit(1)).alias("_n"))
    share = F.try_divide(F.col("time").cast("double") - F.col("_t0"), F.col("_t1") - F.col("_t0"))
    times = times.join(spans, list(part)).withColumn(
        "_slice", F.coalesce(F.floor(share * F.col("_slices")), F.lit(0)).cast("long")
    ).drop("_t0", "_t1", "_slices")
    inside = Window.partitionBy(*part, "_slice").orderBy("time")
    within = times.select(
        *part, "time", (F.col("time") - F.lag("time").over(inside)).alias("gap"),
        F.lit(1).cast("long").alias("n"),
    ).filter(F.col("gap").isNotNull())
    edges = times.groupBy(*part, "_slice").agg(
        F.min("time").alias("time"), F.max("time").alias("_last"))
    across = edges.select(
        *part, "time",
        (F.col("time") - F.lag("_last").over(Window.partitionBy(*part).orderBy("_slice")))
        .alias("gap"),
        F.lit(1).cast("long").alias("n"),
    ).filter(F.col("gap").isNotNull())
    ties = times.filter(F.col("_n") > 1).select(
        *part, "time", F.lit(0.0).alias("gap"), (F.col("_n") - 1).alias("n"))
    return within.unionByName(across).unionByName(ties)


def shower_frame(pulses: DataFrame, tanks: DataFrame, showers: DataFrame,
                 keys: Sequence[str] = EVENT_KEY) -> DataFrame:
    """Hits with their tank position and the core and direction of their shower."""
    counts = key_counts(pulses, keys)  # from the bare hits: only the key is read
    return salted_join(locate(pulses, tanks), showers, keys, counts=counts)


def explode_slots(df: DataFrame, array: str, weight: Column, value: str = "value") -> DataFrame:
    """One row per array slot carrying the event weight."""
    rest = [c for c in df.columns if c != array]
    return df.select(*rest, weight.alias("weight"), F.posexplode(array).alias("slot", value))
