"""Hit-level operators on hand-made events."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from muonloom.operators import geometry, pulses, summary

KEY = ["event_id"]
SCHEMA = "event_id long, station int, om int, time double, charge double"


def hits(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def tanks(spark, rows):
    return spark.createDataFrame(rows, "station int, tank string, x double, y double, z double")


@pytest.fixture(scope="module")
def grid(spark):
    out = []
    for s in range(1, 50):
        x, y = (s % 7) * 100.0, (s // 7) * 100.0
        out += [(s, "A", x, y, 1946.0), (s, "B", x + 10, y, 1947.0)]
    return tanks(spark, out)


@pytest.mark.parametrize("n", [0, 1, 2, 35, 36, 40])
def test_arrays_are_padded_and_cut(spark, grid, n):
    data = [(1, i + 1, 61, 10.0 * i, 1.0 + i) for i in range(n)]
    events = spark.createDataFrame([(1,)], "event_id long")
    row = pulses.event_arrays(events, hits(spark, data), grid, KEY).first()
    charges = sorted((d[4] for d in data), reverse=True)[:35]
    assert row.pulses == charges + [0.0] * (35 - len(charges))
    for c in ("pulses", "tank_x", "tank_y", "tank_z", "hits_time"):
        assert len(row[c]) == 35
    m = min(n, 35)
    times = [10.0 * i for i in range(max(m - 1, 0))]
    assert row.hits_time == times + [0.0] * (35 - len(times))


def test_positions_follow_their_charge(spark, grid):
    data = [(1, 3, 61, 0.0, 1.0), (1, 5, 63, 1.0, 9.0), (1, 8, 61, 2.0, 4.0)]
    row = pulses.pulse_arrays(hits(spark, data), grid, KEY).first()
    assert row.pulses[:3] == [9.0, 4.0, 1.0]
    assert row.tank_x[:3] == [510.0, 100.0, 300.0]
    assert row.tank_z[:3] == [1947.0, 1946.0, 1946.0]


def test_equal_charges_keep_key_order(spark, grid):
    data = [(1, 9, 61, 0.0, 2.0), (1, 4, 61, 1.0, 2.0)]
    row = pulses.pulse_arrays(hits(spark, data), grid, KEY).first()
    assert row.tank_x[:2] == [400.0, 200.0]


def test_successive_times(spark):
    data = [(1, 1, 61, t, 1.0) for t in (5.0, 1.0, 2.0)]
    row = pulses.successive_times(hits(spark, data), KEY).first()
    assert row.hits_time[:3] == [1.0, 3.0, 0.0]


def test_hlc_slc_split_and_summary(spark):
    data = [
        (1, 26, 61, 0.0, 3.0), (1, 26, 63, 1.0, 2.0),   # both tanks
        (1, 30, 61, 2.0, 9.0),                          # one tank
        (1, 40, 61, 3.0, 1.0), (1, 40, 62, 4.0, 0.5),   # two modules of one tank
    ]
    split = {(r.station, r.om): r.hlc for r in pulses.split_hlc(hits(spark, data), KEY).collect()}
    assert split == {(26, 61): True, (26, 63): True, (30, 61): False, (40, 61): False,
                     (40, 62): False}
    s = summary.event_summary(hits(spark, data), KEY).first()
    assert (s.nsta, s.nslc, s.ntanks) == (1, 3, 5)
    assert s.qtotalhlc == 5.0 and s.qtotal == 15.5 and s.qmax == 9.0 and s.qhillas == 6.5
    assert s.loudest_station == 26 and s.loud_sta


def test_loudest_tie_goes_to_larger_station(spark):
    data = [(1, 26, 61, 0.0, 3.0), (1, 30, 61, 0.0, 3.0)]
    row = summary.loudest_station(hits(spark, data), KEY).first()
    assert row.station == 30 and not row.loud_sta


def test_centre_of_gravity(spark, grid):
    data = [(1, 1, 61, 0.0, 4.0), (1, 2, 61, 3.0, 1.0), (2, 1, 61, 0.0, 0.0)]
    c = {r.event_id: r for r in summary.centre_of_gravity(
        geometry.locate(hits(spark, data), grid), KEY).collect()}
    assert c[1].cogx == pytest.approx((100 * 2 + 200 * 1) / 3) and c[1].t0 == pytest.approx(1.0)
    assert c[2].cogx is None


def test_plane_front_recovers_a_direction(spark, grid):
    zenith, azimuth, speed = 0.4, 1.1, 0.299792458
    nx, ny = math.sin(zenith) * math.cos(azimuth), math.sin(zenith) * math.sin(azimuth)
    data = []
    for s in (1, 5, 9, 20, 33):
        x, y = (s % 7) * 100.0, (s // 7) * 100.0
        data.append((1, s, 61, 1000 - (nx * x + ny * y) / speed, 1.0))
    line = [(2, s, 61, float(s), 1.0) for s in (1, 2, 3)]
    found = {r.event_id: r for r in summary.plane_front(
        geometry.locate(hits(spark, data + line), grid), KEY).collect()}
    assert found[1].zenith == pytest.approx(zenith) and found[1].azimuth == pytest.approx(azimuth)
    assert found[2].zenith is None


def brute_clean(data, where, radius, window, rounds):
    tank = {61: "A", 62: "A", 63: "B", 64: "B"}
    out = {}
    for ev in {d[0] for d in data}:
        mine = [d for d in data if d[0] == ev]
        hit = {}
        for d in mine:
            hit.setdefault(d[1], set()).add(tank[d[2]])
        kept = {d for d in mine if len(hit[d[1]]) >= 2}
        for _ in range(rounds):
            kept |= {
                d for d in mine for k in kept
                if math.dist(where[d[1], tank[d[2]]], where[k[1], tank[k[2]]]) <= radius
                and abs(d[3] - k[3]) <= window}
        for d in mine:
            out[d] = d in kept
    return out


@pytest.mark.parametrize("rounds", [3, None])
def test_seeded_clean_against_brute_force(spark, grid, rounds):
    rng = np.random.default_rng(5)
    data = sorted({
        (int(e), int(s), int(o), float(t), 1.0)
        for e, s, o, t in zip(rng.integers(0, 6, 260), rng.integers(1, 50, 260),
                              rng.integers(61, 65, 260), rng.integers(0, 5000, 260))})
    where = {(r.station, r.tank): (r.x, r.y) for r in grid.collect()}
    got = pulses.seeded_clean(hits(spark, data), grid, 120.0, 300.0, KEY, rounds)
    found = {(r.event_id, r.station, r.om, r.time, r.charge): r.kept for r in got.collect()}
    want = brute_clean(data, where, 120.0, 300.0, rounds or 20)
    assert found == want and any(want.values()) and not all(want.values())


def test_cleaning_follows_a_long_chain(spark):
    tanks = spark.createDataFrame([(i, t, 100.0 * i, 0.0) for i in range(12) for t in "AB"],
                                  "station int, tank string, x double, y double")
    chain = [(1, 0, 61, 0.0, 1.0), (1, 0, 63, 0.0, 1.0)] + [(1, i, 61, 10.0 * i, 1.0) for i in range(1, 10)]
    lost = [(1, 11, 61, 0.0, 1.0), (2, 5, 61, 0.0, 1.0)]
    got = pulses.seeded_clean(hits(spark, chain + lost), tanks, 120.0, 300.0, KEY)
    kept = sorted(r.station for r in got.filter("kept").collect())
    assert kept == [0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 9] and got.count() == 13
    short = pulses.seeded_clean(hits(spark, chain), tanks, 120.0, 300.0, KEY, rounds=3)
    assert short.filter("kept").count() == 5


def test_unknown_tanks_are_no_tanks(spark):
    odd = hits(spark, [(1, 4, 61, 0.0, 1.0), (1, 4, 99, 0.0, 2.0), (2, 4, 61, 0.0, 1.0), (2, 4, 63, 0.0, 1.0)])
    assert {r.event_id: r.n_tanks for r in pulses.station_multiplicity(odd, KEY).collect()} == {1: 1, 2: 2}
    s = {r.event_id: r for r in summary.station_summary(odd, KEY).collect()}
    assert not s[1].hlc and s[1].n_om == 1 and s[1].q == 3.0 and s[2].hlc and s[2].n_om == 2


def test_two_station_needs_close_neighbours(spark, grid):
    both = lambda e, s: [(e, s, 61, 0.0, 1.0), (e, s, 63, 0.0, 1.0)]
    data = both(1, 2) + both(1, 3) + both(2, 2) + both(2, 30) + [(3, 2, 61, 0.0, 1.0)] + both(3, 3)
    found = summary.two_station(hits(spark, data), grid, 110.0, KEY, F.lit(True)).collect()
    assert [r.event_id for r in found] == [1]


def test_gaps_match_a_global_sort(spark, rows):
    rng = np.random.default_rng(2)
    data = [(int(r), float(t)) for r, t in zip(rng.integers(0, 3, 400), rng.integers(0, 900, 400))]
    df = spark.createDataFrame(data, "run int, t double")
    got = {}
    for r in pulses.ordered_gaps(df, ["run"], "t", 20).collect():
        got.setdefault(r.run, []).extend([r.gap] * r.n)
    for run in range(3):
        want = np.diff(np.sort([t for q, t in data if q == run]))
        assert sorted(got[run]) == sorted(want)


def test_union_and_exclusion(spark, rows):
    hlc = hits(spark, [(1, 1, 61, 0.0, 0.1)])
    slc = hits(spark, [(1, 1, 61, 1.0, 0.9), (1, 2, 61, 1.0, 0.8)])
    both = pulses.union_pulses(hlc, slc)
    assert [r[4] for r in rows(both)] == [0.1, 0.9]
    bad = spark.createDataFrame([(1, 61)], "station int, om int")
    assert pulses.exclude_tanks(both, bad, ["station", "om"]).count() == 0


def test_triage(spark):
    data = [(1, 1, 61, 0.0, 0.05), (1, 1, 63, 0.0, 1.0), (1, 2, 61, 0.0, 1.0), (1, 2, 63, 0.0, 0.1)]
    got = {(r.station, r.om): r.hit_class for r in pulses.triage(hits(spark, data), 0.1, KEY).collect()}
    assert got == {(1, 61): "removed", (1, 63): "slc", (2, 61): "hlc", (2, 63): "hlc"}


def test_station_counters(spark, rows):
    data = [(1, 26, 61, 0.0, 1.0), (1, 26, 63, 0.0, 1.0), (2, 26, 61, 0.0, 1.0), (2, 80, 61, 0.0, 1.0),
            (2, 5, 61, 0.0, 1.0)]
    weights = spark.createDataFrame([(1, 0.5), (2, 2.0)], "event_id long, weight double")
    assert rows(summary.station_hits(hits(spark, data), None, KEY)) == [(26, 2.0), (80, 1.0)]
    h = summary.station_hits(hits(spark, data), weights, KEY)
    assert rows(h) == [(26, 2.5), (80, 2.0)]
    assert rows(summary.station_rate(h)) == [(26, 2.5, 1.25), (80, 2.0, 1.0)]
