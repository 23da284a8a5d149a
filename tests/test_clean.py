"""Seeded cleaning touches only events that a seed can change."""

import math
import random

from pyspark.sql import functions as F

from muonloom import session
from muonloom.operators import pulses, skew
from muonloom.plans import chains
from muonloom.plans.views import KEY

SCHEMA = "event_id long, station int, tank string, om int, charge double, time double, hit long"


def tables(spark):
    """2,000 events of one lone hit each; event 1 has a seed pair, a hit near it and one far off."""
    seeded = [(1, 1, "A", 61, 1.0, 0.0, 1), (1, 1, "B", 63, 1.0, 5.0, 2), (1, 2, "A", 61, 1.0, 50.0, 3),
              (1, 3, "A", 61, 1.0, 60.0, 4), (1, 2, "A", 61, 2.0, 50.0, 5), (1, None, "A", 61, 1.0, 5.0, 6)]
    lone = [(e, 2, "A", 61, 1.0, 50.0, e) for e in range(100, 2100)]
    tanks = spark.createDataFrame([(1, "A", 0.0, 0.0, 0.0), (1, "B", 10.0, 0.0, 0.0), (2, "A", 100.0, 0.0, 0.0),
                                   (3, "A", 5000.0, 0.0, 0.0)], "station int, tank string, x double, y double, z double")
    return spark.createDataFrame(seeded + lone, SCHEMA), tanks


def test_rounds_write_only_events_with_a_seed(spark, monkeypatch):
    hits, tanks = tables(spark)
    written = []
    monkeypatch.setattr(pulses, "cut_lineage", lambda df: written.append(session.cut_lineage(df)) or written[-1])
    got = pulses.seeded_clean(hits, tanks, 180.0, 450.0, KEY)
    kept = {r.hit: r.kept for r in got.filter("event_id = 1").collect()}
    assert kept == {1: True, 2: True, 3: True, 4: False, 5: True}
    assert got.count() == 2005 and got.filter("kept").count() == 4
    assert written and sum(df.count() for df in written) < 30


def test_records_write_only_kept_hits(spark, monkeypatch):
    hits, tanks = tables(spark)
    written = []
    for module in (pulses, chains):
        monkeypatch.setattr(module, "cut_lineage", lambda df: written.append(session.cut_lineage(df)) or written[-1])
    none = hits.filter("false")
    got = chains.event_records(hits.select("event_id").distinct(), hits, none, tanks.filter("x < -400"), tanks)
    assert got.count() == 2001
    assert {(r.event_id, r.nsta, r.qtotal) for r in got.filter("qtotal > 0").collect()} == {(1, 1, 5.0)}
    assert written and sum(df.count() for df in written) < 40


def test_marks_of_hot_keys_are_salted(spark):
    facts = spark.range(1000).select((F.col("id") % 4).alias("k"), F.col("id").alias("v"))
    marks = session.cut_lineage(facts.filter("k < 2").groupBy("k").agg(F.count("*").alias("_n")))
    got = skew.mark(facts, marks, ["k"], "found", rows_per_task=30)
    assert got.columns == ["k", "v", "found"] and got.count() == 1000
    assert {(r.k, r.found, r.n) for r in got.groupBy("k", "found").agg(F.count("*").alias("n")).collect()} == {
        (0, True, 250), (1, True, 250), (2, None, 250), (3, None, 250)}


def test_cleaning_as_by_hand_where_many_hits_are_near(spark):
    """Tanks every 90 m on both sides of 0, so that many lie just 180 m apart; times every 150 ns, so 450 apart."""
    draw = random.Random(5)
    spots = {(s, t): ((s % 9 - 4) * 90.0, (s // 9 - 3) * 90.0 + (0.0 if t == "A" else 30.0)) for s in range(63) for t in "AB"}
    hits = [(e, s, t, 61, 1.0, draw.randrange(-30, 30) * 150.0, e * 1000 + i)
            for e in range(6) for i, (s, t) in enumerate(draw.choices(sorted(spots), k=25))]
    both = {(h[0], h[1]) for h in hits if (h[0], h[1], "A") in {x[:3] for x in hits}
            and (h[0], h[1], "B") in {x[:3] for x in hits}}
    kept = {h for h in hits if h[:2] in both}
    while more := {h for h in set(hits) - kept if any(
            h[0] == k[0] and abs(h[5] - k[5]) <= 450.0 and math.dist(spots[h[1:3]], spots[k[1:3]]) <= 180.0 for k in kept)}:
        kept |= more
    assert len(both) < len(kept) < len(hits)
    tanks = spark.createDataFrame([(*k, *xy, 0.0) for k, xy in spots.items()],
                                  "station int, tank string, x double, y double, z double")
    got = pulses.seeded_clean(spark.createDataFrame(hits, SCHEMA), tanks, 180.0, 450.0, KEY).collect()
    assert len(got) == len(hits) and {r.hit for r in got if r.kept} == {h[6] for h in kept}


def test_exploded_neighbours_are_never_broadcast(spark):
    """Spark judges a broadcast by the size before the explosion: it does not fit the driver where events are full."""
    hits = session.cut_lineage(spark.range(100).selectExpr(
        "id AS event_id", "'1|A' AS tank_id", "0.0D AS time", "0.0D AS _x", "0.0D AS _y", "0L AS slice"))
    near = pulses._reach(hits, hits.withColumn("tank_id", F.lit("1|B")), 180.0, KEY)
    assert near.count() == 400
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
