"""Plans and skew: what has to stay true when one key owns a third of all rows."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from muonloom.functions import edges
from muonloom import session
from muonloom.operators import hist, pulses, ranking, skew, summary
from muonloom.plans.views import KEY, Tables

FOLDER = "/root/testdata/sf0.001"


def plan(df, mode="formatted"):
    jvm = df.sparkSession._jvm
    m = jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode)
    return df._jdf.queryExecution().explainString(m)


@pytest.fixture(scope="module")
def skewed(spark):
    """60k hits; event 7 owns a third of them."""
    ids = spark.range(60000)
    event = F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(100 + F.col("id") % 5000)
    return ids.select(
        event.cast("long").alias("event_id"),
        (F.col("id") * 31 % 81 + 1).cast("int").alias("station"),
        (61 + F.col("id") * 7 % 4).cast("int").alias("om"),
        (F.col("id") * 17 % 9973).cast("double").alias("time"),
        (F.col("id") * 13 % 7919 / 100.0).alias("charge"))


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_no_cartesian_product(spark, name):
    text = plan(entry.queries()[name](spark, FOLDER))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


def test_top_hits_are_cut_before_the_shuffle(spark):
    text = plan(pulses.top_pulses(Tables(spark, FOLDER).pulse, KEY, 35, ["hit"]), "simple")
    first, last = text.index("WindowGroupLimit"), text.rindex("WindowGroupLimit")
    assert first < text.index("Exchange") < last and "Partial" in text[last:last + 400]


def test_first_times_are_cut_before_the_shuffle(spark):
    text = plan(pulses.relative_times(Tables(spark, FOLDER).pulse, KEY), "simple")
    assert text.index("WindowGroupLimit") < text.index("Exchange") < text.rindex("WindowGroupLimit")


def test_scan_reads_only_what_is_used(spark):
    t = Tables(spark, FOLDER)
    text = plan(t.evt.filter("filt").groupBy("run").agg(F.sum("energy")))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {
        "o_orderstatus", "o_totalprice", "o_orderdate"}
    assert "PushedFilters: [IsNotNull(o_orderstatus), Not(EqualTo(o_orderstatus,F))]" in text


def test_small_geometry_is_broadcast_by_size_only(spark):
    t = Tables(spark, FOLDER)
    q = lambda: t.pulse.join(t.tank.select("station", "tank", "x"), ["station", "tank"])
    assert "BroadcastHashJoin" in plan(q())
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert "SortMergeJoin" in plan(q())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_histograms_combine_before_the_shuffle(spark):
    t = Tables(spark, FOLDER)
    text = plan(hist.hist1d(t.evt, F.col("loge"), edges.LOGE_EDGES, F.col("w"), ["run"], False),
                "simple")
    assert text.index("Exchange hashpartitioning(run") < text.rindex("partial_sum")


def test_salted_join_equals_a_plain_join(spark, rows, skewed):
    dim = pulses.station_multiplicity(skewed, KEY)
    keys = [*KEY, "station"]
    cols = [*skewed.columns, "n_tanks"]
    counts = dim.select(*keys, F.col("n_hits").alias("_n"))
    for how, known in (("inner", None), ("left", None), ("inner", counts), ("left", counts)):
        small = dim.select(*keys, "n_tanks")
        small = small if how == "inner" else small.filter("station % 2 = 0")
        a = skew.salted_join(skewed, small, keys, how, known, rows_per_task=100).select(cols)
        assert rows(a.na.fill(-1)) == rows(skewed.join(small, keys, how).select(cols).na.fill(-1))


def test_salted_join_spreads_the_hot_event(spark, skewed):
    old = spark.conf.get("spark.sql.adaptive.enabled")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.shuffle.partitions", "32")
        one_row = skewed.select("event_id").distinct().withColumn("w", F.lit(1.0))
        sizes = lambda df: [r["count"] for r in df.groupBy(
            F.spark_partition_id().alias("p")).count().collect()]
        plain = max(sizes(skewed.join(one_row, KEY)))
        salted = max(sizes(skew.salted_join(skewed, one_row, KEY, rows_per_task=500)))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert plain >= 20000 and salted < 6000


@pytest.mark.parametrize("name", ["hlc_slc_split", "pulse_triage"])
def test_few_scans_of_the_hits(spark, name):
    text = plan(entry.queries()[name](spark, FOLDER), "simple")
    assert text.count("Scan parquet") - text.count("Scan parquet [s_") <= 4


def test_cleaning_ignores_far_tanks(spark):
    """Tanks that no event has hit add nothing: pairs of tanks exist only within an event."""
    t = Tables(spark, FOLDER)
    far = spark.range(3000).select(
        (10_000 + F.col("id")).cast("int").alias("station"), F.lit("A").alias("tank"),
        (F.col("id") % 50).cast("double").alias("x"), F.col("id").cast("double").alias("y"))
    wide = t.tank.select("station", "tank", "x", "y").unionByName(far)
    a = pulses.seeded_clean(t.pulse, t.tank, keys=KEY)
    b = pulses.seeded_clean(t.pulse, wide, keys=KEY)
    key = lambda df: sorted(tuple(r) for r in df.select("event_id", "hit", "kept").collect())
    assert key(a) == key(b)


def test_hot_event_results(spark, skewed):
    local = skewed.toPandas()
    hot = local[local.event_id == 7]
    s = summary.event_summary(skewed, KEY).filter("event_id = 7").first()
    tanks = hot.assign(b=hot.om >= 63).groupby("station").b.nunique()
    assert s.nsta == (tanks >= 2).sum()
    assert s.qtotal == pytest.approx(hot.charge.sum()) and s.qmax == hot.charge.max()
    top = [r.charge for r in pulses.top_pulses(skewed.filter("event_id = 7"), KEY).orderBy("rank").collect()]
    assert top == sorted(hot.charge, reverse=True)[:35]


def test_gaps_split_a_hot_run(spark, skewed):
    """The window that sorts times is partitioned by time slice too, not by run alone."""
    gaps = pulses.ordered_gaps(skewed, KEY, "time", 100)
    assert re.search(r"Window \[.*lag\(time.*\], \[event_id#\d+L?, _slice", plan(gaps, "simple"))
    n = gaps.groupBy().agg(F.sum("n")).first()[0]
    assert n == 60000 - skewed.select("event_id").distinct().count()


def test_exact_ranks_without_one_big_sort(spark, skewed):
    df = spark.range(1000, 4000).select(((F.col("id") * 7919) % 100003).alias("k"))
    folds = ranking.contiguous_folds(df, "k", 3, rows_per_bucket=200)
    got = [r.fold for r in folds.orderBy("k").collect()]
    assert got == [0] * 1000 + [1] * 1000 + [2] * 1000
    ranked = ranking.with_rank(df, [F.col("k")], rows_per_bucket=200)
    assert [r["rank"] for r in ranked.orderBy("k").collect()] == list(range(1, 3001))
    text = plan(ranked, "simple")
    assert re.search(r"Window \[row_number\(\).*\], \[_bucket", text)


def test_rank_buckets_grow_with_the_rows(spark, monkeypatch):
    """More rows give more window partitions; one heavy value is split by the tie-breaker."""
    written = []
    monkeypatch.setattr(ranking, "cut_lineage", lambda df: written.append(session.cut_lineage(df)) or written[-1])
    for n in (1000, 8000):
        df = spark.range(n).select((F.col("id") % 2).alias("heavy"), "id")
        ranked = ranking.with_rank(df, [F.col("heavy"), F.col("id")], rows_per_bucket=500)
        assert [r.id for r in ranked.orderBy("rank").collect()] == [*range(0, n, 2), *range(1, n, 2)]
        sizes = [r["count"] for r in written[-1].groupBy("_bucket").count().collect()]
        assert len(sizes) >= n // 600 and max(sizes) < 1200


@pytest.mark.parametrize("n, sizes", [(7, [3, 2, 2]), (6, [2, 2, 2]), (2, [1, 1]), (8, [3, 3, 2])])
def test_fold_sizes(spark, n, sizes):
    df = spark.range(n).select(F.col("id").alias("k"))
    counts = ranking.contiguous_folds(df, "k", 3).groupBy("fold").count().orderBy("fold").collect()
    assert [r["count"] for r in counts] == sizes


def test_half_sizes_and_seed(spark):
    df = spark.range(5).select(F.col("id").alias("k"))
    key = ranking.shuffle_key(["k"], 3)
    halves = ranking.split_half(df, [key, F.col("k")])
    assert [r["count"] for r in halves.groupBy("half").count().orderBy("half").collect()] == [2, 3]


def test_permutation_is_one_to_one(spark):
    df = spark.range(500).select(F.col("id").alias("k"), (F.col("id") * 3).alias("v"))
    a, b = ranking.shuffle_key(["k"], 1), ranking.shuffle_key(["k"], 2)
    p = ranking.permute(df, ["v"], [a, F.col("k")], [b, F.col("k")]).collect()
    assert sorted(r.v_perm for r in p) == sorted(r.v for r in p)
    assert sum(r.v_perm == r.v for r in p) < 20
