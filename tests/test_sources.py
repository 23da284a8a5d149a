"""Run files in, tables out."""

import random

import pytest
from pyspark.sql import functions as F

from muonloom import schema
from muonloom.operators import geometry, pulses
from muonloom.sources import aligned, book, constants, sinks
from muonloom.streaming import incremental


def test_many_files_one_table_with_provenance(spark, tmp_path):
    for name, run in (("Level2_10410_Run00000120", 120), ("Level2_11663_Run00000131", 131)):
        spark.createDataFrame([(run, 1, 5, 61, 1.0, 2.0)], schema.PULSE).coalesce(1).write.parquet(
            str(tmp_path / name))
    df = book.book(spark, str(tmp_path / "Level2_*"), schema.PULSE)
    got = {(r.run, r.dataset, r.particle, r.pdg) for r in book.with_provenance(df).collect()}
    assert got == {(120, "10410", "proton", 2212), (131, "11663", "helium", 1000020040)}
    path = F.col("_metadata.file_path")
    assert {r[0] for r in df.select(book.run_of(path)).collect()} == {120, 131}
    assert [r.run for r in book.runs_ending_in(df, 0).collect()] == [120]


def test_missing_column_is_null_and_reported(spark, tmp_path):
    spark.createDataFrame([(1, 1)], "run int, event_id long").write.parquet(str(tmp_path / "a"))
    spark.createDataFrame([(2, 1, 0.5)], "run int, event_id long, predicted double").write.parquet(
        str(tmp_path / "b"))
    full = "run int, event_id long, predicted double"
    df = spark.read.schema(full).parquet(str(tmp_path / "a"), str(tmp_path / "b"))
    assert {(r.run, r.predicted) for r in book.missing_columns(df, ["predicted"]).collect()} == {(1, 1), (2, 0)}
    done = df.filter("predicted IS NOT NULL")
    assert [r.run for r in book.incomplete_runs(df, done).collect()] == [1]
    manifest = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b")], "run int, table string")
    assert [r.run for r in book.select_complete(df, manifest, ["a", "b"]).collect()] == [2]


def test_ragged_slices_cover_half_open_ranges(spark, rows):
    hits = spark.range(10).select(F.lit(1).alias("run"), F.col("id").alias("pos"), (F.col("id") * 10).alias("q"))
    index = spark.createDataFrame([(1, 100, 0, 3), (1, 101, 3, 3), (1, 102, 5, 9)],
                                  "run int, event_id long, start long, stop long")
    got = book.ragged_slice(hits, index, block=2).select("event_id", "pos")
    assert rows(got) == [(100, 0), (100, 1), (100, 2), (102, 5), (102, 6), (102, 7), (102, 8)]
    nested = spark.createDataFrame([(1, [(0.5, 61), (0.7, 62), (0.9, 63)])],
                                   "run int, pulses array<struct<charge:double,om:int>>")
    got = book.nested_slices(nested, index).select("event_id", "charge")
    assert rows(got) == [(100, 0.5), (100, 0.7), (100, 0.9)]


def test_nested_columns_are_pruned(spark, tmp_path):
    spark.createDataFrame([], schema.EVENT).write.parquet(str(tmp_path / "e"))
    flat = schema.flatten_event(book.book(spark, str(tmp_path / "e"), schema.EVENT)).select("cogx")
    text = flat._jdf.queryExecution().toString()
    assert "ReadSchema: struct<cog:struct<x:double>>" in text


def test_renames(spark):
    df = spark.range(1).select(F.col("id").alias("Plane_Zenith"), F.col("id").alias("Nsta"))
    assert schema.rename_variants(df).columns == ["plane_zenith", "nsta"]


def test_replace_by_name_leaves_the_others(spark, tmp_path, rows):
    store = str(tmp_path / "store")
    table = lambda v: spark.createDataFrame([(0, v)], "bin int, value double")
    sinks.put_quantity(table(1.0), store, "low")
    sinks.put_quantity(table(2.0), store, "high")
    sinks.put_quantity(table(3.0), store, "low")
    assert rows(sinks.get_quantity(spark, store, "low")) == [(0, 3.0)]
    assert rows(sinks.get_quantity(spark, store, "high")) == [(0, 2.0)]


def test_sibling_columns_and_summary(spark, tmp_path, rows):
    events = spark.createDataFrame([(1,), (2,)], "event_id long")
    path = sinks.write_sibling(spark.createDataFrame([(1, 0.5)], "event_id long, w double"),
                               str(tmp_path), "w")
    joined = sinks.attach_column(events, spark.read.parquet(path), ["event_id"])
    assert {tuple(r) for r in joined.collect()} == {(1, 0.5), (2, None)}
    sinks.write_summary(events, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2


def test_runs_are_booked_once(spark, tmp_path, rows):
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    fields = schema.PULSE
    put = lambda run, n: spark.createDataFrame(
        [(run, i, 1, 61, 0.0, 1.0) for i in range(n)], fields).coalesce(1).write.mode("append").parquet(src)
    go = lambda: incremental.book_new_runs(
        incremental.run_files(spark, src, fields), out, state).awaitTermination()
    counts = lambda: {r.run: r["count"] for r in spark.read.parquet(out).groupBy("run").count().collect()}
    put(1, 3)
    go()
    assert counts() == {1: 3}
    put(2, 4)
    go()
    go()
    assert counts() == {1: 3, 2: 4}


def test_a_run_in_two_batches_keeps_all_rows(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    fields = schema.PULSE
    for _ in range(2):
        spark.createDataFrame([(7, i, 1, 61, 0.0, 1.0) for i in range(5)], fields).coalesce(1) \
            .write.mode("append").parquet(src)
    failed = []

    def shaky(df):
        if len(failed) < 1:
            failed.append(True)
            raise RuntimeError("lost")
        return df

    for transform in (shaky, lambda df: df):
        stream = incremental.run_files(spark, src, fields, files_per_batch=1)
        try:
            incremental.book_new_runs(stream, out, state, transform).awaitTermination()
        except Exception:
            assert failed
    booked = spark.read.parquet(out)
    assert booked.count() == 10 and booked.select("batch").distinct().count() == 2


def test_windowed_histogram_drops_only_open_windows(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows = [("2024-01-01 01:00:00", 0.5), ("2024-01-01 05:00:00", 1.5), ("2024-01-02 01:00:00", 0.5),
            ("2024-01-04 00:00:00", 0.5)]
    df = spark.createDataFrame(rows, "t string, x double").select(F.to_timestamp("t").alias("t"), "x")
    df.coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    h = incremental.windowed_hist(stream, "t", F.col("x"), [0.0, 1.0, 2.0])
    incremental.run_to_table(h, out, state).awaitTermination()
    got = {(r.start.day, r.bin, r.hits) for r in spark.read.parquet(out).collect()}
    assert got == {(1, 0, 1), (1, 1, 1), (2, 0, 1)}


GAP_SCHEMA = "run string, s double, extra int"


def _add_times(spark, path, rows):
    spark.createDataFrame(rows, GAP_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def _stamped(spark, path):
    return (spark.readStream.schema(GAP_SCHEMA).parquet(path)
            .select("run", F.timestamp_seconds("s").alias("stamp"), F.col("s").alias("t"), "extra"))


def _tuples(df):
    return sorted((str(r.run), r.time, r.gap) for r in df.collect() for _ in range(r.n))


def test_gaps_of_arriving_files_are_those_of_the_whole(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    draw = random.Random(5)
    rows = [(draw.choice(["a", "a", "a", "b", None]), float(draw.randrange(36_000)), 1) for _ in range(600)]
    rows += [("a", 40_000.0, 1), ("b", 50_000.0, 1), ("b", None, 1), (None, None, None), ("a", 100_000.0, 1)]
    # a row comes at most half an hour of event time late
    rows.sort(key=lambda x: (x[1] or 0.0) + draw.random() * 1800)
    cuts = [0, 150, 151, 400, len(rows)]
    for k in range(4):
        _add_times(spark, src, rows[cuts[k]:cuts[k + 1]])
        stream = _stamped(spark, src)
        if k == 1:  # the second stream of this call is lost; the next call makes up for it
            slices = incremental.closed_slices(stream, ["run"], "stamp", "t")
            incremental.run_to_table(slices, f"{out}/slices", f"{state}/slices").awaitTermination()
            continue
        gaps = incremental.arriving_gaps(stream, ["run"], "stamp", "t", out, state)
    # all slices are over but that of the last row
    whole = spark.createDataFrame([x for x in rows if x[1] is not None and x[1] < 100_000.0 and x[0]], GAP_SCHEMA)
    got = _tuples(gaps)
    assert [g for g in got if g[0] != "None"] == _tuples(pulses.ordered_gaps(whole, ["run"], "s"))
    nameless = sorted(s for run, s, _ in rows if run is None and s is not None)
    assert [g for g in got if g[0] == "None"] == sorted(
        ("None", b, b - a) for a, b in zip(nameless, nameless[1:]))
    again = incremental.arriving_gaps(_stamped(spark, src), ["run"], "stamp", "t", out, state)
    assert _tuples(again) == got


def test_gaps_of_no_and_of_late_rows(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    spark.createDataFrame([], GAP_SCHEMA).write.parquet(src)
    args = (["run"], "stamp", "t", out, state)
    assert incremental.arriving_gaps(_stamped(spark, src), *args).count() == 0
    for rows in ([("a", 10.0, 1), ("a", 10.0, 1), ("a", 90_000.0, 1)], [("a", 11.0, 1), ("a", 200_000.0, 1)]):
        _add_times(spark, src, rows)
        got = _tuples(incremental.arriving_gaps(_stamped(spark, src), *args))
    # the row at 11 s came after its slice was closed
    assert got == [("a", 10.0, 0.0), ("a", 90_000.0, 89_990.0)]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_aligned_tables_join_without_exchange(spark, tmp_path):
    keys = ["run", "event_id"]
    base = spark.range(1000).selectExpr("id % 7 AS run", "id AS event_id", "id * 2 AS a")
    some = base.filter("event_id % 3 = 0").selectExpr("run", "event_id", "event_id AS b")
    at = [aligned.write_aligned(df, str(tmp_path / n), keys, 6) for n, df in (("base", base), ("some", some))]
    left, right = (aligned.read_aligned(spark, x, keys) for x in at)
    whole = aligned.aligned_join(left, right, keys=keys)
    assert "Exchange" not in _plan(whole)
    expected = sorted((i % 7, i, i * 2, i if i % 3 == 0 else None) for i in range(1000))
    assert sorted(tuple(x) for x in whole.collect()) == expected
    # written back in the same buckets: still no exchange, and joins on with others
    back = aligned.write_back(spark, at[0], right, str(tmp_path / "back"), keys)
    again = aligned.aligned_join(aligned.read_aligned(spark, back, keys),
                                 right.withColumnRenamed("b", "c"), keys=keys)
    assert "Exchange" not in _plan(again)
    assert sorted(tuple(x) for x in again.collect()) == [x + (x[3],) for x in expected]
    with pytest.raises(ValueError):
        aligned.write_back(spark, at[0], left, str(tmp_path / "clash"), keys)
    assert not [x for x in spark.catalog.listTables() if x.name.startswith("aligned_")]


def test_aligned_tables_of_unequal_buckets_and_odd_rows(spark, tmp_path):
    fields = "run int, event_id long, {} string"
    a = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (1, 2, "y"), (None, 3, "z"), (2, None, "w")], fields.format("a"))
    b = spark.createDataFrame([(1, 2, "p"), (2, None, "q"), (5, 5, "r")], fields.format("b"))
    expected = [("w", None), ("x", None), ("y", "p"), ("y", "p"), ("z", None)]
    for counts in ((4, 4), (4, 3), (2, 8)):
        one, two = (aligned.read_aligned(spark, aligned.write_aligned(
            df, str(tmp_path / f"{n}{counts}"), ["run", "event_id"], k), ["run", "event_id"])
            for df, n, k in zip((a, b), "ab", counts))
        got = aligned.aligned_join(one, two, keys=["run", "event_id"])
        assert sorted((r.a, r.b) for r in got.collect()) == expected
    empty = aligned.write_aligned(b.limit(0), str(tmp_path / "none"), ["run", "event_id"], 4)
    got = aligned.aligned_join(one, aligned.read_aligned(spark, empty, ["run", "event_id"], b.schema), keys=["run", "event_id"])
    assert got.count() == 5 and got.filter("b IS NOT NULL").count() == 0


def test_constant_tables(spark):
    p = constants.flux_parameters(spark)
    assert {r.model: r["count"] for r in p.groupBy("model").count().collect()} == {
        "h4a": 11, "h3a": 15, "poly": 15}
    assert constants.outside_spectra(spark).count() == 42 + 17
    assert constants.particles(spark).filter("particle = 'iron'").count() == 4


def test_shared_folder_is_required_on_a_cluster(spark, monkeypatch):
    from muonloom import session

    class Away:
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError):
        session.shared_dir(Away)


def test_tables_read_what_was_written(spark, tmp_path, rows):
    tanks = spark.createDataFrame([(1, "A", 0, 1.0, 2.0, 3.0), (4, "B", 7, 4.0, 6.0, 3.0)], schema.TANK)
    tanks.write.parquet(str(tmp_path / "tanks"))
    back = geometry.read_geometry(spark, str(tmp_path / "tanks"))
    assert rows(back) == rows(tanks) and back.schema == tanks.schema
    assert geometry.station_distance(back, 1, 4).first().distance == 5.0
    spark.createDataFrame([(7, *[1.5] * (len(schema.RUN_DIM) - 1))], ",".join(
        ["run int"] + [f"{f.name} double" for f in schema.RUN_DIM[1:]])).select(
        *[F.col(f.name).cast(f.dataType) for f in schema.RUN_DIM]).write.parquet(str(tmp_path / "runs"))
    assert book.read_runs(spark, str(tmp_path / "runs")).first().run == 7
    (tmp_path / "spectra.csv").write_text("name,log_energy,flux,err,sys_low,sys_high\na,5.0,1e-3,1e-4,,2e-4\n")
    assert tuple(book.read_spectra(spark, str(tmp_path / "spectra.csv")).first()) == ("a", 5.0, 1e-3, 1e-4, None, 2e-4)


def test_a_run_written_again_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "events")
    for run, n in ((1, 3), (2, 4), (1, 5)):
        sinks.write_events(spark.range(n).withColumn("run", F.lit(run)), path)
    assert {r.run: r["count"] for r in spark.read.parquet(path).groupBy("run").count().collect()} == {1: 5, 2: 4}


def test_run_selection_prunes_folders_at_run_time(spark, tmp_path):
    events = spark.range(400).select(F.col("id").alias("event_id"), (F.col("id") % 8).cast("int").alias("run"))
    sinks.write_events(events, str(tmp_path / "events"))
    spark.createDataFrame([(r, 100.0 * r) for r in range(8)], "run int, duration double").write.parquet(str(tmp_path / "runs"))
    read = lambda name: spark.read.parquet(str(tmp_path / name))
    kept = book.selected_runs(read("events"), read("runs"), F.col("duration") >= 600)
    assert {(r.run, r.duration) for r in kept.collect()} == {(6, 600.0), (7, 700.0)} and kept.count() == 100
    plan = kept._jdf.queryExecution().executedPlan()
    assert "dynamicpruning" in plan.toString()
    # all folders are known to the plan; which ones are opened is decided while it runs
    assert len([f for f in kept.inputFiles() if "/events/" in f]) >= 8
