"""Forests over tables with missing values: every event is scored, only whole rows are learnt from."""

import math

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

import __spark_entry__ as entry
from muonloom.operators import ml
from tools.check_queries import TABLES, canonical, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def holed(tmp_path_factory):
    """The small tables with one value in nine missing in every column but the first."""
    folder = str(tmp_path_factory.mktemp("holed"))
    con = connect(FOLDER)
    for table in TABLES:
        columns = [d[0] for d in con.execute(f"SELECT * FROM {table} LIMIT 0").description]
        kept = [f"CASE WHEN hash(row_no, '{c}') % 9 <> 0 THEN {c} END AS {c}" for c in columns[1:]]
        con.execute(f"COPY (SELECT {', '.join([columns[0], *kept])} FROM (SELECT *, row_number() OVER () AS row_no FROM {table}))"
                    f" TO '{folder}/{table}.parquet' (FORMAT parquet)")
    return folder


def assert_as_sql(spark, folder, name):
    df = entry.queries()[name](spark, folder)
    want = (c := connect(folder).execute(entry.oracle_sql()[name])).fetchall()
    assert want and canonical([tuple(r) for r in df.collect()], df.columns) == canonical(want, [d[0] for d in c.description])


@pytest.mark.parametrize("name", ["rf_core", "rf_core_y", "rf_energy", "rf_predict", "rf_zenith"])
def test_every_event_is_scored_despite_missing_values(spark, holed, name):
    assert_as_sql(spark, holed, name)


def test_vectors_are_finite_and_as_wide_as_the_layout(spark):
    rows = spark.createDataFrame(
        [(1.0, [1.0, 2.0]), (None, [math.nan, None]), (math.inf, None), (-math.inf, [5.0, 6.0, 7.0]), (2.0, [3.0])],
        "a double, b array<double>")
    layout = ml.Layout({"a": (F.col("a"), 1), "b": (F.col("b"), 2)})
    got = [list(r.v) for r in rows.select(layout.vector().alias("v")).collect()]
    big = 3.4028235e38
    assert got == [[1, 1, 2], [0, 0, 0], [big, 0, 0], [-big, 5, 6], [2, 3, 0]]


def test_heldout_metrics_trains_and_scores_every_fold(spark, holed, monkeypatch):
    scored, evaluate = [], ml.evaluate
    monkeypatch.setattr(ml, "evaluate", lambda df, **by: scored.append(df.count()) or evaluate(df, **by))
    got = entry.queries()["heldout_metrics"](spark, holed).collect()
    assert len(got) == 3 and all(r.is_sane for r in got)
    assert len(scored) == 1 and 0 < scored[0] < sum(r.n for r in got)
    assert_as_sql(spark, holed, "heldout_metrics")


def untrained(tmp_path, keep):
    """The small tables without coincident hits but in the events where ``keep``: the training masks pass no others."""
    con = connect(FOLDER)
    for table in TABLES:
        changed = (f"* REPLACE (CASE WHEN {keep} THEN l_suppkey ELSE l_suppkey - l_suppkey % 2 END AS l_suppkey)"
                   if table == "lineitem" else "*")
        con.execute(f"COPY (SELECT {changed} FROM {table}) TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
    return str(tmp_path)


def rows_and_range(spark, folder, name):
    """Rows but for ``in_range``, which have to be those of the SQL, and ``in_range`` by event."""
    df = entry.queries()[name](spark, folder)
    got = df.collect()
    want = (c := connect(folder).execute(entry.oracle_sql()[name])).fetchall()
    names, plain = [d[0] for d in c.description], [x for x in df.columns if x != "in_range"]
    pick = lambda rows, of: [tuple(r[of.index(x)] for x in plain) for r in rows]
    assert want and canonical(pick(got, df.columns), plain) == canonical(pick(want, names), plain)
    return {r.event_id: r.in_range for r in got}


@pytest.mark.parametrize("name", ["rf_core", "rf_core_y", "rf_energy", "rf_predict", "rf_zenith"])
def test_events_are_returned_unscored_where_no_event_passes_the_mask(spark, tmp_path, name):
    with pytest.warns(UserWarning, match="without a prediction"):
        assert not any(rows_and_range(spark, untrained(tmp_path, "FALSE"), name).values())


@pytest.mark.parametrize("name", ["rf_core_y", "rf_energy", "rf_zenith"])
def test_only_the_fold_whose_others_have_no_training_event_is_unscored(spark, tmp_path, name):
    fold = lambda e: (e * 7919 + 104729) % 1000003 % 3
    with pytest.warns(UserWarning, match="without a prediction"):
        got = rows_and_range(spark, untrained(tmp_path, "(l_orderkey * 7919 + 104729) % 1000003 % 3 = 0"), name)
    assert {fold(e): v for e, v in got.items()} == {0: False, 1: True, 2: True}
    assert all(v == (fold(e) != 0) for e, v in got.items())


def trained_on_one(tmp_path):
    """Tables in which one event passes the masks, a simulated one, and that event."""
    sql = entry.oracle_sql()["rf_energy"]
    event = connect(FOLDER).execute(f"SELECT min(event_id) FROM ({sql}) WHERE mask AND event_id % 2 = 0").fetchone()[0]
    return untrained(tmp_path, f"l_orderkey = {event}"), event


def assert_one_is_enough(spark, tmp_path, name):
    folder, event = trained_on_one(tmp_path)
    fold = lambda e: (e * 7919 + 104729) % 1000003 % 3
    got = rows_and_range(spark, folder, name)
    assert all(v == (name == "rf_predict" or fold(e) != fold(event)) for e, v in got.items())


@pytest.mark.parametrize("name", ["rf_energy", "rf_predict"])
def test_weighted_forests_of_one_event_say_its_label(spark, tmp_path, name):
    assert_one_is_enough(spark, tmp_path, name)


@pytest.mark.parametrize("weights", [[1.0], [2.0, 2.0], [0.0, 0.0, 0.0]])
def test_empty_bags_do_not_pull_predictions_to_zero(spark, weights):
    rows = spark.createDataFrame([(i, 10.0 + i, w, [float(i)]) for i, w in enumerate(weights)],
                                 "event_id long, label double, weight double, x array<double>")
    block = rows.withColumn("features", array_to_vector("x"))
    fit = lambda b: ml.train(b, ml.ForestSettings(trees=40, depth=3, min_leaf=1, bins=32), weighted=True)
    for r in ml.fit_predict(fit, block, block, ["event_id"]).collect():
        assert 10 - 1e-9 <= r.prediction <= 9 + len(weights) + 1e-9


@pytest.mark.parametrize("name", ["rf_core", "rf_core_y", "rf_zenith"])
def test_geometry_forests_of_one_event_say_its_label(spark, tmp_path, name):
    assert_one_is_enough(spark, tmp_path, name)


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_grid_over_fewer_rows_than_folds_need(spark, n):
    block = spark.range(n).select((F.col("id") + 10.0).alias("label"), array_to_vector(F.array(F.col("id") * 1.0)).alias("features"))
    s = ml.ForestSettings(trees=5, depth=5, min_leaf=1, bins=32, folds=3)
    model, rmse = ml.train_cv(block, s, {"maxDepth": [3, 5]})
    assert model.transform(block).count() == n and len(rmse) == 2
    assert n > 1 or all(math.isnan(x) for x in rmse) and model.stages[-1].getOrDefault("maxDepth") == 5
