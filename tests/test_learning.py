"""Feature layouts, folds and forests."""

import duckdb
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

import __spark_entry__ as entry
from muonloom.operators import ml, ranking
from muonloom.plans import learning
from muonloom.plans.views import KEY, Tables
from muonloom.sources import sinks
from tools.check_queries import canonical, connect

FOLDER = "/root/testdata/sf0.001"
S = ml.ForestSettings(trees=8, depth=6, min_leaf=5, bins=32)


@pytest.fixture(scope="module")
def signal(spark):
    """label = 3 x0 + x1, x2 is noise."""
    u = lambda seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(10007)) / 10007.0
    df = spark.range(1500).select(F.col("id").alias("event_id"),
                                  *[u(i).alias(f"x{i}") for i in range(3)])
    block = df.select("event_id", (3 * F.col("x0") + F.col("x1")).alias("label"),
                      array_to_vector(F.array("x0", "x1", "x2")).alias("features"))
    return ml.staged(ranking.hashed_folds(block, KEY, 3))


def test_layout_sizes(spark):
    sizes = {ml.core_layout: 109, ml.zenith_layout: 77, ml.energy_layout: 74}
    booked = learning.booked_arrays(Tables(spark, FOLDER)).limit(50)
    for layout, size in sizes.items():
        lay = layout()
        assert lay.size == size and lay.spans()[-1][2] == size
        got = booked.select(F.size(lay.as_array()).alias("n")).distinct().collect()
        assert [r.n for r in got] == [size]


def test_published_settings():
    assert (ml.GEOMETRY.trees, ml.GEOMETRY.depth, ml.GEOMETRY.bins, ml.GEOMETRY.folds) == (1000, 14, 50, 3)
    assert (ml.ENERGY.trees, ml.ENERGY.depth, ml.ENERGY.min_leaf) == (600, 10, 10)


@pytest.fixture(scope="module")
def showers(tmp_path_factory):
    """Sixty events of six equal hits, in both tanks of three stations: the training masks pass every one."""
    folder = str(tmp_path_factory.mktemp("showers"))
    tables = {
        "supplier": "SELECT i AS s_suppkey, 1000.0 * i AS s_acctbal, CAST(i AS INTEGER) AS s_nationkey FROM range(6) t(i)",
        "orders": """SELECT i AS o_orderkey, i % 30 AS o_custkey, 1000.0 + 50 * i AS o_totalprice, 'O' AS o_orderstatus,
                            DATE '1995-01-01' AS o_orderdate FROM range(1, 61) t(i)""",
        "lineitem": """SELECT i AS l_orderkey, i * 6 + j AS l_partkey, j AS l_suppkey, CAST(j AS INTEGER) AS l_linenumber,
                              100.0 * i AS l_extendedprice, DATE '1995-01-01' + CAST(j AS INTEGER) AS l_shipdate
                       FROM range(1, 61) t(i), range(6) u(j)"""}
    for name, sql in tables.items():
        duckdb.sql(f"COPY ({sql}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return folder


def registered_forests(spark, folder, name, monkeypatch):
    """The forests that score the events of ``folder`` in the registered query, one for each fold."""
    models, predict = [], ml.predict
    monkeypatch.setattr(ml, "predict", lambda model, *a, **k: models.append(model.stages[-1]) or predict(model, *a, **k))
    rows = entry.queries()[name](spark, folder).collect()
    assert len(rows) == 60 and all(r.mask and r.in_range for r in rows) and len(models) == learning.FOLDS
    return models


def test_registered_core_forests_are_the_published_ones(spark, showers, monkeypatch):
    grids, train_cv = [], ml.train_cv
    monkeypatch.setattr(ml, "train_cv", lambda rows, s, grid, **k: grids.append(grid) or train_cv(rows, s, grid, **k))
    for model in registered_forests(spark, showers, "rf_core", monkeypatch):
        got = [model.getOrDefault(p) for p in ("minInstancesPerNode", "maxBins")]
        assert model.getNumTrees == 1000 and model.getOrDefault("maxDepth") in (12, 14) and got == [10, 50]
    assert grids == [{"maxDepth": [12, 14]}] * learning.FOLDS


def test_grid_of_the_core_forest_follows_its_settings(spark, monkeypatch):
    monkeypatch.setattr(learning, "held_out", lambda *a, grid, **k: grid["maxDepth"])
    assert [learning.rf_core(None, ml.ForestSettings(depth=d)) for d in (1, 5, 14)] == [[0, 1], [3, 5], [12, 14]]


def test_registered_energy_forests_are_the_published_ones(spark, showers, monkeypatch):
    for model in registered_forests(spark, showers, "rf_energy", monkeypatch):
        got = [model.getOrDefault(p) for p in ("maxDepth", "minInstancesPerNode", "maxBins", "weightCol")]
        assert model.getNumTrees == 600 and got == [10, 10, 50, "weight"]


def test_trees_of_a_forest_are_wrapped_when_asked_for(signal):
    model = ml.train(signal, S).stages[-1]
    assert "trees" not in vars(model) and len(model.trees) == model.getNumTrees == S.trees


def test_out_of_fold_beats_the_mean_and_covers_all(signal):
    models = ml.fit_folds(signal, S)
    scored = ml.out_of_fold(signal, models, KEY)
    assert scored.count() == signal.count() == scored.select("event_id").distinct().count()
    assert ml.evaluate(scored).first().r2 > 0.8


def test_fold_models_never_saw_their_rows(signal):
    seen = {k: signal.filter(F.col("fold") != k).select("event_id") for k in range(3)}
    for k, train in seen.items():
        assert train.join(signal.filter(F.col("fold") == k), KEY).count() == 0


def test_permutation_importance_ranks_the_signal(signal):
    model = ml.train(signal.filter("fold <> 0"), S)
    imp = {r.position: r.value for r in ml.permutation_importance(
        model, signal.filter("fold = 0"), KEY, 3).collect()}
    assert imp[0] > imp[1] > imp[2] >= 0 and sum(imp.values()) == pytest.approx(1.0)


def test_cross_half_and_ensemble(signal):
    key = ranking.shuffle_key(KEY, 5)
    halves = ml.staged(ranking.split_half(signal, [key, F.col("event_id")]))
    scored = ml.cross_half(halves, S, KEY)
    pairs = {(r.half, r.model_id) for r in scored.select("half", "model_id").distinct().collect()}
    assert pairs == {(2, "half1"), (1, "half2")}
    models = [ml.train(halves.filter(F.col("half") == h), S) for h in (1, 2)]
    mean = {r.event_id: r.prediction for r in ml.ensemble_mean(signal, models, KEY).limit(50).collect()}
    a, b = [{r.event_id: r.prediction for r in ml.predict(m, signal, KEY).collect()} for m in models]
    assert all(v == pytest.approx((a[k] + b[k]) / 2) for k, v in mean.items())


@pytest.mark.parametrize("name", ["rf_core", "rf_core_y", "rf_zenith", "rf_energy", "ensemble_mean"])
def test_forest_queries_score_every_event(spark, name):
    t = Tables(spark, FOLDER)
    events = learning.vectors(t) if name == "ensemble_mean" else t.booked
    want = {r.event_id: r.n for r in events.groupBy("event_id").agg(F.count("*").alias("n")).collect()}
    scored = entry.queries()[name](spark, FOLDER)
    got = scored.groupBy("event_id").agg(F.count("*").alias("n"), F.min("in_range").alias("ok")).collect()
    assert {r.event_id: r.n for r in got} == want and all(r.ok for r in got)
    sql = canonical((c := connect(FOLDER).execute(entry.oracle_sql()[name])).fetchall(), [d[0] for d in c.description])
    assert sql == canonical([tuple(r) for r in scored.collect()], scored.columns)


def test_energy_forest_needs_training_rows(spark):
    with pytest.raises(ValueError, match="training mask"):
        learning.rf_energy(Tables(spark, FOLDER), mask=F.lit(False))


def test_out_of_bag_beats_the_mean_and_uses_unseen_trees_only(signal):
    block = ml.staged(signal)
    settings = ml.ForestSettings(trees=8, depth=5, min_leaf=5, bins=32)
    models = ml.fit_bags(block, settings, KEY)
    scored = ml.out_of_bag(block, models, KEY, settings.seed)
    rows = scored.collect()
    few = ml.out_of_bag(block, models, KEY, settings.seed, at_once=3).collect()
    same = lambda rs: sorted((r.event_id, r.n_bag, r.n_oob, round(r.prediction or 0, 9)) for r in rs)
    assert same(rows) == same(few) and len(rows) == signal.count()
    share = sum(r.n_oob for r in rows) / (8 * len(rows))
    assert abs(share - 0.368) < 0.05 and abs(sum(r.n_bag for r in rows) / (8 * len(rows)) - 1) < 0.1
    assert all((r.prediction is None) == (r.n_oob == 0) for r in rows)
    assert ml.evaluate(scored.filter("prediction IS NOT NULL")).first().r2 > 0.5
    # a row's prediction is the mean of the trees whose bag lacks it
    one = next(r for r in rows if 0 < r.n_oob < 8)
    each = [m.transform(signal.filter(F.col("event_id") == one.event_id)).select(
        "prediction", ml.bag_weight(KEY, k, settings.seed).alias("w")).first() for k, m in enumerate(models)]
    left = [p for p, w in each if w == 0]
    assert one.prediction == pytest.approx(sum(left) / len(left)) and one.n_oob == len(left)


def test_importance_uses_every_fold_and_donors_of_the_same_fold(signal):
    block = ml.staged(signal)
    values = ml.fold_importance(ml.fit_folds(block, S), block, KEY, 3)
    found = {(r.fold, r.position): r.value for r in values.collect()}
    folds = {r.fold for r in signal.select("fold").distinct().collect()}
    assert {f for f, _ in found} == folds and len(found) == 3 * len(folds)
    for f in folds:
        assert found[f, 0] > found[f, 1] >= 0
        assert sum(found[f, j] for j in range(3)) == pytest.approx(1.0)
    key = [ranking.shuffle_key(KEY, 1)]
    pairs = ml.donors(block, KEY, ["fold"], key, [F.col("event_id")]).collect()
    assert all(r.fold == r.fold_perm for r in pairs)
    assert sorted(r.event_id for r in pairs) == sorted(r.event_id_perm for r in pairs)


def test_mean_baseline(signal):
    rows = [(r.fold, r.label) for r in signal.select("fold", "label").collect()]
    for r in ml.mean_baseline(signal).collect():
        others = [x for f, x in rows if f != r.fold]
        mine = [x for f, x in rows if f == r.fold]
        m = sum(others) / len(others)
        assert r.mean_rmse == pytest.approx((sum((x - m) ** 2 for x in mine) / len(mine)) ** 0.5)


def test_cross_fitting_trains_on_the_other_folds(signal):
    calls = []

    def one(others, fold):
        calls.append(([r.fold for r in others.select("fold").distinct().orderBy("fold").collect()],
                      [r.fold for r in fold.select("fold").distinct().collect()]))
        return fold

    assert learning.cross_fitted(signal, one).count() == signal.count()
    assert calls == [([1, 2], [0]), ([0, 2], [1]), ([0, 1], [2])]


def test_cv_picks_the_lowest_rmse_and_weights_matter(signal):
    model, rmse = ml.train_cv(signal, S, {"maxDepth": [1, 6]}, fold_col="fold")
    assert rmse[1] < rmse[0] and model.stages[-1].getOrDefault("maxDepth") == 6
    heavy = signal.withColumn("weight", F.when(F.col("label") > 2, 100.0).otherwise(1.0))
    mean = lambda m: m.transform(signal).agg(F.avg("prediction")).first()[0]
    stump = ml.ForestSettings(trees=5, depth=0, min_leaf=1)
    assert mean(ml.train(heavy, stump, weighted=True)) > mean(ml.train(heavy, stump)) + 0.2


def test_model_survives_saving(signal, tmp_path):
    model = ml.train(signal, S)
    sinks.save_model(model, str(tmp_path / "m"))
    sinks.save_model(model, str(tmp_path / "m"))
    back = sinks.load_model(str(tmp_path / "m"))
    a = ml.predict(model, signal, KEY).orderBy("event_id").collect()
    assert a == ml.predict(back, signal, KEY).orderBy("event_id").collect()


def test_importance_groups(spark, signal):
    layout = ml.Layout({"a": (F.col("x0"), 1), "b": (F.col("x1"), 2)})
    model = ml.train(signal, S)
    imp = {r.feature: r.importance for r in ml.forest_importance(model, layout, signal).collect()}
    assert imp["a"] > imp["b"] and sum(imp.values()) == pytest.approx(1.0)
    per_fold = spark.createDataFrame([("a", 0.2), ("a", 0.4), ("b", 0.8)], "feature string, importance double")
    got = [(r.feature, r.importance) for r in ml.mean_importance(per_fold).collect()]
    assert got[0][0] == "b" and got[1][1] == pytest.approx(0.3)
