"""Random-forest regression: feature blocks, training, scoring, importance."""

from __future__ import annotations

import functools
import math
import warnings
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import DecisionTreeRegressionModel, RandomForestRegressionModel, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, Window, functions as F

from muonloom.functions.features import log_array, pad, zeros
from muonloom.functions.guards import finite, is_finite, log10_feature, ratio
from muonloom.operators.hist import metrics
from muonloom.operators.ranking import permute, shuffle_key
from muonloom.schema import N_SLOTS
from muonloom.session import cut_lineage


@dataclass(frozen=True)
class Layout:
    """Ordered feature groups: name -> (column, width)."""

    groups: Mapping[str, tuple[Column, int]] = field(default_factory=dict)

    @property
    def size(self) -> int:
        return sum(w for _, w in self.groups.values())

    def spans(self) -> list[tuple[str, int, int]]:
        """(group, first, last+1) positions in the feature vector."""
        out, at = [], 0
        for name, (_, width) in self.groups.items():
            out.append((name, at, at + width))
            at += width
        return out

    def as_array(self) -> Column:
        parts = [c if w > 1 else F.array(c.cast("double")) for c, w in self.groups.values()]
        return F.concat(*parts)

    def vector(self) -> Column:
        """One vector of ``size`` finite numbers: what is missing is 0, and no group is wider than it says."""
        parts = [pad(F.slice(F.coalesce(c, zeros(w)), 1, w), w) if w > 1 else F.array(c.cast("double"))
                 for c, w in self.groups.values()]
        return array_to_vector(F.transform(F.concat(*parts), finite))


def core_layout() -> Layout:
    """109 features of the core-position forests."""
    return Layout({
        "cogx": (F.col("cogx"), 1),
        "cogy": (F.col("cogy"), 1),
        "lognsta": (log10_feature(F.col("nsta")), 1),
        "coszen": (F.cos("plane_zenith"), 1),
        "pulses": (F.col("pulses"), N_SLOTS),
        "tank_x": (F.col("tank_x"), N_SLOTS),
        "tank_y": (F.col("tank_y"), N_SLOTS),
    })


def zenith_layout() -> Layout:
    """77 features of the zenith forest."""
    return Layout({
        "cogx": (F.col("cogx"), 1),
        "cogy": (F.col("cogy"), 1),
        "lognsta": (log10_feature(F.col("nsta")), 1),
        "zenith": (F.col("plane_zenith"), 1),
        "azimuth": (F.col("plane_azimuth"), 1),
        "t0": (F.col("t0"), 1),
        "zsc": (F.col("zsc_avg"), 1),
        "pulses": (F.col("pulses"), N_SLOTS),
        "hits_time": (F.col("hits_time"), N_SLOTS),
    })


def energy_layout() -> Layout:
    """74 features of the energy forest."""
    return Layout({
        "logqtotal": (log10_feature(F.col("qtotalhlc")), 1),
        "logqsum2": (log10_feature(F.col("qsum2")), 1),
        "lognstation": (log10_feature(F.col("nsta")), 1),
        "costheta": (F.cos("zenith"), 1),
        "pulses": (log_array(F.col("pulses")), N_SLOTS),
        "rhit": (log_array(F.col("frac_radius")), N_SLOTS),
    })


def feature_block(df: DataFrame, layout: Layout, label: Column, keys: Sequence[str],
                  weight: Column | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """(keys..., keep..., label, weight?, features): everything a forest needs, nothing else."""
    cols = [*keys, *keep, label.cast("double").alias("label")]
    if weight is not None:
        cols.append(weight.cast("double").alias("weight"))
    return df.select(*cols, layout.vector().alias("features"))


def trainable(block: DataFrame, weighted: bool = False) -> DataFrame:
    """The rows a forest can learn from: a finite label and, if weighted, a finite weight of 0 or more."""
    rows = block.filter(is_finite(F.col("label")))
    return rows.filter(is_finite(F.col("weight")) & (F.col("weight") >= 0)) if weighted else rows


@dataclass(frozen=True)
class ForestSettings:
    trees: int = 1000
    depth: int = 14
    min_leaf: int = 10
    bins: int = 50
    folds: int = 3
    seed: int = 11
    memory_mb: int = 256  # of each task, for node statistics: more nodes per pass over the block


GEOMETRY = ForestSettings()
GEOMETRY_TRIAL = ForestSettings(trees=200)
ENERGY = ForestSettings(trees=600, depth=10)


class ForestModel(RandomForestRegressionModel):
    """MLlib's forest.  Its ``trees`` are wrapped when asked for: PySpark 4.1 wraps each tree of each fit, 9 s for 1000."""

    @property
    def trees(self) -> list[DecisionTreeRegressionModel]:
        return [DecisionTreeRegressionModel(m) for m in self._call_java("trees")]


class Forest(RandomForestRegressor):
    """MLlib's forest estimator, whose fits give a ``ForestModel``."""

    def _create_model(self, java_model) -> ForestModel:
        return ForestModel(java_model)


def forest(s: ForestSettings, weighted: bool = False, prediction: str = "prediction"
           ) -> RandomForestRegressor:
    rf = Forest(
        featuresCol="features", labelCol="label", predictionCol=prediction,
        numTrees=s.trees, maxDepth=s.depth, minInstancesPerNode=s.min_leaf,
        maxBins=s.bins, seed=s.seed, maxMemoryInMB=s.memory_mb)
    return rf.setWeightCol("weight") if weighted else rf


def train(block: DataFrame, s: ForestSettings, weighted: bool = False) -> PipelineModel:
    return Pipeline(stages=[forest(s, weighted)]).fit(block)


def train_cv(block: DataFrame, s: ForestSettings, grid: Mapping[str, Sequence] | None = None,
             fold_col: str | None = None, parallelism: int = 3, weighted: bool = False
             ) -> tuple[PipelineModel, list[float]]:
    """k-fold cross-validated grid; the best mean RMSE wins.  Returns (model, mean RMSEs).

    Without ``fold_col`` rows are dealt by a digest of their features, and a fold that gets none is left out.
    Where fewer than two folds have rows there is nothing to compare: the model has the settings as they are and
    the RMSEs are NaN.
    """
    rf = forest(s, weighted)
    builder = ParamGridBuilder()
    for name, values in (grid or {"maxDepth": [s.depth]}).items():
        builder = builder.addGrid(rf.getParam(name), list(values))
    points, pipeline, folds = builder.build(), Pipeline(stages=[rf]), s.folds
    if not fold_col:
        fold_col = "_fold"
        digest = F.xxhash64(vector_to_array("features"), F.lit(s.seed))
        block = block.withColumn(fold_col, F.pmod(digest, F.lit(folds)).cast("int"))
        used = sorted(r[0] for r in block.select(fold_col).distinct().collect())
        if len(used) < 2:
            return pipeline.fit(block), [math.nan] * len(points)
        folds = len(used)
        block = block.withColumn(fold_col, (F.array_position(F.lit(used), F.col(fold_col)) - 1).cast("int"))
    cv = CrossValidator(
        estimator=pipeline, estimatorParamMaps=points, evaluator=RegressionEvaluator(), numFolds=folds, seed=s.seed,
        parallelism=parallelism).setFoldCol(fold_col)
    fitted = cv.fit(block)
    return fitted.bestModel, list(fitted.avgMetrics)


def predict(model: PipelineModel, block: DataFrame, keys: Sequence[str],
            name: str = "prediction", keep: Sequence[str] = ()) -> DataFrame:
    """Keyed predictions; they stay distributed and join back by key."""
    return model.transform(block).select(*keys, *keep, F.col("prediction").alias(name))


def mean_label(rows: DataFrame) -> float | None:
    """Mean label, by weight where ``rows`` have weights above 0; None without rows."""
    mean = F.avg("label")
    if "weight" in rows.columns:
        weighted = ratio(F.sum(F.col("label") * F.col("weight")), F.sum("weight"))
        mean = F.when(is_finite(weighted), weighted).otherwise(mean)
    return rows.agg(mean).first()[0]


def fit_predict(fit: Callable[[DataFrame], PipelineModel], rows: DataFrame, block: DataFrame, keys: Sequence[str],
                keep: Sequence[str] = (), needed: bool = False) -> DataFrame:
    """``block`` scored by the forest that ``fit`` makes of ``rows``.

    The forest learns labels less their mean, which its predictions get back: MLlib's trees say 0 where their bag
    is empty, as happens with few rows.  Without rows predictions are NULL, or it is an error if a forest is
    ``needed``.
    """
    mean = mean_label(rows)
    if mean is None:
        if needed:
            raise ValueError("no event to learn from passes the training mask")
        warnings.warn("no event passes the training mask: events are returned without a prediction", stacklevel=2)
        return block.select(*keys, *keep, F.lit(None).cast("double").alias("prediction"))
    model = fit(rows.withColumn("label", F.col("label") - mean))
    return predict(model, block, keys, "prediction", keep).withColumn("prediction", F.col("prediction") + mean)


def cross_half(block: DataFrame, s: ForestSettings, keys: Sequence[str], half: str = "half",
               weighted: bool = False) -> DataFrame:
    """Train on each half and score the other one."""
    out = None
    for trained, scored in ((1, 2), (2, 1)):
        model = train(block.filter(F.col(half) == trained), s, weighted)
        part = model.transform(block.filter(F.col(half) == scored)).select(
            *keys, half, "label", "prediction", F.lit(f"half{trained}").alias("model_id"))
        out = part if out is None else out.unionByName(part)
    return out


def fit_folds(block: DataFrame, s: ForestSettings, fold: str = "fold",
              weighted: bool = False) -> list[PipelineModel]:
    """One model per fold, trained on the other folds."""
    return [train(block.filter(F.col(fold) != k), s, weighted) for k in range(s.folds)]


def out_of_fold(block: DataFrame, models: Sequence[PipelineModel], keys: Sequence[str],
                fold: str = "fold") -> DataFrame:
    """Every row scored by the model that did not see it."""
    out = None
    for k, model in enumerate(models):
        part = model.transform(block.filter(F.col(fold) == k)).select(
            *keys, fold, "label", "prediction")
        out = part if out is None else out.unionByName(part)
    return out


def ensemble_mean(block: DataFrame, models: Sequence[PipelineModel], keys: Sequence[str],
                  name: str = "prediction") -> DataFrame:
    """Mean prediction of several models, side by side in one pass (no join)."""
    out = block
    names = []
    for i, model in enumerate(models):
        names.append(f"_p{i}")
        out = model.transform(out).withColumnRenamed("prediction", names[-1])
    mean = sum((F.col(n) for n in names), F.lit(0.0)) / float(len(names))
    return out.select(*keys, mean.alias(name))


def prediction_rows(scored: DataFrame, target: str, model_id: str | Column,
                    keys: Sequence[str], value: str = "prediction",
                    fold: Column | None = None) -> DataFrame:
    """Predictions as rows of one table keyed by target and model."""
    model = F.lit(model_id) if isinstance(model_id, str) else model_id
    return scored.select(
        *keys, F.lit(target).alias("target"), model.alias("model_id"),
        (F.lit(None).cast("int") if fold is None else fold).alias("fold"),
        F.col(value).alias("value"))


def use_predictions(events: DataFrame, predictions: DataFrame, model_of: Mapping[str, str],
                    keys: Sequence[str]) -> DataFrame:
    """Events with one column per target, each taken from the model named for it."""
    wanted = F.lit(False)
    for target, model in model_of.items():
        wanted = wanted | ((F.col("target") == target) & (F.col("model_id") == model))
    wide = predictions.filter(wanted).groupBy(*keys).agg(*[
        F.max(F.when(F.col("target") == t, F.col("value"))).alias(t) for t in model_of])
    return events.join(wide, list(keys), "left")


def vector_table(vectors: DataFrame, by: Sequence[str], vector: str = "importance") -> DataFrame:
    """(by..., position, value) of an array column."""
    return vectors.select(*by, F.posexplode(vector).alias("position", "value"))


def group_importance(values: DataFrame, layout: Layout | Sequence[tuple[str, int, int]],
                     by: Sequence[str] = ()) -> DataFrame:
    """Sum of importances over the positions of each feature group."""
    spans = layout.spans() if isinstance(layout, Layout) else layout
    name = F.when(F.lit(False), F.lit(""))
    for g, lo, hi in spans:
        name = name.when((F.col("position") >= lo) & (F.col("position") < hi), F.lit(g))
    return (
        values.withColumn("feature", name).filter(F.col("feature").isNotNull())
        .groupBy(*by, "feature").agg(F.sum("value").alias("importance"))
    )


def mean_importance(grouped: DataFrame) -> DataFrame:
    """Mean over folds, most important first."""
    return grouped.groupBy("feature").agg(F.avg("importance").alias("importance")).orderBy(
        F.col("importance").desc(), F.col("feature"))


def forest_importance(model: PipelineModel, layout: Layout, block: DataFrame) -> DataFrame:
    """Grouped impurity importances of a trained forest (one small vector from the model)."""
    vec = [float(v) for v in model.stages[-1].featureImportances.toArray()]
    one = block.sparkSession.createDataFrame([(vec,)], "importance array<double>")
    return group_importance(vector_table(one, []), layout)


def permutation_importance(model: PipelineModel, held_out: DataFrame, keys: Sequence[str],
                           n_features: int, seed: int = 1) -> DataFrame:
    """Drop in R2 when one feature is permuted: (position, value), value >= 0 and summing to 1.

    Every row meets one donor row (an exact random permutation of the
    held-out rows); feature j of the row is replaced by that of the donor for
    each j in turn, so all features are scored in one job and one shuffle.
    """
    base = held_out.select(*keys, "label", vector_to_array("features").alias("x"))
    a, b = shuffle_key(keys, seed), shuffle_key(keys, seed + 1)
    pairs = permute(base, ["x"], [a, *keys], [b, *keys])
    j = F.col("position")
    swapped = F.when(j < 0, F.col("x")).otherwise(
        F.transform("x", lambda v, i: F.when(i == j, F.get(F.col("x_perm"), i)).otherwise(v)))
    rows = pairs.withColumn(
        "position", F.explode(F.sequence(F.lit(-1), F.lit(n_features - 1)))
    ).select("position", "label", array_to_vector(swapped).alias("features"))
    scores = metrics(model.transform(rows), "label", "prediction", by=["position"])
    everything = Window.partitionBy(F.lit(0))  # spans n_features + 1 rows
    base_r2 = F.max(F.when(j < 0, F.col("r2"))).over(everything)
    drop = scores.withColumn("value", F.greatest(base_r2 - F.col("r2"), F.lit(0.0))).filter(j >= 0)
    share = ratio(F.col("value"), F.sum("value").over(everything))
    return drop.select("position", F.coalesce(share, F.lit(0.0)).alias("value"))


def donors(block: DataFrame, keys: Sequence[str], columns: Sequence[str], order_a: Sequence[Column],
           order_b: Sequence[Column], fold: str = "fold") -> DataFrame:
    """Give every row ``columns`` and keys of a donor row of its own fold, as ``<name>_perm``.

    Both orders begin with the fold, so equal global ranks lie in the same fold
    at the same place: one exact permutation per fold without a window per fold.
    """
    f = F.col(fold)
    return permute(block, [*columns, *keys], [f, *order_a], [f, *order_b])


def fold_importance(models: Sequence[PipelineModel], block: DataFrame, keys: Sequence[str], n_features: int,
                    order_a: Sequence[Column] | None = None, order_b: Sequence[Column] | None = None,
                    fold: str = "fold") -> DataFrame:
    """(fold, position, value): permutation importance of every fold for the model that did not see it.

    Value is the drop in R2 when the feature comes from a donor row, cut at 0
    and normalised per fold.  Rows are exploded over the features once and all
    folds meet in one aggregate by (fold, position).
    """
    a = order_a or [shuffle_key(keys, 1), *[F.col(k) for k in keys]]
    b = order_b or [shuffle_key(keys, 2), *[F.col(k) for k in keys]]
    base = block.select(*keys, fold, "label", vector_to_array("features").alias("x"))
    j = F.col("position")
    swapped = F.when(j < 0, F.col("x")).otherwise(
        F.transform("x", lambda v, i: F.when(i == j, F.get(F.col("x_perm"), i)).otherwise(v)))
    rows = donors(base, keys, ["x"], a, b, fold).withColumn(
        "position", F.explode(F.sequence(F.lit(-1), F.lit(n_features - 1)))
    ).select(fold, "position", "label", array_to_vector(swapped).alias("features"))
    scored = None
    for k, model in enumerate(models):
        part = model.transform(rows.filter(F.col(fold) == k)).select(fold, "position", "label", "prediction")
        scored = part if scored is None else scored.unionByName(part)
    scores = metrics(scored, "label", "prediction", by=[fold, "position"])
    whole = Window.partitionBy(fold)  # n_features + 1 rows of a fold
    base_r2 = F.max(F.when(j < 0, F.col("r2"))).over(whole)
    drop = scores.withColumn("value", F.greatest(base_r2 - F.col("r2"), F.lit(0.0))).filter(j >= 0)
    share = ratio(F.col("value"), F.sum("value").over(whole))
    return drop.select(fold, "position", F.coalesce(share, F.lit(0.0)).alias("value"))


#: How often a row is drawn into a bag: Poisson with mean 1, up to this many times.
MOST_DRAWS = 8
POISSON = [sum(math.exp(-1.0) / math.factorial(i) for i in range(n + 1)) for n in range(MOST_DRAWS)]


def bag_weight(keys: Sequence[str], tree: int | Column, seed: int = 0) -> Column:
    """How often a row is in the bag of a tree: a Poisson draw from a digest of seed, tree and key.

    The draw depends on nothing else, so a bag is the same in every rerun and
    no list of drawn rows is kept.
    """
    number = F.lit(tree) if isinstance(tree, int) else tree
    name = F.concat_ws("|", F.lit(f"bag-{seed}"), number.cast("string"), *[F.col(k).cast("string") for k in keys])
    u = F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)
    out = F.lit(MOST_DRAWS)
    for n in reversed(range(MOST_DRAWS)):
        out = F.when(u < POISSON[n], F.lit(n)).otherwise(out)
    return out.cast("double")


def fit_bags(block: DataFrame, s: ForestSettings, keys: Sequence[str], weighted: bool = False,
             parallelism: int = 3) -> list[PipelineModel]:
    """One tree per bag, trained on the rows drawn into it, each as often as it was drawn.

    A third of the features is tried at each split.  Trees are independent jobs
    over the staged block; ``parallelism`` of them run at once.
    """

    def one(tree: int) -> PipelineModel:
        w = bag_weight(keys, tree, s.seed) * (F.col("weight") if weighted else F.lit(1.0))
        drawn = block.withColumn("weight", w).filter("weight > 0")
        single = forest(replace(s, trees=1, seed=s.seed + tree), True)
        return Pipeline(stages=[single.setBootstrap(False).setFeatureSubsetStrategy("onethird")]).fit(drawn)

    with ThreadPool(parallelism) as pool:
        return pool.map(inheritable_thread_target(block.sparkSession)(one), range(s.trees))


def out_of_bag(block: DataFrame, models: Sequence[PipelineModel], keys: Sequence[str], seed: int,
               at_once: int = 50) -> DataFrame:
    """keys, label, n_bag (draws into all bags), n_oob (trees that never saw the row), prediction (their mean).

    The prediction is NULL for a row in every bag.  Trees score rows side by
    side, ``at_once`` per pass; one aggregate by row joins the passes.
    """
    parts = []
    for start in range(0, len(models), at_once):
        out, unseen, bag = block, [], F.lit(0.0)
        for i, model in enumerate(models[start:start + at_once]):
            out = model.transform(out).withColumnRenamed("prediction", f"_p{i}")
            drawn = bag_weight(keys, start + i, seed)
            bag = bag + drawn
            unseen.append(F.when(drawn == 0, F.col(f"_p{i}")))
        left = F.filter(F.array(*unseen), lambda p: p.isNotNull())
        parts.append(out.select(*keys, "label", bag.alias("n_bag"), F.size(left).alias("n_oob"),
                                F.aggregate(left, F.lit(0.0), lambda a, p: a + p).alias("_sum")))
    rows = functools.reduce(DataFrame.unionByName, parts)
    if len(parts) > 1:
        rows = rows.groupBy(*keys, "label").agg(*[F.sum(c).alias(c) for c in ("n_bag", "n_oob", "_sum")])
    return rows.select(*keys, "label", F.col("n_bag").cast("long").alias("n_bag"), F.col("n_oob").cast("long").alias("n_oob"),
                       ratio(F.col("_sum"), F.col("n_oob")).alias("prediction"))


def mean_baseline(block: DataFrame, fold: str = "fold") -> DataFrame:
    """(fold, n, mean_rmse): error of predicting each fold by the mean label of the other folds.

    Rows without a label count in ``n`` only.
    """
    f = block.groupBy(fold).agg(F.count(F.lit(1)).alias("n"), F.count("label").alias("_l"), F.sum("label").alias("_s"),
                                F.sum(F.col("label") * F.col("label")).alias("_q"))
    whole = Window.partitionBy(F.lit(0))  # one row per fold
    mean = ratio(F.sum("_s").over(whole) - F.col("_s"), F.sum("_l").over(whole) - F.col("_l"))
    f = f.withColumn("_m", mean)
    square = ratio(F.col("_q") - 2 * F.col("_m") * F.col("_s"), F.col("_l")) + F.col("_m") * F.col("_m")
    return f.withColumn("_e", square).select(
        fold, "n", F.sqrt(F.when(F.col("_e") < 0, 0.0).otherwise(F.col("_e"))).alias("mean_rmse"))


def evaluate(scored: DataFrame, label: str = "label", prediction: str = "prediction",
             by: Sequence[str] = ()) -> DataFrame:
    return metrics(scored, label, prediction, by)


def staged(block: DataFrame) -> DataFrame:
    """A training block written once.

    A forest reads its block once per tree level; without this every pass would
    rebuild the arrays from the hits.
    """
    return cut_lineage(block)
