"""Weighted histograms as one aggregate each.

Rows shrink to (group, bin) partial sums on the map side, so the shuffle
carries bins and not events, however the events are distributed over bins.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from muonloom.functions.edges import bin_index, edge_at
from muonloom.functions.guards import ratio, ratio_error


def fill_bins(binned: DataFrame, by: Sequence[str], n_bins: int,
              values: Sequence[str]) -> DataFrame:
    """Add the empty bins of every group with zeros.

    Works on a finished histogram: a group packs its at most ``n_bins`` rows
    into a map and unpacks all bins, so nothing is joined.
    """
    packed = binned.groupBy(*by).agg(
        F.map_from_entries(F.collect_list(
            F.struct(F.col("bin"), F.struct(*values)))).alias("_m"))
    rows = packed.select(*by, "_m", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"))
    cell = F.try_element_at(F.col("_m"), F.col("bin"))
    return rows.select(*by, "bin", *[F.coalesce(cell[v], F.lit(0)).alias(v) for v in values])


def hist1d(df: DataFrame, x: Column, edges: Sequence[float], weight: Column | None = None,
           by: Sequence[str] = (), fill: bool = True) -> DataFrame:
    """(by..., bin, lo, hi, sum_w, err, n); out-of-range values are dropped."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    binned = (
        df.select(*by, bin_index(x, edges).alias("bin"), w.alias("_w"))
        .filter(F.col("bin").isNotNull())
        .groupBy(*by, "bin")
        .agg(F.sum("_w").alias("sum_w"), F.sum(F.col("_w") * F.col("_w")).alias("sum_w2"),
             F.count(F.lit(1)).alias("n"))
    )
    if fill:
        binned = fill_bins(binned, by, len(edges) - 1, ["sum_w", "sum_w2", "n"])
    return binned.select(
        *by, "bin", edge_at(edges, F.col("bin")).alias("lo"),
        edge_at(edges, F.col("bin") + 1).alias("hi"),
        "sum_w", F.sqrt("sum_w2").alias("err"), "n")


def hist2d(df: DataFrame, x: Column, y: Column, edges_x: Sequence[float],
           edges_y: Sequence[float], weight: Column | None = None,
           by: Sequence[str] = ()) -> DataFrame:
    """(by..., bin_x, bin_y, sum_w, sum_w2, n) of the filled cells."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    return (
        df.select(*by, bin_index(x, edges_x).alias("bin_x"),
                  bin_index(y, edges_y).alias("bin_y"), w.alias("_w"))
        .filter(F.col("bin_x").isNotNull() & F.col("bin_y").isNotNull())
        .groupBy(*by, "bin_x", "bin_y")
        .agg(F.sum("_w").alias("sum_w"), F.sum(F.col("_w") * F.col("_w")).alias("sum_w2"),
             F.count(F.lit(1)).alias("n"))
    )


Variables = Mapping[str, tuple[Column, Sequence[float]]]


def _names(names: Sequence[str], number: str) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), F.col(number) + 1)


def hist_many(df: DataFrame, variables: Variables, weight: Column | None = None,
              by: Sequence[str] = (), arrays: Variables | None = None) -> DataFrame:
    """Histograms of many variables in one pass: (by..., var, bin, lo, hi, sum_w, err, n).

    ``arrays`` are variables with an array of values per row, all of the row's
    weight; null values are left out.  Each row is binned in every variable
    first, arrays inside the array, and only then spread to pairs of a variable's
    number and bin, which combine before the shuffle.  Names and edges are
    attached to the finished bins.
    """
    every = {**variables, **(arrays or {})}
    number = {v: F.lit(i) for i, v in enumerate(every)}
    w = F.lit(1.0) if weight is None else weight.cast("double")
    cell = lambda v, x, e: F.struct(number[v].alias("number"), bin_index(x, e).cast("int").alias("bin"))
    cells = F.array(*[cell(v, x, e) for v, (x, e) in variables.items()])
    inside = lambda v, e: lambda value: cell(v, value, e)
    none = F.array().cast("array<struct<number:int,bin:int>>")
    for v, (x, e) in (arrays or {}).items():
        slots = F.transform(F.filter(x, lambda value: value.isNotNull()), inside(v, e))
        cells = F.concat(cells, F.coalesce(slots, none))
    summed = (
        df.select(*by, w.alias("_w"), F.inline(cells))
        .filter(F.col("bin").isNotNull())
        .groupBy(*by, "number", "bin")
        .agg(F.sum("_w").alias("sum_w"), F.sum(F.col("_w") * F.col("_w")).alias("_w2"),
             F.count(F.lit(1)).alias("n"))
    )
    edges = F.array(*[F.array(*[F.lit(float(b)) for b in e]) for _, e in every.values()])
    at = lambda i: F.element_at(F.element_at(edges, F.col("number") + 1), (i + 1).cast("int"))
    return summed.select(
        *by, _names(list(every), "number").alias("var"), "bin", at(F.col("bin")).alias("lo"),
        at(F.col("bin") + 1).alias("hi"), "sum_w", F.sqrt("_w2").alias("err"), "n")


def hist2d_pairs(df: DataFrame, variables: Variables, weight: Column | None = None,
                 by: Sequence[str] = ()) -> DataFrame:
    """2-D histograms of every pair of variables in one pass."""
    names = list(variables)
    w = F.lit(1.0) if weight is None else weight.cast("double")
    binned = df.select(
        *by, w.alias("_w"),
        *[bin_index(x, e).alias(f"_b_{v}") for v, (x, e) in variables.items()])
    both = [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]
    pairs = F.array(*[
        F.struct(F.lit(i).alias("pair"), F.col(f"_b_{a}").alias("bin_x"), F.col(f"_b_{b}").alias("bin_y"))
        for i, (a, b) in enumerate(both)
    ])
    return (
        binned.select(*by, "_w", F.inline(pairs))
        .filter(F.col("bin_x").isNotNull() & F.col("bin_y").isNotNull())
        .groupBy(*by, "pair", "bin_x", "bin_y")
        .agg(F.sum("_w").alias("sum_w"), F.sum(F.col("_w") * F.col("_w")).alias("sum_w2"),
             F.count(F.lit(1)).alias("n"))
        .withColumns({"var_x": _names([a for a, _ in both], "pair"),
                      "var_y": _names([b for _, b in both], "pair")}).drop("pair")
    )


def hist_pulses(pulses: DataFrame, weights: DataFrame, edges: Sequence[float],
                keys: Sequence[str], weight: str = "weight", value: str = "charge") -> DataFrame:
    """Charge histogram of hits with the weight of their event.

    Hits are first counted per (event, bin), so the join to the weights never
    sees more rows per event than there are bins.
    """
    q = F.nanvl(F.col(value), F.lit(0.0))
    counts = (
        pulses.select(*keys, bin_index(q, edges).alias("bin"))
        .filter(F.col("bin").isNotNull())
        .groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("_n"))
    )
    w = F.col(weight)
    return (
        counts.join(weights.select(*keys, weight), list(keys))
        .groupBy("bin")
        .agg(F.sum(w * F.col("_n")).alias("sum_w"),
             F.sqrt(F.sum(w * w * F.col("_n"))).alias("err"), F.sum("_n").alias("n"))
        .select("bin", edge_at(edges, F.col("bin")).alias("lo"),
                edge_at(edges, F.col("bin") + 1).alias("hi"), "sum_w", "err", "n")
    )


def hist_gaps(gaps: DataFrame, edges: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Histogram of gaps that carry a multiplicity ``n``."""
    return (
        gaps.select(*by, bin_index(F.col("gap"), edges).alias("bin"), "n")
        .filter(F.col("bin").isNotNull())
        .groupBy(*by, "bin").agg(F.sum("n").alias("n"))
        .select(*by, "bin", edge_at(edges, F.col("bin")).alias("lo"), "n")
    )


def normalise(hist: DataFrame, by: Sequence[str]) -> DataFrame:
    """Divide sum_w and err by the group total; windows here span bins, not events."""
    total = F.sum("sum_w").over(Window.partitionBy(*by))
    return hist.withColumns({"norm": ratio(F.col("sum_w"), total),
                             "norm_err": ratio(F.col("err"), total)})


def compare(data: DataFrame, mc: DataFrame, on: Sequence[str]) -> DataFrame:
    """Ratio of two normalised histograms per bin, with error; bins of either side stay."""
    d = data.select(*on, F.col("norm").alias("data"), F.col("norm_err").alias("data_err"))
    m = mc.select(*on, F.col("norm").alias("mc"), F.col("norm_err").alias("mc_err"))
    args = [F.col(c) for c in ("data", "mc", "data_err", "mc_err")]
    return d.join(m, list(on), "full").withColumns({
        "ratio": ratio(args[0], args[1]), "ratio_err": ratio_error(*args)})


def compare_samples(hist: DataFrame, on: Sequence[str], sample: str,
                    names: tuple[str, str] = ("data", "mc")) -> DataFrame:
    """As ``compare`` for two samples of one histogram table, without reading it twice."""
    pick = lambda s, c: F.max(F.when(F.col(sample) == s, F.col(c)))
    wide = hist.groupBy(*on).agg(
        pick(names[0], "norm").alias("data"), pick(names[0], "norm_err").alias("data_err"),
        pick(names[1], "norm").alias("mc"), pick(names[1], "norm_err").alias("mc_err"))
    args = [F.col(c) for c in ("data", "mc", "data_err", "mc_err")]
    return wide.withColumns({"ratio": ratio(args[0], args[1]), "ratio_err": ratio_error(*args)})


def absolute_difference(cells: DataFrame, on: Sequence[str], sample: str,
                        names: tuple[str, str] = ("data", "mc")) -> DataFrame:
    """|a - b| of the sums of two samples per cell, a missing cell counting as 0."""
    pick = lambda s: F.coalesce(F.max(F.when(F.col(sample) == s, F.col("sum_w"))), F.lit(0.0))
    return cells.groupBy(*on).agg(F.abs(pick(names[0]) - pick(names[1])).alias("difference"))


def weighted_spread(df: DataFrame, by: Sequence[str], value: Column, weight: Column,
                    more_than: int = 5) -> DataFrame:
    """Weighted mean and standard deviation (divided by the sum of weights) per group.

    Moments are taken around the middle of the group's values, found by a first
    aggregate, so a spread far smaller than the values keeps its digits.  Both
    aggregates combine on the map side.  Groups with ``more_than`` rows or fewer
    are dropped.
    """
    rows = df.select(*by, value.cast("double").alias("_v"), weight.cast("double").alias("_w"))
    middle = rows.groupBy(*by).agg(((F.min("_v") + F.max("_v")) / 2).alias("_c"))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by]
    moved = rows.alias("l").join(middle.alias("r"), same)
    v = F.col("_v") - F.col("_c")
    m = moved.groupBy(*[F.col(f"l.{c}").alias(c) for c in by]).agg(
        F.count(F.lit(1)).alias("n"), F.first("_c").alias("_c"), F.sum("_w").alias("_s0"),
        F.sum(F.col("_w") * v).alias("_s1"), F.sum(F.col("_w") * v * v).alias("_s2"))
    mean = ratio(F.col("_s1"), F.col("_s0"))
    var = ratio(F.col("_s2"), F.col("_s0")) - mean * mean
    return m.filter(F.col("n") > more_than).select(
        *by, "n", (F.col("_c") + mean).alias("mean"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("sigma"))


def resolution(df: DataFrame, log_energy: Column, residual: Column, weight: Column,
               edges: Sequence[float], more_than: int = 5) -> DataFrame:
    """Spread of a residual per true-energy bin (every bin half open, as published)."""
    inside = df.select(
        F.when(log_energy < F.lit(edges[-1]), bin_index(log_energy, edges)).alias("bin"),
        residual.alias("_r"), weight.alias("_wt"),
    ).filter(F.col("bin").isNotNull())
    out = weighted_spread(inside, ["bin"], F.col("_r"), F.col("_wt"), more_than)
    mid = (edge_at(edges, F.col("bin")) + edge_at(edges, F.col("bin") + 1)) * 0.5
    return out.select("bin", mid.alias("log_energy"), "n", "mean", "sigma")


def metrics(df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows, RMSE and R2 of predictions; the variance is a centred, mergeable moment."""
    miss = F.col(label) - F.col(prediction)
    m = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(miss * miss).alias("_sse"),
        F.var_pop(label).alias("_var"))
    return m.select(
        *by, "n", F.sqrt(F.col("_sse") / F.col("n")).alias("rmse"),
        (1.0 - ratio(F.col("_sse"), F.col("_var") * F.col("n"))).alias("r2"))
