"""Exact global ranks without moving every row to one task, and splits built on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from muonloom.session import cut_lineage

ROWS_PER_BUCKET = 1_000_000


def quantile_bucket(df: DataFrame, col: str, buckets: int) -> Column:
    """Bucket number that grows with ``col`` and holds about the same number of rows each.

    The boundaries are approximate quantiles (``buckets`` numbers on the
    driver), found by a job over the key column alone.  Meant for keys that are
    (nearly) unique; the caller takes as many buckets as its rows ask for.
    """
    bounds = df.approxQuantile(col, [i / buckets for i in range(1, buckets)], 0.25 / buckets)
    bounds = sorted(set(bounds))

    def pick(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(col) < F.lit(bounds[mid]), pick(lo, mid)).otherwise(pick(mid + 1, hi))

    return pick(0, len(bounds))


def with_rank(df: DataFrame, order: Sequence[Column], rank: str = "rank", total: str = "total",
              rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Add the 1-based global rank and the row count.

    Rows are range-partitioned on the whole order, ties broken by its later
    columns, into as many buckets as their number asks for, and written with
    their bucket.  Ranks are counted inside buckets in parallel and shifted by
    the rows of earlier buckets; the only single-task step handles one row per
    bucket.
    """
    buckets = max(1, -(-df.count() // rows_per_bucket))
    tagged = cut_lineage(df.repartitionByRange(buckets, *order)
                         .withColumn("_bucket", F.spark_partition_id()))
    sizes = tagged.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    running = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = sizes.select(
        "_bucket",
        F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_before"),
        F.sum("_n").over(whole).alias(total),
    )
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order))
    return (
        tagged.withColumn("_inside", inside)
        .join(offsets, "_bucket")
        .withColumn(rank, (F.col("_inside") + F.col("_before")).cast("long"))
        .drop("_bucket", "_inside", "_before")
    )


def shuffle_key(keys: Sequence[str], seed: int) -> Column:
    """Reproducible random order of rows: a hash of the key and a seed."""
    return F.xxhash64(*[F.col(k) for k in keys], F.lit(seed))


def contiguous_folds(df: DataFrame, key: str, k: int = 3, fold: str = "fold",
                     rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """k contiguous folds in key order, 0-based; the first n mod k folds get one row more."""
    ranked = with_rank(df, [F.col(key)], "_r", "_t", rows_per_bucket)
    size = F.floor(F.col("_t") / k)
    extra = F.col("_t") % k
    edge = extra * (size + 1)
    r0 = F.col("_r") - 1
    number = F.when(r0 < edge, F.floor(r0 / (size + 1))).otherwise(
        extra + F.floor(F.try_divide(r0 - edge, size)))
    return ranked.withColumn(fold, number.cast("int")).drop("_r", "_t")


def hashed_folds(df: DataFrame, keys: Sequence[str], k: int = 3, seed: int = 1,
                 fold: str = "fold") -> DataFrame:
    """k random folds by a hash of the key: no shuffle, the default at scale."""
    return df.withColumn(fold, F.pmod(shuffle_key(keys, seed), F.lit(k)).cast("int"))


def split_half(df: DataFrame, order: Sequence[Column], half: str = "half",
               rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Exact halves in a shuffled order: floor(n/2) rows in half 1, the rest in half 2."""
    ranked = with_rank(df, order, "_r", "_t", rows_per_bucket)
    return ranked.withColumn(
        half, F.when(F.col("_r") <= F.floor(F.col("_t") / 2), F.lit(1)).otherwise(F.lit(2))
    ).drop("_r", "_t")


def permute(df: DataFrame, columns: Sequence[str], order_a: Sequence[Column],
            order_b: Sequence[Column], suffix: str = "_perm",
            rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Give every row the ``columns`` of another row: rank in order a meets rank in order b."""
    left = with_rank(df, order_a, "_r", "_t", rows_per_bucket).drop("_t")
    right = with_rank(df, order_b, "_r", "_t", rows_per_bucket).select(
        "_r", *[F.col(c).alias(c + suffix) for c in columns])
    return left.join(right, "_r").drop("_r")
