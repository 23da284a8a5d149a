"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

ROWS_PER_TASK = 2_000_000  # a key with more rows than this is split


def key_counts(facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per key, as column ``_n``; counts combine on the map side and read key columns only."""
    return facts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))


def salted_join(facts: DataFrame, dim: DataFrame, keys: Sequence[str], how: str = "inner",
                counts: DataFrame | None = None, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Equi-join of a fact table with a table that is small per key.

    Rows of a hot key spread over as many parts as its size asks for and the
    matching dim rows are copied to each part; every other key joins as usual.
    Results are those of the plain join.  ``counts`` (keys and ``_n``) is given
    where an aggregate over the keys exists anyway, else rows are counted here.
    The list of hot keys is broadcast: it has at most one key per
    ``rows_per_task`` rows.  Only inner and left joins make sense here.
    """
    if how not in ("inner", "left"):
        raise ValueError("salted_join supports inner and left joins")
    keys = list(keys)
    counts = key_counts(facts, keys) if counts is None else counts
    hot = F.broadcast(counts.filter(F.col("_n") > rows_per_task).select(
        *keys, F.ceil(F.col("_n") / rows_per_task).cast("int").alias("_parts")))
    part = F.pmod(F.xxhash64(*[F.col(c) for c in facts.columns]), F.col("_parts")).cast("int")
    left = (
        facts.join(hot, keys, "left")
        .withColumn("_salt", F.coalesce(part, F.lit(0))).drop("_parts")
    )
    copies = F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1)
    right = dim.join(hot, keys, "left").withColumn("_salt", F.explode(copies)).drop("_parts")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def mark(facts: DataFrame, marks: DataFrame, keys: Sequence[str], name: str,
         rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Facts with a column ``name``: TRUE where ``marks`` has their key, else NULL.

    ``marks`` is a written table with one row per key and ``_n``, the number of
    facts that have it.  Spark knows its size and broadcasts it if it is small,
    so that the facts stay where they are; else hot keys are salted.
    """
    keys = list(keys)
    marks = marks.select(*keys, F.ceil(F.col("_n") / rows_per_task).cast("int").alias("_parts"))
    hot = F.broadcast(marks.filter(F.col("_parts") > 1))
    part = F.pmod(F.xxhash64(*[F.col(c) for c in facts.columns]), F.col("_parts")).cast("int")
    left = facts.join(hot, keys, "left").withColumn("_salt", F.coalesce(part, F.lit(0))).drop("_parts")
    right = marks.select(*keys, F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_salt"),
                         F.lit(True).alias(name))
    return left.join(right, [*keys, "_salt"], "left").drop("_salt")
