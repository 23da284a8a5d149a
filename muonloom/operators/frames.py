"""Filter decisions on event and sub-event records: masks, prescales, keep lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def parent_masks(flags: DataFrame, keys: Sequence[str], name: str = "filter",
                 passed: str = "passed") -> DataFrame:
    """OR of every filter over the sub-events of an event: one row per (event, filter)."""
    return flags.groupBy(*keys, name).agg(F.bool_or(passed).alias(passed))


def passed_filters(flags: DataFrame, keys: Sequence[str], name: str = "filter",
                   passed: str = "passed") -> DataFrame:
    """The set of filters an event passed; its size is bounded by the number of filters."""
    return flags.groupBy(*keys).agg(
        F.sort_array(F.collect_set(F.when(F.col(passed), F.col(name)))).alias("filters"))


def passed_any(filters: Column, names: Sequence[str]) -> Column:
    return F.arrays_overlap(filters, F.array(*[F.lit(n) for n in names]))


def keep_columns(df: DataFrame, keep: Sequence[str], when: Column,
                 always: Sequence[str] = ()) -> DataFrame:
    """Where ``when`` holds, blank every column outside the keep list."""
    stay = {*keep, *always}
    return df.withColumns({
        c: F.when(when, F.lit(None)).otherwise(F.col(c)) for c in df.columns if c not in stay})


def drop_raw(df: DataFrame, raw: Sequence[str], passed: Column, trimmed: Column) -> DataFrame:
    """Blank the raw-data columns unless the event passed or was flagged by the trimmer."""
    keep = F.coalesce(passed, F.lit(False)) | F.coalesce(trimmed, F.lit(False))
    return df.withColumns({c: F.when(keep, F.col(c)) for c in raw})


def keep_decision(any_filter: Column, archive: Column) -> Column:
    """What stays of an event: 'all', 'archive' or 'summary'.

    An event that passed any filter keeps all; else one that passed an archive
    filter keeps the archive; else only the summary stays.  With a missing
    flag nothing is removed at the step that needs it.
    """
    return (
        F.when(any_filter, F.lit("all"))
        .when(any_filter.isNull(), F.lit("all"))
        .when(archive.isNull() | archive, F.lit("archive"))
        .otherwise(F.lit("summary"))
    )


def prescale(df: DataFrame, factors: Mapping[str, int], name: str = "filter",
             key: Column | None = None, seed: int = 1,
             override: Mapping[str, int] | None = None) -> DataFrame:
    """Keep one in N of the rows of each filter, chosen by a reproducible hash of the key.

    Filters without a factor are kept whole.
    """
    table = {**factors, **(override or {})}
    n = F.lit(1)
    for f, k in table.items():
        n = F.when(F.col(name) == f, F.lit(int(k))).otherwise(n)
    draw = F.xxhash64("event_id", F.lit(seed)) if key is None else key
    return df.filter(F.pmod(draw, n) == 0)


def has_frame(column: str) -> Column:
    return F.col(column).isNotNull()


def only_stream(df: DataFrame, stream: str, column: str = "stop") -> DataFrame:
    """Drop records of every other type."""
    return df.filter(F.col(column) == stream)
