"""Columns of events in folders of equal buckets, so that joining them moves no rows."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, types as T


def write_aligned(df: DataFrame, path: str, keys: Sequence[str], buckets: int, in_place: bool = False) -> str:
    """Write one row per event in ``buckets`` buckets of the keys; returns the folder of the files.

    Rows are shuffled once, so that each bucket is one file.  ``in_place`` leaves
    that out: for rows that come from a join of tables in the same buckets.
    Choose buckets of 100-200 MB.  Rows without a key all go to one bucket.
    """
    name = f"aligned_{uuid.uuid4().hex}"
    where = f"{path.rstrip('/')}/buckets-{buckets}"
    rows = df if in_place else df.repartition(buckets, *keys)
    writer = rows.write.format("parquet").mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys)
    writer.option("path", where).saveAsTable(name)
    df.sparkSession.sql(f"DROP TABLE {name}")  # forgets the name; the files stay
    return where


def read_aligned(spark: SparkSession, where: str, keys: Sequence[str], schema: T.StructType | None = None) -> DataFrame:
    """A folder that ``write_aligned`` returned, in any session; its name tells the number of buckets.

    Give the schema of a table that may be empty: it has no files to tell it.
    """
    buckets = int(where.rpartition("buckets-")[2])
    name, by = f"aligned_{uuid.uuid4().hex}", ", ".join(f"`{k}`" for k in keys)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema or spark.read.parquet(where).schema)
    spark.sql(f"CREATE TABLE {name} ({fields}) USING parquet CLUSTERED BY ({by}) INTO {buckets} BUCKETS "
              f"LOCATION '{where}'")
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return found


def aligned_join(first: DataFrame, *others: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The first table with the columns of the others; null where they have no row.

    No rows are exchanged between tables of equal buckets.  A table in other
    buckets joins right as well, through an exchange that Spark adds.
    """
    for other in others:
        first = first.join(other.hint("merge"), list(keys), "left")
    return first


def write_back(spark: SparkSession, where: str, values: DataFrame, path: str, keys: Sequence[str],
               schema: T.StructType | None = None) -> str:
    """Write a stored table with more columns, in its own buckets: only ``values`` may be shuffled."""
    stored = read_aligned(spark, where, keys, schema)
    clash = (set(values.columns) & set(stored.columns)) - set(keys)
    if clash:
        raise ValueError(f"columns that the table has already: {sorted(clash)}")
    buckets = int(where.rpartition("buckets-")[2])
    return write_aligned(aligned_join(stored, values, keys=keys), path, keys, buckets, in_place=True)
