"""Writing results: replace by name, sibling columns, summaries and models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Model, PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F


def write_events(df: DataFrame, path: str, partition: Sequence[str] = ("run",)) -> None:
    """Booked events partitioned by run.  A run written again replaces itself only."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partition).parquet(path))


def put_quantity(df: DataFrame, path: str, name: str, column: str = "quantity") -> None:
    """Replace one named quantity of a store and leave the others alone."""
    (df.withColumn(column, F.lit(name)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path))


def get_quantity(spark: SparkSession, path: str, name: str, column: str = "quantity") -> DataFrame:
    """One named quantity; reads its folder only."""
    return spark.read.parquet(path).filter(F.col(column) == name).drop(column)


def write_summary(df: DataFrame, path: str) -> None:
    """A small summary table as a single file."""
    df.coalesce(1).write.mode("overwrite").parquet(path)


def attach_column(events: DataFrame, values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add derived columns by key; events without a value get NULL."""
    return events.join(values, list(keys), "left")


def write_sibling(values: DataFrame, root: str, name: str) -> str:
    """Store a derived column next to its events instead of rewriting them."""
    path = f"{root.rstrip('/')}/{name}"
    values.write.mode("overwrite").parquet(path)
    return path


def save_model(model: Model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
