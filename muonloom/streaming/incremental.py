"""Incremental booking of arriving run files and running hit summaries."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from muonloom.functions.edges import bin_index


def run_files(spark: SparkSession, path: str, schema: T.StructType,
              files_per_batch: int | None = None) -> DataFrame:
    """Stream of the rows of run files as they arrive in a folder."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def book_new_runs(stream: DataFrame, out: str, checkpoint: str,
                  transform: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Book every new file once, partitioned by run and batch.

    A run may arrive in any number of batches: each batch adds its own
    partitions beside those that are there.  A batch that is retried after a
    failure replaces exactly the partitions it had begun.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        (transform(batch).withColumn("batch", F.lit(batch_id).cast("long"))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("run", "batch").parquet(out))

    return (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def windowed_rate(stream: DataFrame, time: str, by: Sequence[str], window: str = "1 day",
                  late: str = "1 hour", weight: Column | None = None) -> DataFrame:
    """Hits per time window and group; late rows count until the watermark passes."""
    value = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return (
        stream.withWatermark(time, late)
        .groupBy(F.window(time, window).alias("window"), *by)
        .agg(value.alias("hits"))
        .select(F.col("window.start").alias("start"), *by, "hits")
    )


def windowed_hist(stream: DataFrame, time: str, x: Column, edges: Sequence[float],
                  window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Running histogram of a value per time window."""
    binned = stream.select(time, bin_index(x, edges).alias("bin")).filter(
        F.col("bin").isNotNull())
    return windowed_rate(binned, time, ["bin"], window, late)


def run_to_table(result: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append closed windows to a folder until the available input is used up."""
    return (result.writeStream.format("parquet").outputMode("append").option("path", out)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def closed_slices(stream: DataFrame, by: Sequence[str], stamp: str, time: str, length: str = "1 hour",
                  late: str = "1 hour") -> DataFrame:
    """Sorted times of each group in slices of event time, each slice once, when it is over.

    Slices wait for rows up to ``late`` behind the latest ``stamp``; rows later
    than that are dropped, as are rows without a stamp or time.  Slices, not
    groups, are the keys, so a hot group spreads over tasks and the state of a
    slice goes when it closes.  Choose ``length`` so that a slice of the busiest
    group is some 100,000 times.
    """
    return (
        stream.filter(F.col(time).isNotNull()).withWatermark(stamp, late)
        .groupBy(F.window(stamp, length).alias("_slice"), *by)
        .agg(F.sort_array(F.collect_list(F.col(time).cast("double"))).alias("times"))
        .select(*by, F.col("_slice.start").alias("slice"), "times")
    )


def gaps_within(slices: DataFrame, by: Sequence[str]) -> DataFrame:
    """Gaps between consecutive times of one slice: (by, time, gap, n).  Works on tables and streams."""
    later = F.slice("times", F.lit(2), F.size("times") - 1)
    pairs = F.transform(later, lambda t, i: F.struct(t.alias("time"), (t - F.get("times", i)).alias("gap")))
    return slices.select(*by, F.explode(pairs).alias("_p")).select(
        *by, "_p.time", "_p.gap", F.lit(1).cast("long").alias("n"))


def gaps_across(slices: DataFrame, by: Sequence[str]) -> DataFrame:
    """Gaps from the last time of a slice to the first of the group's next one, from a stream of slices.

    State is the last time of each group.  Slices close in the order of time,
    so those of a later batch come after those seen; one row per slice is read.
    """
    ends = slices.select(*by, "slice", F.get("times", F.lit(0)).alias("first"),
                         F.element_at("times", -1).alias("last"))
    keys = [ends.schema[c] for c in by]
    out = T.StructType([*keys, T.StructField("time", T.DoubleType()), T.StructField("gap", T.DoubleType()),
                        T.StructField("n", T.LongType())])

    def bridge(key, parts, state):
        rows = pd.concat(list(parts)).sort_values("slice")
        first, last = rows["first"].to_numpy(), rows["last"].to_numpy()
        before = np.concatenate([state.get if state.exists else (np.nan,), last[:-1]])
        state.update((float(last[-1]),))
        found = pd.DataFrame({**dict(zip(by, key)), "time": first, "gap": first - before, "n": 1})
        yield found[~np.isnan(before)]

    return ends.groupBy(*by).applyInPandasWithState(
        bridge, out, T.StructType([T.StructField("last", T.DoubleType())]), "append", GroupStateTimeout.NoTimeout)


def arriving_gaps(stream: DataFrame, by: Sequence[str], stamp: str, time: str, out: str, checkpoint: str,
                  length: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Gaps of all slices closed so far: (by, time, gap, n); equal times give gaps of 0.

    Runs over what has arrived since the last call with these folders and
    stops.  A call that fails is repeated by the next one: slices and bridges
    are written once each, by streams that go on from their checkpoints.
    """
    spark = stream.sparkSession
    for name in ("slices", "bridges"):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/{name}")
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).mkdirs(path)
    slices = closed_slices(stream, by, stamp, time, length, late)
    run_to_table(slices, f"{out}/slices", f"{checkpoint}/slices").awaitTermination()
    # a file may wait for any time: none is too old
    closed = spark.readStream.schema(slices.schema).option("maxFileAge", "36500d").parquet(f"{out}/slices")
    bridges = gaps_across(closed, by)
    run_to_table(bridges, f"{out}/bridges", f"{checkpoint}/bridges").awaitTermination()
    written = spark.read.schema(slices.schema).parquet(f"{out}/slices")
    return gaps_within(written, by).unionByName(spark.read.schema(bridges.schema).parquet(f"{out}/bridges"))
