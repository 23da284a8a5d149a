"""Reading run files: many files to one table, with provenance and completeness checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from muonloom.schema import RUN_DIM
from muonloom.sources.constants import DATASET_PARTICLE, PDG


def book(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType) -> DataFrame:
    """All run files matching the given globs as one table.

    The schema is given, so no file is opened for inference; columns a file
    lacks come back as NULL.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.schema(schema).parquet(*paths)


SPECTRUM = T.StructType([
    T.StructField("name", T.StringType()),
    *[T.StructField(n, T.DoubleType())
      for n in ("log_energy", "flux", "err", "sys_low", "sys_high")],
])


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The run list with livetime, overburden and temperature."""
    return spark.read.schema(RUN_DIM).parquet(path)


def read_spectra(spark: SparkSession, path: str) -> DataFrame:
    """Published spectra with errors as (name, log_energy, flux, err, sys_low, sys_high)."""
    return spark.read.schema(SPECTRUM).option("header", True).csv(path)


def select_complete(df: DataFrame, manifest: DataFrame, required: Sequence[str],
                    key: str = "run") -> DataFrame:
    """Rows of the runs that have every required table.

    ``manifest``: one row per (run, table).  The complete runs are a run list,
    far smaller than the rows they select.
    """
    has = (
        manifest.filter(F.col("table").isin(*required))
        .groupBy(key).agg(F.count_distinct("table").alias("_k"))
        .filter(F.col("_k") == len(set(required)))
    )
    return df.join(has.select(key), key, "left_semi")


def incomplete_runs(runs: DataFrame, present: DataFrame, key: str = "run") -> DataFrame:
    """Runs without the required data.  They are reported, never deleted."""
    return runs.select(key).distinct().join(present.select(key).distinct(), key, "left_anti")


def missing_columns(df: DataFrame, columns: Sequence[str], key: str = "run") -> DataFrame:
    """Per run, how many rows lack each of the columns."""
    return df.groupBy(key).agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])


def run_of(path: Column) -> Column:
    """Run number in a file name such as Run00128290_..."""
    return F.regexp_extract(path, r"Run0*(\d+)", 1).cast("int")


def dataset_of(path: Column) -> Column:
    """Five- or four-digit simulation dataset number in a file name."""
    numbers = "|".join(sorted(DATASET_PARTICLE, key=len, reverse=True))
    return F.regexp_extract(path, rf"({numbers})", 1)


def particle_of(dataset: Column) -> Column:
    """Particle simulated in a dataset; NULL for an unknown number."""
    pairs = [F.lit(x) for kv in DATASET_PARTICLE.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), dataset)


def pdg_of(particle: Column) -> Column:
    pairs = [x for k, v in PDG.items() for x in (F.lit(k), F.lit(v).cast("long"))]
    return F.try_element_at(F.create_map(*pairs), particle)


def with_provenance(df: DataFrame, path: Column | None = None) -> DataFrame:
    """Add dataset, particle and pdg code from the file each row came from."""
    p = F.col("_metadata.file_path") if path is None else path
    return (
        df.withColumn("dataset", dataset_of(p))
        .withColumn("particle", particle_of(F.col("dataset")))
        .withColumn("pdg", pdg_of(F.col("particle")))
    )


def runs_ending_in(df: DataFrame, digit: int = 0, run: str = "run") -> DataFrame:
    """The sample of runs whose number ends in a digit; prunes folders partitioned by run."""
    return df.filter(F.col(run) % 10 == digit)


def ragged_slice(pulses: DataFrame, index: DataFrame, file: Sequence[str] = ("run",),
                 position: str = "pos", block: int = 4096) -> DataFrame:
    """Give every pulse row the event that owns its position.

    ``index``: (file..., event_id, start, stop) with half-open ranges that do
    not overlap; ``pulses``: (file..., pos, ...).  Both sides get a block number
    of ``block`` positions, a range appearing once per block it touches, so the
    range test becomes an equi-join that stays balanced inside one large file.
    """
    ranges = index.filter(F.col("stop") > F.col("start")).withColumn(
        "_block",
        F.explode(F.sequence(F.floor(F.col("start") / block),
                             F.floor((F.col("stop") - 1) / block))))
    rows = pulses.withColumn("_block", F.floor(F.col(position) / block))
    inside = (F.col(position) >= F.col("start")) & (F.col(position) < F.col("stop"))
    return rows.join(ranges, [*file, "_block"]).filter(inside).drop("_block", "start", "stop")


def nested_slices(pulses: DataFrame, index: DataFrame, file: Sequence[str] = ("run",)) -> DataFrame:
    """As ragged_slice for files read as one array column: positions come from posexplode."""
    rest = [c for c in pulses.columns if c != "pulses"]
    flat = pulses.select(*rest, F.posexplode("pulses").alias("pos", "pulse"))
    return ragged_slice(flat, index, file).select("*", "pulse.*").drop("pulse")


def selected_runs(events: DataFrame, runs: DataFrame, condition: Column, run: str = "run") -> DataFrame:
    """Events of the runs that meet a condition on the run table, with the run's columns.

    ``events`` is read from folders partitioned by run (``sinks.write_events``).
    Which runs are wanted is known only once the run table has been filtered;
    the join then hands the run numbers to the scan, which opens their folders
    only.  The run list carries no hint: Spark decides by its size, and prunes
    where it broadcasts the list or the pruning pays off by itself.
    """
    return events.join(runs.filter(condition), run)
