"""Session helpers."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "muonloom") -> SparkSession:
    """A local session for tests and the benchmark.  On a cluster use spark-submit."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # larger generated methods are never compiled by the JVM; split them instead
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: the one named in ``spark.checkpoint.dir``.

    The setting is only read, never changed.  Where it is unset, a local master
    gets a temporary folder (one per application); on a cluster that would be
    lost together with its executor, so there the setting must be given.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return _LOCAL.setdefault(context.applicationId, tempfile.mkdtemp(prefix="muonloom-"))


def write_table(df: DataFrame, partition: Sequence[str] = ()) -> str:
    """Write a table to the shared folder, in folders by ``partition``; returns its path.

    Tables are removed with ``drop_table``, or when the program ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    (df.write.partitionBy(*partition) if partition else df.write).parquet(path)
    _WRITTEN.setdefault(path, spark)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and go on from the written one.

    What follows survives lost executors without recomputing what came before,
    and, other than a checkpointed RDD, a later step reads only the columns it
    needs and the planner knows the size.
    """
    return df.sparkSession.read.schema(df.schema).parquet(write_table(df))


_WRITTEN: dict[str, SparkSession] = {}


def drop_table(df: DataFrame) -> None:
    """Remove a table made by ``cut_lineage`` that no later step reads."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        found = next((p for p in _WRITTEN if p.rpartition("/")[2] == path.rpartition("/")[2]), None)
        if found:
            _remove(found, _WRITTEN.pop(found))


def _remove(path: str, spark: SparkSession) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for path, spark in _WRITTEN.items():
        if spark.sparkContext._jsc is None:  # stopped
            break
        _remove(path, spark)
