"""Table schemas and the rename map used while booking."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

N_SLOTS = 35  # width of every per-event array

PULSE = T.StructType([
    T.StructField("run", T.IntegerType()),
    T.StructField("event_id", T.LongType()),
    T.StructField("station", T.IntegerType()),
    T.StructField("om", T.IntegerType()),
    T.StructField("time", T.DoubleType()),
    T.StructField("charge", T.DoubleType()),
])

TANK = T.StructType([
    T.StructField("station", T.IntegerType()),
    T.StructField("tank", T.StringType()),
    T.StructField("tank_index", T.IntegerType()),
    T.StructField("x", T.DoubleType()),
    T.StructField("y", T.DoubleType()),
    T.StructField("z", T.DoubleType()),
])

EVENT = T.StructType([
    T.StructField("run", T.IntegerType()),
    T.StructField("event_id", T.LongType()),
    T.StructField("filt", T.BooleanType()),
    T.StructField("loud_sta", T.BooleanType()),
    T.StructField("cog", T.StructType([
        T.StructField("x", T.DoubleType()),
        T.StructField("y", T.DoubleType()),
        T.StructField("time", T.DoubleType()),
    ])),
    T.StructField("plane", T.StructType([
        T.StructField("zenith", T.DoubleType()),
        T.StructField("azimuth", T.DoubleType()),
    ])),
    *[T.StructField(n, T.DoubleType())
      for n in ("qmax", "qhillas", "qtotal", "qtotalhlc")],
    *[T.StructField(n, T.IntegerType()) for n in ("nsta", "nslc", "ntanks")],
])

RUN_DIM = T.StructType([
    T.StructField("run", T.IntegerType()),
    T.StructField("duration", T.DoubleType()),
    T.StructField("overburden", T.DoubleType()),
    T.StructField("temperature", T.DoubleType()),
])

# Booked column names differ between production variants.
RENAMES = {
    "Plane_Zenith": "plane_zenith",
    "PlaneZenith": "plane_zenith",
    "Plane_Azimuth": "plane_azimuth",
    "PlaneAzimuth": "plane_azimuth",
    "COGX": "cogx",
    "COGY": "cogy",
    "T0": "t0",
    "Qmax": "qmax",
    "Qhillas": "qhillas",
    "Qtotal": "qtotal",
    "Qtotalhlc": "qtotalhlc",
    "Nsta": "nsta",
    "Nslc": "nslc",
    "Ntanks": "ntanks",
    "FiltCondt": "filt",
    "LoudSta": "loud_sta",
}


def rename_variants(df: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """Map variant column names to the booked ones; absent names are ignored."""
    return df.withColumnsRenamed(RENAMES if names is None else names)


def flatten_event(df: DataFrame) -> DataFrame:
    """Nested event columns to flat ones; the scan reads only the leaves used."""
    return df.select(
        "run", "event_id", "filt", "loud_sta",
        F.col("cog.x").alias("cogx"), F.col("cog.y").alias("cogy"),
        F.col("cog.time").alias("t0"),
        F.col("plane.zenith").alias("plane_zenith"),
        F.col("plane.azimuth").alias("plane_azimuth"),
        "qmax", "qhillas", "qtotal", "qtotalhlc", "nsta", "nslc", "ntanks",
    )
