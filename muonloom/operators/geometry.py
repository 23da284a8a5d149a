"""The detector geometry as a table: positions and distances."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from muonloom.functions.directions import distance
from muonloom.schema import TANK
from muonloom.sources.constants import OM_TANK


def read_geometry(spark: SparkSession, path: str) -> DataFrame:
    """Tank positions from a table (station, tank, tank_index, x, y, z)."""
    return spark.read.schema(TANK).parquet(path)


def tank_of(om: Column) -> Column:
    """Tank letter of an optical module number."""
    a = [o for o, t in OM_TANK.items() if t == "A"]
    b = [o for o, t in OM_TANK.items() if t == "B"]
    return F.when(om.isin(*a), F.lit("A")).when(om.isin(*b), F.lit("B"))


def tank_index(station: Column, tank: Column) -> Column:
    """Running tank number 0, 1, ... with A before B in each station."""
    return 2 * (station - 1) + F.when(tank == "A", 0).otherwise(1)


def locate(pulses: DataFrame, tanks: DataFrame, how: str = "inner") -> DataFrame:
    """Add x, y, z of the hit tank.

    No hint: Spark broadcasts the geometry when its measured size is below the
    broadcast threshold and uses a shuffled join otherwise.
    """
    p = pulses if "tank" in pulses.columns else pulses.withColumn("tank", tank_of(F.col("om")))
    return p.join(tanks.select("station", "tank", "x", "y", "z"), ["station", "tank"], how)


def station_spacing(tanks: DataFrame) -> DataFrame:
    """Distance between the two tanks of every station."""
    a = tanks.filter(F.col("tank") == "A").select("station", F.col("x").alias("xa"),
                                                  F.col("y").alias("ya"), F.col("z").alias("za"))
    b = tanks.filter(F.col("tank") == "B").select("station", F.col("x").alias("xb"),
                                                  F.col("y").alias("yb"), F.col("z").alias("zb"))
    d = distance(*[F.col(c) for c in ("xa", "ya", "xb", "yb")])
    return a.join(b, "station").select("station", d.alias("distance"))


def station_centres(tanks: DataFrame) -> DataFrame:
    """Mid point between the tanks of every station."""
    return tanks.groupBy("station").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


def station_distance(tanks: DataFrame, station_a: int, station_b: int) -> DataFrame:
    """Distance between the mid points of two stations."""
    centre = lambda c, s: F.avg(F.when(F.col("station") == s, F.col(c)))
    return tanks.agg(
        distance(centre("x", station_a), centre("y", station_a),
                 centre("x", station_b), centre("y", station_b)).alias("distance"))
