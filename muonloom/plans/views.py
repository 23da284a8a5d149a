"""The benchmark tables seen as detector tables, in Spark and as the same SQL."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, functions as F

from muonloom.sources.constants import PDG

# Each view: name -> SQL over the registered tables and earlier views.
VIEWS: dict[str, str] = {
    "pulse": """
        SELECT l_orderkey AS event_id, CAST(l_suppkey // 2 + 1 AS INTEGER) AS station,
               CAST(61 + (l_suppkey % 2) * 2 + l_linenumber % 2 AS INTEGER) AS om,
               CASE WHEN l_suppkey % 2 = 0 THEN 'A' ELSE 'B' END AS tank,
               l_extendedprice / 10000.0 AS charge,
               CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS DOUBLE) AS time,
               l_partkey * 10 + l_linenumber AS hit
        FROM lineitem""",
    "pulse_dense": """
        SELECT user_id AS event_id, CAST(event_id % 81 + 1 AS INTEGER) AS station,
               CAST(61 + (event_id // 81) % 4 AS INTEGER) AS om,
               CASE WHEN (event_id // 81) % 4 < 2 THEN 'A' ELSE 'B' END AS tank,
               value AS charge,
               date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 1e6 AS time,
               event_id AS hit
        FROM events""",
    "tank": """
        SELECT CAST(s_suppkey // 2 + 1 AS INTEGER) AS station,
               CASE WHEN s_suppkey % 2 = 0 THEN 'A' ELSE 'B' END AS tank,
               CAST(s_suppkey AS INTEGER) AS tank_index,
               s_acctbal / 10 - 450 AS x, (s_nationkey - 12) * 40.0e0 AS y,
               CAST(1946 + s_suppkey % 7 AS DOUBLE) AS z
        FROM supplier""",
    "tank_dense": """
        SELECT DISTINCT station, tank,
               CAST(((station - 1) % 9 - 4) * 125 + CASE WHEN tank = 'B' THEN 10 ELSE 0 END
                    AS DOUBLE) AS x,
               CAST(((station - 1) // 9 - 4) * 108 AS DOUBLE) AS y,
               1946.0e0 AS z
        FROM pulse_dense""",
    "evt": """
        SELECT o_orderkey AS event_id, CAST(year(o_orderdate) AS INTEGER) AS run,
               o_totalprice * 20 AS energy, log10(o_totalprice * 20) AS loge,
               o_orderstatus <> 'F' AS filt,
               CAST(CASE o_custkey % 4 WHEN 0 THEN 2212 WHEN 1 THEN 1000020040
                    WHEN 2 THEN 1000080160 ELSE 1000260560 END AS BIGINT) AS pdg,
               radians(CAST(o_custkey % 40 AS DOUBLE)) AS zenith,
               radians(CAST(o_orderkey % 360 AS DOUBLE)) AS azimuth,
               CAST((o_custkey * 7) % 600 - 300 AS DOUBLE) AS x,
               CAST((o_orderkey * 13) % 600 - 300 AS DOUBLE) AS y,
               1e6 / o_totalprice AS w,
               log10(o_totalprice * 20) + (((o_orderkey * 37) % 101) - 50) / 250.0e0 AS loge_p,
               radians(CAST(o_custkey % 40 AS DOUBLE))
                 + radians((((o_orderkey * 17) % 21) - 10) * 0.2e0) AS zen_p,
               CAST((o_custkey * 7) % 600 - 300 + (o_orderkey * 11) % 41 - 20 AS DOUBLE) AS x_p,
               CAST((o_orderkey * 13) % 600 - 300 + (o_orderkey * 23) % 41 - 20 AS DOUBLE) AS y_p,
               CASE WHEN o_orderkey % 2 = 1 THEN 'data' ELSE 'mc' END AS sample,
               CASE WHEN o_orderkey % 2 = 1 THEN 1e-3 ELSE 1e6 / o_totalprice END AS sw
        FROM orders""",
    "summary": """
        SELECT event_id,
               COUNT(*) FILTER (WHERE hlc) AS nsta,
               CAST(SUM(CASE WHEN hlc THEN 0 ELSE n_om END) AS BIGINT) AS nslc,
               CAST(SUM(n_om) AS BIGINT) AS ntanks,
               SUM(CASE WHEN hlc THEN q ELSE 0 END) AS qtotalhlc,
               SUM(q) AS qtotal, MAX(q_max) AS qmax, SUM(q) - MAX(q_max) AS qhillas,
               (MAX({'q': q_max, 's': station}) FILTER (WHERE hlc)).s AS loudest_station
        FROM (SELECT event_id, station, SUM(charge) AS q, MAX(charge) AS q_max,
                     COUNT(DISTINCT tank) >= 2 AS hlc, COUNT(DISTINCT om) AS n_om
              FROM pulse GROUP BY event_id, station)
        GROUP BY event_id""",
    "top2": """
        SELECT event_id, SUM(charge) AS qsum2, MAX(charge) AS q1
        FROM (SELECT event_id, charge, row_number() OVER
                     (PARTITION BY event_id ORDER BY charge DESC) AS r FROM pulse)
        WHERE r <= 2 GROUP BY event_id""",
    "booked": """
        SELECT e.*, s.nsta, s.nslc, s.ntanks, s.qtotalhlc, s.qtotal, s.qmax, s.qhillas,
               s.loudest_station, t.qsum2
        FROM evt e JOIN summary s USING (event_id) JOIN top2 t USING (event_id)""",
    "top35": """
        SELECT event_id, station, om, tank, charge, time, hit, r AS rank
        FROM (SELECT *, row_number() OVER (PARTITION BY event_id
                     ORDER BY charge DESC, station, om, time, hit) AS r FROM pulse)
        WHERE r <= 35""",
    "top35_dense": """
        SELECT event_id, station, om, tank, charge, time, hit, r AS rank
        FROM (SELECT *, row_number() OVER (PARTITION BY event_id
                     ORDER BY charge DESC, station, om, time, hit) AS r FROM pulse_dense)
        WHERE r <= 35""",
    "run_dim": """
        SELECT DISTINCT run, 28000.0e0 + run % 100 * 10 AS duration FROM evt""",
    "flags": """
        SELECT user_id AS event_id, event_id AS sub_id, event_type AS filter, value > 50 AS passed
        FROM events""",
}

_DEPENDS = {
    "tank_dense": ["pulse_dense"], "summary": ["pulse"], "top2": ["pulse"],
    "booked": ["pulse", "evt", "summary", "top2"], "top35": ["pulse"],
    "top35_dense": ["pulse_dense"], "run_dim": ["evt"],
}


def with_views(names: str, body: str) -> str:
    """SQL text of ``body`` with the named views in front."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for d in _DEPENDS.get(name, []):
            add(d)
        if name not in wanted:
            wanted.append(name)

    for n in names.split():
        add(n)
    if not wanted:
        return body.strip()
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in wanted)
    return f"WITH {ctes}\nSELECT * FROM (\n{body.strip()}\n)"


KEY = ["event_id"]
TIES = ["station", "om", "time", "hit"]


class Tables:
    """The same views as lazy DataFrames over one folder of parquet files."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @functools.cached_property
    def pulse(self) -> DataFrame:
        odd = F.col("l_suppkey") % 2
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("event_id"),
            (F.floor(F.col("l_suppkey") / 2) + 1).cast("int").alias("station"),
            (61 + odd * 2 + F.col("l_linenumber") % 2).cast("int").alias("om"),
            F.when(odd == 0, F.lit("A")).otherwise(F.lit("B")).alias("tank"),
            (F.col("l_extendedprice") / 10000.0).alias("charge"),
            F.date_diff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date"))
            .cast("double").alias("time"),
            (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("hit"))

    @functools.cached_property
    def pulse_dense(self) -> DataFrame:
        four = F.floor(F.col("event_id") / 81) % 4
        micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', "
                        "CAST(ts AS TIMESTAMP_NTZ))")
        return self.raw("events").select(
            F.col("user_id").alias("event_id"),
            (F.col("event_id") % 81 + 1).cast("int").alias("station"),
            (61 + four).cast("int").alias("om"),
            F.when(four < 2, F.lit("A")).otherwise(F.lit("B")).alias("tank"),
            F.col("value").alias("charge"),
            (micros / 1e6).alias("time"),
            F.col("event_id").alias("hit"))

    @functools.cached_property
    def tank(self) -> DataFrame:
        odd = F.col("s_suppkey") % 2
        return self.raw("supplier").select(
            (F.floor(F.col("s_suppkey") / 2) + 1).cast("int").alias("station"),
            F.when(odd == 0, F.lit("A")).otherwise(F.lit("B")).alias("tank"),
            F.col("s_suppkey").cast("int").alias("tank_index"),
            (F.col("s_acctbal") / 10 - 450).alias("x"),
            ((F.col("s_nationkey") - 12) * 40.0).alias("y"),
            (1946 + F.col("s_suppkey") % 7).cast("double").alias("z"))

    @functools.cached_property
    def tank_dense(self) -> DataFrame:
        s = F.col("station")
        return self.pulse_dense.select("station", "tank").distinct().select(
            "station", "tank",
            (((s - 1) % 9 - 4) * 125 + F.when(F.col("tank") == "B", 10).otherwise(0))
            .cast("double").alias("x"),
            ((F.floor((s - 1) / 9) - 4) * 108).cast("double").alias("y"),
            F.lit(1946.0).alias("z"))

    @functools.cached_property
    def evt(self) -> DataFrame:
        k, c = F.col("o_orderkey"), F.col("o_custkey")
        pdg = F.when(c % 4 == 0, PDG["proton"]).when(c % 4 == 1, PDG["helium"]).when(
            c % 4 == 2, PDG["oxygen"]).otherwise(PDG["iron"])
        deg = lambda v: F.radians(v.cast("double"))
        energy = F.col("o_totalprice") * 20
        x, y = (c * 7) % 600 - 300, (k * 13) % 600 - 300
        w = F.lit(1e6) / F.col("o_totalprice")
        return self.raw("orders").select(
            k.alias("event_id"),
            F.year("o_orderdate").alias("run"),
            energy.alias("energy"), F.log10(energy).alias("loge"),
            (F.col("o_orderstatus") != "F").alias("filt"),
            pdg.cast("long").alias("pdg"),
            deg(c % 40).alias("zenith"), deg(k % 360).alias("azimuth"),
            x.cast("double").alias("x"), y.cast("double").alias("y"),
            w.alias("w"),
            (F.log10(energy) + ((k * 37) % 101 - 50) / 250.0).alias("loge_p"),
            (deg(c % 40) + F.radians(((k * 17) % 21 - 10) * 0.2)).alias("zen_p"),
            (x + (k * 11) % 41 - 20).cast("double").alias("x_p"),
            (y + (k * 23) % 41 - 20).cast("double").alias("y_p"),
            F.when(k % 2 == 1, F.lit("data")).otherwise(F.lit("mc")).alias("sample"),
            F.when(k % 2 == 1, F.lit(1e-3)).otherwise(w).alias("sw"))

    @functools.cached_property
    def summary(self) -> DataFrame:
        from muonloom.operators.summary import event_summary
        return event_summary(self.pulse, KEY)

    @functools.cached_property
    def qsum2(self) -> DataFrame:
        from muonloom.operators.pulses import top_pulses
        top = top_pulses(self.pulse, KEY, 2, ["hit"])
        return top.groupBy(*KEY).agg(F.sum("charge").alias("qsum2"))

    @functools.cached_property
    def booked(self) -> DataFrame:
        """Events with at least one hit, their summary and the two largest charges."""
        return self.evt.join(self.summary, KEY).join(self.qsum2, KEY)

    @functools.cached_property
    def run_dim(self) -> DataFrame:
        runs = self.evt.select("run").distinct()
        return runs.withColumn("duration", 28000.0 + F.col("run") % 100 * 10)

    @functools.cached_property
    def flags(self) -> DataFrame:
        return self.raw("events").select(
            F.col("user_id").alias("event_id"), F.col("event_id").alias("sub_id"),
            F.col("event_type").alias("filter"), (F.col("value") > 50).alias("passed"))
