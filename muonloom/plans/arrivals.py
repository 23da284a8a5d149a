"""Registered queries: streams that run over what is available and stop."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from muonloom.operators import hist
from muonloom.plans.hits import GAP_EDGES, seconds
from muonloom.plans.registry import edges_sql, in_bin, query
from muonloom.session import shared_dir
from muonloom.streaming import incremental


def _stream(t, name):
    """The rows of one table as a stream."""
    schema = t.raw(name).schema
    return (t.spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
            .parquet(t.folder))


def _folders(t):
    base = f"{shared_dir(t.spark).rstrip('/')}/arrivals-{uuid.uuid4().hex}"
    return f"{base}/out", f"{base}/state"


@query("stream_booking", """
    SELECT CAST(year(o_orderdate) AS INTEGER) AS run, COUNT(*) AS n FROM orders GROUP BY ALL""")
def stream_booking(t):
    events = _stream(t, "orders").withColumn("run", F.year("o_orderdate"))
    out, state = _folders(t)
    incremental.book_new_runs(events, out, state).awaitTermination()
    return t.spark.read.parquet(out).groupBy("run").agg(F.count("*").alias("n"))



@query("stream_rate", """
    WITH d AS (SELECT CAST(ts AS DATE) AS day, event_type, value FROM events)
    SELECT strftime(day, '%Y-%m-%d') AS day, event_type, COUNT(*) AS hits FROM d
    WHERE CAST(day + 1 AS TIMESTAMP) <= (SELECT MAX(ts) - INTERVAL 1 HOUR FROM events)
    GROUP BY day, event_type""")
def stream_rate(t):
    hits = _stream(t, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    rate = incremental.windowed_rate(hits, "ts", ["event_type"])
    out, state = _folders(t)
    incremental.run_to_table(rate, out, state).awaitTermination()
    return t.spark.read.parquet(out).select(
        F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "hits")


@query("stream_gaps", f"""
    WITH d AS (SELECT event_type AS run, date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 1e6 AS t FROM events
               WHERE CAST(CAST(ts AS DATE) + 1 AS TIMESTAMP) <= (SELECT MAX(ts) - INTERVAL 1 HOUR FROM events)),
         gaps AS (SELECT run, t - lag(t) OVER (PARTITION BY run ORDER BY t) AS gap FROM d),
         b AS {edges_sql(GAP_EDGES)}
    SELECT run, bin, COUNT(*) AS n FROM gaps JOIN b ON {in_bin('gap')} GROUP BY run, bin""")
def stream_gaps(t):
    stamped = _stream(t, "events").select(
        F.col("event_type").alias("run"), F.col("ts").cast("timestamp").alias("ts"), seconds().alias("t"))
    gaps = incremental.arriving_gaps(stamped, ["run"], "ts", "t", *_folders(t), length="1 day")
    return hist.hist_gaps(gaps, GAP_EDGES, ["run"]).select("run", "bin", "n")
