"""Named queries with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from muonloom.plans.views import Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = ""):
    """Register a function of Tables; ``sql`` may use the named views."""

    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = with_views(views, sql)
        return fn

    return register


def r(col: Column | str, digits: int = 6) -> Column:
    """Round for comparison (Spark rounds through decimals, so never to -0.0)."""
    return F.round(F.col(col) if isinstance(col, str) else col, digits)


def g(col: Column | str, digits: int = 9) -> Column:
    """Keep ``digits`` significant digits; meant for tables of bins."""
    c = F.col(col) if isinstance(col, str) else col
    return F.format_string(f"%.{digits - 1}e", c.cast("double")).try_cast("double")


def R(expr: str, digits: int = 6) -> str:
    return f"(CASE WHEN round({expr}, {digits}) = 0 THEN 0.0e0 ELSE round({expr}, {digits}) END)"


def G(expr: str, digits: int = 9) -> str:
    return (f"(CASE WHEN ({expr}) = 0 THEN 0.0e0 ELSE "
            f"CAST(printf('%.{digits - 1}e', CAST({expr} AS DOUBLE)) AS DOUBLE) END)")


def num(x: float) -> str:
    """A DOUBLE literal."""
    t = repr(float(x))
    return t if "e" in t else t + "e0"


def edges_sql(edges) -> str:
    """SELECT of (bin, lo, hi, last) for histogram edges."""
    rows = ", ".join(
        f"({i}, {num(edges[i])}, {num(edges[i + 1])}, {str(i == len(edges) - 2).upper()})"
        for i in range(len(edges) - 1))
    return f"(SELECT * FROM (VALUES {rows}) AS t(bin, lo, hi, last))"


def in_bin(x: str, e: str = "b") -> str:
    return f"{x} >= {e}.lo AND ({x} < {e}.hi OR ({e}.last AND {x} = {e}.hi))"
