"""Shared pieces of the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: White space between words, as a character class body, and a word.
SPACE = r"\x20\x09-\x0D"
WORD = f"[^{SPACE}]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Tables of at most so many rows of a few numbers are broadcast; larger ones are shuffled.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def as_bytes(col: Column | str) -> Column:
    """UTF-8 bytes of a string column; null becomes empty."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.cast("string").cast("binary"), F.lit(b""))


def lower_ascii(col: Column) -> Column:
    return F.translate(col, UPPER, UPPER.lower())


def word_count(col: Column | str) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(F.col(col) if isinstance(col, str) else col, F.lit(WORD)),
                      F.lit(0)).cast("long")


def hash_sample(df: DataFrame, key: str, limit: int) -> DataFrame:
    """At most ``limit`` rows, the first by a hash of their key.

    A first cut by the hash leaves about twice as many rows in all, however
    many tasks there are, so sorting them out stays small.
    """
    share = min(1.0, 2.0 * limit / max(df.count(), 1))
    h = F.xxhash64(F.lit(11), key)
    few = df if share == 1.0 else df.filter(F.pmod(h, F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    return few.orderBy(h, key).limit(limit)


def words_of(text: bytes) -> list[bytes]:
    """Words with A-Z in lower case (both bytes methods know ASCII only)."""
    return text.lower().split()


def map_rows(df: DataFrame, schema: str, make: Callable[[], Callable[[dict], Iterator[dict] | list]],
             batch: int = 500) -> DataFrame:
    """Run a row function in Arrow batches.

    ``make`` runs once per task and returns a function from a row to rows.
    Results leave in batches of ``batch`` rows, so memory follows the longest
    rows and never the partition.
    """
    to = arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn, out = make(), []
        for b in batches:
            for start in range(0, b.num_rows, batch):
                for row in b.slice(start, batch).to_pylist():
                    out.extend(fn(row))
                    if len(out) >= batch:
                        yield pa.RecordBatch.from_pylist(out, schema=to)
                        out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=to)

    return df.mapInArrow(run, schema)


def arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))
