"""Document fingerprints by SimHash, and all fingerprints within a Hamming radius by permuted block tables."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from muonloom.llm.common import arrow_schema
from muonloom.llm.minhash import CHUNK, shingle_hashes
from muonloom.operators.ranking import quantile_bucket
from muonloom.session import cut_lineage

#: Bits of a fingerprint.
BITS = 128
#: The last of so many equal parts of a text is edited.
PARTS = 4


def fingerprint(text: bytes) -> bytes:
    """Signs of the votes of all five-word terms; a term votes as often as it occurs.  No words: all zero."""
    terms = shingle_hashes(text)
    votes = np.zeros(BITS, np.int64)
    for i in range(0, len(terms), CHUNK):
        h = terms[i:i + CHUNK]
        wide = np.empty((len(h), 2), "<u8")
        wide[:, 0] = h * np.uint64(0x9E3779B97F4A7C15)
        wide[:, 0] ^= wide[:, 0] >> np.uint64(32)
        wide[:, 1] = (h ^ np.uint64(0xD1B54A32D192ED03)) * np.uint64(0x94D049BB133111EB)
        wide[:, 1] ^= wide[:, 1] >> np.uint64(31)
        bits = np.unpackbits(wide.view(np.uint8), axis=1)
        votes += 2 * bits.sum(axis=0, dtype=np.int64) - len(h)
    return np.packbits(votes > 0).tobytes()


def likeness(distance: Column) -> Column:
    """Cosine that a Hamming distance stands for, from 0 (unrelated) to 1 (equal)."""
    return F.when(distance == 0, F.lit(1.0)).otherwise(
        F.greatest(F.lit(0.0), F.cos(distance * F.lit(np.pi / BITS))))


def hex_distance(a: str, b: str) -> Column:
    """Bits in which two fingerprints in hexadecimal differ."""
    parts = [F.bit_count(F.conv(F.substring(a, i, 8), 16, 10).cast("long").bitwiseXOR(
        F.conv(F.substring(b, i, 8), 16, 10).cast("long"))) for i in range(1, BITS // 4, 8)]
    return sum(parts[1:], parts[0]).cast("long")


def edited(text: str, following: str) -> str:
    """The last quarter replaced by as many first characters of the following text (or all it has)."""
    n = len(text) // PARTS
    return text[:len(text) - n] + following[:n]


def neighbours(docs: DataFrame) -> DataFrame:
    """(part, after, doc_id, text): ranges of documents by id, each with the first of the next range once more.

    Within a part, rows are sorted by after, doc_id and text, so every document
    is followed by its next one; after the last range comes the first document.
    Range borders are quantiles of the ids alone; parts are as many as shuffle
    partitions.  Null ids come first.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select("doc_id")
    part = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(quantile_bucket(ids.dropna(), "doc_id", parts))
    # one row per part: its smallest id (null first)
    starts = (ids.withColumn("part", part).groupBy("part")
              .agg(F.max(F.col("doc_id").isNull()).alias("null"), F.min("doc_id").alias("id"))
              .orderBy("part").collect())
    heads = spark.createDataFrame(
        [(None if s["null"] else s["id"], starts[i - 1]["part"]) for i, s in enumerate(starts)],
        "head long, to int")
    rows = docs.select(part.alias("part"), F.lit(0).alias("after"), F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce("text", F.lit("")).alias("text"))
    heads = (rows.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("head")))
             .select(F.col("to").alias("part"), F.lit(1).alias("after"), "doc_id", "text"))
    order = ["part", "after", "doc_id", "text"]
    return rows.unionByName(heads).repartition(parts, "part").sortWithinPartitions(*order)


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited text's bytes, and fingerprints of text, edited text and next text, per row of ``docs``.

    Rows follow one another by doc_id (null first), equal ids by text; the last is
    followed by the first.  Null text is empty.  Other columns are ignored.
    """
    schema = "doc_id long, n_chars long, edited binary, own binary, changed binary, next binary"
    to = arrow_schema(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        last, last_own = None, b""
        for b in batches:
            for row in b.to_pylist():
                if last is not None and row["part"] == last["part"] and not last["after"]:
                    own = fingerprint(row["text"].encode())
                    changed = edited(last["text"], row["text"]).encode()
                    out.append({"doc_id": last["doc_id"], "n_chars": len(last["text"]), "edited": changed,
                                "own": last_own, "changed": fingerprint(changed), "next": own})
                else:
                    own = fingerprint(row["text"].encode())
                last, last_own = row, own
                if len(out) >= 200:
                    yield pa.RecordBatch.from_pylist(out, schema=to)
                    out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=to)

    return neighbours(docs).mapInArrow(run, schema)


def block_keys(code: Column, radius: int, blocks: int) -> Column:
    """Keys of a fingerprint (32 hexadecimal digits) in the permuted block tables.

    With ``blocks`` blocks of which at most ``radius`` can differ, the other
    blocks agree; there is one table for each choice of those.
    """
    digits = BITS // 4
    cuts = [round(i * digits / blocks) for i in range(blocks + 1)]
    part = [F.substring(code, cuts[i] + 1, cuts[i + 1] - cuts[i]) for i in range(blocks)]
    return F.array(*[F.concat(F.lit(f"{t}:"), *[part[i] for i in kept])
                     for t, kept in enumerate(combinations(range(blocks), blocks - radius))])


def within_radius(queries: DataFrame, codes: DataFrame, radius: int = 3, blocks: int = 5) -> DataFrame:
    """(query, code, distance): every code of ``codes`` within ``radius`` bits of a code of ``queries``.

    Both have a column ``code`` with fingerprints in hexadecimal; null codes are
    left out, equal ones count once, so groups of copies are a single row.  Exact
    by the pigeonhole principle; pairs that meet in several tables come once.
    """
    if not 0 <= radius < blocks:
        raise ValueError("radius must be below the number of blocks")
    left = queries.select(F.col("code").alias("query")).dropna().distinct()
    right = codes.select("code").dropna().distinct()
    left = left.withColumn("key", F.explode(block_keys(F.col("query"), radius, blocks)))
    right = right.withColumn("key", F.explode(block_keys(F.col("code"), radius, blocks)))
    return (left.join(right.hint("merge"), "key").withColumn("distance", hex_distance("query", "code"))
            .filter(F.col("distance") <= radius).select("query", "code", "distance").distinct())


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row."""
    rows = with_next(docs)
    code = lambda c: F.lower(F.hex(c))
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), code("own").alias("fingerprint"),
                       code("changed").alias("edited_fingerprint"), code("next").alias("_next"))
    return (rows.withColumn("near_edited", likeness(hex_distance("fingerprint", "edited_fingerprint")))
            .withColumn("near_next", likeness(hex_distance("fingerprint", "_next"))).drop("_next"))


def close_fingerprints(prints: DataFrame, every: int = 50, radius: int = 3) -> DataFrame:
    """Add n_close: other rows whose fingerprint is within ``radius`` bits, for ids divisible by ``every``, else null."""
    prints = cut_lineage(prints)
    counts = prints.groupBy(F.col("fingerprint").alias("code")).agg(F.count("*").alias("_rows"))
    counts = cut_lineage(counts)
    asked = prints.filter(F.col("doc_id") % every == 0).select(F.col("fingerprint").alias("code"))
    found = (within_radius(asked, counts, radius).join(counts.hint("merge"), "code")
             .groupBy("query").agg(F.sum("_rows").alias("_n")))
    # written, so that the join has its own exchanges and a frequent fingerprint is split
    joined = prints.join(cut_lineage(found).hint("merge"), (F.col("fingerprint") == F.col("query"))
                         & (F.col("doc_id") % every == 0), "left")
    return joined.withColumn("n_close", F.col("_n") - 1).drop("query", "_n")
