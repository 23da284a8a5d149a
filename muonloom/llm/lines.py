"""Line dedup by range-partitioned line hashes, streamed in order of hash and document.

One row per document and distinct line goes to a range partition of (hash,
document) and is sorted there, so a line that stands in a third of all documents
spreads over many partitions.  Each task streams its rows, keeping the first
rows of the current line only until the threshold is reached.  A line that
touches a partition's edge can't be judged there: its rows leave as pending and
its segment as a count; there are at most two such lines per partition, and
their total counts are joined afterwards.  What returns to a document is a
compressed bitmap of the lines it keeps, not text.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from muonloom.llm.common import arrow_schema, as_bytes, map_rows
from muonloom.session import cut_lineage

#: What a line's key is stripped of at both ends.
BLANK = b"\x20\x09\x0a\x0b\x0c\x0d"


def line_keys(text: bytes) -> list[bytes]:
    """Keys of the lines of a text: A-Z lowered, blank ends stripped."""
    return [line.strip(BLANK) for line in text.lower().split(b"\n")]


def n_points(key: bytes) -> int:
    return len(key.decode("utf-8", "replace"))


def _identified(docs: DataFrame) -> DataFrame:
    """A document is its id and a hash of its text; rows equal in both are the same document."""
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), as_bytes("text").alias("text"))


LINE = "hash binary, doc_id long, text_hash long, n_lines int, places array<int>"


def document_lines(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """One row per document and distinct key of at least ``min_chars`` code points, with its places."""

    def start():
        def one(row):
            places: dict[bytes, list[int]] = {}
            keys = line_keys(row["text"])
            for i, key in enumerate(keys):
                places.setdefault(key, []).append(i)
            for key, at in places.items():
                if len(key) >= 4 * min_chars or n_points(key) >= min_chars:
                    yield {"hash": xxhash.xxh3_128_digest(key), "doc_id": row["doc_id"],
                           "text_hash": row["text_hash"], "n_lines": len(keys), "places": at}

        return one

    return map_rows(_identified(docs), LINE, start, batch=5000)


#: kind 0: dropped places of a document, pending if hash is set; ``first`` is a place to keep if no
#: earlier partition has the line.  kind 1: a line at a partition's edge and its documents there.
JUDGED = LINE + ", kind int, part int, first int, n long"


def _stream(min_docs: int, keep_first: bool, schema: pa.Schema):
    """Judge the lines of one sorted range partition; at most ``min_docs`` rows are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        out: list[dict] = []
        held: list[dict] = []
        current, docs, last, at_start = None, 0, None, True

        def close(at_edge: bool) -> None:
            if current is None or not at_edge:
                return  # an inner line of too few documents stays
            if docs < min_docs:
                out.extend(held)
            out.append({"kind": 1, "hash": current, "part": part, "n": docs})

        for b in batches:
            for row in b.to_pylist():
                if row["hash"] != current:
                    close(at_start)
                    at_start = current is None
                    current, held, docs, last = row["hash"], [], 0, None
                key = (row["doc_id"], row["text_hash"])
                if key == last:
                    continue  # a repeated row of a document
                docs, last = docs + 1, key
                row |= {"kind": 0, "part": part}
                if docs == 1 and keep_first:
                    row["first"], row["places"] = row["places"][0], row["places"][1:]
                held.append(row)
                if docs >= min_docs:  # settled, whatever other partitions hold
                    for r in held:
                        if not (at_start and "first" in r):
                            r["hash"] = None
                    out.extend(held)
                    held = []
                if len(out) >= 5000:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out = []
        close(True)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def dropped_places(lines: DataFrame, min_docs: int, keep_first: bool = False) -> DataFrame:
    """(doc_id, text_hash, n_lines, places): lines to drop, in one or more rows per document.

    Lines of at least ``min_docs`` documents go, all of them or all but the
    first in order of document and place (null ids first).
    """
    order = ["hash", "doc_id", "text_hash"]
    lines = cut_lineage(lines)  # range partitioning reads its input twice
    judged = (lines.repartitionByRange(*order).sortWithinPartitions(*order)
              .mapInArrow(_stream(min_docs, keep_first, arrow_schema(lines.sparkSession, JUDGED)), JUDGED))
    judged = cut_lineage(judged)
    # at most two lines per partition, whatever the data
    edges = (judged.filter("kind = 1").groupBy(F.col("hash").alias("_hash"))
             .agg(F.sum("n").alias("_docs"), F.min("part").alias("_first_part"))
             .filter(F.col("_docs") >= min_docs))
    keep = ["doc_id", "text_hash", "n_lines", "places"]
    settled = judged.filter("kind = 0 AND hash IS NULL").select(keep)
    is_first = F.col("first").isNull() | (F.col("part") == F.col("_first_part"))
    pending = (judged.filter("kind = 0 AND hash IS NOT NULL")
               .join(F.broadcast(edges), F.col("hash") == F.col("_hash"))
               .withColumn("places", F.when(is_first, F.col("places")).otherwise(
                   F.array_append("places", F.col("first"))))
               .select(keep))
    return settled.unionByName(pending)


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1,
                 keep_first: bool = False) -> DataFrame:
    """(doc_id, text_hash, n_lines, n_dropped, keep): per document that loses lines, which lines it keeps.

    ``keep`` is a zlib-compressed bitmap, one bit per line, first line first.
    Documents without a row keep all their lines.  A document is a doc_id (null
    is one) with its text, so repeated rows count once; null and empty text is
    one empty line, too short to be dropped.  Other columns are ignored.
    """
    found = (dropped_places(document_lines(docs, min_chars), min_docs, keep_first)
             .groupBy("doc_id", "text_hash", "n_lines")
             .agg(F.flatten(F.collect_list("places")).alias("places")))  # at most the document's lines

    def start():
        def one(row):
            keep = np.ones(row["n_lines"], np.uint8)
            keep[row["places"]] = 0
            dropped = len(keep) - int(keep.sum())
            if dropped:
                yield {k: row[k] for k in ("doc_id", "text_hash", "n_lines")} | {
                    "n_dropped": dropped, "keep": zlib.compress(np.packbits(keep).tobytes(), 1)}

        return one

    return map_rows(found, "doc_id long, text_hash long, n_lines long, n_dropped long, keep binary", start)


def kept_lines(text: bytes, keep: bytes | None) -> tuple[int, bytes]:
    """Number of lines before, and the text of the kept ones."""
    lines = text.split(b"\n")
    if keep is None:
        return len(lines), text
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines))
    return len(lines), b"\n".join([line for line, bit in zip(lines, bits.tolist()) if bit])


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the ``carry`` columns, n_lines, n_dropped and the kept text of each row of ``docs``."""
    carried = F.struct("doc_id", *carry).alias("row")
    rows = docs.select(carried, F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_text_hash"),
                       as_bytes("text").alias("text"))
    # the bitmaps grow with the documents, so they are never broadcast
    marks = bitmaps.select("doc_id", "text_hash", "n_dropped", "keep").hint("merge")
    joined = rows.join(marks, F.col("_id").eqNullSafe(F.col("doc_id"))
                       & (F.col("_text_hash") == F.col("text_hash")), "left")
    joined = joined.select("row", "text", "n_dropped", "keep")

    def start():
        def one(row):
            n, text = kept_lines(row["text"], row["keep"])
            return [{"row": row["row"], "n_lines": n, "n_dropped": row["n_dropped"] or 0, "text": text}]

        return one

    kind = rows.schema["row"].dataType.simpleString()
    done = map_rows(joined, f"row {kind}, n_lines long, n_dropped long, text binary", start)
    return done.select("row.*", "n_lines", "n_dropped", F.col("text").cast("string").alias("text"))
