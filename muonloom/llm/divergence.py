"""How far the term shares of sources in one language lie apart.

1. Arrow batches of documents are lower-cased, split and dictionary-encoded,
   and hash-grouped into partial counts per (lang, source, term): texts never
   leave their task.  One aggregate merges the parts.
2. Terms in enough documents of a language are kept; shares are fixed-point
   integers, so results are exact and do not depend on the order of rows.
3. Sources are compared in columnar shards: a shard holds some terms of a
   language and at most two blocks of its sources, as one matrix of counts.
   Shards add up per pair of sources; terms that neither source has share one
   value, which is added at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from muonloom.llm.common import BROADCAST_ROWS, arrow_schema
from muonloom.session import cut_lineage

#: What stands between terms (fixed by the contract): ASCII other than letters.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: A term is kept in a language if so many of its documents have it.
MIN_DOCS = 10
#: Shares are counted in units of 1 / SCALE.
SCALE = 1_000_000_000
#: Ranks of the terms that set a source apart.
TOP_TERMS = 10
#: Terms of a shard, and sources on either side of it.
SHARD, BLOCK = 4096, 128
#: Bytes of text tokenized at once, and partial rows a task holds before it lets them go.
BATCH_BYTES, HOLD_ROWS = 8 << 20, 200_000

_PART = "lang string, source string, term string, n long, docs long"


def _count(part: pa.RecordBatch) -> pa.Table:
    """Partial counts of some rows; a row without a term says that the group occurs."""
    lowered = pc.ascii_lower(part["text"])
    pieces = pc.split_pattern_regex(lowered, pattern=BETWEEN)
    at, term = pc.list_parent_indices(pieces), pc.list_flatten(pieces)
    real = pc.greater(pc.binary_length(term), 0)
    at, code = at.filter(real), term.filter(real).dictionary_encode()
    per_doc = pa.table({"at": at, "code": code.indices}).group_by(["at", "code"]).aggregate([([], "count_all")])
    groups = pa.table({"lang": part["lang"], "source": part["source"]}).take(per_doc["at"])
    groups = groups.append_column("code", per_doc["code"]).append_column("n", per_doc["count_all"])
    merged = groups.group_by(["lang", "source", "code"]).aggregate([("n", "sum"), ("n", "count")])
    found = pa.table({"lang": merged["lang"], "source": merged["source"],
                      "term": code.dictionary.take(merged["code"]), "n": merged["n_sum"],
                      "docs": merged["n_count"]})
    seen = pa.table({"lang": part["lang"], "source": part["source"]}).group_by(["lang", "source"]).aggregate([])
    zero = pa.array(np.zeros(seen.num_rows, np.int64))
    none = pa.nulls(seen.num_rows, pa.string())
    return pa.concat_tables([found, seen.append_column("term", none).append_column("n", zero)
                             .append_column("docs", zero)])


def _merge(parts: list[pa.Table]) -> pa.Table:
    grouped = (pa.concat_tables(parts).group_by(["lang", "source", "term"])
               .aggregate([("n", "sum"), ("docs", "sum")]))
    return grouped.rename_columns(["lang", "source", "term", "n", "docs"])


def slices(batch: pa.RecordBatch, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts have at most ``limit`` bytes; a longer text stands alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy().astype(np.int64))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of every term and documents with it.

    A row with a null term stands for every (lang, source) that occurs.
    """
    to = arrow_schema(docs.sparkSession, _PART)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0
        for batch in batches:
            for part in slices(batch):
                held.append(_count(part))
                rows += held[-1].num_rows
                if rows > HOLD_ROWS:
                    held = [_merge(held)]
                    rows = held[0].num_rows
                    if rows > HOLD_ROWS // 2:
                        yield from held[0].cast(to).to_batches(max_chunksize=10_000)
                        held, rows = [], 0
        if held:
            yield from _merge(held).cast(to).to_batches(max_chunksize=10_000)

    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return (rows.mapInArrow(run, _PART).groupBy("lang", "source", "term")
            .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * terms)), exact for counts below 9e15; for no terms any number.

    A long division by three digits at a time, as SCALE is 1000 * 1000 * 1000.
    """
    below = F.greatest(total + 2 * terms, F.lit(1).cast("long"))
    rest, out = n + 2, F.lit(0).cast("long")
    for _ in range(3):
        out = out * 1000 + F.call_function("div", rest * 1000, below)
        rest = (rest * 1000) % below
    return out + 1


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q))."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _shares(n: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    below = np.maximum(total + 2 * terms, 1)
    rest, out = n + 2, np.zeros_like(n)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, below)
        out = out * 1000 + more
    return out + 1


def source_pairs(found: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): the gap between two sources summed over the kept terms, in both directions.

    A shard is a group of at most about SHARD terms and two blocks of sources.
    Every source of the blocks is in it, also those without any of its terms.
    """
    per_lang = groups.groupBy("lang").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    placed = groups.join(per_lang, "lang").select(
        "lang", "source", "total", "terms", "blocks", F.greatest(F.ceil(F.col("terms") / SHARD), F.lit(1)).alias("shards"),
        F.pmod(F.xxhash64("source"), F.col("blocks")).alias("block"))
    home = placed.select("lang", "source", "blocks", "block", "shards", "total", "terms")
    entries = _with_groups(found.select("lang", "source", "term", "n"), home).withColumn(
        "shard", F.pmod(F.xxhash64("term"), F.col("shards")))
    members = home.select("*", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"),
                          F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard"))
    rows = entries.unionByName(members).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("lang", "shard", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                       "block", "source", "total", "terms", "term", "n")
    schema = "lang string, a string, b string, total_a long, total_b long, terms long, value long, seen long"
    to = arrow_schema(found.sparkSession, schema)

    def compare(tile: pa.Table) -> pa.Table:
        tile = tile.combine_chunks()
        at = pc.is_null(tile["term"])
        names = tile.filter(at).sort_by("source")
        entry = tile.filter(pc.invert(at))
        sources = names["source"].combine_chunks()
        total, block = names["total"].to_numpy(), names["block"].to_numpy()
        code = entry["term"].combine_chunks().dictionary_encode()
        counts = np.zeros((len(sources), len(code.dictionary)), np.int64)
        counts[pc.index_in(entry["source"], value_set=sources).to_numpy(), code.indices.to_numpy()] = entry["n"].to_numpy()
        terms = tile["terms"][0].as_py()
        p = _shares(counts, total[:, None], terms)
        i, j = tile["i"][0].as_py(), tile["j"][0].as_py()
        low, high = np.flatnonzero(block == i), np.flatnonzero(block == j)  # a block may be without sources
        left, right, value = [], [], []
        for a in low:
            b = high[high > a] if i == j else high
            d = p[b] - p[a]
            left.append(np.full(len(b), a))
            right.append(b)
            value.append((d * d // (p[b] + p[a])).sum(axis=1))
        a, b = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (left, right))
        size = len(a)
        return pa.table({
            "lang": pa.repeat(tile["lang"][0], size), "a": sources.take(pa.array(a)), "b": sources.take(pa.array(b)),
            "total_a": total[a], "total_b": total[b], "terms": np.full(size, terms),
            "value": np.concatenate(value) if value else np.zeros(0, np.int64),
            "seen": np.full(size, counts.shape[1])}).cast(to)

    sums = (rows.groupBy("lang", "shard", "i", "j").applyInArrow(compare, schema)
            .groupBy("lang", "a", "b", "total_a", "total_b", "terms")
            .agg(F.sum("value").alias("value"), F.sum("seen").alias("seen")))
    none = F.lit(0).cast("long")
    absent = gap(share(none, F.col("total_a"), F.col("terms")), share(none, F.col("total_b"), F.col("terms")))
    whole = F.col("value") + (F.col("terms") - F.col("seen")) * absent
    both = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
                   F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    return sums.select("lang", whole.alias("value"), F.inline(both))


def _with_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows with their group's columns; few groups are broadcast, more are joined by a shuffle."""
    few = groups.count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(groups) if few else groups.hint("merge"), ["lang", "source"])


def divergences(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank of every (lang, source) of ``docs``.

    Terms are runs of letters and non-ASCII characters with A-Z in lower case;
    a language keeps those in at least ``min_docs`` of its documents (rows).
    With c occurrences of a kept term in a group that has N of all V kept
    terms, its share is p = 1 + floor(1e9 * (c + 2) / (N + 2 * V)).

    * part "pair": item is another source of the language, value the sum over
      all kept terms of floor((p - q)^2 / (p + q)); 0 if no term is kept.
    * part "term": item is a kept term that occurs in the group with a higher
      share p than the language's q; value is its floor((p - q)^2 / (p + q));
      the first ``top`` ranks.

    Ranks count from 1 by falling value, ties by the item's bytes.  Null
    language, source or text count as empty; a group without terms has its
    pairs; a source that is alone in its language has none; an empty table
    gives no rows.  Other columns are ignored.
    """
    counts = cut_lineage(term_counts(docs))
    words = counts.filter("term IS NOT NULL")
    kept = cut_lineage(words.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("in_docs"))
                       .filter(F.col("in_docs") >= min_docs).drop("in_docs"))
    found = cut_lineage(words.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = cut_lineage(counts.filter("term IS NULL").select("lang", "source")
                         .join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
                         .na.fill(0, ["total", "terms", "lang_total"]))
    p = share(F.col("n"), F.col("total"), F.col("terms"))
    q = share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    own = (_with_groups(found, groups).withColumns({"p": p, "q": q}).filter("p > q")
           .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                   gap(F.col("p"), F.col("q")).alias("value")))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    own = own.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    pairs = (source_pairs(found, groups)
             .select("lang", "source", F.lit("pair").alias("part"), "item", "value",
                     F.row_number().over(order).alias("rank")))
    return pairs.unionByName(own)
