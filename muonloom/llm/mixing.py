"""Mixing sources to target weights: repetition rates and a hash-seeded draw per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from muonloom.llm.common import BROADCAST_ROWS, word_count
from muonloom.session import cut_lineage

#: Salts for joining rates to documents when there are too many sources to broadcast.
SALTS = 64


def source_sizes(docs: DataFrame, size: Column, source: str = "source") -> DataFrame:
    """Tokens per source (source, source_size); null is a source of its own."""
    return docs.groupBy(F.col(source).alias("source")).agg(F.sum(size).cast("long").alias("source_size"))


def cyclic_weights(sizes: DataFrame, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Add ``weight``: sources by code point, null last, take the cycle's weights in turn.

    Ranks are counted inside range partitions and shifted by the partitions
    before, so no task holds all sources; the one window without a key has one
    row per partition.
    """
    placed = cut_lineage(sizes.repartitionByRange(F.col("source").asc_nulls_last())
                         .withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    parts = parts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(F.col("source").asc_nulls_last()))
    place = (F.col("_before") + F.col("_inside") - 1) % len(cycle)
    weight = F.element_at(F.array(*[F.lit(w) for w in cycle]), (place + 1).cast("int"))
    return (placed.withColumn("_inside", inside).join(parts, "_part")
            .select("source", "source_size", weight.alias("weight")))


def fill_targets(weighted: DataFrame, most: int = 3) -> tuple[DataFrame, int]:
    """Targets that share all tokens by weight, none above ``most`` times its source's size.

    What a capped source can't take is shared again by weight among the others
    until none is above.  Each pass is one aggregate to a single row over the
    table of sources.  Adds target and rate = target / size; a source without
    tokens has target 0 and rate 1 (its documents stay once).  Returns also the
    number of sources.
    """
    sources = cut_lineage(weighted)
    cap = F.col("source_size") * most
    total, weight, n = sources.agg(F.sum("source_size"), F.sum("weight"), F.count("*")).first()
    total = total or 0
    level, last = (total / weight if weight else 0.0), -1
    while True:
        over = cap <= F.lit(level) * F.col("weight")
        taken, free, capped = sources.agg(
            F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("weight"))),
            F.sum(over.cast("long"))).first()
        if not free or capped == last:
            break
        level, last = (total - (taken or 0)) / free, capped
    target = F.least(cap.cast("double"), F.lit(level) * F.col("weight"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(1.0))
    return sources.withColumn("target", target).withColumn("rate", rate), n


def draw(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the id and the seed alone."""
    text = F.concat(F.lit(f"mix-{seed}|"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(2 ** 52))


def with_rates(docs: DataFrame, rates: DataFrame, n_sources: int) -> DataFrame:
    """Join each document to its source's rate.

    Up to 100,000 sources are broadcast.  Beyond, documents are salted by a
    hash of their id and each rate goes to every salt, so a source with a third
    of all rows is spread over 64 keys.
    """
    rates = rates.withColumnRenamed("source", "_source")
    if n_sources <= BROADCAST_ROWS:
        return docs.join(F.broadcast(rates), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    salted = docs.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "n_words"), F.lit(SALTS)))
    rates = rates.withColumn("_to", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(rates, F.col("source").eqNullSafe(F.col("_source"))
                       & (F.col("_salt") == F.col("_to"))).drop("_source", "_salt", "_to")


def mix(docs: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 0) -> DataFrame:
    """Columns of ``docs`` plus n_words, source_size, target, rate and copies.

    copies = floor(rate), plus one if the document's draw is below the fraction
    of rate.  Rows with equal doc_id share the draw (null ids share one), so a
    rerun gives the same mix.  Null text has no words, null source is a source,
    an empty table gives no rows.  Input columns called like an added one are
    replaced.
    """
    added = ("n_words", "source_size", "weight", "target", "rate", "copies")
    docs = docs.drop(*added).withColumn("n_words", word_count("text"))
    weighted = cyclic_weights(source_sizes(docs, F.col("n_words")), cycle)
    rates, n = fill_targets(weighted, most)
    whole = F.floor("rate")
    extra = (draw(F.col("doc_id"), seed) < F.col("rate") - whole).cast("long")
    return with_rates(docs, rates, n).withColumn("copies", whole + extra)


def emit(mixed: DataFrame) -> DataFrame:
    """One row per copy."""
    return (mixed.filter("copies > 0")
            .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
            .drop("_copy"))
