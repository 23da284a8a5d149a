"""A corpus pipeline from raw documents to token ids.

Every stage takes the rows that the stage before has kept and returns the
columns of documents, the last one token ids.  Rows are written between stages,
so a lost executor never repeats an earlier one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from muonloom.llm import bpe, lines, minhash, mixing, toxicity
from muonloom.llm.common import table
from muonloom.session import cut_lineage, drop_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier chain finds toxic.

    The chain is fitted on the labelled documents of the given tables.
    """
    chain = toxicity.fit(table(spark, sf_dir, "documents"),
                         toxicity.categories(table(spark, sf_dir, "labels")))
    scored = toxicity.score(docs, chain, carry=tuple(COLUMNS))
    return scored.filter(F.col("p_toxic") < toxicity.TOXIC).select(COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that stand in at least 10 documents; a document may become empty but stays."""
    kept = lines.apply_bitmaps(docs, lines.keep_bitmaps(docs), carry=("lang", "source"))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near-duplicates."""
    found = (minhash.near_components(docs).filter("NOT kept")
             .select(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key")))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (minhash.row_key() == F.col("_key"))
    return docs.join(found.hint("merge"), same, "anti").select(COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources come near their target weights."""
    return mixing.emit(mixing.mix(docs.select(COLUMNS))).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the bytes they decode to."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    done = bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks)
    return done.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", toxic), ("line dedup", line_dedup), ("MinHash near-dedup", near_dedup),
          ("mixing sources", mix), ("byte-level BPE", encode)]

#: The first stage is a fitted classifier, which SQL can't express; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, cut_lineage(stage(spark, docs, sf_dir))
        drop_table(before)
    return STAGES[-1][1](spark, docs, sf_dir)
