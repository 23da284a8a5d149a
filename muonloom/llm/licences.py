"""Licence scan by canonical digests: texts that read the same have the same digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from muonloom.llm.known_licences import LICENCES, NOTICES, SPELLINGS

#: What follows "copyright" in prose, where a wrapped line may begin with it: nothing, or no name of an owner.
PROSE = (r"[,;.]?[ \t\r]*$|[\p{L}-]|[,;.]?[ \t]+(?:notices?|holders?|owners?|laws?|licen[sc]es?|interests?|patents?"
         r"|trademarks?|permissions?|statements?|disclaimers?|rights?|protection|claims?|grants?|infringements?|and|or|in"
         r"|on|under|that|which)(?![\p{L}\p{N}])")
#: A line that only says whose copyright it is.
COPYRIGHT_LINE = rf"(?m)^[ \t]*(portions )?(copyright(?!{PROSE})|\(c\)|©)[^\n]*$"
RESERVED_LINE = r"(?m)^[ \t]*all rights reserved[^\w\n]*$"


def canonical(text: Column) -> Column:
    """Lower case, equivalent spellings, one space for anything but letters and digits; lines are kept."""
    c = F.lower(F.coalesce(text, F.lit("")))
    c = F.regexp_replace(c, r"[^\p{L}\p{N}\n]+", " ")
    for pattern, same in SPELLINGS:
        c = F.regexp_replace(c, pattern, same)
    return c


def canonical_whole(text: Column) -> Column:
    """Canonical text as one line, without copyright lines."""
    c = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "")
    c = F.regexp_replace(c, RESERVED_LINE, "")
    return F.trim(F.regexp_replace(canonical(c), r"[ \n]+", " "))


def known(spark: SparkSession, texts: list[tuple[str, str]], form) -> DataFrame:
    """(digest, licence) of known texts, by the same canonical form as the documents."""
    rows = spark.createDataFrame(texts, "licence string, text string")
    digests = rows.select(F.sha2(form(F.col("text")), 256).alias("digest"), "licence")
    return digests.groupBy("digest").agg(F.min("licence").alias("licence"))


def scan(docs: DataFrame, licences: list[tuple[str, str]] = LICENCES,
         notices: list[tuple[str, str]] = NOTICES) -> DataFrame:
    """doc_id, digest, licence and notices of every row of ``docs``.

    ``licence`` is the licence whose text the whole document is, up to case,
    punctuation, white space, copyright lines and equivalent spellings; null if
    none.  ``notices`` are the sorted licences of the one-line notices that
    stand in it as whole lines; empty if none.  The known texts are parameters
    of a few dozen rows, joined by digest.  Null text counts as empty, which no
    licence is; null ids and repeated rows keep their row; other columns are
    ignored.  Documents are never shuffled: both joins carry digests only.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"),
                       F.sha2(canonical_whole(F.col("text")), 256).alias("digest"))
    whole = rows.join(known(spark, licences, canonical_whole), "digest", "left")

    def line_form(text: Column) -> Column:
        return F.trim(canonical(text))

    line = F.explode(F.array_distinct(F.split(canonical(F.col("text")), "\n")))
    found = (docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"), line.alias("line"))
             .select("_id", "_hash", F.sha2(F.trim("line"), 256).alias("digest"))
             .join(known(spark, notices, line_form).withColumnRenamed("licence", "notice"), "digest")
             .groupBy("_id", "_hash").agg(F.sort_array(F.collect_set("notice")).alias("notices")))
    return whole.join(found, F.col("doc_id").eqNullSafe(F.col("_id"))
                      & F.col("text_hash").eqNullSafe(F.col("_hash")), "left") \
        .select("doc_id", "digest", "licence", F.coalesce("notices", F.array().cast("array<string>")).alias("notices"))
