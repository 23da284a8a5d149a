"""The registered queries of the text operators, each over its whole table, with SQL where it can be written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import public_tokenizers

from muonloom.llm import (ann, bpe, divergence, epsilon, extract, licences, lines, minhash, mixing, ngram, prefixes,
                          simhash, toxicity)
from muonloom.llm.common import table
from muonloom.llm.known_licences import LICENCES, NOTICES, SPELLINGS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


MIX_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM s),
o AS (
  SELECT *, 3 * source_size AS cap,
    row_number() OVER (ORDER BY 3 * source_size / weight, source NULLS LAST) AS k,
    sum(source_size) OVER ()::BIGINT AS total,
    coalesce(sum(3 * source_size) OVER before, 0)::BIGINT AS capped,
    sum(weight) OVER ()::BIGINT - coalesce(sum(weight) OVER before, 0)::BIGINT AS free
  FROM w
  WINDOW before AS (ORDER BY 3 * source_size / weight, source NULLS LAST
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (
  SELECT (total - capped)::DOUBLE / free AS level FROM o
  WHERE cap > ((total - capped)::DOUBLE / free) * weight ORDER BY k LIMIT 1),
t AS (
  SELECT source, source_size, least(cap::DOUBLE, (SELECT level FROM l) * weight) AS target FROM o),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 1.0 END AS rate FROM t)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (size * (floor(rate) + CASE WHEN
     ('0x' || substr(md5('mix-0|' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE
     < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
"""


@query("op3_mix_sources", MIX_SQL)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    mixed = mixing.mix(docs)
    return mixed.select("doc_id", F.col("n_words").alias("size"), "source_size", "target",
                        (F.col("n_words") * F.col("copies")).alias("taken"))


@query("op9_byte_bpe")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    done = bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


LINES_SQL = r"""
WITH l AS (
  SELECT doc_id, md5(coalesce(text, '')) AS h, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
  FROM documents),
k AS (
  SELECT *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY doc_id
"""


@query("op10_line_dedup", LINES_SQL)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    kept = lines.apply_bitmaps(docs, lines.keep_bitmaps(docs))
    return kept.select("doc_id", "n_lines", "n_dropped",
                       F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _canonical_sql(text: str) -> str:
    c = rf"regexp_replace(lower(coalesce({text}, '')), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g')"
    for pattern, same in SPELLINGS:
        c = f"regexp_replace({c}, {_text(pattern)}, {_text(same.replace('$', chr(92)))}, 'g')"
    return c


def _whole_sql(text: str) -> str:
    c = rf"regexp_replace(lower(coalesce({text}, '')), '(?m)^[ \t]*(portions )?(copyright|\(c\)|©)[^\n]*$', '', 'g')"
    c = rf"regexp_replace({c}, '(?m)^[ \t]*all rights reserved[^\w\n]*$', '', 'g')"
    return rf"trim(regexp_replace({_canonical_sql(c)}, '[ \n]+', ' ', 'g'))"


def _known_sql(texts: list[tuple[str, str]], form: str) -> str:
    rows = ", ".join(f"({_text(a)}, {_text(b)})" for a, b in texts)
    return (f"(SELECT sha256({form}) AS digest, min(licence) AS licence "
            f"FROM (VALUES {rows}) AS t(licence, text) GROUP BY 1)")


LICENCE_SQL = f"""
WITH w AS (SELECT doc_id, sha256({_whole_sql('text')}) AS digest FROM documents),
l AS (SELECT DISTINCT doc_id, sha256(trim(unnest(string_split({_canonical_sql('text')}, chr(10))))) AS digest
      FROM documents),
n AS (SELECT doc_id, list_sort(list(DISTINCT licence)) AS notices
      FROM l JOIN {_known_sql(NOTICES, 'trim(' + _canonical_sql('text') + ')')} k USING (digest) GROUP BY doc_id)
SELECT w.doc_id, w.digest, k.licence, coalesce(n.notices, []) AS notices
FROM w LEFT JOIN {_known_sql(LICENCES, _whole_sql('text'))} k USING (digest)
LEFT JOIN n ON n.doc_id = w.doc_id
"""


@query("op6_licence_scan", LICENCE_SQL)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return licences.scan(table(spark, folder, "documents").select("doc_id", "text"))


@query("op7_toxicity")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    chain = toxicity.fit(docs, toxicity.categories(table(spark, folder, "labels")))
    return toxicity.score(docs, chain).withColumn("toxic", F.col("p_toxic") >= toxicity.TOXIC)


NEAR_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN []
    WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingle
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared
  FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * shared >= 75 * (na.n + nb.n - shared)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS other FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.other, d.doc_id)) AS component_id,
  d.doc_id = least(d.doc_id, coalesce(c.other, d.doc_id)) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id
"""


@query("op5_minhash_dedup", NEAR_SQL)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_components(table(spark, folder, "documents")).drop("row_key")


@query("op2_nearest")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return ann.nearest(table(spark, folder, "embeddings"))


@query("op1_main_text")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    return (extract.extract(pages, extract.fitted(pages))
            .withColumn("n_chars", F.length("text").cast("long")))


@query("op8_fingerprints")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return simhash.close_fingerprints(simhash.fingerprints(docs))


@query("op4_lm_score")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return ngram.score(table(spark, folder, "documents").select("doc_id", "text"))


DIVERGENCE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS lang_n FROM w GROUP BY 1, 2 HAVING count(DISTINCT doc) >= 10),
v AS (SELECT lang, count(*) AS terms, sum(lang_n) AS lang_total FROM k GROUP BY lang),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k ON k.lang = w.lang AND k.term = w.term GROUP BY 1, 2, 3),
t AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY 1, 2),
g AS (SELECT x.lang, x.source, coalesce(t.total, 0) AS total FROM (SELECT DISTINCT lang, source FROM d) x
      LEFT JOIN t ON t.lang = x.lang AND t.source = x.source),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.total + 2 * v.terms)::HUGEINT AS p,
    1 + (1000000000::HUGEINT * (k.lang_n + 2)) // (v.lang_total + 2 * v.terms)::HUGEINT AS q
  FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY 1, 2, 3),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source
  LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q),
z AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM z WHERE part = 'pair' OR rank <= 10
"""


@query("op12_divergence", DIVERGENCE_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.divergences(table(spark, folder, "documents"))


VECTORS_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.95),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS other FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT x.vec_id, coalesce(n.n, 0) AS n_links, least(x.vec_id, coalesce(c.other, x.vec_id)) AS component_id,
  x.vec_id = least(x.vec_id, coalesce(c.other, x.vec_id)) AS kept
FROM embeddings x LEFT JOIN n ON n.vec_id = x.vec_id LEFT JOIN c ON c.vec_id = x.vec_id
"""


@query("op11_near_vectors", VECTORS_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return epsilon.near_vectors(table(spark, folder, "embeddings"))


@query("op13_prefix_trie")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return prefixes.prefix_trie(table(spark, folder, "conversations"))
