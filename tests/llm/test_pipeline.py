"""Each stage of the pipeline against a plain version of it, on its own input."""

import hashlib
from collections import Counter

import corpus_pipeline
import public_tokenizers
import tiktoken

from muonloom.llm import bpe, mixing, toxicity
from tests.llm.test_near import plain_components
from tests.llm.test_text import plain_line_dedup

FOLDER = "/root/testdata/sf0.01"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    inputs = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        inputs.append(docs)
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    inputs.append(docs)
    rows = [[tuple(r) for r in df.select("doc_id", "text").collect()] for df in inputs[:-1]]
    assert all(df.columns == corpus_pipeline.COLUMNS for df in inputs[1:5])

    chain = toxicity.fit(inputs[0], toxicity.categories(spark.read.parquet(f"{FOLDER}/labels.parquet")))
    scorer = toxicity.Scorer(chain)
    assert Counter(rows[1]) == Counter(
        r for r in rows[0] if scorer((r[1] or "").encode())[1] < toxicity.TOXIC)
    assert len(rows[1]) < len(rows[0])

    kept = plain_line_dedup(rows[1], 10)
    assert Counter(rows[2]) == Counter((i, kept[i, t]) for i, t in rows[1])

    near = {i: k for i, _, _, k in plain_components(rows[2])}
    assert Counter(rows[3]) == Counter(r for r in rows[2] if near[r[0]])

    copies = {r.doc_id: r.copies for r in mixing.mix(inputs[3]).collect()}
    assert Counter(rows[4]) == Counter({r: copies[r[0]] for r in rows[3] if copies[r[0]]})

    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=dict(bpe.read_ranks(RANKS)),
                              special_tokens={})
    got = Counter((r.doc_id, tuple(bpe.from_little_endian(r.ids)), r.decoded_sha256) for r in docs.collect())
    assert got == Counter((i, tuple(coder.encode_ordinary(t)), hashlib.sha256(t.encode()).hexdigest())
                          for i, t in rows[4])


def test_stages_take_edge_rows(spark, edge, nothing, tmp_path):
    for name, df in (("edge", edge), ("nothing", nothing)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{name}{k}")
            stage(spark, df, "/root/testdata/sf0.001").write.parquet(path)
            df = spark.read.parquet(path)
        assert df.columns[0] == "doc_id"
