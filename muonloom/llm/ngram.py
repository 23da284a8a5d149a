"""Bigram language model by deleted interpolation.

p(w | v) = a * c(v w) / c(v) + b * c(w) / N + d / (V + 1), with weights a, b, d
for each bucket of c(v).  The weights are learned by expectation-maximisation
on documents that are deleted from the counts meanwhile.

Counts meet texts by hashes in packed form.  Documents are taken in batches of
some hundred thousand tokens; a batch asks for the counts of its distinct words and
bigrams, so a pair of words that stands in every document is asked for once per
batch.  Requests are cut by hash into partitions, as many as the text asks for;
a partition adds up its keys over all batches and answers each batch with
counts in the order of its keys.  A batch and its answers then meet by batch
number, which bounds every group by the size of a batch.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from muonloom.llm.common import arrow_schema, as_bytes, words_of
from muonloom.session import cut_lineage

#: Tokens of a batch, and bytes of text for each partition of the counts.
BATCH_TOKENS, PARTITION_BYTES = 700_000, 14 << 20
#: One of so many training documents is deleted from the counts to learn the weights.
DELETED = 20
#: Rounds of expectation-maximisation at most, and the change of weights that ends it.
ROUNDS, STILL = 25, 1e-3
#: Weights of bigram, unigram and uniform part to begin with; they count as so many tokens in every bucket.
FIRST, PRIOR = (0.4, 0.55, 0.05), 10.0
#: Buckets double in context frequency; the first is for contexts never seen.
BUCKETS = 48

END = np.uint64(xxhash.xxh3_64_intdigest(b"end of text "))
START = np.uint64(xxhash.xxh3_64_intdigest(b"start of text "))
HELD_OUT, TRAIN, DROPPED = 0, 1, 2

REQUEST = "batch long, kind int, part int, keys binary, counts binary, role int, proof long"
ANSWER = "batch long, kind int, part int, counts binary, deleted binary, role int, proof long"
TEXTS = "batch long, role int, proof long, ids binary, valid binary, lengths binary, words binary, places binary"


def role_of(doc_id) -> int:
    """Whether a document is held out, trained on, or trained on and deleted while weights are learned.

    By the crc32 of the id as text; a null id counts as empty text.
    """
    c = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if c % 10 == 0:
        return HELD_OUT
    return DROPPED if c // 10 % DELETED == 0 else TRAIN


def planes(values: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers byte by byte, lowest first: zeros of small numbers lie together and compress."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def bigram_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    s = left * np.uint64(0x9E3779B97F4A7C15) + right
    s ^= s >> np.uint64(29)
    s *= np.uint64(0xBF58476D1CE4E5B9)
    return s ^ (s >> np.uint64(32))


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values, and the place of each value among them."""
    place, seen = pd.factorize(values)
    order = np.argsort(seen, kind="stable")
    rank = np.empty(len(seen), np.int64)
    rank[order] = np.arange(len(seen))
    return seen[order], rank[place]


class Batch:
    """Documents of one role with their tokens."""

    def __init__(self, number: int, role: int):
        self.number, self.role = number, role
        self.ids: list[int | None] = []
        self.hashes: list[np.ndarray] = []
        self.tokens = 0

    def add(self, doc_id, words: list[bytes]) -> None:
        h = np.empty(len(words) + 1, np.uint64)
        h[:-1] = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        h[-1] = END
        self.ids.append(doc_id)
        self.hashes.append(h)
        self.tokens += len(h)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct words with START, the place of every token, and tokens per document."""
        lengths = np.array([len(h) for h in self.hashes], np.int64)
        found, place = distinct(np.concatenate([np.array([START], np.uint64), *self.hashes]))
        return found, place, lengths


def contexts(place: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Place of the word before each token; ``place`` begins with that of START."""
    before = place[:-1].copy()
    before[0] = place[0]
    firsts = np.cumsum(lengths)[:-1]
    before[firsts] = place[0]
    return before


def bigrams(words: np.ndarray, place: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct bigram keys, and the place of each token's bigram among them."""
    pairs, at = distinct(contexts(place, lengths) * len(words) + place[1:])
    keys = bigram_keys(words[pairs // len(words)], words[pairs % len(words)])
    order = np.argsort(keys, kind="stable")
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.arange(len(keys))
    return keys[order], rank[at]


def batches_of(rows: Iterator[pa.RecordBatch]) -> Iterator[Batch]:
    """Documents of a task in batches, the same ones whenever the task reads the same rows."""
    task, made = TaskContext.get().partitionId(), 0
    open_: dict[int, Batch] = {}
    for b in rows:
        ids, texts = b.column("doc_id").to_pylist(), b.column("text")
        for doc_id, text in zip(ids, texts):
            role = role_of(doc_id)
            if role not in open_:
                open_[role] = Batch((task << 32) + made, role)
                made += 1
            open_[role].add(doc_id, words_of(text.as_py()))
            if open_[role].tokens >= BATCH_TOKENS:
                yield open_.pop(role)
    for role in sorted(open_):
        yield open_.pop(role)


def proof_of(words: np.ndarray, tokens: int) -> int:
    """Tells two contents of a batch apart."""
    return int(np.bitwise_xor.reduce(words) ^ np.uint64(tokens)) >> 1


def _requests(parts: int, schema: pa.Schema):
    def cut(keys: np.ndarray, counts: np.ndarray, kind: int, batch: Batch, proof: int) -> Iterator[dict]:
        part = ((keys >> np.uint64(40)) * np.uint64(parts) >> np.uint64(24)).astype(np.int64)
        edges = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
        for a, b in zip(edges[:-1], edges[1:]):
            yield {"batch": batch.number, "kind": kind, "part": int(part[a]), "keys": keys[a:b].tobytes(),
                   "counts": planes(counts[a:b]), "role": batch.role, "proof": proof}

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(rows):
            words, place, lengths = batch.words()
            proof = proof_of(words, batch.tokens)
            counts = np.bincount(place, minlength=len(words))
            counts[place[0]] = len(lengths)  # contexts at the start
            keys, at = bigrams(words, place, lengths)
            out = [*cut(words, counts, 1, batch, proof),
                   *cut(keys, np.bincount(at, minlength=len(keys)), 2, batch, proof)]
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def _answers(schema: pa.Schema):
    """Add up the keys of one partition and answer each batch.

    Rows of kind 0 have sums in ``proof``, by ``part``: tokens and distinct
    words, with the deleted documents and without.
    """

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        keys = [np.frombuffer(r["keys"], np.uint64) for r in rows]
        counts = [from_planes(r["counts"]) for r in rows]
        found, place = distinct(np.concatenate(keys))
        total, deleted = np.zeros(len(found), np.int64), np.zeros(len(found), np.int64)
        start = 0
        for r, c in zip(rows, counts):
            at = place[start:start + len(c)]
            start += len(c)
            if r["role"] != HELD_OUT:
                total[at] += c  # keys of a batch are distinct
            if r["role"] == DROPPED:
                deleted[at] += c
        out, start = [], 0
        for r, c in zip(rows, counts):
            at = place[start:start + len(c)]
            start += len(c)
            out.append({"batch": r["batch"], "kind": r["kind"], "part": r["part"], "counts": planes(total[at]),
                        "deleted": planes(deleted[at]) if r["role"] == DROPPED else None,
                        "role": r["role"], "proof": r["proof"]})
        if rows and rows[0]["kind"] == 1:
            real = found != START
            rest = total - deleted
            for i, c in enumerate((total[real], total[real] > 0, rest[real], rest[real] > 0)):
                out.append({"batch": -1, "kind": 0, "part": i, "role": -1, "proof": int(c.sum())})
        return pa.Table.from_pylist(out, schema=schema)

    return run


def _texts(schema: pa.Schema, roles: tuple[int, ...]):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(rows):
            if batch.role not in roles:
                continue
            words, place, lengths = batch.words()
            ids = np.array([0 if i is None else i for i in batch.ids], np.int64)
            valid = np.array([i is not None for i in batch.ids], np.uint8)
            yield pa.RecordBatch.from_pylist([{
                "batch": batch.number, "role": batch.role, "proof": proof_of(words, batch.tokens),
                "ids": ids.tobytes(), "valid": valid.tobytes(), "lengths": lengths.tobytes(),
                "words": words.tobytes(), "places": planes(place)}], schema=schema)

    return run


class Answered:
    """Tokens of a batch with their counts, deleted documents taken out if asked."""

    def __init__(self, texts: pa.Table, answers: pa.Table, without_deleted: bool):
        (text,), replies = texts.to_pylist(), answers.to_pylist()
        if any(r["proof"] != text["proof"] for r in replies):
            raise RuntimeError("documents came in another order than before; write them to a table first")
        replies.sort(key=lambda r: (r["kind"], r["part"]))

        def gather(kind: int) -> np.ndarray:
            mine = [r for r in replies if r["kind"] == kind]
            c = np.concatenate([from_planes(r["counts"]) for r in mine])
            return c - np.concatenate([from_planes(r["deleted"]) for r in mine]) if without_deleted else c

        self.ids = np.frombuffer(text["ids"], np.int64)
        self.valid = np.frombuffer(text["valid"], np.uint8)
        self.lengths = np.frombuffer(text["lengths"], np.int64)
        words, place = np.frombuffer(text["words"], np.uint64), from_planes(text["places"])
        unigram, bigram = gather(1), gather(2)
        _, at = bigrams(words, place, self.lengths)
        self.word = unigram[place[1:]]
        self.context = unigram[contexts(place, self.lengths)]
        self.pair = bigram[at]
        self.role = text["role"]

    def parts(self, n: int, v: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Bucket, bigram, unigram and uniform probability of each token."""
        bucket = np.where(self.context > 0, 1 + np.log2(np.maximum(self.context, 1)).astype(np.int64), 0)
        p2 = self.pair / np.maximum(self.context, 1)
        p1 = self.word / max(n, 1)
        return np.minimum(bucket, BUCKETS - 1), p2, p1, 1.0 / (v + 1)


def learn(events: DataFrame, uniform: float) -> np.ndarray:
    """Weights per bucket by expectation-maximisation over (bucket, p2, p1, n).

    One aggregate per round, of a row per bucket.
    """
    weights = np.tile(np.array(FIRST), (BUCKETS, 1))
    for _ in range(ROUNDS):
        tables = [F.array(*[F.lit(float(w)) for w in weights[:, k]]) for k in range(3)]
        share = [F.element_at(t, F.col("bucket") + 1) * p
                 for t, p in zip(tables, (F.col("p2"), F.col("p1"), F.lit(uniform)))]
        whole = share[0] + share[1] + share[2]
        sums = events.groupBy("bucket").agg(*[F.sum(F.col("n") * s / whole).alias(f"s{k}")
                                              for k, s in enumerate(share)]).collect()
        new = weights.copy()
        for r in sums:
            found = np.array([r["s0"], r["s1"], r["s2"]]) + PRIOR * np.array(FIRST)
            new[r["bucket"]] = found / found.sum()
        change = np.abs(new - weights).max()
        weights = new
        if change < STILL:
            break
    return weights


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs``.

    Learns from documents whose crc32 of the id as text is not divisible by 10.
    score is the model's log10 probability of the whole text with its end,
    base_score that of smoothed single words.  Null and empty texts are a lone
    end; null ids are held out; repeated rows count as often as they come;
    without training text every token has the uniform probability.  Other
    columns are ignored.

    ``docs`` is read twice and must give the same rows in the same order, as a
    table of files does; otherwise the job stops with an error.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes("text").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // PARTITION_BYTES))
    to_answer = arrow_schema(spark, ANSWER)
    answers = cut_lineage(rows.mapInArrow(_requests(parts, arrow_schema(spark, REQUEST)), REQUEST)
                          .groupBy("kind", "part").applyInArrow(_answers(to_answer), ANSWER))
    sums = {r["part"]: r["s"] for r in answers.filter("kind = 0").groupBy("part").agg(F.sum("proof").alias("s")).collect()}
    n, v, n_rest, v_rest = (sums.get(i, 0) for i in range(4))

    def batches(roles: tuple[int, ...]):
        texts = rows.mapInArrow(_texts(arrow_schema(spark, TEXTS), roles), TEXTS).groupBy("batch")
        return texts.cogroup(answers.filter(F.col("role").isin(*roles)).groupBy("batch"))

    events = "bucket int, p2 double, p1 double, n long"
    to_events = arrow_schema(spark, events)

    def events_of(texts: pa.Table, replies: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return to_events.empty_table()
        bucket, p2, p1, _ = Answered(texts, replies, True).parts(n_rest, v_rest)
        alike = pd.DataFrame({"bucket": bucket.astype(np.int32), "p2": p2, "p1": p1}) \
            .groupby(["bucket", "p2", "p1"], sort=False).size().reset_index(name="n")
        return pa.Table.from_pandas(alike, preserve_index=False).cast(to_events)

    seen = cut_lineage(batches((DROPPED,)).applyInArrow(events_of, events))
    weights = learn(seen, 1.0 / (v_rest + 1))

    scores = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
              "base_score double, score double")
    to_scores = arrow_schema(spark, scores)

    def scores_of(texts: pa.Table, replies: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return to_scores.empty_table()
        batch = Answered(texts, replies, False)
        bucket, p2, p1, p0 = batch.parts(n, v)
        w = weights[bucket]
        token = np.log10(w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] * p0)
        base = np.log10((batch.word + 0.1) / (n + 0.1 * (v + 1)))
        starts = np.concatenate([[0], np.cumsum(batch.lengths)[:-1]])
        docs_ = len(batch.ids)
        return pa.Table.from_arrays([
            pa.array(batch.ids, mask=batch.valid == 0), pa.array([batch.role == HELD_OUT] * docs_),
            pa.array(batch.lengths), pa.array(np.add.reduceat((batch.word > 0).astype(np.int64), starts)),
            pa.array([n] * docs_, pa.int64()), pa.array(np.add.reduceat(base, starts)),
            pa.array(np.add.reduceat(token, starts))], schema=to_scores)

    return batches((HELD_OUT, TRAIN, DROPPED)).applyInArrow(scores_of, scores)
