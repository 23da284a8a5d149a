"""Nearest neighbours by randomly rotated one-bit codes.

A vector is moved by the mean of a sample, scaled to length one, padded with
zeros and rotated at random; its code keeps the sign of every coordinate, packed
to bits, with two scalars: its length after moving and the inner product of the
vector with its own code.  These give an unbiased estimate of any inner product
with a bound on its error.  A vector is compared exactly only if the estimate
plus the bound reaches the k-th best found so far.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from muonloom.llm.common import arrow_schema, hash_sample
from muonloom.session import cut_lineage

#: Bits of a code are this multiple of the dimensions, rounded up to bytes.
SPREAD = 4
#: Standard deviations that the error bound allows for.
BOUND = 3.0
#: Vectors in a block of candidates, queries in a block of queries.
BLOCK, QUERIES = 8192, 1024
#: Vectors that the mean is taken from, at most: the first by a hash of their id.
SAMPLE = 10_000
SEED = 7


def rotation(dims: int, bits: int) -> np.ndarray:
    """The first ``dims`` rows of a random rotation of ``bits`` dimensions."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).normal(size=(bits, bits)))
    return (q * np.sign(np.diag(r)))[:dims]


def n_bits(dims: int) -> int:
    return 8 * -(-dims * SPREAD // 8)


def encode(x: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed codes, lengths after moving by ``centre``, inner products of the unit vectors with their codes."""
    bits = n_bits(x.shape[1])
    moved = x - centre
    length = np.sqrt((moved * moved).sum(axis=1))
    unit = moved / np.where(length > 0, length, 1)[:, None]
    turned = unit @ rotation(x.shape[1], bits)
    own = np.abs(turned).sum(axis=1) / np.sqrt(bits)
    return np.packbits(turned > 0, axis=1), length, np.where(own > 0, own, 1)


def usable(vector: str) -> Column:
    """Neither null nor zero, all components finite."""
    v = F.col(vector)
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce(finite & F.exists(v, lambda c: c != 0), F.lit(False))


def index(vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per block of vectors: (dims, block, ids, vectors, centre, codes, lengths, own).

    Every usable vector is indexed; blocks are hash buckets of ids, as many as the count asks for, one kind per number of
    dimensions.
    """
    rows = vectors.select("vec_id", "embedding").filter(usable("embedding") & F.col("vec_id").isNotNull())
    rows = cut_lineage(rows.select("vec_id", F.size("embedding").alias("dims"),
                                   F.col("embedding").cast("array<double>").alias("v")))
    n = rows.count()
    sample = hash_sample(rows, "vec_id", SAMPLE)
    sums = sample.select("dims", F.posexplode("v").alias("at", "x")).groupBy("dims", "at").agg(F.avg("x").alias("x"))
    centres = sums.groupBy("dims").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))),
                                                   lambda s: s["x"]).alias("centre"))
    # as long as the dimensions in use: one vector for each
    placed = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(SEED), "vec_id"), F.lit(-(-max(n, 1) // block))))
    placed = placed.join(F.broadcast(centres), "dims", "left")
    schema = ("dims int, block long, ids binary, vectors binary, centre binary, codes binary, "
              "lengths binary, own binary")
    to = arrow_schema(vectors.sparkSession, schema)

    def build(part: pa.Table) -> pa.Table:
        dims = part["dims"][0].as_py()
        order = np.argsort(part["vec_id"].to_numpy(), kind="stable")
        ids = part["vec_id"].to_numpy()[order]
        x = part["v"].combine_chunks().flatten().to_numpy().reshape(-1, dims)[order]
        centre = np.array(part["centre"][0].as_py() or [0.0] * dims)
        codes, lengths, own = encode(x, centre)
        row = {"dims": dims, "block": part["block"][0].as_py(), "ids": ids.tobytes(), "vectors": x.tobytes(),
               "centre": centre.tobytes(), "codes": codes.tobytes(), "lengths": lengths.tobytes(),
               "own": own.tobytes()}
        return pa.Table.from_pylist([row], schema=to)

    return placed.groupBy("dims", "block").applyInArrow(build, schema)


def exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products, each summed alike, so equal vectors get equal numbers."""
    return (x * q).sum(axis=1)


def search_block(row: dict, queries: list[dict], k: int):
    """Best ``k`` of a block for each query, by estimate, bound and exact check."""
    dims = row["dims"]
    ids = np.frombuffer(row["ids"], np.int64)
    x = np.frombuffer(row["vectors"], np.float64).reshape(-1, dims)
    centre = np.frombuffer(row["centre"], np.float64)
    length, own = np.frombuffer(row["lengths"]), np.frombuffer(row["own"])
    bits = n_bits(dims)
    signs = np.unpackbits(np.frombuffer(row["codes"], np.uint8).reshape(len(ids), -1), axis=1)
    signs = (signs[:, :bits].astype(np.float32) * 2 - 1) / np.float32(np.sqrt(bits))
    q = np.array([r["v"] for r in queries], np.float64)
    turned = (q @ rotation(dims, bits)).astype(np.float32)
    offsets = q @ centre
    norms = np.sqrt((q * q).sum(axis=1))
    scale = length / own
    # error of an estimate, up to the query's length
    error = BOUND * length * np.sqrt(np.maximum(1 - own * own, 0)) / own / np.sqrt(max(bits - 1, 1))
    estimates = turned @ signs.T
    for i, r in enumerate(queries):
        mine = ids == r["query_id"]
        estimate = estimates[i] * scale
        estimate[mine] = -np.inf
        n = min(k, len(ids) - int(mine.sum()))
        if n <= 0:
            continue
        near = np.argpartition(-estimate, n - 1)[:n]
        least = exact(x[near], q[i]).min()
        # the margin covers rounding of the estimates
        hopeful = estimate + error * norms[i] + offsets[i] >= least - 1e-5 * (1 + abs(least))
        hopeful[near] = True
        chosen = np.flatnonzero(hopeful & ~mine)
        score = exact(x[chosen], q[i])
        best = np.lexsort((ids[chosen], -score))[:n]
        for c in best:
            yield {"query_id": r["query_id"], "vec_id": int(ids[chosen[c]]), "score": float(score[c])}


def nearest(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest others of each vector whose id is divisible by ``every``.

    Nearest by inner product on the original vectors, ties to the smaller id; a
    query gets all others if there are fewer.  Vectors that are null or zero or
    hold null or non-finite components take no part, nor do null ids; repeated
    ids are repeated candidates, except for the query itself.  Only vectors of
    as many dimensions are compared.  Other columns are ignored.

    Every block of queries meets every block of candidates once, so the work is
    queries times candidates over the 32 bytes of a code for 64 dimensions.
    """
    blocks = cut_lineage(index(vectors))
    flat = vectors.select("vec_id", "embedding").filter(usable("embedding") & (F.col("vec_id") % every == 0))
    queries = flat.select(F.col("vec_id").alias("query_id"), F.size("embedding").alias("dims"),
                          F.col("embedding").cast("array<double>").alias("v")).dropDuplicates(["query_id"])
    parts = -(-max(queries.count(), 1) // QUERIES)
    n_blocks = (blocks.agg(F.max("block")).first()[0] or 0) + 1
    # a stated set of queries in blocks against all blocks of candidates: each pair of blocks is one bounded group
    queries = (queries.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)))
               .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long")))))
    blocks = blocks.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    schema = "query_id long, vec_id long, score double"
    to = arrow_schema(vectors.sparkSession, schema)

    def compare(candidates: pa.Table, asked: pa.Table) -> pa.Table:
        asked = asked.select(["query_id", "v"]).to_pylist()
        rows = [found for row in candidates.to_pylist() if asked for found in search_block(row, asked, k)]
        return pa.Table.from_pylist(rows, schema=to)

    keys = ["dims", "block", "part"]
    found = blocks.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(compare, schema)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
