"""Trie of conversation prefixes, on fingerprints that compose.

A run of turns has the fingerprint (n, s): its length and the sum of
t_i * B^i over its turns, modulo three primes.  Runs compose:
(n1, s1) * (n2, s2) = (n1 + n2, s1 + B^n1 * s2), so the fingerprint of a head
of one conversation followed by a tail of another is a few multiplications on
stored prefix sums; rebuilt texts are never put together.

1. Turns become a digest and a byte count and are sorted by range; running
   sums inside a range are composed with those of earlier ranges, so one
   conversation may fill many ranges.
2. A rebuilt conversation has one row per depth: its prefix fingerprint and a
   reference to the stored turn it ends with.  Rows of one fingerprint are a
   node.  All members must agree in the digest of the turn they refer to and
   in the parent's fingerprint; if any node's members do not, other bases are
   taken and the step is repeated.
3. A node is named by its smallest member and its depth; nodes of one name
   form a chain down to the end of that conversation.  Sums over subtrees are
   found for chains by pointer doubling, then along chains as running sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from muonloom.llm.common import arrow_schema
from muonloom.session import cut_lineage

#: Original turns at the head that may come from another conversation, at most.
HEAD = 8
#: A conversation's head comes from the one with the id that is a multiple of FAMILY.
FAMILY = 5
#: Primes of 31 bits.
PRIMES = (2_147_483_647, 2_147_483_629, 2_147_483_587)
SUMS = [f"s{i}" for i in range(len(PRIMES))]
#: Rows of a range.
RANGE = 500_000
#: Ids hashed as one piece.
PIECE = 256
#: Positions per table of powers: 2^12 entries each, for positions below 2^36.
LOW = 12


class Powers:
    """B^n modulo each prime."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.bases = [int(rng.integers(1 << 29, p - 1)) for p in PRIMES]

    def tables(self) -> list[list[np.ndarray]]:
        out = []
        for base, p in zip(self.bases, PRIMES):
            rows, step = [], base
            for _ in range(3):
                row = np.ones(1 << LOW, np.int64)
                for i in range(1, 1 << LOW):
                    row[i] = int(row[i - 1]) * step % p
                rows.append(row)
                step = int(row[-1]) * step % p
            out.append(rows)
        return out

    def at(self, i: int, n: int) -> int:
        """B^n of prime ``i``; n may be negative."""
        return pow(self.bases[i], n, PRIMES[i])


def power(table: list[np.ndarray], n: np.ndarray, p: int) -> np.ndarray:
    mask = (1 << LOW) - 1
    return table[0][n & mask] * table[1][(n >> LOW) & mask] % p * table[2][n >> (2 * LOW)] % p


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, d1, d2, bytes): stored turns without their texts.

    Rows without a conv_id are left out.  d1 and d2 are 120 bits of the SHA-256
    of role and text, with the role's length in front; null counts as empty.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit("|"), role, text), 256)
    half = lambda at: (F.conv(F.substring(digest, at, 15), 16, 10)).cast("long")
    return conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        half(1).alias("d1"), half(16).alias("d2"), F.octet_length(text).cast("long").alias("bytes"))


def running(rows: DataFrame, key: str, order: Sequence[Column], sums: Sequence[str],
            powers: Powers | None = None, each: int = RANGE) -> DataFrame:
    """Adds ``place`` (from 1) and turns ``sums`` into running sums, both within ``key`` (a long) along ``order``.

    Rows are sorted by range, so a key of any size spreads over ranges.  Each
    range is summed on its own; only the sums of the last key of each range go
    to the driver, and what they add up to goes back by broadcast: one row per
    range.  With ``powers`` row i counts B^(i-1) times, modulo each prime, and
    the sum before the row is added as ``<name>_before``.
    """
    spark = rows.sparkSession
    parts = max(1, -(-rows.count() // each))
    sorted_rows = (rows.repartitionByRange(parts, F.col(key), *order).sortWithinPartitions(F.col(key), *order)
                   .withColumn("_range", F.spark_partition_id()))
    names = sorted_rows.columns
    earlier = [f"{s}_before" for s in sums] if powers else []
    schema = ", ".join([f"{n} {t}" for n, t in sorted_rows.dtypes] + [f"{n} long" for n in [*earlier, "place"]])
    to = arrow_schema(spark, schema)
    where = [names.index(s) for s in sums]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = powers.tables() if powers else None
        last, n0, s0 = None, 0, [0] * len(sums)
        for b in batches:
            if not b.num_rows:
                continue
            k = b[key].to_numpy()
            new = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            start = np.repeat(new, np.diff(np.append(new, len(k))))
            carried = start == 0 if last is not None and k[0] == last else np.zeros(len(k), bool)
            place = np.arange(len(k)) - start + np.where(carried, n0, 0)
            columns = list(b.columns)
            for i, at in enumerate(where):
                x = columns[at].to_numpy()
                if tables:
                    x = x * power(tables[i], place, PRIMES[i]) % PRIMES[i]
                total = np.cumsum(x)
                total = total - np.where(start > 0, total[start - 1], 0) + np.where(carried, s0[i], 0)
                if tables:
                    total %= PRIMES[i]
                    columns.append(pa.array((total - x) % PRIMES[i]))
                s0[i] = int(total[-1])
                columns[at] = pa.array(total)
            last, n0 = k[-1], int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*columns, pa.array(place + 1)], schema=to)

    done = cut_lineage(sorted_rows.mapInArrow(run, schema))
    ends = done.groupBy("_range").agg(F.max_by(F.struct(key, "place", *sums), F.struct(key, "place")).alias("e"))
    carry, before = [], None
    for number, e in sorted((r["_range"], r["e"]) for r in ends.collect()):
        if before is not None:
            carry.append((number, *before))
        n, s = e["place"], [e[c] for c in sums]
        if before is not None and before[0] == e[key]:
            n, s = n + before[1], [_compose(before, i, v, powers) for i, v in enumerate(s)]
        before = (e[key], n, *s)
    out = done
    if carry:
        columns = [f"_c{i}" for i in range(len(sums))]
        mult = [(powers.at(i, c[2]) if powers else 1) for c in carry for i in range(len(sums))]
        table = [(*c, *mult[j * len(sums):(j + 1) * len(sums)]) for j, c in enumerate(carry)]
        factors = [f"_m{i}" for i in range(len(sums))]
        more = spark.createDataFrame(table, f"_range int, {key} long, _n long, "
                                     + ", ".join(f"{c} long" for c in columns + factors))
        out = out.join(F.broadcast(more), ["_range", key], "left")
        out = out.withColumn("place", F.col("place") + F.coalesce("_n", F.lit(0)))
        for at, s in enumerate([*sums, *earlier]):
            i = at % len(sums)
            value = F.col(columns[i]) + F.col(factors[i]) * F.col(s)
            value = value % PRIMES[i] if powers else value
            out = out.withColumn(s, F.when(F.col("_n").isNotNull(), value).otherwise(F.col(s)))
    return out.select(*[n for n in names if n != "_range"], *earlier, "place")


def _compose(before: tuple, i: int, s: int, powers: Powers | None) -> int:
    if powers is None:
        return before[2 + i] + s
    return (before[2 + i] + powers.at(i, before[1]) * s) % PRIMES[i]


def _mod(value: Column, i: int) -> Column:
    return F.pmod(value, F.lit(PRIMES[i]))


def _packed(parts: Sequence[Column]) -> list[Column]:
    """A fingerprint as two longs."""
    return [F.shiftleft(parts[0], 31) + parts[1], parts[2]]


def rebuilt(turns: DataFrame, powers: Powers) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations as (rows, whole).

    Rows, one per conversation and depth: conv_id, depth, fingerprint (k1, k2), the parent's (q1, q2), and of the
    stored turn it ends with the digest (d1, d2) and bytes.  Whole, one per conversation: conv_id, depth, k1, k2.
    """
    values = [F.pmod(F.xxhash64(F.lit(i), "d1", "d2"), F.lit(p - 1)) + 1 for i, p in enumerate(PRIMES)]
    prefix = running(turns.select("*", *[v.alias(s) for s, v in zip(SUMS, values)]), "conv_id",
                     [F.col("turn").asc_nulls_first(), F.col("d1"), F.col("d2")], SUMS, powers)
    prefix = cut_lineage(prefix.drop("turn"))
    before = [f"{s}_before" for s in SUMS]
    piece = F.struct("place", *SUMS, *before, "d1", "d2", "bytes")
    convs = prefix.groupBy("conv_id").agg(
        F.max("place").alias("n"), F.max_by(F.struct(*SUMS), "place").alias("whole"),
        F.array_sort(F.collect_list(F.when(F.col("place") <= HEAD, piece))).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEAD + 1)).cast("int")
    convs = cut_lineage(convs.withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % FAMILY}))
    bases = convs.select(F.col("conv_id").alias("base"), F.col("head").alias("base_head"))
    plans = convs.join(bases.hint("merge"), "base", "left").withColumn(
        "taken", F.when(F.col("base_head").isNull(), F.lit(0)).otherwise(F.least("h", F.size("base_head"))))

    def first(head: str, n: Column, s: str) -> Column:
        """Prefix sum of the first n turns."""
        return F.when(n > 0, F.get(head, n - 1)[s]).otherwise(F.lit(0).cast("long"))

    # a tail moves up by h - taken places: its sums are multiplied by B^(taken - h)
    for i, s in enumerate(SUMS):
        inverses = F.array(*[F.lit(powers.at(i, -k)) for k in range(HEAD + 1)])
        shift = F.get(inverses, F.col("h") - F.col("taken")).cast("long")
        gone = first("head", F.least(F.col("h"), F.size("head")), s)
        plans = plans.withColumns({
            f"shift{i}": shift, f"start{i}": _mod(first("base_head", F.col("taken"), s) - _mod(shift * gone, i), i)})
    own = F.col("n") > F.col("h")
    ends = [F.when(own, _mod(F.col(f"start{i}") + F.col(f"shift{i}") * F.col("whole")[s], i))
            .otherwise(first("base_head", F.col("taken"), s)) for i, s in enumerate(SUMS)]
    k1, k2 = _packed(ends)
    moves = [f"{n}{i}" for n in ("shift", "start") for i in range(len(SUMS))]
    plans = cut_lineage(plans.select(
        "conv_id", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("depth"),
        k1.alias("k1"), k2.alias("k2"), *moves, F.slice("base_head", F.lit(1), F.col("taken")).alias("borrowed")))

    def named(sums: list[Column], earlier: list[Column]) -> list[Column]:
        return [c.alias(n) for c, n in zip(_packed(sums) + _packed(earlier), ("k1", "k2", "q1", "q2"))]

    t = plans.select("conv_id", F.explode("borrowed").alias("t")).select("conv_id", "t.*")
    heads = t.select("conv_id", F.col("place").alias("depth"),
                     *named([F.col(s) for s in SUMS], [F.col(s) for s in before]), "d1", "d2", "bytes")
    moved = lambda names: [_mod(F.col(f"start{i}") + F.col(f"shift{i}") * F.col(s), i) for i, s in enumerate(names)]
    t = prefix.join(plans.select("conv_id", "h", "taken", *moves).hint("merge"), "conv_id").filter("place > h")
    tails = t.select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("depth"),
                     *named(moved(SUMS), moved(before)), "d1", "d2", "bytes")
    return heads.unionByName(tails), plans.select("conv_id", "depth", "k1", "k2")


def nodes_of(rows: DataFrame, whole: DataFrame) -> DataFrame:
    """One row per fingerprint and depth, with ``agreed``: whether all members have that parent and last turn."""
    same = [F.min(c) == F.max(c) for c in ("d1", "d2", "q1", "q2")]
    found = rows.groupBy("depth", "k1", "k2").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"),
        F.max("q1").alias("q1"), F.max("q2").alias("q2"), (same[0] & same[1] & same[2] & same[3]).alias("agreed"))
    zero = F.lit(0).cast("long")
    root = whole.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0").select(
        *[zero.alias(c) for c in ("depth", "k1", "k2")], "conv_id", "n_convs", zero.alias("bytes"),
        *[F.lit(None).cast("long").alias(c) for c in ("q1", "q2")], F.lit(True).alias("agreed"))
    return found.unionByName(root)


def ends_of(whole: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256): digest of the ascending, comma-joined ids of the conversations that end there.

    Ids are sorted by range and joined to short pieces, so a node where very
    many end is spread out; then the pieces of a node stream through one hash.
    """
    key = ["depth", "k1", "k2"]
    schema = "depth long, k1 long, k2 long, first long, ids string"
    to = arrow_schema(whole.sparkSession, schema)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, ids = [b[c].to_numpy() for c in key], b["conv_id"].to_numpy()
            if not len(ids):
                continue
            new = np.concatenate([[True], np.any([c[1:] != c[:-1] for c in at], axis=0)])
            start = np.flatnonzero(new)
            start = np.concatenate([np.arange(i, j, PIECE) for i, j in zip(start, np.append(start[1:], len(ids)))])
            text = [",".join(map(str, ids[i:j].tolist())) for i, j in zip(start, np.append(start[1:], len(ids)))]
            yield pa.RecordBatch.from_arrays([*[pa.array(c[start]) for c in at], pa.array(ids[start]), pa.array(text)],
                                             schema=to)

    out = "depth long, k1 long, k2 long, ends_sha256 string"
    done = arrow_schema(whole.sparkSession, out)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for b in batches:
            rows = []
            for *name, ids in zip(*[b[c].to_pylist() for c in [*key, "ids"]]):
                if name == last:
                    state.update(b"," + ids.encode())
                else:
                    if last is not None:
                        rows.append((*last, state.hexdigest()))
                    last, state = name, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(done.names, r)) for r in rows], schema=done)
        if last is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(done.names, (*last, state.hexdigest())))], schema=done)

    parts = max(1, -(-whole.count() // RANGE))
    order = [*key, "conv_id"]
    short = whole.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(pieces, schema)
    return (short.repartition(*key).sortWithinPartitions(*key, "first").select(*key, "ids").mapInArrow(digest, out))


def subtree_totals(chains: DataFrame) -> DataFrame:
    """(conv_id, saved, leaves): sums over each chain and all below it.

    ``chains``: conv_id, up (the chain it hangs on), saved, leaves.  Each round
    adds what lies up to twice as deep, so rounds grow with the logarithm of
    the chains above one another.
    """
    state = cut_lineage(chains.select("conv_id", "up", "saved", "leaves"))
    while not state.filter("up IS NOT NULL").isEmpty():
        gain = state.filter("up IS NOT NULL").groupBy(F.col("up").alias("conv_id")).agg(
            F.sum("saved").alias("more_saved"), F.sum("leaves").alias("more_leaves"))
        above = state.filter("up IS NOT NULL").select(F.col("conv_id").alias("up"), F.col("up").alias("next"))
        state = cut_lineage(
            state.join(gain.hint("merge"), "conv_id", "left").join(above.hint("merge"), "up", "left").select(
                "conv_id", F.col("next").alias("up"),
                (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"),
                (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves")))
    return state.drop("up")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations.

    Turns are ordered by turn, null first, then by a digest of role and text;
    null role or text counts as empty.  Conversation c is rebuilt from the first
    h turns of conversation c - c % 5 (all if fewer, none if absent) and its own
    turns after its first h, with h = crc32(c) % 9.  A node of depth d stands
    for the conversations (members) that begin with the same d turns; the root
    has depth 0.  Columns: conv_id (smallest member), depth, parent_conv_id (the
    parent's conv_id; null for the root), n_convs (members), n_children,
    n_leaves (childless nodes in the subtree), saved_tokens (over the subtree,
    members but one times the bytes of the last text) and ends_sha256 (digest
    of the members of d turns).  Rows without a conv_id take no part; an empty
    table has no node.  Repeated turns are turns.  Other columns are ignored.
    """
    turns = cut_lineage(turns_of(conversations))
    for seed in count(1):
        rows, whole = rebuilt(turns, Powers(seed))
        nodes = cut_lineage(nodes_of(rows, whole))
        if nodes.filter("NOT agreed").isEmpty():
            break
    key = ["depth", "k1", "k2"]
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("q1"), F.col("k2").alias("q2"),
                           F.col("conv_id").alias("parent_conv_id"))
    tree = (nodes.join(ends_of(whole).hint("merge"), key, "left")
            .join(parents.hint("merge"), ["depth", "q1", "q2"], "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "ends_sha256",
                    ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved")))
    tree = cut_lineage(tree)
    children = (tree.filter("parent_conv_id IS NOT NULL")
                .groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"))
                .agg(F.count("*").alias("n_children")))
    tree = cut_lineage(tree.join(children.hint("merge"), ["conv_id", "depth"], "left").na.fill(0, ["n_children"])
                       .withColumn("leaves", (F.col("n_children") == 0).cast("long")))
    chains = cut_lineage(tree.groupBy("conv_id").agg(
        F.min("depth").alias("top"), F.min_by("parent_conv_id", "depth").alias("up"),
        F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves")))
    totals = subtree_totals(chains)
    hung = (chains.filter("up IS NOT NULL").select("conv_id", "up", "top").join(totals.hint("merge"), "conv_id")
            .groupBy(F.col("up").alias("conv_id"), (F.col("top") - 1).alias("depth"))
            .agg(F.sum("saved").alias("hung_saved"), F.sum("leaves").alias("hung_leaves")))
    tree = tree.join(hung.hint("merge"), ["conv_id", "depth"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "ends_sha256",
        (F.col("leaves") + F.coalesce("hung_leaves", F.lit(0))).alias("n_leaves"),
        (F.col("saved") + F.coalesce("hung_saved", F.lit(0))).alias("saved_tokens"))
    summed = running(cut_lineage(tree), "conv_id", [F.col("depth").desc()], ["n_leaves", "saved_tokens"])
    return summed.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                         F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
