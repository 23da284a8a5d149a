"""MinHash near-dedup by an inverted join on signature coordinates.

1. Texts with equal shingle sets form a class; from here on a class is one row.
2. Each class is posted under its (coordinate, value) pairs.  A pair of classes
   that is to match in at least T of K coordinates must share one of the K-T+1
   rarest postings of each (rarest first in one global order), so only those
   are followed, and values of a single class, which can't collide, are skipped.
3. The smallest class of a posting list is its hub.  Every class is compared
   with the hubs of its postings: that many comparisons grow with the postings,
   not with pairs.  Classes linked so far are joined to components.
4. What is left are pairs in one hub's list but in different components.  Only
   members outside the list's largest component are compared: first with one
   another inside blocks, which joins most of what belongs together, then, with
   the components that are left, with the whole list, in cells of bounded rows
   and bytes.  A cell joins components as it goes, passes over pairs that are
   joined already and returns one link per join, never all links.
Candidates with at least T collisions are confirmed on the full shingle sets.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from muonloom.llm.common import arrow_schema, as_bytes, map_rows, words_of
from muonloom.llm.components import components
from muonloom.session import cut_lineage

WORDS = 5
#: Coordinates of a signature, and collisions from which a pair is checked.  A pair of similarity
#: 0.75 has fewer with probability below 1.1e-6, one of 0.8 below 1e-9.
COORDINATES, MATCHES = 96, 51
#: Percentage of the union that two sets must share to be linked.
SIMILAR = 75
#: Members of a block on either side in step 4, and bytes of sets on either side.
BLOCK, AGAINST, CELL_BYTES = 256, 2048, 16 << 20
#: Row keys (8 bytes each) of the texts read again are broadcast up to so many.
BROADCAST_KEYS = 2_000_000
#: Shingles hashed at once.
CHUNK = 16_384

_RNG = np.random.default_rng(20_240_501)
MULTIPLIERS = _RNG.integers(0, 2 ** 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SCALES = _RNG.integers(0, 2 ** 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _RNG.integers(0, 2 ** 63, COORDINATES, dtype=np.uint64)


def shingle_hashes(text: bytes, n: int = WORDS) -> np.ndarray:
    """64-bit hashes of the n-word shingles, in order; fewer words are one shingle, no words none."""
    words = words_of(text)
    if len(words) < n:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))] if words else [], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    m = len(h) - n + 1
    s = reduce(np.add, (h[i:m + i] * MULTIPLIERS[i] for i in range(n)))
    s ^= s >> np.uint64(29)
    s *= np.uint64(0xBF58476D1CE4E5B9)
    return s ^ (s >> np.uint64(32))


def shingle_set(text: bytes) -> np.ndarray:
    return np.unique(shingle_hashes(text))


def signature(hashes: np.ndarray) -> np.ndarray:
    """Smallest value of every coordinate's hash."""
    best = np.full(COORDINATES, 2 ** 32 - 1, np.uint64)
    for i in range(0, len(hashes), CHUNK):
        part = hashes[i:i + CHUNK, None] * SCALES + SHIFTS
        best = np.minimum(best, (part >> np.uint64(32)).min(axis=0))
    return best.astype(np.uint32).view(np.int32)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets share enough: 100 * shared >= 75 * union."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < SIMILAR * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    shared = int((large[at] == small).sum())
    return 100 * shared >= SIMILAR * (len(a) + len(b) - shared)


def row_key() -> Column:
    """Names a row's id and text."""
    return F.xxhash64("doc_id", "text")


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest of the shingle set, node (a number for the set) and signature."""

    def start():
        def one(row):
            s = shingle_set(row["text"])
            out = {"doc_id": row["doc_id"], "row_key": row["row_key"], "n_shingles": len(s)}
            if len(s):
                digest = xxhash.xxh3_128_digest(s.tobytes())
                out |= {"digest": digest, "node": int.from_bytes(digest[:8], "little", signed=True),
                        "sig": signature(s)}
            return [out]

        return one

    rows = docs.select("doc_id", row_key().alias("row_key"), as_bytes("text").alias("text"))
    schema = "doc_id long, row_key long, n_shingles long, digest binary, node long, sig array<int>"
    return map_rows(rows, schema, start)


def hub_members(classes: DataFrame) -> DataFrame:
    """(hub, node): distinct hubs of the postings each class has to follow; step 2."""
    postings = classes.select("node", F.posexplode("sig").alias("at", "value")).select(
        "node", (F.shiftleft(F.col("at").cast("long"), 32) + (F.col("value").cast("long") + 2 ** 31))
        .alias("posting"))
    shared = (postings.groupBy("posting").agg(F.count("*").alias("df"), F.min("node").alias("hub"))
              .filter("df > 1"))
    prefix = COORDINATES - MATCHES + 1
    # what remains of the prefix after the postings that no other class has
    followed = F.slice(F.array_sort("shared"), F.lit(1),
                       F.greatest(F.lit(0), F.size("shared") - (COORDINATES - prefix)))
    return (postings.join(shared.hint("merge"), "posting")
            .groupBy("node").agg(F.collect_list(F.struct("df", "posting", "hub")).alias("shared"))
            .select("node", F.explode(F.array_distinct(F.transform(followed, lambda p: p["hub"]))).alias("hub")))


def confirm_hubs(members: DataFrame, full: DataFrame) -> DataFrame:
    """Links (a, b) between classes and their hubs; step 3."""
    a = full.select(F.col("node").alias("a"), F.col("sig").alias("sig_a"), F.col("set").alias("set_a"))
    b = full.select(F.col("node").alias("b"), F.col("sig").alias("sig_b"), F.col("set").alias("set_b"))
    pairs = (members.filter("node != hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
             .join(a.hint("merge"), "a").join(b.hint("merge"), "b"))

    def start():
        def one(row):
            same = sum(x == y for x, y in zip(row["sig_a"], row["sig_b"]))
            if same >= MATCHES and linked(np.frombuffer(row["set_a"], np.uint64),
                                          np.frombuffer(row["set_b"], np.uint64)):
                yield {"a": row["a"], "b": row["b"]}

        return one

    return map_rows(pairs, "a long, b long", start)


def join_cell(nodes: np.ndarray, home: np.ndarray, outside: np.ndarray, sigs: np.ndarray,
              sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links (a, b) that join the components ``home`` of a cell: those of a spanning forest."""
    links, home = [], home.copy()
    sizes = np.array([len(s) for s in sets])
    for i in np.flatnonzero(outside):
        at = np.flatnonzero((home != home[i]) & (100 * np.minimum(sizes, sizes[i]) >= SIMILAR * np.maximum(sizes, sizes[i])))
        at = at[(sigs[at] == sigs[i]).sum(axis=1) >= MATCHES]
        for k in at:
            if home[k] != home[i] and linked(sets[i], sets[k]):
                links.append((int(nodes[i]), int(nodes[k])))
                home[home == home[k]] = home[i]
    return links


def confirm_blocks(members: DataFrame, full: DataFrame, component: DataFrame, inside: bool) -> DataFrame:
    """Links between different components of one hub's list; step 4.

    ``inside`` compares the members outside the list's largest component with
    one another, block by block, where they fill more than one block; otherwise
    they meet the whole list.
    """
    node = (full.select("node", "bytes").join(component, "node", "left")
            .withColumn("component", F.coalesce("component", "node")))
    found = cut_lineage(members.join(node.hint("merge"), "node"))
    sizes = found.groupBy("hub", "component").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    blocks = lambda n, bytes_, most: F.ceil(F.greatest(n / most, bytes_ / CELL_BYTES)).cast("long")
    n, size, most = F.sum("n"), F.sum("bytes"), F.max(F.struct("n", "component", "bytes"))
    lists = (sizes.groupBy("hub").agg(n.alias("n"), size.alias("bytes"), most.alias("most"), F.count("*").alias("parts"))
             .filter("parts > 1")
             .select("hub", F.col("most")["component"].alias("largest"),
                     blocks(F.col("n") - F.col("most")["n"], F.col("bytes") - F.col("most")["bytes"], BLOCK).alias("rows"),
                     blocks(F.col("n"), F.col("bytes"), AGAINST).alias("columns")))
    if inside:
        lists = lists.filter("rows > 1")
    # written, so that the join has its own exchanges and a hub with many members is split
    open_ = found.join(cut_lineage(lists).hint("merge"), "hub")
    number = F.xxhash64("node")
    zero = F.lit(0).cast("long")
    outer = open_.filter("component != largest").withColumns(
        {"outside": F.lit(True), "i": F.pmod(number, F.col("rows"))})
    names = ["hub", "i", "j", "outside", "node", "component"]
    if inside:
        cells = outer.withColumn("j", zero).select(names)
    else:
        outer = outer.withColumn("j", F.explode(F.sequence(zero, F.col("columns") - 1)))
        others = open_.withColumns({"outside": F.lit(False), "j": F.pmod(number, F.col("columns")),
                                    "i": F.explode(F.sequence(zero, F.col("rows") - 1))})
        cells = outer.select(names).unionByName(others.select(names))
    to = arrow_schema(full.sparkSession, "a long, b long")

    def compare(cell: pa.Table) -> pa.Table:
        cell = cell.combine_chunks()
        links = []
        if cell.num_rows > 1 and pc.any(cell["outside"]).as_py():
            column = lambda name: cell[name].combine_chunks()
            links = join_cell(
                column("node").to_numpy(), column("component").to_numpy(),
                column("outside").to_numpy(zero_copy_only=False),
                column("sig").flatten().to_numpy().reshape(-1, COORDINATES),
                [np.frombuffer(s.as_buffer(), np.uint64) for s in column("set")])
        a, b = zip(*links) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())}).cast(to)

    return cells.join(full.drop("bytes").hint("merge"), "node").groupBy("hub", "i", "j").applyInArrow(compare, "a long, b long")


def join_components(first: DataFrame, more: DataFrame) -> DataFrame:
    """(node, component) of ``first`` after the links ``more``; every node of either has a row."""
    home = first.select(F.col("node").alias("a"), F.col("component").alias("home"))
    links = more.join(home.hint("merge"), "a", "left").select(F.coalesce("home", "a").alias("a"), "b")
    home = home.withColumnRenamed("a", "b")
    links = links.join(home.hint("merge"), "b", "left").select("a", F.coalesce("home", "b").alias("b"))
    joined = components(links.distinct()).select(F.col("node").alias("component"), F.col("component").alias("whole"))
    # nodes of the first round by their component, and nodes that only the second round has linked
    nodes = first.unionByName(joined.select(F.col("component").alias("node"), "component")
                              .join(first, "node", "anti"))
    return nodes.join(joined.hint("merge"), "component", "left").select(
        "node", F.coalesce("whole", "component").alias("component"))


def full_sets(docs: DataFrame, classes: DataFrame, members: DataFrame) -> DataFrame:
    """(node, sig, set, bytes) of the classes in ``members``: sorted shingle hashes, from one text of each class."""
    wanted = cut_lineage(classes.join(members.select("node").distinct().hint("merge"), "node")
                         .select("node", "sig", "row_key"))
    keys = wanted.select("row_key")
    if wanted.count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    texts = docs.select(row_key().alias("row_key"), as_bytes("text").alias("text")).join(keys, "row_key", "semi")

    def start():
        def one(row):
            return [{"row_key": row["row_key"], "set": shingle_set(row["text"]).tobytes()}]

        return one

    sets = map_rows(texts, "row_key long, set binary", start)
    return sets.join(wanted.hint("merge"), "row_key").select("node", "sig", "set", F.octet_length("set").alias("bytes"))


def link_classes(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, component) of every class that is linked with another."""
    members = cut_lineage(hub_members(classes))
    full = cut_lineage(full_sets(docs, classes, members))
    first = cut_lineage(components(confirm_hubs(members, full)))
    for inside in (True, False):
        more = cut_lineage(confirm_blocks(members, full, first, inside))
        if not more.isEmpty():
            first = cut_lineage(join_components(first, more))
    return first


def near_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and row_key (a hash of id and text) for every row of ``docs``.

    Rows whose 5-word shingle sets share at least 75 % of their union are
    linked; component_id is the smallest doc_id reachable over links.  Every
    text links with its equals.  Null and empty texts, and texts of white
    space only, have no shingles, link with nothing and are their own component.
    Rows without an id take part in links; a component without any id has a null
    one.  kept is true where doc_id is the component_id, and for all rows of a
    component without ids; rows of equal id are kept or dropped together.
    Other columns are ignored.
    """
    signed = cut_lineage(sign(docs.select("doc_id", "text")))
    classes = cut_lineage(signed.filter("n_shingles > 0").groupBy("digest").agg(
        F.first("node").alias("node"), F.first("sig").alias("sig"),
        F.min("doc_id").alias("smallest"), F.min("row_key").alias("row_key")))
    linked_nodes = cut_lineage(link_classes(docs, classes))
    named = linked_nodes.join(classes.select("node", "smallest").hint("merge"), "node")
    least = named.groupBy("component").agg(F.min("smallest").alias("component_id"))
    ids = (linked_nodes.join(least.hint("merge"), "component").select("node", "component_id"))
    by_digest = (classes.select("digest", "node", "smallest").join(ids.hint("merge"), "node", "left")
                 .select("digest", F.coalesce("component_id", "smallest").alias("component_id")))
    return (signed.select("doc_id", "n_shingles", "digest", "row_key").join(by_digest.hint("merge"), "digest", "left")
            .select("doc_id", "n_shingles", "row_key", F.when(F.col("n_shingles") == 0, F.col("doc_id"))
                    .otherwise(F.col("component_id")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"),
                                           F.col("component_id").isNull())))
