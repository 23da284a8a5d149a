"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors with cosine of at least c lie within eps = sqrt(2 - 2c).

1. Equal vectors form a class; from here on a class is one row with a weight.
2. Classes are turned onto principal axes (fitted on a bounded sample; any
   rotation keeps distances, so the fit decides speed and never results) and
   sorted by the grid cells, eps wide, of the leading axes.  The order is cut
   into sequences of bounded size, each one row of packed vectors.
3. Sequences are joined recursively as intervals of the order: eight times
   wider ones first; a pair of intervals goes on to its parts unless their
   boxes on the leading axes are provably further apart than eps.
4. What is left of the recursion runs inside a pair of sequences, by halves:
   distant halves are skipped by boxes and balls, halves that provably lie
   within eps of each other are counted as a whole, the rest is compared in
   double precision.  A pair of sequences returns one row per linked class:
   how many others it is linked with, and one link of a spanning forest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from muonloom.llm.ann import usable
from muonloom.llm.common import arrow_schema, hash_sample
from muonloom.llm.components import components
from muonloom.operators.ranking import with_rank
from muonloom.session import cut_lineage

SIMILAR = 0.95
#: Vectors the axes are fitted on, at most.
SAMPLE = 5_000
#: Leading axes of the grid.
AXES = 8
#: Classes of a sequence, sequences under a wider interval, and classes compared at once.
SEQUENCE, FAN, LEAF = 8192, 8, 512
#: Slack for rounding, far above that of a few thousand dimensions in double precision.
SLACK = 1e-9


def axes_of(sample: DataFrame) -> dict[int, np.ndarray]:
    """Principal axes (columns, by falling spread) for each number of dimensions in the sample."""
    rows: dict[int, list] = {}
    for (v,) in sample.select("unit").collect():
        rows.setdefault(len(v), []).append(v)
    out = {}
    for dims, vectors in rows.items():
        x = np.array(vectors)
        x -= x.mean(axis=0)
        out[dims] = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    return out


def unit(vector: str) -> Column:
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(vector, lambda x: x / norm)


def classes_of(vectors: DataFrame) -> DataFrame:
    """(h1, h2, v, dims, weight, smallest) of the distinct usable vectors."""
    keyed = vectors.filter(usable("embedding")).select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return (keyed.select(*class_key("v"), "v", "vec_id").groupBy("h1", "h2")
            .agg(F.any_value("v").alias("v"), F.count("*").alias("weight"), F.min("vec_id").alias("smallest"))
            .withColumn("dims", F.size("v")))


def class_key(vector: str) -> list[Column]:
    """128 bits that name a vector."""
    return [F.xxhash64(vector).alias("h1"), F.xxhash64(F.lit(77), vector).alias("h2")]


def grid(classes: DataFrame, axes: dict[int, np.ndarray], eps: float) -> DataFrame:
    """Adds ``cells``, the grid cells of the leading axes; missing ones are 0."""
    schema = ", ".join(f"{n} {t}" for n, t in classes.dtypes if n != "unit") + ", cells array<int>"
    names = [n for n in classes.columns if n != "unit"]
    to = arrow_schema(classes.sparkSession, schema)

    def run(batches):
        for b in batches:
            size = pc.list_value_length(b["unit"]).to_numpy()
            flat, start = b["unit"].flatten().to_numpy(), np.cumsum(size) - size
            cells = np.zeros((len(size), AXES), np.int32)
            for dims in np.unique(size):
                at = np.flatnonzero(size == dims)
                lead = leading(flat[start[at][:, None] + np.arange(dims)], axes)
                cells[at, :lead.shape[1]] = np.floor(lead / eps)
            packed = pa.FixedSizeListArray.from_arrays(pa.array(cells.ravel()), AXES)
            columns = [b[n] for n in names] + [packed.cast(pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names + ["cells"]).cast(to)

    return classes.mapInArrow(run, schema)


def sequences(classes: DataFrame, axes: dict[int, np.ndarray], size: int = SEQUENCE) -> tuple[DataFrame, DataFrame]:
    """(dims, seq, nodes, weights, vectors, lo, hi): packed runs of the grid order with boxes on the leading axes;
    and the classes with their place in it.
    """
    order = [F.col("dims"), *[F.col("cells")[i] for i in range(AXES)], F.col("h1"), F.col("h2")]
    ranked = cut_lineage(with_rank(classes, order, "place", "all"))
    first = ranked.groupBy("dims").agg(F.min("place").alias("first"))
    placed = ranked.join(first, "dims").withColumn(
        "seq", F.call_function("div", F.col("place") - F.col("first"), F.lit(size)))
    schema = ("dims int, seq long, nodes binary, weights binary, vectors binary, "
              "lo array<double>, hi array<double>")
    to = arrow_schema(classes.sparkSession, schema)

    def pack(part: pa.Table) -> pa.Table:
        dims = part["dims"][0].as_py()
        place = part["place"].to_numpy()
        turn = np.argsort(place)
        x = part["v"].combine_chunks().flatten().to_numpy().reshape(-1, dims)[turn]
        lead = leading(unit_rows(x), axes)
        row = {"dims": dims, "seq": part["seq"][0].as_py(), "nodes": place[turn].tobytes(),
               "weights": part["weight"].to_numpy()[turn].tobytes(), "vectors": x.tobytes(),
               "lo": lead.min(axis=0), "hi": lead.max(axis=0)}
        return pa.Table.from_pylist([row], schema=to)

    rows = placed.select("dims", "seq", "place", "weight", "v")
    return rows.groupBy("dims", "seq").applyInArrow(pack, schema), ranked


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def leading(u: np.ndarray, axes: dict[int, np.ndarray]) -> np.ndarray:
    """Coordinates on the leading axes."""
    turn = axes.get(u.shape[1])
    return u @ turn[:, :AXES] if turn is not None else u[:, :AXES]


def near_intervals(seqs: DataFrame, eps: float) -> DataFrame:
    """(dims, a, b) with a <= b: pairs of sequences whose boxes are not provably further apart than eps."""
    boxes = seqs.select("dims", "seq", *[F.get("lo", F.lit(i)).alias(f"lo{i}") for i in range(AXES)],
                        *[F.get("hi", F.lit(i)).alias(f"hi{i}") for i in range(AXES)])
    levels = [cut_lineage(boxes)]
    top = levels[0].agg(F.max("seq")).first()[0] or 0
    while top > 0:
        wider = levels[-1].groupBy("dims", F.call_function("div", F.col("seq"), F.lit(FAN)).alias("seq")).agg(
            *[F.min(f"lo{i}").alias(f"lo{i}") for i in range(AXES)],
            *[F.max(f"hi{i}").alias(f"hi{i}") for i in range(AXES)])
        levels.append(cut_lineage(wider))
        top //= FAN
    pairs = levels[-1].select("dims", F.col("seq").alias("a"), F.col("seq").alias("b"))
    far = F.lit(0.0)
    for i in range(AXES):
        apart = F.greatest(F.col(f"x.lo{i}") - F.col(f"y.hi{i}"), F.col(f"y.lo{i}") - F.col(f"x.hi{i}"), F.lit(0.0))
        far = far + F.coalesce(apart * apart, F.lit(0.0))
    for level in reversed(levels[:-1]):
        part = level.withColumn("above", F.call_function("div", F.col("seq"), F.lit(FAN)))
        met = (pairs.join(part.alias("x"), (pairs["dims"] == F.col("x.dims")) & (pairs["a"] == F.col("x.above")))
               .join(part.alias("y"), (pairs["dims"] == F.col("y.dims")) & (pairs["b"] == F.col("y.above"))))
        pairs = cut_lineage(met.filter((F.col("x.seq") <= F.col("y.seq")) & (far <= (eps + SLACK) ** 2)).select(
            F.col("x.dims").alias("dims"), F.col("x.seq").alias("a"), F.col("y.seq").alias("b")))
    return pairs


class Sequence:
    """A packed run of classes with the boxes and balls of its halves."""

    def __init__(self, row: dict, axes: dict[int, np.ndarray]):
        self.nodes = np.frombuffer(row["nodes"], np.int64)
        self.weights = np.frombuffer(row["weights"], np.int64)
        self.x = np.frombuffer(row["vectors"], np.float64).reshape(len(self.nodes), -1)
        self.u = unit_rows(self.x)
        self.lead = leading(self.u, axes)
        self.known: dict[tuple[int, int], tuple] = {}

    def bounds(self, start: int, stop: int) -> tuple:
        found = self.known.get((start, stop))
        if found is None:
            lead, u = self.lead[start:stop], self.u[start:stop]
            centre = u.mean(axis=0)
            radius = float(np.sqrt(((u - centre) ** 2).sum(axis=1).max()))
            found = self.known[(start, stop)] = (lead.min(axis=0), lead.max(axis=0), centre, radius)
        return found


class PairJoin:
    """Joins two sequences (or one with itself) by halves."""

    def __init__(self, a: Sequence, b: Sequence, similar: float):
        self.a, self.b, self.own = a, b, a is b
        self.similar, self.eps = similar, float(np.sqrt(2 - 2 * similar))
        self.links = [np.zeros(len(a.nodes), np.int64)]
        self.links.append(self.links[0] if self.own else np.zeros(len(b.nodes), np.int64))
        # a disjoint-set forest over the classes of both
        self.shift = 0 if self.own else len(a.nodes)
        self.root = np.arange(len(a.nodes) + (0 if self.own else len(b.nodes)))

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def unite(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.root[max(i, j)] = min(i, j)

    def run(self, a0: int, a1: int, b0: int, b1: int) -> None:
        same = self.own and a0 == b0 and a1 == b1
        if not same or a1 - a0 > LEAF:
            alo, ahi, ac, ar = self.a.bounds(a0, a1)
            blo, bhi, bc, br = self.b.bounds(b0, b1)
            gap = np.maximum(np.maximum(alo - bhi, blo - ahi), 0)
            between = float(np.sqrt(((ac - bc) ** 2).sum()))
            if gap @ gap > (self.eps + SLACK) ** 2 or between - ar - br > self.eps + SLACK:
                return
            if not same and between + ar + br < self.eps - 1e-6:
                self.whole(a0, a1, b0, b1)
                return
        if max(a1 - a0, b1 - b0) <= LEAF:
            self.compare(a0, a1, b0, b1, same)
            return
        am, bm = (a0 + a1) // 2, (b0 + b1) // 2
        if same:
            self.run(a0, am, a0, am)
            self.run(a0, am, am, a1)
            self.run(am, a1, am, a1)
        elif a1 - a0 >= b1 - b0:
            self.run(a0, am, b0, b1)
            self.run(am, a1, b0, b1)
        else:
            self.run(a0, a1, b0, bm)
            self.run(a0, a1, bm, b1)

    def whole(self, a0: int, a1: int, b0: int, b1: int) -> None:
        """Every class of one side is linked with every class of the other."""
        self.links[0][a0:a1] += self.b.weights[b0:b1].sum()
        self.links[1][b0:b1] += self.a.weights[a0:a1].sum()
        for i in range(a0, a1):
            self.unite(i, self.shift + b0)
        for j in range(b0, b1):
            self.unite(a0, self.shift + j)

    def compare(self, a0: int, a1: int, b0: int, b1: int, same: bool) -> None:
        cosine = self.a.u[a0:a1] @ self.b.u[b0:b1].T
        hit = cosine >= self.similar
        # at the threshold the plain formula on the given vectors decides
        for i, j in zip(*np.nonzero(np.abs(cosine - self.similar) < SLACK)):
            x, y = self.a.x[a0 + i], self.b.x[b0 + j]
            hit[i, j] = (x * y).sum() / (np.sqrt((x * x).sum()) * np.sqrt((y * y).sum())) >= self.similar
        if same:
            np.fill_diagonal(hit, False)
        rows, columns = np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
        if not len(rows):
            return
        hit = hit[np.ix_(rows, columns)]
        self.links[0][a0 + rows] += hit @ self.b.weights[b0 + columns]
        if not same:
            self.links[1][b0 + columns] += self.a.weights[a0 + rows] @ hit
        # a spanning forest of the hits: smallest label over links until nothing changes
        left, far = rows + a0, columns + b0 + self.shift
        label = np.where(hit, left[:, None], len(self.root)).min(axis=0)
        while True:
            mine = np.minimum(np.where(hit, label[None, :], len(self.root)).min(axis=1), left)
            after = np.minimum(np.where(hit, mine[:, None], len(self.root)).min(axis=0), label)
            if (after == label).all():
                break
            label = after
        for i, m in zip(left, mine):
            self.unite(int(i), int(m))
        for j, m in zip(far, label):
            self.unite(int(j), int(m))

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Linked classes, how many others each is linked with here, and one linked class of smaller number."""
        nodes = self.a.nodes if self.own else np.concatenate([self.a.nodes, self.b.nodes])
        links = self.links[0] if self.own else np.concatenate(self.links)
        at = np.flatnonzero(links)
        return nodes[at], links[at], nodes[[self.find(int(i)) for i in at]] if len(at) else nodes[:0]


def link_counts(seqs: DataFrame, pairs: DataFrame, axes: dict[int, np.ndarray], similar: float) -> DataFrame:
    """(node, links, other): per pair of sequences and linked class, a part of its number of links and one link."""
    load = seqs.select("dims", "seq", "nodes", "weights", "vectors")
    left = pairs.withColumn("seq", F.col("a"))
    right = pairs.filter("a != b").withColumn("seq", F.col("b"))
    rows = left.unionByName(right).join(load.hint("merge"), ["dims", "seq"])
    schema = "node long, links long, other long"
    to = arrow_schema(seqs.sparkSession, schema)

    def compare(cell: pa.Table) -> pa.Table:
        parts = [Sequence(r, axes) for r in sorted(cell.to_pylist(), key=lambda r: r["seq"])]
        join = PairJoin(parts[0], parts[-1], similar)
        join.run(0, len(parts[0].nodes), 0, len(parts[-1].nodes))
        return pa.table(dict(zip(("node", "links", "other"), join.result()))).cast(to)

    return rows.groupBy("dims", "a", "b").applyInArrow(compare, schema)


def near_vectors(vectors: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors``.

    Two vectors of as many dimensions are linked if their cosine in double
    precision is at least ``similar`` (above 0); n_links counts the other rows
    linked directly, equal rows and rows of the same id included.  component_id
    is the smallest vec_id reachable over links, itself included; a component
    without any id has a null one.  Vectors that are null, empty, zero or hold
    null or non-finite components link with nothing and are their own
    component.  kept is true where vec_id is the component_id, and for all rows
    of a component without ids.  Other columns are ignored.
    """
    eps = float(np.sqrt(2 - 2 * similar))
    classes = cut_lineage(classes_of(vectors).withColumn("unit", unit("v")))
    axes = axes_of(hash_sample(classes, "h1", SAMPLE))
    seqs, ranked = sequences(grid(classes, axes, eps), axes)
    seqs = cut_lineage(seqs)
    found = cut_lineage(link_counts(seqs, near_intervals(seqs, eps), axes, similar))
    home = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    names = ranked.select(F.col("place").alias("node"), "h1", "h2", "weight", "smallest")
    named = cut_lineage(names.join(home, "node", "left").withColumn("component", F.coalesce("component", "node"))
                        .join(links, "node", "left"))
    least = named.groupBy("component").agg(F.min("smallest").alias("component_id"))
    by_key = named.join(least.hint("merge"), "component").select(
        "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), "component_id",
        F.lit(True).alias("known"))
    v = F.when(usable("embedding"), F.col("embedding").cast("array<double>"))
    rows = vectors.select("vec_id", v.alias("v")).select("vec_id", *[
        F.when(F.col("v").isNotNull(), k).alias(n) for n, k in zip(("h1", "h2"), class_key("v"))])
    component = F.when(F.col("known"), F.col("component_id")).otherwise(F.col("vec_id"))
    return (rows.join(by_key.hint("merge"), ["h1", "h2"], "left")
            .select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
                    component.alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"),
                                           F.col("component_id").isNull())))
