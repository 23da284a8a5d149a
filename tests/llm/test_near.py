"""Near-duplicates and nearest neighbours against brute force."""

import random
from collections import Counter
from math import comb

import numpy as np
import pytest

from muonloom.llm import ann, components, minhash


def test_few_pairs_miss_the_collisions():
    """The stated chance that a pair of a similarity has fewer collisions than are checked."""
    n = minhash.COORDINATES
    for similarity, bound in ((0.75, 1.1e-6), (0.8, 1e-9)):
        assert sum(comb(n, i) * similarity ** i * (1 - similarity) ** (n - i) for i in range(minhash.MATCHES)) < bound


def test_pairs_with_51_collisions_are_checked(spark):
    whole = np.arange(40, dtype=np.uint64)
    rows = [(node, [at if at < 51 else 1000 * node + at for at in range(minhash.COORDINATES)], bytearray(whole.tobytes()))
            for node in (1, 2)]
    full = spark.createDataFrame(rows, "node long, sig array<int>, set binary")
    members = minhash.hub_members(full)
    assert [tuple(r) for r in minhash.confirm_hubs(members, full).collect()] == [(2, 1)]


def plain_components(rows):
    """(id, shingles, smallest id reachable) of every row; rows are (id, text)."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({b" ".join(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    home = list(range(len(rows)))

    def find(i):
        while home[i] != i:
            i = home[i]
        return i

    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in where[x] if j < i).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                home[b] = a
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    for i, (k, _) in enumerate(rows):
        c = least.get(find(i)) if sets[i] else k
        yield k, len(sets[i]), c, (k == c if k is not None else c is None)


def near_copies(seed, n, edits, words=120):
    """Copies of one text, each with some words changed: most pairs are close to the threshold."""
    r = random.Random(seed)
    base = [f"w{r.randrange(10 ** 6)}" for _ in range(words)]
    for _ in range(n):
        w = list(base)
        for at in r.sample(range(words), r.choice(edits)):
            w[at] = f"x{r.randrange(10 ** 6)}"
        yield " ".join(w)


def passage_texts(seed, n):
    """Texts that share a passage but are not alike."""
    r = random.Random(seed)
    passage = " ".join(f"p{i}" for i in range(60))
    for _ in range(n):
        yield passage + " " + " ".join(f"q{r.randrange(10 ** 6)}" for _ in range(r.choice([15, 30, 60, 90])))


def check(df, rows):
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_components(df).collect())
    assert got == Counter(plain_components(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_near_threshold_groups(spark, seed):
    texts = list(near_copies(seed, 150, [0, 1, 2, 3, 4, 5, 6])) + list(near_copies(seed + 10, 60, [2, 3])) \
        + list(passage_texts(seed, 80))
    texts += texts[:40]
    random.Random(seed).shuffle(texts)
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_small_blocks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 3)
    monkeypatch.setattr(minhash, "AGAINST", 11)
    rows = list(enumerate(list(near_copies(5, 120, [3, 4, 5, 6])) + list(passage_texts(5, 40))))
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BROADCAST_KEYS", 0)
    rows = list(enumerate(near_copies(6, 60, [1, 2, 3, 4])))
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_edges(edge, nothing):
    check(edge, [(r.doc_id, r.text) for r in edge.collect()])
    assert minhash.near_components(nothing).count() == 0


def test_corpus(corpus):
    check(corpus[0], [r[:2] for r in corpus[1]])


def test_a_cell_returns_a_spanning_forest():
    texts = near_copies(6, 60, [1, 2, 3, 4] * 30)
    sets = [minhash.shingle_set(t.encode()) for t in texts]
    nodes = np.arange(len(sets)) + 7
    links = minhash.join_cell(nodes, nodes.copy(), np.ones(len(sets), bool),
                              np.array([minhash.signature(s) for s in sets]), sets)
    root = {int(n): int(n) for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        assert find(a) != find(b)  # no link within a component
        root[find(b)] = find(a)
    for i, s in enumerate(sets):
        for j in range(i):
            if minhash.linked(s, sets[j]):
                assert find(int(nodes[i])) == find(int(nodes[j]))


def test_signatures_agree_as_often_as_sets():
    r = np.random.default_rng(2)
    shared = r.integers(0, 2 ** 63, 600, dtype=np.uint64)
    a, b = (np.unique(np.concatenate([shared, r.integers(0, 2 ** 63, 100, dtype=np.uint64)])) for _ in range(2))
    assert minhash.linked(a, b) and abs((minhash.signature(a) == minhash.signature(b)).mean() - 0.75) < 0.15


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000)]
    random.Random(1).shuffle(links)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(300)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_nearest(rows, every=20, k=20):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(
        x is not None and np.isfinite(x) for x in v) and any(v)]
    for i, q in {i: q for i, q in good if i % every == 0}.items():
        near = sorted((-float((v * q).sum()), j) for j, v in good if j != i and len(v) == len(q))[:k]
        for rank, (s, j) in enumerate(near, 1):
            yield i, rank, j, round(-s, 9)


def nearest(df, **more):
    return Counter((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in ann.nearest(df, **more).collect())


@pytest.mark.parametrize("kind", ["noise", "groups", "lengths"])
def test_nearest(spark, kind, monkeypatch):
    monkeypatch.setattr(ann, "QUERIES", 16)
    r = np.random.default_rng(4)
    x = r.normal(size=(700, 24))
    if kind == "groups":
        x = x[:9][r.integers(0, 9, 700)] + 0.05 * x
    if kind == "lengths":
        x *= r.exponential(size=(700, 1)) + 0.01
        x += 3.0
    rows = [(i * 5, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want, got = Counter(plain_nearest(rows)), nearest(df)
    assert sum((want & got).values()) >= 0.97 * sum(want.values()) and sum(got.values()) == sum(want.values())


def test_nearest_edges(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 2.0]), (20, [1.0, 2.0]), (3, [1.0, 2.0]), (4, [1.0, 2.0]), (40, None), (60, []), (80, [0.0, 0.0]),
            (100, [1.0, None]), (120, [nan, 1.0]), (140, [inf, 1.0]), (160, [1.0, 2.0, 3.0]), (None, [9.0, 9.0]),
            (7, [-1.0, 0.5]), (180, [2.0, 0.0, 1.0])]
    df = spark.createDataFrame([r + (1, "k") for r in rows],
                               "vec_id long, embedding array<double>, block int, codes string")
    assert nearest(df) == Counter(plain_nearest(rows))
    assert nearest(df.limit(0)) == Counter()


def test_estimates_lie_within_their_bound():
    r = np.random.default_rng(9)
    x, q = r.normal(size=(400, 64)), r.normal(size=64)
    codes, length, own = ann.encode(x, x.mean(axis=0))
    bits = ann.n_bits(64)
    signs = np.unpackbits(codes, axis=1)[:, :bits] * 2.0 - 1
    estimate = signs @ (q @ ann.rotation(64, bits)) / np.sqrt(bits) * length / own + q @ x.mean(axis=0)
    error = length * np.sqrt(1 - own ** 2) / own / np.sqrt(bits - 1) * np.linalg.norm(q)
    off = np.abs(estimate - x @ q) / error
    assert (off < ann.BOUND).mean() > 0.99 and abs((estimate - x @ q).mean()) < 0.5
