"""Vector joins, source divergences and prefix tries against plain versions."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from muonloom.llm import divergence, epsilon, prefixes
from tests.llm.plain_trie import plain_trie


def plain_near(rows, similar=0.95):
    """{position: (vec_id, n_links, component_id, kept)} of (vec_id, vector) rows."""
    good = [i for i, (_, v) in enumerate(rows)
            if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    near = defaultdict(set)
    for i in good:
        for j in good:
            x, y = np.array(rows[i][1], float), np.array(rows[j][1], float)
            if i != j and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= similar:
                near[i].add(j)
    out = []
    for i, (vec, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((vec, len(near[i]), least, vec == least))
    return sorted(out, key=str)


def vectors_with_edges():
    rng = np.random.default_rng(5)
    rows = []
    for c in range(6):  # clusters around centres, from tight to loose
        centre = rng.normal(size=12)
        for _ in range(25):
            rows.append((len(rows), (centre + rng.normal(size=12) * 0.08 * (c + 1)).tolist()))
    rows += [(len(rows) + i, rng.normal(size=12).tolist()) for i in range(60)]
    rows += [(1000 + i, rows[3][1]) for i in range(20)]                # copies
    rows += [(1100, [2 * x for x in rows[3][1]]), (1101, [-x for x in rows[3][1]])]
    rows += [(1200, None), (1201, []), (1202, [0.0] * 12), (1203, [1.0, None] * 6), (1204, [math.nan] * 12),
             (1205, [math.inf] + [0.0] * 11), (1206, [1.0, 0.0]), (1207, [1.0, 0.1]), (1208, [3.0]), (1209, [-0.0, 1.0]),
             (1210, [0.0, 1.0]), (None, rows[3][1]), (None, [5.0, 5.0, 5.0]), (None, None), (7, rows[7][1]),
             (7, rng.normal(size=12).tolist())]
    return rows


def near_rows(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows],
                               "vec_id long, embedding array<double>, component string, links int")
    return sorted((tuple(r) for r in epsilon.near_vectors(df, **kw).collect()), key=str)


@pytest.mark.parametrize("size", [7, 8192])
def test_near_vectors_match_all_pairs(spark, monkeypatch, size):
    monkeypatch.setattr(epsilon, "LEAF", 4)
    whole = epsilon.sequences
    monkeypatch.setattr(epsilon, "sequences", lambda c, a: whole(c, a, size))
    rows = vectors_with_edges()
    assert near_rows(spark, rows) == plain_near(rows)


def test_near_vectors_of_nothing(spark):
    assert near_rows(spark, []) == []
    assert near_rows(spark, [(1, None)]) == [(1, 0, 1, True)]


def test_halves_within_reach_count_as_a_whole():
    rng = np.random.default_rng(2)
    x = 1 + rng.normal(size=(64, 8)) * 1e-3
    row = {"nodes": np.arange(64).tobytes(), "weights": np.full(64, 3).tobytes(), "vectors": x.tobytes()}
    one = epsilon.Sequence(row, {})
    join = epsilon.PairJoin(one, one, 0.95)
    join.compare = lambda a0, a1, b0, b1, same: epsilon.PairJoin.compare(join, a0, a1, b0, b1, same) if same else 1 / 0
    old, epsilon.LEAF = epsilon.LEAF, 16
    try:
        join.run(0, 64, 0, 64)
    finally:
        epsilon.LEAF = old
    nodes, links, other = join.result()
    assert links.tolist() == [63 * 3] * 64 and set(other) == {0}


def plain_divergence(rows, min_docs, top):
    """Result rows of (lang, source, text) documents."""
    words = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub(
        "[A-Z]", lambda m: m[0].lower(), text or ""))) for lang, source, text in rows]
    docs, total, group = defaultdict(set), Counter(), Counter()
    groups = defaultdict(set)
    for at, (lang, source, terms) in enumerate(words):
        groups[lang].add(source)
        for t in terms:
            docs[lang, t].add(at)
            total[lang, t] += 1
            group[lang, source, t] += 1
    out = []
    for lang, sources in groups.items():
        kept = [t for (la, t), d in docs.items() if la == lang and len(d) >= min_docs]
        v = len(kept)

        def shares(count):
            n = sum(count(t) for t in kept)
            return {t: 1 + 10 ** 9 * (count(t) + 2) // (n + 2 * v) for t in kept}

        whole = shares(lambda t: total[lang, t])
        p = {s: shares(lambda t, s=s: group[lang, s, t]) for s in sources}
        for s in sources:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // (p[s][t] + p[o][t]) for t in kept), o) for o in sources if o != s]
            own = [((p[s][t] - whole[t]) ** 2 // (p[s][t] + whole[t]), t) for t in kept
                   if group[lang, s, t] and p[s][t] > whole[t]]
            for part, found, limit in (("pair", pairs, None), ("term", own, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found[:limit])]
    return sorted(out)


DOCS = "lang string, source string, text string, term string, n int, total int, block int"


def divergence_rows(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "t", 1, 2, 3) for r in rows], DOCS)
    return sorted(tuple(r) for r in divergence.divergences(df, **kw).collect())


@pytest.mark.parametrize("shard, block, hold", [(5, 2, 10), (4096, 128, 400_000)])
def test_divergences_match_a_plain_version(spark, monkeypatch, shard, block, hold):
    for name, value in (("SHARD", shard), ("BLOCK", block), ("HOLD_ROWS", hold), ("BATCH_BYTES", 400)):
        monkeypatch.setattr(divergence, name, value)
    rng = random.Random(4)
    vocabulary = ["Alpha", "beta", "naïve", "ÄPFEL", "x", "don", "日本", " q", "tail"] + [f"w{c}" for c in "abcdefghij"]
    rows = [(rng.choice(["en", "de", None]), rng.choice(["a", "b", "é", None, "hot", "hot", "hot"]),
             " ".join(rng.choices(vocabulary, k=rng.randrange(12))) + "\x00'9_") for _ in range(300)]
    rows += [("en", "only null", None), ("fr", "lonely", "bonjour"), ("xx", "p", "one"), ("xx", "q", None), (None,) * 3,
             ("en", "long", "beta BETA gamma " * 30_000)] + [("en", "hot", "same words here")] * 40
    assert divergence_rows(spark, rows, min_docs=4, top=3) == plain_divergence(rows, 4, 3)


def test_divergences_of_nothing(spark):
    assert divergence_rows(spark, []) == []
    assert divergence_rows(spark, [("a", "s", "word"), ("a", "t", None)]) == [
        ("a", "s", "pair", "t", 0, 1), ("a", "t", "pair", "s", 0, 1)]


def test_shares_hold_for_large_counts(spark):
    from pyspark.sql import functions as F
    cases = [(3, 10, 4), (8_000_000_000_000_000, 8_500_000_000_000_000, 1_000_000), (0, 0, 7), (0, 0, 0)]
    got = spark.createDataFrame(cases, "n long, total long, terms long").select(
        divergence.share(*[F.col(c) for c in ("n", "total", "terms")])).collect()
    for (n, total, terms), (value,) in zip(cases[:3], got):
        assert value == 1 + 10 ** 9 * (n + 2) // (total + 2 * terms)
        assert divergence._shares(np.array([n]), np.array([total]), terms)[0] == value


def trie_rows(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows],
                               "conv_id long, turn long, role string, text string, depth int, digest string")
    return sorted(tuple(r) for r in prefixes.prefix_trie(df).collect())


def conversations():
    rng = random.Random(9)
    rows = []
    for c in range(140):
        for t in range(rng.choice([1, 2, 3, 5, 9, 14])):
            rows.append((c * rng.choice([1, 1, 3]) + (c % 7 == 0) * 10 ** 12, t, rng.choice(["user", "assistant"]),
                         rng.choice(["hi", "hi", "ok", "日本 ok", "?"])))
    rows += [(c, t, "user", "same") for c in range(2000, 2080) for t in range(3)]              # copies
    rows += [(3000 + c, t, "user", f"deep {t}") for c in (0, 1, 2) for t in range(400)]        # long and shared
    rows += [(3005 + c, t, "user", f"deep {t}") for c in range(30) for t in range(10 + 3 * c)]  # one below the other
    rows += [(None, 1, "user", "x"), (4000, None, "user", "first"), (4000, 0, None, None), (4000, 1, "", ""),
             (4001, 2, "a", "bc"), (4001, 2, "ab", "c"), (4001, 2, "ab", "c"), (-7, 0, "user", "hi"), (4002, 0, "u", None)]
    return rows


def test_trie_matches_a_plain_version(spark, monkeypatch):
    rows = conversations()
    whole = prefixes.running
    monkeypatch.setattr(prefixes, "running", lambda *a: whole(*a, **({"powers": None} if len(a) < 5 else {}), each=150))
    monkeypatch.setattr(prefixes, "PIECE", 7)
    assert trie_rows(spark, rows) == plain_trie(rows)


def test_trie_of_nothing(spark):
    assert trie_rows(spark, []) == []
    assert trie_rows(spark, [(None, 1, "user", "x")]) == []


def test_trie_takes_other_bases_when_members_disagree(spark, monkeypatch):
    """With a tiny modulus different prefixes share fingerprints, which the stored references reveal."""
    whole, seeds = prefixes.nodes_of, []

    def doubtful(rows, plans):
        seeds.append(1)
        from pyspark.sql import functions as F
        found = whole(rows, plans)
        return found.withColumn("agreed", F.lit(False)) if len(seeds) < 3 else found

    monkeypatch.setattr(prefixes, "nodes_of", doubtful)
    rows = [(1, 0, "u", "a"), (2, 0, "u", "a"), (2, 1, "u", "b")]
    assert trie_rows(spark, rows) == plain_trie(rows) and len(seeds) == 3


def test_members_of_a_clashing_fingerprint_disagree(spark):
    rows = spark.createDataFrame([(1, 1, 5, 5, 0, 0, 1, 2, 3), (2, 1, 5, 5, 0, 0, 1, 9, 3)],
                                 "conv_id long, depth long, k1 long, k2 long, q1 long, q2 long, d1 long, d2 long, bytes long")
    whole = spark.createDataFrame([(1, 1, 5, 5), (2, 1, 5, 5)], "conv_id long, depth long, k1 long, k2 long")
    assert prefixes.nodes_of(rows, whole).filter("NOT agreed").count() == 1
