"""BPE, line dedup, fingerprints and the language model against plain versions."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from muonloom.llm import bpe, lines, ngram, simhash

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def coders():
    ranks = bpe.read_ranks(RANKS)
    return bpe.Encoder(ranks, public_tokenizers.PATTERN), tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=dict(ranks), special_tokens={})


@pytest.mark.parametrize("text", [
    "", "a" * 20_000, "ab" * 9_000, "<|endoftext|> \n\n  x  ", "日本語のテスト" * 300, "\U0001f600" * 900,
    " " * 5_000 + "x", "it's  I'll  we'd\r\n\r\n", "١٢٣ Ⅷ ½ x²", "a\x1cb \x1c c"])
def test_bpe_like_tiktoken(coders, text):
    own, other = coders
    ids = own.encode(text)
    assert list(bpe.from_little_endian(ids)) == other.encode_ordinary(text)
    assert own.decode(ids) == text.encode()


def test_bpe_random_texts(coders):
    own, other = coders
    r = random.Random(3)
    for _ in range(5_000):
        text = "".join(r.choices(" \n\t'sRtdm \r\x0b\x1c  a1é½Ⅷ_,.日ab  ", k=r.randint(0, 14)))
        assert list(bpe.from_little_endian(own.encode(text))) == other.encode_ordinary(text), repr(text)


def test_bpe_table(spark, edge, nothing, coders):
    got = bpe.decode(bpe.encode(edge, RANKS, public_tokenizers.PATTERN), RANKS).collect()
    want = Counter((r.doc_id, (r.text or "").encode(), len(coders[1].encode_ordinary(r.text or ""))) for r in edge.collect())
    assert Counter((r.doc_id, bytes(r.decoded), r.n_tokens) for r in got) == want
    assert bpe.encode(nothing, RANKS, public_tokenizers.PATTERN).count() == 0


def test_rank_file_is_read_whole():
    with open(RANKS, "rb") as f:
        first = f.readline().split()
    ranks = bpe.read_ranks(RANKS)
    assert ranks[0] == (base64.b64decode(first[0]), int(first[1])) and {b for b, _ in ranks} >= {bytes([i]) for i in range(256)}


def plain_line_dedup(rows, min_docs, keep_first=False):
    """(id, text) -> kept text; documents are distinct pairs of id and text."""
    docs = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    where = defaultdict(list)
    for i, t in docs:
        for p, key in enumerate(lines.line_keys((t or "").encode())):
            if key:
                where[key].append((i, t, p))
    gone = set()
    for at in where.values():
        if len({(i, t) for i, t, _ in at}) >= min_docs:
            gone |= set(at[1:] if keep_first else at)
    return {(i, t): "\n".join(x for p, x in enumerate((t or "").split("\n")) if (i, t, p) not in gone) for i, t in docs}


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("partitions", [1, 7])
def test_line_dedup(spark, keep_first, partitions):
    r = random.Random(5)
    pool = [f"line {i}" for i in range(40)] + ["", "  ", "HOT", " hot\t", "hot"]
    rows = [(i, "\n".join(r.choices(pool, k=r.randint(0, 9)) + ["Hot "] * (i % 3))) for i in range(300)]
    rows += [(None, "hot\nrare"), (None, None), (300, None), (300, "")]
    df = spark.createDataFrame([x + (1, "h") for x in rows + rows[:5]], "doc_id long, text string, keep int, hash string")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        marks = lines.keep_bitmaps(df, min_docs=20, keep_first=keep_first)
        got = lines.apply_bitmaps(df, marks, carry=("hash",)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = plain_line_dedup(rows, 20, keep_first)
    have = Counter((g.doc_id, g.text) for g in got)
    assert have == Counter((i, want[i, t]) for i, t in rows + rows[:5])
    assert all(g.hash == "h" and 0 <= g.n_dropped <= g.n_lines for g in got)


def test_line_dedup_edges(edge, nothing):
    got = lines.apply_bitmaps(edge, lines.keep_bitmaps(edge, min_docs=3)).collect()
    want = plain_line_dedup([(r.doc_id, r.text) for r in edge.collect()], 3)
    assert Counter((g.doc_id, g.text) for g in got) == Counter(
        (r.doc_id, want[r.doc_id, r.text]) for r in edge.collect())
    assert lines.apply_bitmaps(nothing, lines.keep_bitmaps(nothing)).count() == 0


def distance(a: str, b: str) -> int:
    return (int(a, 16) ^ int(b, 16)).bit_count()


def test_fingerprints(edge, nothing):
    rows = sorted(((r.doc_id, r.text or "") for r in edge.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = Counter()
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        e = t[:len(t) - len(t) // 4] + following[:len(t) // 4]
        p, q, n = (simhash.fingerprint(x.encode()).hex() for x in (t, e, following))
        want[i, len(t), hashlib.sha256(e.encode()).hexdigest(), p, q, distance(p, q), distance(p, n)] += 1
    like = {d: 1.0 if d == 0 else max(0.0, math.cos(d * math.pi / 128)) for d in range(129)}
    got = simhash.fingerprints(edge).collect()
    assert Counter((g.doc_id, g.n_chars, g.edited_sha256, g.fingerprint, g.edited_fingerprint) for g in got) == Counter(
        k[:5] for k in want.elements())
    assert sorted(round(g.near_edited + 2 * g.near_next, 9) for g in got) == sorted(
        round(like[k[5]] + 2 * like[k[6]], 9) for k in want.elements())
    assert simhash.fingerprints(nothing).count() == 0


def test_single_document_follows_itself(spark):
    (g,) = simhash.fingerprints(spark.createDataFrame([(5, "a b c d e f g h")], "doc_id long, text string")).collect()
    assert g.near_next == 1.0 and g.edited_sha256 == hashlib.sha256(b"a b c d e f a b").hexdigest()


@pytest.mark.parametrize("radius,blocks", [(0, 1), (3, 5), (6, 8)])
def test_within_radius(spark, radius, blocks):
    r = np.random.default_rng(radius)
    base = r.integers(0, 2, (30, 128), dtype=np.uint8)
    codes = [np.packbits(b).tobytes().hex() for b in base]
    for b in base:
        for flips in (1, 2, 3, 4, 6, 7):
            c = b.copy()
            c[r.choice(128, flips, replace=False)] ^= 1
            codes.append(np.packbits(c).tobytes().hex())
    codes += codes[:3]
    df = spark.createDataFrame([(c, "k") for c in codes] + [(None, "k")], "code string, key string")
    got = {(g["query"], g["code"], g["distance"]) for g in simhash.within_radius(df, df, radius, blocks).collect()}
    assert got == {(a, b, distance(a, b)) for a in codes for b in codes if distance(a, b) <= radius}


def plain_scores(rows, weights):
    texts = [(i, (t or "").encode().lower().split() + [None]) for i, t in rows]
    c, pairs, starts = Counter(), Counter(), 0
    for i, t in texts:
        if zlib.crc32(b"" if i is None else str(i).encode()) % 10:
            c.update(t)
            pairs.update(zip([0] + t[:-1], t))
            starts += 1
    n, v = sum(c.values()), len(c)
    before = {**c, 0: starts}
    for i, t in texts:
        score = base = 0.0
        for a, x in zip([0] + t[:-1], t):
            cv = before.get(a, 0)
            w = weights[1 + int(math.log2(cv)) if cv else 0]
            score += math.log10(w[0] * (pairs[a, x] / cv if cv else 0) + w[1] * c[x] / max(n, 1) + w[2] / (v + 1))
            base += math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1)))
        yield (i, zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0, len(t), sum(c[x] > 0 for x in t), n,
               round(base, 6), round(score, 6))


@pytest.mark.parametrize("data", ["edge", "corpus"])
def test_language_model(request, data, monkeypatch):
    df = request.getfixturevalue(data)
    df = df[0] if isinstance(df, tuple) else df
    monkeypatch.setattr(ngram, "BATCH_TOKENS", 5_000)
    monkeypatch.setattr(ngram, "PARTITION_BYTES", 100_000)
    learned, learn = [], ngram.learn
    monkeypatch.setattr(ngram, "learn", lambda *a: learned.append(learn(*a)) or learned[-1])
    got = ngram.score(df).collect()
    assert np.allclose(learned[0].sum(axis=1), 1) and (learned[0] > 0).all()
    want = list(plain_scores([(r.doc_id, r.text) for r in df.collect()], learned[0]))
    assert Counter((g.doc_id, g.held_out, g.n_tokens, g.n_known, g.train_tokens, round(g.base_score, 6), round(g.score, 6))
                   for g in got) == Counter(want)
    if data == "corpus":  # better than single words on texts it has not seen
        held = [g for g in got if g.held_out]
        assert sum(g.score for g in held) > sum(g.base_score for g in held)


def test_language_model_of_nothing(nothing):
    assert ngram.score(nothing).count() == 0


def test_weights_rise_in_likelihood(spark):
    r = np.random.default_rng(1)
    rows = [(int(b), float(p), float(q), 1) for b, p, q in zip(r.integers(0, 3, 500), r.random(500) * (r.random(500) < 0.6), r.random(500) / 50)]
    events = spark.createDataFrame(rows, "bucket int, p2 double, p1 double, n long")
    w = ngram.learn(events, 1e-4)
    like = lambda w: sum(math.log(w[b][0] * p + w[b][1] * q + w[b][2] * 1e-4) for b, p, q, _ in rows)
    assert like(w) > like(np.tile(np.array(ngram.FIRST), (ngram.BUCKETS, 1)))
