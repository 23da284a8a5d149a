"""Toxicity by a classifier chain of linear models over hashed words and word beginnings.

Categories are predicted one after another; each model also sees the
probabilities of the categories before it.  While the chain is fitted these are
out-of-fold: a document's earlier probability comes from a model that has not
seen the document, as will be the case when the chain is applied.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from muonloom.llm.common import as_bytes, hash_sample, map_rows, words_of
from muonloom.session import cut_lineage

#: Features of a word are hashed to so many columns.
COLUMNS = 1 << 18
#: Beginnings of so many letters are features too, so unseen endings of a stem are recognised.
BEGINNINGS = (3, 4, 5, 6, 7)
#: What is stripped from a word before it is looked at.
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~0123456789"
#: Labelled documents that the chain is fitted on, at most; the first by a hash of their id.
FIT_DOCUMENTS = 4_000
#: A document is toxic from this probability on.
TOXIC = 0.3
#: A word's features are remembered, for so many words per task.
CACHED_WORDS = 200_000


def columns_of(word: bytes) -> list[int]:
    """Feature columns of a word: without marks around it, its beginnings, and the marks behind it."""
    core = word.rstrip(MARKS)
    names = [b"~" + word[len(core):]] if len(core) < len(word) else []
    core = core.lstrip(MARKS)
    if core:
        letters = core.decode("utf-8", "ignore")
        names.append(b"=" + core)
        names += [b"^" + letters[:n].encode() for n in BEGINNINGS if len(letters) >= n]
    return [xxhash.xxh32_intdigest(n) % COLUMNS for n in names]


def features(text: bytes) -> np.ndarray:
    """Sorted distinct columns of a document."""
    found: set[int] = set()
    for w in set(words_of(text)):
        found.update(columns_of(w))
    return np.array(sorted(found), np.int32)


def telling(lists: list[np.ndarray], label: np.ndarray, most: int, least: float = 15.0) -> np.ndarray:
    """The ``most`` columns that depend most on the label, of chi-square ``least`` and more in 2 documents or more."""
    n, ones = len(label), label.sum()
    count = lambda chosen: np.bincount(np.concatenate(chosen), minlength=COLUMNS) if chosen else np.zeros(COLUMNS)
    both = count([x for x, y in zip(lists, label) if y]).astype(float)
    seen = count(lists).astype(float)
    spread = seen * (n - seen) * ones * (n - ones)
    off = both * n - seen * ones
    chi = np.where(seen > 1, off * off * n / np.maximum(spread, 1e-9), 0.0)
    best = np.argsort(-chi, kind="stable")[:most]
    return np.sort(best[chi[best] >= least])


@dataclass
class Linear:
    """Logistic model over some columns and the probabilities of earlier categories."""

    columns: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    bias: float


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def fit_linear(x: np.ndarray, label: np.ndarray, columns: np.ndarray, rounds: int = 250,
               rate: float = 0.5, l2: float = 1e-4) -> Linear:
    """Logistic regression by adaptive gradient steps.

    ``x`` has a column per chosen feature, then one per earlier category.
    """
    n = len(label)
    x = np.column_stack([x, np.ones(n)]).astype(np.float32)
    w, g = np.zeros(x.shape[1], np.float32), np.full(x.shape[1], 1e-8, np.float32)
    keep = np.full(x.shape[1], l2, np.float32)
    keep[-1] = 0.0
    for _ in range(rounds):
        d = x.T @ ((sigmoid(x @ w) - label) / max(n, 1)).astype(np.float32) + keep * w
        g += d * d
        w -= (rate * d / np.sqrt(g)).astype(np.float32)
    k = len(columns)
    return Linear(columns, w[:k].astype(float), w[k:-1].astype(float), float(w[-1]))


def dense(lists: list[np.ndarray], chosen: np.ndarray) -> np.ndarray:
    """0/1 matrix of documents and chosen columns."""
    place = np.full(COLUMNS, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    x = np.zeros((len(lists), len(chosen)), np.float32)
    for i, columns in enumerate(lists):
        at = place[columns]
        x[i, at[at >= 0]] = 1
    return x


@dataclass
class Chain:
    """Models in the order of their categories."""

    names: list[str]
    models: list[Linear] = field(default_factory=list)


def fit_chain(lists: list[np.ndarray], labels: np.ndarray, names: list[str], folds: int = 3,
              most: int = 300) -> Chain:
    """One model per category over its ``most`` most telling columns.

    ``labels`` has a column of 0 and 1 per category.  Columns are chosen anew
    in every fold, so a held-out document has no part in its own probability.
    """
    n = len(lists)
    fold = np.arange(n) % folds
    chain, earlier = Chain(names), np.zeros((n, 0), np.float32)

    def model(seen: np.ndarray, y: np.ndarray) -> tuple[Linear, np.ndarray]:
        chosen = telling([x for x, use in zip(lists, seen) if use], y[seen], most)
        x = np.column_stack([dense(lists, chosen), earlier])
        return fit_linear(x[seen], y[seen], chosen), x

    for k in range(len(names)):
        y = labels[:, k].astype(float)
        chain.models.append(model(np.ones(n, bool), y)[0])
        if k + 1 < len(names):
            p = np.zeros(n)
            for f in range(folds):
                m, x = model(fold != f, y)
                p[fold == f] = sigmoid(x[fold == f] @ np.concatenate([m.weights, m.earlier]) + m.bias)
            earlier = np.column_stack([earlier, p]).astype(np.float32)
    return chain


class Scorer:
    """Probabilities of a document by a chain."""

    def __init__(self, chain: Chain):
        self.models = chain.models
        chosen = sorted(set().union(*[m.columns.tolist() for m in chain.models]))
        self.place = {c: i for i, c in enumerate(chosen)}
        self.table = np.zeros((len(chosen), len(chain.models)))
        for k, m in enumerate(chain.models):
            self.table[[self.place[c] for c in m.columns.tolist()], k] = m.weights
        self.known: dict[bytes, tuple[int, ...]] = {}

    def places(self, word: bytes) -> tuple[int, ...]:
        """Rows of the table that a word switches on; most words have none."""
        found = self.known.get(word)
        if found is None:
            found = tuple(self.place[c] for c in columns_of(word) if c in self.place)
            if len(self.known) < CACHED_WORDS:
                self.known[word] = found
        return found

    def __call__(self, text: bytes) -> list[float]:
        on: set[int] = set()
        on.update(*map(self.places, set(words_of(text))))
        sums = self.table[list(on)].sum(axis=0) if on else np.zeros(len(self.models))
        p: list[float] = []
        for model, s in zip(self.models, sums.tolist()):
            x = s + sum(a * b for a, b in zip(model.earlier.tolist(), p)) + model.bias
            p.append(1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, x)))))
        return p


def labelled_sample(docs: DataFrame, labels: DataFrame, names: list[str], limit: int = FIT_DOCUMENTS):
    """Features and labels of at most ``limit`` labelled documents, the first by a hash of their id.

    The only rows that come to the driver: lists of columns of so many
    documents.  Ids or labels that are null, and ids labelled twice with
    different labels, are left out.
    """
    marks = (labels.select("doc_id", *[F.col(n).cast("int").alias(n) for n in names]).dropna().distinct())
    marks = marks.groupBy("doc_id").agg(F.count("*").alias("_n"), *[F.min(n).alias(n) for n in names])
    marks = hash_sample(cut_lineage(marks.filter("_n = 1").drop("_n")), "doc_id", limit)
    texts = docs.select("doc_id", as_bytes("text").alias("text"))
    rows = texts.join(marks, "doc_id").select("doc_id", "text", *names)

    def start():
        def one(row):
            return [{"doc_id": row["doc_id"], "columns": features(row["text"]).tobytes()}
                    | {n: row[n] for n in names}]

        return one

    kinds = ", ".join(f"{n} int" for n in names)
    got = map_rows(rows, f"doc_id long, columns binary, {kinds}", start).collect()
    got.sort(key=lambda r: (r["doc_id"], r["columns"]))
    lists = [np.frombuffer(r["columns"], np.int32) for r in got]
    return lists, np.array([[r[n] for n in names] for r in got], float).reshape(len(got), len(names))


def fit(docs: DataFrame, labels: DataFrame, names: tuple[str, ...] = ("junk", "toxic"),
        limit: int = FIT_DOCUMENTS) -> Chain:
    """A chain over the label columns ``names``, fitted on a bounded sample (see ``labelled_sample``)."""
    lists, y = labelled_sample(docs, labels, list(names), limit)
    return fit_chain(lists, y, list(names))


def score(docs: DataFrame, chain: Chain, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``carry`` columns and p_<category> of every row, from its whole text.

    Null and empty texts have no features; their probabilities come from the
    biases alone.  Null ids and repeated rows stay.  Other columns are ignored.
    The models (at most 300 weights per category) go to the workers as a broadcast.
    """
    sent = docs.sparkSession.sparkContext.broadcast({"chain": chain})
    names = [f"p_{n}" for n in chain.names]
    rows = docs.select(F.struct(*carry).alias("row"), as_bytes("text").alias("text"))

    def start():
        kept = sent.value  # a worker keeps it, with the scorer, for its next tasks
        if "scorer" not in kept:
            kept["scorer"] = Scorer(kept["chain"])
        scorer = kept["scorer"]

        def one(row):
            return [{"row": row["row"]} | dict(zip(names, scorer(row["text"])))]

        return one

    kind = rows.schema["row"].dataType.simpleString()
    schema = f"row {kind}, " + ", ".join(f"{n} double" for n in names)
    return map_rows(rows, schema, start).select("row.*", *names)


def categories(labels: DataFrame) -> DataFrame:
    """doc_id with the categories junk (low quality) and toxic, from the quality and toxic marks."""
    return labels.select("doc_id", (1 - F.col("quality")).alias("junk"), "toxic")
