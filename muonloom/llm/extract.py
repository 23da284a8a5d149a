"""Main text of web pages by a tree-structured graphical model over the DOM.

Every block element and every text block is a node that is content or not.
Nodes have potentials from their features, links between parent and child have
2x2 potentials.  The graph is a tree, so one upward and one downward pass of
sum-product messages give exact marginals.  Weights maximise the likelihood of
labelled pages, whose gradient needs just these marginals.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from muonloom.llm import labelled_pages
from muonloom.llm.common import arrow_schema, hash_sample
from muonloom.llm.dom import N_FEATURES, N_LINKS, Forest, Page, parse

#: Pages of the table that the model is fitted on besides generated ones, at most: the first by a hash of their id.
FIT_PAGES = 150
#: Pages whose trees are solved together.
BATCH = 100


@dataclass
class Model:
    weights: np.ndarray  # per feature, in favour of content
    links: np.ndarray  # per kind of link: parent's state, child's state


def log_sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def marginals(forest: Forest, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """P(content) of each node, and for each node P(parent's state, own state) as (n, 2, 2)."""
    n = len(forest.parent)
    belief = np.zeros((n, 2))
    belief[:, 1] = np.bincount(forest.rows, model.weights[forest.columns], n)
    up = np.zeros((n, 2))  # message to the parent, by the parent's state
    for level in reversed(forest.levels[1:]):
        table = model.links[forest.link[level]] + belief[level][:, None, :]
        up[level] = log_sum(table[:, :, 0], table[:, :, 1])
        np.add.at(belief, forest.parent[level], up[level])
    # belief now has all messages from below; going down it gets those from above
    pairs = np.zeros((n, 2, 2))
    for level in forest.levels[1:]:
        above = belief[forest.parent[level]] - up[level]
        table = model.links[forest.link[level]] + above[:, :, None]
        joint = table + belief[level][:, None, :]
        joint -= joint.max(axis=(1, 2), keepdims=True)
        joint = np.exp(joint)
        pairs[level] = joint / joint.sum(axis=(1, 2), keepdims=True)
        belief[level] += log_sum(table[:, 0, :], table[:, 1, :])
    return 1.0 / (1.0 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -40, 40))), pairs


def node_labels(page: Page, content: list[bool]) -> np.ndarray:
    """Labels of all nodes from those of the text blocks: an element is content if most of its text is."""
    n = len(page.parent)
    good, all_ = np.zeros(n), np.zeros(n)
    leaves = iter(content)
    for i in range(n):
        if page.text[i] is not None:
            all_[i] = len(page.text[i])
            good[i] = all_[i] * next(leaves)
    for i in range(n - 1, 0, -1):
        good[page.parent[i]] += good[i]
        all_[page.parent[i]] += all_[i]
    return (2 * good > all_).astype(float)


def fit(pages: list[Page], labels: list[list[bool]], rounds: int = 250, rate: float = 0.3,
        l2: float = 2e-5) -> Model:
    """Maximum likelihood by adaptive gradient steps; labels are per text block."""
    forest = Forest.of(pages)
    y = np.concatenate([node_labels(p, c) for p, c in zip(pages, labels)])
    n, below = len(y), np.flatnonzero(forest.parent >= 0)
    model = Model(np.zeros(N_FEATURES), np.zeros((N_LINKS, 2, 2)))
    seen = np.zeros((N_LINKS, 2, 2))
    own, over = y[below].astype(int), y[forest.parent[below]].astype(int)
    np.add.at(seen, (forest.link[below], over, own), 1)
    gw, gl = np.full(N_FEATURES, 1e-8), np.full((N_LINKS, 2, 2), 1e-8)
    for _ in range(rounds):
        p, pairs = marginals(forest, model)
        expected = np.zeros_like(seen)
        np.add.at(expected, forest.link[below], pairs[below])
        dw = np.bincount(forest.columns, (p - y)[forest.rows], N_FEATURES) / n + l2 * model.weights
        dl = (expected - seen) / n + l2 * model.links
        gw += dw * dw
        gl += dl * dl
        model.weights -= rate * dw / np.sqrt(gw)
        model.links -= rate * dl / np.sqrt(gl)
    return model


def main_texts(pages: list[Page], model: Model) -> list[str]:
    """Content blocks of each page, joined by an empty line."""
    if not pages:
        return []
    p, _ = marginals(Forest.of(pages), model)
    out, start = [], 0
    for page in pages:
        out.append("\n\n".join(t for i, t in enumerate(page.text) if t is not None and p[start + i] > 0.5))
        start += len(page.parent)
    return out


def fitted(pages: DataFrame, limit: int = FIT_PAGES) -> Model:
    """A model from generated labelled pages and at most ``limit`` pages of the table, labelled by their markup."""
    sample = hash_sample(pages.select("page_id", "html").filter("html IS NOT NULL"), "page_id", limit).collect()
    known = labelled_pages.generated()
    known += [x for x in (labelled_pages.by_markup(parse(r["html"])) for r in sample) if x]
    return fit([p for p, _ in known], [c for _, c in known])


def extract(pages: DataFrame, model: Model) -> DataFrame:
    """page_id, url and text of every row of ``pages``, from its whole html.

    Null and empty html give an empty text, as do pages without content.  Null
    ids and urls stay, repeated rows give repeated results, other columns are
    ignored.  The model (a few hundred numbers) goes to the workers as a
    broadcast.
    """
    sent = pages.sparkSession.sparkContext.broadcast(model)
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()
    schema = f"page_id {kind}, url string, text string"
    to = arrow_schema(pages.sparkSession, schema)

    def run(batches):
        for b in batches:
            for start in range(0, b.num_rows, BATCH):
                part = b.slice(start, BATCH)
                texts = main_texts([parse(h) for h in part.column("html").to_pylist()], sent.value)
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url").cast(pa.string()), pa.array(texts, pa.string())],
                    schema=to)

    return rows.mapInArrow(run, schema)
