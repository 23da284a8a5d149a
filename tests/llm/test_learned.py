"""Extraction and toxicity: exact inference, held-out accuracy, edge cases."""

import itertools
import math

import numpy as np
import pytest

from muonloom.llm import extract, labelled_pages, toxicity
from muonloom.llm.dom import Forest, N_FEATURES, N_LINKS, parse

CHROME = '<nav><ul><li><a href=/a>Home</a><li><a href=/b>About us</a></ul></nav>'


@pytest.fixture(scope="module")
def model():
    known = labelled_pages.generated()
    return extract.fit([p for p, _ in known], [c for _, c in known])


def text_of(model, html):
    return extract.main_texts([parse(html)], model)[0]


def test_marginals_are_exact():
    r = np.random.default_rng(1)
    model = extract.Model(r.normal(size=N_FEATURES), r.normal(size=(N_LINKS, 2, 2)))
    page = parse("<div class=x><p>One two three.</p><ul><li>a<li>b</ul></div><footer>end</footer>")
    forest = Forest.of([page])
    n = len(forest.parent)
    own = np.bincount(forest.rows, model.weights[forest.columns], n)
    total, on = 0.0, np.zeros(n)
    for y in itertools.product((0, 1), repeat=n):
        s = sum(own[i] * y[i] for i in range(n))
        s += sum(model.links[forest.link[i], y[forest.parent[i]], y[i]] for i in range(1, n))
        total += math.exp(s)
        on += math.exp(s) * np.array(y)
    assert np.allclose(extract.marginals(forest, model)[0], on / total)


BODY = "<p>It was a long day, and nobody spoke a word.</p><p>Later they all went home again.</p>"


@pytest.mark.parametrize("open_", [
    '<svg class="i"/>', "<svg/>", "<math/>", "<svg><use href='#i'/><title/></svg>", "<button>", "<select><option>x",
    "<object>", "<audio>", "<video>", "<canvas>", "<noscript>", "<template>", "<svg><path d='M0 0'>"])
def test_open_or_empty_elements_hide_no_blocks(open_):
    tag = open_[1:].split("<")[0].split(">")[0].split()[0].rstrip("/")
    whole = ["T", "It was a long day, and nobody spoke a word.", "Later they all went home again."]
    for html in (f"<article><h1>T</h1>{open_}{BODY}</article>",
                 f"<body><div>{open_}</div><article><h1>T</h1>{BODY}</article><div><{tag}></{tag}></div></body>",
                 f"<article><h1>T</h1>{open_}{BODY}<{tag}></{tag}></article>"):
        assert [t for t in parse(html).text if t] == whole, html


def test_closed_elements_hide_their_blocks():
    for inner in ("<button><div>no</div></button>", "<template><ul><li>no<li>no</ul><template>no</template>no</template>",
                  "<svg><title>no</title><svg>no</svg><text>no</text></svg>", "<noscript><p>no</p></noscript>",
                  "<object><p>no<script>'</object>'</script></object>", "<select><option>no</select>"):
        assert [t for t in parse(f"<div>a{inner}b<p>c</p></div>").text if t] == ["ab", "c"], inner


def test_text_of_math_is_kept(model):
    html = f"<article><h1>A long day</h1>{BODY}<p>The sum is <math><mi>x</mi><mo>+</mo><mn>1</mn></math> today.</p></article>"
    assert "The sum is x+1 today." in text_of(model, html)


def test_article_after_empty_svg_and_open_button(model):
    for html in (f'<body>{CHROME}<article><h1>A long day</h1><svg class="i"/>{BODY}</article></body>',
                 f"<body>{CHROME}<div><button>Share</div><article><h1>A long day</h1>{BODY}</article></body>"):
        assert "Later they all went home again." in text_of(model, html)


def test_held_out_pages(model):
    right = wrong = 0
    for page, labels in labelled_pages.generated(200, seed=77):
        p, _ = extract.marginals(Forest.of([page]), model)
        got = [p[i] > 0.5 for i, t in enumerate(page.text) if t is not None]
        right += sum(a == b for a, b in zip(got, labels))
        wrong += sum(a != b for a, b in zip(got, labels))
    assert wrong < 0.02 * (right + wrong)


@pytest.mark.parametrize("around", [
    ("<article>", "</article>"), ("<main>", "</main>"), ('<div class="post-content">', "</div>"),
    ('<div id="content">', "</div>"), ('<section class="entry">', "</section>"),
    ("<div class=wrap><article>", "</article></div>")])
def test_templates(model, around):
    html = (f"<html><head><title>T</title><style>p{{}}</style></head><body><header><h1>Site name</h1></header>{CHROME}"
            '<div class="cookie-notice">We use cookies. <button>OK</button></div>'
            f"{around[0]}<h1>A long day &amp; night</h1><p>It was   a long\n day, and <b>nobody</b> spoke a word.</p>"
            "<p>Later &lt;they&gt; all went home&#33;<br>It rained again that evening, as ever.</p>"
            '<div class="ad">Buy two, pay one. Best prices in town.</div>'
            f"<ul><li>First point of the day.</li><li>Second point of the day.</li></ul>{around[1]}"
            '<aside class="sidebar"><h3>Popular</h3><ul><li><a href=/c>Other story</a></ul></aside>'
            '<form action=/s><p>Sign up for our letter.</p><input><button>Go</button></form>'
            '<section class="comments"><h3>2 comments</h3><div class="comment"><p>I liked this story very much, '
            "thank you for it.</p></div></section><footer>&copy; 2020 Site name. All rights reserved.</footer>"
            "<script>var a = '</p>';</script></body></html>")
    assert text_of(model, html) == "\n\n".join([
        "A long day & night", "It was a long day, and nobody spoke a word.",
        "Later <they> all went home! It rained again that evening, as ever.",
        "First point of the day.", "Second point of the day."])


STORY = "<h1>A long day</h1><p>It was a long day, and nobody spoke a word.</p><p>Later they all went home again.</p>"
AROUND_STORY = "A long day\n\nIt was a long day, and nobody spoke a word.\n\nLater they all went home again."


@pytest.mark.parametrize("html", [
    f'<body class="has-sidebar"><div class="layout"><div class="post">{STORY}</div></div></body>',
    f'<body class="sidebar-left single"><div class="post">{STORY}</div></body>',
    f'<div class="no-ads"><article>{STORY}</article></div>',
    f'<div class="page-header-wrapper"><div class="content">{STORY}</div></div>',
    f"<form>{CHROME}<article>{STORY}</article></form>",
    f'<form id="aspnetForm">{CHROME}<div id="content">{STORY}</div><footer>(c) 2020 Us.</footer></form>',
    f"<form>{CHROME}<div>{STORY}</div></form>",
    f'<div class="banner-layout">{CHROME}<main>{STORY}</main></div>',
    f'<div class="with-newsletter"><article>{STORY}</article>'
    f'<div class="newsletter"><p>Get our letter every week, free of charge.</p></div></div>'])
def test_names_of_outer_elements_are_no_verdict(model, html):
    assert text_of(model, html) == AROUND_STORY


@pytest.mark.parametrize("part", [
    '<div class="comments">' + "<article class='comment-body'><p>I liked this story very much, thanks.</p></article>" * 9
    + "</div>",
    '<div class="sidebar"><h3>Popular</h3><p>Read what others have read this week.</p></div>',
    '<form class="newsletter"><p>Get our letter every week, free of charge.</p><input></form>',
    '<div class="ad"><p>Buy two, pay one. Best prices in town.</p></div>'])
def test_parts_of_framed_pages_stay_out(model, part):
    for html in (f'<body class="has-sidebar"><div class="no-ads"><article>{STORY}</article>{part}</div></body>',
                 f"<form>{CHROME}<article>{STORY}</article>{part}</form>"):
        assert text_of(model, html) == AROUND_STORY


@pytest.mark.parametrize("html", ["", " ", "<", "<p", "</p></div>", "<script>x", "<!-- <p>x</p>", "<a href='x>y</a>",
                                  "<p>" * 300, "<div>" * 2000 + "x", "&#xFFFFFFFF; &bogus; &amp", "<ul><li><table><td>"])
def test_broken_markup(model, html):
    assert isinstance(text_of(model, html), str)


def test_extract_table(spark, model):
    body = "<article><p>It was a long day, and nobody spoke a word until the evening came.</p></article>"
    long = "<article>" + "<p>It was a long day, and nobody spoke a word.</p>" * 20_000 + "</article>"
    rows = [(1, "u", body), (2, None, None), (3, "u", ""), (None, "u", body), (1, "u", body), (4, "u", long)]
    df = spark.createDataFrame([r + ("x", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = sorted((str(r.page_id), r.text) for r in extract.extract(df, model).collect())
    said = "It was a long day, and nobody spoke a word until the evening came."
    assert [g for g in got if g[0] != "4"] == [("1", said), ("1", said), ("2", ""), ("3", ""), ("None", said)]
    assert got[4][1].count("nobody") == 20_000
    assert extract.extract(df.limit(0), model).count() == 0


def test_tables_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = extract.extract(pages, extract.fitted(pages)).collect()
    assert all(r.text and "track(" not in r.text and "©" not in r.text for r in got) and len(got) == pages.count()


@pytest.fixture(scope="module")
def labelled(spark):
    folder = "/root/testdata/sf0.1"
    return (spark.read.parquet(f"{folder}/documents.parquet"),
            toxicity.categories(spark.read.parquet(f"{folder}/labels.parquet")))


def test_chain_on_held_out_documents(labelled):
    docs, labels = labelled
    lists, y = toxicity.labelled_sample(docs, labels, ["junk", "toxic"], 10_000)
    cut = len(lists) * 3 // 4
    chain = toxicity.fit_chain(lists[:cut], y[:cut], ["junk", "toxic"])
    assert len(chain.models[1].earlier) == 1 and len(chain.models[0].earlier) == 0
    scorer = toxicity.Scorer(chain)
    texts = {r.doc_id: r.text for r in docs.collect()}
    marks = {r.doc_id: r.toxic for r in labels.collect()}
    fitted = set()  # the sample is in order of ids
    ids = sorted(i for i in marks if i in texts)
    fitted.update(ids[:cut])
    rest = [i for i in ids if i not in fitted]
    said = {i: scorer(texts[i].encode())[1] >= toxicity.TOXIC for i in rest}
    caught = sum(said[i] for i in rest if marks[i])
    false = sum(said[i] for i in rest if not marks[i])
    assert caught >= 0.85 * sum(marks[i] for i in rest) and false <= 0.02 * len(rest)


def test_columns_are_chosen_out_of_fold():
    r = np.random.default_rng(1)
    lists = [np.unique(r.integers(0, 1000, 30)).astype(np.int32) for _ in range(300)]
    y = np.zeros((300, 2))
    for i in range(0, 300, 3):
        lists[i] = np.union1d(lists[i], [5000]).astype(np.int32)
        y[i] = 1
    chain = toxicity.fit_chain(lists, y, ["a", "b"])
    assert all(5000 in m.columns for m in chain.models) and chain.models[1].earlier.shape == (1,)


def test_score_edges(spark, edge, nothing):
    docs = spark.createDataFrame([(i, "you idiot" if i % 2 else "fine day", i) for i in range(60)],
                                 "doc_id long, text string, junk int")
    marks = spark.createDataFrame([(i, 0, i % 2) for i in range(60)] + [(None, 1, 1), (3, None, 1), (999, 0, 1)],
                                  "doc_id long, junk int, toxic int")
    chain = toxicity.fit(docs, marks)
    got = toxicity.score(edge, chain).collect()
    assert len(got) == edge.count() and all(0 < r.p_toxic < 1 and 0 < r.p_junk < 1 for r in got)
    assert toxicity.score(nothing, chain).count() == 0
    said = {r.doc_id: r.p_toxic for r in toxicity.score(docs, chain).collect()}
    assert said[1] > toxicity.TOXIC > said[2]
    empty = toxicity.fit(nothing, marks.limit(0))
    assert toxicity.score(edge, empty).count() == edge.count()
