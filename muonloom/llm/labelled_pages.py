"""Labelled pages to fit the extractor on: generated from templates, and given ones labelled by their markup."""

from __future__ import annotations

import random
from collections.abc import Callable

from muonloom.llm.dom import HINTS, Page, parse

#: Number and seed of the generated pages.
PAGES, SEED = 400, 11
#: Marks content in generated pages; a character that no generated text has.
MARK = "\u0001"


def _sentence(r: random.Random, low: int = 4, high: int = 22) -> str:
    words = ["".join(r.choices("abcdefghijklmnoprstuvw", k=r.randint(2, 9))) for _ in range(r.randint(low, high))]
    return " ".join(words).capitalize() + r.choice(".....!?")


def _prose(r: random.Random, most: int = 5) -> str:
    return " ".join(_sentence(r) for _ in range(r.randint(1, most)))


def _label(r: random.Random) -> str:
    return _sentence(r, 1, 3).rstrip(".!?")


def _links(r: random.Random, n: int) -> str:
    return "".join(f'<li><a href="/{i}">{_label(r)}</a></li>' for i in range(n))


def _named(r: random.Random, tag: str, hint: int, inside: str, plain: float = 0.25) -> str:
    """An element; a bare div always has a telling class, others mostly."""
    name = r.choice(HINTS[hint].split())
    if tag not in ("div", "section", "td", "ul", "span") and r.random() < plain:
        return f"<{tag}>{inside}</{tag}>"
    kind = r.choice(["class", "class", "id"])
    extra = r.choice(["", "", "-wrapper", " box", "-area", " c" + str(r.randint(1, 9))])
    return f'<{tag} {kind}="{name}{extra}">{inside}</{tag}>'


def _menu(r):
    return _named(r, r.choice(["nav", "nav", "div", "ul"]), 0, f"<ul>{_links(r, r.randint(3, 9))}</ul>")


def _header(r):
    inside = r.choice([f"<h1>{_label(r)}</h1>", f"<h2>{_label(r)}</h2>", f"<p>{_label(r)}</p>", ""])
    inside += r.choice(["", f"<p>{_sentence(r)}</p>", _menu(r)])
    return _named(r, r.choice(["header", "header", "div"]), 1, inside)


def _plain_links(r):
    """Links in an element that does not say what it is."""
    inside = r.choice([f"<ul>{_links(r, r.randint(2, 7))}</ul>",
                       " ".join(f'<a href="/{i}">{_label(r)}</a>' for i in range(r.randint(2, 6)))])
    return f'<div class="z{r.randint(1, 99)}">{inside}</div>'


def _footer(r):
    inside = r.choice(["&copy; 2021 ", "Copyright &middot; ", ""]) + _prose(r, 2)
    inside = r.choice([inside, f"<p>{inside}</p>", f"<p>{inside}</p><ul>{_links(r, 4)}</ul>"])
    return _named(r, r.choice(["footer", "footer", "div"]), 2, inside)


def _side(r):
    inside = f"<h3>{_label(r)}</h3>" + r.choice([f"<ul>{_links(r, r.randint(2, 7))}</ul>", f"<p>{_prose(r, 3)}</p>"])
    return _named(r, r.choice(["aside", "aside", "div", "section"]), 3, inside)


def _notice(r):
    text = _prose(r, 2) + r.choice(["", "<button>OK</button>", ' <a href="#">More</a>'])
    return _named(r, r.choice(["div", "div", "section"]), 4, r.choice([text, f"<p>{text}</p>"]))


def _advert(r):
    text = r.choice([_sentence(r), _prose(r, 3), f'<a href="x">{_sentence(r)}</a>'])
    return _named(r, r.choice(["div", "div", "aside", "section"]), 5, r.choice([text, f"<p>{text}</p>"]))


def _form(r):
    inside = f"<label>{_label(r)}</label><input><p>{_sentence(r)}</p><button>Go</button>"
    return _named(r, r.choice(["form", "form", "div"]), 6, inside)


def _comments(r):
    one = lambda: r.choice([
        f"<li><p>{_label(r)}</p><p>{_prose(r)}</p></li>", f"<div><b>{_label(r)}</b> <p>{_prose(r)}</p></div>",
        f'<div class="comment"><p>{_prose(r)}</p></div>', f"<p>{_prose(r)}</p>"])
    inside = r.choice(["", f"<h3>{_label(r)}</h3>"]) + "".join(one() for _ in range(r.randint(1, 6)))
    return _named(r, r.choice(["div", "section"]), 7, inside)


def _share(r):
    return _named(r, r.choice(["div", "ul"]), 8, _links(r, r.randint(2, 5)))


def _byline(r):
    return _named(r, "div", 9, f"{_label(r)}, {r.randint(1, 28)} May")


def _block(r: random.Random) -> str:
    """A block of an article, marked."""
    m = lambda text: MARK + text
    return r.choices([
        lambda: f"<p>{m(_prose(r))}</p>", lambda: f"<p>{m(_prose(r, 2))}", lambda: f"<p>{m(_sentence(r, 1, 4))}</p>",
        lambda: f"<h2>{m(_label(r))}</h2>", lambda: f"<blockquote>{m(_prose(r, 2))}</blockquote>",
        lambda: f"<blockquote><p>{m(_prose(r, 2))}</p></blockquote>",
        lambda: "<ul>" + "".join(f"<li>{m(_sentence(r, 2, 9))}</li>" for _ in range(r.randint(2, 5))) + "</ul>",
        lambda: "<ol>" + "".join(f"<li><p>{m(_sentence(r))}</p>" for _ in range(r.randint(2, 4))) + "</ol>",
        lambda: f"<pre>{m(_sentence(r))}</pre>",
        lambda: "<table>" + "".join(f"<tr><td>{m(_label(r))}<td>{m(_label(r))}</tr>" for _ in range(2)) + "</table>",
        lambda: f'<p>{m(_sentence(r))} <a href="/x">{_label(r)}</a> {_prose(r, 2)}</p>',
        lambda: f"<p><b>{m(_sentence(r))}</b><br>", lambda: f"<div>{m(_prose(r, 2))}</div>",
        lambda: f"<figure><img src=a><figcaption>{m(_sentence(r))}</figcaption></figure>",
    ], [14, 2, 3, 2, 1, 1, 1.5, 0.7, 0.6, 0.6, 2, 2, 1, 0.4])[0]()


def _page(r: random.Random) -> str:
    within: list[Callable] = [_advert, _advert, _share, _form, _side, _notice]
    title = f"<h1>{MARK}{_sentence(r, 2, 12)}</h1>" if r.random() < 0.8 else ""
    if title and r.random() < 0.2:
        title = f"<header>{title}</header>"
    parts = [title, _byline(r) if r.random() < 0.2 else ""]
    short = r.random() < 0.2  # verses, quotes, logs: only short blocks, perhaps alike
    same = _label(r) if short and r.random() < 0.5 else None
    for _ in range(r.choice([5, 20, 60]) if short else r.choice([0, 1, 2, 3, 5, 8, 14])):
        parts.append(f"<p>{MARK}{same or _sentence(r, 1, 4).rstrip('.')}</p>" if short else _block(r))
        if r.random() < 0.08:
            parts.append(r.choice(within)(r))
    inside = "".join(parts)
    tag = r.choice(["article", "article", "article", "main", "div", "div", "section", "td"])
    if r.random() < 0.2:  # nothing says where the article is
        tag = r.choice(["div", "div", "section", "td", "body"])
        name = r.choice(["", f' class="c{r.randint(1, 99)}"', ' class="left"', ' id="a1"'])
        body = inside if tag == "body" else f"<{tag}{name}>{inside}</{tag}>"
    elif tag in ("article", "main") and r.random() < 0.6:
        body = f"<{tag}>{inside}</{tag}>"
    else:
        body = _named(r, tag, 10, inside, 0.5)
    if tag == "td":
        left = r.choice(["", f"<td>{_plain_links(r)}</td>", "<td>" + "<br>".join(
            f'<a href="/{i}">{_label(r)}</a>' for i in range(r.randint(2, 6))) + "</td>"])
        right = r.choice(["", f'<td class="sidebar">{_side(r)}</td>'])
        body = f"<table><tr>{left}{body}{right}</tr></table>"
    if r.random() < 0.3:
        body = f"<div class=\"{r.choice(['wrap', 'container', 'content', 'row', 'x1'])}\">{body}{r.choice(['', _side(r)])}</div>"
    pick = lambda chance, part: part(r) if r.random() < chance else ""
    after = [pick(0.35, _comments), pick(0.25, _side), pick(0.15, _form), pick(0.15, _share), pick(0.15, _advert)]
    r.shuffle(after)
    after.append(pick(0.2, _plain_links))
    before = [pick(0.2, _plain_links), pick(0.45, _header), pick(0.75, _menu), pick(0.25, _notice), pick(0.4, _advert), pick(0.15, _form),
              pick(0.15, _side)]
    head = f"<head><title>{_sentence(r)}</title><script>var a = '<p>';</script></head>"
    return (f"<!DOCTYPE html><html>{head}<body>{''.join(before)}{body}{''.join(after)}{pick(0.8, _footer)}"
            + r.choice(["</body></html>", ""]))


def _framed(r: random.Random, html: str) -> str:
    """The page inside elements whose names speak of parts that they only hold."""
    part = r.choice([w for h in (0, 1, 2, 3, 5, 6) for w in HINTS[h].split()])
    outer = r.choice([f'<div class="has-{part}">', f'<div class="no-{part}">', f'<div id="page-{part}-wrapper">',
                      f'<div class="with-{part} layout">', "<form>", '<form id="page" action="#">'])
    body = r.choice(["<body>", f'<body class="page has-{part}">', f'<body class="{part}-left single">'])
    return html.replace("<body>", body + outer, 1)


def generated(n: int = PAGES, seed: int = SEED) -> list[tuple[Page, list[bool]]]:
    """Pages with a label per text block."""
    r, frames, out = random.Random(seed), random.Random(seed + 1), []
    for _ in range(n):
        html = _page(r)
        page = parse(_framed(frames, html) if frames.random() < 0.2 else html)
        labels = [MARK in t for t in page.text if t is not None]
        page.text = [t and t.replace(MARK, "") for t in page.text]
        if labels:
            out.append((page, labels))
    return out


def by_markup(page: Page) -> tuple[Page, list[bool]] | None:
    """Labels from elements that say what they are; None for pages without article or main."""
    if not {"article", "main"} & set(page.tag):
        return None
    state = [False] * len(page.parent)
    for i in range(1, len(page.parent)):
        state[i] = state[page.parent[i]]
        if page.tag[i] in ("article", "main") and 7 not in page.hints[i]:
            state[i] = True
        elif page.tag[i] in ("nav", "aside", "footer", "form") or any(h < 9 for h in page.hints[i]):
            state[i] = False
    labels = [state[i] for i in range(len(state)) if page.text[i] is not None]
    return (page, labels) if labels else None
