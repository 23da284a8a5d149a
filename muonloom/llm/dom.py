"""A page as a tree of block elements with text blocks as leaves, and features of its nodes."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from html import unescape

import numpy as np

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(?P<end>/)?(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/)?(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)(?:>|\Z)", re.S)
NAMED = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# fixed values: kinds of elements
#: Elements whose content is never text of the page: raw text up to the end tag, and markup.
RAW = frozenset("script style title textarea iframe".split())
HIDDEN = frozenset("noscript template svg object select button canvas audio video".split())
#: Hidden elements that a start tag of the same name ends.
SINGLE = frozenset("select button".split())
#: Elements whose kind says that they are no article.
ZONED = frozenset("nav header footer aside form".split())
HIDDEN_START = re.compile(rf"<(?:{'|'.join(sorted(HIDDEN))})[\s/>]", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset "
                   "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav "
                   "ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: A start tag that ends an open element of the second list, up to one of the third.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("table", "tr")),
    "th": (("td", "th"), ("table", "tr")), "tbody": (("thead", "tbody", "tfoot", "tr", "td", "th"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "tr", "td", "th"), ("table",)), "body": (("head",), ("html",)),
}
KINDS = ["article main", "section", "div center details", "p", "h1", "h2 h3 h4 h5 h6", "ul ol dl menu",
         "li dt dd", "table tbody thead tfoot tr", "td th caption", "blockquote pre figure figcaption", "nav",
         "header", "footer", "aside", "form fieldset legend dialog", "body html"]
#: Words in class, id and role that hint at a part of a page.
HINTS = [
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc tabs topbar toolbar",
    "header masthead logo branding brand sitename hero top",
    "footer foot copyright colophon legal bottom contentinfo imprint",
    "sidebar side aside widget widgets rail related recommended recommendations popular trending archive "
    "blogroll complementary tags also readmore",
    "cookie cookies consent gdpr notice notices alert popup modal overlay message warning disclaimer toast privacy",
    "ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion banner "
    "commercial partner",
    "form search login signin signup subscribe subscription newsletter contact register poll survey",
    "comment comments commentlist reply replies respond discussion disqus responses thread feedback reader readers",
    "share sharing social follow print tools",
    "byline meta author date timestamp posted credit",
    "content article post entry main story body text articlebody postbody hentry prose",
]
#: A name that begins so speaks of another part of the page: has-sidebar, no-ads, withHeader.
OF_OTHERS = frozenset("has no non not with without".split())
KIND_OF = {tag: i for i, tags in enumerate(KINDS) for tag in tags.split()}
HINT_OF = {word: i for i, words in enumerate(HINTS) for word in words.split()}
WORDS_AT = (0, 2, 5, 10, 20, 50, 200)
LINKS_AT = (0.0, 0.25, 0.6)
PLACES_AT = (0.1, 0.3, 0.7, 0.9)
N_KIND, N_HINT = len(KINDS) + 1, len(HINTS)
SHARED = N_KIND + N_HINT
BINS = len(WORDS_AT) + 1 + len(LINKS_AT) + 1
#: Columns: kind and hints of the element (of a leaf: of its parent), then bins, once for leaves, once for elements.
N_ZONES = 5
ZONE_AT = SHARED + BINS + 3 + len(PLACES_AT) + 1
N_FEATURES = 2 * (ZONE_AT + N_ZONES)


@dataclass
class Page:
    """Nodes in document order; a parent comes before its children.  Leaves have a text."""

    parent: list[int] = field(default_factory=lambda: [-1])
    tag: list[str] = field(default_factory=lambda: ["html"])
    hints: list[tuple[int, ...]] = field(default_factory=lambda: [()])
    text: list[str | None] = field(default_factory=lambda: [None])
    linked: list[int] = field(default_factory=lambda: [0])  # characters inside links, of leaves

    def add(self, parent: int, tag: str, hints: tuple[int, ...] = (), text: str | None = None, linked: int = 0) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.hints.append(hints)
        self.text.append(text)
        self.linked.append(linked)
        return len(self.parent) - 1


def hints_of(attrs: str) -> tuple[int, ...]:
    found = set()
    for m in NAMED.finditer(attrs):
        for name in (m[1] or m[2] or m[3] or "").split():
            parts = [part.lower() for part in PART.findall(name)]
            if parts and parts[0] not in OF_OTHERS:
                found.update(HINT_OF[part] for part in parts if part in HINT_OF)
    return tuple(sorted(found))


def after_raw(html: str, tag: str, at: int) -> int:
    """Where the raw text of an element ends whose start tag ends at ``at``; without an end tag, with the page."""
    stop = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(html, at)
    close_at = html.find(">", stop.start()) if stop else -1
    return close_at + 1 if close_at >= 0 else len(html)


def hidden_ends(html: str) -> dict[int, int]:
    """Where the hidden elements end that have an end tag inside their parent block, by where they start."""
    ends: dict[int, int] = {}
    open_: list[tuple[str, int]] = []  # open blocks and hidden elements
    depth: Counter[str] = Counter()  # how many of each are open

    def close(tag: str) -> int:
        while True:
            name, start = open_.pop()
            depth[name] -= 1
            if name == tag:
                return start

    first = HIDDEN_START.search(html)
    at, n = 0 if first else len(html), len(html)
    while at < n and (m := TOKEN.search(html, at)):
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if m["end"] or m["end2"]:
            if depth[tag]:
                start = close(tag)
                if tag in HIDDEN:
                    ends[start] = at
            continue
        # a slash ends an element in svg only
        empty = (tag == "svg" or depth["svg"] > 0) and (m["attrs"] or m["attrs2"] or "").endswith("/")
        if empty or tag == "hr":
            continue
        if tag in RAW:
            at = after_raw(html, tag, at)
        elif tag in HIDDEN or tag in BLOCKS:
            if tag in SINGLE and depth[tag]:
                open_.pop(max(i for i, (name, _) in enumerate(open_) if name == tag))
                depth[tag] -= 1
            open_.append((tag, m.start()))
            depth[tag] += 1
    return ends


def parse(html: str) -> Page:
    """The tree of a page; broken markup closes what it can, unknown end tags are ignored.

    A hidden element without an end tag in its parent block hides what stands
    before the next block-level tag.
    """
    page = Page()
    open_ = [0]  # open block elements, by node
    run: list[str] = []
    in_link = linked = 0
    ends, muted = hidden_ends(html), ""  # muted: an open hidden element without an end tag

    def flush() -> None:
        nonlocal linked
        if run:
            text = " ".join("".join(run).split())
            if text:
                page.add(open_[-1], "#text", (), text, min(linked, len(text)))
            run.clear()
        linked = 0

    def close(tags: tuple[str, ...], until: tuple[str, ...]) -> None:
        for depth in range(len(open_) - 1, 0, -1):
            tag = page.tag[open_[depth]]
            if tag in until:
                return
            if tag in tags:
                del open_[depth:]
                return

    at, n = 0, len(html)
    while at < n:
        m = TOKEN.search(html, at)
        end = m.start() if m else n
        if end > at and not muted:
            piece = unescape(html[at:end])
            run.append(piece)
            if in_link:
                linked += len(piece.strip())
        if not m:
            break
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if not tag:
            continue
        tag = tag.lower()
        attrs = m["attrs"] or m["attrs2"] or ""
        if tag in BLOCKS:
            muted = ""
        if m["end"] or m["end2"]:
            if tag == "a":
                in_link = 0
            elif tag in BLOCKS:
                flush()
                for depth in range(len(open_) - 1, 0, -1):
                    if page.tag[open_[depth]] == tag:
                        del open_[depth:]
                        break
            elif tag == "br":
                run.append(" ")
            continue
        if (tag == "svg" or muted == "svg") and attrs.endswith("/"):
            continue
        if tag in RAW:
            at = after_raw(html, tag, at)
            continue
        if tag in HIDDEN:
            if m.start() in ends:
                at = ends[m.start()]
            else:
                muted = tag
            continue
        if tag == "a":
            in_link = 1
        elif tag in BLOCKS:
            flush()
            if tag == "hr":
                continue
            if page.tag[open_[-1]] == "p" or any(page.tag[i] == "p" for i in open_):
                close(("p",), ("td", "th", "table"))
            if tag in CLOSES:
                close(*CLOSES[tag])
            in_link = 0
            if tag != "html":  # names of the body speak of the whole page
                open_.append(page.add(open_[-1], tag, () if tag == "body" else hints_of(attrs)))
        elif tag in VOID or tag == "br":
            run.append(" " if tag in ("br", "img", "wbr", "input") and tag != "wbr" else "")
    flush()
    unframe(page)
    return page


def unframe(page: Page) -> None:
    """Takes the names off elements that frame the page instead of being a part of it.

    Such an element holds ``main``, or most of the text outside reader comments
    together with the article, its heading or (a form) other parts of the page.
    Comments, menus, asides and footers are frames only around ``main``.
    """
    n = len(page.parent)
    chars, heading = [0] * n, [0] * n
    comments, main, article, parts = ([False] * n for _ in range(4))
    for i in range(1, n):
        comments[i] = comments[page.parent[i]] or 7 in page.hints[i]
    for i in range(n - 1, 0, -1):
        up, tag, hints = page.parent[i], page.tag[i], page.hints[i]
        if page.text[i] is not None and not comments[i]:
            chars[i] = len(page.text[i])
        if tag == "h1":
            heading[i] = chars[i]
        named = any(h < 9 for h in hints)
        main[up] |= main[i] or tag == "main"
        article[up] |= article[i] or (not comments[i] and not named and (tag == "article" or 10 in hints))
        parts[up] |= parts[i] or tag in ("nav", "header", "footer")
        chars[up] += chars[i]
        heading[up] += heading[i]
    for i in range(1, n):
        tag, hints = page.tag[i], page.hints[i]
        if page.text[i] is not None or not (tag in ZONED or any(h < 9 for h in hints)):
            continue
        header = tag == "header" or 1 in hints
        titled = not header and 0 < 2 * heading[i] < chars[i]
        most = 7 not in hints and tag not in ("nav", "aside", "footer") and 2 * chars[i] > chars[0]
        if main[i] or most and (article[i] or titled or tag == "form" and parts[i]):
            page.hints[i] = tuple(h for h in hints if h >= 9)
            page.tag[i] = "div" if tag in ZONED else tag


def bin_of(value: float, edges: tuple) -> int:
    for i, edge in enumerate(edges):
        if value <= edge:
            return i
    return len(edges)


def zone_of(tag: str, hints: tuple[int, ...], outer: int) -> int:
    """Where an element stands, given where its parent does.

    0 nowhere special, 1 in what calls itself the article, 2 in a header of the
    page, 3 in a header of the article, 4 in something else that says what it is.
    """
    if tag in ("article", "main") and outer != 4 and 7 not in hints:
        return 1
    if tag == "header" or 1 in hints:
        return 3 if outer in (1, 3) else 2 if outer == 0 else outer
    if tag in ZONED or any(h < 9 for h in hints):
        return 4
    return 1 if 10 in hints and outer == 0 else outer


def features(page: Page) -> list[list[int]]:
    """Columns that are on, per node."""
    n = len(page.parent)
    words, chars, links = [0] * n, [0] * n, list(page.linked)
    for i in range(n - 1, 0, -1):
        text = page.text[i]
        if text is not None:
            words[i], chars[i] = text.count(" ") + 1, len(text)
        up = page.parent[i]
        words[up] += words[i]
        chars[up] += chars[i]
        links[up] += links[i]
    out, half, before, total = [], N_FEATURES // 2, 0, max(words[0], 1)
    zones = [0] * n
    for i in range(n):
        text = page.text[i]
        leaf = text is not None
        owner = page.parent[i] if leaf else i
        base = 0 if leaf else half
        on = [base + KIND_OF.get(page.tag[owner], N_KIND - 1)]
        on += [base + N_KIND + h for h in page.hints[owner]]
        on.append(base + SHARED + bin_of(words[i], WORDS_AT))
        density = links[i] / chars[i] if chars[i] else 0.0
        on.append(base + SHARED + len(WORDS_AT) + 1 + bin_of(density, LINKS_AT))
        on.append(base + SHARED + BINS)
        if leaf:
            if text[-1] in ".!?…\"”":
                on.append(base + SHARED + BINS + 1)
            if "©" in text or "(c)" in text.lower():
                on.append(base + SHARED + BINS + 2)
        on.append(base + SHARED + BINS + 3 + bin_of(before / total, PLACES_AT))
        if leaf:
            before += words[i]
        if i:
            zones[i] = zones[owner] if leaf else zone_of(page.tag[i], page.hints[i], zones[page.parent[i]])
        on.append(base + ZONE_AT + zones[i])
        out.append(on)
    return out


@dataclass
class Forest:
    """Pages laid one after another: parents, kind of each parent-child link, features, depth order."""

    parent: np.ndarray
    link: np.ndarray
    rows: np.ndarray
    columns: np.ndarray
    levels: list[np.ndarray]

    @staticmethod
    def of(pages: list[Page]) -> "Forest":
        parent, link, rows, columns, depth = [], [], [], [], []
        for page in pages:
            start = len(parent)
            for i, on in enumerate(features(page)):
                up = page.parent[i]
                parent.append(up + start if up >= 0 else -1)
                depth.append(depth[up + start] + 1 if up >= 0 else 0)
                # links into leaves, hinted elements and plain elements have potentials of their own
                link.append(0 if page.text[i] is not None else 1 if page.hints[i] or page.tag[i] in OWN_KIND else 2)
                rows.extend([start + i] * len(on))
                columns.extend(on)
        depths = np.array(depth)
        levels = [np.flatnonzero(depths == d) for d in range(depths.max() + 1)] if depth else []
        return Forest(np.array(parent), np.array(link), np.array(rows), np.array(columns), levels)


#: Elements whose name already says what they are.
OWN_KIND = frozenset("nav header footer aside form article main".split())
N_LINKS = 3
