"""Main-text extraction by a tree-structured graphical model over the page's nodes.

Each element carries a hidden label, content or not.  A node potential comes from a logistic
model of the element's own features (tag, class words, links, text), an edge potential from how
often the labels of parent and child go together.  As the graph is a tree, one pass of
sum-product messages up and one down give every element's exact marginal.  Text whose element
is content with probability 1/2 or more is kept.

Both potentials are trained on labelled pages.  None are given, so ``labelled_pages`` lays out
pages by rule, with every part marked as article or not; ``fit`` takes any labelled trees.

Defined results: a null or empty page has an empty text; a page without tags is all content;
unclosed and misnested elements are closed as browsers do; unknown tags are plain inline ones;
scripts, styles, comments and other unseen parts never give text; a probability of just 1/2 is
content; rows that repeat are extracted alike; a very long page takes time and memory in
proportion to its length; an empty table gives no rows; other columns, whatever their names,
pass through unchanged, and one named like the added column is replaced.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template svg math iframe object canvas".split())
#: Elements whose text is never shown as part of a page's body.
UNSEEN = RAW | {"head", "select", "option", "datalist"}
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_CLOSES_P = BLOCK - {"br", "body", "html", "li", "dd", "dt", "caption", "legend", "summary", "tbody", "td", "tfoot", "th", "thead", "tr", "figcaption"}
#: An opening tag closes these, up to the nearest of the second set.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, {"html"}),
}

#: Class and id words, by what they tell.
WORDS = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager tabs toolbar toc skip topbar".split(),
    "head": "header masthead banner hero logo brand topper".split(),
    "foot": "footer foot copyright colophon legal bottom".split(),
    "side": "sidebar aside rail widget widgets related recommend recommended trending popular promo secondary more".split(),
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promotion adsense dfp".split(),
    "notice": "notice notices cookie cookies consent alert popup modal overlay gdpr warning newsletter subscribe signup banner-notice disclaimer paywall".split(),
    "social": "share sharing social follow tags tag meta byline author-bio login".split(),
    "comment": "comment comments reply replies respond discussion disqus reader-comments thread".split(),
    "form": "form search searchform input contact".split(),
    "main": "article content main post entry story text page-content body post-content entry-content article-body story-body prose".split(),
}
_KIND = {w: kind for kind, ws in WORDS.items() for w in ws}
_TAGS = ("article", "main", "section", "div", "p", "h1", "h2", "li", "ul", "nav", "header", "footer", "aside", "form", "a", "button", "blockquote", "pre", "table", "figure", "body", "inline")
_OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>\"']*)")
_RUN = re.compile(r"[^>\"']*")
_ATTR = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")
_TELLS = {"nav": ("menu",), "footer": ("foot",), "header": ("head",), "aside": ("side",), "form": ("form",), "article": ("main",), "main": ("main",)}
_SPACE = re.compile(r"\s+")
_CLOSERS: dict[str, re.Pattern] = {}


class Node:
    __slots__ = ("above", "chars", "children", "closest", "kinds", "link", "mark", "parent", "tag", "text")

    def __init__(self, tag: str, parent: int, kinds: tuple[str, ...] = (), mark: str = "") -> None:
        self.tag, self.parent, self.kinds, self.mark = tag, parent, kinds, mark
        self.children: list[int] = []
        self.above: tuple[str, ...] = ()  # what the elements around it tell
        self.closest: tuple[str, ...] = ()  # what the closest of them that tells anything does
        self.text = self.chars = self.link = 0  # own characters; all below; those in links


def _kinds(attributes: str) -> tuple[str, ...]:
    out = set()
    for m in _ATTR.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").split():
            low = name.lower()
            if low in _KIND:
                out.add(_KIND[low])
            else:
                out.update(_KIND[w] for w in _SPLIT.split(low) if w in _KIND)
    return tuple(sorted(out))


def _tags(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, "/" or "", name, attributes) of every tag; comments and the like have no name.

    A quote counts only after "=".  Each byte is looked at a bounded number of times: once a tag
    has run to the end of the page for a quote that never closes, tags end at the next ">".
    """
    at, size, plain = 0, len(page), False
    while (i := page.find("<", at)) >= 0:
        if page.startswith(("<!--", "<![CDATA["), i):
            close = "-->" if page[i + 2] == "-" else "]]>"
            j = page.find(close, i + 4)
            at = j + 3 if j >= 0 else size
            yield i, at, "", "", ""
            continue
        if page[i + 1 : i + 2] in ("!", "?"):
            j = page.find(">", i)
            at = j + 1 if j >= 0 else size
            yield i, at, "", "", ""
            continue
        m = _OPEN.match(page, i)
        if m is None:
            at = i + 1
            continue
        end = m.end()
        while end < size and page[end] != ">":
            before = end - 1
            while page[before].isspace():
                before -= 1
            j = page.find(page[end], end + 1) if page[before] == "=" and not plain else -1
            end = _RUN.match(page, max(end, j) + 1).end()
        if end >= size:
            plain, end = True, page.find(">", i)
            if end < 0:
                return
        at = end + 1
        yield i, at, m[1], m[2].lower(), page[m.start(3) : end]


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """The elements in page order, and the page's texts and breaks: (element, text) with "" for a break."""
    nodes, flow = [Node("#root", -1)], []
    stack, at, mark = [0], 0, re.compile(r"data-label\s*=\s*\"(\w+)\"")
    opened: Counter[str] = Counter()  # of the tags in the stack, so that none is looked for in vain

    def say(text: str) -> None:
        if text:
            flow.append((stack[-1], html.unescape(text) if "&" in text else text))

    def close(to: int) -> None:
        for n in stack[to:]:
            if nodes[n].tag in BLOCK:
                flow.append((nodes[n].parent, ""))
                break
        for n in stack[to:]:
            opened[nodes[n].tag] -= 1
        del stack[to:]

    for start, end, closing, tag, attributes in _tags(page):
        if start < at:
            continue
        say(page[at:start])
        at = end
        if not tag:
            continue
        if closing:
            for i in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if nodes[stack[i]].tag == tag:
                    close(i)
                    break
                if nodes[stack[i]].tag in ("td", "th", "table", "body") and tag not in BLOCK:
                    break
            else:
                if tag in ("p", "br"):
                    flow.append((stack[-1], ""))
            continue
        if (tag == "p" or tag in _CLOSES_P) and opened["p"]:
            for i in range(len(stack) - 1, 0, -1):
                if nodes[stack[i]].tag == "p":
                    close(i)
                    break
                if nodes[stack[i]].tag in BLOCK:
                    break
        if tag in _CLOSES:
            ends, stops = _CLOSES[tag]
            for i in range(len(stack) - 1, 0, -1) if any(opened[x] for x in ends) else ():
                if nodes[stack[i]].tag in ends:
                    close(i)
                    if tag not in ("tr",):
                        break
                elif nodes[stack[i]].tag in stops:
                    break
        if tag in BLOCK:
            flow.append((stack[-1], ""))
        if tag in VOID:
            continue
        n = len(nodes)
        found = mark.search(attributes) if "data-label" in attributes else None
        nodes.append(Node(tag, stack[-1], _kinds(attributes) if "=" in attributes else (), found[1] if found else ""))
        nodes[stack[-1]].children.append(n)
        if attributes.endswith("/") and tag in ("svg", "math"):
            continue
        if tag in RAW:
            ended = _CLOSERS.setdefault(tag, re.compile(rf"</{tag}(?=[\s/>])[^>]*>?|$(?![\s\S])", re.I)).search(page, at)
            at = ended.end() if ended else len(page)
            continue
        stack.append(n)
        opened[tag] += 1
    say(page[at:])
    for n, text in flow:
        if text:
            nodes[n].text += 0 if text.isspace() else len(text)
    for x in nodes[1:]:
        up = nodes[x.parent]
        told = up.kinds + _TELLS.get(up.tag, ())
        x.above, x.closest = (tuple(sorted({*up.above, *told})), told) if told else (up.above, up.closest)
    for n in range(len(nodes) - 1, -1, -1):
        x = nodes[n]
        x.chars += x.text
        x.link = x.chars if x.tag == "a" else x.link
        if x.parent >= 0:
            nodes[x.parent].chars += x.chars
            nodes[x.parent].link += x.link
    return nodes, flow


#: The page itself, which is content only for the text that stands in it bare; it tells nothing of its children.
_PAGE = frozenset(("#root", "html", "body"))


def signature(nodes: list[Node], n: int) -> tuple:
    """What the node potential depends on."""
    x = nodes[n]
    tag = x.tag if x.tag in _TAGS else {"h3": "h2", "h4": "h2", "h5": "h2", "h6": "h2", "ol": "ul", "menu": "ul", "input": "form", "fieldset": "form", "label": "form", "hgroup": "header"}.get(x.tag, "inline" if x.tag not in BLOCK else "section")
    share = x.link / x.chars if x.chars else 0.0
    chars = x.chars
    if x.tag in _PAGE:  # what stands in it bare
        tag, share, chars = "body", 0.0, x.text
    return (tag, x.kinds, x.above, x.closest, 0 if share < 0.2 else 1 if share < 0.6 else 2, 0 if chars == 0 else 1 if chars < 80 else 2 if chars < 400 else 3)


_COLUMNS = [*_TAGS, *("." + k for k in WORDS), *("in " + k for k in WORDS), *("by " + k for k in WORDS), "link1", "link2", "empty", "short", "middle", "long", "one"]
_INDEX = {c: i for i, c in enumerate(_COLUMNS)}


def _vector(sign: tuple) -> list[int]:
    tag, kinds, above, closest, link, size = sign
    return [_INDEX[tag], *(_INDEX["." + k] for k in kinds), *(_INDEX["in " + k] for k in above), *(_INDEX["by " + k] for k in closest), *([_INDEX["link" + str(link)]] if link else []), _INDEX[("empty", "short", "middle", "long")[size]], _INDEX["one"]]


def _edge(parent: str) -> int:
    """Kinds of edges by the parent's tag: the page, what groups at will, the article, the rest."""
    if parent in _PAGE:
        return 0
    return 1 if parent in ("div", "section", "table", "td", "tr", "tbody") else 2 if parent in ("article", "main") else 3


EDGES = 4


@dataclass
class Model:
    weights: np.ndarray
    #: [kind of edge][label of parent][label of child]
    edges: list
    cache: dict = field(default_factory=dict)

    def potential(self, sign: tuple) -> tuple[float, float]:
        got = self.cache.get(sign)
        if got is None:
            z = max(-30.0, min(30.0, float(self.weights[_vector(sign)].sum())))
            p = 1 / (1 + exp(-z))
            if len(self.cache) > 100_000:
                self.cache.clear()
            got = self.cache[sign] = (1 - p, p)
        return got

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Probability of content for each element, by messages up and down the tree."""
        size = len(nodes)
        own = [self.potential(signature(nodes, n)) for n in range(size)]
        for n in range(size):
            if nodes[n].tag == "head" or (nodes[n].tag in _PAGE and not nodes[n].text):
                own[n] = (1.0, 1e-6)
        up = [(1.0, 1.0)] * size  # message to the parent
        belief = list(own)
        for n in range(size - 1, 0, -1):
            a, b = belief[n]
            parent = nodes[n].parent
            e = self.edges[_edge(nodes[parent].tag)]
            x, y = e[0][0] * a + e[0][1] * b, e[1][0] * a + e[1][1] * b
            s = x + y
            up[n] = (x / s, y / s)
            c, d = belief[parent]
            c, d = c * up[n][0], d * up[n][1]
            s = c + d or 1e-300
            belief[parent] = (c / s, d / s)
        out = [belief[0][1] / (belief[0][0] + belief[0][1])] + [0.0] * (size - 1)
        full = [belief[0]] + [(0.0, 0.0)] * (size - 1)
        for n in range(1, size):
            parent = nodes[n].parent
            # What the parent knows without this child.
            a, b = full[parent][0] / max(up[n][0], 1e-300), full[parent][1] / max(up[n][1], 1e-300)
            e = self.edges[_edge(nodes[parent].tag)]
            x, y = (e[0][0] * a + e[1][0] * b) * belief[n][0], (e[0][1] * a + e[1][1] * b) * belief[n][1]
            s = x + y or 1e-300
            full[n] = (x / s, y / s)
            out[n] = y / s
        return out

    def extract(self, page: str) -> str:
        nodes, flow = parse(page)
        if len(nodes) == 1:
            return _SPACE.sub(" ", "".join(t or " " for _, t in flow)).strip()
        p = self.marginals(nodes)
        keep = [False] * len(nodes)
        for n, x in enumerate(nodes):
            hidden = x.tag in UNSEEN or (x.parent >= 0 and nodes[x.parent].mark == "unseen")
            if hidden:
                x.mark = "unseen"
            keep[n] = not hidden and p[n] >= 0.5
        return _SPACE.sub(" ", "".join(t if t else " " for n, t in flow if not t or keep[n])).strip()


def fit(pages: list[str], steps: int = 600, rate: float = 0.3) -> Model:
    """Potentials from pages whose elements carry ``data-label`` (inherited by what is inside).

    By pseudo-likelihood: each element's label given its features and its neighbours' labels.
    """
    rows, ys, near = [], [], []
    for page in pages:
        nodes, _ = parse(page)
        label = [0] * len(nodes)
        for n in range(1, len(nodes)):
            x = nodes[n]
            label[n] = int(x.mark == "content") if x.mark else label[x.parent]
        for n in range(1, len(nodes)):
            x = nodes[n]
            # What only groups parts of either kind has no label to learn from.
            if x.tag in UNSEEN or (not x.text and (x.tag in _PAGE or not (x.mark or label[n] or x.kinds or x.above))):
                continue
            side = [0.0] * EDGES
            side[_edge(nodes[x.parent].tag)] += 2 * label[x.parent] - 1
            side[_edge(x.tag)] += sum(2 * label[c] - 1 for c in x.children if nodes[c].tag not in UNSEEN)
            side[0] = 0.0
            # Once with its neighbours and once without, so that features tell what they can alone.
            for known in (side, [0.0] * EDGES):
                rows.append(_vector(signature(nodes, n)))
                ys.append(float(label[n]))
                near.append(known)
    x = np.zeros((len(rows), len(_COLUMNS) + EDGES))
    for i, r in enumerate(rows):
        x[i, r] = 1
    x[:, len(_COLUMNS) :] = np.clip(near, -4, 4) if rows else 0
    alike, many = np.unique(np.column_stack([x, ys]), axis=0, return_counts=True)
    x, y = alike[:, :-1], alike[:, -1]
    w, speed = np.zeros(x.shape[1]), np.full(x.shape[1], 1e-8)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(x @ w)))
        g = x.T @ ((y - p) * many) / max(1, many.sum()) - 1e-4 * w
        speed += g * g
        w += rate * g / np.sqrt(speed)
        w[len(_COLUMNS) :] = np.maximum(w[len(_COLUMNS) :], 0)
    # Labels as -1 and 1: agreement of an edge counts half the weight, disagreement minus that.
    edges = [[[exp(j / 2), exp(-j / 2)], [exp(-j / 2), exp(j / 2)]] for j in w[len(_COLUMNS) :].tolist()]
    return Model(w[: len(_COLUMNS)], edges)


def labelled_pages(n: int = 400, seed: int = 5) -> list[str]:
    """Pages laid out by rule: an article among the parts that pages put around it."""
    r = random.Random(seed)

    def words(a: int, b: int) -> str:
        return " ".join("".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 9))) for _ in range(r.randint(a, b)))

    def links(k: int) -> str:
        return "".join(f"<li><a href='/x'>{words(1, 3)}</a></li>" for _ in range(k))

    def kind(name: str) -> str:
        return r.choice(WORDS[name])

    def off(tag: str, attributes: str, inside: str) -> str:
        return f'<{tag} {attributes} data-label="off">{inside}</{tag}>'

    def body_text() -> str:
        out = [f"<h1>{words(1, 10)}</h1>"] if r.random() < 0.8 else []
        if r.random() < 0.15:
            return "".join(out) + f"<p>{words(1, 12)}</p>"
        for _ in range(r.randint(1, 9)):
            text = words(2, 14) if r.random() < 0.25 else words(20, 90)
            if r.random() < 0.3:
                text += f" <a href='/y'>{words(1, 3)}</a> {words(2, 8)}"
            if r.random() < 0.3:
                text = f"<{r.choice(['b', 'em', 'strong', 'span', 'i'])}>{words(2, 6)}</b> " + text
            out.append(r.choice([f"<p>{text}</p>"] * 6 + [f"<h2>{words(2, 6)}</h2><p>{text}</p>", f"<blockquote><p>{text}</p></blockquote>", f"<ul><li>{words(4, 20)}</li><li>{words(4, 20)}</li></ul>", f"<div>{text}</div>", f"<pre>{words(5, 30)}</pre>", f"<table><tr><td>{words(2, 6)}</td><td>{words(2, 6)}</td></tr></table>", f"<figure><figcaption>{words(3, 10)}</figcaption></figure>", f"<p>{text}<br>{words(5, 20)}"]))
        return "".join(out)

    def clutter() -> str:
        k = r.randrange(14)
        if k == 0:
            return off("nav", r.choice(["", f'class="{kind("menu")}"']), f"<ul>{links(r.randint(2, 9))}</ul>")
        if k == 1:
            return off("div", f'class="{kind("menu")}"', f"<ul>{links(r.randint(2, 9))}</ul>")
        if k == 2:
            return off("aside", r.choice(["", f'class="{kind("side")}"']), f"<h2>{words(1, 4)}</h2><ul>{links(4)}</ul>" if r.random() < 0.5 else f"<p>{words(5, 60)}</p>")
        if k == 3:
            return off(r.choice(["div", "section"]), f'class="{kind("side")}"', f"<h2>{words(1, 4)}</h2><p>{words(5, 60)}</p>")
        if k == 4:
            return off(r.choice(["div", "section", "p", "span", "aside"]), f'{r.choice(["class", "id"])}="{kind("advert")}"', r.choice([words(3, 30), f"<p>{words(3, 60)}</p>", f"<a href='/z'>{words(2, 6)}</a>"]))
        if k == 5:
            return off(r.choice(["div", "section", "p"]), f'class="{kind("notice")}"', r.choice([f"<p>{words(5, 50)}</p><button>{words(1, 2)}</button>", words(4, 40)]))
        if k == 6:
            return off("form", r.choice(["", f'class="{kind("form")}"']), f"<label>{words(1, 3)}</label><input name=q><button>{words(1, 2)}</button><p>{words(3, 20)}</p>")
        if k == 7:
            said = "".join(r.choice([f"<div class='comment'><b>{words(1, 2)}</b><p>{words(3, 70)}</p></div>", f"<li>{words(3, 60)}</li>", f"<article><p>{words(3, 60)}</p></article>"]) for _ in range(r.randint(1, 5)))
            return off(r.choice(["div", "section"]), f'{r.choice(["class", "id"])}="{kind("comment")}"', f"<h2>{words(1, 3)}</h2>{said}")
        if k == 8:
            return off("div", f'class="{kind("social")}"', f"<span>{words(1, 4)}</span><ul>{links(3)}</ul>")
        if k == 9:
            return off("header", r.choice(["", f'class="{kind("head")}"']), f"<h1>{words(1, 4)}</h1><p>{words(2, 12)}</p>")
        if k == 10:
            return off("footer", r.choice(["", f'class="{kind("foot")}"']), r.choice([f"&copy; {words(2, 30)}", f"<p>{words(2, 60)}</p><ul>{links(3)}</ul>"]))
        if k == 11:
            return off("div", f'{r.choice(["class", "id"])}="{kind(r.choice(["foot", "head"]))}"', r.choice([f"<p>{words(3, 60)}</p>", words(3, 30)]))
        if k == 12:
            return off("button", "", words(1, 3))
        return off("ul", "", links(r.randint(3, 8)))

    out = []
    for _ in range(n):
        inside = body_text()
        if r.random() < 0.35:
            inside = inside.replace("<p>", clutter() + "<p>", 1) if r.random() < 0.5 else inside + clutter()
        way = r.random()
        if way < 0.28:
            main = f'<article data-label="content">{inside}</article>'
        elif way < 0.36:
            main = f'<main><article data-label="content">{inside}</article>{clutter() if r.random() < 0.4 else ""}</main>'
        elif way < 0.44:
            main = f'<main data-label="content">{inside}</main>'
        elif way < 0.64:
            main = f'<div {r.choice(["class", "id"])}="{kind("main")}" data-label="content">{inside}</div>'
        elif way < 0.84:
            main = f'<div {r.choice(["", 'class="x"', 'id="c1"', 'class="col row-2"'])} data-label="content">{inside}</div>'
        elif way < 0.9:
            # Bare in the body; what is around it carries its own label.
            main = words(1, 300) if r.random() < 0.7 else f'<h1 data-label="content">{words(1, 8)}</h1>{words(1, 300)}'
        else:
            main = re.sub(r"<(p|h1|h2|ul|blockquote|pre|table|figure|div)>", r'<\1 data-label="content">', inside)
        before = "".join(clutter() for _ in range(r.randint(0, 4)))
        after = "".join(clutter() for _ in range(r.randint(0, 4)))
        page = before + main + after
        if r.random() < 0.3 and not 0.84 <= way < 0.9:
            page = f"<div class='wrapper'>{page}</div>"
        bare = ' data-label="content"' if 0.84 <= way < 0.9 else ""
        out.append(f"<html><head><title>{words(2, 6)}</title></head><body{bare}>{page}</body></html>")
    return out


def extract(pages: DataFrame, model: Model | None = None, page: str = "html", text: str = "text") -> DataFrame:
    """``pages`` with each page's main text."""
    shared = pages.sparkSession.sparkContext.broadcast(model or fit(labelled_pages()))

    def make(part: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([shared.value.extract(x or "") for x in part.column(page).to_pylist()], pa.string())]

    return add_columns(pages, page, [T.StructField(text, T.StringType())], make)


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op7_html_extraction": op7_html_extraction}
