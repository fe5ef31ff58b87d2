"""Main-text extraction with a tree-structured graphical model over the DOM.

Block elements and the text blocks in them are nodes with two states, content or not. A node's own potential comes
from its tag, class words and text; parent and child are coupled by the kind of child. Weights are learned from
labelled pages; sum-product messages, upward and then downward, give each node's marginal,
and the text blocks that are more likely content than not are the main text.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Fixed values of the HTML standard: elements without an end tag, with text that isn't markup, within lines, and
#: those whose start ends an open paragraph.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe canvas object select desc annotation annotation-xml".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby "
                   "s samp small span strike strong sub sup time tt u var br wbr img "
                   # formulas and drawings stand in their line, with the text that they show
                   "math menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace "
                   "msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics "
                   "svg circle clippath defs ellipse filter foreignobject g line lineargradient marker mask path pattern polygon "
                   "polyline radialgradient rect stop symbol text textpath tspan use".split())
ENDS_ITSELF = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"),
               "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
MARKUP = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*))")
#: The rest of a tag by the standard: a value after an equals sign is quoted or ends at white space, and quotes anywhere
#: else are part of names and values. It never steps back, so a tag is read once.
REST = re.compile(r"((?:[^>=]|=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>][^\s>]*|(?=>)))*+)>")
ATTRIBUTE = re.compile(r"\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>][^\s>]*))?", re.I)
NAME = re.compile(r"[a-z]+")


@dataclass
class Page:
    """Nodes in page order, parents before children; text[i] is None for elements."""

    tag: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    names: list[tuple[str, ...]] = field(default_factory=list)
    text: list[str | None] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    share: list[float] = field(default_factory=list)

    def weigh(self) -> Page:
        """Set ``share``: how much of the page's text each node holds."""
        size = [len(t) if t else 0 for t in self.text]
        for i in range(len(size) - 1, 0, -1):
            size[self.parent[i]] += size[i]
        self.share = [x / max(size[0], 1) for x in size]
        return self

    def add(self, tag: str, parent: int, names: tuple[str, ...] = (), text: str | None = None, linked: int = 0) -> int:
        for column, value in ((self.tag, tag), (self.parent, parent), (self.names, names), (self.text, text), (self.linked, linked)):
            column.append(value)
        return len(self.tag) - 1


def _names(attributes: str) -> tuple[str, ...]:
    """Words of class, id and role; ``hidden`` if the element isn't shown."""
    if not attributes or attributes.isspace():
        return ()
    out: list[str] = []
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id", "role"):
            out += NAME.findall(value)
        elif name == "hidden" or name == "aria-hidden" and value == "true" or "display:none" in value.replace(" ", ""):
            out.append("hidden")
    return tuple(out)


def tags(source: str) -> Iterator[tuple[int, int, bool, str | None, str]]:
    """(start, end, whether it closes, name, attributes) of every tag; comments and declarations have no name, and an
    element whose text isn't markup ends behind that text.

    After a tag that no ``>`` ends by the standard's rules, quotes are not trusted any more and a tag ends at the next ``>``;
    where there is none left, the rest is text. So every character is read a bounded number of times.
    """
    at, quotes, last, last_comment = 0, True, source.rfind(">"), source.rfind("-->")
    unclosed: set[str] = set()  # elements that nothing from here on closes
    while m := MARKUP.search(source, at):
        start, tag = m.start(), m.group(2)
        if m.group() == "<!--":
            at = source.index("-->", m.end()) + 3 if last_comment >= m.end() else len(source)
            yield start, at, False, None, ""
            continue
        if last < m.end():
            return
        rest = REST.match(source, m.end()) if tag and quotes else None
        if rest is None:
            quotes = quotes and not tag
            at = source.index(">", m.end()) + 1
        else:
            at = rest.end()
        tag, attributes = tag and tag.lower(), source[m.end():at - 1]
        if tag in RAW and not m.group(1) and not attributes.rstrip().endswith("/"):
            close = None if tag in unclosed else re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(source, at)
            if close:
                at = close.end()
            else:
                unclosed.add(tag)
                at = len(source) if tag in ("script", "style") else at
        yield start, at, bool(m.group(1)), tag, attributes


def parse(source: str) -> Page:
    """Nodes of a page. Inline elements melt into the text block around them; what isn't closed ends with its parent."""
    page = Page()
    stack: list[tuple[str, int]] = [("html", page.add("html", -1))]
    run: list[str] = []
    linked, links, at = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            if text:
                page.add("#text", stack[-1][1], (), text, linked)
            run.clear()
        linked = 0

    def read(end: int) -> None:
        nonlocal linked
        if end > at:
            run.append(source[at:end])
            if links:
                linked += end - at

    for start, end, closing, tag, attributes in tags(source):
        read(start)
        at = end
        if tag is None or tag in RAW:
            continue
        if tag in INLINE:
            if tag == "a":
                links = max(0, links + (-1 if closing else 1))
            elif tag == "br":
                run.append(" ")
            continue
        flush()
        if tag in VOID:
            continue
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            links = 0
            continue
        if stack[-1][0] == "p":
            stack.pop()
        if tag in ENDS_ITSELF:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in ENDS_ITSELF[tag]:
                    break
                if stack[i][0] == tag:
                    del stack[i:]
                    break
        if tag in ("html", "body") and any(t == tag for t, _ in stack[1:]) or tag == "html":
            continue
        stack.append((tag, page.add(tag, stack[-1][1], _names(attributes))))
    read(len(source))
    flush()
    return page.weigh()


def features(page: Page, i: int) -> list[str]:
    """Names of the features of a node."""
    tag = page.tag[i]
    text = page.text[i]
    if text is None:
        out = ["bias " + ("p" if tag == "p" else "element"), "tag " + tag]
        for name in page.names[i]:
            out.append("name " + name)
            out.append("stem " + name[:5])
        if not page.names[i]:
            out.append("plain " + tag)
        share = page.share[i]
        out.append("share " + ("little" if share < 0.05 else "some" if share < 0.2 else "much" if share < 0.5 else "most"))
        return out
    size = len(text)
    share = page.linked[i] / max(size, 1)
    out = ["bias text", f"in {page.tag[page.parent[i]]}", f"size {min(8, size.bit_length())}",
           f"linked {0 if share == 0 else 1 if share < 0.5 else 2}"]
    if text[-1] in ".!?:;\"'”»":
        out.append("ends")
    if "©" in text or "·" in text:
        out.append("mark")
    return out


def kind(tag: str) -> str:
    """Kind of the edge above a node."""
    return "text" if tag == "#text" else "own" if tag in (
        "nav", "aside", "footer", "header", "form", "article", "main", "section", "div") else "part"


@dataclass
class TreeModel:
    """Weights of features and couplings; states are -1 and +1, so a node's field is half its log-odds."""

    weights: dict[str, float]
    couplings: dict[str, float]

    def marginals(self, page: Page) -> list[float]:
        """Log-odds of content of every node given all of the page."""
        n = len(page.tag)
        get = self.weights.get
        own = [2 * sum(get(f, 0.0) for f in features(page, i)) for i in range(n)]
        couple = [self.couplings[kind(t)] for t in page.tag]
        total, up = own[:], [0.0] * n
        for i in range(n - 1, 0, -1):  # children come after their parents
            up[i] = _message(total[i], couple[i])
            total[page.parent[i]] += up[i]
        for i in range(1, n):
            total[i] += _message(total[page.parent[i]] - up[i], couple[i])
        return total


def _message(odds: float, couple: float) -> float:
    """What a neighbour with these log-odds says through a coupling: 2 atanh(tanh(c) tanh(odds / 2))."""
    return 2 * math.atanh(max(-0.999999, min(0.999999, math.tanh(couple) * math.tanh(odds / 2))))


def _pass(own: np.ndarray, couple: np.ndarray, parent: np.ndarray, levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sum-product over a forest, a level at a time: E[state] of nodes and E[state * parent's state] of edges."""
    def message(odds, c):
        return 2 * np.arctanh(np.clip(np.tanh(c) * np.tanh(odds / 2), -0.999999, 0.999999))

    total, up = own.copy(), np.zeros_like(own)
    for level in levels[:0:-1]:
        up[level] = message(total[level], couple[level])
        np.add.at(total, parent[level], up[level])
    pair = np.zeros_like(own)
    for level in levels[1:]:
        rest = total[parent[level]] - up[level]
        a, b, c = np.tanh(rest / 2), np.tanh(total[level] / 2), np.tanh(couple[level])
        pair[level] = (c + a * b) / (1 + c * a * b)
        total[level] += message(rest, couple[level])
    return np.tanh(total / 2), pair


def train(pages: list[Page], labels: list[list[int]], steps: int = 300, rate: float = 0.05, decay: float = 1e-4) -> TreeModel:
    """Maximise the likelihood of the text blocks' labels (+1, -1); elements are hidden, so what is known of an
    element is learned by how it explains the text in it. The gradient is what the features and couplings expect
    with the text clamped, less what they expect freely; both come from exact messages."""
    index: dict[str, int] = {}
    kinds = {"text": 0, "own": 1, "part": 2}
    node, feat, parent, depth, edge, clamp = [], [], [], [], [], []
    for page, own in zip(pages, labels):
        base = len(parent)
        for i in range(len(page.tag)):
            for f in features(page, i):
                node.append(base + i)
                feat.append(index.setdefault(f, len(index)))
            parent.append(base + max(page.parent[i], 0))
            depth.append(depth[base + page.parent[i]] + 1 if i else 0)
            edge.append(kinds[kind(page.tag[i])])
            clamp.append(0 if page.text[i] is None else 40 * own[i])
    node, feat, parent, depth, edge = (np.array(x, np.int64) for x in (node, feat, parent, depth, edge))
    levels = [np.flatnonzero(depth == d) for d in range(depth.max() + 1)]
    held, inner = np.array(clamp, float), depth > 0
    w, c = np.zeros(len(index)), np.full(3, 0.5)
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in (w, c)]
    for t in range(1, steps + 1):
        own = 2 * np.bincount(node, w[feat], len(parent))
        free, pair = _pass(own, c[edge], parent, levels)
        true, tied = _pass(own + held, c[edge], parent, levels)
        grads = (np.bincount(feat, (true - free)[node], len(w)) / len(pages) - decay * w,
                 np.bincount(edge[inner], (tied - pair)[inner], 3) / len(pages) - decay * c)
        for x, g, (m, v) in zip((w, c), grads, moments):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
        np.clip(c, 0, 3, out=c)
    return TreeModel({k: float(w[i]) for k, i in index.items()}, {k: float(c[i]) for k, i in kinds.items()})


#: What labelled pages are made of: (tag, class words) of parts by role. Common names, in no need of being complete:
#: the tree carries what is known of a part to its neighbours.
PARTS = {
    True: [("article", ""), ("article", "post"), ("main", ""), ("main", "content"), ("div", "content"), ("div", "article body"),
           ("div", "post content"), ("div", "entry content"), ("section", "article"), ("div", "story body"), ("div", "main"), ("div", ""), ("div", ""), ("div", ""), ("section", ""), ("body", "")],
    False: [("nav", ""), ("nav", "menu"), ("div", "nav menu"), ("ul", "menu"), ("div", "breadcrumb"), ("header", ""),
            ("header", "site header"), ("div", "header banner"), ("div", "masthead top bar"), ("footer", ""),
            ("footer", "site footer"), ("div", "footer"), ("div", "copyright legal"), ("aside", ""), ("aside", "sidebar"),
            ("div", "sidebar widget"), ("div", "related recommended"), ("div", "share social"), ("div", "tags meta"),
            ("div", "ad"), ("div", "ads advert"), ("div", "advertisement promo"), ("div", "sponsored sponsor"),
            ("section", "promo banner"), ("div", "cookie notice"), ("div", "cookie consent banner"), ("div", "notice"),
            ("div", "alert"), ("div", "popup modal overlay"), ("div", "newsletter subscribe signup"), ("form", ""),
            ("form", "search"), ("form", "login"), ("div", "search"), ("section", "comments"), ("div", "comments"),
            ("div", "comment"), ("ol", "comment list"), ("div", "replies discussion reply"), ("section", "reader responses"),
            ("div", "hidden"), ("dialog", "")],
}


def labelled_pages(n: int = 1000, seed: int = 0) -> tuple[list[Page], list[list[int]]]:
    """Labelled pages for training: random parts in random order around and inside a main part of random shape."""
    rng = np.random.default_rng(seed)
    pick = lambda items: items[int(rng.integers(len(items)))]

    def words(low: int, high: int) -> str:
        return " ".join("w" * int(k) for k in rng.integers(2, 9, int(rng.integers(low, high + 1))))

    def inner(content: bool, tag: str) -> str:
        if content:
            parts = [f"<h1>{words(3, 10)}</h1>"] * bool(rng.random() < 0.8)
            for _ in range(int(rng.integers(1, 12))):
                how = rng.random()
                text = words(1, 8) if how < 0.3 else words(10, 120)
                parts.append(f"<h2>{words(2, 8)}</h2>" if how > 0.93 else f"<ul><li>{text}</li><li>{words(2, 20)}</li></ul>" if how > 0.88
                             else f"<blockquote>{text}.</blockquote>" if how > 0.85 else f"<table><tr><td>{words(1, 4)}</td><td>{words(1, 4)}</td></tr></table>" if how > 0.83
                             else f"<pre>{text}</pre>" if how > 0.81 else f"{text}.<br>" if how > 0.78
                             else f"<p>{text} <a href=x>{words(1, 3)}</a>.</p>" if how > 0.7 else f"<p>{text}.</p>")
            return "".join(parts)
        how = rng.random()
        if how < 0.35:
            return "<ul>" + "".join(f"<li><a href=x>{words(1, 3)}</a></li>" for _ in range(int(rng.integers(2, 9)))) + "</ul>"
        if tag == "form" or how < 0.45:
            return f"<label>{words(1, 3)}</label><input><button>{words(1, 2)}</button>" + f"<p>{words(2, 15)}.</p>" * bool(rng.random() < 0.5)
        if how < 0.7:
            return words(2, 15) + pick(["", ".", " © w", " <a href=x>w</a>"])
        return "".join(f"<{t}>{words(2, 40)}.</{t}>" for t in [pick(["p", "p", "h2", "h3", "h4", "div", "li"]) for _ in range(int(rng.integers(1, 5)))])

    def part(content: bool) -> str:
        tag, names = pick(PARTS[content])
        names = " ".join(names.split()[:int(rng.integers(1, 4))]) if names else ""
        attributes = (" hidden" if names == "hidden" else f' class="{names}"' if rng.random() < 0.8 else f' id="{names.replace(" ", "-")}"') if names else ""
        body = inner(content, tag)
        if not content:
            return f"<{tag}{attributes} data-no>{body}</{tag}>"
        while rng.random() < 0.3:  # boilerplate inside the main part
            at = body.rfind("<p>", 0, int(rng.integers(len(body) + 1)))
            body = body[:max(at, 0)] + part(False) + body[max(at, 0):]
        if tag == "body":
            return body  # the main part is the page's own
        return f"<{tag}{attributes}>{body}</{tag}>" if rng.random() < 0.85 else f"<div><{tag}{attributes}>{body}</{tag}></div>"

    pages, labels = [], []
    for _ in range(n):
        before, after = ("".join(part(False) for _ in range(int(rng.integers(0, 5)))) for _ in range(2))
        source = f"{before}{part(True)}{after}"
        if rng.random() < 0.3:
            source = f'<div class="{pick(["wrap", "container", "page", "site", "inner", "layout"])}">{source}</div>'
        page, own = label(f"<body>{source}</body>")
        pages.append(page)
        labels.append(own)
    return pages, labels


def label(source: str, outside: str = "data-no") -> tuple[Page, list[int]]:
    """Page and labels of a source whose boilerplate elements carry the attribute ``outside``. An element is content
    if half its text is."""
    marked = re.sub(rf"<(\w+)((?:[^>])*?) {outside}>", r'<\1\2 id="markedoutside">', source)
    marked = re.sub(r'class="([^"]*)" id="markedoutside"', r'class="\1 markedoutside"', marked)
    marked = re.sub(r'id="([^"]*)" id="markedoutside"', r'id="\1 markedoutside"', marked)
    page = parse(marked)
    n = len(page.tag)
    out = [False] * n
    size, good = [0] * n, [0] * n
    for i in range(n):
        out[i] = "markedoutside" in page.names[i] or i > 0 and out[page.parent[i]]
        page.names[i] = tuple(x for x in page.names[i] if x != "markedoutside")
    for i in range(n - 1, -1, -1):
        if page.text[i] is not None:
            size[i] = len(page.text[i])
            good[i] = 0 if out[i] else size[i]
        if i:
            size[page.parent[i]] += size[i]
            good[page.parent[i]] += good[i]
    return page, [1 if not out[i] and 2 * good[i] >= size[i] else -1 for i in range(n)]


def main_text(source: str, model: TreeModel) -> str:
    """Content blocks in page order, one a line."""
    page = parse(source)
    odds = model.marginals(page)
    return "\n".join(t for t, x in zip(page.text, odds) if t is not None and x > 0)


def extract_udf(model: TreeModel):
    @F.arrow_udf("string")
    def extract(source: pa.Array) -> pa.Array:
        return pa.array([main_text(s, model) if s else "" for s in source.to_pylist()], pa.string())

    return extract


_default: list[TreeModel] = []


def default_model() -> TreeModel:
    """The model trained from ``labelled_pages``; trained once a process."""
    if not _default:
        _default.append(train(*labelled_pages()))
    return _default[0]


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                      model: TreeModel | None = None) -> DataFrame:
    """Per page: page_id, url, text, n_chars (code points).

    Character references are decoded, white space within a block is one space, blocks are joined by a line feed. A
    null or empty page, or one without main text, has the empty text. Every row is extracted on its own, so null or
    shared ids make no difference; an empty table gives an empty result and other columns are ignored.
    """
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"),
                       extract_udf(model or default_model())(F.col(html_col)).alias("text"))
    return own.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
