"""HTML main text by a tree-structured graphical model.

A page's block elements, and the blocks of text in them, are the nodes of a
tree; each is content or not.  A node has a potential from its own features,
a parent and child have one from their two labels.  Sum-product messages go
up the tree and down again, level by level and for many pages at once, and
give every block's exact marginal; blocks more likely content than not are
the main text.  The potentials are fitted to labelled pages by the gradient
of the log-likelihood, which takes the same marginals.

The labelled pages come from a generator of page layouts with a fixed seed;
``PAGES`` bounds their number.

Defined cases: null html counts as empty and gives the empty text; a page cut
off in a tag loses that tag; unclosed elements end with their parents;
repeated rows give equal rows; an empty table gives none; extra columns play
no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape
from itertools import islice
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

#: Labelled pages the model is fitted to, and steps of the fit.
PAGES, STEPS = 800, 160
#: Characters of html whose trees are solved together.
TOGETHER = 4_000_000

# Elements by their part in a page.
RAW = ("script", "style", "title", "textarea", "iframe", "noscript", "template", "svg", "object", "select", "button", "canvas", "audio", "video", "noembed", "noframes", "xmp")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var"
    # MathML: a formula is part of the text around it
    " math maction annotation annotation-xml menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics".split()
)
HEAD = frozenset("base link meta title style script noscript template".split())
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th"),
}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "tbody": ("table",), "tfoot": ("table",), "option": ("select",)}
TAGS = "html body head article main section div p h1 h2 h3 h4 ul ol li dl dt dd table tr td th nav header footer aside form fieldset figure figcaption blockquote pre address details summary dialog center own-header".split()
#: Elements that show where the main part of a page is, features of what holds one.
SIGNS = ("article", "main", "h1")
# Parts of class, id and role names and what they hint at.
HINTS = (
    ("menu", r"menu|nav|breadcrumb|toolbar|tabs|pagination|pager|toc"),
    ("frame", r"footer|header|masthead|topbar|copyright|legal|colophon"),
    ("side", r"side|aside|widget|related|recommend|rail|popular|trending|complementary"),
    ("notice", r"cookie|consent|notice|banner|alert|popup|modal|overlay|gdpr|dialog|subscribe|newsletter|signup|login|paywall"),
    ("advert", r"(?:^|[^a-z])ads?(?:[^a-z]|$)|advert|sponsor|promo|outbrain|taboola|commercial"),
    ("talk", r"comment|reply|replies|disqus|discussion|respond|reader"),
    ("share", r"share|social|follow|tweet|like"),
    ("search", r"search|form"),
    ("body", r"article|content|post|entry|main|story|body|text|prose|page"),
)
# Quotes hold a > only behind an equals sign; elsewhere they are part of a name.
ATTRIBUTES = r"(?>=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+"
TOKEN = re.compile(
    # a raw name ends at a blank, / or >, else it begins a custom element's; a self-closed svg is empty
    r"<!--.*?(?:-->|\Z)|<svg(?=[\s/>])" + ATTRIBUTES + r"(?<=/)>|<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>])" + ATTRIBUTES + r">.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>" + ATTRIBUTES + r")>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z|(?P<text>[^<]+|<)",
    re.S | re.I,
)
NAMES = re.compile(r"(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
# Names of a layout with or without some part don't name the part.
LAYOUT = re.compile(r"(?<![a-z])(?:no|non|not|has|with|without)[-_][\w-]+", re.I)
HIDDEN = re.compile(r"\bhidden\b|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
HINT = [(name, re.compile(p, re.I)) for name, p in HINTS]
SENTENCE = re.compile(r"[.!?…][\"'»”)]*(?:\s|$)")

FEATURES = [
    "none", "element", *[f"tag:{t}" for t in [*TAGS, "other"]], *[f"hint:{n}" for n, _ in HINTS], *[f"held:{n}" for n, _ in HINTS], *[f"holds:{t}" for t in SIGNS], "hidden",
    "block", *[f"in:{t}" for t in [*TAGS, "other"]], *[f"chars:{i}" for i in range(5)], *[f"links:{i}" for i in range(4)], *[f"sentences:{i}" for i in range(3)], "mark", "root",
]
NUMBER = {f: i for i, f in enumerate(FEATURES)}
ELEMENT, BLOCK, HIDE, MARK = (NUMBER[f] for f in ("element", "block", "hidden", "mark"))
FIRST_HINT = NUMBER[f"hint:{HINTS[0][0]}"]
HOLDS = {t: NUMBER[f"holds:{t}"] for t in SIGNS}
OF_TAG = {t: NUMBER[f"tag:{t}"] for t in TAGS}
IN_TAG = {t: NUMBER[f"in:{t}"] for t in TAGS}


@dataclass
class Tree:
    """Nodes of one or more pages; parents stand before their children."""

    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    feats: list[int] = field(default_factory=list)
    first: list[int] = field(default_factory=list)  # of each node's features
    block: list[str | None] = field(default_factory=list)  # a block's text; None for elements
    names: dict[str, list[int]] = field(default_factory=dict)

    def add(self, parent: int, feats: list[int], block: str | None = None) -> int:
        n = len(self.parent)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.first.append(len(self.feats))
        self.feats.extend(feats)
        self.block.append(block)
        return n

    def hints(self, rest: str) -> list[int]:
        got = self.names.get(rest)
        if got is None:
            said = LAYOUT.sub(" ", " ".join(a or b or c for a, b, c in NAMES.findall(rest)))
            got = [NUMBER[f"hint:{n}"] for n, p in HINT if p.search(said)] if said else []
            if HIDDEN.search(rest):
                got.append(HIDE)
            if len(self.names) < 10_000:
                self.names[rest] = got
        return got


def _block_features(tag: str, text: str, linked: int) -> list[int]:
    n = len(text)
    share = linked / n
    ends = sum(1 for _ in islice(SENTENCE.finditer(text), 2))
    f = [
        BLOCK, IN_TAG.get(tag, NUMBER["in:other"]), NUMBER["chars:0"] + (n > 15) + (n > 50) + (n > 120) + (n > 300),
        NUMBER["links:0"] + (share > 0) + (share > 0.4) + (share > 0.8), NUMBER["sentences:0"] + ends,
    ]
    return f + [MARK] if "©" in text or "®" in text else f


def parse(html: str, tree: Tree) -> None:
    """Add a page to ``tree``."""
    root = tree.add(-1, [NUMBER["root"]])
    stack: list[tuple[str, int]] = [("", root)]
    holds: dict[int, set[str]] = {}  # signs in each element
    parts: list[str] = []
    linked = in_link = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                tag, node = stack[-1]
                tree.add(node, _block_features(tag, text, linked), text)
            parts.clear()
            linked = 0

    for m in TOKEN.finditer(html):
        text = m["text"]
        if text is not None:
            parts.append(text)
            if in_link:
                linked += len(text)
            continue
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "a":
                in_link = 0 if m["end"] else 1
            continue
        if tag in VOID:
            if tag == "br":
                parts.append(" ")
            elif tag == "hr":
                flush()
            continue
        flush()
        in_link = 0
        if m["end"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag or (tag == "header" and stack[i][0] == "own-header"):
                    del stack[i:]
                    break
            continue
        if tag not in HEAD and stack[-1][0] == "head":
            stack.pop()
        for i in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph
            if stack[i][0] == "p":
                del stack[i:]
                break
            if stack[i][0] in ("td", "th", "button", "object", "li", "div", "article", "section", "body"):
                break
        if tag in CLOSES:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in CLOSES[tag]:
                    del stack[i:]
                elif stack[i][0] in SCOPE[tag]:
                    break
        if tag in SIGNS:
            for _, node in reversed(stack[1:]):
                if tag in (of := holds.setdefault(node, set())):
                    break
                of.add(tag)
        elif tag == "header" and any(t == "article" for t, _ in stack):
            tag = "own-header"
        rest = m["rest"]
        feats = [ELEMENT, OF_TAG.get(tag, NUMBER["tag:other"])]
        if rest and not rest.isspace():
            feats += tree.hints(rest)
        stack.append((tag, tree.add(stack[-1][1], [*feats, *[0] * len(SIGNS)])))
    flush()
    for node, signs in holds.items():  # names say less of an element that holds an article
        lo = tree.first[node]
        hi = tree.first[node + 1] if node + 1 < len(tree.first) else len(tree.feats)
        if signs != {"h1"}:
            tree.feats[lo : hi - len(SIGNS)] = [f + len(HINTS) if FIRST_HINT <= f < FIRST_HINT + len(HINTS) else f for f in tree.feats[lo : hi - len(SIGNS)]]
        tree.feats[hi - len(SIGNS) : hi] = [HOLDS[t] if t in signs else 0 for t in SIGNS]


@dataclass
class Model:
    """Weights of the features for "content", and per kind of child the 2x2 potentials of parent and child labels."""

    weights: np.ndarray
    pair: np.ndarray  # [child is a block][parent label][child label]


def _arrays(tree: Tree):
    parent, depth = np.array(tree.parent), np.array(tree.depth)
    is_block = np.array([b is not None for b in tree.block], np.int64)
    owner = np.repeat(np.arange(len(parent)), np.diff([*tree.first, len(tree.feats)]))
    order = np.argsort(depth, kind="stable")
    levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)
    return parent, is_block, owner, np.array(tree.feats), levels


def marginals(arrays, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """P(content) per node, and P(parent label, child label) per node but the roots: exact, by two sweeps."""
    parent, is_block, owner, feats, levels = arrays
    n = len(parent)
    own = np.zeros((n, 2))
    own[:, 1] = np.bincount(owner, model.weights[feats], n)
    up = own.copy()  # own potential and the messages of all children
    sent = np.zeros((n, 2))
    for level in levels[:0:-1]:
        s = up[level][:, None, :] + model.pair[is_block[level]]
        sent[level] = np.logaddexp(s[:, :, 0], s[:, :, 1])
        for y in (0, 1):
            up[:, y] += np.bincount(parent[level], sent[level, y], n)
    belief = up.copy()
    both = np.zeros((n, 2, 2))
    for level in levels[1:]:
        rest = belief[parent[level]] - sent[level]  # the parent without this child
        s = rest[:, :, None] + model.pair[is_block[level]]
        belief[level] = up[level] + np.logaddexp(s[:, 0], s[:, 1])
        b = s + up[level][:, None, :]
        b = np.exp(b - b.max(axis=(1, 2), keepdims=True))
        both[level] = b / b.sum(axis=(1, 2), keepdims=True)
    return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -700, 700))), both


def fit(pages: list[tuple[str, set[str]]], steps: int = STEPS) -> Model:
    """Fit to pages with the set of their content blocks, by gradient ascent (Adam) with a small ridge.

    An element is labelled content if any block in it is.
    """
    tree, label = Tree(), []
    for html, content in pages:
        start = len(tree.parent)
        parse(html, tree)
        y = [1 if b is not None and b in content else 0 for b in tree.block[start:]]
        for i in range(len(y) - 1, 0, -1):
            y[tree.parent[start + i] - start] |= y[i]
        label += y
    arrays = _arrays(tree)
    parent, is_block, owner, feats, _ = arrays
    y = np.array(label)
    child = np.flatnonzero(parent >= 0)
    seen = np.zeros((2, 2, 2))
    np.add.at(seen, (is_block[child], y[parent[child]], y[child]), 1)
    x = np.zeros(len(FEATURES) + 8)
    m, v = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, steps + 1):
        model = Model(x[: len(FEATURES)], x[len(FEATURES) :].reshape(2, 2, 2))
        p, both = marginals(arrays, model)
        g_w = np.bincount(feats, (y - p)[owner], len(FEATURES))
        g_p = seen.copy()
        for k in (0, 1):
            g_p[k] -= both[child[is_block[child] == k]].sum(axis=0)
        g_w[0] = 0  # what fills empty places says nothing
        g = np.r_[g_w, g_p.ravel()] / len(pages) - 0.002 * x
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x = x + 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Model(x[: len(FEATURES)].copy(), x[len(FEATURES) :].reshape(2, 2, 2).copy())


def labelled_page(r: Random) -> tuple[str, set[str]]:
    """A page of a random layout, and its content blocks."""
    content: set[str] = set()
    word = lambda: "".join(r.choice("aeiou") + r.choice("bcdlmnrstv") for _ in range(r.randint(1, 4)))

    def words(n: int) -> str:
        return " ".join(word() for _ in range(max(1, n))).capitalize()

    def prose(n: int) -> str:
        out = []
        while n > 0:
            k = r.randint(3, 18)
            out.append(words(k) + r.choice("...!?"))
            n -= k
        return " ".join(out)

    def mine(text: str) -> str:
        content.add(text)
        return text

    def links(n: int, tag: str = "li") -> str:
        return "".join(f'<{tag}><a href="/{word()}">{words(r.randint(1, 3))}</a></{tag}>' for _ in range(n))

    def box(names: list[str], inner: str, tags: tuple[str, ...] = ("div", "div", "section", "aside")) -> str:
        t = r.choice(tags)
        attr = f' {r.choice(["class", "class", "id"])}="{r.choice(names)}"' if names else ""
        return f"<{t}{attr}>{inner}</{t}>"

    def p(text: str) -> str:
        return r.choice([f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}", f"<div>{text}</div>"])

    menu = lambda: r.choice([f"<nav><ul>{links(r.randint(2, 8))}</ul></nav>", box(["menu", "navbar", "main-nav", "breadcrumbs"], f"<ul>{links(r.randint(2, 8))}</ul>", ("div", "ul")), f'<div role="navigation">{links(4, "span")}</div>'])
    advert = lambda: box(["ad", "ads", "advert", "ad-slot", "sponsored", "promo-box"], r.choice([words(r.randint(2, 14)), prose(r.randint(4, 40)), p(prose(r.randint(4, 30))), f"<h{r.choice('1123')}>{words(3)}</h2>" + p(prose(r.randint(4, 30)))]))
    notice = lambda: box(["cookie-notice", "cookie-banner", "consent", "notice", "newsletter", "popup", "alert"], p(prose(r.randint(5, 40))) + r.choice(["", "<button>ok</button>", "<a href='#'>more</a>"]))
    form = lambda: f"<form{r.choice(['', ' class=search', ' id=login'])}>{r.choice(['', '<label>' + words(2) + '</label>', p(words(r.randint(2, 9)))])}<input name=q>{r.choice([words(2), ''])}</form>"
    side = lambda: box(["sidebar", "side", "widget", "related", "recommended", "popular"], f"<h3>{words(2)}</h3>" + r.choice([f"<ul>{links(5)}</ul>", p(prose(r.randint(5, 40)))]), ("aside", "aside", "div", "section"))
    talk = lambda: box(["comments", "comment-list", "discussion", "replies", "reader-comments"], f"<h3>{words(2)}</h3>" + "".join(box(["comment", "reply"], p(prose(r.randint(4, 60))), ("div", "li", "article")) for _ in range(r.randint(1, 5))), ("div", "section", "section"))
    share = lambda: box(["share", "social", "follow-us"], links(3, "span"), ("div",))
    legal = lambda: r.choice(["&copy; " + words(2) + " &middot; ", "", "&copy; 2020 "]) + r.choice([prose(r.randint(4, 30)), words(4)])
    foot = lambda: r.choice([f"<footer>{legal()}</footer>", f"<footer>{p(legal())}<ul>{links(3)}</ul></footer>", box(["footer", "site-footer", "copyright"], legal(), ("div",))])
    head = lambda: r.choice([f"<header>{r.choice(['', '<h1>' + words(2) + '</h1>', words(2), p(prose(6))])}{menu()}</header>", box(["header", "masthead", "topbar"], words(3), ("div",)), menu()])

    body = []
    if r.random() < 0.7:
        title = f"<h1>{mine(words(r.randint(1, 12)) + r.choice(['', '', '.']))}</h1>"
        own = r.random() < 0.25  # an article's own header
        body.append(f"<header{r.choice(['', ' class=entry-header'])}>{title}{p(mine(prose(12))) if r.random() < 0.3 else ''}</header>" if own else title)
    else:
        own = False
    for _ in range(r.choice([1, 1, 2, 3, 4, 6, 9])):
        k = r.random()
        if k < 0.68:
            text = mine(prose(r.choice([1, 2, 3, 8, 20, 60, 120])))
            body.append(r.choice([f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}", f'<p title="5" tall">{text}', f"<p><b>{text}<br>", f"<div>{text}</div>", f'<p>{text[:5]}<a href="/x">{text[5:12]}</a>{text[12:]}</p>']))
        elif k < 0.76:
            body.append(f"<h{r.choice('23')}>{mine(words(r.randint(1, 8)))}</h{r.choice('23')}>")
        elif k < 0.84:
            body.append("<ul>" + "".join(f"<li>{mine(r.choice([prose(8), words(3)]))}</li>" for _ in range(r.randint(1, 5))) + "</ul>")
        elif k < 0.88:
            body.append(f"<blockquote>{p(mine(prose(15)))}</blockquote>")
        elif k < 0.91:
            body.append("<table>" + "".join(f"<tr><td>{mine(words(2))}</td><td>{mine(words(3))}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>")
        elif k < 0.94:
            body.append(f"<pre>{mine(words(6))}</pre>")
        else:
            body.append(r.choice([advert, side, share, notice, form])())
    if r.random() < 0.2:
        body.append(r.choice([share, talk, foot])())
    inner = "".join(body)
    wrap = r.random()
    if own or wrap < 0.5:
        main = f"<article{r.choice(['', '', ' class=post', ' id=main'])}>{inner}</article>"
    elif wrap < 0.65:
        main = f"<main>{inner}</main>"
    elif wrap < 0.95:
        main = box(["content", "post", "entry-content", "main", "article-body", "story"], inner, ("div", "div", "section"))
    else:
        main = f"<div>{inner}</div>"
    if r.random() < 0.3:
        main = f"<div{r.choice(['', ' class=wrapper', ' id=page', ' class=container'])}>{main}{r.choice([side, talk, str])()}</div>"
    if r.random() < 0.2:
        main = f"<main>{main}</main>"
    if r.random() < 0.35:  # outer names that speak of other parts than the one they hold
        odd = [r.choice(["has", "with", "no", "two", "layout"]), r.choice(["sidebar", "ads", "comments", "header", "footer", "sponsored", "promo", "newsletter", "share", "search", "menu", "cookie", "related", "paywall", "comment"]), r.choice(["layout", "research", "policy", "column", "page", "article", "theme", "open", "desk"])]
        main = f"<{(t := r.choice(['div', 'div', 'section']))} class=\"{r.choice(['-', ' ', '-']).join(odd[r.randint(0, 1):])}\">{main}</{t}>"
    before = "".join(r.choice([menu, advert, notice, form, side, str])() for _ in range(r.randint(0, 3)))
    after = "".join(r.choice([talk, side, advert, notice, share, str, form])() for _ in range(r.randint(0, 3)))
    shown = f"<html><head><title>{words(4)}</title><style>p{{}}</style><script>var a='<p>';</script></head><body>{head() if r.random() < 0.8 else ''}{before}{main}{after}{foot() if r.random() < 0.8 else ''}</body></html>"
    return shown, content


@lru_cache(maxsize=4)
def trained(pages: int = PAGES, seed: int = 20) -> Model:
    r = Random(seed)
    return fit([labelled_page(r) for _ in range(pages)])


def main_texts(pages: list[str | None], model: Model) -> list[str]:
    tree, bounds = Tree(), [0]
    for html in pages:
        parse(html or "", tree)
        bounds.append(len(tree.parent))
    p, _ = marginals(_arrays(tree), model)
    keep = p > 0.5
    return ["\n".join(b for b, k in zip(tree.block[lo:hi], keep[lo:hi].tolist(), strict=True) if k and b is not None) for lo, hi in zip(bounds, bounds[1:], strict=False)]


def _extractor(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[str] = []
            some: list[str | None] = []
            size = 0
            for i, h in enumerate(b.column(2)):
                some.append(h.as_py())
                size += len(some[-1] or "")
                if size >= TOGETHER or i == b.num_rows - 1:
                    out += main_texts(some, model)
                    some, size = [], 0
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    return run


def digest(pages: DataFrame) -> DataFrame:
    """The contract's columns for every page."""
    d = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string"))
    d = d.mapInArrow(tidy(_extractor(trained())), "page_id bigint, url string, text string")
    return d.withColumn("n_chars", F.char_length("text").cast("bigint"))
