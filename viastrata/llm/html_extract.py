"""Main text of web pages: a tree-structured graphical model over the DOM.

Each node is content or not. A node's own features give it a potential, its parent's label another; sums of products, passed
from the leaves up and from the root down, give each node's marginal. Both potentials are counts of labelled pages: a built-in
set, written out from a rule, and pages of the corpus that label themselves by one <article> or <main>. What a node is called
is one feature among others, so pages without these elements are told by classes, links, lengths and neighbours.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_udf, frugal, sampled, small_batches, steps, strings

#: Pages that training takes at most; weight of a count that no page gave; marginal from which a node is content.
TRAIN_PAGES, SMOOTH, THRESHOLD = 2_000, 0.02, 0.5
#: Nodes that the corpus's pages count for, as a share of the built-in ones.
CORPUS_SHARE = 0.25

#: Fixed values of HTML: elements without an end, elements whose text is no text, elements that start a block of text,
#: elements that close an open paragraph.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes".split())
#: Elements that are no text either, but only if they end, and that may end in their own start tag.
HOLLOW = frozenset("template svg".split())
BLOCK = frozenset(
    "xmp address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td "
    "tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("html body caption tbody td tfoot th thead tr option legend".split())
#: Elements that an equal or listed start tag closes, up to the nearest listed holder.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
#: Elements that hold all of a page: what stands in them is told by itself.
PAGE = ("#root", "html", "body")
#: Words in class, id or role that speak for or against content.
AGAINST = (
    "ad", "ads", "advert", "advertisement", "banner", "promo", "sponsor", "sponsored", "nav", "navbar", "menu", "breadcrumb", "breadcrumbs", "footer",
    "header", "masthead", "sidebar", "aside", "widget", "related", "share", "social", "comment", "comments", "reply", "replies", "disqus", "cookie",
    "cookies", "notice", "consent", "gdpr", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "login", "search", "form", "copyright",
    "legal", "toolbar", "pagination", "pager", "tags", "meta", "skip", "hidden", "alert",
)
FOR = ("article", "content", "main", "body", "post", "entry", "story", "text", "prose", "page")

#: Deepest place of a node; what stands deeper is a neighbour there, as in browsers.
DEEPEST = 512

#: What follows "<" or "</": a name and attributes. A quote opens a value only after "="; else it is a character of its word.
#: Nothing is tried twice, so a tag that does not end costs one look at the rest of the page.
_TAG = re.compile(r"""(/?)([a-zA-Z][^\s/>\x00]*+)((?>[^=>]++|=\s*+(?>"[^"]*+"|'[^']*+'|(?!["'])[^\s>]*+))*+)>""")
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*+:\s*+none|aria-hidden\s*+=\s*+[\"']?true", re.I)
_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in (*RAW, *HOLLOW, "xmp")}
#: Character references of more digits than any character has, and zeros before digits.
_ZEROS, _HUGE = re.compile(r"&#0+(?=\d)"), re.compile(r"&#\d{8,};?")
_WORDS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_AGAINST, _FOR = frozenset(AGAINST), frozenset(FOR)


@dataclass
class Dom:
    """Nodes in page order. Text lies in nodes of its own, of tag '#text'."""

    tag: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    names: list[str] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    hidden: list[bool] = field(default_factory=list)

    def add(self, tag: str, parent: int, attributes: str = "", text: str = "") -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.names.append(" ".join(a or b or c for a, b, c in _NAMES.findall(attributes)).lower() if "=" in attributes else "")
        self.hidden.append(bool(attributes) and bool(_HIDDEN.search(attributes)))
        self.text.append(text)
        return len(self.tag) - 1


class Open:
    """The open elements, with the places of each name and of blocks, so that none is ever looked for along the whole list."""

    def __init__(self, root: int):
        self.nodes = [root]
        self.tags = ["#root"]
        self.blocks: list[int] = []
        self.places: dict[str, list[int]] = {}

    def parent(self) -> int:
        return self.nodes[min(len(self.nodes) - 1, DEEPEST - 1)]

    def push(self, node: int, tag: str) -> None:
        at = len(self.nodes)
        self.nodes.append(node)
        self.tags.append(tag)
        self.places.setdefault(tag, []).append(at)
        if tag in BLOCK:
            self.blocks.append(at)

    def last(self, *tags: str) -> int:
        """The innermost place of any of the names; 0 if there is none."""
        return max((at[-1] for t in tags if (at := self.places.get(t))), default=0)

    def close(self, place: int) -> None:
        """Ends the element at a place and all inside it."""
        for tag in reversed(self.tags[place:]):
            self.places[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()
        del self.nodes[place:], self.tags[place:]


def _plain(text: str) -> str:
    """Text with its character references decoded."""
    if "&" not in text:
        return text
    if "&#" in text:
        text = _HUGE.sub("\ufffd", _ZEROS.sub("&#", text))
    return unescape(text)


def _slash_ends(before: str) -> bool:
    """Whether a slash after these attributes ends the tag; else it belongs to an unquoted value."""
    return not before or before[-1] in " \t\n\r\f\"'" or "=" not in before.rsplit(None, 1)[-1]


def parse(html: str) -> Dom:
    """The page's tree, in time that grows with its length. Unclosed elements end with their parents or where HTML implies it;
    stray end tags are passed over; a tag or comment cut by the page's end is no text; comments, scripts and the like are left
    out; template and svg are, if they end; xmp holds text as it stands; noscript and math are elements like others."""
    dom = Dom()
    open_ = Open(dom.add("#root", -1))
    at, said, end = 0, 0, len(html)
    endless: set[str] = set()

    def find_end(tag: str, start: int) -> tuple[int, int] | None:
        """Where the element's end tag starts and ends."""
        if tag in endless:
            return None
        if stop := _ENDS[tag].search(html, start):
            return stop.start(), html.find(">", stop.end()) + 1 or end
        endless.add(tag)
        return None

    def say(upto: int) -> None:
        if said < upto:
            dom.add("#text", open_.parent(), text=_plain(html[said:upto]))

    while (start := html.find("<", at)) >= 0:
        at = start + 1
        mark = html[at : at + 1]
        if not (mark and (mark in "/!?" or mark.isascii() and mark.isalpha())):
            continue
        found = _TAG.match(html, at)
        if not found:
            if html.startswith("!--", at):
                # <!--> and <!---> are whole comments.
                short = 2 if html.startswith(("!-->", "!--->"), at) else 4
                stop = html.find("-->", start + short)
                stop = stop + 3 if stop >= 0 else end
            elif html.startswith("![CDATA[", at) and "]]>" not in endless and (stop := html.find("]]>", at)) >= 0:
                stop += 3
            elif mark in "!?" or mark == "/" and not html[at + 1 : at + 2].isalpha():
                if html.startswith("![CDATA[", at):
                    endless.add("]]>")
                stop = html.find(">", at) + 1 or end
            else:
                stop = end
            say(start)
            at = said = stop
            continue
        say(start)
        at = said = found.end()
        close, tag, attributes = found.groups()
        tag = tag.lower()
        if close:
            place = open_.last(tag)
            # An inline element ends only inside the block that it is in.
            if place and (tag in BLOCK or place > (open_.blocks[-1] if open_.blocks else 0)):
                open_.close(place)
            continue
        if tag in CLOSES_P and open_.blocks and open_.tags[open_.blocks[-1]] == "p":
            open_.close(open_.blocks[-1])
        if tag in IMPLIED:
            shut, holder = IMPLIED[tag]
            while (place := open_.last(*shut)) > open_.last(*holder):
                open_.close(place)
                if tag != "tr":
                    break
        itself = attributes.endswith("/") and _slash_ends(attributes[:-1])
        if tag in RAW:
            _, at = find_end(tag, at) or (end, end)
            said = at
            continue
        if tag in HOLLOW and not itself and (stop := find_end(tag, at)):
            at = said = stop[1]
            continue
        if tag == "xmp":
            stop, at = find_end(tag, at) or (end, end)
            dom.add("#text", dom.add(tag, open_.parent(), attributes), text=html[said:stop])
            said = at
            continue
        node = dom.add(tag, open_.parent(), attributes)
        if tag not in VOID and not (itself and tag not in BLOCK):
            open_.push(node, tag)
    say(end)
    return dom


def features(dom: Dom) -> list[tuple[str, ...]]:
    """Of each node: its name, words of its class and the like, and its text's length and share of links, in steps."""
    n = len(dom.tag)
    size, linked = [0] * n, [0] * n
    for k in range(n - 1, 0, -1):
        if dom.tag[k] == "#text":
            size[k] = len(dom.text[k].strip())
        if dom.tag[k] == "a":
            linked[k] = size[k]
        size[dom.parent[k]] += size[k]
        linked[dom.parent[k]] += linked[k]
    out = []
    for k in range(n):
        tag = dom.tag[k]
        own = [f"tag={tag}" if tag in BLOCK or tag in ("a", "button", "label", "#text", "#root") else "tag=inline"]
        if dom.names[k]:
            words = set(_WORDS.findall(dom.names[k]))
            own += ["name=against"] * bool(words & _AGAINST) + ["name=for"] * bool(words & _FOR and not words & _AGAINST)
        if tag != "#text":
            share = linked[k] / size[k] if size[k] else 0
            own += [f"links={0 if share < 0.1 else 1 if share < 0.5 else 2}"] if size[k] else ["empty"] * (tag in BLOCK)
        else:
            own += [f"long={min(size[k].bit_length() // 2, 6)}" + "a" * (dom.tag[dom.parent[k]] == "a")]
        if dom.hidden[k]:
            own += ["hidden"]
        out.append(tuple(own))
    return out


def holder_labels(dom: Dom) -> list[int] | None:
    """Labels of a page that has one element article, or else one main: 1 inside it, but for parts named otherwise. None: no such page."""
    for tag in ("article", "main"):
        tops = [k for k, t in enumerate(dom.tag) if t == tag]
        if len(tops) == 1:
            labels = [0] * len(dom.tag)
            for k in range(tops[0], len(labels)):
                inside = k == tops[0] or labels[dom.parent[k]]
                bad = dom.tag[k] in ("nav", "aside", "footer", "form", "button") or dom.hidden[k] or _AGAINST & set(_WORDS.findall(dom.names[k]))
                labels[k] = int(bool(inside) and not bad)
            return labels
    return None


def labelled_set() -> Iterator[tuple[str, list[int]]]:
    """The built-in labelled pages: each way to hold the text, with each kind of part that is none, in and beside it.
    A part that is content bears the attribute y."""
    long = "Some words of a text that goes on, as a text does, for a line or two, and then ends here. " * 3
    sizes = (6, 14, 25, 40, 60, 90, 130, 200)
    some = [long[:n] for n in sizes]
    bad = [f"<{t}><p>{x}</p><a href=x>more words</a></{t}>" for k, t in enumerate(("nav", "aside", "footer", "header", "form")) for x in some[k % 2 :: 2]]
    bad += [f'<div class="{w}"><p>{some[k % 8]}</p></div>' for k, w in enumerate(AGAINST)] + [f'<div class="{w}">{some[k * 3 % 8]}</div>' for k, w in enumerate(AGAINST[::2])]
    bad += [f'<section id="{w}"><h3>{some[k]}</h3><p>{some[k + 3]}</p></section>' for k, w in enumerate(("comments", "sidebar", "related", "cookie-notice"))]
    bad += ["<ul>" + "<li><a href=x>word</a></li>" * 6 + "</ul>", "<script>f()</script>", "<button>Go on</button>", f"<div hidden><p>{long}</p></div>"]
    holders = ["article", "main", "section", *(f'div class="{w}"' for w in FOR), "div", ""]
    for k, part in enumerate(bad):
        for j, holder in enumerate(holders):
            inner = f"<h1 y>A heading of it</h1><p y>{long}</p><p y><b y>{long[:60]}</b> {long}<br y>{long[:40]}</p><p y><b y>{long[:90]}<br y></b></p><p y>Shortly.</p><p y>So</p><p y>{long * (2 + 7 * (j % 2))}</p>"
            inner += "".join(bad[(k * 5 + j * 3 + n * 11) % len(bad)] for n in range(j % 4))
            inner += "<ul y><li y>A point that it makes</li></ul>" if k % 2 else f"<blockquote y><p y>{long[:90]}</p></blockquote><h2 y>More of it</h2><p y>Short one.</p>"
            held = f"<{holder} y>{inner}</{holder.split()[0]}>" if holder else inner
            body = f"{part}{held}{bad[(k * 7 + j) % len(bad)]}"
            body = f"<div><div>{body}</div></div>" if holder and k % 3 == 0 else body
            page = f"<html y><head><title>T</title></head><body y>{body}</body></html>"
            dom = parse(page)
            yield page, _marked(page, dom)


def _marked(page: str, dom: Dom) -> list[int]:
    tags = (_TAG.match(page, m.end()) for m in re.finditer("<", page))
    marks = [bool(re.search(r"\sy$", m[3])) for m in tags if m and not m[1] and m[2] not in RAW]
    starts = iter(marks)
    labels: list[int] = []
    for k, tag in enumerate(dom.tag):
        labels.append(1 if tag == "#root" else labels[dom.parent[k]] if tag == "#text" else int(next(starts)))
    return [0 if t in PAGE else y for t, y in zip(dom.tag, labels, strict=True)]


def _above(dom: Dom, k: int, label: int) -> str:
    return "up=page" if dom.tag[dom.parent[k]] in PAGE else f"up={label}"


def count(doms: Iterator[tuple[Dom, list[int]]]) -> Counter:
    """Rows with each (feature, label), (label of the parent, label) and label."""
    seen: Counter = Counter()
    for dom, labels in doms:
        for k, own in enumerate(features(dom)):
            y = labels[k]
            seen[("n", y)] += 1
            for f in own:
                seen[(f, y)] += 1
            if k:
                seen[(_above(dom, k, labels[dom.parent[k]]), y)] += 1
    return seen


@dataclass(frozen=True)
class Model:
    """own: log potentials of (not content, content) by feature; edge[parent's label][label]; page: of what the page itself holds."""

    own: dict[str, tuple[float, float]]
    edge: np.ndarray
    page: np.ndarray


def to_model(seen: Counter, smooth: float = SMOOTH) -> Model:
    n = [seen[("n", 0)], seen[("n", 1)]]
    names = {f for f, _ in seen if f != "n" and not f.startswith("up=")}
    rate = lambda f, y: np.log((seen[(f, y)] + smooth) / (n[y] + 2 * smooth))
    edge = np.array([[seen[(f"up={p}", y)] + smooth for y in (0, 1)] for p in ("0", "1", "page")])
    edge = np.log(edge / edge.sum(axis=1, keepdims=True))
    return Model({f: (rate(f, 0), rate(f, 1)) for f in sorted(names)}, edge[:2], edge[2])


def marginals(model: Model, parent: np.ndarray, own: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Share of content of each node of a forest, by sum-product. parent: -1 at tops, which are told by themselves; own: log
    potentials; depth: from 0 at tops."""
    up = own.copy()
    message = np.zeros_like(own)
    levels = np.split(np.argsort(depth, kind="stable"), np.cumsum(np.bincount(depth, minlength=1))[:-1]) if len(depth) else []
    for nodes in reversed(levels[1:]):
        # What a child says to its parent: the sum over the child's labels.
        m = np.logaddexp(model.edge[:, 0] + up[nodes, :1], model.edge[:, 1] + up[nodes, 1:])
        message[nodes] = m
        above, child = np.unique(parent[nodes], return_inverse=True)
        for y in (0, 1):
            up[above, y] += np.bincount(child, m[:, y])
    belief = up.copy()
    for d, nodes in enumerate(levels):
        if d == 0:
            belief[nodes] += model.page
            continue
        without = belief[parent[nodes]] - message[nodes]
        down = np.stack([np.logaddexp(without[:, 0] + model.edge[0, y], without[:, 1] + model.edge[1, y]) for y in (0, 1)], axis=1)
        belief[nodes] += down - down.max(axis=1, keepdims=True)
    return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -700, 700)))


def blocks(dom: Dom, content: np.ndarray) -> list[str]:
    """Texts of content, block by block: a block ends where a block element starts or ends; br and other inline elements are a
    space or nothing. White space inside is one space."""
    out: list[str] = []
    parts: list[str] = []
    held = -1
    home = [0] * len(dom.tag)
    for k, tag in enumerate(dom.tag):
        home[k] = k if tag in BLOCK or k == 0 else home[dom.parent[k]] if k else 0
        if tag in BLOCK:
            held = _flush(out, parts, -1)
        elif tag == "br":
            parts.append(" ")
        elif tag == "#text" and content[k]:
            if home[k] != held:
                _flush(out, parts, -1)
                held = home[k]
            parts.append(dom.text[k])
    _flush(out, parts, -1)
    return out


def _flush(out: list[str], parts: list[str], held: int) -> int:
    if text := _SPACE.sub(" ", "".join(parts)).strip():
        out.append(text)
    parts.clear()
    return held


def extract_batch(pages: list[str], model: Model, threshold: float = THRESHOLD) -> list[list[str]]:
    """The blocks of main text of each page."""
    doms = [parse(p) for p in pages]
    sizes = [len(d.tag) for d in doms]
    base = np.cumsum([0, *sizes])
    parent, own, depth = np.full(base[-1], -1), np.zeros((base[-1], 2)), np.zeros(base[-1], np.int64)
    for d, b in zip(doms, base[:-1].tolist(), strict=True):
        # What the page itself holds tops a tree of its own.
        p = np.array([-1 if q < 0 or d.tag[q] in PAGE else q for q in d.parent])
        parent[b : b + len(p)] = np.where(p < 0, -1, p + b)
        level = [0] * len(p)
        for k, q in enumerate(p.tolist()):
            if q >= 0:
                level[k] = level[q] + 1
        depth[b : b + len(p)] = level
        own[b : b + len(p)] = [_sum(model, f) for f in features(d)]
    content = marginals(model, parent, own, depth) >= threshold
    return [blocks(d, content[b : b + n]) for d, b, n in zip(doms, base[:-1].tolist(), sizes, strict=True)]


def _sum(model: Model, own: tuple[str, ...]) -> tuple[float, float]:
    a = b = 0.0
    for f in own:
        if x := model.own.get(f):
            a += x[0]
            b += x[1]
    return a, b


def fit(pages: DataFrame, train_pages: int = TRAIN_PAGES) -> Model:
    """Potentials from the built-in set and (page_id, html) of the corpus: of the pages whose ids hash lowest, train_pages at
    most, those that label themselves. Tasks send counts, a few hundred numbers each. No pages: the built-in set alone."""
    seen = count((parse(page), labels) for page, labels in labelled_set())
    small_batches()

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got: Counter = Counter()
        for batch in batches:
            for html in batch["html"]:
                dom = parse(html or "")
                if labels := holder_labels(dom):
                    got += count(iter([(dom, labels)]))
        yield pd.DataFrame([(f, y, n) for (f, y), n in got.items()], columns=["f", "y", "n"])

    sample = sampled(pages.select("page_id", "html"), "page_id", train_pages).select("html")
    summed = sample.mapInPandas(tally, "f string, y int, n long").groupBy("f", "y").agg(F.sum("n").alias("n"))
    return to_model(blend(seen, Counter({(r["f"], r["y"]): r["n"] for r in summed.collect()})))


def blend(built_in: Counter, corpus: Counter) -> Counter:
    """The counts together; the corpus counts for CORPUS_SHARE of the built-in nodes at most, however many pages it gave, so
    that the one layout of a uniform corpus does not unteach the others."""
    nodes = lambda c: c[("n", 0)] + c[("n", 1)]
    share = min(1.0, CORPUS_SHARE * nodes(built_in) / max(nodes(corpus), 1))
    return Counter({k: built_in[k] + share * corpus[k] for k in {*built_in, *corpus}})


def main_text(html: Column, model: Model, threshold: float = THRESHOLD) -> Column:
    """Column of string: the main text of each whole page, blocks joined by \\n. Null and empty pages, and pages without
    content: the empty string."""

    @arrow_udf("string")
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in frugal(batches):
            yield pa.array(["\n".join(b) for run in steps(strings(batch)) for b in extract_batch(run, model, threshold)], pa.string())

    return texts(html)
