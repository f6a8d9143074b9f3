"""Main text of web pages: a graphical model over the DOM tree, whose marginals say which blocks are content."""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from loomgraph.llm.common import blocks
from loomgraph.llm.html_tree import HEADINGS, Node, attributes, parse

#: Labelled pages that a model learns from at most, the first given.
LABELLED = 2_000

#: Words of class, id and role that hint at what an element is. Any of them may begin a part of a name.
CUES = {
    "content": "article content main post entry story body text prose document blog hentry page reader".split(),
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs skip sitemap links".split(),
    "head": "header masthead logo branding topbar toolbar site brand".split(),
    "foot": "footer foot copyright colophon legal imprint".split(),
    "side": "sidebar aside side rail widget related recommended recommendations popular trending recent teaser archive tags categories".split(),
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup paywall warning message toast".split(),
    "advert": "ad ads adv advert adverts advertisement banner sponsor sponsored promo promotion adsense dfp".split(),
    "form": "form search login contact input field signin".split(),
    "comment": "comment comments reply replies respond response responses discussion disqus feedback thread".split(),
    "share": "share sharing social follow tools print".split(),
}
CUE_OF = {word: k for k, words in enumerate(CUES.values()) for word in words}
#: Kinds of elements with features of their own; the last is any other. Blocks of text are kind 0.
KINDS = ["text", "html", "body", "main", "article", "section", "div", "p", "heading", "list", "li", "quote", "table", "cell", "figure", "nav", "header", "footer", "aside", "form", "label", "details", "address", "other"]
KIND_OF = {
    "": 0, "html": 1, "body": 2, "main": 3, "article": 4, "section": 5, "div": 6, "center": 6, "p": 7, "ul": 9, "ol": 9, "dl": 9, "li": 10, "dt": 10, "dd": 10, "blockquote": 11, "pre": 11,
    "table": 12, "tbody": 12, "thead": 12, "tfoot": 12, "tr": 12, "td": 13, "th": 13, "caption": 13, "figure": 14, "figcaption": 14, "nav": 15, "menu": 15, "header": 16, "hgroup": 16, "footer": 17,
    "aside": 18, "dialog": 18, "form": 19, "fieldset": 19, "legend": 20, "optgroup": 20, "option": 20, "search": 19, "details": 21, "summary": 21, "address": 22,
} | {h: 8 for h in HEADINGS}
ROLES = {"navigation": 15, "banner": 16, "contentinfo": 17, "complementary": 18, "search": 19, "form": 19, "main": 3, "article": 4, "dialog": 18, "alertdialog": 18}
#: Names of cues, and flags of attributes.
OF_ATTRIBUTES = len(CUES) + 2
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+")


@lru_cache(maxsize=65_536)
def attribute_cues(tag: str, text: str) -> tuple[int, np.ndarray]:
    """The kind of an element, its role respected, and the hints of its attributes: cues, hidden, an explicit role."""
    cues = np.zeros(OF_ATTRIBUTES)
    kind = KIND_OF.get(tag, len(KINDS) - 1)
    if text.strip():
        found = attributes(text)
        role = found.get("role", "").strip().lower()
        if role in ROLES:
            kind, cues[-1] = ROLES[role], 1
        for part in NAME_PARTS.findall(f"{found.get('class', '')} {found.get('id', '')}"):
            k = CUE_OF.get(part.lower())
            if k is not None:
                cues[k] = 1
        style = found.get("style", "").replace(" ", "").lower()
        cues[-2] = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style
    return kind, cues


class Trees:
    """The trees of many pages as arrays: parents, depths, features of each node, and the blocks of text."""

    def __init__(self, pages: Iterable[list[Node]]):
        parent, depth, kind, cues, size, linked, marks, self.texts, self.page = [], [], [], [], [], [], [], [], []
        for number, nodes in enumerate(pages):
            first = len(parent)
            for n in nodes:
                parent.append(n.parent + first if n.parent >= 0 else -1)
                depth.append(n.depth)
                if n.text:
                    kind.append(0)
                    cues.append(NO_CUES)
                    size.append(len(n.text))
                    linked.append(min(n.linked, len(n.text)))
                    marks.append((n.text[-1] in ".!?:;…。\"”»", "©" in n.text or "(c)" in n.text))
                else:
                    k, c = attribute_cues(n.tag, n.attributes)
                    kind.append(k)
                    cues.append(c)
                    size.append(0)
                    linked.append(0)
                    marks.append((False, False))
                self.texts.append(n.text)
                self.page.append(number)
        self.parent, self.depth, self.kind = np.array(parent, np.int64), np.array(depth, np.int64), np.array(kind, np.int64)
        self.page = np.array(self.page, np.int64)
        self.is_text = np.array(size, np.int64) > 0
        order = np.argsort(self.depth, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(self.depth[order])) + 1)
        self.features = self.measured(np.array(cues).reshape(-1, OF_ATTRIBUTES), np.array(size, float), np.array(linked, float), np.array(marks, float).reshape(-1, 2))

    def up(self, rows: np.ndarray, values: np.ndarray, total: np.ndarray) -> None:
        """Adds values of a level's rows to their parents' in total: children of one parent are neighbours."""
        parent = self.parent[rows]
        first = np.flatnonzero(np.diff(parent, prepend=-1))
        total[parent[first]] += np.add.reduceat(values, first)

    def summed(self, values: np.ndarray) -> np.ndarray:
        """Of each node the sum over what is below it, itself included."""
        total = values.copy()
        for rows in self.levels[:0:-1]:
            self.up(rows, total[rows], total)
        return total

    def measured(self, cues: np.ndarray, size: np.ndarray, linked: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """A row of features for each node; those of an element's text are of all that is below it."""
        n = len(self.kind)
        sums = self.summed(np.column_stack([size, linked, self.is_text, marks])) if n else np.zeros((0, 5))
        below, share, parts = sums[:, 0], sums[:, 1] / np.maximum(1, sums[:, 0]), np.maximum(1, sums[:, 2])
        mean = below / parts
        kinds = np.zeros((n, len(KINDS)))
        kinds[np.arange(n), self.kind] = 1
        # a block is read with the kind of the element around it
        above = np.zeros((n, len(KINDS)))
        inner = np.flatnonzero(self.is_text)
        above[inner, self.kind[self.parent[inner]]] = 1
        numbers = np.column_stack([
            share > 0.5, share > 0.9, share, np.minimum(np.log1p(mean), 7) / 7, mean < 25, mean > 120, np.minimum(np.log1p(below), 10) / 10,
            sums[:, 3] / parts, sums[:, 4] > 0, below == 0,
        ])
        # what a text reads like speaks for blocks, and for elements that nothing else tells apart
        vague = np.isin(self.kind, VAGUE) & ~cues.any(axis=1)
        first = np.zeros(n)  # the page's first article and its first main
        for kind in (KINDS.index("article"), KINDS.index("main")):
            rows = np.flatnonzero(self.kind == kind)
            first[rows[np.diff(self.page[rows], prepend=-1) > 0]] = 1
        return np.hstack([np.ones((n, 1)), numbers * self.is_text[:, None], numbers * vague[:, None], kinds, above, cues, first[:, None]])


#: Elements that may be anything.
VAGUE = [KINDS.index(k) for k in ("section", "div", "list", "cell", "table", "other")]
#: Elements that hold an article with all that belongs to it.
CONTAINERS = [KINDS.index(k) for k in ("body", "main", "article", "section", "div", "cell")]
NO_CUES = np.zeros(OF_ATTRIBUTES)
PAIR_KINDS = len(KINDS)


def log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return (np.log(np.exp(a - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


class TreeModel:
    """Nodes are content (1) or not (0). p is proportional to the product of exp(unary[y]) over nodes and exp(pair[kind,
    parent's y, child's y]) over edges; kind is the child's. All marginals come from one pass of messages up the tree and one down."""

    def __init__(self, features: int):
        self.unary = np.zeros(features)
        self.pair = np.zeros((PAIR_KINDS, 2, 2))

    def marginals(self, trees: Trees) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """p(node is content), p(parent's and child's y) of each node but the roots, and log Z of all pages together."""
        n = len(trees.kind)
        own = np.zeros((n, 2))
        own[:, 1] = trees.features @ self.unary
        up = own.copy()  # the node and all below it
        message = np.zeros((n, 2))
        for rows in trees.levels[:0:-1]:
            message[rows] = log_sum(self.pair[trees.kind[rows]] + up[rows][:, None, :], 2)
            trees.up(rows, message[rows], up)
        log_z = log_sum(up[trees.levels[0]], 1).sum() if n else 0.0
        belief = up.copy()
        both = np.zeros((n, 2, 2))
        for rows in trees.levels[1:]:
            # what the parent knows without this child
            above = belief[trees.parent[rows]] - message[rows]
            joint = above[:, :, None] + self.pair[trees.kind[rows]] + up[rows][:, None, :]
            belief[rows] = log_sum(joint, 1)
            joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
            both[rows] = joint / joint.sum(axis=(1, 2), keepdims=True)
        p = 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500)))
        return p, both, log_z

    def fit(self, trees: Trees, labels: np.ndarray, steps: int = 150, ridge: float = 4e-4) -> TreeModel:
        """Limited-memory quasi-Newton ascent on the log-likelihood of all nodes' labels: seen minus expected features."""
        edges = np.flatnonzero(trees.parent >= 0)
        kinds = np.zeros((len(edges), PAIR_KINDS))
        kinds[np.arange(len(edges)), trees.kind[edges]] = 1
        seen = np.concatenate([trees.features.T @ labels, (kinds.T @ np.eye(4)[2 * labels[trees.parent[edges]] + labels[edges]]).ravel()])
        pages, cut = max(1, trees.page.max(initial=0) + 1), len(self.unary)

        def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
            self.unary, self.pair = w[:cut], w[cut:].reshape(self.pair.shape)
            p, both, log_z = self.marginals(trees)
            expected = np.concatenate([trees.features.T @ p, (kinds.T @ both[edges].reshape(-1, 4)).ravel()])
            return (log_z - seen @ w) / pages + ridge / 2 * w @ w, (expected - seen) / pages + ridge * w

        w = np.zeros(len(seen))
        value, slope = loss(w)
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        for _ in range(steps):
            way, back = -slope, []
            for s, y in reversed(pairs):
                back.append(s @ way / (s @ y))
                way = way - back[-1] * y
            if pairs:
                way = way * (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1])
            for (s, y), a in zip(pairs, reversed(back)):
                way = way + (a - y @ way / (s @ y)) * s
            size = 1.0 if pairs else 1 / max(1.0, float(np.abs(slope).sum()))
            while True:
                new, new_slope = loss(w + size * way)
                if new <= value + 1e-4 * size * (slope @ way) or size < 1e-8:
                    break
                size /= 2
            s, y = size * way, new_slope - slope
            if size < 1e-8 or value - new < 1e-7:
                break
            pairs = [*pairs[-9:], (s, y)] if s @ y > 1e-12 else pairs
            w, value, slope = w + s, new, new_slope
        loss(w)
        return self


def labels_of(trees: Trees, content: np.ndarray) -> np.ndarray:
    """Labels of all nodes from those of the blocks of text: an element is content if all its text is, or if some of it is
    and the element lies inside the smallest container that holds all content of the page, or is that."""
    size = np.array([len(t) for t in trees.texts], float)
    sums = trees.summed(np.column_stack([size, size * content]))
    pure = (sums[:, 1] > 0) & (sums[:, 0] == sums[:, 1])
    total = np.zeros(trees.page.max(initial=0) + 1)
    roots = trees.levels[0]
    total[trees.page[roots]] = sums[roots, 1]
    whole = np.isin(trees.kind, CONTAINERS) & (sums[:, 1] == total[trees.page])
    around = np.zeros(len(size), bool)  # holds such a container and is none of the smallest
    for rows in trees.levels[:0:-1]:
        up = rows[whole[rows] | around[rows]]
        around[trees.parent[up]] = True
    labels = np.where(trees.is_text, content > 0, pure | ((sums[:, 1] > 0) & ~around))
    return labels.astype(np.int64)


class Maker:
    """Labelled pages by rule: content under many kinds of elements and names, among menus, headers, notices, adverts,
    forms, sidebars, comments and footers. Blocks of content carry the attribute data-main."""

    MARK = ' data-main="1"'

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.signs, self.short = True, False

    def words(self, low: int, high: int) -> str:
        return " ".join("".join(self.r.choice("aeioulnrstmdpk") for _ in range(self.r.randint(2, 9))) for _ in range(self.r.randint(low, high)))

    def sentences(self, low: int, high: int) -> str:
        """Running text; on some pages without any signs, or of one word again and again."""
        n = self.r.randint(low, high)
        if self.short:
            return self.words(1, 4) + self.r.choice(".. ").strip()
        if self.signs:
            return " ".join(self.words(1, 22).capitalize() + self.r.choice("....?!") for _ in range(n))
        return " ".join(self.words(1, 22) if self.r.random() < 0.5 else " ".join([self.words(1, 1)] * self.r.randint(1, 20)) for _ in range(n))

    def named(self, tag: str, *names: str, chance: float = 0.85) -> str:
        """A start tag, mostly with a class or id of one of the names."""
        if self.r.random() > chance or not names:
            return f"<{tag}>"
        name = self.r.choice(names)
        name = self.r.choice([name, f"{name}-{self.words(1, 1)}", f"{self.words(1, 1)}-{name}", f"{name} {self.words(1, 1)}", f"{name}_{self.words(1, 1)}"])
        return f'<{tag} {self.r.choice(["class", "class", "id"])}="{name}">'

    def links(self) -> str:
        rows = [f'<a href="/{self.words(1, 1)}">{self.words(1, 3)}</a>' for _ in range(self.r.randint(2, 9))]
        return self.r.choice([f"<ul>{''.join(f'<li>{x}</li>' for x in rows)}</ul>", " | ".join(rows), "".join(f"<div>{x}</div>" for x in rows)])

    def prose(self, mark: str = "") -> str:
        """A part of running text."""
        m, kind = mark, self.r.random()
        if kind < 0.62:
            body = self.sentences(1, self.r.choice([1, 2, 6, 12]))
            if self.r.random() < 0.15:
                body = f'{self.sentences(1, 2)} <a href="/x">{self.words(1, 3)}</a> {body}'
            if self.r.random() < 0.15:
                body = "<b>" + body + "<br>"
            return f"<p{m}>{body}" + self.r.choice(["</p>", "</p>", "\n"])
        if kind < 0.74:
            return f"<h{(k := self.r.randint(2, 4))}{m}>{self.words(1, 8)}</h{k}>"
        if kind < 0.82:
            return "<ul>" + "".join(f"<li{m}>{self.r.choice([self.words(1, 6), self.sentences(1, 2)])}</li>" for _ in range(self.r.randint(2, 6))) + "</ul>"
        if kind < 0.88:
            return f"<blockquote><p{m}>{self.sentences(1, 3)}</p></blockquote>"
        if kind < 0.92:
            return f"<pre{m}>{self.words(3, 20)}</pre>"
        if kind < 0.96:
            return "<table>" + "".join(f"<tr><td{m}>{self.words(1, 4)}</td><td{m}>{self.words(1, 3)}</td></tr>" for _ in range(self.r.randint(2, 5))) + "</table>"
        return f"<figure><img src=x><figcaption{m}>{self.sentences(1, 1)}</figcaption></figure>" if self.r.random() < 0.5 else f"<div{m}>{self.sentences(1, 4)}</div>"

    def closed(self, start: str, body: str) -> str:
        return f"{start}{body}</{start[1:].split()[0].rstrip('>')}>"

    def advert(self) -> str:
        return self.closed(self.named(self.r.choice(["div", "div", "aside", "section"]), *CUES["advert"], chance=1), self.r.choice([self.sentences(1, 3), f'<a href="/x">{self.words(2, 6)}</a>', f"<p>{self.sentences(1, 2)}</p>"]))

    def notice(self) -> str:
        start = self.named(self.r.choice(["div", "div", "section", "aside", "dialog"]), *CUES["notice"], chance=1)
        return self.closed(start, f"<p>{self.sentences(1, 3)}</p>" + self.r.choice(["", f"<button>{self.words(1, 2)}</button>", f'<a href="/x">{self.words(1, 2)}</a>']))

    def menu(self) -> str:
        return self.closed(self.r.choice([self.named("nav", *CUES["menu"], chance=0.4), self.named("div", *CUES["menu"], chance=0.9), self.named("ul", *CUES["menu"], chance=1)]), self.links())

    def header(self) -> str:
        start = self.r.choice([self.named("header", *CUES["head"], chance=0.5), self.named("div", *CUES["head"], chance=1)])
        return self.closed(start, f'<{(t := self.r.choice(["h1", "div", "p", "a"]))}>{self.words(1, 5)}</{t}>' + self.r.choice(["", self.menu(), f"<p>{self.sentences(1, 1)}</p>"]))

    def footer(self) -> str:
        start = self.r.choice([self.named("footer", *CUES["foot"], chance=0.4), self.named("div", *CUES["foot"], chance=1)])
        return self.closed(start, self.r.choice(["&copy; ", "", "Copyright "]) + self.r.choice([self.sentences(1, 2), self.words(1, 6) + " &middot; " + self.sentences(1, 1), self.links(), f"<p>{self.sentences(1, 4)}</p>"]))

    def side(self) -> str:
        start = self.r.choice([self.named("aside", *CUES["side"], chance=0.5), self.named("div", *CUES["side"], chance=1), self.named("section", *CUES["side"], chance=1)])
        return self.closed(start, f"<h{(k := self.r.randint(2, 4))}>{self.words(1, 3)}</h{k}>" + self.r.choice([self.links(), f"<p>{self.sentences(1, 4)}</p>", f"<ul><li>{self.words(2, 6)}</li><li>{self.words(2, 6)}</li></ul>", self.prose()]))

    def form(self) -> str:
        inner = f"<label>{self.words(1, 3)}</label><input name=x><button>{self.words(1, 2)}</button>"
        return self.r.choice([f"<form>{inner}</form>", f"<form><p>{self.sentences(1, 2)}</p>{inner}</form>", self.closed(self.named("div", *CUES["form"], chance=1), f"<p>{self.words(2, 6)}</p>{inner}")])

    def comments(self) -> str:
        start = self.named(self.r.choice(["div", "section", "ol", "ul"]), *CUES["comment"], chance=1)
        item = "li" if start[1] in "ou" else self.r.choice(["div", "div", "div", "p", "p", "article"])
        inside = lambda: f"<p>{self.sentences(1, 6)}</p>" if item != "p" else self.sentences(1, 6)
        names = ("comment", "reply", "response")
        return self.closed(start, self.r.choice(["", f"<h3>{self.words(1, 3)}</h3>"]) + "".join(self.closed(self.named(item, *names, chance=1 if item == "article" else 0.6), self.r.choice(["", f"<b>{self.words(1, 2)}</b> "]) + inside()) for _ in range(self.r.randint(1, 5))))

    def share(self) -> str:
        return self.closed(self.named(self.r.choice(["div", "ul"]), *CUES["share"], chance=1), self.r.choice([self.links(), self.words(1, 3)]))

    def content(self) -> str:
        r, m = self.r, self.MARK
        parts = [self.prose(m) for _ in range(r.choice([1, 1, 2, 3, 6, 12, 25, 60]))]
        if r.random() < 0.2:
            parts.insert(r.randrange(len(parts) + 1), f"{self.closed(self.named('div', 'section', 'inner', 'wrap', 'row', chance=0.7), ''.join(self.prose(m) for _ in range(r.randint(1, 4))))}")
        for extra, chance in ((self.advert, 0.2), (self.share, 0.15), (self.side, 0.12), (self.menu, 0.05), (self.form, 0.08), (self.notice, 0.05)):
            if r.random() < chance:
                parts.insert(r.randrange(len(parts) + 1), extra())
        title = f"<h1{m}>{self.words(1, 10)}</h1>"
        if r.random() < 0.15:
            title = f"<header>{title}</header>"
        body = (title if r.random() < 0.85 else "") + "".join(parts)
        if r.random() < 0.12:
            body += self.comments()
        if r.random() < 0.1:
            body += f"<footer>{self.words(1, 6)}</footer>"
        wrap = r.choice(["article", "article", "article", "main", "both", "named", "named", "named", "plain", "cell", "section"])
        names = CUES["content"]
        if wrap == "both":
            return f"<main>{self.closed(self.named('article', *names, chance=0.4), body)}</main>"
        if wrap == "named":
            return self.closed(self.named("div", *names, chance=1), body)
        if wrap == "plain":
            return f"<div>{body}</div>" if r.random() < 0.5 else body
        if wrap == "cell":
            return f"<table><tr><td>{self.links()}</td><td>{body}</td></tr></table>"
        return self.closed(self.named(wrap, *names, chance=0.4), body)

    def page(self) -> str:
        r = self.r
        self.signs, self.short = r.random() < 0.75, r.random() < 0.15
        before = [f() for f, chance in ((self.header, 0.45), (self.menu, 0.6), (self.notice, 0.3), (self.advert, 0.4), (self.side, 0.12), (self.form, 0.12)) if r.random() < chance]
        after = [f() for f, chance in ((self.share, 0.15), (self.side, 0.35), (self.comments, 0.35), (self.advert, 0.2), (self.form, 0.2), (self.notice, 0.15)) if r.random() < chance]
        r.shuffle(before)
        r.shuffle(after)
        main = self.content() if r.random() < 0.97 else ""
        if r.random() < 0.2:
            after, main = [], f"<div>{main}{''.join(after)}</div>"
        body = "".join(before) + main + "".join(after) + (self.footer() if r.random() < 0.7 else "")
        if r.random() < 0.25:
            body = self.closed(self.named("div", "wrapper", "container", "page", "layout", "outer"), body)
        return f"<!DOCTYPE html><html><head><title>x</title></head><body>{body}</body></html>"


def labelled_pages(n: int = 800, seed: int = 11) -> list[str]:
    """Pages whose blocks of content carry data-main."""
    maker = Maker(seed)
    return [maker.page() for _ in range(n)]


def fit_extractor(pages: Iterable[str] | None = None, limit: int = LABELLED) -> TreeModel:
    """A model from labelled pages, the first `limit` at most: content is the text inside elements with the attribute data-main. Without
    any given, from pages made by rule."""
    trees = [parse(p) for _, p in zip(range(limit), labelled_pages() if pages is None else pages)]
    content = []
    for nodes in trees:
        inside = []
        for n in nodes:
            inside.append(bool(n.parent >= 0 and inside[n.parent]) or "data-main" in n.attributes)
        content.extend(bool(n.text) and inside[n.parent] for n in nodes)
    bare = [[n._replace(attributes=re.sub(r'\s*data-main(="[^"]*")?', "", n.attributes)) for n in nodes] for nodes in trees]
    trees = Trees(bare)
    return TreeModel(trees.features.shape[1]).fit(trees, labels_of(trees, np.array(content, np.int64)))


def main_texts(model: TreeModel, pages: list[str]) -> list[str]:
    """The main text of each page: its blocks of content, a line each."""
    trees = Trees(map(parse, pages))
    p, _, _ = model.marginals(trees)
    out: list[list[str]] = [[] for _ in pages]
    for k in np.flatnonzero(trees.is_text & (p >= 0.5)).tolist():
        out[trees.page[k]].append(trees.texts[k])
    return ["\n".join(lines) for lines in out]


def extracted(pages: DataFrame, html_col: str = "html", text_col: str = "text", count_col: str = "n_chars", model: TreeModel | None = None) -> DataFrame:
    """pages with the main text of each page and its code points, in place of columns of these names.

    The tree of a page's elements and blocks of text is a graphical model: unary potentials from what a node is and
    reads like (its kind, names of class and id, links, length), pair potentials between a node and its parent. Messages up and down
    the tree give exact marginals; blocks that are content with at least one half are kept, in page order, a line each. White space
    inside a block is one blank, character references are decoded, nothing is cut. Scripts, styles and controls
    of forms are no text. A null or empty page, and one without content, gives an empty text; repeated rows are read each for itself, other
    columns of any name are carried along, an empty table gives an empty one. A page is one task's work whatever its size.
    """
    model = model or fit_extractor()
    names = [c for c in pages.columns if c not in (text_col, count_col)]
    rows = pages.select(*(pages[c] for c in names))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, _ in blocks(batches, html_col):
            texts = main_texts(model, [t or "" for t in block.column(names.index(html_col)).to_pylist()])
            yield pa.RecordBatch.from_arrays([*block.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*names, text_col, count_col])

    schema = StructType([*rows.schema.fields, StructField(text_col, StringType()), StructField(count_col, LongType())])
    return rows.mapInArrow(work, schema)
