"""HTML extraction (operator 5): boosted trees over DOM nodes.

A page is parsed into its block elements. Gradient-boosted trees give each node
the chance that it belongs to the article (itself part of it, or an ancestor of
it) from subtree density, attribute tokens, depth and sibling statistics. Decoding
is hierarchical: the labelling of greatest likelihood in which no node is kept
below a dropped one, found from the leaves up. The text of kept nodes is the
result. Parsing and decoding are per page, scoring is one array operation for a
batch of pages; nothing is exchanged.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter

import numpy as np
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from graphloom.llm.base import annotate, as_rows, table

#: Labelled pages to train on, and the size of the ensemble.
PAGES = 2400
TREES, DEPTH, SEED = 40, 6, 42

# Fixed values of HTML: elements without content, elements whose content is no
# text of the page, elements that start a block, and what closes an open <p>.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template title svg iframe object select datalist button textarea canvas audio video".split())
#: Elements that end an open drawing, as in browsers.
BREAKS = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span "
    "strong strike sub sup table tt u ul var article main section nav header footer aside figure form".split()
)
#: What may stand in <head>; anything else ends it.
HEAD = frozenset("head html base basefont bgsound link meta noframes noscript script style template title".split())
RAW = frozenset("script style title textarea iframe noscript".split())
BLOCK = frozenset(
    "html body article main section nav header footer aside div form fieldset p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th "
    "caption blockquote pre figure figcaption address details summary dialog center menu hgroup search".split()
)
OPEN_ENDED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPE = frozenset("article main section nav header footer aside div form ul ol dl table td th blockquote body html figure details dialog".split())

# Attribute tokens by what they tell; the trees weigh the counts.
GOOD = frozenset("article content post entry story main body text page blog news read prose maincontent articlebody entrycontent".split())
BAD = {
    "nav": frozenset("nav navigation navbar menu breadcrumb breadcrumbs pagination pager toolbar topbar skip toc".split()),
    "edge": frozenset("header footer masthead banner bottom top copyright legal colophon foot head site".split()),
    "side": frozenset("sidebar side aside rail widget related recommended recommendations more popular trending tags share social byline meta".split()),
    "ads": frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion dfp teaser".split()),
    "note": frozenset("cookie cookies consent notice notices gdpr alert popup modal overlay newsletter subscribe signup login paywall privacy".split()),
    "talk": frozenset("comment comments reply replies respond discussion disqus commentlist responses thread reviews".split()),
    "form": frozenset("form search searchbox input contact".split()),
}
KINDS = ("article main section nav header footer aside div form p h1 h2 ul ol li table td blockquote pre figure body".split())
NAMES = [f"is_{k}" for k in KINDS] + ["good"] + [f"bad_{k}" for k in BAD] + ["up_good"] + [f"up_{k}" for k in BAD]
NAMES += "length words links per_node stops depth nth nth_back siblings share parent_share rank heading paragraphs up_nav up_article bad up_bad main main_in".split()

#: As in browsers, a quote holds a value only right behind "="; elsewhere, or if it is never closed, the tag ends at the next ">".
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"'=]++|=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'<>][^\s<>]*+)|[=\"'])*+)>", re.S)
NAMED = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)", re.S)
ATTRIBUTE = re.compile(r"\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Page:
    """The block elements of a page, in page order (parents before children), and
    its pieces of text: (node, text)."""

    def __init__(self, source: str):
        self.tag, self.parent, self.tokens = ["html"], [-1], [frozenset()]
        self.pieces: list[tuple[int, str]] = []
        self.linked: list[int] = []
        stack: list[tuple[str, int]] = [("html", 0)]
        hidden = foreign = links = at = 0
        closed = None
        in_head = False
        while True:
            found = TAG.search(source, at)
            stop = found.start() if found else len(source)
            if in_head and not hidden and not source[at:stop].isspace() and stop > at:
                in_head = False
            if stop > at and not hidden and not in_head:
                self.piece(stack[-1][1], source[at:stop], links)
            if not found:
                break
            at = found.end()
            name = (found[2] or "").lower()
            if not name:
                continue
            if found[1]:
                if name in ("head", "body", "html"):
                    in_head = False
                if name in HIDDEN:
                    hidden = max(0, hidden - 1)
                    foreign *= hidden > 0
                elif name == "a":
                    links = 0
                elif name == "foreignobject":
                    foreign = int(hidden > 0)
                elif name in BLOCK:
                    if foreign:
                        hidden = foreign = 0
                    if not hidden:
                        self.close(stack, name)
                continue
            if name == "body" or name == "article" or (foreign and name in BREAKS):
                hidden = foreign = 0
            if not hidden and name not in HEAD:
                in_head = False
            if name == "head":
                in_head = len(self.tag) == 1 and not self.pieces
            elif name in HIDDEN:
                if name in RAW:  # no elements inside: skip to its end
                    end = re.compile(rf"</{name}\b[^>]*>", re.I).search(source, at)
                    at = end.end() if end else len(source)
                elif not found[0].endswith("/>") and (hidden or name == "svg" or found.start() in (closed := self.closed(source) if closed is None else closed)):
                    hidden += 1
                    foreign += name == "svg" and hidden == 1
            elif name == "foreignobject":
                foreign = 0  # elements of the page may stand in it
            elif name == "br":
                if not hidden:
                    self.piece(stack[-1][1], " ", 0)
            elif name == "a":
                links = 1
            elif name in BLOCK and name != "html" and not hidden:
                links = 0
                self.make_room(stack, name)
                node = len(self.tag)
                self.tag.append(name)
                self.parent.append(stack[-1][1])
                self.tokens.append(self.attributes(found[3]))
                stack.append((name, node))

    @staticmethod
    def closed(source: str) -> set[int]:
        """Where the elements without text of the page begin that have an end tag, ahead of
        the end of the block around them. One that has none holds nothing back."""
        found, stack, open_ = set(), [], Counter()
        at = 0
        while m := NAMED.search(source, at):
            at, name = m.end(), (m[2] or "").lower()
            if name in RAW and not m[1]:
                end = re.compile(rf"</{name}\b", re.I).search(source, at)
                at = end.end() if end else len(source)
            elif not m[1] and (name in HIDDEN or name in BLOCK):
                stack.append((name, m.start()))
                open_[name] += 1
            elif m[1] and open_[name]:
                while True:
                    top, start = stack.pop()
                    open_[top] -= 1
                    if top == name:
                        break
                if name in HIDDEN:
                    found.add(start)
        return found

    def piece(self, node: int, text: str, linked: int) -> None:
        self.pieces.append((node, text))
        self.linked.append(linked)

    @staticmethod
    def attributes(text: str) -> frozenset:
        if "=" not in text:
            return frozenset()
        return frozenset(p.lower() for m in ATTRIBUTE.finditer(text) for p in PART.findall(m[1] or m[2] or m[3] or ""))

    @staticmethod
    def make_room(stack: list[tuple[str, int]], name: str) -> None:
        """Closes what a new block ends: an open <p>, or a list item or cell."""
        if stack[-1][0] == "p" or (stack[-1][0][0] == "h" and stack[-1][0][1:].isdigit() and name[0] != "d"):
            stack.pop()
        ended = OPEN_ENDED.get(name)
        while ended and len(stack) > 1:
            if stack[-1][0] in ended:
                stack.pop()
                continue
            break

    @staticmethod
    def close(stack: list[tuple[str, int]], name: str) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] == name:
                del stack[k:]
                return
            if name in ("p", "li", "td", "th", "tr", "dt", "dd") and stack[k][0] in SCOPE:
                return


def page_features(page: Page) -> np.ndarray:
    """One row of NAMES for each node; subtree sums come from one pass from the
    last node to the first."""
    n = len(page.tag)
    own, words, linked, stops = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    for (node, text), link in zip(page.pieces, page.linked):
        size = len(text) - text.count(" ") - text.count("\n")
        own[node] += size
        words[node] += text.count(" ") + 1 if size else 0
        linked[node] += size * link
        stops[node] += text.count(". ") + text.count(", ") + text.endswith((".", "!", "?"))
    nodes, paragraphs, depth = np.ones(n), np.array([t == "p" for t in page.tag], float), np.zeros(n)
    sums = np.stack([own, words, linked, stops, nodes, paragraphs], axis=1)
    children: list[list[int]] = [[] for _ in range(n)]
    for k in range(n - 1, 0, -1):
        sums[page.parent[k]] += sums[k]
        children[page.parent[k]].append(k)
    x = np.zeros((n, len(NAMES)))
    place = {name: k for k, name in enumerate(NAMES)}
    total = max(1.0, sums[0, 0])
    good, bad = place["good"], place["bad_nav"]
    up = place["up_good"]
    for k in range(n):
        row, parent, tag, tokens = x[k], page.parent[k], page.tag[k], page.tokens[k]
        if f"is_{tag}" in place:
            row[place[f"is_{tag}"]] = 1
        if tokens:
            row[good] = len(tokens & GOOD)
            for j, some in enumerate(BAD.values()):
                row[bad + j] = len(tokens & some)
            row[place["bad"]] = row[bad : bad + len(BAD)].any()
        if parent >= 0:
            depth[k] = depth[parent] + 1
            row[up : up + 1 + len(BAD)] = np.maximum(x[parent, up : up + 1 + len(BAD)], x[parent, good : good + 1 + len(BAD)])
            outer = page.tag[parent]
            row[place["up_nav"]] = max(x[parent, place["up_nav"]], outer in ("nav", "header", "footer", "aside", "form"))
            row[place["up_bad"]] = max(x[parent, place["up_bad"]], x[parent, place["bad"]])
            row[place["up_article"]] = max(x[parent, place["up_article"]], outer in ("article", "main"))
        row[place["heading"]] = tag[0] == "h" and tag[1:].isdigit()
        for nth, child in enumerate(reversed(children[k])):
            x[child, place["nth"]], x[child, place["nth_back"]], x[child, place["siblings"]] = nth, len(children[k]) - 1 - nth, len(children[k])
            x[child, place["parent_share"]] = sums[child, 0] / max(1.0, sums[k, 0])
    x[:, place["length"]] = np.log1p(sums[:, 0])
    x[:, place["words"]] = np.log1p(sums[:, 1])
    x[:, place["links"]] = sums[:, 2] / np.maximum(1, sums[:, 0])
    x[:, place["per_node"]] = np.log1p(sums[:, 0] / sums[:, 4])
    x[:, place["stops"]] = sums[:, 3] / np.maximum(1, sums[:, 1])
    x[:, place["depth"]] = depth
    x[:, place["share"]] = sums[:, 0] / total
    x[:, place["rank"]] = np.arange(n) / n
    x[:, place["paragraphs"]] = np.log1p(sums[:, 5])
    # the block container with most text of its own paragraphs, and what is in it
    prose = np.zeros(n)
    for k in range(1, n):
        if page.tag[k] in ("p", "blockquote", "pre") and not x[k, place["up_bad"]]:
            prose[page.parent[k]] += sums[k, 0] - sums[k, 2]
    main = int(prose.argmax())
    x[main, place["main"]] = 1
    for k in range(main + 1, n):
        x[k, place["main_in"]] = page.parent[k] == main or x[page.parent[k], place["main_in"]]
    return x


def decode(page: Page, chance: np.ndarray) -> np.ndarray:
    """The most likely labelling in which every kept node has a kept parent."""
    chance = np.clip(chance, 1e-6, 1 - 1e-6)
    keep, drop = np.log(chance), np.log(1 - chance)
    for k in range(len(chance) - 1, 0, -1):  # children come after their parents
        keep[page.parent[k]] += max(keep[k], drop[k])
        drop[page.parent[k]] += drop[k]
    kept = np.zeros(len(chance), bool)
    kept[0] = True
    for k in range(1, len(chance)):
        kept[k] = kept[page.parent[k]] and keep[k] > drop[k]
    return kept


def page_text(page: Page, kept: np.ndarray) -> str:
    """Text of kept nodes: white space inside a block becomes one space, blocks
    are trimmed and joined by one space in page order."""
    blocks: list[list[str]] = []
    last = None
    for node, text in page.pieces:
        if node != last:
            blocks.append([])
            last = node
        if kept[node]:
            blocks[-1].append(text)
    joined = (" ".join(entities.unescape("".join(b)).split()) for b in blocks)
    return " ".join(b for b in joined if b)


class Trees:
    """A fitted ensemble as arrays, for scoring a matrix of nodes."""

    def __init__(self, trees: list[dict], weights: list[float]):
        self.trees, self.weights = trees, weights

    def chance(self, x: np.ndarray) -> np.ndarray:
        margin = np.zeros(len(x))
        for tree, weight in zip(self.trees, self.weights):
            at = np.zeros(len(x), np.int64)
            feature, cut, left, right = (np.array(tree[c]) for c in ("feature", "cut", "left", "right"))
            for _ in range(DEPTH + 1):
                inner = feature[at] >= 0
                goes = x[np.arange(len(x)), np.maximum(feature[at], 0)] <= cut[at]
                at = np.where(inner, np.where(goes, left[at], right[at]), at)
            margin += weight * np.array(tree["value"])[at]
        return 1 / (1 + np.exp(-2 * margin))


def unpacked(model) -> Trees:
    """Spark's boosted trees as Trees."""

    def flat(node) -> dict:
        out: dict[str, list] = {c: [] for c in ("feature", "cut", "left", "right", "value")}

        def add(node) -> int:
            k = len(out["value"])
            inner = node.getClass().getSimpleName() == "InternalNode"
            for c, v in zip(out, (node.split().featureIndex() if inner else -1, node.split().threshold() if inner else 0.0, 0, 0, node.prediction())):
                out[c].append(v)
            if inner:
                out["left"][k] = add(node.leftChild())
                out["right"][k] = add(node.rightChild())
            return k

        add(node)
        return out

    return Trees([flat(t._call_java("rootNode")) for t in model.trees], list(model.treeWeights))


def labelled_page(seed: int) -> str:
    """A made-up page for training; elements of the article carry data-main. Layouts
    vary in elements, names, order and nesting."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(("re", "on", "ti", "an", "er", "th", "ion", "es", "le", "ou")) for _ in range(r.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))

    def sentences(a: int, b: int) -> str:
        return " ".join(words(3, 16).capitalize() + r.choice("...!?") for _ in range(r.randint(a, b)))

    def attr(*names: str) -> str:
        return f' {r.choice(("class", "id"))}="{r.choice(names)}{r.choice(("", "", " " + word(), "-" + word()))}"'

    def link_list(a: int, b: int) -> str:
        items = [f'<a href="/{word()}">{words(1, 4)}</a>' for _ in range(r.randint(a, b))]
        return r.choice(("<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", " | ".join(items), "".join(f"<div>{x}</div>" for x in items)))

    def wrap(tags: tuple[str, ...], names: tuple[str, ...], inner: str, bare: float = 0.3) -> str:
        tag = r.choice(tags)
        return f"<{tag}{'' if tag != 'div' and r.random() < bare else attr(*names)}>{inner}</{tag}>"

    nav = lambda: wrap(("nav", "div", "ul"), ("nav", "menu", "navbar", "main-menu", "breadcrumb", "pagination"), link_list(3, 10))
    header = lambda: wrap(("header", "div"), ("header", "site-header", "masthead", "top-bar"), r.choice((f"<h1>{words(1, 3)}</h1>", f"<p>{words(2, 6)}</p>", words(1, 4))) + r.choice(("", nav())))
    footer = lambda: wrap(("footer", "div"), ("footer", "site-footer", "copyright", "page-bottom"), r.choice((f"&copy; {words(1, 4)} &middot; {sentences(1, 1)}", f"<p>{sentences(1, 3)}</p>" + link_list(2, 5), words(2, 8))))
    ad = lambda: wrap(("div", "aside", "section"), ("ad", "ads", "advert", "sponsored", "promo", "banner-ad"), r.choice((sentences(1, 3), f"<p>{sentences(1, 2)}</p>", f'<a href="/x">{words(3, 9)}</a>')), 0)
    side = lambda: wrap(("aside", "div", "section"), ("sidebar", "widget", "related", "recommended", "share", "popular"), f"<h3>{words(1, 3)}</h3>" + r.choice((link_list(3, 8), f"<p>{sentences(1, 3)}</p>", link_list(2, 4) + f"<p>{words(3, 9)}</p>")))
    notice = lambda: wrap(("div", "section", "aside"), ("cookie-notice", "consent", "notice", "newsletter", "subscribe-box", "popup", "alert"), r.choice((f"<p>{sentences(1, 3)}</p>", sentences(1, 2)) ) + r.choice(("", "<button>Ok</button>")), 0)
    form = lambda: wrap(("form", "div"), ("search-form", "contact-form", "login", "signup"), f"<form><label>{words(1, 3)}</label><input name=q><p>{words(2, 8)}</p></form>" if r.random() < 0.5 else f"<label>{words(1, 4)}</label><input><p>{sentences(1, 1)}</p>", 0.6)
    say = lambda: r.choice(("<li>{}</li>", '<div class="comment">{}</div>', "<div>{}</div>", '<article class="comment">{}</article>')).format(f"<b>{word()}</b> <p>{sentences(1, 5)}</p>")
    talk = lambda: wrap(("section", "div", "ol"), ("comments", "comment-list", "discussion", "responses", "replies"), f"<h3>{words(1, 2)}</h3>" + "".join(say() for _ in range(r.randint(1, 6))), 0)

    def block() -> str:
        m = " data-main"
        kind = r.random()
        if kind < 0.72:
            text = sentences(1, 9) if r.random() < 0.85 else words(1, 5)
            text = r.choice((text, f"<b>{text}<br>", text.replace(" ", f' <a href="/{word()}">{word()}</a> ', 1), text + " &amp;&amp; " + words(1, 4)))
            return f"<p{m}>{text}</p>" if r.random() < 0.9 else f"<div{m}>{text}</div>"
        if kind < 0.82:
            return f"<h2{m}>{words(2, 7)}</h2>"
        if kind < 0.9:
            return f"<ul{m}>" + "".join(f"<li{m}>{words(2, 14)}</li>" for _ in range(r.randint(1, 6))) + "</ul>"
        if kind < 0.95:
            return f"<blockquote{m}><p{m}>{sentences(1, 3)}</p></blockquote>"
        rows = "".join(f"<tr{m}>" + "".join(f"<td{m}>{words(1, 3)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(1, 4)))
        return f"<table{m}>{rows}</table>"

    blocks = [block() for _ in range(r.choice((1, 1, 2, 3, 5, 8, 12, 20, 30)))]
    if r.random() < 0.25:
        blocks.insert(r.randint(0, len(blocks)), r.choice((ad, side, notice))())
    title = f"<h1 data-main>{words(2, 9)}</h1>"
    body = (title if r.random() < 0.85 else "") + "".join(blocks)
    names = ("content", "post-content", "entry", "article-body", "story", "main-content", "post", "text")
    shape = r.random()
    if shape < 0.45:
        main = f"<article data-main{'' if r.random() < 0.6 else attr(*names)}>{body}</article>"
    elif shape < 0.85:
        main = f"<div data-main{attr(*names)}>{body}</div>"
    else:
        main = f"<div data-main>{body}</div>"
    if r.random() < 0.4:
        around = r.choice(("<main data-main>{}</main>", "<div data-main>{}</div>", '<div data-main id="wrapper">{}</div>', "<section data-main>{}</section>"))
        main = around.format(main + (talk() if r.random() < 0.4 else "") + (side() if r.random() < 0.3 else ""))
    before = [x() for x in (header, nav, notice, ad, form) if r.random() < 0.55]
    after = [x() for x in (talk, side, ad, footer, notice, form, nav) if r.random() < 0.5]
    r.shuffle(before)
    return f"<!DOCTYPE html><html><head><title>{words(2, 5)}</title></head><body data-main>{''.join(before)}{main}{''.join(after)}</body></html>"


def labelled_nodes(spark: SparkSession, pages: int = PAGES) -> DataFrame:
    """(x, label) for each node of ``pages`` labelled pages, made in tasks."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for seed in pdf["id"]:
                source = labelled_page(int(seed))
                page = Page(source)
                marks = [bool(m[3] and "data-main" in m[3]) for m in TAG.finditer(source) if not m[1] and (m[2] or "").lower() in BLOCK]
                label = [1.0, *map(float, marks[1:])]  # the first is <html>
                yield pd.DataFrame({"x": page_features(page).tolist(), "label": label})

    return spark.range(0, pages, 1, 4).mapInPandas(run, "x array<double>, label double")


def train(spark: SparkSession, nodes: DataFrame | None = None, seed: int = SEED) -> Trees:
    """Boosted trees on labelled nodes (by default those of PAGES made pages)."""
    rows = (nodes or labelled_nodes(spark)).select(array_to_vector("x").alias("features"), "label").cache()
    booster = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=seed, maxMemoryInMB=64, cacheNodeIds=False)
    found = unpacked(booster.fit(rows))
    rows.unpersist()
    return found


FOUND = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])


def extracted(pages: DataFrame, trees: Trees, column: str = "html") -> DataFrame:
    """pages' row (struct ``row``) with text and n_chars (its code points).

    A null or empty page, or one without an article, has an empty text. Pages of
    any length are read whole; broken markup is closed as browsers do. Repeated
    rows give repeated results, an empty table none.
    """
    shared = pages.sparkSession.sparkContext.broadcast((trees.trees, trees.weights))  # plain lists

    def make():
        model = Trees(*shared.value)

        def compute(sources):
            texts: list[str] = []
            for k in range(0, len(sources), 64):
                parsed = [Page((s or b"").decode("utf-8", "replace")) for s in sources[k : k + 64]]
                nodes = [page_features(p) for p in parsed]
                chance = np.split(model.chance(np.concatenate(nodes)), np.cumsum([len(x) for x in nodes])[:-1])
                texts += [page_text(p, decode(p, c)) for p, c in zip(parsed, chance)]
            return [texts, [len(t) for t in texts]]

        return compute

    return annotate(as_rows(pages), FOUND, make, column)


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    found = extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"), train(spark))
    return found.select("row.page_id", "row.url", "text", "n_chars")
