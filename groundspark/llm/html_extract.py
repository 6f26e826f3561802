"""Main text of web pages by a tree-structured graphical model over the DOM.

Every element that can carry meaning is a node with one of three states: A holds the article among
other things, C belongs to the article, B is boilerplate. Node potentials come from the words of class,
id and role, and the shape of the text; parent-child potentials from how often an element of the child's
tag has a state below each state of its parent (a heading in the article is article, whatever headings of
menus are). Both are counted on labelled pages (train). An inline element is a node only if a class names
it, has no potential but that of names known from training, and follows its parent else. Sum-product
messages pass up and down the tree, and the text of nodes whose marginal of C is the largest is kept (where
there is none, of nodes that neither their own markup nor that above them makes boilerplate).

Text: character references decoded, white space inside a block made one space and trimmed, blocks
in page order joined by an empty line. Null and blank pages give an empty text. Extra columns pass
through; a column with the name of the output is replaced. Attributes of pages (data-gold too) are
never labels: only train() reads those.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, short_batches


#: Fixed values of HTML: elements without content, with raw text, inline elements, and elements whose start ends others.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title select svg math object noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("html body table td th ul ol dl article section div main aside nav footer header form".split())

#: Words of class names that tell of layout, not of content.
LAYOUT = frozenset("active area block body bottom box col cols column columns container first full grid inner item items large last layout left line list new old outer page right row section small text top unit wide wrap wrapper".split())
#: A quote opens a value behind an equals sign only; elsewhere it is a character of a name or of a bare value.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*+(?:\"[^\"]*\"|'[^']*')|[^>])*+)(?:>|\Z)|<|[^<]+", re.S)
GOLD = re.compile(r"(?<!\S)data-gold=([012])(?=[\s/]|\Z)")
FOREIGN = frozenset(("svg", "math"))  # raw elements that a slash may close at once
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
NAME = re.compile(r"[a-z]+|[A-Z][a-z]*")

STATES = (0, 1, 2)  # A, C, B
LABELLED = 20_000  # labelled pages that a model is trained on at most
FOLLOWS = 0.96  # share of inline elements that are what their parent is
BACKED = 4.0  # elements of any tag that count beside those of a child's own kind
SHAPE_WEIGHT = 0.3  # of features of the text beside those of the markup: texts below one parent are alike


class Node:
    __slots__ = ("tag", "names", "parent", "kids", "flow", "chars", "linked", "gold")

    def __init__(self, tag: str, names: list[str], parent: Node | None):
        self.tag, self.names, self.parent = tag, names, parent
        self.kids: list[Node] = []
        self.flow: list = []  # texts, nodes and breaks in page order
        self.chars = self.linked = 0
        self.gold = 0


def after_raw(page: str, at: int, tag: str, closed: bool) -> int:
    """Where a raw element ends whose start tag ends at at. Browsers ignore the slash of <script/>: it has content if its end tag comes before another start tag."""
    if closed and tag in FOREIGN:
        return at
    end = re.compile(rf"<(/?){re.escape(tag)}(?![^\s/>])[^>]*(?:>|\Z)", re.I)
    if closed:
        m = end.search(page, at)
        return m.end() if m and m.group(1) else at
    while m := end.search(page, at):
        if m.group(1):
            return m.end()
        at = m.end()
    return len(page)


def parse(page: str, marked: bool = False) -> Node:
    """The element tree. Plain inline elements aren't nodes; scripts, styles and the head leave nothing.

    marked: the page is a labelled one, whose elements hold their state in data-gold; of other pages that is an attribute like any.
    """
    root = Node("html", [], None)
    stack: list[tuple[str, Node]] = [("html", root)]
    open_: Counter = Counter()  # tags on the stack, so that end tags without a start aren't searched for
    at, n = 0, len(page)

    def cut(k: int) -> None:
        open_.subtract(t for t, _ in stack[k:])
        del stack[k:]

    while at < n:
        m = TOKEN.match(page, at)
        at = m.end()
        tag = m.group(2)
        node = stack[-1][1]
        if tag is None:
            text = m.group()
            if text[0] != "<" or text == "<":
                text = html.unescape(text) if "&" in text else text
                node.flow.append(text)
                size = len(text.strip())
                node.chars += size
                if open_["a"]:
                    node.linked += size
            continue
        tag = tag.lower()
        if m.group(1):
            for k in range(len(stack) - 1, 0, -1) if open_[tag] else ():
                if stack[k][0] == tag:
                    cut(k)
                    if tag not in INLINE:
                        node.flow.append(None)
                    break
                if stack[k][0] in SCOPE and tag not in SCOPE:
                    break
            continue
        if tag in RAW:
            at = after_raw(page, at, tag, m.group(3).rstrip().endswith("/"))
            continue
        if tag in ("html", "head", "body") and tag != "body":
            continue
        if tag in ENDS_P and open_["p"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    cut(k)
                    break
                if stack[k][0] in SCOPE:
                    break
        if tag in SIBLINGS and any(open_[t] for t in SIBLINGS[tag]):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in SIBLINGS[tag]:
                    cut(k)
                    break
                if stack[k][0] in ("ul", "ol", "dl", "table", "select"):
                    break
        node = stack[-1][1]
        if tag in VOID:
            node.flow.append(" " if tag in ("br", "wbr", "img") else None)
            continue
        names = [x.lower() for a in ATTRIBUTE.finditer(m.group(3)) for x in NAME.findall(a.group(2) or a.group(3) or a.group(4) or "") if x.lower() not in LAYOUT] if m.group(3) else []
        if tag in INLINE and not names:
            stack.append((tag, node))
            open_[tag] += 1
            continue
        child = Node(tag, names, node)
        if marked and (gold := GOLD.search(m.group(3))):
            child.gold = int(gold.group(1))
        node.kids.append(child)
        node.flow.append(child)
        if not m.group(3).rstrip().endswith("/") or tag not in ("path", "use"):
            stack.append((tag, child))
            open_[tag] += 1
    return root


def order(root: Node) -> list[Node]:
    """Parents before their children."""
    nodes = [root]
    for x in nodes:
        nodes.extend(x.kids)
    return nodes


def features(node: Node) -> tuple[list[str], list[str]]:
    """Features of names and of the text; an inline element's text has no say."""
    names = [f"c:{x}" for x in dict.fromkeys(node.names)]
    if node.tag in INLINE:
        return names, []
    n, share = node.chars, node.linked / node.chars if node.chars else 0
    size = "0" if n == 0 else "1" if n < 25 else "2" if n < 100 else "3"
    link = "0" if share < 0.2 else "1" if share < 0.6 else "2"
    return names, [f"s:{size}{link}"]


def kind(node: Node) -> str:
    """Of edges: the tag, with a full stop if a class names the element. Only such ones and those of a few tags are strange to their parents."""
    return node.tag + "." * bool(node.names)


def counted(pages: Iterable[str]) -> Counter:
    """(kind, name, state) -> number over the elements of labelled pages: kind t for all, f for a feature, e for an edge (its name: parent's state and kind)."""
    seen: Counter = Counter()
    for page in pages:
        for x in order(parse(page, True)):
            seen["t", "", x.gold] += 1
            for f in sum(features(x), [f"t:{x.tag}"]):
                seen["f", f, x.gold] += 1
            if x.parent and x.tag not in INLINE:
                seen["e", f"{x.parent.gold} {kind(x)}", x.gold] += 1
    return seen


class Model:
    """Counts of labelled pages as node and edge potentials."""

    def __init__(self, counts: Counter, alpha: float = 0.02):
        total = [counts["t", "", s] for s in STATES]
        kinds = {name[2:] for k, name, _ in counts if k == "e"}
        share = lambda rows: [[e / sum(row) for e in row] for row in rows]
        self.inline = [[FOLLOWS if s == up else (1 - FOLLOWS) / 2 for s in STATES] for up in STATES]
        self.rest = {end: share([[sum(counts["e", f"{up} {k}", s] for k in kinds if k.endswith(".") == bool(end)) + alpha for s in STATES] for up in STATES]) for end in ("", ".")}
        self.edges = {k: share([[counts["e", f"{up} {k}", s] + BACKED * self.rest["." * k.endswith(".")][up][s] for s in STATES] for up in STATES]) for k in kinds}
        self.node = {}
        for f in {name for kind, name, _ in counts if kind == "f"}:
            c = [counts["f", f, s] for s in STATES]
            self.node[f] = [(c[s] + alpha) / (total[s] + 3 * alpha) / ((sum(c) + 3 * alpha) / (sum(total) + 9 * alpha)) for s in STATES]

    def edge(self, node: Node) -> list[list[float]]:
        """Shares of the node's states below each state of its parent."""
        if node.tag in INLINE:
            return self.inline
        end = "." * any(f"c:{x}" in self.node for x in node.names)  # names that training hasn't seen name nothing
        return self.edges.get(node.tag + end) or self.rest[end]

    def potential(self, node: Node, tag: bool = False) -> list[float]:
        """Of names and text; with tag, of the tag too, as where no state of a parent is at hand."""
        names, shape = features(node)
        out = [1.0, 1.0, 1.0]
        for fs, w in ((names + [f"t:{node.tag}"] * tag, 1.0), (shape, SHAPE_WEIGHT)):
            for f in fs:
                if p := self.node.get(f):
                    out = [o * q if w == 1.0 else o * q**w for o, q in zip(out, p, strict=True)]
        return out

    def marginals(self, nodes: list[Node]) -> list[list[float]]:
        """Sum-product: messages from the leaves to the root, then back."""
        place = {id(x): i for i, x in enumerate(nodes)}
        up = [self.potential(x) for x in nodes]  # potential times the messages of all children
        message: list[list[float]] = [[1.0] * 3] * len(nodes)
        for i in range(len(nodes) - 1, 0, -1):
            b, e = up[i], self.edge(nodes[i])
            m = [e[s][0] * b[0] + e[s][1] * b[1] + e[s][2] * b[2] for s in STATES]
            z = m[0] + m[1] + m[2] or 1.0
            message[i] = m = [m[0] / z, m[1] / z, m[2] / z]
            k = place[id(nodes[i].parent)]
            p = up[k]
            p = [p[0] * m[0], p[1] * m[1], p[2] * m[2]]
            z = p[0] + p[1] + p[2] or 1.0
            up[k] = [p[0] / z, p[1] / z, p[2] / z]
        z = sum(up[0]) or 1.0
        out = [[x / z for x in up[0]]]
        for i in range(1, len(nodes)):
            belief, m, e, b = out[place[id(nodes[i].parent)]], message[i], self.edge(nodes[i]), up[i]
            rest = [belief[s] / m[s] if m[s] else 0.0 for s in STATES]
            d = [(rest[0] * e[0][s] + rest[1] * e[1][s] + rest[2] * e[2][s]) * b[s] for s in STATES]
            z = d[0] + d[1] + d[2] or 1.0
            out.append([d[0] / z, d[1] / z, d[2] / z])
        return out


def blocks(root: Node, kept: dict[int, bool]) -> list[str]:
    """Texts of kept nodes, cut where block elements start and end."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if text := " ".join("".join(run).split()):
            out.append(text)
        run.clear()

    stack: list[tuple[Node, int]] = [(root, 0)]
    while stack:
        node, i = stack.pop()
        if i == 0 and node.tag not in INLINE:
            flush()
        keep = kept[id(node)]
        while i < len(node.flow):
            x = node.flow[i]
            i += 1
            if isinstance(x, Node):
                stack.append((node, i))
                stack.append((x, 0))
                break
            if x is None:
                flush()
            elif keep:
                run.append(x)
        else:
            if node.tag not in INLINE:
                flush()
    flush()
    return out


def extract_text(page: str | None, model: Model) -> str:
    """Main text of one page."""
    if not page or page.isspace():
        return ""
    root = parse(page)
    nodes = order(root)
    best = model.marginals(nodes)
    found = blocks(root, {id(x): p[1] > p[0] and p[1] > p[2] for x, p in zip(nodes, best, strict=True)})
    if not found:  # a page without any markup of its own: all that isn't boilerplate by its own markup or that above it
        plain: dict[int, bool] = {}
        for x in nodes:
            own = model.potential(x, True)
            plain[id(x)] = plain.get(id(x.parent), True) and max(own[0], own[1]) > own[2]
        found = blocks(root, plain)
    return "\n\n".join(found)


#: Labelled fragments. Wrappers are elements round the article; names are those that sites give to what isn't article.
WRAPPERS = ["article", "main", "div class=content", "div id=content", "div class=post", "div class='entry-content'", "section class='article-body'", "div class=story", "div id=main", "div class='post-content'", "article class=post", "article class='article hentry'", "div class=article", "div class=text"]
BARE_WRAPPERS = ["div", "div class=container", "div class=wrapper", "div id=page", "div class=row", "section", "main", "div class='main-column'"]
MENUS = ["nav", "nav class=navbar", "div class=menu", "div id=nav", "ul class=menu", "div class=breadcrumbs", "ol class=breadcrumb", "div class=pagination", "nav role=navigation", "div class='site-navigation'", "div class=toc", "div class='skip-links'"]
HEADS = ["header", "header class='site-header'", "div id=header", "div class=header", "div class=masthead", "div role=banner", "div class=topbar", "div class=logo"]
FEET = ["footer", "div id=footer", "div class=footer", "footer class='site-footer'", "div role=contentinfo", "div class=copyright", "div class=legal", "div class=credits"]
SIDES = ["aside", "div class=sidebar", "div id=sidebar", "div class=widget", "div class=related", "section class='related-posts'", "div class=recommended", "div role=complementary", "div class=trending", "div class='popular-posts'", "div class='author-bio'", "div class=tags"]
ADVERTS = ["div class=ad", "div class=ads", "div class=advert", "div class=advertisement", "div id='ad-top'", "div class=banner", "div class=sponsored", "div class=promo", "ins class=adsbygoogle", "div class='ad-container'", "aside class=ad", "p class=ad"]
NOTICES = ["div class=notice", "div class='cookie-banner'", "div id='cookie-consent'", "div class=alert", "div role=alert", "div class=popup", "div class=modal", "div class=gdpr", "div class=disclaimer", "div class=paywall", "dialog", "p class=notice", "div class=cookies", "div class=consent", "div role=dialog", "div class=overlay"]
FORMS = ["form", "form class=search", "div class=newsletter", "div class=signup", "form id=login", "div class=subscribe", "div class='search-form'", "div class=share", "div class=social", "fieldset", "button", "div class=login"]
COMMENTS = ["section class=comments", "div id=comments", "div class='comment-list'", "ol class=commentlist", "div id=disqus", "div class=comment", "section id='reader-comments'", "div class=discussion", "div class=responses", "li class=comment", "div class=replies", "article class=comment", "div class=reviews"]
INSIDE = ["h1", "h2", "h3", "h4", "p", "p", "p", "p", "p", "p", "blockquote", "pre", "figure", "figcaption", "ul", "ol", "table", "p class=lead", "h1 class=title", "h2 class=subtitle", "div class=paragraph", "section", "dl"]


def labelled_pages(n: int = 600, seed: int = 7) -> list[str]:
    """Pages put together from the labelled fragments; data-gold holds the state of each element."""
    r = random.Random(seed)
    words = lambda k: " ".join("".join(r.choice("aeioustrnl") for _ in range(r.randint(2, 8))) for _ in range(k)) + "."

    def element(spec: str, inner: str, gold: int) -> str:
        return f"<{spec} data-gold={gold}>{inner}</{spec.split()[0]}>"

    def lines(gold: int, long: float, linked: float) -> str:
        out = []
        for _ in range(r.randint(1, 6)):
            text = words(r.randint(15, 60) if r.random() < long else r.randint(1, 5))
            text = f"<a href=x>{text}</a>" if r.random() < linked else text
            out.append(text if r.random() < 0.3 else element(r.choice(["p", "p", "li", "span", "div", "div", "h1", "h2", "h3", "h4"]), text, gold))
        return "".join(out)

    def boilerplate(kinds: list[str], long: float, linked: float) -> str:
        inner = lines(2, long, linked)
        if r.random() < 0.3:
            inner = element(r.choice(["div", "ul", "div class=inner", "section"]), inner, 2)
        return element(r.choice(kinds), inner, 2)

    def article() -> str:
        parts = [element("h1", words(r.randint(2, 9)), 1)] if r.random() < 0.9 else []
        if parts and r.random() < 0.15:
            parts = [element("header", parts[0] + element("p", words(r.randint(3, 20)), 1), 1)]
        for _ in range(r.randint(1, 9)):
            spec = r.choice(INSIDE)
            if spec.split()[0] in ("ul", "ol"):
                inner = "".join(element("li", words(r.randint(3, 30)), 1) for _ in range(3))
            elif spec == "table":
                inner = element("tr", "".join(element("td", words(3), 1) for _ in range(3)), 1)
            elif spec in ("section", "figure", "blockquote"):
                inner = element("figcaption" if spec == "figure" else "p", words(r.randint(5, 40)), 1)
            else:
                inner = words(r.randint(1, 80)) if spec[0] != "h" else words(r.randint(1, 8))
                inner = f"{inner} <a href=y>{words(2)}</a>" if r.random() < 0.2 else inner
            parts.append(element(spec, inner, 1))
            if r.random() < 0.12:
                parts.append(boilerplate(r.choice([ADVERTS, SIDES, FORMS, NOTICES, MENUS]), 0.3, 0.4))
        if r.random() < 0.2:
            parts.append(boilerplate(COMMENTS, 0.7, 0.1))
        if r.random() < 0.1:
            parts.append(boilerplate(FEET, 0.2, 0.4))
        body = "".join(parts)
        return element(r.choice(WRAPPERS), body, 1) if r.random() < 0.8 else body

    pages = []
    for _ in range(n):
        core = article()
        if r.random() < 0.3:
            core += boilerplate(SIDES, 0.3, 0.7)
        while r.random() < 0.4:
            core = element(r.choice(BARE_WRAPPERS), core, 0)
        before = "".join(boilerplate(k, long, linked) for k, long, linked, p in ((NOTICES, 0.5, 0.1, 0.3), (HEADS, 0.2, 0.5, 0.5), (MENUS, 0, 0.9, 0.8), (ADVERTS, 0.4, 0.3, 0.5), (FORMS, 0.1, 0.2, 0.2)) if r.random() < p)
        after = "".join(boilerplate(k, long, linked) for k, long, linked, p in ((COMMENTS, 0.7, 0.1, 0.4), (SIDES, 0.3, 0.6, 0.4), (ADVERTS, 0.4, 0.3, 0.2), (FORMS, 0.1, 0.2, 0.3), (FEET, 0.3, 0.4, 0.8)) if r.random() < p)
        pages.append(f"<html><body data-gold=0>{before}{core}{after}</body></html>")
    return pages


def train(labelled: DataFrame, column: str = "html", most: int = LABELLED) -> Model:
    """A model from labelled pages: HTML whose elements hold their state in data-gold (0 holds the article, 1 article, 2 boilerplate).

    Of more than most pages the first by hash are taken. Pages are counted where they lie; only sums come to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = counted(x for x in batch.column(0).to_pylist() if x)
            cols = list(zip(*seen, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32()), pa.array(list(seen.values()), pa.int64())], ["kind", "name", "state", "n"])

    sample = labelled.select(F.col(column).alias("html")).orderBy(F.xxhash64("html"), "html").limit(most)
    sums = sample.mapInArrow(run, "kind string, name string, state int, n long").groupBy("kind", "name", "state").agg(F.sum("n").alias("n"))
    return Model(Counter({(r.kind, r.name, r.state): r.n for r in sums.collect()}))


def extract(pages: DataFrame, column: str = "html", out: str = "text", model: Model | None = None, drop: tuple[str, ...] = ("html",)) -> DataFrame:
    """pages with the main text of a column of HTML. model: from train(); by default from the labelled fragments below."""
    model = model or Model(counted(labelled_pages()))
    keep = [c for c in pages.columns if c != out and c not in drop]
    schema = T.StructType([pages.schema[c] for c in keep] + [T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array((extract_text(x.as_py(), model) for x in batch.column(len(keep))), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], texts], [*keep, out])

    short_batches(pages.sparkSession)
    return pages.select(*keep, F.col(column).alias(free_name(pages, "__html"))).mapInArrow(run, schema)


def digests(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""
    return extract(pages.select("page_id", "url", "html")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
