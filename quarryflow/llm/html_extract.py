"""HTML extraction by wrappers that same-host pages have in common.

A wrapper is a union-free regular expression over token streams: fixed tags and
texts, text slots where pages differ, optional groups (?) and repeated groups
(+). It is inferred by aligning all pages of one kind (host and outer structure)
in tasks, then the tasks' wrappers: equal tokens stay, differing texts
become slots, neighbours of one shape fold into a repeated group, and what one
page lacks becomes optional. The wrapper tells which element holds the slots of
the article. Where no element does, the texts that every page of the kind has at
one path go.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cache, reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, store

#: Distinct pages of one kind that make a text on all of them fixed.
PAGES = 3
#: Children of a wrapper's element before those of one tag become one.
WIDE = 200
#: The share of the words around it that an inner element must hold to be the main one.
MOST = 0.65
#: Wrappers of one kind that a task joins, on average at most.
PARTS = 64
#: Wrappers that a task holds before it writes them out.
MOST_HELD = 2000
COLUMNS = ["page_id", "url", "host", "kind", "paths", "marks", "texts", "learned"]

# a quote opens a value only after an equals sign
_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|[^>])*+)>|<[^>]*+>")
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_RAW = {"script", "style", "textarea", "noscript", "template", "svg", "iframe", "title"}
_VOID = {"br", "img", "hr", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "math", "mi", "mo", "mn", "mrow", "ms", "mtext", "mspace", "msup", "msub", "msubsup", "mfrac", "msqrt", "mroot", "mover", "munder", "munderover", "mfenced", "mtable", "mtr", "mtd", "mstyle", "semantics"}
_CLOSES_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
_APART = {"nav", "footer", "aside", "form", "head", "button", "select", "menu", "dialog"}
_APART_WORDS = set(
    "nav navbar navigation menu sidebar footer masthead banner ad ads advert adverts advertisement advertising sponsor sponsored promo "
    "cookie cookies consent notice notices alert comment comments reply replies disqus share sharing social related recommended "
    "newsletter subscribe subscription signup login popup modal breadcrumb breadcrumbs pagination pager widget toolbar "
    "copyright disclaimer contentinfo complementary search dialog".split()
)
#: Words that say nothing beside one of those: "site-footer" is a footer, "share-price" is no share box.
_NEUTRAL = set(
    "site page main global top bottom left right inner outer box bar block section list item items container wrapper wrap area group module "
    "panel content body links link button buttons icon icons text title row col column primary secondary first last mobile desktop fixed sticky "
    "small large wide post article entry story blog field label message count unit slot region holder form header js".split()
)
#: Words by which an inline element names itself an advert.
_ADVERT = set("ad ads advert adverts advertisement advertising sponsor sponsored promo".split())
_MAIN = ("article", "main")
#: Elements below this depth count as siblings there, in page order.
DEEP = 100


@dataclass
class Node:
    """An element, or a text (label "#") whose text is None once pages differ.

    A label is the tag and the words of class, id and role; it ends in "!" if
    these name a menu, footer or the like, in "^" if they name a header.
    """

    label: str
    children: list[Node] = field(default_factory=list)
    text: str | None = None
    mark: str = ""  # "?" optional, "+" repeated, "*" both
    words: int = 0  # of a text, all pages and repeats together

    @property
    def name(self) -> str:
        return self.label.split(".", 1)[0].rstrip("!^")


def parse(page: str) -> Node:
    """The element tree; unclosed and misnested tags are tolerated."""
    root = Node("")
    stack, at = [root], 0
    is_open: Counter[str] = Counter()
    deepest: tuple[Node, Node] | None = None  # an element below DEEP and the node that stands for it

    def add_text(s: str) -> None:
        nonlocal deepest
        top = stack[-1]
        if len(stack) > DEEP and s.strip():
            if not deepest or deepest[0] is not top or stack[DEEP - 1].children[-1] is not deepest[1]:
                deepest = (top, Node(top.label))
                stack[DEEP - 1].children.append(deepest[1])
            top = deepest[1]
        if s.strip():
            if top.children and top.children[-1].label == "#":
                top.children[-1].text += s
            else:
                top.children.append(Node("#", text=s))
        elif s and top.children and top.children[-1].label == "#":
            top.children[-1].text += " "

    def close(depth: int) -> None:
        for n in stack[depth:]:
            is_open[n.name] -= 1
        del stack[depth:]

    while True:
        lt = page.find("<", at)
        if lt < 0:
            add_text(html.unescape(page[at:]))
            return root
        if lt > at:
            add_text(html.unescape(page[at:lt]))
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = len(page) if end < 0 else end + 3
            continue
        m = _TAG.match(page, lt)
        if not m or not (m[2] or page[lt + 1 : lt + 2] in "!?/"):
            add_text("<")
            at = lt + 1
            continue
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name in _INLINE:
            if name == "br":
                add_text(" ")
            elif not m[1] and m[3] and _is_advert(m[3]):
                at = _past(page, name, at)
            continue
        if m[1]:
            if is_open[name]:
                depth = len(stack) - 1
                while stack[depth].name != name:
                    depth -= 1
                close(depth)
            continue
        if name in _RAW:
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at) if not m[3].endswith("/") else None
            at = end.end() if end else (at if m[3].endswith("/") else len(page))
            continue
        top = stack[-1].name
        if name in _CLOSES_P and top == "p" or name in ("li", "tr", "td", "th", "dt", "dd", "option") and top == name:
            close(len(stack) - 1)
        node = Node(_label(name, m[3]))
        if len(stack) < DEEP:
            stack[-1].children.append(node)
        elif len(stack) > DEEP and apart(stack[-1].label, False):
            node.label = f"{name}!"
        if name not in _VOID and not m[3].endswith("/"):
            stack.append(node)
            is_open[name] += 1


def _past(page: str, name: str, at: int) -> int:
    """The end of an element whose start tag ends at `at`; `at` if it is never closed."""
    depth = 1
    for m in re.compile(rf"<(/?){name}\b[^>]*>", re.I).finditer(page, at):
        depth += -1 if m[1] else 0 if m[0].endswith("/>") else 1
        if not depth:
            return m.end()
    return at


def _tokens(attributes: str) -> Iterator[list[str]]:
    """The words of each token of class, id and role."""
    for m in _ATTR.finditer(attributes):
        for token in html.unescape(m[2] or m[3] or m[4] or "").split():
            yield re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", token).lower())


def _is_advert(attributes: str) -> bool:
    return any(any(w in _ADVERT for w in parts) and all(w in _ADVERT or w in _NEUTRAL for w in parts) for parts in _tokens(attributes))


@cache
def _segments(word: str) -> tuple[str, ...]:
    """A word written as one of several known ones, "commentlist", as these; others as they are. "ad" alone is too short to be told inside a word."""
    if word in _APART_WORDS or word in _NEUTRAL:
        return (word,)
    for i in range(3, len(word) - 1):
        if word[:i] in _APART_WORDS or word[:i] in _NEUTRAL:
            rest = _segments(word[i:])
            if all(w in _APART_WORDS or w in _NEUTRAL for w in rest):
                return (word[:i], *rest)
    return (word,)


def _label(name: str, attributes: str) -> str:
    if not attributes:
        return name
    words: dict[str, None] = {}
    aside = header = False
    for parts in _tokens(attributes):
        words.update(dict.fromkeys(parts))
        known = [w for p in parts for w in _segments(p)]
        if all(w in _APART_WORDS or w in _NEUTRAL for w in known):
            aside |= any(w in _APART_WORDS for w in known)
            header |= "header" in known
    plain = name in ("html", "body", *_MAIN)
    return ".".join([name, *words]) + ("" if plain else "!" if aside else "^" if header else "")


def apart(label: str, in_main: bool) -> bool:
    """Whether an element is a menu, footer, advert or the like by its own name."""
    name = label.split(".", 1)[0].rstrip("!^")
    return label.endswith("!") or name in _APART or not in_main and (name == "header" or label.endswith("^"))


def fold(node: Node) -> Node:
    """Neighbouring children of one shape become a repeated group."""
    out: list[Node] = []
    for child in map(fold, node.children):
        if out and child.label != "#" and out[-1].label == child.label:
            out[-1] = align(out[-1], child)
            out[-1].mark = "*" if "?" in out[-1].mark or "*" in out[-1].mark else "+"
        else:
            out.append(child)
    return Node(node.label, narrow(out), node.text, node.mark, node.words)


def narrow(children: list[Node]) -> list[Node]:
    """At most WIDE children, as generated classes or long alternations make more: those of one tag become one."""
    if len(children) <= WIDE:
        return children
    by: dict[str, Node] = {}
    for c in children:
        name = c.name
        c = Node(name, c.children, c.text, "*", c.words)
        by[name] = align(by[name], c) if name in by else c
    return list(by.values())


def align(a: Node, b: Node) -> Node:
    """The least general wrapper of two wrappers with one label."""
    if a.label == "#":
        return Node("#", text=a.text if a.text == b.text else None, mark=_joined(a.mark, b.mark), words=a.words + b.words)
    x, y = a.children, b.children
    same = 0  # equal ends belong to every longest common subsequence
    while same < min(len(x), len(y)) and x[same].label == y[same].label:
        same += 1
    ends = 0
    while ends < min(len(x), len(y)) - same and x[-1 - ends].label == y[-1 - ends].label:
        ends += 1
    out = [align(c, d) for c, d in zip(x[:same], y[:same], strict=True)]
    out += _between(x[same : len(x) - ends], y[same : len(y) - ends])
    out += [align(c, d) for c, d in zip(x[len(x) - ends :], y[len(y) - ends :], strict=True)]
    return Node(a.label, narrow(out), mark=_joined(a.mark, b.mark))


def _between(x: list[Node], y: list[Node]) -> list[Node]:
    """Aligned by a longest common subsequence of labels, the rest optional. Lists have WIDE nodes at most."""
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i].label == y[j].label else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    out = []
    while i < len(x) or j < len(y):
        if i < len(x) and j < len(y) and x[i].label == y[j].label:
            out.append(align(x[i], y[j]))
            i, j = i + 1, j + 1
        elif j == len(y) or i < len(x) and best[i + 1][j] >= best[i][j + 1]:
            out.append(_optional(x[i]))
            i += 1
        else:
            out.append(_optional(y[j]))
            j += 1
    return out


def _optional(n: Node) -> Node:
    return Node(n.label, n.children, n.text, {"": "?", "+": "*"}.get(n.mark, n.mark), n.words)


def _joined(a: str, b: str) -> str:
    marks = {a, b}
    if "*" in marks or marks == {"?", "+"}:
        return "*"
    return "+" if "+" in marks else "?" if "?" in marks else ""


def infer(pages: list[str]) -> Node:
    """The wrapper of some pages of one host."""
    trees = [fold(parse(p)) for p in pages]
    wrapper = trees[0]
    for t in trees[1:]:
        wrapper = align(wrapper, t)
    return wrapper


def expression(node: Node) -> str:
    """The wrapper written out: #PCDATA slots, (...)+ and (...)? groups."""
    inner = "#PCDATA" if node.label == "#" and node.text is None else node.text if node.label == "#" else "".join(map(expression, node.children))
    body = inner if node.label in ("#", "") else f"<{node.label}>{inner}</{node.name}>"
    return f"({body}){node.mark}" if node.mark else body


def rules(wrapper: Node, common: Iterable[str] = ()) -> dict:
    """What extraction needs of a wrapper: the paths of its main elements, and the texts that never change.

    The main element is the innermost that still holds most words of the text
    slots (and repeated texts) around it, outside menus and the like. That an
    element is an article or main is a hint that doubles its words; all articles
    go with one that wins.
    """
    within: dict[tuple[str, ...], int] = {}
    own: dict[tuple[str, ...], int] = {}
    named: dict[str, int] = {}
    fixed = set(common)

    def visit(n: Node, path: tuple[str, ...], repeated: bool, main: str) -> int:
        total = 0
        for c in n.children:
            again = repeated or c.mark in ("+", "*")
            if c.label == "#":
                if c.text is None or (again and _mark(path, c.text) not in fixed):
                    if main:
                        named[main] = named.get(main, 0) + c.words
                    else:
                        own[path] = own.get(path, 0) + c.words
                        total += c.words
            elif not apart(c.label, bool(main)):
                here = (*path, c.label)
                total += visit(c, here, again, main or ("/".join(here) if c.name in _MAIN else ""))
        if not main:
            within[path] = within.get(path, 0) + total
        return total

    visit(wrapper, (), False, "")
    best: tuple[str, ...] = ()
    while True:
        # an element that is little but text is a block of the article, not the article
        inner = [p for p in within if len(p) == len(best) + 1 and p[: len(best)] == best and own.get(p, 0) * 2 < within[p]]
        most = max(inner, key=lambda p: (within[p], p), default=None)
        if most is None or within[most] < MOST * within[best]:
            break
        best = most
    articles = 2 * max(named.values(), default=0) >= max(1, within[best])
    return {"main": sorted(named) if articles else ["/".join(best)], "fixed": sorted(fixed)}


def _mark(path: tuple[str, ...], digest: str) -> str:
    return _digest("/".join(path) + "\t" + digest)


def _digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def digested(node: Node) -> Node:
    """The tree with each text replaced by a hash of its words, so that wrappers stay small; blank texts go."""
    children = [digested(c) for c in node.children if c.label != "#" or c.text.split()]
    words = node.text.split() if node.text else []
    return Node(node.label, children, _digest(" ".join(words)) if node.text else node.text, node.mark, len(words))


def kind(tree: Node) -> str:
    """A page's kind: the paths of its outer three levels without menus and the like."""
    found: set[str] = set()

    def visit(n: Node, path: str, depth: int) -> None:
        for c in n.children:
            if c.label != "#" and not apart(c.label, False):
                found.add(f"{path}/{c.label}")
                if depth < 3 and c.name not in _MAIN:
                    visit(c, f"{path}/{c.label}", depth + 1)

    visit(tree, "", 1)
    return _digest(" ".join(sorted(found)))


def places(tree: Node) -> set[str]:
    """Each text of a digested page with its path, outside menus and the like."""
    found: set[str] = set()

    def visit(n: Node, path: tuple[str, ...], main: bool) -> None:
        for c in n.children:
            if c.label == "#":
                found.add(_mark(path, c.text))
            elif not apart(c.label, main):
                visit(c, (*path, c.label), main or c.name in _MAIN)

    visit(tree, (), False)
    return found


@dataclass
class Learned:
    """What some pages of one kind have in common.

    seen: the least hashes of distinct pages, as many as make texts fixed;
    common: the texts that every page has at one path.
    """

    wrapper: Node
    common: set[str]
    seen: list[str]

    def joined(self, other: Learned) -> Learned:
        seen = sorted({*self.seen, *other.seen})[:PAGES]
        return Learned(align(self.wrapper, other.wrapper), self.common & other.common, seen)

    def dump(self) -> str:
        return json.dumps([_plain(self.wrapper), sorted(self.common), self.seen])

    @staticmethod
    def load(text: str) -> Learned:
        tree, common, seen = json.loads(text)
        return Learned(_node(tree), set(common), seen)

    def rule(self) -> dict:
        return rules(self.wrapper, self.common if len(self.seen) >= PAGES else ())


def learned(tree: Node, page: str) -> Learned:
    """A page as a wrapper of itself alone."""
    own = digested(tree)
    return Learned(fold(own), places(own), [_digest(page)])


def _plain(n: Node) -> list:
    return [n.label, n.text, n.mark, n.words, [_plain(c) for c in n.children]]


def _node(x: list) -> Node:
    return Node(x[0], [_node(c) for c in x[4]], x[1], x[2], x[3])


def blocks(tree: Node) -> tuple[list[str], list[str], list[str]]:
    """Paths, marks (of path and text) and texts of a page's blocks in page order, outside menus and the like."""
    paths: list[str] = []
    marks: list[str] = []
    texts: list[str] = []

    def visit(n: Node, path: tuple[str, ...], main: bool) -> None:
        for c in n.children:
            if c.label == "#":
                text = " ".join(c.text.split())
                if text:
                    paths.append("/".join(path))
                    marks.append(_mark(path, _digest(text)))
                    texts.append(text)
            elif not apart(c.label, main):
                visit(c, (*path, c.label), main or c.name in _MAIN)

    visit(tree, (), False)
    return paths, marks, texts


def host(url: str = "url"):
    return F.coalesce(F.regexp_extract(F.lower(F.col(url)), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))


#: The path of a main element that is all of the page.
_WHOLE = r"^(html[^/]*)?/?(body[^/]*)?$"
BLOCKS = "paths array<string>, marks array<string>, texts array<string>"


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host, kind and the blocks of every page; beside them rows with `learned`, a wrapper of a task's pages of one host and kind.

    Each page is parsed once. A task writes out its wrappers whenever it holds
    many, so it keeps no more.
    """
    kinds = dict(pages.dtypes)
    rows = pages.select("page_id", "url", host().alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    schema = f"page_id {kinds['page_id']}, url string, host string, kind string, {BLOCKS}, learned string"
    lists = pa.list_(pa.string())

    def wrapped(found: dict[tuple[str, str], Learned], ids: pa.DataType) -> pa.RecordBatch:
        none = pa.nulls(len(found))
        hosts, names = (pa.array([k[i] for k in found], pa.string()) for i in (0, 1))
        dumps = pa.array([x.dump() for x in found.values()], pa.string())
        arrays = [none.cast(ids), none.cast(pa.string()), hosts, names, *([none.cast(lists)] * 3), dumps]
        return pa.RecordBatch.from_arrays(arrays, COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str], Learned] = {}
        ids = pa.int64()
        for batch in slices(batches, 200):
            ids = batch.column("page_id").type
            names, cut = [], []
            for h, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                tree = parse(page)
                key = (h, kind(tree))
                names.append(key[1])
                cut.append(blocks(tree))
                if page:
                    one = learned(tree, page)
                    found[key] = found[key].joined(one) if key in found else one
            columns = [pa.array(c, lists) for c in zip(*cut, strict=True)]
            kept = [batch.column(c) for c in ("page_id", "url", "host")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(names, pa.string()), *columns, pa.nulls(batch.num_rows, pa.string())], COLUMNS)
            if len(found) > MOST_HELD:
                yield wrapped(found, ids)
                found = {}
        if found:
            yield wrapped(found, ids)

    return rows.mapInArrow(run, schema)


def wrappers(some: DataFrame) -> DataFrame:
    """host, kind, main, fixed: the rules of each kind of page, of every page of the kind.

    some: host, kind, learned. Rounds join up to PARTS wrappers of one kind into
    one, so no task holds the pages of a host, nor all its wrappers.
    """
    schema = "host string, kind string, learned string"

    def merged(group: pd.DataFrame) -> pd.DataFrame:
        every = map(Learned.load, sorted(group["learned"]))
        return group[["host", "kind"]].iloc[:1].assign(learned=reduce(Learned.joined, every).dump())

    while True:
        counts = store(some.groupBy("host", "kind").count(), "html-counts")
        if counts.filter("count > 1").isEmpty():
            break
        dealt = some.join(counts, ["host", "kind"]).withColumn("part", F.pmod(F.xxhash64("learned", F.rand(5)), F.ceil(F.col("count") / PARTS)))
        some = store(dealt.groupBy("host", "kind", "part").applyInPandas(merged, schema), "html-wrappers")

    def rule(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rules = [Learned.load(x).rule() for x in pdf["learned"]]
            yield pd.DataFrame({"host": pdf["host"], "kind": pdf["kind"], "main": [r["main"] for r in rules], "fixed": [r["fixed"] for r in rules]})

    return some.mapInPandas(rule, "host string, kind string, main array<string>, fixed array<string>")


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    A block is kept if it lies in the main element that the wrapper of its page's
    kind tells. If the page has nothing there, or the kind has no such element,
    all its blocks are kept but those whose text all pages of the kind have at
    that path; inside the main element nothing is dropped for being common. A null html is empty and gives
    an empty text, as does a page without an article; pages with a null url share
    the wrappers of the host ''. A page alone of its kind is its own wrapper.
    Repeated rows give repeated results. Very long and deep pages are taken
    whole. An empty table gives an empty result; further columns are ignored.
    """
    every = store(parsed(pages), "html-parsed")
    rules = store(wrappers(every.filter("learned IS NOT NULL").select("host", "kind", "learned")), "html-rules")
    rows = every.filter("learned IS NULL").drop("learned").join(rules, ["host", "kind"], "left")
    block = F.arrays_zip("paths", "marks", "texts")
    fixed = F.coalesce("fixed", F.array().cast("array<string>"))
    under = lambda b, m: (b["paths"] == m) | b["paths"].startswith(F.concat(m, F.lit("/")))
    held = lambda b: F.exists("main", lambda m: ~m.rlike(_WHOLE) & under(b, m))
    inside = lambda b: F.exists("main", lambda m: (m == "") | under(b, m))
    kept = F.filter(block, lambda b: held(b) | ~F.array_contains(fixed, b["marks"]))
    rows = rows.select("page_id", "url", "main", kept.alias("kept")).select("page_id", "url", "kept", F.filter("kept", inside).alias("within"))
    text = F.array_join(F.when(F.size("within") > 0, F.col("within.texts")).otherwise(F.col("kept.texts")), "\n")
    return rows.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
