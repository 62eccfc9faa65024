"""Main text of web pages by wrapper induction.

Pages become trees of their block elements. The trees of a host are aligned by simple tree matching into one wrapper, level by
level and first in parts, so that a large host is spread. Each wrapper node is a slot. A text that a slot shows on most of the
host's pages is template; slots whose text varies are content, unless their path or their links mark them as furniture
(menus, footers, adverts, forms, comments and the like). Counts per slot run over all pages.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from html.parser import HTMLParser
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.llm.common import discard, load, pick, small, stored
from reviewlake.llm.registry import query

#: A text is template if at least so many different pages of the host show it in a slot, and so large a share of those with the slot.
TEMPLATE_PAGES = 5
TEMPLATE_SHARE = 0.6
#: A slot is a menu if links hold so large a share of its text over all pages of the host.
LINK_SHARE = 0.6
#: A part of the wrapper that holds so large a share of the host's varying unlinked text is no furniture, whatever its name.
MAIN_SHARE = 0.5
#: A host's distinct shapes are aligned in parts of about so many, and the parts' wrappers then with one another.
SHAPES_PER_TASK = 2000
#: Elements nested deeper than this belong to the ancestor at this depth; their texts stay.
MAX_DEPTH = 150

_SILENT = {"script", "style", "noscript", "template", "svg", "head", "title", "iframe", "object", "canvas", "select", "option", "textarea", "button"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_BLOCKS = {
    "html", "body", "address", "article", "aside", "blockquote", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search",
    "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "caption",
}
_FLOW = {"p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "td", "th", "dt", "dd", "blockquote", "pre", "figure"}
#: An opening tag ends these elements if one of them is the innermost open block.
_ENDS = {
    "p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"},
}
_FURNITURE_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog", "search", "fieldset"}
#: These are furniture even if they hold most of a host's text.
_NEVER = {"nav", "footer", "menu", "dialog", "search"}
_FURNITURE = re.compile(
    r"^(nav\w*|menus?|breadcrumbs?|sidebar|side|footer|foot|masthead|topbar|ads?|advert\w*|banner|promo\w*|sponsor\w*|cookies?|consent|notices?|alert|gdpr"
    r"|popup|modal|overlay|newsletter|subscribe|signup|share|sharing|social|related|recommend\w*|comments?|replies|respond|disqus|pagination|pager|skip"
    r"|login|search|form|widget|toolbar|copyright|disclaimer|tags?|teaser|trending|popular)$")
#: A name of several parts is furniture if its last part is, but for names of states and subjects such as has-sidebar or
#: category-social, or if only words for boxes and places follow, as in ad-box; not comments-open.
_STATES = {"has", "have", "is", "no", "not", "with", "without", "category", "cat", "tag", "topic", "type", "format", "status", "hide", "show", "js", "page", "template"}
_BOXES = {
    "area", "bar", "block", "body", "bottom", "box", "button", "buttons", "column", "container", "content", "group", "holder", "icons", "inner", "item", "items", "left", "links",
    "list", "main", "module", "outer", "panel", "posts", "primary", "right", "row", "secondary", "section", "slot", "title", "top", "unit", "widget", "wrap", "wrapper", "zone",
}
#: Behind the sign of an element with a name of furniture.
MARK = "!"
_NAMES = re.compile(r"[A-Za-z]+")
_SPACES = re.compile(r"\s+")


def named_furniture(name: str) -> bool:
    """Whether a whole class, id or role is a name of furniture."""
    parts = [p.lower() for p in _NAMES.findall(name)]
    hits = [i for i, p in enumerate(parts) if _FURNITURE.match(p)]
    return bool(hits) and (len(parts) == 1 or parts[0] not in _STATES) and all(p in _BOXES for p in parts[hits[-1] + 1:])


@dataclass
class Node:
    """A block element: its name with class and id, its children (blocks, or texts with the share of linked characters)."""

    sign: str
    children: list = field(default_factory=list)


class _Tree(HTMLParser):
    """Block elements and the texts between their borders; what shows no text is left out."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#")
        self.open: list[Node] = [self.root]
        self.text: list[str] = []
        self.linked, self.silent, self.link = 0, [], 0

    def parse_marked_section(self, i, report=1):
        """An unknown or unclosed section is a comment up to the next >, as browsers take it, and the page goes on."""
        try:
            end = super().parse_marked_section(i, report)
        except AssertionError:
            end = -1
        return end if end >= 0 else self.parse_bogus_comment(i)

    def flush(self) -> None:
        text = _SPACES.sub(" ", "".join(self.text)).strip()
        if text:
            self.open[-1].children.append((text, min(self.linked, len(text))))
        self.text, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        if self.silent:
            if tag == self.silent[-1]:
                self.silent.append(tag)
            return
        if tag == "body" and any(n.sign.startswith("body") for n in self.open):
            return
        if tag in _SILENT:
            self.silent.append(tag)
        elif tag == "br":
            self.text.append(" ")
        elif tag == "a":
            self.link = 1
        elif tag in _BLOCKS:
            self.flush()
            while len(self.open) > 1 and self.open[-1].sign.split(".")[0] in _ENDS.get(tag, {"p"}):
                self.open.pop()
            if len(self.open) > MAX_DEPTH:
                return
            names = dict(attrs)
            words = sorted({w.lower() for k in ("class", "id", "role") for w in _NAMES.findall(names.get(k) or "")})
            named = tag not in ("html", "body") and any(named_furniture(w) for k in ("class", "id", "role") for w in (names.get(k) or "").split())
            node = Node(".".join([tag, *words, *([MARK] if named else [])]))
            self.open[-1].children.append(node)
            self.open.append(node)
            self.link = 0
        elif tag in _VOID:
            self.text.append(" " if tag in ("hr", "img", "input") else "")

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.silent:
            if tag == self.silent[-1]:
                self.silent.pop()
            elif tag in ("body", "html") or tag == "head" and "head" in self.silent:
                self.silent.clear()
            return
        if tag == "a":
            self.link = 0
        elif tag in _BLOCKS:
            names = [n.sign.split(".")[0] for n in self.open]
            if tag in names:
                self.flush()
                del self.open[len(names) - 1 - names[::-1].index(tag):]

    def handle_data(self, data):
        if not self.silent:
            self.text.append(data)
            self.linked += len(data) * self.link


def parse(html: str | None) -> tuple[list, list[tuple[int, str, int]]]:
    """The page's shape and its texts in order: (place in the shape, text, linked characters).

    A shape is [sign, children] with repeated siblings folded into one child; places number its nodes in preorder.
    """
    tree = _Tree()
    # A head without an end must not swallow the page.
    source = re.sub(r"(?i)<body", "</head><body", html or "", count=1)
    try:
        tree.feed(source)
        tree.close()
    except (AssertionError, ValueError):
        pass
    tree.flush()
    return fold(tree.root)


def fold(root: Node) -> tuple[list, list[tuple[int, str, int]]]:
    shape: list = [root.sign, []]
    texts: list[tuple[list, str, int]] = []

    def slot_of(children: list, cursor: int, sign: str) -> int:
        """Where a child belongs: elements of running text share one node each among their siblings, others fold into the
        next equal one behind ``cursor``, which is the sibling before for the first record of a list."""
        first = 0 if sign.split(".")[0] in _FLOW else max(cursor, 0)
        for i in range(first, len(children)):
            if children[i][0] == sign:
                return i
        children.insert(cursor + 1, [sign, []])
        return cursor + 1

    stack: list[list] = [[shape, iter(root.children), -1]]
    while stack:
        to, rest, cursor = stack[-1]
        child = next(rest, None)
        if child is None:
            stack.pop()
        elif isinstance(child, tuple):
            texts.append((to, *child))
        else:
            stack[-1][2] = slot_of(to[1], cursor, child.sign)
            stack.append([to[1][stack[-1][2]], iter(child.children), -1])
    order, places = [shape], {}
    while order:
        node = order.pop()
        places[id(node)] = len(places)
        order.extend(reversed(node[1]))
    return shape, [(places[id(n)], t, k) for n, t, k in texts]


def match(a: list, b: list) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching of the children of two nodes of one kind: the size of the largest order-preserving match, and its
    pairs of children. Nodes match only if their signs are equal."""
    memo: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}

    def go(x: list, y: list) -> tuple[int, list[tuple[int, int]]]:
        key = (id(x), id(y))
        if key in memo:
            return memo[key]
        m, n = len(x[1]), len(y[1])
        best = [[0] * (n + 1) for _ in range(m + 1)]
        for i in range(m):
            for j in range(n):
                take = best[i][j] + go(x[1][i], y[1][j])[0] if x[1][i][0] == y[1][j][0] else 0
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], take)
        pairs, i, j = [], m, n
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((i, j))
        memo[key] = best[m][n] + 1, pairs[::-1]
        return memo[key]

    return go(a, b)


def merge(wrapper: list, shape: list) -> None:
    """Align a shape with the wrapper and add the nodes that the wrapper lacks, each behind the match before it."""
    pairs = dict((j, i) for i, j in match(wrapper, shape)[1])
    children, at, out = wrapper[1], 0, []
    for j, child in enumerate(shape[1]):
        if j in pairs:
            out += children[at:pairs[j] + 1]
            at = pairs[j] + 1
            merge(children[pairs[j]], child)
        else:
            out.append(json.loads(json.dumps(child)))
    wrapper[1] = out + children[at:]


def place(wrapper: list, shape: list) -> list[int]:
    """For every node of the shape (in preorder) the preorder number of its wrapper node; -1 if there is none."""
    numbers, order = {}, [wrapper]
    while order:
        node = order.pop()
        numbers[id(node)] = len(numbers)
        order.extend(reversed(node[1]))
    out: list[int] = []

    def go(at: list | None, node: list) -> None:
        out.append(-1 if at is None else numbers[id(at)])
        pairs = {j: i for i, j in match(at, node)[1]} if at is not None else {}
        for j, child in enumerate(node[1]):
            go(at[1][pairs[j]] if j in pairs else None, child)

    go(wrapper, shape)
    return out


def furniture(shape: list, free: list[int] | None = None) -> list[bool]:
    """For every node of a shape (in preorder) whether its path marks it as furniture. A header inside an article is part of it.

    ``free`` has the varying unlinked characters of each node. A mark is not handed down to a child with most of them, nor
    to one that holds an article or main element if the page has none outside of marked elements.
    """
    nodes, parents, order = [], [], [(shape, -1)]
    while order:
        node, parent = order.pop()
        parents.append(parent)
        at = len(nodes)
        nodes.append(node)
        order.extend((c, at) for c in reversed(node[1]))
    signs = [n[0].split(".") for n in nodes]
    heads = [s[0] in ("article", "main") for s in signs]
    weight = list(free or [0] * len(nodes))
    most = MAIN_SHARE * sum(weight)
    holds = list(heads)
    for i in range(len(nodes) - 1, 0, -1):
        weight[parents[i]] += weight[i]
        holds[parents[i]] |= holds[i]

    def marks(overrule: bool) -> list[bool]:
        out, inside, fixed = [], [], []
        for i, (tag, *words) in enumerate(signs):
            up = parents[i]
            within = i > 0 and inside[up] or tag in ("article", "main") or "main" in words
            own = tag in _FURNITURE_TAGS or MARK in words
            own |= not within and (tag == "header" or "header" in words and tag not in ("html", "body"))
            large = weight[i] > most > 0 or overrule and holds[i]
            never = i > 0 and fixed[up] or tag in _NEVER
            out.append(never or not large and (own or i > 0 and out[up]))
            inside.append(within)
            fixed.append(never)
        return out

    found = marks(False)
    return marks(True) if any(heads) and all(m for m, h in zip(found, heads) if h) else found


def _induce(rows: pd.DataFrame) -> list:
    """One wrapper of all given shapes, the frequent ones first."""
    wrapper: list = ["#", []]
    for shape in rows.sort_values(["n", "shape"], ascending=[False, True])["shape"]:
        merge(wrapper, json.loads(shape))
    return wrapper


def wrappers(shapes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(host, wrapper), and (host, shape, slots, marked) for every distinct shape of every host: slots[i] is the wrapper node of
    the shape's node i, marked[i] whether its own path is furniture (for nodes without a wrapper node)."""
    sizes = small(stored(shapes.groupBy("host").agg(F.ceil(F.count("*") / SHAPES_PER_TASK).alias("salts")), "html-hosts"), 20_000)
    salted = shapes.join(sizes, "host").withColumn("salt", F.pmod(F.xxhash64("shape"), F.col("salts")).cast("int")).drop("salts")

    def part(key: tuple[Any, ...], rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [key[0]], "shape": [json.dumps(_induce(rows))], "n": [int(rows["n"].sum())]})

    def whole(key: tuple[Any, ...], rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [key[0]], "wrapper": [json.dumps(_induce(rows))]})

    parts = salted.groupBy("host", "salt").applyInPandas(part, "host string, shape string, n long")
    done = stored(parts.groupBy("host").applyInPandas(whole, "host string, wrapper string"), "html-wrappers")

    def align(source):
        for frame in source:
            trees = {w: json.loads(w) for w in frame["wrapper"].unique()}
            shapes = [json.loads(s) for s in frame["shape"]]
            yield frame.assign(slots=[place(trees[w], s) for w, s in zip(frame["wrapper"], shapes)],
                               marked=[furniture(s) for s in shapes])[["host", "shape", "slots", "marked"]]

    return done, stored(shapes.join(done, "host").mapInPandas(align, "host string, shape string, slots array<int>, marked array<boolean>"), "html-slots")


def marked_slots(wrapped: DataFrame, free: DataFrame) -> DataFrame:
    """(host, furniture) from (host, wrapper) and (host, slot, free characters): whether each wrapper node is furniture."""
    def run(source):
        for frame in source:
            out = []
            for wrapper, found in zip(frame["wrapper"], frame["free"]):
                tree, order, n = json.loads(wrapper), [], 0
                order.append(tree)
                while order:
                    n += 1
                    order.extend(order.pop()[1])
                weight = [0] * n
                for row in found if found is not None else ():
                    if row["slot"] >= 0:
                        weight[row["slot"]] = int(row["free"])
                out.append(furniture(tree, weight))
            yield pd.DataFrame({"host": frame["host"], "furniture": out})

    each = free.groupBy("host").agg(F.collect_list(F.struct("slot", "free")).alias("free"))
    return stored(wrapped.join(each, "host", "left").mapInPandas(run, "host string, furniture array<boolean>"), "html-furniture")


def parsed(pages: DataFrame) -> DataFrame:
    """Per page row: page_id, url, host, shape, and its texts with the place of each and its linked characters."""
    def run(source):
        for batch in source:
            shapes, places, texts, linked = [], [], [], []
            for html in batch.column(2).to_pylist():
                shape, found = parse(html)
                shapes.append(json.dumps(shape, separators=(",", ":")))
                places.append([p for p, _, _ in found])
                texts.append([t for _, t, _ in found])
                linked.append([k for _, _, k in found])
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], batch.column(3), pa.array(shapes, pa.string()), pa.array(places, ints), pa.array(texts, pa.list_(pa.string())), pa.array(linked, ints)],
                ["page_id", "url", "host", "shape", "places", "texts", "linked"])

    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pick(pages, page_id="long", url="string", html="string").withColumn("host", host)
    return stored(rows.mapInArrow(run, "page_id long, url string, host string, shape string, places array<int>, texts array<string>, linked array<int>"), "html-blocks")


def main_text(pages: DataFrame) -> DataFrame:
    """Per page row: page_id, url, text, n_chars.

    A null or empty page has the empty text. Pages without a host are aligned with one another. A page that repeats another's
    texts counts once where template is told from content, so copies of an article don't make it template.
    Very long texts are worked whole, an empty table gives no rows, and other columns, whatever their names, are not read.
    """
    rows = parsed(pages)
    shapes = rows.groupBy("host", "shape").agg(F.count("*").alias("n"))
    wrapped, slots = wrappers(shapes)
    placed = rows.join(small(slots, 20_000), ["host", "shape"])

    each = placed.select("host", F.xxhash64("texts").alias("page"), F.explode(F.arrays_zip("places", "texts", "linked")).alias("b"), "slots").select(
        "host", "page", F.element_at("slots", F.col("b.places") + 1).alias("slot"), F.xxhash64("b.texts").alias("key"),
        F.char_length("b.texts").alias("size"), F.col("b.linked").alias("linked"))
    # Distinct pages first: one row per host, slot, text and page.
    each = each.groupBy("host", "slot", "key", "page").agg(F.max("size").alias("size"), F.max("linked").alias("linked"))
    counts = each.groupBy("host", "slot", "key").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.sum("linked").alias("linked"))
    counts = stored(counts, "html-counts")
    pages_of = each.groupBy("host", "slot", "page").agg(F.lit(1).alias("one")).groupBy("host", "slot").agg(F.count("*").alias("pages"))
    totals = counts.groupBy("host", "slot").agg(F.sum("size").alias("size"), F.sum("linked").alias("linked"))
    menus = totals.where(F.col("linked") > LINK_SHARE * F.col("size")).select("host", "slot", F.lit(None).cast("long").alias("key"))
    frequent = counts.where(F.col("n") >= TEMPLATE_PAGES).join(pages_of, ["host", "slot"]).where(F.col("n") >= TEMPLATE_SHARE * F.col("pages"))
    # At most one or two texts of a slot can be on most pages, so the list is as long as the wrapper at most.
    template = menus.union(frequent.select("host", "slot", "key")).groupBy("host").agg(
        F.collect_list(F.struct("slot", "key")).alias("gone"))
    gone = stored(template, "html-template")
    varying = counts.join(frequent.select("host", "slot", "key"), ["host", "slot", "key"], "left_anti").groupBy("host", "slot").agg(
        F.sum(F.greatest(F.lit(0), F.col("size") - F.col("linked"))).alias("free"))
    sides = marked_slots(wrapped, varying)

    listed = placed.join(small(gone, 20_000), "host", "left").join(small(sides, 20_000), "host")
    blocks = F.arrays_zip("places", "texts")
    none = F.array().cast(gone.schema["gone"].dataType)

    def content(block):
        slot, key = F.element_at("slots", block["places"] + 1), F.xxhash64(block["texts"])
        known = F.exists(F.coalesce("gone", none), lambda g: (g["slot"] == slot) & (g["key"].isNull() | (g["key"] == key)))
        side = F.when(slot >= 0, F.get("furniture", slot)).otherwise(F.element_at("marked", block["places"] + 1))
        return ~side & ~known

    text = F.array_join(F.transform(F.filter(blocks, content), lambda b: b["texts"]), "\n\n")
    discard(counts)
    return listed.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))


@query("op1_html_extraction")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(load(spark, sf_dir, "pages"))
