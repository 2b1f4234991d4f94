"""Main text of web pages by wrappers inferred from the pages of a host.

A page is a stream of tags and text slots. It is tidied into balanced elements, repeated runs of alike siblings
are folded into repeated groups, and what is left is a union-free regular expression of one page. The
expressions of a host are aligned one after the other: equal siblings are merged, and a mismatch makes what only one side
has optional; one sibling against a repeated group joins the group; text that differs becomes a slot. The result
is the host's wrapper. Pages of one host may be any share of all: tasks align the pages they hold, equal
expressions once, and only their wrappers, a few per host and task, meet in a second alignment.

An expression has at most ``MOST_KINDS`` children in a place; longer ones are generalised to a repeated group
of their optional kinds, which still accepts every page. A wrapper so stays of bounded size.

In the wrapper the main part is chosen: its articles, else its main element, else the element that holds most of the
host's running text. Elements that are menus, headers, footers, sidebars, notices, adverts, forms, comments or
no text by their tag, role or class are left out everywhere. A page's blocks are read from its main part in page order; a page
without that part is read whole.

Null or empty pages have an empty text. Pages without a host share one. Pages are read whole, each by itself,
so repeated rows and ids do not matter. Other columns pass through; those named like a result are replaced.
"""

from __future__ import annotations

import html
import json
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Sent to tasks by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MOST_KINDS = 64
MOST_DEPTH = 200  # of wrappers; texts of deeper elements are taken as children of this depth
HELD_HOSTS = 2000  # wrappers a task holds before it passes them on

# Elements by what they do.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter output q rp rt ruby "
             "s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = set("head nav footer aside form script style noscript template iframe object svg canvas button select textarea "
              "input menu dialog audio video map title".split())
PASSED = INLINE | {"html", "body"}  # no steps of a path
# A start tag that ends an open element of the same line: paragraphs end at any block, items at the next.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
        "option": {"option"}, "thead": {"tr"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
ROLES = set("navigation banner contentinfo complementary search dialog alertdialog menu menubar form".split())
NAMES = set("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies "
            "copyright disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice overlay pager pagination "
            "popup promo promoted related recommended respond reply replies share sharing sidebar signup social sponsor sponsored subscribe "
            "toolbar widget".split())
# A class with one of these says how a page is laid out, not what its element is.
STATES = set("disabled enabled free has is layout no not with without".split())
MAIN_NAMES = set("article content entry main post story".split())

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"""
                   r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.DOTALL)
ATTRIBUTE = re.compile(r"""(?<![-\w])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
NUMBER = re.compile(r"\d{2,}")
SPACE = re.compile(r"\s+")
PARTS = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")


class Element:
    """A tag with its children, which are elements and texts."""
    __slots__ = ("tag", "key", "dropped", "children")

    def __init__(self, tag: str, key: str, dropped: int):
        self.tag, self.key, self.dropped, self.children = tag, key, dropped, []


def _kind(tag: str, attributes: str) -> tuple[str, int]:
    """What names an element in an expression, and whether it is no main text: 2, or 1 as long as it does not hold most of it."""
    names: set[str] = set()
    classes: set[str] = set()
    dropped = 1 if tag == "form" else 2 * (tag in DROPPED)
    if attributes.strip():
        for name, *values in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), next((v for v in values if v), "")
            if name == "role":
                dropped = max(dropped, 2 * (value.strip().lower() in ROLES))
            elif name in ("class", "id"):
                # Numbers of several digits are often of the page, not of its kind.
                classes |= set(NUMBER.sub("", value).split())
                for token in value.split():
                    words = {w.lower() for w in PARTS.split(token) if w}
                    if not words & STATES:
                        names |= words & (NAMES | MAIN_NAMES)
            elif name == "hidden" or value.lower() == "true":
                dropped = 2
    if tag not in ("html", "body", "main", "article"):
        # The header of a post holds its title.
        dropped = max(dropped, int(bool(names & NAMES - {"header"}) or "header" in names and not names & MAIN_NAMES))
    return ".".join([tag, *sorted(classes)]), dropped


def parse(page: str | None) -> Element:
    """Balanced elements of a page; end tags without a start are skipped, starts without an end end with their parent."""
    root = _elements(page)
    _keep_holders(root)
    return root


def _keep_holders(root: Element) -> None:
    """An element dropped by its name, or a form, that holds the article or main element with most of the text is none of those.

    A form without either is kept if most of the page's running text is in it.
    """
    order, stack = [], [(root, False)]
    while stack:
        element, inside = stack.pop()
        order.append((element, inside))
        inside |= element.tag in ("article", "main")
        stack += [(c, inside) for c in element.children if not isinstance(c, str)]
    if not any(e.dropped == 1 for e, _ in order):
        return
    letters: dict[int, int] = {}
    mains: dict[int, int] = {}
    for element, _ in reversed(order):
        own = main = 0
        # What is dropped by its tag, role or as hidden, and links, are no running text.
        if element.dropped != 2 and element.tag not in RAW and element.tag != "a":
            for child in element.children:
                own += len(child.strip()) if isinstance(child, str) else letters[id(child)]
                main += 0 if isinstance(child, str) else mains[id(child)]
        letters[id(element)], mains[id(element)] = own, own if element.tag in ("article", "main") else main
    for element, inside in order:
        if element.dropped == 1 and not inside:
            held = letters[id(element)] if element.tag == "form" else mains[id(element)]
            element.dropped = int(2 * held <= letters[id(root)])


def _elements(page: str | None) -> Element:
    root = Element("", "", 0)
    open_ = [root]
    tags: dict[str, int] = {}  # open elements of each tag
    page = page or ""
    at = 0

    def leave(i):
        for one in open_[i:]:
            tags[one.tag] -= 1
        del open_[i:]

    def text(start, end):
        if start < end:
            open_[-1].children.append(page[start:end])

    while True:
        found = TOKEN.search(page, at)
        if found is None:
            text(at, len(page))
            return root
        text(at, found.start())
        at = found.end()
        tag = (found[2] or found[5] or "").lower()
        if not tag:
            if page.startswith("<![CDATA[", found.start()):
                text(found.start() + 9, found.end() - 3 * page.endswith("]]>", 0, found.end()))
            continue
        if found[1] or found[4]:
            for i in range(len(open_) - 1, 0, -1) if tags.get(tag) else ():
                if open_[i].tag == tag:
                    leave(i)
                    break
            continue
        attributes = found[3] or found[6] or ""
        if tag not in INLINE:
            # A paragraph does not go on behind the start of a block, nor do the inline elements in it.
            for i in range(len(open_) - 1, 0, -1):
                if open_[i].tag == "p":
                    leave(i)
                    break
                if open_[i].tag not in INLINE:
                    if open_[i].tag in ENDS.get(tag, ()):
                        leave(i)
                    break
        key, dropped = _kind(tag, attributes)
        element = Element(tag, key, dropped)
        open_[-1].children.append(element)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.IGNORECASE).search(page, at)
            end = close.start() if close else len(page)
            element.children.append(page[at:end])
            at = close.end() if close else len(page)
        elif tag not in VOID and not attributes.endswith("/"):
            open_.append(element)
            tags[tag] = tags.get(tag, 0) + 1


# Expressions --------------------------------------------------------------------------------------------
# An item is [key, optional, repeated, letters of running text, children]; the key "#" is a text slot, whose
# children are the one constant text, or none where texts differ.

def below(element: Element) -> list:
    """What is in an element and all below, without what is dropped or no text: texts in page order."""
    texts, stack = [], element.children[::-1]
    while stack:
        child = stack.pop()
        if isinstance(child, str):
            texts.append(child)
        elif not child.dropped and child.tag not in RAW and child.tag != "a":
            stack += child.children[::-1]
    return texts


def expression(element: Element, depth: int = 1) -> list:
    """The expression of one page."""
    children = []
    for child in element.children if depth < MOST_DEPTH else below(element):
        if isinstance(child, str):
            words = SPACE.sub(" ", child).strip()
            if words and element.tag not in RAW:
                children.append(["#", 0, 0, len(words), [xxhash.xxh32_intdigest(words)]])
        elif child.tag not in RAW and child.tag not in VOID:
            children.append(expression(child, depth + 1))
    children = folded(children)
    return [element.key, 0, 0, 0 if element.dropped or element.tag == "a" else sum(c[3] for c in children), children]


def folded(items: list) -> list:
    """Repeated runs as repeated groups: first of one sibling, then of two and of three."""
    for width in (1, 2, 3):
        out: list = []
        for item in items:
            out.append(item)
            while len(out) >= 2 * width and all(a[0] == b[0] for a, b in zip(out[-2 * width:-width], out[-width:])):
                last = [merge(a, b) for a, b in zip(out[-2 * width:-width], out[-width:])]
                for one in last:
                    one[2] = 1
                out[-2 * width:] = last
        items = out
    return generalised(items) if len(items) > MOST_KINDS else items


def generalised(items: list) -> list:
    """(a? b? c?)+ for any run of a, b and c."""
    kinds: dict[str, list] = {}
    for item in items:
        key = item[0] if item[0] in kinds or len(kinds) < MOST_KINDS - 1 else "*"
        kinds[key] = merge(kinds[key], [key, *item[1:]]) if key in kinds else [key, *item[1:]]
    return [[k, 1, 1, letters, children] for k, _, _, letters, children in kinds.values()]


def merge(a: list, b: list) -> list:
    """What accepts both; letters add up."""
    if a[0] == "#":
        return ["#", a[1] | b[1], a[2] | b[2], a[3] + b[3], a[4] if a[4] == b[4] else []]
    return [a[0], a[1] | b[1], a[2] | b[2], a[3] + b[3], aligned(a[4], b[4])]


def aligned(a: list, b: list) -> list:
    """Two runs of siblings as one: those in common in their longest common order, the others optional."""
    if [x[0] for x in a] == [x[0] for x in b]:
        return [merge(x, y) for x, y in zip(a, b)]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = 1 + best[i + 1][j + 1] if a[i][0] == b[j][0] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i][0] == b[j][0]:
            out.append(merge(a[i], b[j]))
            i, j = i + 1, j + 1
        elif j == len(b) or i < len(a) and best[i + 1][j] >= best[i][j + 1]:
            out.append([a[i][0], 1, *a[i][2:]])
            i += 1
        else:
            out.append([b[j][0], 1, *b[j][2:]])
            j += 1
    return folded(out) if len(out) > max(len(a), len(b)) else out


def written(item: list) -> str:
    """A wrapper as a regular expression for people."""
    key, optional, repeated, _, children = item
    inner = "#" if key == "#" else f"<{key}>" + " ".join(map(written, children)) + f"</{key}>"
    return inner if not optional and not repeated else f"({inner})" + ("*" if optional and repeated else "?" if optional else "+")


# The main part ------------------------------------------------------------------------------------------

def main_part(wrapper: list) -> str:
    """Tag or path of the elements that hold the main text; empty for the whole page."""
    letters: dict[str, int] = {}
    dense = ["", 0]

    def look(item, depth, path):
        for child in item[4] if item[0] != "#" else ():
            if child[0] == "#" or not child[3]:
                continue
            tag = child[0].split(".")[0]
            if tag in ("article", "main"):
                letters[tag] = letters.get(tag, 0) + child[3]
            below = path if tag in PASSED else f"{path}/{child[0]}"
            # The deepest element with two thirds of all running text.
            if 3 * child[3] >= 2 * wrapper[3] and depth > dense[1] and tag not in PASSED and tag != "p":
                dense[:] = below, depth
            look(child, depth + 1, below)
    look(wrapper, 1, "")
    return next((tag for tag in ("article", "main") if letters.get(tag)), dense[0])


def main_text(page: str | None, main: str) -> str:
    """Blocks of the main part, one to a line."""
    root = parse(page)
    blocks: list[str] = []
    line: list[str] = []

    def close():
        words = SPACE.sub(" ", html.unescape("".join(line))).strip()
        if words:
            blocks.append(words)
        line.clear()

    # Elements being read: what is left of them, whether they are inside the main part and an article, and their path.
    reading = [(iter(root.children), root, not main, False, "")]
    while reading:
        left, element, inside, in_article, path = reading[-1]
        child = next(left, None)
        if child is None:
            reading.pop()
            if element.tag not in INLINE and element is not root and element.tag != "header":
                close()
        elif isinstance(child, str):
            if inside and element.tag not in RAW:
                line.append(child)
        elif child.tag == "header" and in_article and not child.dropped:
            reading.append((iter(child.children), child, inside, in_article, path))
        elif not child.dropped and child.tag != "header":
            if child.tag in VOID:
                if child.tag in ("br", "wbr"):
                    line.append(" " if child.tag == "br" else "")
                elif child.tag == "hr":
                    close()
                continue
            if child.tag not in INLINE:
                close()
            # The path of a main part is no deeper than a wrapper.
            inner = path if child.tag in PASSED or len(reading) > MOST_DEPTH else f"{path}/{child.key}"
            reading.append((iter(child.children), child, inside or main in (child.tag, inner),
                            in_article or child.tag == "article", inner))
    close()
    if not blocks and main:
        return main_text(page, "")
    return "\n".join(blocks)


# Over a table -------------------------------------------------------------------------------------------

def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))


def _infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task code: pages to one wrapper for each host that the task has met."""
    wrappers: dict[str, list] = {}

    def out():
        rows = pa.RecordBatch.from_arrays([pa.array(wrappers, pa.string()), pa.array([json.dumps(w) for w in wrappers.values()])],
                                          ["host", "wrapper"])
        wrappers.clear()
        return rows
    for batch in batches:
        for name, page in zip(batch.column(0).to_pylist(), batch.column(1)):
            own = expression(parse(page.as_py()))
            wrappers[name] = merge(wrappers[name], own) if name in wrappers else own
        if len(wrappers) > HELD_HOSTS:
            yield out()
    yield out()


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task code: wrappers in order of hosts to one for each host, with its main part."""
    name, wrapper = None, None

    def out():
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([written(wrapper)]), pa.array([main_part(wrapper)])],
                                          ["host", "wrapper", "main"])
    for batch in batches:
        for host_, packed in zip(*(c.to_pylist() for c in batch.columns)):
            own = json.loads(packed)
            if host_ == name:
                wrapper = merge(wrapper, own)
            else:
                if name is not None:
                    yield out()
                name, wrapper = host_, own
    if name is not None:
        yield out()


def infer(pages: DataFrame) -> DataFrame:
    """The wrapper of each ``host`` of ``pages (url, html)`` as an expression, and its ``main`` part."""
    parts = pages.select(host(F.col("url")).alias("host"), "html").mapInArrow(_infer, "host string, wrapper string")
    return (parts.repartition("host").sortWithinPartitions("host", F.xxhash64("wrapper"))
            .mapInArrow(_combine, "host string, wrapper string, main string"))


@F.arrow_udf(T.StringType())
def _main_text(pages: pa.Array, mains: pa.Array) -> pa.Array:
    return pa.array([main_text(p.as_py(), m or "") for p, m in zip(pages, mains.to_pylist())], pa.string())


def extract(pages: DataFrame, wrappers: DataFrame) -> DataFrame:
    """``pages`` with the main ``text``; the wrappers are one short row for each host."""
    known = wrappers.select(F.col("host").alias("_host"), F.col("main").alias("_main"))
    joined = pages.drop("text").join(known, host(F.col("url")) == F.col("_host"), "left")
    return joined.withColumn("text", _main_text("html", "_main")).drop("_host", "_main")
