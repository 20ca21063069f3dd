"""Main body of web pages by tree scoring.

A page's block tags become a tree. Every paragraph passes points for its length and its commas to its ancestors, whole
to the first and half of it for each further one; an ancestor's points are discounted by the share of its text that
lies in links. The best container and its siblings of similar kind are kept; within them subtrees that look like
furniture (menus, paths, notices, advertising, tools, teasers, readers' comments) are dropped by the same measures.

Pages are scored one by one in the task that reads them (``mapInArrow``); there is no shuffle and no model.

Defined cases: null and blank pages give no block, nor do pages without any paragraph; html may be escaped any number
of times or not at all; unclosed tags end with their parent or the next sibling; a text repeated in a page is one block; equal
pages under several ids give their blocks each.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = frozenset("html head body title h1 h2 h3 h4 h5 h6 p div section article main aside nav header footer ul ol li dl dt dd table tr td th".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
BOXES = frozenset(("div", "section", "article", "main", "aside", "nav", "header", "footer", "td", "body", "html"))
#: A tag that starts ends an open one of these, up to (not through) the tags in BOUND.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
BOUND = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}

_DROP = re.compile(r"(?is)<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<!\[CDATA\[.*?\]\]>")
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<[!?][^>]*>")
_SPACE = re.compile(r"[\s​-‍⁠﻿]+")
_MARKUP = re.compile(r"<\s*(?:!doctype|/?[a-zA-Z][a-zA-Z0-9]*[\s/>])", re.I)
_COMMA = re.compile(r"[,，、；;]")
_END = re.compile(r"[。！？!?…；;.][”\"'’」』）)\]]*$")
_LABEL = re.compile(r"^[^，。；,;“”\"]{1,24}[:：]")
_SPEAKER = re.compile(r"^[^\s，。；,;：:]{1,8}\d+[:：]")
_PATH = re.compile(r"\S\s*[>›»→]\s*\S.*[>›»→]\s*\S")
#: Text that speaks to the visitor instead of about the subject.
_VISITOR = re.compile(r"(?i)cookie|您|本站|扫码|客户端|赞助播出|^广告|版权所有")


class Node:
    __slots__ = ("tag", "parent", "kids", "chars", "links", "score", "texts", "body", "odd", "good")

    def __init__(self, tag: str, parent: "Node | None"):
        self.tag, self.parent = tag, parent
        self.kids: list = []  # nodes, and texts as [text, linked characters, label is linked, number of inline pieces]
        self.chars = self.links = 0
        self.texts = self.body = self.odd = self.good = 0  # texts inside, those not in headings, of them those like links or speakers, and paragraphs
        self.score = 0.0


def unescape_at_rest(s: str) -> str:
    while not _MARKUP.search(s):
        t = html.unescape(s)
        if t == s:
            break
        s = t
    return s


def squeeze(s: str) -> str:
    return _SPACE.sub("", html.unescape(s))


def parse(page: str) -> Node:
    """The tree of block tags; texts between two of them are one text, whatever inline tags are inside."""
    s = _DROP.sub("", unescape_at_rest(page))
    root = Node("", None)
    node = root
    at, buf, linked, in_link, lead, pieces = 0, [], 0, False, False, 0

    def flush() -> None:
        nonlocal buf, linked, lead, pieces
        if buf:
            raw = "".join(buf)
            t = squeeze(raw)
            if t:
                node.kids.append([t, linked, lead, pieces, raw])
        buf, linked, lead, pieces = [], 0, False, 0

    for m in _TAG.finditer(s):
        piece = s[at : m.start()]
        at = m.end()
        if piece:
            n = len(squeeze(piece))
            if in_link:
                if n and not "".join(buf).strip():
                    lead = True
                linked += n
            if n:
                pieces += 1
            buf.append(piece)
        tag = (m[2] or "").lower()
        if not tag:
            continue
        close = bool(m[1])
        if tag == "a":
            in_link = not close
        if tag not in BLOCK:
            continue
        flush()
        if close:
            up = node
            while up is not None and up.tag != tag:
                up = up.parent
            if up is not None and up.parent is not None:
                node = up.parent
            in_link = False
            continue
        if node.tag == "p":  # a block ends an open paragraph
            node = node.parent
        ends = ENDS.get(tag)
        if ends:
            up, bound = node, BOUND[tag]
            while up is not None and up.tag not in bound and up.tag not in ends:
                up = up.parent
            if up is not None and up.tag in ends:
                while up.parent is not None and up.parent.tag in ends:
                    up = up.parent
                node = up.parent
        child = Node(tag, node)
        node.kids.append(child)
        node = child
    buf.append(s[at:])
    flush()
    return root


def _points(t: list, tag: str) -> float:
    """Points of a paragraph: none for captions, labels, speakers and notices."""
    text, linked = t[0], t[1]
    if len(text) < 8 or tag in HEADINGS or tag in ("title", "dt", "th") or linked * 2 > len(text):
        return 0.0
    if not _END.search(text) or _VISITOR.search(text) or _SPEAKER.match(text) or (t[2] and _LABEL.match(text)):
        return 0.0
    return 1.0 + len(_COMMA.findall(text)) + min(len(text) / 40.0, 3.0)


def _measure(root: Node) -> None:
    """Points and counts of all nodes; pages may be nested to any depth, so there is no recursion here and below."""
    for k, n in _texts(root):
        n.chars += len(k[0])
        n.links += k[1]
        n.texts += 1
        p = _points(k, n.tag)
        if n.tag not in HEADINGS:
            n.body += 1
            n.odd += bool(_SPEAKER.match(k[0]) or (k[2] and _LABEL.match(k[0])) or k[1] * 2 > len(k[0]))
            n.good += p > 0
        if p:
            # a paragraph's own tag isn't a container unless text stands in it beside other blocks
            up = n if n.tag in BOXES and any(isinstance(x, Node) for x in n.kids) else n.parent
            while up is not None and up.tag in ("ul", "ol", "li", "tr", "table", "dl", "dd", "p") and up.parent is not None:
                up = up.parent
            share = 1.0
            for _ in range(4):
                if up is None or not up.tag:
                    break
                up.score += p * share
                share /= 2
                up = up.parent
                while up is not None and up.tag in ("ul", "ol", "li", "tr", "table", "dl", "dd"):
                    up = up.parent
    for n in reversed(list(_nodes(root))):
        up = n.parent
        if up is not None:
            up.chars += n.chars
            up.links += n.links
            up.texts += n.texts
            up.body += n.body
            up.odd += n.odd
            up.good += n.good


def _value(n: Node) -> float:
    return n.score * (1.0 - n.links / max(1, n.chars))


def _nodes(n: Node) -> Iterator[Node]:
    stack = [n]
    while stack:
        x = stack.pop()
        yield x
        stack.extend(k for k in reversed(x.kids) if isinstance(k, Node))


def _texts(n: Node) -> Iterator[tuple[list, Node]]:
    """The texts in order, each with the node that holds it."""
    stack = [(n, iter(n.kids))]
    while stack:
        x, kids = stack[-1]
        for k in kids:
            if isinstance(k, Node):
                stack.append((k, iter(k.kids)))
                break
            yield k, x
        else:
            stack.pop()


def _furniture_text(t: list, tag: str) -> bool:
    """A text that stands alone in a box: advertising, notices, paths, tools."""
    text, raw = t[0], t[4]
    if _VISITOR.search(text) or _SPEAKER.match(text):
        return True
    if tag in HEADINGS or tag in ("dt", "dd", "th", "td", "li"):
        return False
    if _PATH.search(html.unescape(raw)):
        return True
    return not _END.search(text) and len(text) < 60


def _furniture(n: Node) -> bool:
    """A whole box that is a menu, a list of links, teasers or comments."""
    if n.tag in ("nav", "footer"):
        return True
    if not n.texts:
        return True
    if n.tag == "dl" or n.tag == "table":
        return False
    if n.tag in ("ul", "ol"):
        return n.links * 2 > n.chars
    if n.links * 2 > n.chars or not n.body:
        return True
    if n.odd * 2 > n.body:
        return True
    return n.tag == "aside" and n.good * 2 < n.body


def _keep(root: Node, out: list[str]) -> None:
    stack = [(root, iter(root.kids))]
    while stack:
        n, kids = stack[-1]
        for k in kids:
            if isinstance(k, Node):
                if k.tag in ("p", "div", "section", "article", "main", "aside", "header", "nav", "footer", "ul", "ol", "td", "body") or (k.tag == "table" and any(x.tag in ("p", "div", "section", "h1", "h2", "h3", "aside", "article") for x in _nodes(k))):
                    if k.tag != "table" and k.tag != "td" and _furniture(k):
                        if not (k.tag in ("p", "div") and all(not isinstance(x, Node) for x in k.kids) and all(_points(t, k.tag) > 0 for t in k.kids)):
                            continue
                stack.append((k, iter(k.kids)))
                break
            elif n.tag in ("p", "div", "section", "article", "main", "aside", "header", "body", "td", "") and _furniture_text(k, n.tag) and n.tag != "td":
                continue
            elif n.tag == "title":
                continue
            else:
                if not _VISITOR.search(k[0]) or n.tag in ("dd", "td", "th"):
                    out.append(k[0])
        else:
            stack.pop()


def main_blocks(page: str | None) -> list[str]:
    """Texts (without white space) of the blocks of a page's main body, in order."""
    if page is None or not page.strip():
        return []
    root = parse(page)
    _measure(root)
    best, top = None, 0.0
    for n in _nodes(root):
        if n.tag in BOXES and (v := _value(n)) > top:
            best, top = n, v
    if best is None:
        return []
    out: list[str] = []
    up = best.parent
    if up is not None and up.tag in BOXES and best.tag != "td":
        for k in up.kids:
            if k is best:
                _keep(best, out)
            elif isinstance(k, Node) and k.tag in BOXES and _value(k) >= 0.25 * top and not _furniture(k):
                _keep(k, out)
            elif isinstance(k, Node) and k.tag in HEADINGS and up.tag not in ("body", "html") and not any(isinstance(x, Node) and x.tag in HEADINGS for x in best.kids):
                _keep(k, out)
    else:
        _keep(best, out)
    return out


def blocks(df: DataFrame, id_col: str = "id", page: str = "html") -> DataFrame:
    """(id, position, text, block_md5) for each distinct block of the main body of each page."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                cols: tuple[list, list, list, list] = ([], [], [], [])
                for i, s in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    for k, t in enumerate(dict.fromkeys(main_blocks(s))):
                        for c, v in zip(cols, (i, k, t, hashlib.md5(t.encode("utf-8", "replace")).hexdigest())):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.string(), pa.string()))], ["id", "position", "text", "block_md5"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(page)).where(F.col(page).isNotNull()).mapInArrow(run, "id long, position int, text string, block_md5 string")
