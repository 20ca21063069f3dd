"""Pages into a cell relation and links: the only place where markup is parsed.

``parse_tables`` reads (page_id, url, html) and writes one row per slot of every table's dense grid; everything behind it
is plain DataFrame code. A page that can't be parsed gives one row with ``error`` set instead of ending the job.
Null and blank pages give no row; markup needn't be closed; spans that reach beyond the table end with it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtab.config import DEFAULT, INFO, Config
from loomtab.functions.names import MARKUP
from loomtab.functions.urls import decode_percent

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CLOSES = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody"}, {"table"}), "p": ({"p"}, {"div", "td", "li", "section", "body"}),
}


class Tag:
    __slots__ = ("name", "attrs", "parent", "kids")

    def __init__(self, name: str, attrs: dict[str, str], parent: "Tag | None"):
        self.name, self.attrs, self.parent, self.kids = name, attrs, parent, []

    def walk(self) -> Iterator["Tag"]:
        stack = [k for k in reversed(self.kids) if isinstance(k, Tag)]
        while stack:
            t = stack.pop()
            yield t
            stack.extend(k for k in reversed(t.kids) if isinstance(k, Tag))

    def tags(self) -> list["Tag"]:
        return [k for k in self.kids if isinstance(k, Tag)]

    def text(self, breaks: str = "") -> str:
        out: list[str] = []
        stack: list = [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            elif x.name == "br":
                out.append(breaks)
            else:
                stack.extend(reversed(x.kids))
        return "".join(out)

    def classes(self) -> str:
        return self.attrs.get("class") or ""


class _Builder(HTMLParser):
    def __init__(self, drop: frozenset[str]):
        super().__init__(convert_charrefs=True)
        self.root = Tag("", {}, None)
        self.node, self.drop, self.hidden = self.root, drop, 0

    def handle_starttag(self, tag, attrs):
        if self.hidden:
            self.hidden += tag in self.drop
            return
        if tag in self.drop:
            self.hidden = 1
            return
        if tag in CLOSES:
            ends, bound = CLOSES[tag]
            up = self.node
            while up.parent is not None and up.name not in ends and up.name not in bound:
                up = up.parent
            if up.name in ends:
                self.node = up.parent
        t = Tag(tag, {k: v or "" for k, v in attrs}, self.node)
        self.node.kids.append(t)
        if tag not in VOID:
            self.node = t

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and not self.hidden:
            self.node = self.node.parent or self.root

    def handle_endtag(self, tag):
        if self.hidden:
            self.hidden -= tag in self.drop
            return
        up = self.node
        while up.parent is not None and up.name != tag:
            up = up.parent
        if up.parent is not None:
            self.node = up.parent

    def handle_data(self, data):
        if not self.hidden:
            self.node.kids.append(data)


def dom(page: str, drop: tuple[str, ...] = DEFAULT.drop_tags) -> Tag:
    b = _Builder(frozenset(drop))
    b.feed(page.replace("\r", "").replace("\t", "").replace("\n", ""))
    b.close()
    return b.root


_MARKUP = re.compile(MARKUP)


def unescape_at_rest(page: str) -> str:
    """A stored page, unescaped until markup appears or nothing changes."""
    while not _MARKUP.search(page):
        plain = unescape(page)
        if plain == page:
            break
        page = plain
    return page


def page_name(url: str | None) -> str:
    """Last part of the path, or the one before a number, decoded."""
    parts = (url or "").split("/")
    last = parts[-1]
    if last.isdigit() and len(parts) > 1:
        last = parts[-2]
    return unquote(last)


_NOTE = re.compile(r"\[\d+\]")


def _clean(s: str) -> str:
    return _NOTE.sub("", s).replace("\xa0", "")


def _cell(t: Tag, config: Config) -> dict:
    links, images = {}, []
    for x in t.walk():
        if x.name == "a" and x.attrs.get("href"):
            links.setdefault(_clean(x.text()), config.host + x.attrs["href"])
        elif x.name == "img" and x.attrs.get("src"):
            images.append(x.attrs["src"])

    def span(k: str, most: int) -> int:  # the bounds of the public standard for tables
        v = t.attrs.get(k, "").strip()
        return min(max(1, int(v)), most) if v.isdecimal() else 1

    return {"content": _clean(t.text()), "tag": t.name, "rs": span("rowspan", 65534), "cs": span("colspan", 1000), "links": links, "images": images}


def _rows(table: Tag) -> list[list[Tag]]:
    out = []
    for t in table.walk():
        if t.name == "tr":
            up = t.parent
            while up is not None and up.name != "table":
                up = up.parent
            if up is table:
                out.append([c for c in t.tags() if c.name in ("td", "th")])
    return [r for r in out if r]


def _caption(table: Tag, config: Config) -> str:
    for t in table.tags():
        if t.name == "caption":
            return t.text().strip()
    if table.parent is None:
        return config.unnamed
    around = table.parent.tags()
    before = around[: around.index(table)][::-1][:2]
    for k, s in enumerate(before):
        if "title" in s.classes():
            return s.text().strip()
        if k == 0:
            only = s.tags()
            if len(only) == 1 and 0 < len(only[0].text().strip()) < 20:
                return only[0].text().strip()
    return config.unnamed


def measures(table: Tag) -> dict[str, int]:
    """What the heuristics look at."""
    rows = _rows(table)
    inner = list(table.walk())
    first = "".join(c.text() for r in rows[:2] for c in r)
    return {
        "n_rows": len(rows), "n_cols": max((len(r) for r in rows), default=0), "links": sum(t.name == "a" for t in inner), "nested": sum(t.name == "table" for t in inner),
        "scripts": sum(t.name == "script" for t in inner), "images": sum(t.name == "img" for t in inner), "words": int(any(c.isalpha() for c in first)),
    }


def passes(m: dict[str, int]) -> tuple[bool, bool, bool]:
    """Shape, density and wording rules."""
    area = m["n_rows"] * m["n_cols"]
    dense = m["links"] > 2 * area or m["nested"] > 3 or m["scripts"] > 1 or m["images"] > area / 2
    return m["n_rows"] >= 2 and m["n_cols"] >= 2, not dense, bool(m["words"])


def locate(root: Tag, url: str | None, config: Config = DEFAULT) -> list[dict]:
    """Tables of a page in order: infobox, list tables, tables that pass the rules."""
    found = []
    name = page_name(url)
    wanted = set(config.infobox_class.split())
    for box in (t for t in root.walk() if wanted and wanted <= set(t.classes().split())):
        inner = [box, *box.walk()]
        dt, dd = [t for t in inner if t.name == "dt"], [t for t in inner if t.name == "dd"]
        if dt and len(dt) == len(dd):
            rows = [[{"content": _clean(x.text("/")).strip(), "tag": x.name, "rs": 1, "cs": 1, "links": {}, "images": []} for x in r] for r in zip(dt, dd)]
            preset = None
            if rows[0][0]["content"] in config.info_names:
                preset = INFO
                rows[0][1]["links"] = {rows[0][1]["content"]: url or ""}
            found.append({"kind": "infobox", "caption": config.unnamed, "preset": preset, "rows": rows, "m": None})
    if config.list_tables:
        titles = [t for t in root.walk() if t.classes() == "normal title-td"]
        lists = [t for t in root.walk() if t.name == "ul"]
        if titles and len(titles) == len(lists):
            for title, ul in zip(titles, lists):
                rows = []
                for li in (t for t in ul.tags() if t.name == "li"):
                    cells = []
                    for s in (t for t in li.walk() if t.name == "span" and t.text().strip() != "▪"):
                        cells.append({"content": _clean(s.text()), "tag": "span", "rs": 1, "cs": 1, "links": {a.text(): a.attrs.get("href", "") for a in s.walk() if a.name == "a"}, "images": []})
                    if cells:
                        rows.append(cells)
                found.append({"kind": "list", "caption": title.text().strip(), "preset": None, "rows": rows, "m": None})
    for t in root.walk():
        if t.name == "table":
            m = measures(t)
            if all(passes(m)):
                found.append({"kind": "table", "caption": _caption(t, config), "preset": None, "rows": [[_cell(c, config) for c in r] for r in _rows(t)], "m": m})
    for f in found:
        f["prefix"] = name
    return found


def grid(rows: list[list[dict]]) -> list[tuple[int, int, bool, dict]]:
    """Slots (row, col, is the cell's own place, cell) of a table by the slot algorithm of HTML."""
    taken: dict[tuple[int, int], tuple[bool, dict]] = {}
    for r, row in enumerate(rows):
        c = 0
        for cell in row:
            while (r, c) in taken:
                c += 1
            for i in range(min(cell["rs"], len(rows) - r)):
                for j in range(cell["cs"]):
                    taken.setdefault((r + i, c + j), (i == 0 and j == 0, cell))
            c += cell["cs"]
    return [(r, c, own, cell) for (r, c), (own, cell) in sorted(taken.items(), key=lambda x: x[0])]


CELLS = "page_id long, table_id int, kind string, caption string, prefix string, preset string, row int, col int, anchor boolean, rowspan int, colspan int, content string, tag string, links map<string,string>, images array<string>, error string"
_ARROW = pa.schema([
    ("page_id", pa.int64()), ("table_id", pa.int32()), ("kind", pa.string()), ("caption", pa.string()), ("prefix", pa.string()), ("preset", pa.string()), ("row", pa.int32()), ("col", pa.int32()), ("anchor", pa.bool_()),
    ("rowspan", pa.int32()), ("colspan", pa.int32()), ("content", pa.string()), ("tag", pa.string()), ("links", pa.map_(pa.string(), pa.string())), ("images", pa.list_(pa.string())), ("error", pa.string()),
])


def _over_pages(pages: DataFrame, make, schema: str, arrow: pa.Schema, id_col: str, url: str, html: str) -> DataFrame:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                rows: list[tuple] = []
                for i, u, h in zip(*(c.to_pylist() for c in part.columns)):
                    if h and h.strip():
                        rows += make(i, u, unescape_at_rest(h))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(arrow.types)], schema=arrow)

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html")).mapInArrow(run, schema)


def parse_tables(pages: DataFrame, config: Config = DEFAULT, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    def make(i: int, u: str | None, h: str) -> list[tuple]:
        try:
            out = []
            for k, t in enumerate(locate(dom(h, config.drop_tags), u, config)):
                for r, c, own, cell in grid(t["rows"]):
                    out.append((i, k, t["kind"], t["caption"], t["prefix"], t["preset"], r, c, own, cell["rs"], cell["cs"], cell["content"], cell["tag"], list(cell["links"].items()), cell["images"], None))
            return out
        except Exception as e:  # one page must not end the job
            return [(i, *[None] * 12, None, None, repr(e)[:500])]

    return _over_pages(pages, make, CELLS, _ARROW, id_col, url, html)


def table_measures(pages: DataFrame, config: Config = DEFAULT, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, table_no, n_rows, n_cols, links, images, shape, density, words) of every table tag."""
    arrow = pa.schema([("page_id", pa.int64()), *[(k, pa.int32()) for k in ("table_no", "n_rows", "n_cols", "links", "images")], *[(k, pa.bool_()) for k in ("shape_ok", "density_ok", "words_ok")]])

    def make(i: int, u: str | None, h: str) -> list[tuple]:
        try:
            out = []
            for k, t in enumerate(x for x in dom(h, config.drop_tags).walk() if x.name == "table"):
                m = measures(t)
                out.append((i, k, m["n_rows"], m["n_cols"], m["links"], m["images"], *passes(m)))
            return out
        except Exception:  # a page that can't be parsed has no tables to measure; parse_tables reports it
            return []

    return _over_pages(pages, make, "page_id long, table_no int, n_rows int, n_cols int, links int, images int, shape_ok boolean, density_ok boolean, words_ok boolean", arrow, id_col, url, html)


# ---- text-level operators --------------------------------------------------------------------------------------------
def strip_breaks(html: Column) -> Column:
    return F.translate(html, "\r\t\n", "")


def drop_blocks(html: Column, tags: tuple[str, ...] = ("script", "style", "article", "code")) -> Column:
    c = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    for t in tags:
        c = F.regexp_replace(c, rf"(?is)<{t}\b[^>]*>.*?</{t}\s*>", "")
    return c


def tag_document(body: Column, title: Column) -> Column:
    """A fragment as a document of its own."""
    return F.concat(F.lit('<!DOCTYPE html><html><head><meta charset="utf-8"><title>'), title, F.lit("</title></head><body>"), body, F.lit("</body></html>"))


def name_of_page(url: Column) -> Column:
    parts = F.split(url, "/")
    last = F.element_at(parts, -1)
    return decode_percent(F.when(last.rlike(r"^\d+$"), F.try_element_at(parts, F.lit(-2))).otherwise(last))
