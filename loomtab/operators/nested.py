"""Deeply nested semi-structured text into linked flat rows.

The bytes of a whole batch of fields are indexed at once with numpy: bitmaps of backslashes, quotes and structural
characters; strings masked by the parity (prefix sum) of unescaped quotes; nesting depth by the prefix sum of opening
and closing brackets; the parent of a token by search among the opening brackets of its level; positions by counting
the commas of a level. Only spans of values, never single characters, are touched by Python code.

A field may hold one document or several behind each other; a document may be JSON, the same text escaped for HTML,
a JSON string holding a document, or the printed form of Python lists; the lists of items may be wrapped in objects.
Items are found by their shape: ``[[name, url], {attributes}]`` for entities and ``[[name, url], relation, [name, url]]``
for relationships.

Defined cases: null, blank and incomplete (cut off, unbalanced) fields give no row; ``null`` and empty lists or objects
give no leaf; of a key repeated in an object the last value counts; numbers and booleans are given as their text; a
repeated row gives its own rows; extra columns are ignored.
"""

from __future__ import annotations

import ast
import functools
import html
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAF_SCHEMA = "id long, field string, item_no long, path string, value string, kind string, name string, url string, to_name string, to_url string"
_OPEN_OF = {ord("]"): ord("["), ord("}"): ord("{")}
_CLASS = np.zeros(256, np.uint8)  # 1 open, 2 close, 3 comma, 4 colon, 5 white space
for _c, _k in (("[{", 1), ("]}", 2), (",", 3), (":", 4), (" \t\r\n", 5)):
    for _x in _c:
        _CLASS[ord(_x)] = _k
STRING, SCALAR = 6, 7


class Index:
    """Structural index of a buffer of fields. Tokens are in order; arrays are parallel to them."""

    def __init__(self, fields: list[bytes], quote: bytes):
        lens = np.fromiter((len(f) for f in fields), np.int64, len(fields))
        self.start = np.zeros(len(fields) + 1, np.int64)
        np.cumsum(lens + 1, out=self.start[1:])
        self.raw = b"\n".join(fields) + b"\n"
        buf = np.frombuffer(self.raw, np.uint8)
        n = len(buf)
        at = np.arange(n)
        slash = buf == 0x5C
        is_quote = buf == quote[0]
        if slash.any():  # a character is escaped behind an odd run of backslashes
            last = np.maximum.accumulate(np.where(slash, -1, at))
            run = np.zeros(n, np.int64)
            run[1:] = (at - last)[:-1]
            is_quote &= run % 2 == 0
        q = np.flatnonzero(is_quote)
        before = np.searchsorted(q, self.start)  # quotes before each field
        owner = np.searchsorted(self.start, q, "right") - 1
        rank = np.arange(len(q)) - before[owner]
        self.odd = np.diff(before) % 2 == 1
        opening = q[rank % 2 == 0]
        toggles = np.zeros(n + 1, np.int32)
        toggles[opening] += 1
        closing = q[rank % 2 == 1]
        toggles[closing + 1] -= 1
        ends = self.start[1:][self.odd]
        toggles[ends] -= 1  # an unclosed string ends with its field
        inside = np.cumsum(toggles[:-1]) > 0
        kind = _CLASS[buf]
        kind[inside] = 5
        kind[opening] = STRING
        plain = (kind == 0) & ~inside
        first = plain.copy()
        first[1:] &= ~plain[:-1]
        kind[plain & ~first] = 5
        kind[first] = SCALAR
        self.tok = np.flatnonzero(kind != 5)
        self.kind = kind[self.tok]
        self.byte = buf[self.tok]
        self.field = np.searchsorted(self.start, self.tok, "right") - 1
        step = (self.kind == 1).astype(np.int64) - (self.kind == 2)
        depth = np.cumsum(step)
        base = np.concatenate(([0], depth))[np.searchsorted(self.tok, self.start[:-1])]
        depth_after = depth - base[self.field]
        self.level = depth_after - step  # for an opening bracket the level outside
        self.level[self.kind == 2] -= 1  # a closing bracket belongs to the level outside too
        final = np.zeros(len(fields), np.int64)
        np.add.at(final, self.field, step)
        low = np.zeros(len(fields), np.int64)
        np.minimum.at(low, self.field, depth_after)
        self.ok = (final == 0) & (low >= 0) & ~self.odd
        shut = np.append(closing, n)  # for a string token the place of its closing quote
        self.end = shut[np.searchsorted(shut, self.tok, "right").clip(max=len(closing))]
        self.plain = plain
        self._link()

    def _link(self) -> None:
        t = len(self.tok)
        self.parent = np.full(t, -1, np.int64)
        self.number = np.zeros(t, np.int64)
        good = self.ok[self.field]
        for lv in range(int(self.level[good].max(initial=0)) + 1):
            mine = np.flatnonzero(good & (self.level == lv))
            commas = mine[self.kind[mine] == 3]
            if lv:
                outer = np.flatnonzero(good & (self.level == lv - 1) & (self.kind == 1))
                p = outer[np.searchsorted(outer, mine) - 1]
                self.parent[mine] = p
                self.number[mine] = np.searchsorted(commas, mine) - np.searchsorted(commas, p)
        # brackets of a pair must be of one kind: the opening one is the last of its level
        closes = np.flatnonzero(good & (self.kind == 2))
        for lv in np.unique(self.level[closes]):
            own = closes[self.level[closes] == lv]
            opens = np.flatnonzero(good & (self.level == lv) & (self.kind == 1))
            mate = opens[np.searchsorted(opens, own) - 1]
            wrong = np.where(self.byte[own] == ord("]"), ord("["), ord("{")) != self.byte[mate]
            self.ok[self.field[own[wrong]]] = False

    def text(self, k: int) -> bytes:
        """The bytes of a string (without quotes) or scalar token."""
        a = int(self.tok[k])
        if self.kind[k] == STRING:
            return self.raw[a + 1 : int(self.end[k])]
        b = a
        while self.plain[b]:
            b += 1
        return self.raw[a:b]


def _plain(raw: bytes, quote: bytes) -> str:
    if b"\\" not in raw:
        return raw.decode("utf-8", "replace")
    s = raw.decode("utf-8", "replace")
    try:
        if quote == b'"':
            return json.loads(f'"{s}"', strict=False)
        return ast.literal_eval(f"'{s}'")
    except (ValueError, SyntaxError):
        return s


_LITERALS = {"true": "boolean", "false": "boolean", "True": "boolean", "False": "boolean"}


def _flat(ix: Index, quote: bytes, want: str, keep: Callable[[str], bool] | None = None) -> list[list[tuple]]:
    """For each field its rows (doc order): (token of the item, path, value, kind, name, url, to_name, to_url)."""
    out: list[list[tuple]] = [[] for _ in ix.ok]
    good = ix.ok[ix.field]
    valueish = good & ((ix.kind == 1) | (ix.kind == STRING) | (ix.kind == SCALAR))
    nxt = np.concatenate((ix.kind[1:], [0]))
    is_key = valueish & (ix.kind == STRING) & (nxt == 4)
    vals = np.flatnonzero(valueish & ~is_key)
    # an array is an item if its values have the shape wanted
    par = ix.parent[vals]
    first = np.full(len(ix.tok) + 1, -1, np.int64)
    second, third = first.copy(), first.copy()
    size = np.zeros(len(ix.tok) + 1, np.int64)
    np.add.at(size, par[par >= 0], 1)
    inside = par >= 0
    for k, slot in enumerate((first, second, third)):
        pick = inside & (ix.number[vals] == k)
        slot[par[pick]] = vals[pick]
    arr = np.flatnonzero(good & (ix.byte == ord("[")) & (ix.kind == 1))

    def opens(slot: np.ndarray, ch: str) -> np.ndarray:
        s = slot[arr]
        return (s >= 0) & (ix.kind[s] == 1) & (ix.byte[s] == ord(ch))

    if want == "entity":
        shape = (size[arr] == 2) & opens(first, "[") & opens(second, "{")
    else:
        s2 = second[arr]
        shape = (size[arr] == 3) & opens(first, "[") & opens(third, "[") & (s2 >= 0) & ((ix.kind[s2] == STRING) | (ix.kind[s2] == SCALAR))
    root = np.full(len(ix.tok), -1, np.int64)  # the item over a token
    root[arr[shape]] = arr[shape]
    for lv in range(1, int(ix.level[good].max(initial=0)) + 1):
        mine = np.flatnonzero(good & (ix.level == lv))
        p = ix.parent[mine]
        up = root[p]
        root[mine] = np.where(up >= 0, up, root[mine])
    item_of = arr[shape]
    item_of = item_of[root[item_of] == item_of]
    item_of = item_of[(ix.parent[item_of] < 0) | (root[ix.parent[item_of]] < 0)]

    def scalar(k: int) -> str | None:
        if k < 0 or ix.kind[k] == 1:
            return None
        raw = ix.text(k)
        if ix.kind[k] == STRING:
            return _plain(raw, quote)
        s = raw.decode("utf-8", "replace")
        return None if s in ("null", "None") else s

    def scalars(ks: np.ndarray) -> list[str | None]:
        """:func:`scalar` of many tokens."""
        text = zip(ks.tolist(), ((ks >= 0) & (ix.kind[ks] == STRING)).tolist(), (ix.tok[ks] + 1).tolist(), ix.end[ks].tolist())
        return [_plain(ix.raw[a:b], quote) if string else scalar(k) for k, string, a, b in text]

    def pairs(ks: np.ndarray) -> Iterator[tuple[str | None, str | None]]:
        return zip(scalars(first[ks]), scalars(second[ks]))

    if not len(item_of):
        return out
    if want == "relationship":
        for k, f, rel, a, b in zip(item_of.tolist(), ix.field[item_of].tolist(), scalars(second[item_of]), pairs(first[item_of]), pairs(third[item_of])):
            out[f].append((k, rel if rel is not None else "", rel, "relation", *a, *b))
        return out

    is_item = np.zeros(len(ix.tok), bool)
    is_item[item_of] = True
    attrs = {int(second[k]): int(k) for k in item_of.tolist()}
    heads = dict(zip(item_of.tolist(), pairs(first[item_of])))
    rooted = vals[(root[vals] >= 0)]
    rooted = rooted[is_item[root[rooted]]]
    members: dict[int, dict] = {}
    over, names = ix.parent[rooted], {b"": ""}
    keyed = (ix.byte[over] == ord("{")) & (rooted >= 2) & (ix.kind[rooted - 1] == 4)
    quoted = keyed & (ix.kind[rooted - 2] == STRING)
    start, end = np.where(quoted, ix.tok[rooted - 2] + 1, -1), np.where(quoted, ix.end[rooted - 2], 0)
    start[~keyed] = 0
    numbers = np.where(ix.byte[over] == ord("{"), -1, ix.number[rooted])
    for k, p, number, a, b, nests in zip(rooted.tolist(), over.tolist(), numbers.tolist(), start.tolist(), end.tolist(), (ix.kind[rooted] == 1).tolist()):
        key = number  # in order, so that the last of a repeated key stays
        if number < 0 and (key := names.get(raw := ix.raw[a:b] if a >= 0 else ix.text(k - 2))) is None:
            key = names[raw] = _plain(raw, quote)
        members.setdefault(p, {})[key] = ~k if nests else k
    for obj, item in attrs.items():
        rows, stack = out[ix.field[item]], [(obj, "")]
        name, url = heads[item]
        leaves = []
        while stack:
            c, path = stack.pop()
            for key, k in members.get(c, {}).items():
                here = f"{path}[{key}]" if isinstance(key, int) else (f"{path}.{key}" if path else key)
                if k < 0:
                    stack.append((~k, here))
                elif keep is None or keep(here):
                    v = scalar(k)
                    if v is not None:
                        kind = "string" if ix.kind[k] == STRING else _LITERALS.get(v, "number")
                        leaves.append((k, here, v, kind))
        leaves.sort()
        rows.append((item, None, None, "item", name, url, None, None))
        rows += [(item, here, v, kind, name, url, None, None) for _, here, v, kind in leaves]
    for rows in out:
        rows.sort(key=lambda r: r[0])  # stable: leaves stay behind their item
    return out


_ESCAPED = re.compile(r"&(?:quot|#34|#x22|#39|#x27|amp|lt|gt);")


def _repr_to_json(s: str) -> str | None:
    """Exact slow path for printed Python lists that mix both kinds of quotes; None if incomplete."""
    out, at = [], 0
    try:
        while at < len(s):
            if s[at].isspace():
                at += 1
                continue
            depth, i, q = 0, at, ""
            while i < len(s):
                c = s[i]
                if q:
                    if c == "\\":
                        i += 1
                    elif c == q:
                        q = ""
                elif c in "'\"":
                    q = c
                elif c in "[{(":
                    depth += 1
                elif c in "]})":
                    depth -= 1
                    if depth == 0:
                        break
                i += 1
            out.append(json.dumps(ast.literal_eval(s[at : i + 1]), ensure_ascii=False))
            at = i + 1
    except (ValueError, SyntaxError, RecursionError, MemoryError):
        return None
    return " ".join(out)


def parse_fields(texts: list[str | None], want: str, keep: Callable[[str], bool] | None = None) -> list[list[tuple]]:
    """Rows of each text, as in :func:`_flat` with the item's number in place of its token."""
    result: list[list[tuple]] = [[] for _ in texts]
    groups: dict[bytes, list[tuple[int, bytes]]] = {b'"': [], b"'": []}
    for i, s in enumerate(texts):
        if s is None or not s.strip():
            continue
        if '"' not in s and _ESCAPED.search(s):
            s = html.unescape(s)
        m = re.search("[\"']", s)
        quote = b"'" if m and m[0] == "'" else b'"'
        if quote == b"'" and ('"' in s or "\\" in s):
            s, quote = _repr_to_json(s), b'"'
            if s is None:
                continue
        groups[quote].append((i, s.replace("\n", " ").encode("utf-8", "replace")))
    for quote, fields in groups.items():
        if not fields:
            continue
        ix = Index([b for _, b in fields], quote)
        rows = _flat(ix, quote, want, keep)
        whole: dict[int, list[tuple[int, str]]] = {}
        loose = np.flatnonzero(ix.ok[ix.field] & (ix.level == 0) & (ix.kind == STRING))
        for k in loose.tolist():
            whole.setdefault(int(ix.field[k]), []).append((k, _plain(ix.text(k), quote)))
        inner = [(f, k, s) for f, ks in whole.items() for k, s in ks]
        parsed = _documents([s for _, _, s in inner], want, keep) if inner else []
        bad = set()
        for (f, k, _), got in zip(inner, parsed):
            if got is None:
                bad.add(f)
            else:
                rows[f] += [((k, r[0]), *r[1:]) for r in got]
        for f, (i, _) in enumerate(fields):
            if f in bad or not ix.ok[f]:
                continue
            own = sorted(rows[f], key=lambda r: r[0] if isinstance(r[0], tuple) else (r[0], -1)) if f in whole else rows[f]
            number, last = -1, None
            for r in own:
                if want == "relationship" or r[3] == "item" or r[0] != last:
                    number += 1
                last = r[0]
                result[i].append((number, *r[1:]))
    return result


def _documents(texts: list[str], want: str, keep: Callable[[str], bool] | None) -> list[list[tuple] | None]:
    """Documents held in strings; None for one that isn't complete."""
    got = parse_fields(texts, want, keep)
    out: list[list[tuple] | None] = []
    for s, rows in zip(texts, got):
        if rows or not s.strip():
            out.append(rows)
        else:
            quote = b"'" if (m := re.search("[\"']", s)) and m[0] == "'" else b'"'
            out.append([] if Index([s.replace("\n", " ").encode("utf-8", "replace")], quote).ok[0] else None)
    return out


def flatten(df: DataFrame, id_col: str, fields: dict[str, str], paths: str | None = None) -> DataFrame:
    """All rows of the nested fields. ``fields``: {column: 'entity' or 'relationship'}.

    ``paths``: only leaves whose path this pattern matches are read and sent; items and relations come whatever their attributes.
    """
    names = list(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = functools.lru_cache(1 << 16)(re.compile(paths).search) if paths else None
        schema = pa.schema([("id", pa.int64()), ("field", pa.string()), ("item_no", pa.int64()), *[(c, pa.string()) for c in ("path", "value", "kind", "name", "url", "to_name", "to_url")]])
        for b in batches:
            for at in range(0, b.num_rows, 256):  # bounds the index of very long fields
                part = b.slice(at, 256)
                ids = part.column(0).to_pylist()
                cols: list[list] = [[] for _ in range(10)]
                for k, f in enumerate(names):
                    for i, rows in zip(ids, parse_fields(part.column(1 + k).to_pylist(), fields[f], keep)):
                        for r in rows:
                            for c, v in zip(cols, (i, f, *r)):
                                c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types)], schema=schema)

    return df.select(F.col(id_col).cast("long").alias("id"), *[F.col(f) for f in names]).mapInArrow(run, LEAF_SCHEMA)


def persons(flat: DataFrame) -> DataFrame:
    return flat.where("kind = 'item'").select("id", "item_no", "name", "url")


def attributes(flat: DataFrame) -> DataFrame:
    return flat.where("field = 'entity' and kind <> 'item'").select("id", "item_no", "path", "value", "kind")


def relations(flat: DataFrame) -> DataFrame:
    return flat.where("kind = 'relation'").select("id", "item_no", F.col("name").alias("c0_name"), F.col("url").alias("c0_url"), F.col("value").alias("rel"), F.col("to_name").alias("c2_name"), F.col("to_url").alias("c2_url"))
