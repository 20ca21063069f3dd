"""Duplicates hidden by formatting: one record per statement and the number of its copies.

Pass 1 builds two Bloom filters in every partition, of the canonical hashes seen once and of those seen repeatedly,
and merges the partitions' filters chunk by chunk: ``once = A | B``, ``again = A' | B' | (A & B)``. Nothing that occurs
twice can escape ``again``. Pass 2 tests every row against it: rows that can't be repeats are singletons and aren't
shuffled; the others are collapsed within each Arrow batch and grouped exactly by their whole canonical text.

The canonical texts are worked out once and kept in a table of the shared folder, which both passes read.

Bounds: the filter sent to the executors has at most ``max_bits`` bits; beyond that many keys the hash space is worked
off in several rounds, each with a filter of its own and, as the table is laid out by rounds, rows of its own. Groups with a large share of all rows are joined by broadcast of
their (countably few) keys, see :mod:`loomtab.operators.skew`.

Defined cases: null equals empty text; rows with equal ids are one row; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtab.operators.skew import join_groups
from loomtab.session import cut, cut_counted

CHUNK = 1 << 15  # bytes of a filter that are merged together
PROBES = 5


def letters(c: Column) -> Column:
    """Lower-case letters and digits of a text, without white space and punctuation; null counts as empty."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}\p{M}]+", "")


def endpoint_key(c: Column) -> Column:
    """A (name, url) endpoint in either order, without formatting; a blank url differs from a given one."""
    s = F.lower(F.coalesce(c, F.lit("")))
    address = r"https?://[^\s'\"‘’“”|,，\[\]［］()（）]+"
    return F.concat(letters(F.regexp_replace(s, address, "")), F.lit("\x01"), letters(F.regexp_extract(s, f"({address})", 1)))


_ADDRESS = re.compile(r"https?://[^\s'\"‘’“”|,，\[\]［］()（）]+")


def _letters(s: str) -> str:
    return "".join(c for c in s if c.isalnum() or unicodedata.category(c)[0] == "M") if not s.isalnum() else s


def _endpoint(s: str | None) -> str:
    s = (s or "").lower()
    m = _ADDRESS.search(s)
    return _letters(_ADDRESS.sub("", s)) + "\x01" + (_letters(m[0]) if m else "")


def statements(df: DataFrame, id_col: str, c0: str, rel: str, c2: str) -> DataFrame:
    """(id, key) with the canonical text of each (endpoint, relation, endpoint).

    The same as :func:`endpoint_key` and :func:`letters`, but each different text of an Arrow batch is worked on once: the
    endpoints of a hot person, a third of all perhaps, cost next to nothing.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            cols = []
            for j, f in ((1, _endpoint), (2, lambda s: _letters((s or "").lower())), (3, _endpoint)):
                d = pc.dictionary_encode(b.column(j), null_encoding="encode")
                cols.append(pa.array([f(t) for t in d.dictionary.to_pylist()], pa.string()).take(d.indices))
            yield pa.RecordBatch.from_arrays([b.column(0), pc.binary_join_element_wise(*cols, "\x02")], ["id", "key"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(c0), F.col(rel), F.col(c2)).mapInArrow(run, "id long, key string")


def _positions(h: np.ndarray, bits: int) -> np.ndarray:
    mask = np.uint64(bits - 1)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([(h + np.uint64(i) * step) & mask for i in range(PROBES)])


def _test(f: np.ndarray, pos: np.ndarray) -> np.ndarray:
    return ((f[(pos >> np.uint64(3)).astype(np.int64)] >> (pos & np.uint64(7)).astype(np.uint8)) & 1).astype(bool).all(axis=0)


def _set(f: np.ndarray, pos: np.ndarray) -> None:
    p = np.sort(pos.ravel())
    byte = (p >> np.uint64(3)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], byte[1:] != byte[:-1]))) if len(p) else np.zeros(0, np.int64)
    if len(first):
        f[byte[first]] |= np.bitwise_or.reduceat((1 << (p & np.uint64(7)).astype(np.uint8)).astype(np.uint8), first)


class TwoFilters:
    """Hashes seen at least once, and (with all of them, perhaps some more) those seen at least twice."""

    def __init__(self, bits: int):
        self.bits = bits
        self.once = np.zeros(bits // 8, np.uint8)
        self.again = np.zeros(bits // 8, np.uint8)

    def add(self, h: np.ndarray) -> None:
        u, n = np.unique(h, return_counts=True)
        pos = _positions(u, self.bits)
        _set(self.again, pos[:, (n > 1) | _test(self.once, pos)])
        _set(self.once, pos)


def repeat_filter(hashes: DataFrame, bits: int) -> bytes:
    """The merged filter of repeatedly seen hashes (column h) as ``bits / 8`` bytes."""
    step = min(CHUNK, bits // 8)

    def build(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two = TwoFilters(bits)
        for b in it:
            two.add(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
        for c in range(bits // 8 // step):
            a = two.once[c * step : (c + 1) * step]
            if a.any():
                r = two.again[c * step : (c + 1) * step]
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([zlib.compress(a.tobytes(), 1)]), pa.array([zlib.compress(r.tobytes(), 1)])], ["chunk", "once", "again"])

    def merge(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, once, again = None, None, None

        def out():
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([zlib.compress(again.tobytes(), 1)])], ["chunk", "again"])

        for b in it:
            for c, o, r in zip(*(x.to_pylist() for x in b.columns)):
                o, r = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (o, r))
                if c != at:
                    if at is not None:
                        yield out()
                    at, once, again = c, o.copy(), r.copy()
                else:
                    again |= r | (once & o)
                    once |= o
        if at is not None:
            yield out()

    parts = hashes.select("h").mapInArrow(build, "chunk int, once binary, again binary")
    merged = parts.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(merge, "chunk int, again binary")
    whole = bytearray(bits // 8)
    for r in merged.collect():  # as a whole no more than the bound of the filter
        whole[r["chunk"] * step : (r["chunk"] + 1) * step] = zlib.decompress(r["again"])
    return bytes(whole)


def _split(rows: DataFrame, total: int, max_bits: int, bits_a_key: int) -> DataFrame:
    """Rows (id, key) as batches' groups (key, first_id, ids, n, maybe): maybe = possibly repeated."""
    rounds = max(1, -(-total * bits_a_key // max_bits))
    share = -(-total * bits_a_key // rounds)
    bits = min(max_bits, 1 << max(13, (max(1, share) - 1).bit_length()))
    hashed = rows.select("id", "key", F.xxhash64("key").alias("h"))
    if rounds > 1:  # laid out by rounds once, so that each reads its own rows only
        hashed = cut_counted(hashed.withColumn("round", F.pmod(F.shiftright("h", 7), F.lit(rounds)).cast("int")), "round")[0]
    out = None
    for r in range(rounds):
        mine = (hashed.where(F.col("round") == r) if rounds > 1 else hashed).select("id", "key", "h")
        held = rows.sparkSession.sparkContext.broadcast(repeat_filter(mine, bits))

        def test(it: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            f = np.frombuffer(held.value, np.uint8)
            for b in it:
                h = b.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
                maybe = _test(f, _positions(h, bits))
                ids = b.column(0).to_numpy(zero_copy_only=False)
                lone = np.flatnonzero(~maybe)
                groups: dict[str, list[int]] = {}
                for i in np.flatnonzero(maybe).tolist():
                    groups.setdefault(b.column(1)[i].as_py(), []).append(int(ids[i]))
                keys = pa.concat_arrays([b.column(1).take(pa.array(lone)).cast(pa.string()), pa.array(list(groups), pa.string())])
                lists = [[int(x)] for x in ids[lone]] + list(groups.values())
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array([min(x) for x in lists], pa.int64()), pa.array(lists, pa.list_(pa.int64())), pa.array([len(set(x)) for x in lists], pa.int64()), pa.array([False] * len(lone) + [True] * len(groups))],
                    ["key", "first_id", "ids", "n", "maybe"],
                )

        part = mine.mapInArrow(test, "key string, first_id long, ids array<long>, n long, maybe boolean")
        out = part if out is None else out.unionByName(part)
    return out


def collapse(df: DataFrame, key: Column, id_col: str, max_bits: int = 1 << 27, bits_a_key: int = 8) -> DataFrame:
    """One row per statement: keep_id (the lowest id) and copies (the number of its rows)."""
    rows, total = cut_counted(df.select(F.col(id_col).cast("long").alias("id"), key.alias("key")))
    got = _split(rows, total, max_bits, bits_a_key)
    lone = got.where("not maybe").select(F.col("first_id").alias("keep_id"), F.lit(1).cast("long").alias("copies"))
    groups = got.where("maybe").groupBy("key").agg(F.min("first_id").alias("keep_id"), F.sum("n").alias("copies"))
    return lone.unionByName(groups.select("keep_id", "copies"))


def copies(df: DataFrame, key: Column, id_col: str, max_bits: int = 1 << 27, bits_a_key: int = 8) -> DataFrame:
    """(keep_id, copy_id) for every row that states the same as one with a lower id."""
    rows, total = cut_counted(df.select(F.col(id_col).cast("long").alias("id"), key.alias("key")))
    possible = cut(_split(rows, total, max_bits, bits_a_key).where("maybe").select("key", "ids", "first_id", "n"))
    groups = possible.groupBy("key").agg(F.min("first_id").alias("keep_id"), F.sum("n").alias("size")).where("size > 1")
    pairs = join_groups(possible.select("key", "ids"), groups, "key", "size", total)
    return pairs.select("keep_id", F.explode("ids").alias("copy_id")).where("copy_id > keep_id")
