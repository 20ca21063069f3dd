"""Evaluation texts leaking into training text.

The n-grams (four tokens) of the normalised test passages are broadcast as sorted hashes behind a bitmap. Those held by
at most ``COMMON`` passages are seeds: the token windows of every document are looked up among them. A pair of document
and passage whose seeds cover ``SEEDED`` of the passage is verified on all its n-grams: equal runs that follow each
other with little between them, in document and passage alike, form a chain. Chains of a few tokens, or of common
phrases only, are dropped, as is a place of the document whose chains hold no more than a sentence form filled with
other words; a document contains a passage if the other chains' runs cover at least ``least`` of its
tokens. Everything happens in the task that reads the document; there is no shuffle.

An instruction before a passage (the first clause, if at least ``shared`` passages begin with it) doesn't count.
``least`` is a little below a third since the n-grams over a changed word are lost.

Bounds: the broadcast set is bounded by ``block`` passages of bounded length a round; more passages take more rounds.

Defined cases: null, blank and very short texts contain nothing, a passage of fewer than four tokens is contained
nowhere; repeated documents and repeated passages count each; an empty table gives no row.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtab.functions.script import simplify_map
from loomtab.llm.tokens import Tokens, char_table

N = 4
LEAST = 0.3
#: Passages (of different content) that may hold a seed, and the part of a passage that seeds must cover before it is verified.
COMMON = 2
SEEDED = 0.15
#: Tokens that may lie between the runs of a chain, by how many their distance may differ, and a chain's least tokens, in all and of seeds.
GAP, SHIFT = 12, 3
CHAIN, OWN = 12, 8
#: Least tokens that neighbouring chains have together, or one of their runs alone: a sentence form that texts share has fewer.
REGION, RUN = 30, 20
_LEAD = re.compile(r"\s*(.+?[:：。.?？!！\n])", re.S)
BITS = 22


def without_instructions(texts: list[str], shared: int = 3) -> list[str]:
    """Passages without the leading clauses that several of them share; a passage never loses its last clause."""
    out = [t or "" for t in texts]
    while True:
        lead = [m if (m := _LEAD.match(t)) and t[m.end() :].strip() else None for t in out]
        n = Counter(m[1].strip().lower() for m in lead if m)
        cut = [m is not None and n[m[1].strip().lower()] >= shared for m in lead]
        if not any(cut):
            return out
        out = [t[m.end() :] if c else t for t, m, c in zip(out, lead, cut)]


class GramSet:
    """Hashes of the passages' n-grams with the (passage, position) pairs of each; seeds are those few passages hold."""

    def __init__(self, ids: list[int], texts: list[str], table: np.ndarray, n: int = N):
        t = Tokens(texts, table)
        self.ids = np.array(ids, np.int64)
        self.length = np.bincount(t.text, minlength=len(ids))
        g, at = t.grams(n)
        begin = np.searchsorted(t.text, np.arange(len(ids) + 1))
        content = np.unique([hash(t.hash[a:z].tobytes()) for a, z in zip(begin[:-1], begin[1:])], return_inverse=True)[1]
        order = np.argsort(g, kind="stable")
        gram, text = g[order], t.text[at][order]
        pos = at[order] - begin[text]
        which = np.cumsum(np.concatenate(([0], gram[1:] != gram[:-1])))[: len(gram)]
        held = np.unique(which * len(ids) + content[text]) // len(ids) if len(gram) else which
        seed = np.bincount(held, minlength=1)[which] <= COMMON
        self.gram, self.item, self.pos = gram[seed], text[seed].astype(np.int32), pos[seed].astype(np.int32)
        by_item = np.argsort(text, kind="stable")  # within a passage by hash
        self.all, self.all_pos, self.all_seed = gram[by_item], pos[by_item], seed[by_item]
        self.all_begin = np.searchsorted(text[by_item], np.arange(len(ids) + 1))
        self.n = n
        self.bitmap = np.zeros(1 << BITS, bool)
        self.bitmap[(self.gram >> np.uint64(64 - BITS)).astype(np.int64)] = True

    def seeded(self, text: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, item) whose seeds found cover enough of the item to be verified; text is that of each window."""
        near = np.flatnonzero(self.bitmap[(g >> np.uint64(64 - BITS)).astype(np.int64)])
        lo, many = _equal(self.gram, g[near])
        k = _places(lo, many)
        if not len(k):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        key = np.unique((np.repeat(text[near], many).astype(np.int64) * len(self.ids) + self.item[k]) << 32 | self.pos[k])
        group, p = key >> 32, key & 0xFFFFFFFF
        new = np.concatenate((np.flatnonzero(group[1:] != group[:-1]), [len(group) - 1]))
        step = np.full(len(p), self.n, np.int64)
        step[:-1] = np.minimum(self.n, p[1:] - p[:-1])
        step[new] = self.n
        first = np.concatenate(([0], new[:-1] + 1))
        pair = group[first]
        pair = pair[np.add.reduceat(step, first) >= SEEDED * self.length[pair % len(self.ids)]]
        return pair // len(self.ids), pair % len(self.ids)

    def aligned(self, g: np.ndarray, at: np.ndarray, item: int) -> tuple[float, list[tuple[int, int]]]:
        """Share of an item in the chains of a document with the windows g at the tokens at, and the chains' first and last tokens."""
        own = slice(self.all_begin[item], self.all_begin[item + 1])
        lo, many = _equal(self.all[own], g)
        k = _places(lo, many)
        tok, pos, seed = np.repeat(at, many), self.all_pos[own][k], self.all_seed[own][k]
        order = np.lexsort((tok, tok - pos))
        tok, pos, seed = tok[order], pos[order], seed[order]
        first = np.flatnonzero(np.concatenate(([True], (tok[1:] - tok[:-1] != 1) | (pos[1:] - pos[:-1] != 1))))
        last = np.concatenate((first[1:], [len(tok)])) - 1
        runs = sorted(zip(tok[first].tolist(), (tok[last] + self.n).tolist(), first.tolist(), (last + 1).tolist()))
        chains: list[list[tuple[int, int, int, int]]] = []
        live: list[tuple[list, int, int]] = []  # chain, end and diagonal of its last runs
        for run in runs:
            a, z, f, _ = run
            shift = a - int(pos[f])
            live = [x for x in live if a - x[1] <= GAP]
            mine = None
            for chain, _, s in live:
                if abs(s - shift) <= SHIFT and (mine is None or chain is not mine):
                    if mine is None:
                        mine = chain
                    else:  # the run joins two chains
                        mine.extend(chain)
                        chains = [c for c in chains if c is not chain]
                        live = [(mine if x[0] is chain else x[0], *x[1:]) for x in live]
            if mine is None:
                mine = []
                chains.append(mine)
            mine.append(run)
            live.append((mine, z, shift))
        length = int(self.length[item])
        kept = []
        for chain in chains:
            covered, rare = np.zeros(length, bool), np.zeros(length, bool)
            for _, _, f, e in chain:
                covered[pos[f] : pos[e - 1] + self.n] = True
                for p in pos[f:e][seed[f:e]]:
                    rare[p : p + self.n] = True
            if covered.sum() >= min(CHAIN, length) and rare.sum() >= min(OWN, length):
                kept.append((min(r[0] for r in chain), max(r[1] for r in chain), max(r[1] - r[0] for r in chain), covered))
        total = np.zeros(length, bool)
        kept.sort(key=lambda c: c[:3])
        spans = [(c[0], c[1] - 1) for c in kept]
        while kept:
            end, size = kept[0][1], 1
            while size < len(kept) and kept[size][0] - end <= 2 * GAP:
                end, size = max(end, kept[size][1]), size + 1
            part, kept = kept[:size], kept[size:]
            covered = np.logical_or.reduce([c[3] for c in part])
            if covered.sum() >= min(REGION, length) or max(c[2] for c in part) >= min(RUN, length):
                total |= covered
        return float(total.mean()), spans

    def found(self, t: Tokens, least: float) -> Iterator[tuple[int, int, float, list[tuple[int, int]]]]:
        """(text, item, share, first and last tokens of the chains) of every text that contains an item."""
        g, at = t.grams(self.n)
        text = t.text[at]
        for d, i in zip(*(x.tolist() for x in self.seeded(text, g))):
            a, z = np.searchsorted(text, (d, d + 1))
            share, spans = self.aligned(g[a:z], at[a:z], i)
            if share >= least:
                yield d, i, share, spans


def _equal(held: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place of each of g in the sorted array held, and the number of places."""
    lo = np.searchsorted(held, g)
    return lo, np.searchsorted(held, g, "right") - lo


def _places(lo: np.ndarray, many: np.ndarray) -> np.ndarray:
    return np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(many.sum())


def _sets(items: DataFrame, item_id: str, text: str, block: int, n: int):
    spark = items.sparkSession
    table = char_table(simplify_map(spark))
    rows = items.select(item_id, text).where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).orderBy(item_id)
    held: list = []

    def made() -> GramSet:
        return GramSet([r[0] for r in held], without_instructions([r[1] for r in held]), table, n)

    for r in rows.toLocalIterator():
        held.append(r)
        if len(held) == block:
            yield made(), table
            held = []
    if held:
        yield made(), table


def _scan(docs: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, schema: str, rows, block: int, n: int) -> DataFrame:
    spark = docs.sparkSession
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    out = None
    for grams, table in _sets(items, item_id, item_text, block, n):
        held = spark.sparkContext.broadcast((grams, table))

        def run(it: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            grams, table = held.value
            for b in it:
                for at in range(0, b.num_rows, 512):
                    part = b.slice(at, 512)
                    yield from rows(part.column(0).to_numpy(), part.column(1).to_pylist(), grams, table)

        part = source.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", least: float = LEAST, block: int = 20_000, n: int = N) -> DataFrame:
    """(item_id, doc_id, share) for every document that contains a passage."""

    def rows(ids, texts, grams, table) -> Iterator[pa.RecordBatch]:
        out = [(int(grams.ids[i]), int(ids[d]), share) for d, i, share, _ in grams.found(Tokens(texts, table), least)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["item_id", "doc_id", "share"])

    return _scan(docs, items, doc_id, text, item_id, item_text, "item_id long, doc_id long, share double", rows, block, n)


def leaked_spans(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", least: float = LEAST, block: int = 20_000, n: int = N) -> DataFrame:
    """(doc_id, begin, end): spans of characters of a document that stem from passages it contains, merged."""

    def rows(ids, texts, grams, table) -> Iterator[pa.RecordBatch]:
        t = Tokens(texts, table)
        spans: dict[int, list[tuple[int, int]]] = {}
        for x, _, _, chains in grams.found(t, least):
            spans.setdefault(x, []).extend((int(t.start[k]), int(t.end[m])) for k, m in chains)
        out: list[tuple[int, int, int]] = []
        for x, s in spans.items():
            s.sort()
            a, z = s[0]
            for b, e in s[1:]:
                if b <= z:
                    z = max(z, e)
                else:
                    out.append((int(ids[x]), a, z))
                    a, z = b, e
            out.append((int(ids[x]), a, z))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(3)], ["doc_id", "begin", "end"])

    return _scan(docs, items, doc_id, text, item_id, item_text, "doc_id long, begin long, end long", rows, block, n)


def remove_spans(docs: DataFrame, spans: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents without the spans; those that hold none are as they were. A document's spans are bounded by its text."""
    grouped = spans.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("begin", "end"))).alias("_s")).withColumnRenamed("doc_id", "_d")
    last = F.aggregate("_s", F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("kept")), lambda acc, s: F.struct(F.greatest(s["end"], acc["at"]).alias("at"), F.concat(acc["kept"], F.substring(F.col(text), (acc["at"] + 1).cast("int"), F.greatest(s["begin"] - acc["at"], F.lit(0)).cast("int"))).alias("kept")))
    rest = F.concat(last["kept"], F.substring(F.col(text), (last["at"] + 1).cast("int"), F.length(text)))
    return docs.join(grouped, docs[doc_id] == grouped["_d"], "left").withColumn(text, F.when(F.col("_s").isNotNull(), rest).otherwise(F.col(text))).drop("_s", "_d")
