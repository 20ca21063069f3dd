"""Has this key been seen before? Elias–Fano stores of hashed keys.

Keys are hashed to 64 bits. The hash space is cut into ranges ("parts"); each part keeps its distinct hashes sorted
and Elias–Fano encoded: high bits in unary, low bits packed, about ``2 + log2(range / keys)`` bits a key. New batches
are probed by successor search and then merged, one batch after the other within a part, all parts in parallel.

Hot keys: in each Arrow batch of the map side only the first row of a key travels to its part; the others are known to
be repeats already and are spread over all tasks, so a key with a third of all rows costs its part a few rows only.

Wrong answers: a new key is called seen if another key has its hash. With n stored keys that has the probability
n / 2**64 a probe; :func:`error_report` states it together with the wrong answers counted against exact keys.

Defined cases: null keys are never seen and never stored; of rows with equal key and equal id none precedes the other;
repeated rows give their id once; an empty table gives no row; an empty store has seen nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIGN = np.uint64(1 << 63)


class EliasFano:
    """A sorted set of distinct unsigned integers below ``2**width``."""

    def __init__(self, values: np.ndarray, width: int):
        n = len(values)
        self.n, self.width = n, width
        self.low_bits = max(0, width - max(1, math.ceil(math.log2(max(n, 2))))) if n else 0
        low = np.uint64(self.low_bits)
        high = (values >> low).astype(np.int64) if self.low_bits < 64 else np.zeros(n, np.int64)
        size = int(high[-1]) + n + 1 if n else 0
        bits = np.zeros(size, bool)
        bits[high + np.arange(n)] = True
        self.high = np.packbits(bits)
        self.size = size
        self.low = self._pack(values & np.uint64((1 << self.low_bits) - 1), self.low_bits)

    @staticmethod
    def _pack(values: np.ndarray, width: int) -> np.ndarray:
        if not width or not len(values):
            return np.zeros(1, np.uint64)
        at = np.arange(len(values), dtype=np.int64) * width
        word, off = at >> 6, (at & 63).astype(np.uint64)
        out = np.zeros((len(values) * width >> 6) + 2, np.uint64)
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        out[word[first]] |= np.bitwise_or.reduceat(values << off, first)
        over = np.flatnonzero(off + np.uint64(width) > 64)
        out[word[over] + 1] |= values[over] >> (np.uint64(64) - off[over])  # at most one value reaches into a word
        return out

    def _low_at(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.int64) * self.low_bits
        word, off = at >> 6, (at & 63).astype(np.uint64)
        rest = self.low[word + 1] << ((np.uint64(64) - off) & np.uint64(63))
        got = (self.low[word] >> off) | np.where(off > 0, rest, np.uint64(0))
        return got & np.uint64((1 << self.low_bits) - 1)

    def _zeros(self) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(self.high, count=self.size) == 0)

    def values(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, count=self.size))
        return ((ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)) | self._low_at(np.arange(self.n))

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Index of the smallest value that isn't below each x; n if there is none."""
        if not self.n:
            return np.zeros(len(x), np.int64)
        zeros = self._zeros()  # the zero number h ends the bucket of high part h
        h = (x >> np.uint64(self.low_bits)).astype(np.int64)
        beyond = h >= len(zeros)
        hh = np.minimum(h, len(zeros) - 1)
        start = np.where(hh > 0, zeros[hh - 1] - (hh - 1), 0)
        end = zeros[hh] - hh
        want = x & np.uint64((1 << self.low_bits) - 1)
        at = start.copy()
        open_ = np.flatnonzero((at < end) & ~beyond)
        while len(open_):
            less = self._low_at(at[open_]) < want[open_]
            open_ = open_[less]
            at[open_] += 1
            open_ = open_[at[open_] < end[open_]]
        at[beyond] = self.n
        return at

    def contains(self, x: np.ndarray) -> np.ndarray:
        at = self.successor(x)
        ok = at < self.n
        out = np.zeros(len(x), bool)
        if ok.any():
            zeros = self._zeros()
            i = at[ok]
            h = (x[ok] >> np.uint64(self.low_bits)).astype(np.int64)
            hh = np.minimum(h, len(zeros) - 1)
            inside = (i < zeros[hh] - hh) & (h < len(zeros))
            out[ok] = inside & (self._low_at(i) == (x[ok] & np.uint64((1 << self.low_bits) - 1)))
        return out

    def merge(self, new: np.ndarray) -> EliasFano:
        return EliasFano(np.union1d(self.values(), new), self.width) if len(new) else self

    def dump(self) -> tuple[int, int, int, bytes, bytes]:
        return self.n, self.low_bits, self.size, self.low.tobytes(), self.high.tobytes()

    @classmethod
    def load(cls, width: int, n: int, low_bits: int, size: int, low: bytes, high: bytes) -> EliasFano:
        ef = cls(np.zeros(0, np.uint64), width)
        ef.n, ef.low_bits, ef.size = n, low_bits, size
        ef.low, ef.high = np.frombuffer(low, np.uint64), np.frombuffer(high, np.uint8)
        return ef


def _hashed(df: DataFrame, id_col: str, key: Column, source: int) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), key.alias("_k")).where("_k is not null").select("id", F.xxhash64("_k").alias("h"), F.lit(source).alias("src"))


def part_bits(rows: int, rows_a_part: int) -> int:
    return max(0, math.ceil(math.log2(max(1, rows / rows_a_part))))


def seen_before(pending: DataFrame, earlier: DataFrame, key: Column, id_col: str = "id", batches: int = 4, rows_a_part: int = 1 << 20, total: int | None = None) -> DataFrame:
    """Ids of ``pending`` rows whose key occurs in ``earlier`` or in a ``pending`` row with a smaller id.

    ``key`` is the canonical key as a column expression valid in both tables. ``pending`` is merged in ``batches``
    ranges of ids. A part holds about ``rows_a_part`` rows; their number follows from the sizes of the tables.
    """
    spark = pending.sparkSession
    own = pending.agg(F.min(id_col).alias("a"), F.max(id_col).alias("b"), F.count(F.lit(1)).alias("n")).first()
    n = total or (own["n"] + earlier.count())
    k = max(part_bits(n, rows_a_part), math.ceil(math.log2(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))))
    low, span = own["a"] or 0, (own["b"] or 0) - (own["a"] or 0) + 1
    rows = _hashed(earlier, id_col, key, 0).unionByName(_hashed(pending, id_col, key, 1))
    parts = 1 << k

    def first_of_batch(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            ids, h, src = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            u = h.view(np.uint64) ^ SIGN
            order = np.lexsort((ids, src, u))
            su, ss, si = u[order], src[order], ids[order]
            new = np.concatenate(([True], su[1:] != su[:-1])) if len(su) else np.zeros(0, bool)
            lead = np.maximum.accumulate(np.where(new, np.arange(len(su)), 0))
            repeat = (ss[lead] < ss) | (si[lead] < si)
            drop = repeat & (ss == 0)  # an earlier key once is enough
            keep = ~drop
            part = (su >> np.uint64(64 - k)).astype(np.int64) if k else np.zeros(len(su), np.int64)
            part = np.where(repeat, si % parts, part)
            batch = np.where(ss == 0, 0, 1 + (si - low) * batches // span)
            batch = np.where(repeat, -1, batch)
            cols = [part[keep].astype(np.int32), batch[keep].astype(np.int32), (su ^ SIGN).view(np.int64)[keep], si[keep]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["part", "batch", "h", "id"])

    def probe(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = 64 - k
        mask = np.uint64((1 << width) - 1)
        at, held, store = None, [], None

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal store
            h = np.concatenate([x[0] for x in held])
            ids = np.concatenate([x[1] for x in held])
            u = (h.view(np.uint64) ^ SIGN) & mask
            new = np.concatenate(([True], u[1:] != u[:-1]))
            lead = np.maximum.accumulate(np.where(new, np.arange(len(u)), 0))
            if at[1] > 0:
                known = store.contains(u[new])[np.cumsum(new) - 1]
                yield pa.RecordBatch.from_arrays([pa.array(ids[known | (ids[lead] < ids)])], ["id"])
            store = store.merge(u[new])

        for b in it:
            part, batch, h, ids = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            if not len(part):
                continue
            edge = np.flatnonzero((part[1:] != part[:-1]) | (batch[1:] != batch[:-1])) + 1
            for a, z in zip([0, *edge], [*edge, len(part)]):
                if batch[a] < 0:  # repeats known since the map side
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a:z])], ["id"])
                    continue
                here = (int(part[a]), int(batch[a]))
                if here != at:
                    if held:
                        yield from close()
                        held = []
                    if at is None or here[0] != at[0]:
                        store = EliasFano(np.zeros(0, np.uint64), width)
                    at = here
                held.append((h[a:z], ids[a:z]))
        if held:
            yield from close()

    routed = rows.mapInArrow(first_of_batch, "part int, batch int, h long, id long")
    sorted_ = routed.repartition("part").sortWithinPartitions("part", "batch", "h", "id")
    return sorted_.mapInArrow(probe, "id long")


def build_store(df: DataFrame, key: Column, bits: int = 4) -> DataFrame:
    """A table of 2**bits encoded parts of the distinct keys, to be written and merged with later batches."""
    hashed = df.select(key.alias("_k")).where("_k is not null").select(F.xxhash64("_k").alias("h")).distinct()
    return _merge(hashed, None, bits)


def merge_store(store: DataFrame, df: DataFrame, key: Column, bits: int = 4) -> DataFrame:
    hashed = df.select(key.alias("_k")).where("_k is not null").select(F.xxhash64("_k").alias("h")).distinct()
    return _merge(hashed, store, bits)


_STORE = "part int, n long, low_bits int, size long, low binary, high binary"


def _part(bits: int) -> Column:
    return F.shiftrightunsigned(F.col("h").bitwiseXOR(F.lit(-(1 << 63))), 64 - bits).cast("int") if bits else F.lit(0)


def _merge(hashed: DataFrame, store: DataFrame | None, bits: int) -> DataFrame:
    width = 64 - bits
    routed = hashed.select(_part(bits).alias("part"), "h")

    def one(key, left: pa.Table, right: pa.Table) -> pa.Table:
        u = np.unique((right["h"].to_numpy().view(np.uint64) ^ SIGN) & np.uint64((1 << width) - 1)) if right.num_rows else np.zeros(0, np.uint64)
        ef = EliasFano.load(width, *[left[c][0].as_py() for c in ("n", "low_bits", "size", "low", "high")]) if left.num_rows else EliasFano(np.zeros(0, np.uint64), width)
        ef = ef.merge(u)
        return pa.table({c: [v] for c, v in zip(("part", "n", "low_bits", "size", "low", "high"), (key[0].as_py(), *ef.dump()))}, schema=pa.schema([("part", pa.int32()), ("n", pa.int64()), ("low_bits", pa.int32()), ("size", pa.int64()), ("low", pa.binary()), ("high", pa.binary())]))

    left = store if store is not None else hashed.sparkSession.createDataFrame([], _STORE)
    return left.groupBy("part").cogroup(routed.groupBy("part")).applyInArrow(one, _STORE)


def error_report(found: DataFrame, pending: DataFrame, earlier: DataFrame, key: Column, id_col: str = "id") -> DataFrame:
    """One row: probes, seen, stored keys, expected rate of wrong answers, and the wrong answers counted exactly."""
    p = pending.select(F.col(id_col).alias("id"), key.alias("k")).where("k is not null")
    e = earlier.select(key.alias("k")).where("k is not null")
    first = p.groupBy("k").agg(F.min("id").alias("first")).join(e.distinct().withColumn("old", F.lit(True)), "k", "full")
    exact = p.join(first, "k").where("old or id > first").select("id").distinct()
    wrong = exact.withColumn("x", F.lit(1)).join(found.distinct().withColumn("y", F.lit(1)), "id", "full").where("x is null or y is null").agg(F.count(F.lit(1)).alias("wrong_answers"))
    one = F.count(F.lit(1))
    parts = {"probes": p.agg(one.alias("probes")), "stored_keys": first.agg(one.alias("stored_keys")), "seen": found.agg(F.countDistinct("id").alias("seen")), "wrong_answers": wrong}
    rows = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts.values())
    got = rows.agg(*[F.max(c).alias(c) for c in parts])
    return got.select("probes", "seen", "stored_keys", "wrong_answers", (F.col("wrong_answers") / F.greatest("probes", F.lit(1))).alias("wrong_rate"), (F.col("stored_keys") / F.lit(2.0**64)).alias("expected_rate"))
