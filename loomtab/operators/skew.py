"""Joins that survive a hot key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fewer than this many groups can each hold more than 1/HOT of all rows, so the list of hot groups may be broadcast.
HOT = 1000
#: Buckets in which keys are counted at first.
BUCKETS = 1 << 12


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, least: int = 10_000) -> DataFrame:
    """``rows`` ⋈ ``groups`` on ``key``, where ``groups`` has one row per key with its number of rows in ``size``.

    Groups with more than ``max(least, total / HOT)`` rows are fewer than HOT by counting, and are joined by
    broadcast, so that their rows stay where they are; all other rows are shuffled, in groups of a bounded size.
    """
    limit = max(least, total // HOT)
    hot = F.broadcast(groups.where(F.col(size) > limit))
    cold = groups.where(F.col(size) <= limit)
    return rows.join(hot, key).unionByName(rows.join(F.broadcast(groups.where(F.col(size) > limit).select(key)), key, "left_anti").join(cold, key))


def hot_keys(rows: dict[str, DataFrame], least: int = 10_000) -> dict[str, list]:
    """For each table of one number column the keys with more than ``max(least, rows / HOT)`` rows each.

    They are fewer than HOT a table by counting: more than HOT keys of more than ``least`` rows each means that the
    table has more than HOT * least rows, so that the limit rises. Rows are counted by buckets of keys first; keys are
    counted only in the buckets that hold more rows than the limit, since no other can hold such a key.
    """
    number = F.col("key").cast("long")
    slot = lambda k: F.when(number.isNotNull(), F.pmod(F.xxhash64(number), F.lit(BUCKETS)) + k * BUCKETS).otherwise(-1 - k)
    keys = reduce(DataFrame.unionByName, [t.toDF("key").select(number.alias("key"), slot(k).alias("slot")) for k, t in enumerate(rows.values())])
    sizes = keys.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).collect()
    total = [0] * len(rows)
    for r in sizes:
        total[r["slot"] // BUCKETS if r["slot"] >= 0 else -1 - r["slot"]] += r["n"]
    limit = [max(least, n // HOT) for n in total]
    full = [r["slot"] for r in sizes if r["slot"] >= 0 and r["n"] > limit[r["slot"] // BUCKETS]]
    out: dict[str, list] = {name: [] for name in rows}
    if full:
        names = list(rows)
        for r in keys.where(F.col("slot").isin(full)).groupBy("slot", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > min(limit)).orderBy(F.desc("n")).collect():
            if r["n"] > limit[k := r["slot"] // BUCKETS]:
                out[names[k]].append(r["key"])
    return out


def join_unique(rows: DataFrame, lookup: DataFrame, key: str, hot: list) -> DataFrame:
    """``rows`` ⋈ ``lookup`` on ``key``, where ``lookup`` has a key once; rows of the keys in ``hot`` stay where they are.

    ``hot`` comes from :func:`hot_keys`, so that the part of ``lookup`` that is sent to all tasks has fewer than HOT rows.
    """
    if not hot:
        return rows.join(lookup, key)
    is_hot = F.col(key).isin(hot)
    return rows.where(is_hot).join(F.broadcast(lookup.where(is_hot)), key).unionByName(rows.where(~is_hot).join(lookup, key))
