"""Queue tables: bounded appends and consumption by offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtab.config import DEFAULT


def capped_append(queue: DataFrame, new: DataFrame, limit: int = DEFAULT.queue_limit) -> DataFrame:
    """The queue with the new rows, unless it holds more than ``limit`` rows already.

    The count is one row and is joined as such, so that the whole stays one lazy plan.
    """
    gate = queue.agg((F.count(F.lit(1)) <= limit).alias("_open"))
    return queue.unionByName(new.join(F.broadcast(gate), F.col("_open")).drop("_open"))


def head(queue: DataFrame, n: int, order: str = "id") -> DataFrame:
    return queue.orderBy(order).limit(n)


def consume(queue: DataFrame, taken: DataFrame, key: str = "id") -> DataFrame:
    return queue.join(taken.select(key), key, "left_anti")
