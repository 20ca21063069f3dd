"""Traditional to simplified characters, by the rules of the ICU library that Spark brings along."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Unified ideographs and extension A.
RANGES = ((0x3400, 0x4DBF), (0x4E00, 0x9FFF))


@lru_cache(maxsize=1)
def _pairs() -> tuple[str, str]:
    spark = SparkSession.getActiveSession()
    chars = "".join(chr(c) for a, b in RANGES for c in range(a, b + 1))
    rule = spark._jvm.com.ibm.icu.text.Transliterator.getInstance("Traditional-Simplified")  # fails where it is missing: results must not depend on the machine
    out = rule.transliterate("\n".join(chars)).split("\n")
    pairs = [(a, b) for a, b in zip(chars, out) if a != b and len(b) == 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def simplify_map(spark: SparkSession) -> dict[str, str]:
    return dict(zip(*_pairs()))


def simplify(c: Column) -> Column:
    return F.translate(c, *_pairs()) if _pairs()[0] else c
