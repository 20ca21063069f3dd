"""Replaceable word tests: a tagger splits a text into tagged words, a score sums what a list of tags is worth.

No part-of-speech tagger is at hand, so the default tags runs of characters by their script; any function from a column to an
array of tags may take its place.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tag of a run of characters and its pattern.
RUNS = {"n": r"[\p{IsHan}]+", "x": r"[A-Za-z]+", "m": r"[0-9]+", "w": r"[^\p{L}\p{N}\p{M}\s]+"}
#: What a word of each tag is worth.
WORTH = {"n": 1, "x": 2, "m": 3, "w": 4}


def run_tags(c: Column) -> Column:
    """The tags of a text's runs, by tag."""
    text = F.coalesce(c, F.lit(""))
    return F.flatten(F.array(*[F.array_repeat(F.lit(t), F.size(F.regexp_extract_all(text, F.lit(f"({p})"), F.lit(1)))) for t, p in RUNS.items()]))


def word_score(c: Column, tagger: Callable[[Column], Column] = run_tags, worth: Mapping[str, int] = WORTH) -> Column:
    table = F.create_map(*[F.lit(x) for kv in worth.items() for x in kv])
    return F.aggregate(F.transform(tagger(c), lambda t: F.coalesce(table[t], F.lit(0))), F.lit(0), lambda a, x: a + x)


def has_tag(c: Column, tag: str, tagger: Callable[[Column], Column] = run_tags) -> Column:
    return F.array_contains(tagger(c), tag)
