"""Several values packed in one field: one row per value, with its position.

Quoted spans are replaced by indexed placeholders made of two private-use characters; those characters, where a text
happens to hold them, are spans themselves, so that no placeholder can collide with the text. The rest is split at
delimiters and list numbers, the spans are put back by array lookup, and the items are exploded with positions from 1.
Everything is a column expression; there is no shuffle.

Defined cases: null and blank texts give no item; empty items are left out and not counted; an unclosed quotation mark
is an ordinary character inside an item and is dropped at its ends; a space between two Latin words doesn't
delimit; repeated rows give their items each; very long texts and extra columns need nothing special.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtab.functions.text import SPACE, ustrip

OPEN, CLOSE, CUT = "\ue000", "\ue001", "\ue002"
SPANS = "《[^《》]*》|“[^“”]*”|「[^「」]*」|『[^『』]*』|‘[^‘’]*’|\"[^\"]*\"|[\ue000\ue001\ue002]"
DELIMITERS = r"[/／、,，;；|｜\n\r\t　]"
LIST_NUMBER = r"[①-⑳⑴-⒇㈠-㈩]|(?:(?<=^|[\s/、,，;；|])[(（]?\d{1,2}[)）.．、](?!\d))"
QUOTES = "\"“”「」『』‘’"


def items(value: Column) -> Column:
    """The array of items of a text."""
    spans = F.regexp_extract_all(value, F.lit(f"({SPANS})"), F.lit(1))
    rest = F.split(value, SPANS, -1)
    held = F.array_join(F.transform(rest, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit(OPEN), (i - 1).cast("string"), F.lit(CLOSE), p))), "")
    cut = F.regexp_replace(held, LIST_NUMBER, CUT)
    cut = F.regexp_replace(cut, DELIMITERS, CUT)
    cut = F.regexp_replace(cut, rf"(?<![A-Za-z.'])\s+|\s+(?![A-Za-z])", CUT)
    cut = F.regexp_replace(cut, f"{CLOSE}(?={OPEN})", CLOSE + CUT)
    parts = F.split(cut, CUT, -1)

    def back(token: Column) -> Column:
        pieces = F.split(token, OPEN, -1)
        return F.array_join(
            F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.get(spans, F.substring_index(p, CLOSE, 1).cast("int")), F.substring_index(p, CLOSE, -1)))),
            "",
        )

    bare = F.transform(F.transform(parts, back), lambda x: F.regexp_replace(x, rf"(?U)^[{QUOTES}]*{SPACE}*[{QUOTES}]*|[{QUOTES}]*{SPACE}*[{QUOTES}]*$", ""))
    return F.filter(F.transform(bare, ustrip), lambda x: x != "")


def split_values(df: DataFrame, value: str, keep: list[str], least: int = 1) -> DataFrame:
    """``keep`` columns, pos (from 1) and item, for the texts with ``least`` items or more."""
    got = df.select(*[F.col(k) for k in keep], items(F.col(value)).alias("_items")).where(F.size("_items") >= least)
    return got.select(*keep, F.posexplode("_items").alias("_p", "item")).select(*keep, (F.col("_p") + 1).cast("long").alias("pos"), "item")
