"""Cleaning of names and relations, guards on triples, and small text codecs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtab.functions.urls import decode_percent

# fixed values: what is cut from names (bracketed remarks; ASCII brackets only around one character) and the marks dropped
REMARKS = r"\(.?\)|（.*?）|\{.*?\}|\[.*?\]|【.*?】|<.*?>"
MARKS = r"(?U)[\s+.!/_,$%^*(\"'——！，。？?、~@#￥%……&*（）]+"


def clean_name(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, REMARKS, ""), MARKS, "")


def person_name(c: Column) -> Column:
    """As :func:`clean_name`, of the part before the first slash."""
    return F.regexp_replace(F.substring_index(F.regexp_replace(c, REMARKS, ""), "/", 1), MARKS, "")


def without_remarks(c: Column) -> Column:
    return F.regexp_replace(c, REMARKS, "")


def is_blank(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", "") == ""


def relation_guard(name: Column, rel: Column, to: Column, longest: int = 7) -> Column:
    """Whether a cleaned (name, relation, name) may be kept."""
    return ~is_blank(name) & ~is_blank(rel) & ~is_blank(to) & (F.length(rel) <= longest)


def triad_guard(name: Column, prop: Column, value: Column, longest: int = 7) -> Column:
    """Whether a raw (name, property, value) may be kept."""
    return ~is_blank(name) & ~is_blank(prop) & ~is_blank(value) & (F.length(name) <= longest) & (F.length(prop) <= longest)


def strip_footnotes(c: Column) -> Column:
    return F.regexp_replace(c, r"\[\d+\]", "")


def strip_nbsp(c: Column) -> Column:
    return F.replace(c, F.lit("\xa0"), F.lit(""))


def breaks_to_slash(c: Column) -> Column:
    return F.regexp_replace(c, r"(?i)<br\s*/?>", "/")


def strip_prefix_chars(c: Column, chars: str) -> Column:
    """Drop leading characters of a set (not a prefix)."""
    return F.ltrim(c, F.lit(chars))


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescape_html(c: Column) -> Column:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&#39;", "'"), ("&nbsp;", "\xa0"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


#: A tag. A page without any is escaped at rest.
MARKUP = r"(?i)<\s*(?:!doctype|/?[a-z][a-z0-9]*[\s/>])"


def page_markup(c: Column) -> Column:
    """A stored page, unescaped until markup appears; the number of rounds follows from its most escaped entity."""
    depth = F.transform(F.regexp_extract_all(c, F.lit("&((?:amp;)*)(?:lt|gt|quot|nbsp|#39|#x27);"), F.lit(1)), lambda x: (F.length(x) / 4).cast("int"))
    rounds = F.sequence(F.lit(0), F.coalesce(F.array_max(depth), F.lit(0)))
    opened = F.aggregate(rounds, c, lambda page, _: F.when(page.rlike(MARKUP), page).otherwise(unescape_html(page)))
    return F.when(c.rlike(MARKUP), c).otherwise(opened)


def encode_bits(c: Column) -> Column:
    """Code points in binary, separated by spaces (ASCII; other characters need two UTF-16 units)."""
    return F.array_join(F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.bin(F.ascii(x))), " ")


def decode_bits(c: Column) -> Column:
    return F.array_join(F.transform(F.split(c, " "), lambda b: F.char(F.conv(b, 2, 10).cast("int"))), "")


def url_decode(c: Column) -> Column:
    return decode_percent(c)


def pretty_json(c: Column) -> Column:
    """A map as indented JSON with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c))), {"pretty": "true"})
