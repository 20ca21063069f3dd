"""Column functions for cleaning text; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space plus zero-width marks.
SPACE = "[\\s ​‌‍⁠﻿]"
#: The same as a list of characters, for functions that are cheaper than patterns.
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u200b\u200c\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff"
FOOTNOTE = r"(?U)[\[［]\s*\d+\s*[\]］]"


def ustrip(c: Column) -> Column:
    """Strip Unicode white space at both ends (``trim`` knows the ASCII space only)."""
    return F.btrim(c, F.lit(BLANKS))


def no_space(c: Column) -> Column:
    return F.translate(c, BLANKS, "")


def no_footnotes(c: Column) -> Column:
    """The pattern runs only over texts with a bracket."""
    return F.when(c.contains("[") | c.contains("［"), F.regexp_replace(c, FOOTNOTE, "")).otherwise(c)


def clean(c: Column) -> Column:
    """Drop footnote marks and surrounding white space."""
    return ustrip(no_footnotes(c))


def ascii_digits(c: Column) -> Column:
    return F.translate(c, "０１２３４５６７８９．－／", "0123456789.-/")


def blank(c: Column) -> Column:
    return F.coalesce(ustrip(c), F.lit("")) == ""
