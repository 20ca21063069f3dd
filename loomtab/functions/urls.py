"""Column functions on addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtab.functions.text import BLANKS



def decode_percent(c: Column) -> Column:
    """Percent-decoded text; '+' stays; text that can't be decoded stays as it is."""
    safe = F.replace(c, F.lit("+"), F.lit("%2B"))
    lone = F.regexp_replace(safe, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(lone), c)


def page_key(url: Column) -> Column:
    """What all addresses of one page share; null for blank ones.

    Dropped: scheme, default port of the scheme, query, fragment, one final slash, surrounding white space. Lower
    case: host. Percent-encoding is undone, so that either way of writing a character gives the same key; the case of
    the path stays.
    """
    u = F.btrim(url, F.lit(BLANKS))
    bare = F.substring_index(F.substring_index(u, "#", 1), "?", 1)

    def parts(x: Column) -> Column:
        head = F.lower(F.substring(x, 1, 8))
        scheme = F.when(head == "https://", 2).when(head.startswith("http://"), 1).otherwise(0)
        return F.struct(scheme.alias("scheme"), F.when(scheme == 2, F.substr(x, F.lit(9))).when(scheme == 1, F.substr(x, F.lit(8))).otherwise(x).alias("rest"))

    def key(p: Column) -> Column:
        host = F.substring_index(p["rest"], "/", 1)
        path = F.substr(p["rest"], F.length(host) + 1)
        path = F.when(path.contains("%"), decode_percent(path)).otherwise(path)
        port = F.when(p["scheme"] == 1, F.regexp_replace(host, ":(80)?$", "")).when(p["scheme"] == 2, F.regexp_replace(host, ":(443)?$", "")).otherwise(host)
        return F.concat(F.lower(F.when(host.contains(":"), port).otherwise(host)), F.regexp_replace(path, "/$", ""))

    # each step is bound once by a lambda, not repeated in the expressions behind it
    made = F.get(F.transform(F.transform(F.array(bare), parts), key), F.lit(0))
    return F.when(u != "", made)


def last_segment(url: Column) -> Column:
    """The page's name: the last part of the path, or the one before it if the last is a number; decoded."""
    parts = F.split(F.regexp_replace(url, r"[?#].*$", ""), "/")
    last = F.element_at(parts, -1)
    return decode_percent(F.when(last.rlike(r"^\d+$"), F.try_element_at(parts, F.lit(-2))).otherwise(last))
