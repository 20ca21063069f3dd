"""Links of pages and the traversal of the frontier.

Links come from ``href`` attributes with or without quotation marks; pages are unescaped until markup appears first. A link is useful if a recogniser takes the name in it for a person; the default
recogniser is a pattern, any Column function may be given instead. Seen addresses are excluded exactly (anti-join).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtab.config import DEFAULT, Config
from loomtab.functions.names import page_markup, strip_prefix_chars
from loomtab.functions.urls import decode_percent
from loomtab.session import cut

HREF = r"""(?i)<a\s[^>]*?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
#: Two to four Han characters, or two Latin words.
PERSON = r"^(?:[一-龥]{2,4}|[A-Z][a-z]+ [A-Z][a-z]+)$"


def is_person(name: Column) -> Column:
    return name.rlike(PERSON)


def links_flat(pages: DataFrame, id_col: str = "page_id", html: str = "html") -> DataFrame:
    """(page_id, href), stripped, of pages in whatever escaping they are stored; also over streams."""
    got = pages.select(F.col(id_col).alias("page_id"), F.explode(F.regexp_extract_all(page_markup(F.col(html)), F.lit(HREF), F.lit(1))).alias("href"))
    return got.select("page_id", F.trim(F.regexp_replace("href", "^[\"']|[\"']$", "")).alias("href"))


def links(pages: DataFrame, id_col: str = "page_id", html: str = "html") -> DataFrame:
    """(page_id, href): stripped and distinct per page."""
    return links_flat(pages, id_col, html).distinct()


def absolute(found: DataFrame, config: Config = DEFAULT) -> DataFrame:
    return found.withColumn("url", F.concat(F.lit(config.host), "href"))


def name_in_link(href: Column, config: Config = DEFAULT) -> Column:
    parts = F.split(F.regexp_replace(href, f"^{config.item_prefix}", ""), "/")
    last = F.element_at(parts, -1)
    return decode_percent(F.when(last.rlike(r"^\d+$"), F.try_element_at(parts, F.lit(-2))).otherwise(last))


def relevance(href: Column, config: Config = DEFAULT, recogniser: Callable[[Column], Column] = is_person) -> Column:
    """1.0 for the item page of a person, otherwise 0.0."""
    ok = href.startswith(config.item_prefix) & F.coalesce(recogniser(name_in_link(href, config)), F.lit(False))
    return F.when(ok, 1.0).otherwise(0.0)


def charset_stripped(href: Column, config: Config = DEFAULT) -> Column:
    return strip_prefix_chars(href, config.item_prefix)


def route(found: DataFrame, config: Config = DEFAULT, recogniser: Callable[[Column], Column] = is_person) -> DataFrame:
    """Links with their score and whether they go to the useful queue."""
    return found.withColumn("score", relevance(F.col("href"), config, recogniser)).withColumn("useful", F.col("score") >= config.relevance)


def possible(urls: DataFrame, config: Config = DEFAULT, url: str = "url") -> DataFrame:
    """Addresses that may lead to persons: item pages without a dot in the last part."""
    u = F.col(url)
    return urls.where(u.startswith(config.host + config.item_prefix) & ~F.substring_index(u, "/", -1).contains("."))


def unseen(urls: DataFrame, seen: DataFrame, url: str = "url") -> DataFrame:
    return urls.dropDuplicates([url]).join(seen.select(url).distinct(), url, "left_anti")


def step(frontier: DataFrame, pages: DataFrame, seen: DataFrame, config: Config = DEFAULT, recogniser: Callable[[Column], Column] = is_person) -> DataFrame:
    """New addresses behind the pages of a frontier: (url, useful)."""
    here = pages.join(frontier.select("url").distinct(), "url", "left_semi")
    got = route(absolute(links(here), config), config, recogniser)
    new = got.groupBy("url").agg(F.max("useful").alias("useful"))
    return new.join(seen.select("url"), "url", "left_anti")


def reach(seeds: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(node, depth): breadth-first distance from the seeds over (src, dst) edges, up to ``depth``.

    Each round joins the frontier only, and cuts its lineage through the shared checkpoint folder.
    """
    seen = seeds.select("node").distinct().withColumn("depth", F.lit(0))
    edges = cut(edges.select("src", "dst"))  # worked out once, not anew in each round
    frontier = seen
    for k in range(1, depth + 1):
        new = frontier.join(edges, frontier["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        frontier = cut(new.withColumn("depth", F.lit(k)))
        seen = seen.unionByName(frontier)
        if frontier.isEmpty():
            break
    return seen


def fetch(frontier: DataFrame, snapshot: DataFrame, url: str = "url") -> DataFrame:
    """Pages of a frontier from a stored snapshot (the crawl itself needs a network)."""
    return snapshot.join(frontier.select(url).distinct(), url, "left_semi")
