"""Nodes and edges merged from entities and relationships.

Entities are (seq, name, url, prop, value), relationships (seq, src, src_url, rel, dst, dst_url); ``seq`` is the order in
which they were written. First writers win. Names of clans (``config.clan_suffix``) never merge through entities.
Hot nodes are combined before the shuffle (``min`` of structs), and no window runs over a whole node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtab.config import DEFAULT, Config


def nodes_by_name(entities: DataFrame) -> DataFrame:
    """(name, prop, value): one node per name; the earliest value of a property stays."""
    got = entities.groupBy("name", "prop").agg(F.min(F.struct("seq", "value")).alias("x"))
    return got.select("name", "prop", F.col("x.value").alias("value"))


def _prefixes(url: Column) -> Column:
    """An address and what it goes back to at its slashes, down to the blank one; without the scheme alone."""
    parts = F.split(url, "/")
    made = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return F.array_union(F.array(F.lit("")), F.filter(made, lambda x: ~x.rlike("^[a-z]+:/?$")))


def canonical_urls(entities: DataFrame) -> DataFrame:
    """(name, url, node_url): addresses of a name of which one goes on from the other are one node, named by the earliest; a blank address belongs to the name's earliest.

    By equi-joins on (name, prefix): work grows with the number of addresses times their slashes, never with pairs of a name's addresses.
    """
    first = entities.groupBy("name", "url").agg(F.min("seq").alias("seq"))
    best = F.min(F.struct("seq", F.col("node").alias("url")))
    cut = first.where("url <> ''").select("name", F.col("url").alias("node"), "seq", F.explode(_prefixes(F.col("url"))).alias("url"))
    longer = cut.groupBy("name", "url").agg(best.alias("x"))  # the earliest that goes on from each prefix
    up = first.where("url <> ''").select("name", "url").join(longer, ["name", "url"])
    shorter = first.select("name", F.col("url").alias("prefix"), F.struct("seq", "url").alias("x"))
    down = cut.select("name", F.col("node").alias("url"), F.col("url").alias("prefix")).join(shorter, ["name", "prefix"]).select("name", "url", "x")
    blank = first.where("url = ''").select("name", "url").join(first.groupBy("name").agg(F.min(F.struct("seq", "url")).alias("x")), "name").select("name", "url", "x")
    return up.select("name", "url", "x").unionByName(down).unionByName(blank).groupBy("name", "url").agg(F.min("x").alias("x")).select("name", "url", F.col("x.url").alias("node_url"))


def nodes_by_url(entities: DataFrame) -> DataFrame:
    """(name, node_url, prop, value)."""
    to = canonical_urls(entities)
    got = entities.join(to, ["name", "url"]).groupBy("name", "node_url", "prop").agg(F.min(F.struct("seq", "value")).alias("x"))
    return got.select("name", "node_url", "prop", F.col("x.value").alias("value"))


def without_clans(rows: DataFrame, config: Config = DEFAULT, name: str = "name") -> DataFrame:
    return rows.where(~F.col(name).endswith(config.clan_suffix))


def fuse(props: DataFrame, keys: list[str]) -> DataFrame:
    """Property maps of nodes: (keys, props)."""
    first = props.groupBy(*keys, "prop").agg(F.min(F.struct("seq", "value")).alias("x"))
    return first.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("prop", F.col("x.value"))))).alias("props"))


def node_id(name: Column, url: Column) -> Column:
    return F.xxhash64(name, F.coalesce(url, F.lit("")))


def endpoints(relationships: DataFrame, entities: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(seq, dst, dst_url, how): how the far end of each edge is found: 'exact', 'fresh' (clan names), 'name' or 'new'."""
    exact = entities.select(F.col("name").alias("dst"), F.col("url").alias("dst_url")).distinct().withColumn("_e", F.lit(True))
    named = entities.select(F.col("name").alias("dst")).distinct().withColumn("_n", F.lit(True))
    got = relationships.join(exact, ["dst", "dst_url"], "left").join(named, "dst", "left")
    how = F.when(F.col("_e"), "exact").when(F.col("dst").endswith(config.clan_suffix), "fresh").when(F.col("_n"), "name").otherwise("new")
    return got.select("seq", "dst", "dst_url", how.alias("how"))


def edges(relationships: DataFrame, keep_multi: bool = False) -> DataFrame:
    """(src, rel, dst) with the earliest seq; equal edges once unless ``keep_multi``."""
    if keep_multi:
        return relationships.select("src", "rel", "dst", "seq")
    return relationships.groupBy("src", "rel", "dst").agg(F.min("seq").alias("seq"))


def chart_nodes(entities: DataFrame) -> DataFrame:
    """(name, url, label): the first entity of each url, then of each name; the label lists its properties."""
    heads = entities.groupBy("seq", "name", "url").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("prop", "value"))), lambda x: F.concat(x["prop"], F.lit(":"), x["value"])), "\n").alias("label")
    )
    by_url = heads.groupBy("url").agg(F.min(F.struct("seq", "name", "label")).alias("x")).select("url", "x.*")
    by_name = by_url.groupBy("name").agg(F.min(F.struct("seq", "url", "label")).alias("x"))
    return by_name.select("name", "x.url", "x.label")


def chart_links(relationships: DataFrame, entities: DataFrame) -> DataFrame:
    """(seq, src, rel, dst): names replaced by the first name that the url of the far end was given."""
    first = entities.where("url <> ''").groupBy(F.col("url").alias("dst_url")).agg(F.min_by("name", "seq").alias("_n"))
    return relationships.join(first, "dst_url", "left").select("seq", "src", "rel", F.coalesce("_n", "dst").alias("dst"))


def flatten_pages(tables: DataFrame, key: str, item: str, order: str) -> DataFrame:
    """Lists of a page's tables as one list per page."""
    return tables.groupBy(key).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order, item))), lambda x: x[item])).alias(item))


def label_lines(props: Column) -> Column:
    return F.array_join(F.transform(F.map_entries(props), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), "\n")
