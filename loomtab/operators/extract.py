"""Entities and relationships of classified tables, and the whole pipeline from pages to both."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtab.config import COL, DEFAULT, ENTITY, INFO, PROPERTY, TITLE, Config
from loomtab.functions.names import clean_name, is_blank, person_name, relation_guard, triad_guard, without_remarks
from loomtab.operators import tables as T
from loomtab.session import cut

KEYS = T.KEYS


def persons(cells: DataFrame, config: Config = DEFAULT, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, row, raw, name, url): the person column without its header; the address of the name in the cell, then in the table."""
    col = T.person_column(cells, config, keys).where("person_col >= 0")
    got = cells.where("row > 0").join(col, list(keys)).where("col = person_col")
    got = got.select(*keys, "row", F.coalesce("content", F.lit("")).alias("raw"), *(["links"] if "links" in cells.columns else []))
    if "links" in cells.columns:
        table = T.href_map(cells, keys).select(*keys, F.col("text").alias("raw"), F.col("url").alias("_u"))
        got = got.join(table, [*keys, "raw"], "left").withColumn("url", F.coalesce(F.try_element_at("links", F.col("raw")), F.col("_u"), F.lit(""))).drop("_u", "links")
    else:
        got = got.withColumn("url", F.lit(""))
    return got.withColumn("name", clean_name(F.col("raw")))


def person_names(cells: DataFrame, config: Config = DEFAULT, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, row, person): names cleaned with the part after a slash dropped."""
    return persons(cells, config, keys).select(*keys, "row", person_name(F.col("raw")).alias("person"))


def entities(cells: DataFrame, config: Config = DEFAULT, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, row, name, url, prop, value): one row per filled attribute of a person."""
    p = persons(cells, config, keys)
    col = T.person_column(cells, config, keys).where("person_col >= 0")
    rest = cells.join(col, list(keys)).where("col <> person_col").drop("person_col")
    eav = T.records(rest, keys)
    return p.where(~is_blank(person_name(F.col("raw")))).join(eav, [*keys, "row"]).select(*keys, "row", "name", "url", "prop", "value")


def triads(cells: DataFrame, config: Config = DEFAULT, keys: Sequence[str] = KEYS) -> DataFrame:
    """(name, prop, value) of raw names that pass the guard on lengths."""
    p = persons(cells, config, keys)
    col = T.person_column(cells, config, keys).where("person_col >= 0")
    rest = cells.join(col, list(keys)).where("col <> person_col").drop("person_col")
    got = p.join(T.records(rest, keys), [*keys, "row"]).where(triad_guard(F.col("raw"), F.col("prop"), F.col("value"), config.longest_name))
    return got.select(*keys, clean_name(F.col("raw")).alias("name"), clean_name(F.col("prop")).alias("prop"), without_remarks(F.col("value")).alias("value"))


def _relations(p: DataFrame, subject: Column, rel: Column, config: Config, keys: Sequence[str]) -> DataFrame:
    got = p.select(*keys, "row", clean_name(subject).alias("src"), clean_name(rel).alias("rel"), F.col("name").alias("dst"), F.col("url").alias("dst_url"))
    return got.where(relation_guard(F.col("src"), F.col("rel"), F.col("dst"), config.longest_relation))


def property_relations(cells: DataFrame, config: Config = DEFAULT, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, row, src, rel, dst, dst_url): the page's person, the cell of the foremost relation column, the row's person."""
    rel = T.relation_columns(cells, config, keys).groupBy(*keys).agg(F.min_by("col", F.struct("priority", "col")).alias("_rc"))
    cell = cells.where("row > 0").join(rel, list(keys)).where("col = _rc").select(*keys, "row", F.col("content").alias("_rel"), "prefix")
    return _relations(persons(cells, config, keys).join(cell, [*keys, "row"]), F.col("prefix"), F.col("_rel"), config, keys)


def caption_relations(cells: DataFrame, config: Config = DEFAULT, keys: Sequence[str] = KEYS) -> DataFrame:
    """The page's person, the caption, the row's person."""
    head = cells.groupBy(*keys).agg(F.max("caption").alias("_rel"), F.max("prefix").alias("prefix"))
    return _relations(persons(cells, config, keys).join(head, list(keys)), F.col("prefix"), F.col("_rel"), config, keys)


def header_relations(cells: DataFrame, config: Config = DEFAULT, keys: Sequence[str] = KEYS) -> DataFrame:
    """Headers as relations of the names in row 1, where no person column exists but most headers are relation words."""
    count = T.headers(cells, keys).groupBy(*keys).agg(F.sum(T._word_count(F.col("header"), config.caption_words)).alias("_hits"), F.count(F.lit(1)).alias("_n"))
    open_ = T.person_column(cells, config, keys).where("person_col < 0").join(count, list(keys)).where("_hits > _n / 2").select(*keys)
    first = cells.where("row = 1").select(*keys, "col", F.coalesce("content", F.lit("")).alias("_dst"), "prefix")
    got = T.headers(cells, keys).join(first, [*keys, "col"]).join(open_, list(keys), "left_semi")
    got = got.select(*keys, "col", clean_name(F.col("prefix")).alias("src"), clean_name(F.col("header")).alias("rel"), clean_name(F.col("_dst")).alias("dst"))
    return got.where(relation_guard(F.col("src"), F.col("rel"), F.col("dst"), config.longest_relation))


def extract(cells: DataFrame, config: Config = DEFAULT, keys: Sequence[str] = KEYS) -> tuple[DataFrame, DataFrame]:
    """(entities, relationships) of all tables by their type."""
    kinds = T.classify(cells, config, keys)
    if "preset" in cells.columns:
        preset = cells.groupBy(*keys).agg(F.max("preset").alias("_p"))
        kinds = kinds.join(preset, list(keys)).withColumn("table_type", F.coalesce("_p", "table_type")).drop("_p")

    def of(*types: str) -> DataFrame:
        return cells.join(kinds.where(F.col("table_type").isin(*types)).select(*keys), list(keys), "left_semi")

    ents = entities(of(INFO, ENTITY, PROPERTY, TITLE), config, keys)
    rels = property_relations(of(PROPERTY), config, keys).unionByName(caption_relations(of(TITLE), config, keys))
    if config.header_relation:
        rels = rels.unionByName(header_relations(of(PROPERTY), config, keys).withColumn("row", F.lit(1)).withColumn("dst_url", F.lit("")).drop("col"))
    return ents, rels


def pipeline(cells: DataFrame, config: Config = DEFAULT, keys: Sequence[str] = KEYS) -> tuple[DataFrame, DataFrame]:
    """Regular tables, turned so that headers stand in row 0, cleaned, and extracted."""
    cells = cut(cells.repartition(*keys))  # read by every step, and laid out for all of them; else each would parse the pages again
    regular = cells.join(T.shapes(cells, keys).where("is_correct and is_normal").select(*keys), list(keys), "left_semi")
    side = T.direction(regular, keys)
    if "kind" in cells.columns:  # infoboxes are known to run by columns
        boxes = cells.groupBy(*keys).agg((F.max("kind") == "infobox").alias("_box"))
        side = side.join(boxes, list(keys)).withColumn("direction", F.when(F.col("_box"), COL).otherwise(F.col("direction"))).drop("_box")
    t = regular.join(side, list(keys))
    turned = t.withColumn("_r", F.when(F.col("direction") == COL, F.col("col")).otherwise(F.col("row"))).withColumn("col", F.when(F.col("direction") == COL, F.col("row")).otherwise(F.col("col"))).withColumn("row", F.col("_r")).drop("_r", "direction")
    return extract(cut(T.clean(turned, config, keys)), config, keys)
