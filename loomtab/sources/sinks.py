"""Writers of the pipeline: queues, pages, extracted rows, triples, charts and record bundles."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtab.functions.names import escape_html


def append_pages(pages: DataFrame, path: str) -> None:
    """(url, html) with html escaped at rest; empty pages are left out."""
    pages.where("html is not null and html <> ''").withColumn("html", escape_html(F.col("html"))).write.mode("append").parquet(path)


def append_extracted(rows: DataFrame, path: str) -> None:
    """Typed append of entities or relationships; quotation marks in the data need no care."""
    rows.write.mode("append").parquet(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_triples(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("escape", '"').csv(path)


def write_tables(cells: DataFrame, path: str, by: str = "page_id") -> None:
    """Cells in files by a hash bucket of the page, for lookups."""
    cells.withColumn("bucket", F.pmod(F.xxhash64(by), F.lit(64))).write.mode("overwrite").partitionBy("bucket").parquet(path)


def lookup(spark: SparkSession, path: str, page_id: int, by: str = "page_id") -> DataFrame:
    """A page's cells, read from its bucket only."""
    t = spark.read.parquet(path)
    key = F.lit(page_id).cast("long")
    bucket = spark.range(1).select(F.pmod(F.xxhash64(key), F.lit(64)).alias("b")).first()["b"]
    return t.where((F.col("bucket") == bucket) & (F.col(by) == page_id)).drop("bucket")


def record_id(url: Column) -> Column:
    """The same id for a page whenever it is written."""
    return F.hex(F.xxhash64(url))


def write_records(cells: DataFrame, entities: DataFrame, relationships: DataFrame, path: str) -> None:
    for name, rows in (("tables", cells), ("entities", entities), ("relationships", relationships)):
        rows.write.mode("overwrite").parquet(f"{path}/{name}")


def clear(spark: SparkSession, paths: dict[str, str]) -> None:
    """Queues emptied: {path: schema}."""
    for path, schema in paths.items():
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def html_tables(cells: DataFrame, keys: tuple[str, ...] = ("table_id",)) -> DataFrame:
    """(keys, html): each table as markup, anchored cells with their spans; a title row over all columns."""
    tag = F.coalesce(F.col("tag"), F.lit("td"))
    rs = F.coalesce(F.col("rowspan"), F.lit(1)) if "rowspan" in cells.columns else F.lit(1)
    cs = F.coalesce(F.col("colspan"), F.lit(1)) if "colspan" in cells.columns else F.lit(1)
    own = cells.where("anchor") if "anchor" in cells.columns else cells
    span = F.concat(F.when(rs > 1, F.concat(F.lit(' rowspan="'), rs.cast("string"), F.lit('"'))).otherwise(""), F.when(cs > 1, F.concat(F.lit(' colspan="'), cs.cast("string"), F.lit('"'))).otherwise(""))
    text = F.concat(F.lit("<"), tag, span, F.lit(">"), escape_html(F.coalesce("content", F.lit(""))), F.lit("</"), tag, F.lit(">"))
    row = own.withColumn("_t", text).groupBy(*keys, "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "_t"))), lambda x: x["_t"]), "").alias("_r"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "_r"))), lambda x: F.concat(F.lit("<tr>"), x["_r"], F.lit("</tr>"))), "")
    return row.groupBy(*keys).agg(F.concat(F.lit("<table>"), body, F.lit("</table>")).alias("html"))


def chart(nodes: list[dict], links: list[dict]) -> str:
    """A page with the nodes and links of one person as data, for any force layout."""
    data = json.dumps({"nodes": nodes, "links": links}, ensure_ascii=False)
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"></head><body><script id="graph" type="application/json">{data}</script></body></html>'


def split_errors(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows without the error column, error rows)."""
    return rows.where("error is null").drop("error"), rows.where("error is not null")
