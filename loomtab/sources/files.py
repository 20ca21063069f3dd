"""Readers of the pipeline's files: seeds, settings, stored pages, concatenated JSON documents, triples, Word tables."""

from __future__ import annotations

import json
import zipfile
from collections.abc import Iterator
from io import BytesIO
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtab.config import DEFAULT, Config
from loomtab.operators.html import CELLS, _ARROW, grid


def seeds(spark: SparkSession, path: str) -> DataFrame:
    """(url) of a text file with one address a line; blank lines are left out."""
    return spark.read.text(path).select(F.trim("value").alias("url")).where("url <> ''")


def settings(path: str) -> dict:
    """A small JSON settings file, read on the driver."""
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def config_from(path: str) -> Config:
    """Settings over the defaults; unknown keys are an error."""
    return Config(**{k: tuple(v) if isinstance(v, list) else v for k, v in settings(path).items()})


def html_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, html) of a folder of stored pages."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("html"))


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of files that may hold several JSON documents behind each other; see operators.nested."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def triples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("c0 string, c1 string, c2 string").option("escape", '"').csv(path)


def queue(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def initial_pages(spark: SparkSession, urls: list[str], snapshot: DataFrame | None = None) -> DataFrame:
    """(url, html) of given addresses, with stored pages where there are any."""
    first = spark.createDataFrame([(u,) for u in urls], "url string")
    return first.join(snapshot.select("url", "html"), "url", "left") if snapshot is not None else first.withColumn("html", F.lit(None).cast("string"))


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_rows(content: bytes) -> list[list[list[str]]]:
    """Texts of the tables of a Word document: tables of rows of cells."""
    with zipfile.ZipFile(BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    return [[["".join(t.text or "" for t in c.iter(f"{_W}t")) for c in r.findall(f"{_W}tc")] for r in t.findall(f"{_W}tr")] for t in root.iter(f"{_W}tbl")]


def word_tables(spark: SparkSession, path: str) -> DataFrame:
    """The cell relation of Word files: the first cell is the caption, the other rows are the table. Bad files give an error row."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows: list[tuple] = []
            for name, i, content in zip(*(c.to_pylist() for c in b.columns)):
                try:
                    for k, t in enumerate(docx_rows(content)):
                        caption = t[0][0] if t and t[0] else DEFAULT.unnamed
                        cells = [[{"rs": 1, "cs": 1, "c": c} for c in r] for r in t[1:]]
                        rows += [(i, k, "word", caption, name, None, r, c, own, 1, 1, cell["c"], "td", [], [], None) for r, c, own, cell in grid(cells)]
                except Exception as e:
                    rows.append((i, *[None] * 14, repr(e)[:500]))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_ARROW.types)], schema=_ARROW)

    files = spark.read.format("binaryFile").load(path)
    return files.select(F.substring_index("path", "/", -1), F.xxhash64("path"), "content").mapInArrow(run, CELLS)
