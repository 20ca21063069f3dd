"""Continuous extraction, graph building and link deduplication.

Progress is the checkpoint, in place of reading and deleting queue rows: a restarted job neither loses nor repeats rows.
Sinks write one folder per micro-batch, so that a repeated batch replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomtab.config import DEFAULT, Config
from loomtab.operators import crawl, graph, html


def queue_stream(spark: SparkSession, path: str, files_a_batch: int = 8) -> DataFrame:
    """A queue folder as a stream with a bounded batch."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def start(df: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    w = df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def run(df: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Work off what is there, then stop."""
    q = start(df, each, checkpoint)
    q.awaitTermination()
    if q.exception():
        raise q.exception()


def extract_cells(pages: DataFrame, out: str, checkpoint: str, config: Config = DEFAULT, id_col: str = "page_id") -> None:
    """Pages → cells, without loss of a stage by a bad page."""
    run(pages, lambda b, n: html.parse_tables(b, config, id_col).write.mode("overwrite").parquet(f"{out}/batch={n}"), checkpoint)


def links_once(pages: DataFrame, checkpoint: str, out: str, id_col: str = "page_id") -> None:
    """Distinct links over all pages; the state store keeps one small row per link."""
    got = crawl.links_flat(pages, id_col).dropDuplicates(["href"])
    q = got.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()


def build_graph(entities: DataFrame, out: str, checkpoint: str) -> None:
    """Entities → first values of properties, merged with those before: each batch writes the next state of the store."""

    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        rows = batch.select("seq", "name", "prop", "value")
        if n > 0:
            rows = rows.unionByName(spark.read.parquet(f"{out}/state={n - 1}"))
        best = rows.groupBy("name", "prop").agg(F.min(F.struct("seq", "value")).alias("x"))
        best.select("x.seq", "name", "prop", "x.value").write.mode("overwrite").parquet(f"{out}/state={n}")

    run(entities, merge, checkpoint)


def graph_state(spark: SparkSession, out: str) -> DataFrame:
    """The latest state written by :func:`build_graph`."""
    t = spark.read.parquet(out)
    last = t.agg(F.max("state")).first()[0]
    return graph.nodes_by_name(t.where(F.col("state") == last)) if last is not None else t


def flush_queue(links: DataFrame, out: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """New links to the queue folder, batch by batch."""
    return start(links, lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}"), checkpoint, every)


def windowed_counts(events: DataFrame, time: str = "ts", late: str = "1 hour", width: str = "10 minutes") -> DataFrame:
    """Rows by window of event time, with a watermark for late ones."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w")).count().select(F.col("w.start").alias("start"), F.col("count").alias("n"))
