"""Session helpers shared by operators and queries."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only on a local master (tests) that names none."""
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if shared:
        return shared
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="loomtab-ckpt-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a table written into the shared checkpoint folder (survives the loss of executors).

    The rows are computed once, where a checkpoint of an RDD computes its last stage twice. The table is removed when
    the driver ends.
    """
    return cut_counted(df)[0]


def cut_counted(df: DataFrame, by: str | None = None) -> tuple[DataFrame, int]:
    """The same, with the number of rows, which is counted as they are written; ``by`` is a column of few values that gets folders of its own."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/loomtab-{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.partitionBy(*[by] if by else []).parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path), seen.get["n"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once an application, so that they need no installation of it.

    The archive is served by Spark to all executors; its place on the driver doesn't matter to them.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    made = os.path.join(tempfile.mkdtemp(prefix="loomtab-"), "loomtab.zip")
    with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(made)
    _SHIPPED.add(sc.applicationId)
