"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, lazily."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir of the session.

    Where none is named, a local session (tests) gets a temporary folder of its own, which is
    recorded in the session; on a cluster that folder would not be shared, so it is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.conf.get("lodestream.shared.dir", None)
        if not path:
            if not spark.sparkContext.master.split("[")[0] == "local":
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            path = "file://" + tempfile.mkdtemp(prefix="lodestream-")
            spark.conf.set("lodestream.shared.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends there, and the
    rows survive the loss of any executor."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodestream_path = path
    return out


def tidy(spark: SparkSession) -> None:
    """Lets go of shuffle files that no live plan refers to: Spark removes them once the
    driver's garbage is collected, which a driver with a quiet heap puts off. A plan that
    has just run is still held by the events about it, hence the second collection."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.4)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of ours that no later plan reads."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def drop(df: DataFrame) -> None:
    """Delete a table made by cut() that no later plan reads."""
    path = getattr(df, "_lodestream_path", None)
    if path:
        remove(df.sparkSession, path)


def whole_text(col: str = "text"):
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def pieces(texts, limit: int):
    """Index ranges of consecutive texts holding about `limit` characters each (a longer
    text has a range of its own)."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)
