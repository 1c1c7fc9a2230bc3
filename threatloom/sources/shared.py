"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only where a local session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir names no folder that the cluster shares")
    if not named:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="threatloom-"))
        named = spark.sparkContext.getCheckpointDir()
    return named


def materialize(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write df as Parquet in the shared folder, in a folder for each value of ``by`` if given, and read it again: cuts lineage and
    survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/threatloom-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(df.columns)


def sized_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """df with a broadcast hint if it has at most max_rows rows; else df as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
