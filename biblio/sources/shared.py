"""The folder that driver and executors share, and tables settled in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder takes its place on one machine only."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return found or tempfile.mkdtemp(prefix="biblio-")


def settled(df: DataFrame) -> DataFrame:
    """The frame with its lineage cut by a checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """The frame written to the shared folder and read again, for loops: lineage is cut, and sizes are those of the files.

    A checkpoint keeps the planner's estimate of its size.  A join's is the product of its sides', so where each round joins what the
    round before made, the estimate has twice as many digits each time, and the driver drowns in them.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
