"""Resumable incremental ingest.

A file stream with a checkpoint takes every file once, over any number of runs: a run that stops goes on where it was.
A fresh checkpoint takes all files again.  The target is dealt into buckets by a hash of the key, each with a folder a batch: a batch
looks only into the buckets that its own keys fall into, and writes only there; what is there already is not written again.

A batch adds the rows of ids that none before had; those of ``force`` are taken although they are there, and with ``replace`` all are.
The last batch that brought an id has its row.

Defined cases: of rows of one id in a batch the smallest stays; a null id is an id; a batch that is run again after a failure gives
the same folders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from biblio.sources.versions import _files, bucket_of

BUCKETS = 256


def one_each(batch: DataFrame, key: str) -> DataFrame:
    """The smallest row of each id."""
    cols = [c for c in batch.columns if c != key]
    return batch.groupBy(key).agg(F.min(F.struct(*cols)).alias("_r")).select(key, "_r.*") if cols else batch.distinct()


def add_new(previous: DataFrame | None, batch: DataFrame, key: str) -> DataFrame:
    """What a batch adds: the first row of each id that is not there."""
    first = one_each(batch, key)
    if previous is None:
        return first
    there = previous.select(F.col(key).alias("_there")).distinct()
    return first.join(there, F.col(key).eqNullSafe(F.col("_there")), "left_anti")


def take_all(previous: DataFrame | None, batch: DataFrame, key: str) -> DataFrame:
    """A row of each id of the batch, whether it is there or not."""
    return one_each(batch, key)


def forcing(ids: DataFrame, adds: Callable = add_new) -> Callable:
    """As ``adds``, but the ids of a frame are taken although they are there."""

    def taken(previous: DataFrame | None, batch: DataFrame, key: str) -> DataFrame:
        again = ids.select(F.col(key).alias("_again")).distinct()
        kept = previous if previous is None else previous.join(again, F.col(key).eqNullSafe(F.col("_again")), "left_anti")
        return adds(kept, batch, key)

    return taken


def incremental_ingest(spark: SparkSession, source: str, schema: T.StructType, checkpoint: str, target: str, key: str, adds: Callable[[DataFrame | None, DataFrame, str], DataFrame] = add_new, files_per_batch: int = 1000, buckets: int = BUCKETS, replace: bool = False, force: DataFrame | None = None) -> int:
    """Take the files that no run has taken; returns the number of batches.

    Every batch writes what ``adds(rows before it in its buckets, batch, key)`` returns.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    root = target.rstrip("/")
    choose = take_all if replace else adds if force is None else forcing(force, adds)

    def take(batch: DataFrame, n: int) -> None:
        marked = batch.withColumn("_bucket", bucket_of(key, buckets))
        touched = sorted(r[0] for r in marked.select("_bucket").distinct().collect())  # ``buckets`` at most
        before = None if replace else _before(spark, root, schema, touched, n)
        rows = choose(before, batch, key)
        rows.withColumns({"_bucket": bucket_of(key, buckets), "batch": F.lit(n)}).repartition("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket", "batch").parquet(root)

    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    last = query.lastProgress
    return 0 if last is None else last["batchId"] + (1 if last["numInputRows"] else 0)


def _before(spark: SparkSession, root: str, schema: T.StructType, touched: list[int], n: int) -> DataFrame | None:
    """Rows of earlier batches in some buckets; other buckets' folders are not even listed."""
    paths = [f"{root}/_bucket={b}" for b in touched]
    fs, _ = _files(spark, root)
    there = [p for p in paths if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p))]
    if not there:
        return None
    whole = T.StructType([*schema.fields, T.StructField("_bucket", T.IntegerType()), T.StructField("batch", T.IntegerType())])
    return spark.read.schema(whole).option("basePath", root).parquet(*there).filter(F.col("batch") < n).drop("_bucket", "batch")


def ingested(spark: SparkSession, target: str, key: str | None = None) -> DataFrame:
    """Rows of all batches; with a key, the row of the last batch that brought it."""
    rows = spark.read.parquet(target)
    if key is None:
        return rows.drop("_bucket", "batch")
    cols = [c for c in rows.columns if c not in (key, "_bucket", "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*cols), "batch").alias("_r")).select(key, "_r.*")
