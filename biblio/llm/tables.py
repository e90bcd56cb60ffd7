"""Reading tables, checkpoints and numbering shared by the operators of this folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows up to which a side of narrow rows (a few longs) is broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 2_000_000


#: Rows of an Arrow batch at most: batches of texts are held both in the JVM and in Python.
BATCH_ROWS = 2_000


def in_batches(df: DataFrame, function, schema) -> DataFrame:
    """``mapInArrow`` with batches of at most ``BATCH_ROWS`` rows (a setting of the session)."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(name)) <= BATCH_ROWS:
        df.sparkSession.conf.set(name, str(BATCH_ROWS))
    return df.mapInArrow(function, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only on one machine, as in tests, may a temporary folder take its place.
    """
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="checkpoint-")


def settled(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the cluster's shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_digest(df: DataFrame) -> Column:
    """A 64-bit hash of a row's content, null apart from any value."""
    parts = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        parts += [c.isNull(), F.to_json(F.struct(c)) if "map<" in f.dataType.simpleString() else c]
    return F.xxhash64(*parts)


def words_in(text: Column) -> Column:
    """Number of words (runs of anything but ASCII white space) of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def unit(*cols: Column | str, seed: int) -> Column:
    """A repeatable pseudo-random number in (0, 1) made from the given columns."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11)
    return (bits.cast("double") + 0.5) / float(2**53)


def offsets_before(df: DataFrame, key: str, n: str, out: str, fan: int = 4096) -> DataFrame:
    """Add ``out``: the sum of ``n`` over all rows with a smaller ``key`` (a dense integer).

    Two levels of windows keep every window at ``fan`` rows of a group, and one row for each group.
    """
    grouped = df.withColumn("_off_g", F.floor(F.col(key) / fan))
    tops = grouped.groupBy("_off_g").agg(F.sum(n).alias("_off_t"))
    tops = tops.select("_off_g", (F.sum("_off_t").over(Window.orderBy("_off_g").rowsBetween(Window.unboundedPreceding, -1))).alias("_off_b"))
    inner = F.sum(n).over(Window.partitionBy("_off_g").orderBy(key).rowsBetween(Window.unboundedPreceding, -1))
    return (
        grouped.withColumn("_off_i", F.coalesce(inner, F.lit(0)))
        .join(tops, "_off_g")
        .withColumn(out, F.col("_off_i") + F.coalesce("_off_b", F.lit(0)))
        .drop("_off_g", "_off_i", "_off_b")
    )


def with_arrays(df: DataFrame, compute, fields: str, inputs: list[str]) -> DataFrame:
    """``df`` plus the columns of ``fields`` (a DDL string), computed batch by batch in Python.

    ``compute`` gets the Arrow arrays of ``inputs`` and returns one array for each new column.  A
    column of ``df`` with the name of a new one is replaced.
    """
    import pyarrow as pa
    from pyspark.sql.types import StructType

    new = StructType.fromDDL(fields).fields
    keep = [c for c in df.columns if c not in {f.name for f in new}]
    spare = [c for c in inputs if c not in keep]  # read by the computation, not returned
    source = df.select(*(F.col(f"`{c}`") for c in keep + spare))
    schema = StructType([source.schema[c] for c in keep] + new)
    n_keep = len(keep)

    def per_batch(batches):
        from .textbuf import trimmed

        for batch in trimmed(batches):
            got = compute(*(batch.column(batch.schema.get_field_index(c)) for c in inputs))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_keep], *got], names=[f.name for f in schema.fields])

    return in_batches(source, per_batch, schema)


def numbered(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Add ``out``: the 0-based place of each row in the given order.

    Rows are dealt out by ranges, counted for each range and numbered within it.  The range of a row
    is fixed by a checkpoint, so that a recomputed task cannot move it.
    """
    ranged = settled(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    starts = offsets_before(ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")), "_p", "_n", "_start").select("_p", "_start")
    inner = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return ranged.withColumn("_i", inner).join(starts, "_p").withColumn(out, (F.col("_i") + F.col("_start")).cast("long")).drop("_p", "_i", "_start")


def narrow_join(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """A join whose right side, already settled, is broadcast if it is small, and shuffled otherwise."""
    small = right.count() <= BROADCAST_ROWS
    return left.join(F.broadcast(right) if small else right, on, how)
