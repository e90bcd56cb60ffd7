"""Operator 10: sharding by a two-pass external shuffle.

Pass one scatters records uniformly into buckets of about ``bucket_bytes``, and ``BUCKET_ROWS`` at most, by a seeded hash,
shuffles each bucket in memory (Fisher-Yates over places, with a seeded hash of the bucket and the step as its random number;
Spark's own ``shuffle`` goes on from bucket to bucket, so its outcome is the task's) and writes it.  Pass two numbers
the written records through, bucket after bucket, and cuts the sequence into shards whose row counts
differ by one at most (law ``rows``).

The hash is of the seed, the record's whole content and its number among equal records, so that the result depends on the
records alone, not on how they are split, and equal records spread like any others.  Only records that occur more than once
get numbers: a first pass over digests finds them (broadcast where they are few), they are counted before they move, and told
apart again in runs of ``RUN``, however many one has.

Defined cases: null text has no bytes; a text longer than a bucket is a record like any other; null ids are ids like any
other; equal texts and repeated rows are records of their own; an empty table gives an empty result; with fewer records than
shards some shards stay empty; columns with the names of new ones are replaced; maps are compared by their entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import free_name, narrow_join, offsets_before, row_digest, settled, table

SHARDS = 24
BUCKET_BYTES = 1 << 20
#: Records of a bucket on average at most: a step of the shuffle copies the places so far.
BUCKET_ROWS = 1024
#: Copies of one record that a task tells apart.
RUN = 1024


def told_apart(df: DataFrame, out: str) -> DataFrame:
    """``df``, in any order, plus ``out``: the number of each row among rows equal to it, from 0."""
    digest, n = free_name(df, "_digest"), free_name(df, "_n")
    rows = df.withColumn(digest, row_digest(df))
    repeated = settled(rows.groupBy(digest).agg(F.count(F.lit(1)).alias(n)).filter(F.col(n) > 1))
    if repeated.isEmpty():
        return df.withColumn(out, F.lit(0).cast("long"))
    marked = narrow_join(rows, repeated, digest, "left")
    alone = marked.filter(F.col(n).isNull()).select(*(F.col(f"`{c}`") for c in df.columns), F.lit(0).cast("long").alias(out))
    counted = marked.filter(F.col(n).isNotNull()).groupBy(*(F.col(f"`{c}`") for c in df.columns), digest).agg(F.count(F.lit(1)).alias(n))
    runs = counted.withColumn(out, F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1, F.lit(RUN).cast("long")))).repartition(digest, out)
    each = runs.withColumn(out, F.explode(F.sequence(F.col(out), F.least(F.col(out) + RUN, F.col(n)) - 1)))
    return alone.unionByName(each.drop(digest, n))


def fisher_yates(rows: Column, seed: int, bucket: Column) -> Column:
    """An array in an order that the seed and the bucket decide: each place is swapped into those before it."""

    def step(places: Column, i: Column) -> Column:
        j = F.pmod(F.xxhash64(F.lit(seed), bucket, i), i + 1).cast("int")
        swapped = F.concat(F.slice(places, F.lit(1), j), F.array(i), F.slice(places, j + 2, i - j - 1), F.array(F.try_element_at(places, j + 1)))
        return F.when(j == i, F.array_append(places, i)).otherwise(swapped)

    order = F.aggregate(F.sequence(F.lit(0), F.size(rows) - 1), F.array().cast("array<int>"), step)
    return F.transform(order, lambda p: F.element_at(rows, p + 1))


def shuffled(df: DataFrame, size: str | Column, shards: int = SHARDS, bucket_bytes: int = BUCKET_BYTES, seed: int = 10) -> DataFrame:
    """``df`` plus ``shard`` and ``slot``, its random place; ``size`` is a record's bytes."""
    total = df.agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("b")).first()
    n_rows, buckets = total["n"], max(1, -(-(total["b"] or 0) // bucket_bytes), -(-total["n"] // BUCKET_ROWS))
    keep = [c for c in df.columns if c not in ("shard", "slot")]
    maps = {f.name for f in df.schema.fields if f.dataType.typeName() == "map"}
    plain = df.select(*(F.array_sort(F.map_entries(f"`{c}`")).alias(c) if c in maps else F.col(f"`{c}`") for c in keep))
    number, bucket = free_name(plain, "_number"), free_name(plain, "_bucket")
    record = F.struct(*(F.col(f"`{c}`") for c in keep))
    scattered = told_apart(plain, number).withColumn(bucket, F.pmod(F.xxhash64(F.lit(seed), row_digest(plain), number), F.lit(buckets))).select(F.col(bucket).alias("_b"), record.alias("_r"))
    gathered = scattered.groupBy("_b").agg(F.array_sort(F.collect_list("_r")).alias("_rows"))
    written = settled(gathered.withColumn("_rows", fisher_yates(F.col("_rows"), seed, F.col("_b"))))
    starts = offsets_before(written.select("_b", F.size("_rows").alias("_n")), "_b", "_n", "_start").select("_b", "_start")
    placed = narrow_join(written, settled(starts), "_b").select(F.posexplode("_rows").alias("_i", "_row"), "_start").withColumn("_at", F.col("_start") + F.col("_i"))
    shard = F.expr(f"cast((_at * {shards}) div {max(n_rows, 1)} as int)")
    first = F.expr(f"(shard * {n_rows}L + {shards - 1}) div {shards}")
    back = (F.map_from_entries(F.col(f"_row.`{c}`")).alias(c) if c in maps else F.col(f"_row.`{c}`") for c in keep)
    return placed.withColumn("shard", shard).withColumn("slot", F.col("_at") - first).select(*back, "shard", "slot")


def op10_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    size = (F.octet_length(raw) + 8).cast("long")
    out = shuffled(table(spark, sf_dir, "documents"), size)  # whole documents; digests are of what comes out
    return out.select("doc_id", size.alias("size"), F.crc32(raw).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
