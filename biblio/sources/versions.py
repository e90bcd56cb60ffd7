"""Versions of a collection: committed by one atomic pointer, compared by digests of buckets.

A version's files come first, in a folder of their own, dealt into buckets by a hash of the key, with a digest of each bucket beside
them.  Then a numbered pointer is renamed into place; a name that is taken is refused.  Readers follow the highest pointer, so a
writer that dies halfway leaves the last version as it was, and of two writers that go on from the same version the second is told.

Two versions differ only in buckets whose digests differ: only these buckets' files are read to tell which rows changed.

Defined cases: a null key falls into a bucket like any other; repeated rows count in the digests; a new or dropped column changes the
digest of every row, and is told by ``columns_changed``; an empty version has no buckets.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from biblio.operators.snapshot import GateError, diff, semantic

BUCKETS = 256
POINTERS = "pointers"


def _files(spark: SparkSession, path: str):
    """The file system of a path, and the path, as Spark's own readers see them."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def pointers(spark: SparkSession, root: str) -> list[int]:
    """Numbers of all committed versions."""
    fs, folder = _files(spark, f"{root.rstrip('/')}/{POINTERS}")
    if not fs.exists(folder):
        return []
    names = (s.getPath().getName() for s in fs.listStatus(folder))
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != "_")


def pointer(spark: SparkSession, root: str, number: int | None = None, version: str | None = None) -> dict:
    """What a pointer says: that of a number, the last one of a version, or the last of all."""
    for n in reversed(pointers(spark, root)):
        if number in (None, n):
            says = json.loads(spark.read.text(f"{root.rstrip('/')}/{POINTERS}/{n:012}.json", wholetext=True).first()[0])
            if version in (None, says["version"]):
                return says
    raise LookupError(f"no such version below {root}: {version or number}")


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(41), F.col(f"`{key}`")), F.lit(buckets)).cast("int")


def bucket_digests(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """(bucket, n, digest): number of rows, and two sums over row hashes that no order changes."""
    rows = semantic(df)
    parts = [x for c in sorted(rows.columns) for x in (F.lit(c), F.col(f"`{c}`").isNull(), F.to_json(F.struct(f"`{c}`")) if "map<" in rows.schema[c].dataType.simpleString() else F.col(f"`{c}`"))]
    hashed = rows.select(bucket_of(key, buckets).alias("bucket"), F.xxhash64(F.lit(1), *parts).alias("a"), F.xxhash64(F.lit(2), *parts).alias("b"))
    sums = hashed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("a").alias("x"), F.sum(F.col("b").cast("decimal(38,0)")).alias("s"))
    return sums.select("bucket", "n", F.concat_ws(":", "x", "s").alias("digest"))


def commit(df: DataFrame, root: str, version: str, key: str | None = None, expected: int | None = None, buckets: int = BUCKETS, gates: list = ()) -> int:
    """Write a version and point to it; returns its number.  Without a key rows are one bucket of files, which can't be compared.

    ``expected`` is the number of the version that this one follows (0: none), by default the last one now.  Gates see the written
    rows before the pointer; a gate that raises leaves the versions as they are.
    """
    spark, root = df.sparkSession, root.rstrip("/")
    known = pointers(spark, root)
    follows = (known[-1] if known else 0) if expected is None else expected
    if follows != (known[-1] if known else 0):
        raise GateError(f"version {follows} is not the last one")
    folder = f"{root}/files/{version}-{uuid.uuid4().hex}"
    if key is None:
        df.write.parquet(f"{folder}/rows")
    else:
        df.withColumn("_bucket", bucket_of(key, buckets)).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{folder}/rows")
    says = {"number": follows + 1, "version": version, "folder": folder, "key": key, "buckets": buckets, "schema": df.schema.json()}
    written = _rows(spark, says)
    for gate in gates:
        gate(written)
    if key is not None:
        bucket_digests(written, key, buckets).coalesce(1).write.parquet(f"{folder}/digests")
    fs, ready = _files(spark, f"{root}/{POINTERS}/_{uuid.uuid4().hex}")
    out = fs.create(ready, False)
    out.write(json.dumps(says).encode())
    out.close()
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(f"{root}/{POINTERS}/{follows + 1:012}.json")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    never = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    never[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE  # a name that is taken is an error
    try:
        context.rename(ready, place, never)
    except Exception as e:
        fs.delete(ready, False)
        if fs.exists(place):
            raise GateError(f"version {follows} has a successor already") from e
        raise
    return follows + 1


def _rows(spark: SparkSession, says: dict, buckets: list[int] | None = None) -> DataFrame:
    schema = StructType.fromJson(json.loads(says["schema"]))
    whole = spark.read.schema(schema if says["key"] is None else StructType([*schema.fields]).add("_bucket", IntegerType())).parquet(f"{says['folder']}/rows")
    if buckets is not None:
        whole = whole.filter(F.col("_bucket").isin(buckets))
    return whole.select(*(F.col(f"`{c}`") for c in schema.names))


def read_version(spark: SparkSession, root: str, version: str | None = None, number: int | None = None) -> DataFrame:
    """Rows of a version, the last one if none is named."""
    return _rows(spark, pointer(spark, root, number, version))


def differing_buckets(spark: SparkSession, old: dict, new: dict) -> list[int]:
    """Buckets whose digests differ between two versions' pointers; there are ``buckets`` at most."""
    a, b = (spark.read.schema("bucket int, n long, digest string").parquet(f"{x['folder']}/digests") for x in (old, new))
    both = a.join(b.select("bucket", F.col("n").alias("_n"), F.col("digest").alias("_digest")), "bucket", "full_outer")
    return sorted(r[0] for r in both.filter(~F.col("n").eqNullSafe(F.col("_n")) | ~F.col("digest").eqNullSafe(F.col("_digest"))).select("bucket").collect())


def changes(spark: SparkSession, root: str, old: int, new: int) -> DataFrame:
    """(key, status, changed_fields) of the rows that two versions don't share; only differing buckets are read."""
    a, b = pointer(spark, root, old), pointer(spark, root, new)
    if a["key"] is None or (a["key"], a["buckets"]) != (b["key"], b["buckets"]):
        raise ValueError("versions have different buckets, or none")
    some = differing_buckets(spark, a, b)
    return diff(_rows(spark, a, some), _rows(spark, b, some), a["key"]).filter("status <> 'unchanged'")


def columns_changed(spark: SparkSession, root: str, old: int, new: int) -> dict[str, list[str]]:
    """Columns that one of two versions has and the other hasn't."""
    a, b = ({f["name"] for f in json.loads(pointer(spark, root, n)["schema"])["fields"]} for n in (old, new))
    return {"added": sorted(b - a), "dropped": sorted(a - b)}
