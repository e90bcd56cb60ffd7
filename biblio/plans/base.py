"""The test tables as the library's logical tables, and a register of queries with their SQL twins."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from biblio.sources.shared import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
NOW = 1998


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that must give the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share: below ``spark.checkpoint.dir``, or a local one on one machine."""
    return f"{shared_folder(spark).rstrip('/')}/biblio-{uuid.uuid4().hex}"


def in_place(df: DataFrame, *cols: str) -> DataFrame:
    """The columns of an ordered frame and ``place``, each row's number in that order from 1.

    Rows are written as they are ordered; the places before a partition are the sum of the sizes of those before it.
    """
    folder = scratch(df.sparkSession)
    df.select(*cols, F.monotonically_increasing_id().alias("_m")).write.parquet(folder)
    rows = df.sparkSession.read.parquet(folder).withColumn("_p", F.shiftright("_m", 33))
    counts = rows.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_s", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return rows.join(before, "_p").select(*cols, (F.col("_s") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("place"))


def edges(spark: SparkSession, folder: str) -> DataFrame:
    """(author, work, citations): suppliers of orders; citations are the ordered quantities."""
    return table(spark, folder, "lineitem").groupBy(F.col("l_suppkey").alias("author"), F.col("l_orderkey").alias("work")).agg(F.sum(F.col("l_quantity").cast("int")).alias("citations"))


def works(spark: SparkSession, folder: str) -> DataFrame:
    """(id, year, type, area, owner, citations) of orders."""
    cited = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sum(F.col("l_quantity").cast("int")).alias("citations"))
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("type"), F.col("o_orderpriority").alias("area"), F.col("o_custkey").alias("owner"))
    return orders.join(cited, "id", "left")


def advised(spark: SparkSession, folder: str) -> DataFrame:
    """(id, people[]): the suppliers of an order, in order of lines."""
    lines = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))), lambda x: x["l_suppkey"].cast("string")).alias("people"))
    return lines


def snapshots(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Two versions of orders: some removed, some added, some changed."""
    orders = table(spark, folder, "orders").withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(18,2)"))
    k = F.col("o_orderkey") % 50
    return orders.filter(k != 0), orders.filter(k != 1).withColumn("o_totalprice", F.when(k == 2, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).cast("decimal(18,2)"))


def nodes(spark: SparkSession, folder: str) -> DataFrame:
    """(id, parent, position, label, visible) of a tree over customers: the parent of k is k div 10."""
    return table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") > 0, F.expr("c_custkey div 10")).alias("parent"), (F.col("c_custkey") % 10).alias("position"), F.col("c_name").alias("label"), (F.col("c_custkey") % 7 != 3).alias("visible"))


# The same tables in SQL.
EDGES = "(SELECT l_suppkey AS author, l_orderkey AS work, CAST(sum(CAST(l_quantity AS INTEGER)) AS BIGINT) AS citations FROM lineitem GROUP BY 1, 2)"
WORKS = "(SELECT o_orderkey AS id, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderstatus AS type, o_orderpriority AS area, o_custkey AS owner, c.citations FROM orders LEFT JOIN (SELECT l_orderkey, CAST(sum(CAST(l_quantity AS INTEGER)) AS BIGINT) AS citations FROM lineitem GROUP BY 1) c ON l_orderkey = o_orderkey)"
PREVIOUS = "(SELECT * REPLACE (CAST(o_totalprice AS DECIMAL(18,2)) AS o_totalprice) FROM orders WHERE o_orderkey % 50 <> 0)"
CURRENT = "(SELECT * REPLACE (CAST(CASE WHEN o_orderkey % 50 = 2 THEN CAST(o_totalprice AS DECIMAL(18,2)) + 1 ELSE o_totalprice END AS DECIMAL(18,2)) AS o_totalprice) FROM orders WHERE o_orderkey % 50 <> 1)"
NODES = "(SELECT c_custkey AS id, CASE WHEN c_custkey > 0 THEN c_custkey // 10 END AS parent, c_custkey % 10 AS position, c_name AS label, c_custkey % 7 <> 3 AS visible FROM customer)"
ASCII = r"regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g')"
