"""Windows, ordering, limits and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biblio.sources.shared import settled


def with_positions(df: DataFrame, values: str) -> DataFrame:
    """One row for each element of an array, with its 1-based position."""
    return df.select("*", F.posexplode(values).alias("_p", "element")).withColumn("position", F.col("_p") + 1).drop("_p", values)


def position_of(df: DataFrame, values: str, wanted: Column, out: str = "position") -> DataFrame:
    """1-based place of a value in an array, null if absent."""
    return df.withColumn(out, F.nullif(F.array_position(values, wanted), F.lit(0)))


def first_wins(df: DataFrame, key: str, order: list[str], gather: str | None = None) -> DataFrame:
    """The first row of each key; ``gather`` collects that column over all of them, sorted."""
    cols = [c for c in df.columns if c != key]
    kept = df.groupBy(key).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("_r"), *([F.sort_array(F.collect_set(gather)).alias(f"all_{gather}")] if gather else []))
    return kept.select(key, "_r.*", *([f"all_{gather}"] if gather else []))


def prefer_linked(df: DataFrame, key: str, link: str, pos: str) -> DataFrame:
    """Of rows of one key, the only one whose link is the key, else the first; ``choice`` says which rule held."""
    linked = F.col(link) == F.col(key)
    per = df.groupBy(key).agg(F.count_if(linked).alias("_l"), F.min(F.when(linked, F.col(pos))).alias("_lp"), F.min(pos).alias("_fp"), F.count(F.lit(1)).alias("_n"))
    chosen = per.select(key, F.when(F.col("_l") == 1, F.col("_lp")).otherwise(F.col("_fp")).alias(pos), F.when(F.col("_n") == 1, "only").when(F.col("_l") == 1, "linked").otherwise("first").alias("choice"))
    return df.join(chosen, [key, pos])


def scanned(df: DataFrame, group: str, order: list[str], counts: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, ranges: int | None = None) -> DataFrame:
    """Add running sums (``counts``) and last values so far that are not null (``lasts``) of each group's rows, in order.

    A segmented scan: rows are dealt by ranges of group and order, however few groups there are, and scanned range by range; what
    a group's earlier ranges end with is carried into the next.  Only a range's first group can go on from another, so that there is
    one carried row a range at most, which is broadcast.  ``order`` must tell any two rows of a group apart.
    """
    counts, lasts = counts or {}, lasts or {}
    marks = {f"_c_{c}": x.cast("long") for c, x in counts.items()} | {f"_l_{c}": x for c, x in lasts.items()}
    keys = [F.col(c) for c in (group, *order)]
    dealt = df.withColumns(marks)
    dealt = dealt.repartitionByRange(ranges, *keys) if ranges else dealt.repartitionByRange(*keys)
    rows = settled(dealt.withColumn("_range", F.spark_partition_id()))
    inner = Window.partitionBy("_range", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    at = F.struct(*order)
    ends = rows.groupBy("_range", F.col(group).alias("_group")).agg(*(F.sum(f"_c_{c}").alias(f"_c_{c}") for c in counts), *(F.max_by(f"_l_{c}", F.when(F.col(f"_l_{c}").isNotNull(), at)).alias(f"_l_{c}") for c in lasts))
    before = Window.partitionBy("_group").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("_range", "_group", F.row_number().over(Window.partitionBy("_group").orderBy("_range")).alias("_n"), *(F.sum(f"_c_{c}").over(before).alias(f"_b_{c}") for c in counts), *(F.last(f"_l_{c}", ignorenulls=True).over(before).alias(f"_b_{c}") for c in lasts)).filter("_n > 1").drop("_n").withColumnRenamed("_range", "_into")
    own = rows.withColumns({f"_c_{c}": F.sum(f"_c_{c}").over(inner) for c in counts} | {f"_l_{c}": F.last(f"_l_{c}", ignorenulls=True).over(inner) for c in lasts})
    both = own.join(F.broadcast(carried), (F.col("_range") == F.col("_into")) & F.col(group).eqNullSafe(F.col("_group")), "left")
    done = both.withColumns({c: F.coalesce(F.col(f"_c_{c}"), F.lit(0)) + F.coalesce(F.col(f"_b_{c}"), F.lit(0)) for c in counts} | {c: F.coalesce(f"_l_{c}", f"_b_{c}") for c in lasts})
    return done.select(*(c for c in df.columns if c not in {*counts, *lasts}), *counts, *lasts)


def carry_forward(df: DataFrame, group: str, label: str, order: list[str], blanks: tuple[str, ...] = ("", "t"), ranges: int | None = None) -> DataFrame:
    """A row with a blank label takes the last one before it; ``order`` must tell any two rows of a group apart."""
    named = F.when(~F.col(label).isin(*blanks), F.col(label))
    return scanned(df, group, order, lasts={"_label": named}, ranges=ranges).withColumn(label, F.coalesce("_label", F.lit(""))).select(*df.columns)


def blocks(df: DataFrame, group: str, is_header: Column, order: list[str], ranges: int | None = None) -> DataFrame:
    """Number the blocks of a line stream that header lines open; lines before the first have block 0.

    ``order`` must tell any two lines of a group apart.
    """
    return scanned(df, group, order, counts={"block": F.coalesce(is_header, F.lit(False)).cast("int")}, ranges=ranges)


def parse_blocks(lines: DataFrame, group: str, order: str, header: str, fields: dict[str, str], stop: str | None = None, ranges: int | None = None) -> DataFrame:
    """(group, block, field, value) of a line stream.

    ``header`` opens a block, a pattern of ``fields`` begins a field (the rest of its line is its first part),
    other lines continue the field, a line like ``stop`` ends it, and lines of digits only (page numbers) are left out.
    """
    text = F.trim("line")
    opened = F.coalesce(*(F.when(text.rlike(p), F.lit(f)) for f, p in fields.items()))
    rest = reduce(lambda c, fp: F.when(text.rlike(fp[1]), F.regexp_replace(text, fp[1], "")).otherwise(c), fields.items(), text)
    ended = text.rlike(header) | (text.rlike(stop) if stop else F.lit(False))
    mark = F.when(opened.isNotNull(), opened).when(ended, F.lit(""))
    placed = scanned(lines.filter(~text.rlike(r"^\d+$")), group, [order], {"block": F.trim("line").rlike(header).cast("int")}, {"field": mark}, ranges).withColumn("_rest", F.trim(rest))
    kept = placed.filter("block > 0 and field <> '' and _rest <> ''")
    return kept.groupBy(group, "block", "field").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "_rest"))), lambda x: x["_rest"]), " ").alias("value"))


def top_k(df: DataFrame, by: str, k: int, tie: str) -> DataFrame:
    return df.orderBy(F.desc(by), tie).limit(k)


def by_year_desc(df: DataFrame, year: str = "year", tie: str = "id") -> DataFrame:
    """Latest first; rows without a year come last."""
    return df.orderBy(F.desc(F.coalesce(F.nullif(F.col(year).cast("string"), F.lit("")), F.lit("0000"))), tie)


def new_first(df: DataFrame, is_new: Column) -> DataFrame:
    """Added rows by year and id, latest first, then the others in their order."""
    return df.withColumn("_n", is_new).orderBy(F.desc("_n"), F.when(F.col("_n"), F.struct("year", "id")).desc_nulls_last(), "pos").drop("_n")


def by_rank(df: DataFrame, ranks: dict[str, int], group: str, pos: str) -> DataFrame:
    """Order by the rank of a group (unknown groups last), then by position."""
    rank = F.coalesce(*(F.when(F.col(group) == g, F.lit(r)) for g, r in ranks.items()), F.lit(len(ranks)))
    return df.orderBy(rank, pos)


def tree_order(df: DataFrame) -> DataFrame:
    return df.orderBy("parent", "position", "id")


def cap(df: DataFrame, per: str, n: int, order: list[str]) -> DataFrame:
    """The first n rows of each category."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(per).orderBy(*order))).filter(F.col("_r") <= n).drop("_r")


def stable_merge_order(df: DataFrame) -> DataFrame:
    """Rows that were there keep their order; new ones follow by id."""
    return df.orderBy(F.col("old_pos").isNull(), "old_pos", "id")


def union_all(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def tagged_union(parts: dict[str, DataFrame], tag: str = "kind") -> DataFrame:
    return union_all(*(df.withColumn(tag, F.lit(name)) for name, df in parts.items()))


def set_diff(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): ids in ``a`` only, ``b`` only or both."""
    x = a.select(key).distinct().withColumn("_a", F.lit(True))
    y = b.select(key).distinct().withColumn("_b", F.lit(True))
    return x.join(y, key, "full_outer").select(key, F.when(F.col("_a").isNull(), "right").when(F.col("_b").isNull(), "left").otherwise("both").alias("side"))


def item_sets(a: Column, b: Column) -> dict[str, Column]:
    """Items of two arrays in either, in both, in the first only and in the second only; each once, sorted."""
    found = {"union": F.array_union(a, b), "common": F.array_intersect(a, b), "left": F.array_except(a, b), "right": F.array_except(b, a)}
    return {name: F.array_sort(items) for name, items in found.items()}


def same_set(a: DataFrame, b: DataFrame) -> bool:
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def paginate(df: DataFrame, order: list[str], size: int = 12) -> DataFrame:
    """Page of each row of a listing, from 1; a listing is ordered whole, by ranges of its order."""
    ranged = df.repartitionByRange(*(F.col(c) for c in order)).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    counts = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.withColumn("_s", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inner = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return ranged.withColumn("_i", inner).join(starts, "_p").withColumn("page", F.ceil((F.col("_i") + F.col("_s")) / size)).drop("_p", "_i", "_s")
