"""Operator 2: mixing sources to target weights by Pareto order sampling.

Sources share a word budget by weight; a source stops at ``most`` times its size and the excess goes
to the others.  Within a source a document's expected copies are in proportion to its weight (the binary digits of its
size, so longer documents count for somewhat more), ``most`` at most, and meet the target in expectation.
Their whole part is certain; the rest is a document's inclusion probability in a sample of a fixed number of words:
documents are ranked by Pareto's order variable, their random odds divided by their inclusion odds, and taken in that
order until the target is met, so the last one taken may give a part of its words.

The ranking never sorts a whole source at once.  Order variables fall into intervals, as many as the source has
rows for (``MEET`` each); sums for each (source, interval) tell which intervals are taken whole and which one the
target cuts.

Defined cases: null text has no words, is given 0 words and 0 copies; a null source is a source of
its own, after all others; very long texts weigh by their digits like any other; equal order variables are ordered by key
and size, and rows that agree in all are interchangeable; an empty table gives an empty result; columns that the
arguments do not name are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import free_name, narrow_join, numbered, row_digest, settled, table, words_in

#: Rows of an interval of order variables, about.
MEET = 4_000
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0


def water_level(sources: DataFrame, budget: float, most: float) -> float:
    """The level at which ``sum(least(most * size, level * weight))`` meets the budget."""
    level, capped = 0.0, -1
    while True:
        full = F.lit(level) * F.col("_weight") >= F.lit(most) * F.col("_size")
        got = sources.agg(F.sum(F.when(full, F.col("_size"))).alias("s"), F.count(F.when(full, 1)).alias("n"), F.sum(F.when(~full, F.col("_weight"))).alias("w")).first()
        if got["n"] == capped or not got["w"]:
            return level
        capped, level = got["n"], (budget - most * (got["s"] or 0)) / got["w"]


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(_k, _size, target) of each source from (_k, source, _size); weights repeat in code point order, null last."""
    ranked = numbered(sizes, [F.col("source").asc_nulls_last()], "_rank")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("_rank") % len(weights) + 1).cast("int"))
    sources = settled(ranked.withColumn("_weight", weight))
    total = sources.agg(F.sum("_size")).first()[0] or 0
    level = water_level(sources, share * total, most)
    return sources.select("_k", "_size", F.least(F.lit(most) * F.col("_size"), F.lit(level) * F.col("_weight")).alias("target"))


def uniform(key: Column, text: Column, seed: int) -> Column:
    """A repeatable number in (0, 1) from 52 bits of a digest."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"), F.md5(F.coalesce(text, F.lit("")))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)


def rates(classes: DataFrame, per_source: DataFrame, most: float) -> DataFrame:
    """(_k, _size, target, _rate, _rest, _mean): what a unit of weight is copied in expectation, the words left to sample.

    The sum of ``least(most, rate * weight)`` over all words is the least of its values with any heaviest weights at
    ``most``, so the rate that meets the target is the largest of those that meet it so.
    """
    heaviest = Window.partitionBy("_k").orderBy(F.desc("_w")).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.partitionBy("_k").orderBy(F.desc("_w")).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    full, left = F.coalesce(F.sum("_words").over(heaviest), F.lit(0)), F.sum(F.col("_w") * F.col("_words")).over(rest)
    rate = F.when(left > 0, (F.col("target") - F.lit(most) * full) / left)
    found = classes.join(per_source, "_k").withColumn("_r", rate).withColumn("_rate", F.coalesce(F.max("_r").over(Window.partitionBy("_k")), F.lit(0.0)))
    sure = F.sum(F.floor(F.least(F.lit(most), F.col("_rate") * F.col("_w"))).cast("long") * F.col("_words"))
    out = found.groupBy("_k").agg(F.first("_size").alias("_size"), F.first("target").alias("target"), F.first("_rate").alias("_rate"), F.sum("_n").alias("_rows"), (F.round(F.first("target")).cast("long") - sure).alias("_rest"))
    mean = F.least(F.greatest(F.col("_rest") / F.greatest(F.col("_size"), F.lit(1)), F.lit(0.001)), F.lit(0.999))
    return out.withColumn("_mean", (1 - mean) / mean)


def sample(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 2, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, size, source_size, target, taken, copies, order_odds) of each document, and the columns to carry.

    ``taken`` counts words, ``copies`` the times a document is wanted whole (a part of at least half of
    its words counts as one); ``order_odds`` ranks a document, null if no copy of it is left to chance.
    """
    size = words_in(F.col(f"`{text}`"))
    narrow = settled(
        docs.select(
            F.col(f"`{key}`").alias("_id"),
            F.col(f"`{source}`").alias("source"),
            F.concat_ws("", F.when(F.col(f"`{source}`").isNotNull(), F.lit("s")), F.col(f"`{source}`")).alias("_k"),
            size.alias("size"),
            uniform(F.col(f"`{key}`"), F.col(f"`{text}`"), seed).alias("_u"),
            *carry,
        ).withColumn("_w", F.length(F.bin("size")))
    )
    classes = settled(narrow.groupBy("_k", "_w").agg(F.min("source").alias("source"), F.sum("size").alias("_words"), F.count(F.lit(1)).alias("_n")))
    per_source = targets(classes.groupBy("_k").agg(F.min("source").alias("source"), F.sum("_words").alias("_size")), weights, share, most)
    known = settled(rates(classes.select("_k", "_w", "_words", "_n"), per_source, most))
    copies = F.least(F.lit(most), F.col("_rate") * F.col("_w"))
    chance = F.col("_e") - F.col("_whole")
    odds = F.when((F.col("size") > 0) & (chance > 0), (F.col("_u") / (1 - F.col("_u"))) / (chance / (1 - chance)))
    ranked = narrow_join(narrow.drop("source"), known, "_k").withColumn("_e", copies).withColumn("_whole", F.floor("_e").cast("long")).withColumn("order_odds", odds)
    # the share of a logistic curve below the order variable is about even
    place = F.coalesce(F.col("order_odds") / (F.col("order_odds") + F.col("_mean")), F.col("_u"))
    placed = settled(ranked.withColumn("_b", F.floor(place * F.ceil(F.col("_rows") / MEET)).cast("long")).select("_id", "size", "_u", "_k", "_size", "target", "_rest", "_whole", "order_odds", "_b", *carry))
    chosen = F.when(F.col("order_odds").isNotNull(), F.col("size")).otherwise(0)
    intervals = placed.groupBy("_k", "_b").agg(F.sum(chosen).alias("_words"))
    before = F.coalesce(F.sum("_words").over(Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cuts = settled(intervals.select("_k", "_b", before.alias("_before")))
    inner = F.coalesce(F.sum(chosen).over(Window.partitionBy("_k", "_b").orderBy(F.col("order_odds").asc_nulls_last(), "_id", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = F.greatest(F.lit(0), F.least(chosen, F.col("_rest") - F.col("_before") - F.col("_inner")))
    return (
        placed.join(cuts, ["_k", "_b"])
        .withColumn("_inner", inner)
        .withColumn("_part", part)
        .select(
            F.col("_id").alias(key),
            "size",
            F.col("_size").alias("source_size"),
            "target",
            (F.col("_whole") * F.col("size") + F.col("_part")).alias("taken"),
            F.when(F.col("size") == 0, 0).otherwise(F.col("_whole") + F.when(2 * F.col("_part") >= F.col("size"), 1).otherwise(0)).alias("copies"),
            "order_odds",
            *carry,
        )
    )


def mixed(docs: DataFrame, key: str = "doc_id", **how) -> DataFrame:
    """``docs`` with every document repeated as often as the mix wants it whole; rows of one key go together.

    A row with a null key goes by its content, so that only rows that agree in every column go together.
    """
    mark, times, copy = (free_name(docs, x) for x in ("_mix", "_copies", "_copy"))
    keyed = docs.withColumn(mark, F.struct(F.col(f"`{key}`").alias("key"), F.when(F.col(f"`{key}`").isNull(), row_digest(docs)).alias("content")))
    wanted = sample(keyed, key, carry=(mark,), **how).filter("copies > 0").groupBy(mark).agg(F.max("copies").cast("int").alias(times))
    return narrow_join(keyed, settled(wanted), mark).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*(F.col(f"`{c}`") for c in docs.columns))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, (CAST('0x' || substr(md5(concat_ws('|', '2', CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM documents),
w AS (SELECT *, length(CASE WHEN size = 0 THEN '0' ELSE ltrim(bin(size), '0') END) AS w FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)]::DOUBLE AS weight FROM w GROUP BY source),
l AS (SELECT max((1.5::DOUBLE * total - 2.0::DOUBLE * full_) / left_) AS level FROM (SELECT sum(source_size) OVER () AS total, coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_, sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_ FROM s)),
t AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, level * weight) AS target FROM s, l),
c AS (SELECT source, w, CAST(sum(size) AS BIGINT) AS words FROM w GROUP BY 1, 2),
r AS (SELECT c.source, w, words, source_size, target, max((target - 2.0::DOUBLE * full_) / nullif(left_, 0)) OVER (PARTITION BY c.source) AS rate FROM (SELECT *, CAST(coalesce(sum(words) OVER (PARTITION BY source ORDER BY w DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS full_, CAST(sum(w * words) OVER (PARTITION BY source ORDER BY w DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS left_ FROM c) c JOIN t ON c.source IS NOT DISTINCT FROM t.source),
k AS (SELECT source, any_value(source_size) AS source_size, any_value(target) AS target, coalesce(any_value(rate), 0) AS rate, CAST(round(any_value(target)) AS BIGINT) - CAST(sum(CAST(floor(least(2.0::DOUBLE, coalesce(rate, 0) * w)) AS BIGINT) * words) AS BIGINT) AS rest FROM r GROUP BY 1),
e AS (SELECT w.doc_id, w.source, size, u, source_size, target, rest, least(2.0::DOUBLE, rate * w) AS e FROM w JOIN k ON w.source IS NOT DISTINCT FROM k.source),
o AS (SELECT *, CAST(floor(e) AS BIGINT) AS whole, CASE WHEN size > 0 AND e - floor(e) > 0 THEN (u / (1 - u)) / ((e - floor(e)) / (1 - (e - floor(e)))) END AS odds FROM e),
p AS (SELECT *, CASE WHEN odds IS NOT NULL THEN size ELSE 0 END AS chosen FROM o)
SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(chosen, rest - coalesce(sum(chosen) OVER (PARTITION BY source ORDER BY odds NULLS LAST, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS taken, odds AS order_odds,
CAST(CASE WHEN size = 0 THEN 0 ELSE whole + CASE WHEN 2 * greatest(0, least(chosen, rest - coalesce(sum(chosen) OVER (PARTITION BY source ORDER BY odds NULLS LAST, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) >= size THEN 1 ELSE 0 END END AS BIGINT) AS copies FROM p"""
