"""Counting works, citations, people and supervision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def yearly_stats(works: DataFrame, year: str = "year", citations: str = "citations") -> DataFrame:
    """(year, works, citations) of rows whose year is a number."""
    y = F.col(year).try_cast("int")
    return works.filter(y.isNotNull()).groupBy(y.alias("year")).agg(F.count(F.lit(1)).alias("works"), F.sum(F.coalesce(F.col(citations).try_cast("bigint"), F.lit(0))).alias("citations"))


def type_counts(works: DataFrame, kind: str = "type", default: str = "article") -> DataFrame:
    return works.groupBy(F.coalesce(F.nullif(F.col(kind), F.lit("")), F.lit(default)).alias("type")).agg(F.count(F.lit(1)).alias("works"))


def marginals(df: DataFrame, dims: dict[str, str]) -> DataFrame:
    """(dimension, key, n) for each dimension on its own and in total, in one pass; ``dims`` maps names to defaults."""
    filled = df.select(*(F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(d)).alias(c) for c, d in dims.items()))
    grouped = filled.groupingSets([[F.col(c)] for c in dims] + [[]], *(F.col(c) for c in dims)).agg(F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("n"))
    bit = {c: (1 << len(dims)) - 1 - (1 << (len(dims) - 1 - k)) for k, c in enumerate(dims)}
    dimension = F.coalesce(*(F.when(F.col("_g") == b, F.lit(c)) for c, b in bit.items()), F.lit("total"))
    key = F.coalesce(*(F.when(F.col("_g") == b, F.col(c)) for c, b in bit.items()), F.lit(""))
    return grouped.select(dimension.alias("dimension"), key.alias("key"), "n")


def h_index(edges: DataFrame, author: str = "author", citations: str = "citations") -> DataFrame:
    """(author, h_index): the largest i with i works of at least i citations.

    Citations are counted per (author, value) first, so that a window holds distinct values, not works.
    """
    tallies = edges.groupBy(author, citations).agg(F.count(F.lit(1)).alias("_n"))
    at_least = F.sum("_n").over(Window.partitionBy(author).orderBy(F.desc(citations)).rowsBetween(Window.unboundedPreceding, 0))
    return tallies.withColumn("_w", at_least).groupBy(author).agg(F.coalesce(F.max(F.least(F.col("_w"), F.floor(F.col(citations)))), F.lit(0)).cast("long").alias("h_index"))


def author_scorecard(edges: DataFrame, author: str = "author", work: str = "work", citations: str = "citations") -> DataFrame:
    """(author, works, citations, h_index) of one row per author and work."""
    tallies = edges.groupBy(author, citations).agg(F.count(F.lit(1)).alias("_n"))
    at_least = F.sum("_n").over(Window.partitionBy(author).orderBy(F.desc(citations)).rowsBetween(Window.unboundedPreceding, 0))
    return tallies.withColumn("_w", at_least).groupBy(author).agg(F.sum("_n").alias("works"), F.sum(F.col("_n") * F.col(citations)).alias("citations"), F.max(F.least(F.col("_w"), F.col(citations))).cast("long").alias("h_index"))


def advisor_load(df: DataFrame, lists: list[str], k: int | None = None) -> DataFrame:
    """(name, n): mentions over all the given arrays; the k highest if asked."""
    counted = df.select(F.explode(F.concat(*(F.coalesce(F.col(c), F.array().cast("array<string>")) for c in lists))).alias("name")).filter("name <> ''").groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return counted if k is None else counted.orderBy(F.desc("n"), "name").limit(k)


def advisor_roles(df: DataFrame, people: str = "advisors") -> DataFrame:
    """(name, main, co, total): the first of a list is the main advisor, the others help."""
    return df.select(F.posexplode(people).alias("pos", "name")).groupBy("name").agg(F.count_if(F.col("pos") == 0).alias("main"), F.count_if(F.col("pos") > 0).alias("co"), F.count(F.lit(1)).alias("total"))


def supervision_lists(df: DataFrame, person: str, work: str, role: str, degree: str) -> DataFrame:
    """Per person the sorted works as advisor and co-advisor, and degree counts, which grow by advisors only."""

    def listed(kind: str) -> Column:
        return F.sort_array(F.collect_set(F.when(F.col(role) == kind, F.col(work))))

    def counted(value: str) -> Column:
        return F.count_if((F.col(role) == "advisor") & (F.col(degree) == value))

    return df.groupBy(person).agg(listed("advisor").alias("as_advisor"), listed("coadvisor").alias("as_coadvisor"), counted("M").alias("master_count"), counted("D").alias("doctor_count"))


def fellowship_counts(df: DataFrame, level: str = "level") -> DataFrame:
    """(level, n) and the total under level null."""
    return df.filter(F.col(level).isNotNull()).rollup(level).agg(F.count(F.lit(1)).alias("n"))


def top_values(df: DataFrame, values: str, k: int, info: str | None = None, order: str | None = None) -> DataFrame:
    """The k values of an array column in most rows, with the first-seen description of each."""
    rows = df.select(F.explode(F.array_distinct(values)).alias("value"), *( [F.col(info).alias("_info"), F.col(order).alias("_order")] if info else []))
    aggs = [F.count(F.lit(1)).alias("n")] + ([F.min_by("_info", "_order").alias("info")] if info else [])
    return rows.groupBy("value").agg(*aggs).orderBy(F.desc("n"), "value").limit(k)


def combine_author_metrics(df: DataFrame, person: str = "person") -> DataFrame:
    """Several ids of one person: the largest h-index and coauthor count, the sum of the rest, 0 where none is known."""
    zero = {c: F.coalesce(F.col(c).try_cast("bigint"), F.lit(0)) for c in ("h_index", "citations", "cited_by", "documents", "coauthors")}
    return df.groupBy(person).agg(*((F.max if c in ("h_index", "coauthors") else F.sum)(v).alias(c) for c, v in zero.items()))


def best_metric(df: DataFrame, cols: list[str], out: str = "best") -> DataFrame:
    """The largest of several sources, where any is above zero."""
    best = F.greatest(*(F.coalesce(F.col(c), F.lit(0)) for c in cols)) if len(cols) > 1 else F.col(cols[0])
    return df.withColumn(out, F.when(best > 0, best))


def aggregate_projects(records: DataFrame) -> DataFrame:
    """One row a project from (pos, project, line, area, people[], production): first filled texts, lists in order."""

    def first(c: str) -> Column:
        return F.min_by(F.col(c), F.when(F.col(c) != "", F.col("pos")))

    def in_order(lists: Column) -> Column:
        return F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", lists.alias("v")))), lambda x: x["v"])))

    return records.groupBy("project").agg(first("line").alias("line"), first("area").alias("area"), in_order(F.col("people")).alias("people"), F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "production"))), lambda x: x["production"])).alias("productions"))


def count_per_member(df: DataFrame, members: str) -> DataFrame:
    return df.select(F.explode(F.array_distinct(members)).alias("member")).groupBy("member").agg(F.count(F.lit(1)).alias("n"))


def topic_index(classified: DataFrame, topic: str = "topic", person: str = "person") -> DataFrame:
    """(topic, works, people): how many works, and who, sorted."""
    return classified.groupBy(topic).agg(F.count_distinct("work").alias("works"), F.sort_array(F.collect_set(person)).alias("people"))


def invert_references(df: DataFrame, person: str, refs: str) -> DataFrame:
    """(work, people): who refers to each work."""
    return df.select(person, F.explode(refs).alias("work")).groupBy("work").agg(F.sort_array(F.collect_set(person)).alias("people"))


def match_stats(entities: DataFrame, matches: DataFrame, key: str) -> DataFrame:
    """(total, matched, coverage percent)."""
    marked = entities.select(key).distinct().join(matches.select(key).distinct().withColumn("_m", F.lit(1)), key, "left")
    n, m = F.count(F.lit(1)), F.count("_m")
    return marked.agg(n.alias("total"), m.alias("matched"), F.when(n > 0, F.round(100 * m / n, 1)).otherwise(F.lit(0.0)).alias("coverage"))


def dedup_stats(df: DataFrame, key: str, owner: str, doi: str) -> DataFrame:
    """(raw, without_id, without_doi, unique_works, duplicates, shared) of rows of one owner and work each."""
    per = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.count_distinct(owner).alias("_o"))
    u = per.agg(F.count(F.lit(1)).alias("unique_works"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"), F.count_if(F.col("_o") > 1).alias("shared"))
    return df.agg(F.count(F.lit(1)).alias("raw"), F.count_if(F.col(key).isNull()).alias("without_id"), F.count_if(F.coalesce(F.col(doi), F.lit("")) == "").alias("without_doi")).crossJoin(F.broadcast(u))  # one row each


def total_references(df: DataFrame, refs: str) -> DataFrame:
    return df.agg(F.coalesce(F.sum(F.size(refs)), F.lit(0)).alias("total"))


def update_statistics(previous: DataFrame, additions: DataFrame) -> DataFrame:
    """Long statistics (dimension, key, n) plus those of added rows."""
    return previous.unionByName(additions).groupBy("dimension", "key").agg(F.sum("n").alias("n"))


def omitted(df: DataFrame, category: str, cap: int = 100) -> DataFrame:
    """How many items a report leaves out that shows ``cap`` of each category."""
    return df.groupBy(category).agg(F.count(F.lit(1)).alias("_n")).agg(F.coalesce(F.sum(F.greatest(F.lit(0), F.col("_n") - cap)), F.lit(0)).alias("omitted"))


def latest(df: DataFrame, col: str) -> DataFrame:
    return df.agg(F.max(col).alias("latest"))


def entity_view(entities: DataFrame, matches: DataFrame, key: str) -> DataFrame:
    """Per entity total, main and co mentions and the matched names; entities without any stay, with zeros."""
    counted = matches.groupBy(key).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("role") == "main").alias("main"), F.count_if(F.col("role") == "co").alias("co"), F.sort_array(F.collect_set("name")).alias("names"))
    return entities.join(counted, key, "left").withColumns({**{c: F.coalesce(c, F.lit(0)) for c in ("total", "main", "co")}, "names": F.coalesce("names", F.array().cast("array<string>"))})


def summary_index(works: DataFrame) -> DataFrame:
    return works.select("id", F.struct("title", "year", "type", "people", "citations").alias("summary"))


def child_counts(nodes: DataFrame, visible: Column | None = None) -> DataFrame:
    """(id, children) of every node; only visible children count if a condition is given."""
    kids = nodes if visible is None else nodes.filter(visible)
    return nodes.select("id").join(kids.filter("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("children")), "id", "left").select("id", F.coalesce("children", F.lit(0)).alias("children"))


def recent_cumulative(yearly: DataFrame, now: int, years: int = 10) -> DataFrame:
    """Running citations over the years now - years .. now, from zero; one row a year."""
    inside = yearly.filter(F.col("year").between(now - years, now))
    return inside.withColumn("cumulative", F.sum("citations").over(Window.orderBy("year").rowsBetween(Window.unboundedPreceding, 0)))


def top_cited(works: DataFrame, periods: dict[str, int | None], k: int, now: int) -> DataFrame:
    """(period, rank, ...) of the k most cited works since ``now - years``; a period of None has no bound.

    Only works with citations above 0 count, and those without a year only where there is no bound.
    """
    since = F.array(*(F.struct(F.lit(p).alias("period"), F.lit(None if y is None else now - y).cast("int").alias("since")) for p, y in periods.items()))
    rows = works.filter(F.col("citations") > 0).withColumn("_p", F.explode(since)).filter(F.col("_p.since").isNull() | (F.col("year") >= F.col("_p.since")))
    rank = F.row_number().over(Window.partitionBy("period").orderBy(F.desc("citations"), "id"))
    return rows.withColumn("period", F.col("_p.period")).drop("_p").withColumn("rank", rank).filter(F.col("rank") <= k)


def recent_degrees(df: DataFrame, now: int, years: int = 10, course: str = "course") -> DataFrame:
    """(year, masters, doctors) of the last years, by the words of the course."""
    y = F.col("year").try_cast("int")
    return df.filter(y.between(now - years, now)).groupBy(y.alias("year")).agg(F.count_if(F.col(course).contains("Mestrado")).alias("masters"), F.count_if(F.col(course).contains("Doutorado")).alias("doctors"))


def quality_score(df: DataFrame, weights: dict[str, int], out: str = "quality") -> DataFrame:
    """Sum of the weights of the fields that are filled: not null, not empty, not zero."""
    types = dict(df.dtypes)

    def present(c: str) -> Column:
        if types[c].startswith(("array", "map")):
            return F.size(c) > 0
        return (F.col(c) != "") if types[c] == "string" else (F.col(c) != 0 if types[c] not in ("boolean",) and not types[c].startswith("struct") and not types[c].startswith("timestamp") and types[c] != "date" else F.col(c).isNotNull())

    parts = [F.when(present(c), w).otherwise(0) for c, w in weights.items()]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return df.withColumn(out, total)


#: Points of a complete work record (fixed values).
WORK_WEIGHTS = {"doi": 20, "abstract": 20, "keywords": 10, "journal": 15, "authors": 15, "subject_areas": 10, "citations": 10}
