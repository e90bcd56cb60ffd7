"""Projections for pages and search: indexes, facets, listings, freshness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biblio.functions.text import age_days, collapse, filled, fold, fold_value, slug


def compact_index(df: DataFrame) -> DataFrame:
    """Short rows of theses (id, title, author, year, course, advisors[], advisor_ids[], keywords[])."""
    return df.select("id", F.substring("title", 1, 200).alias("t"), F.col("author").alias("a"), F.col("year").alias("y"), F.when(F.col("course").contains("Mestrado"), "M").otherwise("D").alias("c"), F.slice("advisors", 1, 3).alias("ad"), F.slice(F.filter("advisor_ids", lambda x: x.isNotNull()), 1, 3).alias("ap"), F.slice("keywords", 1, 5).alias("k"))


def thesis_record(df: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Full records: missing texts take defaults, the pdf address falls back to the full-text address."""
    out = df.withColumns({c: F.coalesce(filled(F.col(c)), F.lit(d)) for c, d in defaults.items() if c in df.columns})
    return out.withColumn("pdf_url", F.coalesce(filled(F.col("pdf_url")), filled(F.col("fulltext_url")), F.lit(""))).drop("fulltext_url")


def graduation_record(df: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """The same for graduation works, whose course has two names."""
    return thesis_record(df.withColumn("course", F.coalesce(filled(F.col("course")), filled(F.col("curso")), F.lit(""))).drop("curso"), defaults)


def normalize_entry(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Raw search entries (eid, title, cover_date, doi, publication_name, subtype, citedby, url) as works, and the bad ones."""
    ok = F.coalesce(F.col("eid").rlike(r"^2-s2\.0-\d+$"), F.lit(False))
    works = df.filter(ok).select(
        F.col("eid").alias("publication_id"),
        F.regexp_extract("eid", r"(\d+)$", 1).alias("number"),
        "doi",
        F.coalesce(filled(F.col("title")), F.lit("Untitled")).alias("title"),
        F.substring("cover_date", 1, 4).alias("year"),
        F.col("cover_date").alias("date"),
        "subtype",
        F.struct(F.col("publication_name").alias("name")).alias("journal"),
        F.struct(F.coalesce(F.col("citedby").try_cast("int"), F.lit(0)).alias("citations"), F.col("url").alias("link")).alias("metrics"),
    )
    return works, df.filter(~ok).select(F.lit("eid").alias("rule"), F.col("eid").alias("key"), F.lit("no valid work id").alias("message"))


def master_record(df: DataFrame) -> DataFrame:
    """Flat source rows as nested records; authors come from parallel lists separated by ``;``."""
    names, ids = F.split("author_names", ";"), F.split("author_ids", ";")
    authors = F.transform(F.arrays_zip(names.alias("name"), ids.alias("source_id")), lambda x: F.struct(F.trim(x["name"]).alias("name"), F.trim(x["source_id"]).alias("source_id")))
    return df.select("eid", "title", "year", classify_type(F.col("kind")).alias("type"), F.when(F.coalesce(F.col("author_names"), F.lit("")) != "", authors).otherwise(F.array().cast("array<struct<name:string,source_id:string>>")).alias("authors"), F.struct(F.col("journal").alias("name"), "issn").alias("journal"))


def classify_type(kind: Column) -> Column:
    """Kind of a work by words in its description, the first that fits."""
    k = F.lower(F.coalesce(kind, F.lit("")))
    return F.when(k.contains("conference") | k.contains("proceeding"), "conference").when(k.contains("review"), "review").when(k.contains("book") | k.contains("chapter"), "book").otherwise("article")


def published_pages(df: DataFrame) -> DataFrame:
    return df.filter(F.col("published") & (F.col("kind") == "page"))


def faceted_search(df: DataFrame, q: str, text: list[str], facets: dict[str, str] | None = None, contains: dict[str, str] | None = None) -> DataFrame:
    """Rows whose text holds the query whatever its accents, and whose facets are equal; empty ones do not filter."""
    conditions = [fold(F.concat_ws(" ", *text), "combining").contains(fold_value(q))] if q else []
    conditions += [F.col(c) == v for c, v in (facets or {}).items() if v]
    conditions += [F.array_contains(c, v) for c, v in (contains or {}).items() if v]
    return df.filter(reduce(lambda a, b: a & b, conditions)) if conditions else df


def facet_values(df: DataFrame, col: str) -> DataFrame:
    return df.filter(F.coalesce(F.col(col).cast("string"), F.lit("")) != "").select(col).distinct().orderBy(F.desc(col))


def allow(df: DataFrame, col: str, values: list) -> DataFrame:
    return df.filter(F.col(col).isin(list(values)))


def works_in_period(df: DataFrame, year_filter: str, now: int, year: str = "year") -> DataFrame:
    """``all``, a year, or ``last5``: the five years that end now."""
    if year_filter == "all":
        return df
    y = F.col(year).try_cast("int")
    return df.filter(y.between(now - 4, now)) if year_filter == "last5" else df.filter(y == int(year_filter))


def select_entities(df: DataFrame, requested: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Active people with an external id; and requested ids that are none of these."""
    able = df.filter(F.col("active") & (F.size("external_ids") > 0))
    if requested is None:
        return able, None
    return able.join(requested.select("id"), "id", "left_semi"), requested.select("id").join(able.select("id"), "id", "left_anti")


def search_index(pages: DataFrame) -> DataFrame:
    """(title, url, language, section) of pages."""
    title = collapse(F.regexp_replace(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))
    path = F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), r"^[a-z]+://[^/]*/?", "")
    return pages.select(title.alias("title"), "url", F.regexp_extract("html", r'(?i)<html[^>]*\blang="([^"]*)"', 1).alias("language"), F.element_at(F.split(path, "/"), 1).alias("section"))


def freshness(df: DataFrame, group: str, updated: str, days: int, now: str) -> DataFrame:
    """(source, age_days, state): ok up to the threshold, warn up to twice that, else old."""
    age = age_days(F.max(updated), F.lit(now))
    return df.groupBy(group).agg(age.alias("age_days")).withColumn("state", F.when(F.col("age_days") <= days, "ok").when(F.col("age_days") <= 2 * days, "warn").otherwise("old"))


def fellowship(df: DataFrame, col: str) -> DataFrame:
    """Flag and level of ``Sim - <level>``."""
    yes = F.coalesce(F.col(col).startswith("Sim"), F.lit(False))
    return df.withColumn("fellow", yes).withColumn("level", F.when(yes, F.trim(F.regexp_replace(col, r"^Sim\s*-?\s*", ""))))


def classify_dimensions(df: DataFrame, width: str = "width", height: str = "height", least: int = 300, most_ratio: float = 2.0) -> DataFrame:
    """Orientation of images by aspect ratio, and warnings."""
    ratio = F.col(width) / F.col(height)
    small = F.least(width, height) < least
    return df.withColumn("orientation", F.when(ratio > 1.1, "landscape").when(ratio < 0.9, "portrait").otherwise("square")).withColumn("warnings", F.array_compact(F.array(F.when(small, "small"), F.when(F.greatest(ratio, 1 / ratio) > most_ratio, "extreme ratio"))))


def category_documents(df: DataFrame, documents: str = "documents") -> DataFrame:
    """One row a document, in order; categories without any keep one row."""
    return df.select(*(c for c in df.columns if c != documents), F.posexplode_outer(documents).alias("pos", "document"))


def normalize_batch(df: DataFrame, paths: list[str]) -> DataFrame:
    return df.withColumns({c: F.regexp_replace(c, "^/+", "") for c in paths})


def migrate_person(df: DataFrame) -> DataFrame:
    """Old area records (name, link, area) as people with a slug, the id in their link and no metrics yet."""
    zero = F.struct(*(F.lit(0).alias(c) for c in ("h_index", "citations", "documents")))
    return df.select(slug(F.col("name"), "delete").alias("id"), "name", "area", filled(F.regexp_extract("link", r"authorId=(\d+)", 1)).alias("source_id"), zero.alias("metrics"))


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    return df.filter(F.col(key) == F.lit(value))


def apply_view(df: DataFrame, filters: dict[str, str] | None = None, flags: dict[str, bool] | None = None, groups: list[str] = (), sort: str | None = None, allowed: list[str] = ()) -> DataFrame:
    """A saved view: pattern and flag filters, rows ordered by groups then an allowed sort key."""
    if sort and sort not in allowed:
        raise ValueError(f"{sort!r} is no sort key of this view")
    out = df
    for c, p in (filters or {}).items():
        out = out.filter(F.col(c).rlike(p))
    for c, v in (flags or {}).items():
        out = out.filter(F.col(c) == v)
    keys = [*groups, *([sort] if sort else [])]
    return out.orderBy(*keys) if keys else out


def view_groups(df: DataFrame, groups: list[str]) -> DataFrame:
    return df.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"))
