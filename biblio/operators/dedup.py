"""Duplicate keys, canonical records, survivorship and remapped references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biblio.functions.text import fold, normalize_doi


def duplicate_key(works: DataFrame, out: str = "key") -> DataFrame:
    """A work's identity: its DOI; else title, year and journal if all are there; else its own id."""
    doi = normalize_doi(F.col("doi"))
    title, journal = (fold(F.coalesce(F.col(c), F.lit("")), "work_text") for c in ("title", "journal"))
    year = F.coalesce(F.col("year").cast("string"), F.lit(""))
    full = (title != "") & (year != "") & (journal != "")
    return works.withColumn(out, F.when(doi != "", F.struct(F.lit("doi").alias("kind"), doi.alias("a"), F.lit("").alias("b"), F.lit("").alias("c"))).when(full, F.struct(F.lit("title-year-journal").alias("kind"), title.alias("a"), year.alias("b"), journal.alias("c"))).otherwise(F.struct(F.lit("eid").alias("kind"), F.coalesce(F.col("eid"), F.lit("")).alias("a"), F.lit("").alias("b"), F.lit("").alias("c"))))


def deduplicate(works: DataFrame, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """(canonical works, (id, canonical)); canonical is the smallest id of a key, compared as text."""
    keyed = duplicate_key(works)
    first = keyed.groupBy("key").agg(F.min(F.col(id_col).cast("string")).alias("canonical"))
    aliases = keyed.select(F.col(id_col).cast("string").alias("id"), "key").join(first, "key").select("id", "canonical")
    return works.join(first.select(F.col("canonical").alias(id_col)), id_col, "left_semi"), aliases


def survivor(col: str, order: str, empty_too: bool = False) -> Column:
    """The first filled value in the given order."""
    filled = F.col(col).isNotNull() if empty_too else (F.col(col).isNotNull() & (F.col(col).cast("string") != ""))
    return F.min_by(col, F.when(filled, F.col(order))).alias(col)


def merge_duplicates(works: DataFrame, aliases: DataFrame, scalars: list[str], primary_only: list[str] = (), maxima: list[str] = (), last: list[str] = ()) -> DataFrame:
    """One record a canonical id.

    ``scalars``: first filled value by id; ``primary_only``: the canonical record's own; ``maxima``: largest; ``last``: last
    one that is not null.
    """
    rows = works.withColumn("id", F.col("id").cast("string")).join(aliases, "id")
    own = [F.max(F.when(F.col("id") == F.col("canonical"), F.col(c))).alias(c) for c in primary_only]
    late = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("id"))).alias(c) for c in last]
    return rows.groupBy("canonical").agg(*(survivor(c, "id") for c in scalars), *own, *(F.max(c).alias(c) for c in maxima), *late, F.count(F.lit(1)).alias("members")).withColumnRenamed("canonical", "id")


def merge_same_id(existing: DataFrame, candidate: DataFrame, key: str, core: list[str], keep_filled: list[str], keep_known: list[str] = ()) -> DataFrame:
    """Newer records over older ones of the same id.

    ``core`` fields are overwritten even by null; ``keep_filled`` only by filled values; ``keep_known`` by any that
    is not null.  Records on one side only stay as they are.
    """
    old = existing.select(key, F.struct(*core, *keep_filled, *keep_known).alias("_o"))
    new = candidate.select(key, F.struct(*core, *keep_filled, *keep_known).alias("_n"))
    both = old.join(new, key, "full_outer")
    is_new = F.col("_n").isNotNull()
    fields = [F.when(is_new, F.col(f"_n.{c}")).otherwise(F.col(f"_o.{c}")).alias(c) for c in core]
    fields += [F.when(is_new & F.col(f"_n.{c}").isNotNull() & (F.col(f"_n.{c}").cast("string") != ""), F.col(f"_n.{c}")).otherwise(F.col(f"_o.{c}")).alias(c) for c in keep_filled]
    return both.select(key, *fields, *(F.coalesce(f"_n.{c}", f"_o.{c}").alias(c) for c in keep_known))


def merge_authors(rows: DataFrame, work: str = "work") -> DataFrame:
    """One author list a work from (work, seq, source_id, name, person): union by id and name in order of first mention.

    A person once known for an author stays; ``people`` lists them, sorted.
    """
    each = rows.groupBy(work, "source_id", "name").agg(F.min("seq").alias("seq"), F.max_by("person", F.when(F.coalesce("person", F.lit("")) != "", F.struct("seq", "person"))).alias("person"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("seq", "source_id", "name", "person"))), lambda x: F.struct(x["source_id"].alias("source_id"), x["name"].alias("name"), x["person"].alias("person")))
    return each.groupBy(work).agg(listed.alias("authors"), F.sort_array(F.collect_set(F.when(F.col("person") != "", F.col("person")))).alias("people"))


def remap_references(edges: DataFrame, works: DataFrame, aliases: DataFrame) -> DataFrame:
    """(author, work, position, corresponding) after merging works.

    References follow aliases; those to no work vanish; collisions keep the smallest position (1 if unknown) and are
    corresponding if any was.
    """
    moved = edges.join(aliases.select(F.col("id").alias("work"), "canonical"), "work", "left").withColumn("work", F.coalesce("canonical", "work"))
    live = moved.join(works.select(F.col("id").alias("work")), "work", "left_semi")
    many = F.count(F.lit(1)) > 1
    return live.groupBy("author", "work").agg(F.when(many, F.min(F.coalesce(F.nullif("position", F.lit(0)), F.lit(1)))).otherwise(F.first("position")).alias("position"), F.bool_or(F.coalesce("corresponding", F.lit(False))).alias("corresponding"))


def dedup_first(df: DataFrame, key: str, order: str, person: str) -> DataFrame:
    """The first record of each id; later ones only add their person."""
    cols = [c for c in df.columns if c not in (key, person)]
    first = df.groupBy(key).agg(F.min_by(F.struct(*cols), order).alias("_r"), F.sort_array(F.collect_set(person)).alias("people"))
    return first.select(key, "_r.*", "people")
