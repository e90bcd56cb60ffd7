"""Reading and writing records, collections, snapshots, text trees and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from biblio.operators.snapshot import GateError


def _with_corrupt(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])


def read_records(spark: SparkSession, path: str, schema: T.StructType, legacy: str | None = None) -> DataFrame:
    """One JSON document a file, with its file name; an old aggregate file takes its place where there are none."""
    rows = spark.read.schema(_with_corrupt(schema)).option("multiLine", True).option("mode", "PERMISSIVE").json(path).select("*", F.col("_metadata.file_name").alias("file_name"))
    if legacy is not None and rows.isEmpty():
        rows = spark.read.schema(_with_corrupt(schema)).option("multiLine", True).json(legacy).select("*", F.col("_metadata.file_name").alias("file_name"))
    return rows.orderBy("file_name")


def read_collection(spark: SparkSession, path: str, key: str, schema: T.StructType) -> DataFrame:
    """Records of a bare list or of ``{key: [...]}``; anything else is refused."""
    text = spark.read.text(path, wholetext=True)
    listed = T.ArrayType(schema)
    bare, wrapped = F.from_json("value", listed), F.from_json("value", T.StructType([T.StructField(key, listed)]))[key]
    rows = F.when(F.ltrim("value").startswith("["), bare).otherwise(wrapped)
    parsed = text.select(rows.alias("_r"))
    if not parsed.filter("_r is null").isEmpty():
        raise GateError(f"{path} holds neither a list nor {key!r}")
    return parsed.select(F.inline("_r"))


def explode_keyed_map(df: DataFrame, col: str, key: str = "id") -> DataFrame:
    """Rows of an id-keyed map, each with its id."""
    value = df.schema[col].dataType.valueType
    rows = df.select(F.explode(col).alias(key, "_v"))
    return rows.select(key, *(F.col(f"_v.{f}") for f in value.names if f != key)) if isinstance(value, T.StructType) else rows.withColumnRenamed("_v", "value")


def read_snapshot(spark: SparkSession, root: str, version: str) -> DataFrame:
    """Rows of one version, as it was committed last; other versions' files are not read."""
    from .versions import read_version

    return read_version(spark, root, version)


def write_snapshot(df: DataFrame, root: str, version: str, key: str | None = None) -> None:
    """Commit a version: its files are new, and readers see it from the moment that its pointer is in place."""
    from .versions import commit

    commit(df, root, version, key)


def to_source_shape(df: DataFrame, people: list[str], id_col: str = "id") -> DataFrame:
    """Published rows as the source has them: people as names, ids as text."""
    return df.withColumns({**{c: F.transform(c, lambda a: F.coalesce(a["name"], F.lit(""))) for c in people}, id_col: F.col(id_col).cast("string")})


def read_text_tree(spark: SparkSession, root: str, suffixes: list[str], skip: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(path, text) of files with these endings below a root, and problems for those that are not UTF-8."""
    either = ",".join("*" + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in x) for x in suffixes)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"{{{either}}}").load(root).select("path", "content")  # others are not even opened
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    ends = F.greatest(*(name.endswith(s) for s in suffixes)) if len(suffixes) > 1 else name.endswith(suffixes[0])
    kept = files.filter(ends)
    if skip:
        kept = kept.filter(~F.arrays_overlap(F.split("path", "/"), F.array(*(F.lit(s) for s in skip))))
    good = F.is_valid_utf8(F.col("content"))
    return kept.filter(good).select("path", F.col("content").cast("string").alias("text")), kept.filter(~good).select(F.lit("encoding").alias("rule"), F.col("path").alias("key"), F.lit("not UTF-8").alias("message"))


def write_records(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """One row a record; files hold many."""
    df.write.mode("overwrite").format(kind).save(path)


def write_compact(df: DataFrame, path: str, names: dict[str, str]) -> None:
    """JSON lines with short keys."""
    df.select(F.to_json(F.struct(*(F.col(c).alias(s) for c, s in names.items()))).alias("value")).write.mode("overwrite").text(path)


def append_run_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def preview(previous: DataFrame, candidate: DataFrame, key: str) -> DataFrame:
    """What a write would do, without doing it: (action, key)."""
    from biblio.operators.snapshot import diff

    action = F.when(F.col("status") == "added", "create").when(F.col("status") == "changed", "update").when(F.col("status") == "removed", "delete")
    return diff(previous, candidate, key).select(action.alias("action"), key).filter("action is not null")


def promote(candidate: DataFrame, staging: str, published: str, version: str, problems: DataFrame | None = None, gates: list = (), key: str | None = None) -> DataFrame:
    """Stage a candidate, let every gate pass on what was staged, then publish it as a new version.

    Staging below the published path is refused; a failed gate leaves the published versions alone.
    """
    a, b = staging.rstrip("/") + "/", published.rstrip("/") + "/"
    if a.startswith(b) or b.startswith(a):
        raise GateError("staging and published paths overlap")
    if problems is not None:
        from biblio.operators.quality import require

        require(problems)
    spark = candidate.sparkSession
    candidate.write.mode("overwrite").parquet(staging)
    staged = spark.read.parquet(staging)
    for gate in gates:
        gate(staged)
    write_snapshot(staged, published, version, key)
    return read_snapshot(spark, published, version)


def work_schema() -> T.StructType:
    """A bibliographic work."""
    return T.StructType.fromDDL(
        "publication_id string, eid string, doi string, pii string, pubmed_id string, title string, year string, date string, type string, subtype string,"
        " journal struct<name:string,issn:string,eissn:string,volume:string,issue:string,pages:string,article_number:string>,"
        " authors array<struct<name:string,scopus_id:string,affiliation:string,is_member:boolean,member_id:string>>,"
        " member_coauthors array<string>, scopus struct<citations:int,references_count:int,scopus_link:string>,"
        " metadata struct<source:string,last_updated:string,data_quality_score:int>"
    )


def person_schema() -> T.StructType:
    return T.StructType.fromDDL("id string, nome string, ativo boolean, departamento string, categoria string, cargos array<string>, links map<string,string>, scopus_author_ids array<string>, resumo struct<pt:string,en:string>, fonte string, verificado_em string")


def thesis_schema() -> T.StructType:
    return T.StructType.fromDDL("num_tese string, type string, title string, author string, year string, course string, area string, program string, advisors array<struct<name:string,professor_slug:string>>, co_advisors array<struct<name:string,professor_slug:string>>, abstract string, subjects array<string>, defense_date string, detail_url string, pdf_url string")


def columns_struct(df: DataFrame) -> Column:
    return F.struct(*(F.col(f"`{c}`") for c in df.columns))
