"""Queries of sources and sinks, listings, gates, name ladders and incremental ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from biblio.functions import names, text
from biblio.operators import arrange, pages, quality, resolve, snapshot
from biblio.sources import records as sources
from biblio.sources import versions
from biblio.streaming import ingest

from .base import CURRENT, NODES, PREVIOUS, WORKS, in_place, nodes, query, scratch, snapshots, table, works

# Sources and sinks: the tables are written to a shared folder and read back.


def _record_files(spark, d) -> str:
    """A folder with a JSON document of every nation; one in five is cut short."""
    each = F.to_json(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")))
    folder = scratch(spark)
    broken = F.col("n_nationkey") % 5 == 0
    table(spark, d, "nation").select(F.when(broken, F.concat(F.lit("{ "), "n_name")).otherwise(each).alias("value"), F.col("n_nationkey").alias("k")).write.partitionBy("k").text(folder)
    return f"{folder}/*"


@query("SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_nationkey % 5 > 0")
def s1_read_records(spark, d):
    rows = sources.read_records(spark, _record_files(spark, d), spark.createDataFrame([], "id int, name string").schema)
    return rows.filter("id is not null").select("id", "name")


@query("SELECT 'parse' AS rule, '{ ' || n_name AS message FROM nation WHERE n_nationkey % 5 = 0")
def q10_unparseable(spark, d):
    rows = sources.read_records(spark, _record_files(spark, d), spark.createDataFrame([], "id int, name string").schema)
    return quality.unparseable(rows, "file_name").select("rule", F.regexp_replace("message", r"\s+$", "").alias("message"))


@query("SELECT n_nationkey AS id, n_name AS name, n_regionkey AS region FROM nation")
def s2_read_collection(spark, d):
    one = F.to_json(F.struct(F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")))).alias("nations")))
    folder = scratch(spark)
    table(spark, d, "nation").agg(one.alias("value")).write.text(folder)  # a collection is one document
    return sources.read_collection(spark, folder, "nations", spark.createDataFrame([], "id int, name string, region int").schema)


@query(f"SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS o_totalprice FROM {PREVIOUS}")
def s4_read_snapshot(spark, d):
    folder = scratch(spark)
    for version, rows in zip(("v1", "v2"), snapshots(spark, d), strict=True):
        sources.write_snapshot(rows, folder, version)
    return sources.read_snapshot(spark, folder, "v1").select("o_orderkey", F.col("o_totalprice").cast("double").alias("o_totalprice"))


@query("SELECT md5(text) AS digest FROM documents WHERE doc_id % 3 > 0")
def s7_read_text_tree(spark, d):
    folder = scratch(spark)
    coded = F.concat(F.lit("t"), F.regexp_replace(F.base64(F.encode("text", "UTF-8")), r"\s", ""))  # a null text's line is n, an empty one's t
    docs = table(spark, d, "documents").select(F.coalesce(coded, F.lit("n")).alias("value"), F.when(F.col("doc_id") % 3 > 0, "kept").otherwise("node_modules").alias("k"))
    for k in ("kept", "node_modules"):
        docs.filter(F.col("k") == k).select("value").write.option("maxRecordsPerFile", 1000).text(f"{folder}/{k}")  # a file is read as one row
    docs.select(F.md5("value").alias("value")).write.csv(f"{folder}/other")
    good, _ = sources.read_text_tree(spark, folder, [".txt"], ["node_modules"])
    lines = good.select(F.explode(F.split("text", "\n")).alias("line")).filter("line <> ''")
    return lines.select(F.when(F.col("line") != "n", F.md5(F.unbase64(F.substring("line", 2, 1 << 30)))).alias("digest"))


@query("WITH f AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'jpg' WHEN 2 THEN 'exe' ELSE 'PDF' END AS ext, page_id % 3 = 0 AS marked, page_id % 5 = 0 AS odd FROM pages), p AS (SELECT 'img/' || CASE WHEN odd THEN 'Page ' ELSE 'page-' END || page_id || '.' || ext AS path, * FROM f) SELECT path, 'extension' AS problem FROM p WHERE ext = 'exe' UNION ALL SELECT path, 'disguised' FROM p WHERE (ext IN ('pdf', 'PDF') AND NOT marked) OR ext = 'jpg' UNION ALL SELECT path, 'name' FROM p WHERE odd OR ext = 'PDF'")
def s8_audit_binary_files(spark, d):
    k = F.col("page_id")
    ext = F.when(k % 4 == 0, "pdf").when(k % 4 == 1, "jpg").when(k % 4 == 2, "exe").otherwise("PDF")
    path = F.concat(F.lit("img/"), F.when(k % 5 == 0, "Page ").otherwise("page-"), k, F.lit("."), ext)
    content = F.concat(F.when(k % 3 == 0, "%PDF-1.7\n").otherwise(""), "html").cast("binary")
    return pages.audit_binary_files(table(spark, d, "pages").select(path.alias("path"), content.alias("content")))


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def k1_write_records(spark, d):
    folder = scratch(spark)
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    sources.write_records(rows, folder, "json")
    return spark.read.schema(rows.schema).json(folder)


@query("SELECT o_orderkey AS i, o_orderpriority AS p FROM orders")
def k2_write_compact(spark, d):
    folder = scratch(spark)
    sources.write_compact(table(spark, d, "orders"), folder, {"o_orderkey": "i", "o_orderpriority": "p"})
    return spark.read.schema("i bigint, p string").json(folder)


@query("SELECT kind, n FROM (SELECT o_orderstatus AS kind, count(*) AS n FROM orders GROUP BY 1) UNION ALL SELECT o_orderpriority, count(*) FROM orders GROUP BY 1")
def k3_append_run_log(spark, d):
    folder, orders = scratch(spark), table(spark, d, "orders")
    for c in ("o_orderstatus", "o_orderpriority"):
        sources.append_run_log(orders.groupBy(F.col(c).alias("kind")).agg(F.count(F.lit(1)).alias("n")), folder)
    return spark.read.schema("kind string, n bigint").json(folder)


@query(f"SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS o_totalprice FROM {CURRENT}")
def k4_promote(spark, d):
    staging, published = scratch(spark), scratch(spark)
    old, new = snapshots(spark, d)
    sources.write_snapshot(old, published, "v1")
    had = old.count()
    got = sources.promote(new, staging, published, "v2", gates=[lambda staged: snapshot.gate_total(had, staged.count())])
    return got.select("o_orderkey", F.col("o_totalprice").cast("double").alias("o_totalprice"))


@query("SELECT o_orderkey, o_custkey FROM orders")
def l1_incremental_ingest(spark, d):
    """Three runs over a growing folder; the second brings repeats, the third nothing."""
    source, mark, target = (scratch(spark) for _ in range(3))
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    rows.filter("o_orderkey % 3 > 0").write.parquet(source)
    ingest.incremental_ingest(spark, source, rows.schema, mark, target, "o_orderkey")
    late = rows.filter("o_orderkey % 3 < 2").withColumn("o_custkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey")).otherwise(F.lit(-1)).cast("bigint"))
    late.write.mode("append").parquet(source)
    for _ in range(2):
        ingest.incremental_ingest(spark, source, rows.schema, mark, target, "o_orderkey")
    return ingest.ingested(spark, target)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey WHEN o_orderkey % 3 = 1 AND o_orderkey % 5 = 0 THEN -1 ELSE o_custkey END AS o_custkey FROM orders")
def l1_ingest_forced(spark, d):
    """A second run whose repeats are taken again where they are asked for."""
    source, mark, target = (scratch(spark) for _ in range(3))
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    rows.filter("o_orderkey % 3 > 0").write.parquet(source)
    ingest.incremental_ingest(spark, source, rows.schema, mark, target, "o_orderkey")
    late = rows.filter("o_orderkey % 3 < 2").withColumn("o_custkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey")).otherwise(F.lit(-1)).cast("bigint"))
    late.write.mode("append").parquet(source)
    ingest.incremental_ingest(spark, source, rows.schema, mark, target, "o_orderkey", force=rows.filter("o_orderkey % 5 = 0"))
    return ingest.ingested(spark, target, "o_orderkey")


@query(f"SELECT CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed' ELSE 'changed' END AS status, coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey FROM {PREVIOUS} a FULL JOIN {CURRENT} b ON a.o_orderkey = b.o_orderkey WHERE a.o_totalprice IS DISTINCT FROM b.o_totalprice")
def j15_diff_versions(spark, d):
    """Two committed versions compared by the digests of their buckets."""
    folder = scratch(spark)
    numbers = [versions.commit(rows, folder, name, "o_orderkey") for rows, name in zip(snapshots(spark, d), ("v1", "v2"), strict=True)]
    return versions.changes(spark, folder, *numbers).select("status", "o_orderkey")


# Listings: their order, as the place of each row.


@query(f"SELECT id, row_number() OVER (ORDER BY coalesce(CAST(CASE WHEN id % 11 > 0 THEN year END AS VARCHAR), '0000') DESC, id) AS place FROM {WORKS}")
def o2_year_order(spark, d):
    rows = works(spark, d).select("id", F.when(F.col("id") % 11 > 0, F.col("year")).alias("year"))
    return in_place(arrange.by_year_desc(rows), "id")


@query("SELECT id, row_number() OVER (ORDER BY is_new DESC, CASE WHEN is_new THEN year END DESC NULLS LAST, CASE WHEN is_new THEN id END DESC NULLS LAST, pos) AS place FROM (SELECT o_orderkey AS id, CAST(year(o_orderdate) AS INTEGER) AS year, -o_orderkey AS pos, o_orderkey % 4 = 0 AS is_new FROM orders)")
def o3_new_first(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("year"), (-F.col("o_orderkey")).alias("pos"))
    return in_place(arrange.new_first(rows, F.col("id") % 4 == 0), "id")


@query("SELECT c_custkey AS id, row_number() OVER (ORDER BY CASE c_mktsegment WHEN 'MACHINERY' THEN 0 WHEN 'BUILDING' THEN 1 ELSE 2 END, c_custkey) AS place FROM customer")
def o4_by_rank(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_mktsegment")
    return in_place(arrange.by_rank(rows, {"MACHINERY": 0, "BUILDING": 1}, "c_mktsegment", "id"), "id")


@query(f"SELECT id, row_number() OVER (ORDER BY parent NULLS FIRST, position, id) AS place FROM {NODES}")
def o5_tree_order(spark, d):
    return in_place(arrange.tree_order(nodes(spark, d)), "id")


@query(f"SELECT id, row_number() OVER (ORDER BY old_pos IS NULL, old_pos, id) AS place FROM (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS id, -a.o_orderkey AS old_pos FROM {PREVIOUS} a FULL JOIN {CURRENT} b ON a.o_orderkey = b.o_orderkey)")
def o7_stable_merge_order(spark, d):
    a, b = snapshots(spark, d)
    old = a.select(F.col("o_orderkey").alias("id"), (-F.col("o_orderkey")).alias("old_pos"))
    return in_place(arrange.stable_merge_order(b.select(F.col("o_orderkey").alias("id")).join(old, "id", "full_outer")), "id")


# Sets


@query(f"SELECT * FROM (VALUES ('versions', (SELECT count(*) = 0 FROM ((SELECT o_orderkey FROM {PREVIOUS} EXCEPT SELECT o_orderkey FROM {CURRENT}) UNION ALL (SELECT o_orderkey FROM {CURRENT} EXCEPT SELECT o_orderkey FROM {PREVIOUS})))), ('itself', TRUE), ('buyers', (SELECT count(*) = 0 FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_custkey % 3 > 0)))) t(name, same)")
def u4_same_set(spark, d):
    a, b = (x.select("o_orderkey") for x in snapshots(spark, d))
    buyers = table(spark, d, "orders").select(F.col("o_custkey").alias("k")).distinct()
    some = table(spark, d, "customer").filter("c_custkey % 3 > 0").select(F.col("c_custkey").alias("k"))
    checks = [("versions", arrange.same_set(a, b)), ("itself", arrange.same_set(a, a)), ("buyers", arrange.same_set(buyers, some))]
    return spark.createDataFrame(checks, "name string, same boolean")


@query("WITH t AS (SELECT p_partkey, list_distinct(string_split(lower(p_name), ' ')) AS a, list_distinct(string_split(lower(p_name || ' ' || p_type), ' ')) || ['ring'] AS b FROM part) SELECT p_partkey, array_to_string(list_sort(list_distinct(a || b)), ' ') AS both_, array_to_string(list_sort(list_intersect(a, b)), ' ') AS shared, array_to_string(list_sort(list_filter(list_distinct(b), lambda x: NOT list_contains(a, x))), ' ') AS added FROM t")
def u5_token_sets(spark, d):
    a = text.tokens(F.lower("p_name"))
    b = F.array_append(text.tokens(F.lower(F.concat_ws(" ", "p_name", "p_type"))), "ring")
    sets = arrange.item_sets(a, b)
    return table(spark, d, "part").select("p_partkey", *(F.array_join(sets[k], " ").alias(n) for k, n in (("union", "both_"), ("common", "shared"), ("right", "added"))))


# Values


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus WHEN o_orderkey % 3 = 1 THEN o_orderpriority END AS first FROM orders")
def f19_first_of(spark, d):
    k = F.col("o_orderkey") % 3
    many = F.when(k == 0, F.array("o_orderstatus", "o_orderpriority")).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "orders").select("o_orderkey", text.first_of(many, F.when(k == 1, F.col("o_orderpriority"))).alias("first"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 4 THEN NULL ELSE p_name END AS area FROM part")
def f20_subject_area(spark, d):
    k, name = F.col("p_partkey") % 5, F.col("p_name")
    value = (
        F.when(k == 0, name)
        .when(k == 1, F.to_json(F.struct(name.alias("$"), F.lit("1").alias("@code"))))
        .when(k == 2, F.concat(F.lit('["'), name, F.lit('", "other"]')))
        .when(k == 3, F.concat(F.lit('[{"$": "'), name, F.lit('"}, {"$": "other"}]')))
        .otherwise(F.lit("[]"))
    )
    return table(spark, d, "part").select("p_partkey", text.subject_area(value).alias("area"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '1' || chr(CAST(65 + c_nationkey % 4 AS INTEGER)) WHEN 1 THEN '2' WHEN 2 THEN 'SR' END AS level FROM customer")
def f23_fellowship(spark, d):
    k = F.col("c_custkey") % 4
    level = F.concat(F.lit("1"), F.char(97 + F.col("c_nationkey") % 4))
    note = (
        F.when(k == 0, F.concat(F.lit("Docente. Bolsista de Produtividade em Pesquisa do CNPq - Nível "), level, F.lit(" - CA EN")))
        .when(k == 1, "bolsista de produtividade desta casa, NIVEL 2.")
        .when(k == 2, "Bolsista CNPq de apoio, nível sr")
        .otherwise("Bolsista de mestrado. Nível 3")
    )
    return table(spark, d, "customer").select("c_custkey", text.fellowship_from_text(note).alias("level"))


@query("SELECT p_partkey, g || ' ' || s AS given_first, s || ' ' || g AS surname_first, array_to_string(list_transform(string_split(g, ' '), lambda x: substr(x, 1, 1)), ' ') || ' ' || s AS initials_first FROM (SELECT p_partkey, p_name AS g, lower(p_type) AS s FROM part)")
def f25_author_order_variants(spark, d):
    v = names.author_order_variants(F.col("p_name"), F.lower("p_type"))
    return table(spark, d, "part").select("p_partkey", *(v[i].alias(n) for i, n in enumerate(("given_first", "surname_first", "initials_first"))))


@query("SELECT o_orderkey, greatest(0, CAST(floor((epoch(TIMESTAMP '1998-06-01 12:00:00') - epoch(o_orderdate)) / 86400) AS BIGINT)) AS days FROM orders")
def f28_age_days(spark, d):
    now = F.lit("1998-06-01 12:00:00").cast("timestamp")
    return table(spark, d, "orders").select("o_orderkey", text.age_days(F.col("o_orderdate"), now).alias("days"))


# Report texts


@query("SELECT o_orderkey AS report, CAST(1 AS BIGINT) AS block, 'status' AS field, o_orderstatus || ' and ' || o_orderpriority AS value FROM orders UNION ALL SELECT o_orderkey, 2, 'people', 'p' || o_custkey FROM orders UNION ALL SELECT o_orderkey, 2, 'status', 'late' FROM orders WHERE o_orderkey % 2 = 0")
def w9_parse_blocks(spark, d):
    """Two blocks an order: a field that goes on over a page number, a field that a stop line ends."""
    lines = F.array(
        F.lit("before any block"), F.concat(F.lit("Block "), "o_orderkey"), F.concat(F.lit("Status: "), "o_orderstatus"), F.col("o_orderkey").cast("string"), F.concat(F.lit(" and "), "o_orderpriority"),
        F.lit("Block next"), F.concat(F.lit("People: p"), "o_custkey"), F.lit("---"), F.lit("no field"), F.when(F.col("o_orderkey") % 2 == 0, "Status: late").otherwise("---"),
    )
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("report"), F.posexplode(lines).alias("pos", "line"))
    return arrange.parse_blocks(rows, "report", "pos", r"^Block ", {"status": r"^Status: ", "people": r"^People: "}, r"^-+$")


# Gates


def _passes(gate, *args) -> bool:
    try:
        gate(*args)
    except snapshot.GateError:
        return False
    return True


@query("SELECT o_orderstatus AS kind, count(*) AS had, count(*) FILTER (o_orderkey % m > 0) AS has, count(*) FILTER (o_orderkey % m > 0) > 0 AND count(*) FILTER (o_orderkey % m > 0) >= 0.95 * count(*) AS passed FROM (SELECT *, CASE o_orderstatus WHEN 'F' THEN 100 WHEN 'O' THEN 10 ELSE 1 END AS m FROM orders) GROUP BY 1")
def q1_gate_total(spark, d):
    m = F.when(F.col("o_orderstatus") == "F", 100).when(F.col("o_orderstatus") == "O", 10).otherwise(1)
    counts = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("kind")).agg(F.count(F.lit(1)).alias("had"), F.count_if(F.col("o_orderkey") % m > 0).alias("has")).collect()  # one row a status
    return spark.createDataFrame([(r["kind"], r["had"], r["has"], _passes(snapshot.gate_total, r["had"], r["has"])) for r in counts], "kind string, had bigint, has bigint, passed boolean")


@query(f"WITH n AS (SELECT count(*) AS n FROM {PREVIOUS} a FULL JOIN {CURRENT} b ON a.o_orderkey = b.o_orderkey WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_totalprice <> b.o_totalprice) SELECT l.allowed, l.approved, n.n <= l.allowed OR l.approved AS passed FROM n, (VALUES (10, FALSE), (10, TRUE), (1000000000, FALSE)) l(allowed, approved)")
def q3_gate_bulk(spark, d):
    changes = snapshot.diff(*snapshots(spark, d), "o_orderkey")
    cases = [(10, False), (10, True), (1_000_000_000, False)]
    return spark.createDataFrame([(n, ok, _passes(snapshot.gate_bulk, changes, n, ok)) for n, ok in cases], "allowed int, approved boolean, passed boolean")


@query("SELECT 'protected' AS rule, k AS key, CASE WHEN c_custkey IS NULL THEN 'missing' ELSE 'type changed' END AS message FROM (VALUES ('1', 'BUILDING'), ('2', 'MACHINERY'), ('3', 'none'), ('x', 'BUILDING')) e(k, kind) LEFT JOIN customer ON CAST(c_custkey AS VARCHAR) = k WHERE c_custkey IS NULL OR c_mktsegment <> kind")
def q7_protected(spark, d):
    return quality.protected(table(spark, d, "customer"), {"1": "BUILDING", "2": "MACHINERY", "3": "none", "x": "BUILDING"}, "c_custkey", "c_mktsegment").withColumnRenamed("c_custkey", "key")


@query("SELECT 'forbidden' AS rule, key, 'not public in ' || key AS message FROM (VALUES ('abstract'), ('who.mail'), ('list.mail')) t(key)")
def q9_forbidden_fields(spark, d):
    mail = F.struct(F.col("event_type").alias("kind"), F.col("props").alias("mail"))
    rows = table(spark, d, "events").select("event_id", F.col("props").alias("abstract"), mail.alias("who"), F.array(mail).alias("list"))
    return quality.forbidden_fields(rows, ["abstract", "mail"], "event_id").select("rule", "key", F.concat(F.lit("not public in "), "key").alias("message"))


# Name ladders. Entities have names like those of a roster: equal, contained, of the same surname, or sharing parts.

_ROSTER = "(SELECT min(p_partkey) AS author, min(p_partkey) AS pos, p_name AS name FROM part GROUP BY p_name)"
_ENTITIES = "(SELECT p_type || ' ' || (p_partkey % 40) AS entity, min(CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN lower(p_type) || ' ' || string_split(p_name, ' ')[2] WHEN 2 THEN p_name || ' ' || lower(p_type) ELSE string_split(p_name, ' ')[2] || ' ' || lower(p_type) || ' ' || substr(p_name, 1, 3) END) AS name FROM part GROUP BY 1)"


def _similarity(a: str, b: str) -> str:
    """The author ladder in SQL over folded names."""
    p, q = f"string_split({a}, ' ')", f"string_split({b}, ' ')"
    return (
        f"CASE WHEN {a} = '' OR {b} = '' THEN 0.0 WHEN {a} = {b} THEN 1.0 WHEN contains({a}, {b}) OR contains({b}, {a}) THEN 0.9"
        f" WHEN list_last({p}) = list_last({q}) THEN CASE WHEN substr({a}, 1, 1) = substr({b}, 1, 1) THEN CAST(0.7 AS DOUBLE) + CAST(0.2 AS DOUBLE) ELSE 0.7 END"
        f" ELSE len(list_intersect(list_distinct({p}), list_distinct({q}))) / greatest(len({p}), len({q})) END"
    )


_SCORED = f"(SELECT entity, author, pos, CAST({_similarity('e.name', 'r.name')} AS DOUBLE) AS score FROM {_ENTITIES} e, {_ROSTER} r)"
_RANKED = f"(SELECT *, CAST(row_number() OVER (PARTITION BY entity ORDER BY score DESC, pos) AS INTEGER) AS rank FROM {_SCORED})"


def _entities(spark, d):
    k, n = F.col("p_partkey") % 4, F.split("p_name", " ")
    kind = F.lower("p_type")
    name = F.when(k == 0, F.col("p_name")).when(k == 1, F.concat_ws(" ", kind, n[1])).when(k == 2, F.concat_ws(" ", "p_name", kind)).otherwise(F.concat_ws(" ", n[1], kind, F.substring("p_name", 1, 3)))
    return table(spark, d, "part").select(F.concat_ws(" ", "p_type", F.col("p_partkey") % 40).alias("entity"), text.fold(name, "author_name").alias("name")).groupBy("entity").agg(F.min("name").alias("name"))


def _authors(spark, d):
    rows = table(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("author"))
    return rows.select("author", F.col("author").alias("pos"), F.array(text.fold(F.col("name"), "author_name")).alias("variants"))


@query(f"SELECT entity, author, CAST(trunc(score * 100) AS INTEGER) AS confidence FROM {_RANKED} WHERE rank = 1 AND score >= 0.85")
def j4_best_match(spark, d):
    return resolve.best_match(_entities(spark, d), _authors(spark, d))


@query(f"SELECT entity, rank, author, round(score, 6) AS score FROM {_RANKED} WHERE rank <= 3 AND score > 0.2")
def j5_candidates(spark, d):
    return resolve.candidates(_entities(spark, d), _authors(spark, d), 0.2, 3).withColumn("score", F.round("score", 6))


@query(f"SELECT entity, author, CAST(trunc(score * 100) AS INTEGER) AS confidence, CASE WHEN score >= 0.95 THEN 'exact' ELSE 'loose' END AS method FROM {_RANKED} WHERE rank = 1 AND score >= 0.3")
def j6_waterfall(spark, d):
    authors = _authors(spark, d)
    stages = [("exact", lambda e: resolve.best_match(e, authors, 0.95)), ("loose", lambda e: resolve.best_match(e, authors, 0.3))]
    return resolve.run_waterfall(_entities(spark, d), stages)[0]


@query(f"SELECT CASE WHEN score >= 0.95 THEN 'exact' WHEN score >= 0.3 THEN 'loose' ELSE 'none' END AS method, count(*) AS n FROM (SELECT e.entity, coalesce(r.score, 0) AS score FROM (SELECT DISTINCT entity FROM {_ENTITIES}) e LEFT JOIN (SELECT * FROM {_RANKED} WHERE rank = 1) r USING (entity)) GROUP BY 1")
def j6_waterfall_counts(spark, d):
    """How many each stage matched, and none did."""
    authors = _authors(spark, d)
    stages = [("exact", lambda e: resolve.best_match(e, authors, 0.95)), ("loose", lambda e: resolve.best_match(e, authors, 0.3))]
    _, left, counts = resolve.run_waterfall(_entities(spark, d), stages)
    rest = left.agg(F.lit("none").alias("method"), F.count(F.lit(1)).alias("n")).filter("n > 0")
    return counts.unionByName(rest)


#: Advisors and people: roster names with a surname; the short form is a name that people also go by.
_SURNAME = "CASE p_partkey % 5 WHEN 0 THEN 'silva' WHEN 1 THEN 'kubrusly' WHEN 2 THEN 'tanaka silva' WHEN 3 THEN 'kubrusly tanaka' ELSE '' END"
_PEOPLE = f"(SELECT min(p_partkey) AS pos, p_name || ' ' || {_SURNAME} AS name FROM part GROUP BY 2)"
_ADVISORS = f"(SELECT DISTINCT string_split(p_name, ' ')[1] || ' ' || CASE p_partkey % 3 WHEN 0 THEN string_split(p_name, ' ')[2] || ' ' ELSE '' END || {_SURNAME} AS name FROM part)"
_COMMON = "[" + ", ".join(f"'{x}'" for x in [*names.COMMON_LAST_NAMES, *names.COMMON_FIRST_NAMES, *names.PREPOSITIONS]) + "]"
_NO_TELL = "[" + ", ".join(f"'{x}'" for x in [*names.COMMON_LAST_NAMES, *names.COMMON_FIRST_NAMES]) + "]"


def _advisor_score(a: str, b: str) -> str:
    """The advisor ladder in SQL over trimmed lower-case names without a short form."""
    p, q = f"string_split({a}, ' ')", f"string_split({b}, ' ')"
    shared = f"len(list_filter(list_intersect(list_distinct({p}), list_distinct({q})), lambda x: NOT list_contains({_COMMON}, x)))"
    second = f"CASE WHEN len({p}) > 1 THEN {p}[-2] ELSE '' END"
    return (
        f"CASE WHEN {a} = {b} THEN 1.0 WHEN (contains({a}, {b}) OR contains({b}, {a})) AND {shared} >= 1 THEN 0.95 WHEN {p}[1] <> {q}[1] THEN 0.0"
        f" WHEN {p}[-1] = {q}[-1] AND NOT list_contains({_NO_TELL}, {p}[-1]) THEN 0.9 WHEN {p}[-1] = {q}[-1] AND {shared} >= 1 THEN 0.85"
        f" WHEN {second} <> '' AND {second} = {q}[-1] AND NOT list_contains({_NO_TELL}, {second}) THEN 0.85 WHEN {shared} >= 2 THEN 0.8 ELSE 0.0 END"
    )


def _surnames():
    """Names of an advisor and of a person, made of a part's."""
    k, n = F.col("p_partkey"), F.split("p_name", " ")
    surname = F.when(k % 5 == 0, "silva").when(k % 5 == 1, "kubrusly").when(k % 5 == 2, "tanaka silva").when(k % 5 == 3, "kubrusly tanaka").otherwise("")
    middle = F.when(k % 3 == 0, F.concat(n[1], F.lit(" "))).otherwise("")
    return F.trim(F.concat(n[0], F.lit(" "), middle, surname)), F.trim(F.concat("p_name", F.lit(" "), surname))


def _people(spark, d):
    advisor, person = _surnames()
    part = table(spark, d, "part")
    people = part.groupBy(person.alias("name")).agg(F.min("p_partkey").alias("entity"))
    return part.select(advisor.alias("name")).distinct(), people.select("entity", F.col("entity").alias("pos"), "name", F.lit("").alias("short"))


_LADDER = f"(SELECT a.name, b.pos AS entity, CAST({_advisor_score('a.name', 'b.name')} AS DOUBLE) AS score FROM (SELECT trim(name) AS name FROM {_ADVISORS}) a, (SELECT pos, trim(name) AS name FROM {_PEOPLE}) b)"


_WITH_SURNAME = f"(SELECT p_partkey AS k, trim(p_name || ' ' || {_SURNAME}) AS name, trim(string_split(p_name, ' ')[1] || ' ' || CASE p_partkey % 3 WHEN 0 THEN string_split(p_name, ' ')[2] || ' ' ELSE '' END || {_SURNAME}) AS advisor FROM part)"


_PARTS = "(SELECT count(*) FROM part)"


@query(f"SELECT c_custkey, CAST({_advisor_score('a.advisor', 'b.name')} AS DOUBLE) AS score FROM customer JOIN {_WITH_SURNAME} a ON a.k = c_custkey % {_PARTS} JOIN {_WITH_SURNAME} b ON b.k = c_custkey * 7 % {_PARTS}")
def f15_advisor_name_similarity(spark, d):
    advisor, person = _surnames()
    part = table(spark, d, "part")
    n = part.count()
    left = part.select(F.col("p_partkey").alias("x"), names.name_parts(advisor).alias("_p"))
    right = part.select(F.col("p_partkey").alias("y"), names.name_parts(person).alias("_q"))
    rows = table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % n).alias("x"), (F.col("c_custkey") * 7 % n).alias("y"))
    score = names.advisor_name_similarity(F.col("_p"), F.col("_q"))
    return rows.join(left, "x").join(right, "y").select("c_custkey", score.alias("score"))


@query(f"SELECT name, entity, score FROM {_LADDER} WHERE score >= 0.7 QUALIFY row_number() OVER (PARTITION BY name ORDER BY score DESC, entity) = 1")
def j7_match_distinctive(spark, d):
    return resolve.match_distinctive(*_people(spark, d))
