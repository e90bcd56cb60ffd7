"""Queries of the remaining operators: scalar functions, projections, gates, parsers, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from biblio.functions import names, text
from biblio.operators import arrange, dedup, pages, quality, resolve, search, snapshot
from biblio.sources import records as sources

from .base import CURRENT, PREVIOUS, WORKS, query, snapshots, table, works

def key():
    return F.col("c_custkey")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '0000-0002-1825-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') END AS orcid FROM customer")
def f10_extract_orcid(spark, d):
    note = F.when(key() % 3 == 0, F.concat(F.lit("orcid: 0000-0002-1825-"), F.lpad((key() % 10000).cast("string"), 4, "0"), F.lit("."))).otherwise("none")
    return table(spark, d, "customer").select("c_custkey", text.extract_orcid(note).alias("orcid"))


@query("WITH o AS (SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 16, '0') AS s FROM customer), t AS (SELECT c_custkey, s, list_reduce(list_prepend(CAST(0 AS BIGINT), [CAST(substr(s, CAST(i AS INTEGER), 1) AS BIGINT) FOR i IN range(1, 16)]), lambda a, x: (a + x) * 2) AS total FROM o) SELECT c_custkey, CASE WHEN (12 - total % 11) % 11 = 10 THEN FALSE ELSE CAST((12 - total % 11) % 11 AS VARCHAR) = substr(s, 16, 1) END AS ok FROM t")
def f11_orcid_valid(spark, d):
    s = F.lpad(key().cast("string"), 16, "0")
    dashed = F.concat_ws("-", *(F.substring(s, i, 4) for i in (1, 5, 9, 13)))
    return table(spark, d, "customer").select("c_custkey", text.orcid_valid(dashed).alias("ok"))


@query("SELECT c_custkey, lower(list_first(string_split(p_name, ' '))) AS first, lower(list_last(string_split(p_name, ' '))) AS last, len(list_distinct(string_split(p_name, ' '))) AS parts FROM customer JOIN part ON p_partkey = c_custkey % 100 + 1")
def f16_name_parts(spark, d):
    rows = table(spark, d, "customer").join(table(spark, d, "part"), F.col("p_partkey") == key() % 100 + 1).select("c_custkey", names.name_parts(F.col("p_name")).alias("n"))
    return rows.select("c_custkey", "n.first", "n.last", F.size("n.all").cast("long").alias("parts"))


@query("SELECT p_partkey, array_to_string(list_filter(string_split(lower(p_name), ' '), lambda x: len(x) > 1 AND x NOT IN ('de','da','do','dos','das','e','a','o','em','no','na')), ' ') AS tokens FROM part")
def f17_significant_tokens(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(text.significant_tokens(F.col("p_name")), " ").alias("tokens"))


@query(r"SELECT doc_id, md5(trim(regexp_replace(replace(text, chr(160), ' '), '[\s\x0B]+', ' ', 'g'), ' ')) AS cleaned FROM documents")
def f18_clean_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.clean_text(F.col("text"))).alias("cleaned"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey AS INTEGER) ELSE 0 END AS n FROM customer")
def f21_to_int_or_zero(spark, d):
    raw = F.when(key() % 3 == 0, key().cast("string")).when(key() % 3 == 1, F.concat(F.lit("x"), key().cast("string")))
    return table(spark, d, "customer").select("c_custkey", text.to_int_or_zero(raw).alias("n"))


@query("SELECT p_partkey, p_brand AS journal, p_name AS title FROM part")
def f24_citation_split(spark, d):
    whole = F.concat(F.lit("A, B; C . "), "p_name", F.lit(" . "), "p_brand", F.lit(" , v. 1"))
    c = text.citation_split(whole)
    return table(spark, d, "part").select("p_partkey", c["journal"].alias("journal"), c["title"].alias("title"))


@query(r"SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/x/y.pdf' AS absolute FROM pages")
def f26_url_join(spark, d):
    return table(spark, d, "pages").select("page_id", text.url_join(F.col("url"), F.lit("/x/y.pdf")).alias("absolute"))


@query("SELECT doc_id, md5(translate(text, 'ęăőŕűůňřčđ', 'êãõàûùòøèð')) AS fixed FROM documents")
def f27_mojibake_fix(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.mojibake_fix(F.col("text"))).alias("fixed"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE o_orderpriority END AS pdf_url, coalesce(nullif(CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE o_orderstatus END, ''), 'none') AS course FROM orders")
def p2_thesis_record(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select("o_orderkey", F.when(k % 3 == 0, F.col("o_orderstatus")).otherwise("").alias("pdf_url"), F.col("o_orderpriority").alias("fulltext_url"), F.when(k % 2 == 0, "").otherwise(F.col("o_orderstatus")).alias("course"))
    return search.thesis_record(rows, {"course": "none"})


@query("SELECT CAST(o_orderkey AS VARCHAR) AS number, CAST(year(o_orderdate) AS VARCHAR) AS year, CAST(CASE WHEN o_custkey % 2 = 0 THEN o_custkey ELSE 0 END AS INTEGER) AS citations FROM orders WHERE o_orderkey % 5 > 0")
def p3_normalize_entry(spark, d):
    k = F.col("o_orderkey")
    raw = table(spark, d, "orders").select(F.when(k % 5 > 0, F.concat(F.lit("2-s2.0-"), k)).otherwise(k.cast("string")).alias("eid"), F.col("o_orderpriority").alias("title"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("cover_date"), F.lit("d").alias("doi"), F.lit("j").alias("publication_name"), F.lit("ar").alias("subtype"), F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey").cast("string")).otherwise("n/a").alias("citedby"), F.lit("u").alias("url"))
    return search.normalize_entry(raw)[0].select("number", "year", "metrics.citations")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS eid, 'article' AS type, CAST(count(l_suppkey) AS INTEGER) AS authors FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def p4_master_record(spark, d):
    flat = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("eid")).agg(F.array_join(F.collect_list(F.col("l_suppkey").cast("string")), "; ").alias("author_ids"), F.array_join(F.collect_list(F.lit("n")), ";").alias("author_names"))
    rows = flat.withColumns({"title": F.lit("t"), "year": F.lit("2000"), "kind": F.lit("ar"), "journal": F.lit("j"), "issn": F.lit("i")})
    return search.master_record(rows).select("eid", "type", F.size("authors").alias("authors"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE o_orderpriority END, '') AS course FROM orders")
def p5_comparable(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(k.alias("id"), F.when(k % 2 == 0, F.col("o_orderstatus")).alias("course"), F.when(k % 2 == 1, F.col("o_orderpriority")).alias("curso"))
    return snapshot.comparable(rows, {"course": ["curso"]}, ["id"])


@query("SELECT event_id, user_id % 3 = 0 AS changed FROM events")
def p6_sanitize(spark, d):
    rows = table(spark, d, "events").select("event_id", F.when(F.col("user_id") % 3 == 0, F.col("props")).alias("abstract"), F.struct("event_type", F.lit(None).cast("string").alias("mail")).alias("who"))
    return quality.sanitize(rows, ["abstract"], {"who": ["mail"]}).select("event_id", "changed")


@query("SELECT event_id, event_type AS kind FROM events")
def p7_semantic(spark, d):
    rows = table(spark, d, "events").select("event_id", F.struct(F.col("event_type").alias("kind"), F.col("ts").cast("string").alias("last_updated")).alias("m"), F.col("ts").cast("string").alias("generated_at"))
    got = snapshot.semantic(rows)
    return got.select("event_id", "m.*")


@query("SELECT c_custkey AS id FROM customer WHERE c_acctbal > 0 AND c_nationkey % 2 = 0")
def p13_select_entities(spark, d):
    rows = table(spark, d, "customer").select(key().alias("id"), (F.col("c_acctbal") > 0).alias("active"), F.when(F.col("c_nationkey") % 2 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("external_ids"))
    return search.select_entities(rows)[0].select("id")


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE c_mktsegment END AS label FROM customer")
def p20_localized(spark, d):
    s = F.struct(F.col("c_mktsegment").alias("pt"), F.when(key() % 2 == 0, F.col("c_name")).otherwise("").alias("en"))
    return table(spark, d, "customer").select("c_custkey", text.localized(s, "en").alias("label"))


@query("SELECT o_custkey AS id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS pos, o_orderkey AS document FROM orders UNION ALL SELECT c_custkey, NULL, NULL FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def p25_category_documents(spark, d):
    lists = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("documents"))
    return search.category_documents(table(spark, d, "customer").select(key().alias("id")).join(lists, "id", "left"))


@query("SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+:', ''), '^/+', '') AS path FROM pages")
def p26_normalize_batch(spark, d):
    return search.normalize_batch(table(spark, d, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+:", "").alias("path")), ["path"])


@query("SELECT lower(replace(s_name, '#', '-')) AS id, CAST(s_suppkey AS VARCHAR) AS source_id FROM (SELECT s_suppkey, 'Supplier#' || s_suppkey AS s_name FROM supplier)")
def p27_migrate_person(spark, d):
    k = F.col("s_suppkey")
    rows = table(spark, d, "supplier").select(F.concat(F.lit("Supplier-"), k).alias("name"), F.concat(F.lit("http://s/?authorId="), k).alias("link"), F.lit("a").alias("area"))
    return search.migrate_person(rows).select("id", "source_id")


@query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 7")
def p28_lookup(spark, d):
    return search.lookup(table(spark, d, "customer"), "c_nationkey", 7).select("c_custkey", "c_name")


@query("SELECT l_orderkey AS id, CAST(min(i) FILTER (l_suppkey = 7) AS BIGINT) AS position FROM (SELECT l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) AS i FROM lineitem) GROUP BY 1")
def j14_position_of(spark, d):
    from .base import advised

    return arrange.position_of(advised(spark, d), "people", F.lit("7")).select("id", F.col("position").cast("long").alias("position"))


@query("SELECT s_suppkey AS id, s_acctbal AS h, CAST(count(DISTINCT l_orderkey) AS INTEGER) AS works FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey WHERE s_suppkey % 4 > 0 GROUP BY 1, 2")
def j18_merge_profile(spark, d):
    people = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    metrics = table(spark, d, "supplier").filter("s_suppkey % 4 > 0").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("h"))
    done = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("id"), F.col("l_orderkey").alias("work"), F.array("l_returnflag").alias("areas"))
    return resolve.merge_profile(people, metrics, done).select("id", "h", F.size("works").alias("works"))


@query("SELECT n.c_custkey AS id, coalesce(CASE WHEN n.c_custkey % 5 = 0 THEN n.c_name END, '') AS editor FROM customer n")
def j24_with_default(spark, d):
    c = table(spark, d, "customer")
    return resolve.with_default(c.select(key().alias("id")), c.filter("c_custkey % 5 = 0").select(key().alias("id"), F.col("c_name").alias("editor")), "id", "editor")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'doi' WHEN o_orderkey % 4 = 3 THEN 'eid' ELSE 'title-year-journal' END AS kind, min(o_orderkey) OVER (PARTITION BY CASE WHEN o_orderkey % 4 = 0 THEN 'doi' || (o_orderkey // 40) WHEN o_orderkey % 4 = 3 THEN 'eid' || o_orderkey ELSE 'tyj' || (o_orderkey // 40) || '|' || year(o_orderdate) || '|' || o_orderstatus END) AS first FROM orders")
def d1_duplicate_key(spark, d):
    from .records import _works

    keyed = dedup.duplicate_key(_works(spark, d))
    first = keyed.groupBy("key").agg(F.min(F.col("id").cast("bigint")).alias("first"))
    return keyed.join(first, "key").select("id", F.col("key.kind").alias("kind"), "first")


@query("SELECT 'when:finished orders have a date' AS rule, CAST(o_orderkey AS VARCHAR) AS key, 'finished orders have a date' AS message FROM orders WHERE o_orderstatus = 'F' AND NOT o_orderdate < TIMESTAMP '1995-01-01'")
def q6_conditional_required(spark, d):
    rule = ("finished orders have a date", F.col("o_orderstatus") == "F", F.col("o_orderdate") < F.lit("1995-01-01").cast("timestamp_ntz"))
    return quality.conditional_required(table(spark, d, "orders"), "o_orderkey", [rule])


@query("SELECT 'file_name' AS rule, CAST(page_id AS VARCHAR) AS key, CAST(page_id + 1 AS VARCHAR) AS message FROM pages WHERE page_id % 6 = 0")
def q8_file_matches_id(spark, d):
    k = F.col("page_id")
    rows = table(spark, d, "pages").select(k, F.concat(F.lit("data/x/"), F.when(k % 6 == 0, k + 1).otherwise(k), F.lit(".json")).alias("path"))
    return quality.file_matches_id(rows, "page_id")


@query(f"SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS o_totalprice FROM {CURRENT}")
def q11_publishable(spark, d):
    return snapshot.publishable(*snapshots(spark, d), "o_orderkey").select("o_orderkey", F.col("o_totalprice").cast("double").alias("o_totalprice"))


@query("SELECT 'enum:o_orderstatus' AS rule, CAST(o_orderkey AS VARCHAR) AS key, 'Z' AS message FROM orders WHERE o_orderkey % 100 = 1 UNION ALL SELECT 'unique:o_orderkey', CAST(o_orderkey AS VARCHAR), '2' FROM orders WHERE o_orderkey % 100 = 2")
def q12_admit_batch(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    bad = o.filter("o_orderkey % 100 = 1").withColumn("o_orderstatus", F.lit("Z"))
    twice = o.filter("o_orderkey % 100 = 2")
    batch = bad.unionByName(twice).unionByName(twice)
    return quality.admit_batch(o.filter("o_orderkey % 100 > 2"), batch, quality.Rules(key="o_orderkey", enums={"o_orderstatus": ["F", "O", "P"]}))


@query("SELECT o_custkey AS person, (SELECT string_agg(DISTINCT CAST(o2.o_orderkey AS VARCHAR), ',' ORDER BY CAST(o2.o_orderkey AS VARCHAR)) FROM orders o2 WHERE o2.o_custkey = o.o_custkey AND o2.o_orderkey % 50 = 0) AS added_ids FROM orders o WHERE o_orderkey % 50 = 0 GROUP BY 1")
def q14_curated_changes(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("person"), F.col("o_orderkey").cast("string").alias("id"))

    def lists(df):
        return df.groupBy("person").agg(F.collect_set("id").alias("ids"))

    got = snapshot.curated_changes(lists(o.filter("cast(id as bigint) % 50 <> 0")), lists(o), "person", "ids")
    return got.select("person", F.array_join("added_ids", ",").alias("added_ids"))


@query(f"SELECT id, year FROM {WORKS} WHERE type = 'F' UNION ALL SELECT id, NULL FROM {WORKS} WHERE type = 'O'")
def u1_union_all(spark, d):
    w = works(spark, d)
    return arrange.union_all(w.filter("type = 'F'").select("id", "year"), w.filter("type = 'O'").select("id"))


@query("SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'theses' ELSE 'works' END AS kind, o_orderkey AS id FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0")
def s5_staged_or_previous(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(F.when(k % 2 == 0, "theses").otherwise("works").alias("kind"), k.alias("id"))
    return snapshot.staged_or_previous(rows.filter("kind = 'theses'"), rows.filter("id % 3 = 0"))


@query("SELECT CAST(event_id AS VARCHAR) AS id, CAST(value AS VARCHAR) IS NOT NULL AS has_value FROM events")
def s3_explode_keyed_map(spark, d):
    keyed = table(spark, d, "events").select(F.create_map(F.col("event_id").cast("string"), F.struct("value")).alias("m"))
    return sources.explode_keyed_map(keyed, "m").select("id", F.col("value").isNotNull().alias("has_value"))


@query("SELECT l_orderkey AS id, string_agg(CAST(l_suppkey AS VARCHAR), ',' ORDER BY l_linenumber, l_suppkey) AS advisors FROM lineitem GROUP BY 1")
def s6_to_source_shape(spark, d):
    from .base import advised

    rows = advised(spark, d).select("id", F.transform("people", lambda p: F.struct(p.alias("name"), F.lit(None).cast("string").alias("professor_slug"))).alias("advisors"))
    return sources.to_source_shape(rows, ["advisors"]).select(F.col("id").cast("long").alias("id"), F.array_join("advisors", ",").alias("advisors"))


def _lists(spark, d):
    """A catalogue list for each customer that has orders: one table row an order, some without link, id or enough cells."""
    o = table(spark, d, "orders")
    n, k = F.col("o_orderkey") % 7, F.col("o_orderkey").cast("string")
    link = F.when(n == 0, F.concat(F.lit("Title "), k)).when(n == 1, F.concat(F.lit('<a href="d.php">Title '), k, F.lit("</a>"))).otherwise(F.concat(F.lit('<a href="d.php?num_tese='), k, F.lit('&amp;x=1"><b>Title</b> &amp; '), k, F.lit("</a>")))
    rest = F.when(n == 2, "<td>Ana</td><td>P</td>").otherwise("<td>Ana<td>P</td><td>2020</td><td>Mestrado</td>")
    row = F.concat(F.lit("<tr><td>1</td><td>"), link, F.lit("</td>"), rest, F.when(n == 3, "").otherwise("</tr>"))
    return o.groupBy(F.col("o_custkey").alias("page_id")).agg(F.concat(F.lit("<table><tr><th>#</th></tr>"), F.array_join(F.sort_array(F.collect_list(row)), ""), F.lit("</table><table><tr><td>1</td><td><a href='?num_tese=9'>no</a></td><td>a</td><td>b</td><td>c</td><td>d</td></tr></table>")).alias("html"))


@query("SELECT o_custkey AS page, CAST(o_orderkey AS VARCHAR) AS id, 'Title & ' || o_orderkey AS title, 'http://h/c/d.php?num_tese=' || o_orderkey || '&x=1' AS detail_url FROM orders WHERE o_orderkey % 7 > 2")
def h1_extract_catalogue(spark, d):
    return pages.extract_catalogue(_lists(spark, d), "theses", "http://h/c/l.php")[0].select("page", "id", "title", "detail_url")


@query("SELECT o_orderkey AS page, 'advisors' AS field, CAST(o_custkey AS VARCHAR) AS value FROM orders UNION ALL SELECT o_orderkey, 'advisors', o_orderstatus FROM orders UNION ALL SELECT o_orderkey, 'title', o_orderpriority FROM orders UNION ALL SELECT o_orderkey, 'co_advisors', 'Bo' FROM orders WHERE o_orderkey % 3 = 0")
def h2_extract_detail(spark, d):
    """Labels that carry forward, repeat, are unknown or stand alone."""
    html = F.concat(
        F.lit("<table><tr><td>Orientador:</td><td>"), "o_custkey", F.lit("</td></tr><tr><td></td><td>"), "o_orderstatus", F.lit("<tr><td>Título:<td>"), "o_orderpriority", F.lit("</td></tr><tr><td>Alone</td></tr><tr><td>Other label:</td><td>x</td></tr><tr><td>Título</td><td>again</td></tr>"),
        F.when(F.col("o_orderkey") % 3 == 0, "<tr><td>Coorientador(a):</td><td><b>Bo</b></td></tr>").otherwise("<tr><th>Coorientador:</th><td>Bo</td></tr>"), F.lit("</table>"),
    )
    few = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))  # a small file would be one task
    return pages.extract_detail(few.select(F.col("o_orderkey").alias("page_id"), html.alias("html")), "http://h/").select("page", "field", "value")


@query("SELECT c_custkey AS page, CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 90 ELSE 0 END AS works, CAST(7 AS BIGINT) AS second, CASE WHEN c_custkey % 5 > 0 THEN CAST(c_custkey AS VARCHAR) END AS source_id FROM customer")
def h4_extract_profile(spark, d):
    works_ = F.when(key() % 4 > 0, (key() % 90).cast("string")).otherwise("none")
    link = F.when(key() % 5 > 0, F.concat(F.lit("authorId="), key())).otherwise("author=x")
    html = F.concat(F.lit('<div class="a science_cont b"><div class="web_s">Scopus</div><div class="trab">Total: '), works_, F.lit('</div></div><div class="science_cont"><div class="web_s">Other</div><div class="trab">7 works</div></div><a href="http://s/?'), link, F.lit('">x</a>'))
    got = pages.extract_profile(table(spark, d, "customer").select(key().alias("page_id"), html.alias("html")))
    return got.select("page", F.col("counters")[0]["works"].alias("works"), F.col("counters")[1]["works"].alias("second"), "source_id")


@query("SELECT p_partkey AS page, CASE WHEN p_partkey % 3 > 0 THEN '10.1/' || p_partkey ELSE '' END AS doi, CASE WHEN p_partkey % 4 > 0 THEN CAST(2000 + p_size % 20 AS INTEGER) END AS year, p_name AS title FROM part UNION ALL SELECT p_partkey, '10.2/x', 1999, 'Second' FROM part WHERE p_partkey % 2 = 0")
def h5_extract_articles(spark, d):
    """Blocks without a DOI or a year, and pages with a second block."""
    k = F.col("p_partkey")
    year = F.when(k % 4 > 0, F.concat(F.lit('<span data-tipo-ordenacao="ano">'), 2000 + F.col("p_size") % 20, F.lit("</span>"))).otherwise("")
    doi = F.when(k % 3 > 0, F.concat(F.lit('<a href="http://dx.doi.org/10.1/'), k, F.lit('"></a>'))).otherwise('<a href="http://other/">x</a>')
    one = F.concat(F.lit('<div class="artigo-completo">'), doi, F.lit('<span class="transform">A; B . '), "p_name", F.lit(" . J , v. 1"), year, F.lit("</span></div>"))
    two = F.when(k % 2 == 0, '<div class="x artigo-completo"><a href="https://doi.org/10.2/x"></a><span class="transform">C . Second . K , v. 2<span data-tipo-ordenacao="ano">1999</span></span></div>').otherwise("")
    return pages.extract_articles(table(spark, d, "part").select(k.alias("page_id"), F.concat(one, two).alias("html"))).select("page", "doi", "year", "title")
