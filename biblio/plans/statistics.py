"""Queries of counting operators, windows, limits and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from biblio.operators import arrange, stats

from .base import CURRENT, EDGES, NODES, NOW, PREVIOUS, WORKS, advised, edges, nodes, query, snapshots, table, works


#: Order and line number repeat in the test table; all columns together tell its lines apart.
LINE_ORDER = ["l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@query(f"SELECT year, count(*) AS works, CAST(coalesce(sum(coalesce(citations, 0)), 0) AS BIGINT) AS citations FROM {WORKS} GROUP BY year")
def g1_yearly_stats(spark, d):
    return stats.yearly_stats(works(spark, d))


@query("SELECT o_orderstatus AS type, count(*) AS works FROM orders GROUP BY 1")
def g2_type_counts(spark, d):
    return stats.type_counts(works(spark, d))


@query(f"SELECT 'type' AS dimension, type AS key, count(*) AS n FROM {WORKS} GROUP BY 2 UNION ALL SELECT 'year', CAST(year AS VARCHAR), count(*) FROM {WORKS} GROUP BY 2 UNION ALL SELECT 'area', area, count(*) FROM {WORKS} GROUP BY 2 UNION ALL SELECT 'total', '', count(*) FROM {WORKS}")
def g3_marginals(spark, d):
    return stats.marginals(works(spark, d).drop("citations"), {"type": "unknown", "year": "unknown", "area": "unknown"})


@query(f"WITH r AS (SELECT author, citations, row_number() OVER (PARTITION BY author ORDER BY citations DESC, work) AS i FROM {EDGES}) SELECT author, count(*) AS works, CAST(sum(citations) AS BIGINT) AS citations, count(*) FILTER (citations >= i) AS h_index FROM r GROUP BY author")
def g4_author_scorecard(spark, d):
    return stats.author_scorecard(edges(spark, d))


@query("SELECT CAST(l_suppkey AS VARCHAR) AS name, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, name LIMIT 10")
def g5_advisor_load(spark, d):
    return stats.advisor_load(advised(spark, d), ["people"], 10)


@query("WITH p AS (SELECT l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) AS i FROM lineitem) SELECT CAST(l_suppkey AS VARCHAR) AS name, count(*) FILTER (i = 1) AS main, count(*) FILTER (i > 1) AS co, count(*) AS total FROM p GROUP BY 1")
def g6_advisor_roles(spark, d):
    return stats.advisor_roles(advised(spark, d), "people")


def roles(spark, d):
    lines = table(spark, d, "lineitem")
    role = F.when(F.col("l_linenumber") == 1, "advisor").otherwise("coadvisor")
    return lines.select(F.col("l_suppkey").alias("person"), F.col("l_orderkey").alias("work"), role.alias("role"), F.when(F.col("l_returnflag") == "R", "M").otherwise("D").alias("degree"))


@query("SELECT l_suppkey AS person, string_agg(DISTINCT CAST(l_orderkey AS VARCHAR), ',' ORDER BY CAST(l_orderkey AS VARCHAR)) FILTER (l_linenumber = 1) AS as_advisor, string_agg(DISTINCT CAST(l_orderkey AS VARCHAR), ',' ORDER BY CAST(l_orderkey AS VARCHAR)) FILTER (l_linenumber <> 1) AS as_coadvisor, count(*) FILTER (l_linenumber = 1 AND l_returnflag = 'R') AS master_count, count(*) FILTER (l_linenumber = 1 AND l_returnflag <> 'R') AS doctor_count FROM lineitem GROUP BY 1")
def g7_supervision_lists(spark, d):
    got = stats.supervision_lists(roles(spark, d).withColumn("work", F.col("work").cast("string")), "person", "work", "role", "degree")
    return got.withColumns({c: F.nullif(F.array_join(c, ","), F.lit("")) for c in ("as_advisor", "as_coadvisor")})


@query("SELECT c_mktsegment AS level, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY ROLLUP (c_mktsegment)")
def g8_fellowship_counts(spark, d):
    return stats.fellowship_counts(table(spark, d, "customer").select(F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("level")))


@query("SELECT value, count(*) AS n, min_by(p_type, p_partkey) AS info FROM (SELECT p_partkey, p_type, unnest(list_distinct(string_split(p_name, ' '))) AS value FROM part) GROUP BY value ORDER BY n DESC, value LIMIT 20")
def g9_top_values(spark, d):
    return stats.top_values(table(spark, d, "part").withColumn("v", F.split("p_name", " ")), "v", 20, "p_type", "p_partkey")


@query("SELECT c_nationkey AS person, CAST(max(c_custkey % 60) AS BIGINT) AS h_index, CAST(sum(c_custkey % 11) AS BIGINT) AS citations, CAST(sum(c_custkey % 13) AS BIGINT) AS cited_by, CAST(count(*) AS BIGINT) AS documents, CAST(max(c_custkey % 17) AS BIGINT) AS coauthors FROM customer GROUP BY 1")
def g10_combine_author_metrics(spark, d):
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(F.col("c_nationkey").alias("person"), (k % 60).alias("h_index"), (k % 11).alias("citations"), (k % 13).alias("cited_by"), F.lit(1).alias("documents"), (k % 17).alias("coauthors"))
    return stats.combine_author_metrics(rows)


@query("SELECT p_partkey, nullif(greatest(coalesce(CASE WHEN p_size % 2 = 0 THEN p_size END, 0), CAST(p_partkey % 9 AS INTEGER), 0), 0) AS best FROM part")
def g11_best_metric(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.col("p_size")).alias("a"), (F.col("p_partkey") % 9).cast("int").alias("b"))
    return stats.best_metric(rows, ["a", "b"]).select("p_partkey", "best")


@query("WITH r AS (SELECT l_suppkey AS project, l_orderkey * 10 + l_linenumber AS pos, CASE WHEN l_returnflag = 'N' THEN '' ELSE l_returnflag END AS line, l_linestatus AS area, CAST(l_partkey % 5 AS VARCHAR) AS person FROM lineitem) SELECT project, min_by(line, pos) FILTER (line <> '') AS line, min_by(area, pos) AS area, string_agg(person, ',' ORDER BY first_pos) AS people, CAST(max(n) AS BIGINT) AS productions FROM (SELECT project, person, min(pos) AS first_pos FROM r GROUP BY 1, 2) JOIN (SELECT project AS p, min_by(line, pos) FILTER (line <> '') AS line, min_by(area, pos) AS area, count(DISTINCT pos // 10) AS n, min(pos) AS pos FROM r GROUP BY 1) ON p = project GROUP BY project")
def g12_aggregate_projects(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("project"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("l_returnflag")).alias("line"), F.col("l_linestatus").alias("area"), F.array((F.col("l_partkey") % 5).cast("string")).alias("people"), F.col("l_orderkey").cast("string").alias("production"))
    return stats.aggregate_projects(rows).select("project", "line", "area", F.array_join("people", ",").alias("people"), F.size("productions").cast("long").alias("productions"))


@query("SELECT CAST(l_suppkey AS VARCHAR) AS member, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1")
def g13_count_per_member(spark, d):
    return stats.count_per_member(advised(spark, d), "people")


@query(f"SELECT area AS topic, count(DISTINCT id) AS works, string_agg(DISTINCT CAST(owner % 100 AS VARCHAR), ',' ORDER BY CAST(owner % 100 AS VARCHAR)) AS people FROM {WORKS} GROUP BY 1")
def g14_topic_index(spark, d):
    rows = works(spark, d).select(F.col("area").alias("topic"), F.col("id").alias("work"), (F.col("owner") % 100).cast("string").alias("person"))
    return stats.topic_index(rows).withColumn("people", F.array_join("people", ","))


@query("SELECT l_orderkey AS work, string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), ',' ORDER BY CAST(l_suppkey AS VARCHAR)) AS people FROM lineitem GROUP BY 1")
def g15_invert_references(spark, d):
    per = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("person")).agg(F.collect_set("l_orderkey").alias("refs"))
    return stats.invert_references(per, "person", "refs").withColumn("people", F.array_join("people", ","))


@query("SELECT count(*) AS total, count(o) AS matched, round(100.0 * count(o) / count(*), 1) AS coverage FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS o FROM orders) ON o = c_custkey")
def g16_match_stats(spark, d):
    return stats.match_stats(table(spark, d, "customer").withColumnRenamed("c_custkey", "k"), table(spark, d, "orders").withColumnRenamed("o_custkey", "k"), "k")


@query("WITH p AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_suppkey) AS o FROM lineitem GROUP BY 1) SELECT (SELECT count(*) FROM lineitem) AS raw, CAST(0 AS BIGINT) AS without_id, (SELECT count(*) FROM lineitem WHERE l_returnflag = 'N') AS without_doi, count(*) AS unique_works, CAST(sum(n - 1) AS BIGINT) AS duplicates, count(*) FILTER (o > 1) AS shared FROM p")
def g17_dedup_stats(spark, d):
    return stats.dedup_stats(table(spark, d, "lineitem").withColumn("doi", F.when(F.col("l_returnflag") != "N", F.col("l_returnflag"))), "l_orderkey", "l_suppkey", "doi")


@query("SELECT count(*) AS total FROM lineitem")
def g18_total_references(spark, d):
    return stats.total_references(advised(spark, d), "people")


@query("SELECT dimension, key, CAST(sum(n) AS BIGINT) AS n FROM (SELECT 'year' AS dimension, CAST(year(o_orderdate) AS VARCHAR) AS key, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'type', o_orderstatus, count(*) FROM orders GROUP BY 2) GROUP BY 1, 2")
def g19_update_statistics(spark, d):
    old, new = works(spark, d).filter("id % 50 <> 0"), works(spark, d).filter("id % 50 = 0")
    dims = {"year": "unknown", "type": "unknown"}
    return stats.update_statistics(stats.marginals(old, dims), stats.marginals(new, dims)).filter("dimension <> 'total'")


@query("SELECT CAST(sum(greatest(0, n - 100)) AS BIGINT) AS omitted FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey % 20)")
def g20_omitted(spark, d):
    return stats.omitted(table(spark, d, "orders").withColumn("c", F.col("o_custkey") % 20), "c")


@query("SELECT CAST(max(o_orderdate) AS VARCHAR) AS latest FROM orders")
def g21_latest(spark, d):
    return stats.latest(table(spark, d, "orders"), "o_orderdate").select(F.col("latest").cast("string").alias("latest"))


@query("SELECT s_suppkey AS person, count(l_orderkey) AS total, count(*) FILTER (l_linenumber = 1) AS main, count(*) FILTER (l_linenumber <> 1) AS co FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey AND l_quantity > 25 GROUP BY 1")
def g22_entity_view(spark, d):
    lines = table(spark, d, "lineitem").filter("l_quantity > 25").select(F.col("l_suppkey").alias("person"), F.when(F.col("l_linenumber") == 1, "main").otherwise("co").alias("role"), F.col("l_returnflag").alias("name"))
    return stats.entity_view(table(spark, d, "supplier").select(F.col("s_suppkey").alias("person")), lines, "person").drop("names")


@query(f"SELECT id, CAST(year AS VARCHAR) || '|' || type || '|' || CAST(citations AS VARCHAR) AS summary FROM {WORKS}")
def g23_summary_index(spark, d):
    rows = works(spark, d).select("id", F.col("area").alias("title"), "year", "type", F.col("owner").alias("people"), "citations")
    return stats.summary_index(rows).select("id", F.concat(F.col("summary.year"), F.lit("|"), F.col("summary.type"), F.lit("|"), F.col("summary.citations")).alias("summary"))


@query(f"SELECT n.id, count(k.id) AS children FROM {NODES} n LEFT JOIN {NODES} k ON k.parent = n.id AND k.visible GROUP BY n.id")
def g24_child_counts(spark, d):
    return stats.child_counts(nodes(spark, d), F.col("visible"))


@query(f"SELECT author, count(*) FILTER (citations >= i) AS h_index FROM (SELECT author, citations, row_number() OVER (PARTITION BY author ORDER BY citations DESC, work) AS i FROM {EDGES}) GROUP BY author")
def w1_h_index(spark, d):
    return stats.h_index(edges(spark, d))


@query(f"SELECT year, works, citations, CAST(sum(citations) OVER (ORDER BY year) AS BIGINT) AS cumulative FROM (SELECT year, count(*) AS works, CAST(sum(coalesce(citations, 0)) AS BIGINT) AS citations FROM {WORKS} WHERE year BETWEEN {NOW} - 10 AND {NOW} GROUP BY year)")
def w2_recent_cumulative(spark, d):
    return stats.recent_cumulative(stats.yearly_stats(works(spark, d)), NOW)


@query(f"WITH p(period, since) AS (VALUES ('all', NULL), ('10y', {NOW - 10}), ('5y', {NOW - 5}), ('2y', {NOW - 2})), r AS (SELECT period, id, citations, row_number() OVER (PARTITION BY period ORDER BY citations DESC, id) AS rank FROM {WORKS} JOIN p ON since IS NULL OR year >= since WHERE citations > 0) SELECT period, CAST(rank AS INTEGER) AS rank, id, citations FROM r WHERE rank <= 10")
def w3_top_cited(spark, d):
    return stats.top_cited(works(spark, d), {"all": None, "10y": 10, "5y": 5, "2y": 2}, 10, NOW).select("period", "rank", "id", "citations")


@query("SELECT l_orderkey AS id, CAST(l_suppkey AS VARCHAR) AS element, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) AS INTEGER) AS position FROM lineitem")
def w4_with_positions(spark, d):
    return arrange.with_positions(advised(spark, d), "people").select("id", "element", "position")


@query("SELECT l_suppkey AS key, min_by(l_orderkey, (l_orderkey, l_linenumber)) AS work, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS all_flag FROM lineitem GROUP BY 1")
def w5_first_wins(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("key"), F.col("l_orderkey").alias("work"), "l_linenumber", F.col("l_returnflag").alias("flag"))
    return arrange.first_wins(rows, "key", ["work", "l_linenumber"], "flag").select("key", "work", F.array_join("all_flag", ",").alias("all_flag"))


@query("WITH r AS (SELECT c_custkey % 1000 AS key, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 1000 ELSE -1 END AS link, c_custkey AS pos FROM customer), p AS (SELECT key, count(*) FILTER (link = key) AS l, min(pos) FILTER (link = key) AS lp, min(pos) AS fp, count(*) AS n FROM r GROUP BY 1) SELECT key, CASE WHEN l = 1 THEN lp ELSE fp END AS pos, CASE WHEN n = 1 THEN 'only' WHEN l = 1 THEN 'linked' ELSE 'first' END AS choice FROM p")
def w6_prefer_linked(spark, d):
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select((k % 1000).alias("key"), F.when(k % 3 == 0, k % 1000).otherwise(-1).alias("link"), k.alias("pos"))
    return arrange.prefer_linked(rows, "key", "link", "pos").select("key", "pos", "choice")


@query("SELECT l_orderkey AS page, l_linenumber AS row, coalesce(last_value(CASE WHEN l_returnflag NOT IN ('', 'N') THEN l_returnflag END IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate ROWS UNBOUNDED PRECEDING), '') AS label FROM lineitem")
def w7_carry_forward(spark, d):
    rows = table(spark, d, "lineitem").withColumn("label", F.col("l_returnflag"))
    return arrange.carry_forward(rows, "l_orderkey", "label", LINE_ORDER, ("", "N")).select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("row"), "label")


@query("SELECT l_orderkey AS page, l_linenumber AS row, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate ROWS UNBOUNDED PRECEDING) AS BIGINT) AS block FROM lineitem")
def w8_blocks(spark, d):
    rows = arrange.blocks(table(spark, d, "lineitem"), "l_orderkey", F.col("l_returnflag") == "R", LINE_ORDER)
    return rows.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("row"), "block")


@query(f"SELECT year, count(*) FILTER (course LIKE '%Mestrado%') AS masters, count(*) FILTER (course LIKE '%Doutorado%') AS doctors FROM (SELECT year, CASE WHEN type = 'F' THEN 'Mestrado Profissional' ELSE 'Doutorado' END AS course FROM {WORKS}) WHERE year BETWEEN {NOW} - 10 AND {NOW} GROUP BY year")
def w10_recent_degrees(spark, d):
    return stats.recent_degrees(works(spark, d).withColumn("course", F.when(F.col("type") == "F", "Mestrado Profissional").otherwise("Doutorado")), NOW)


@query("SELECT o_orderkey, CAST((CASE WHEN o_orderstatus <> '' THEN 20 ELSE 0 END) + (CASE WHEN o_orderpriority <> '' THEN 10 ELSE 0 END) + (CASE WHEN o_totalprice <> 0 THEN 15 ELSE 0 END) + (CASE WHEN o_custkey <> 0 THEN 10 ELSE 0 END) AS INTEGER) AS quality FROM orders")
def p14_quality_score(spark, d):
    return stats.quality_score(table(spark, d, "orders"), {"o_orderstatus": 20, "o_orderpriority": 10, "o_totalprice": 15, "o_custkey": 10}).select("o_orderkey", "quality")


@query(f"SELECT author, citations FROM (SELECT author, CAST(sum(citations) AS BIGINT) AS citations FROM {EDGES} GROUP BY 1) ORDER BY citations DESC, author LIMIT 20")
def o1_top_k(spark, d):
    return arrange.top_k(edges(spark, d).groupBy("author").agg(F.sum("citations").alias("citations")), "citations", 20, "author")


@query(f"SELECT id, year FROM {WORKS}")
def o2_by_year_desc(spark, d):
    return arrange.by_year_desc(works(spark, d).select("id", "year"))


@query("SELECT o_custkey % 20 AS category, o_orderkey AS id FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey % 20 ORDER BY o_orderkey) <= 30")
def o6_cap(spark, d):
    rows = table(spark, d, "orders").select((F.col("o_custkey") % 20).alias("category"), F.col("o_orderkey").alias("id"))
    return arrange.cap(rows, "category", 30, ["id"])


@query("SELECT o_orderkey AS id, CAST(ceil(row_number() OVER (ORDER BY o_orderkey) / 12.0) AS BIGINT) AS page FROM orders")
def p19_paginate(spark, d):
    return arrange.paginate(table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), ["id"])


@query("SELECT 'customer' AS kind, c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier UNION ALL SELECT 'part', p_partkey, p_name FROM part")
def u2_tagged_union(spark, d):
    parts = {n: table(spark, d, n).select(F.col(f"{p}key").alias("id"), F.col(f"{q}name").alias("name")) for n, p, q in (("customer", "c_cust", "c_"), ("supplier", "s_supp", "s_"), ("part", "p_part", "p_"))}
    return arrange.tagged_union(parts)


@query(f"SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'right' WHEN b.o_orderkey IS NULL THEN 'left' ELSE 'both' END AS side FROM {PREVIOUS} a FULL JOIN {CURRENT} b ON a.o_orderkey = b.o_orderkey")
def u3_set_diff(spark, d):
    a, b = snapshots(spark, d)
    return arrange.set_diff(a, b, "o_orderkey")
