"""Queries of joins, resolution, deduplication, snapshots, quality and trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from biblio.functions.text import fold
from biblio.operators import dedup, quality, resolve, snapshot, tree
from biblio.sources import records as sources

from .base import CURRENT, NODES, PREVIOUS, nodes, query, snapshots, table

_ID = "regexp_replace(lower(strip_accents(name)), '[^a-z0-9 ]', '', 'g')"


def roster(spark, d):
    """Part names as people: the smallest key stands for a name."""
    return table(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("entity_id"))


@query("SELECT l_orderkey AS id, string_agg(p_name || '=' || coalesce(CAST(CASE WHEN e % 3 > 0 THEN e END AS VARCHAR), ''), ';' ORDER BY l_linenumber, p_name) AS people FROM lineitem JOIN part ON p_partkey = l_partkey JOIN (SELECT p_name AS n, min(p_partkey) AS e FROM part GROUP BY 1) ON n = p_name GROUP BY 1")
def j1_match_names(spark, d):
    mapping = roster(spark, d).filter("entity_id % 3 > 0").select(fold(F.col("name"), "library_name").alias("name_key"), "entity_id")
    lines = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    lists = lines.groupBy(F.col("l_orderkey").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "p_name"))), lambda x: x["p_name"]).alias("names"))
    matched, _ = resolve.match_names(lists, "id", "names", mapping)
    return matched.select("id", F.array_join(F.transform("people", lambda p: F.concat(p["name"], F.lit("="), F.coalesce(p["entity_id"].cast("string"), F.lit("")))), ";").alias("people"))


@query("SELECT DISTINCT p_name AS name FROM lineitem JOIN part ON p_partkey = l_partkey JOIN (SELECT p_name AS n, min(p_partkey) AS e FROM part GROUP BY 1) ON n = p_name WHERE e % 3 = 0")
def j1_unmatched_names(spark, d):
    """Names of the lines that no one is known by."""
    mapping = roster(spark, d).filter("entity_id % 3 > 0").select(fold(F.col("name"), "library_name").alias("name_key"), "entity_id")
    lines = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return resolve.match_names(lines.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list("p_name").alias("names")), "id", "names", mapping)[1]


@query("WITH prior AS (SELECT p_name AS name, min(p_partkey % 10) AS e, max(p_partkey % 10) AS m FROM part GROUP BY 1), r AS (SELECT name, e, 1 AS k FROM prior WHERE e = m UNION ALL SELECT p_name, min(p_partkey), 2 FROM part WHERE p_size > 25 GROUP BY 1 UNION ALL SELECT p_name, max(p_partkey), 3 FROM part WHERE p_size > 45 GROUP BY 1) SELECT lower(name) AS name_key, arg_max(e, k) AS entity_id FROM r GROUP BY 1")
def j2_build_name_map(spark, d):
    part = table(spark, d, "part")
    prior = part.select(F.col("p_name").alias("name"), (F.col("p_partkey") % 10).alias("entity_id"))
    people = part.filter("p_size > 25").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("entity_id"))
    aliases = part.filter("p_size > 45").groupBy(F.col("p_name").alias("name")).agg(F.max("p_partkey").alias("entity_id"))
    return resolve.build_name_map(prior, people, aliases)


@query("SELECT c_custkey AS entity, max(s_suppkey) AS author, 100 AS score FROM customer JOIN supplier ON s_suppkey % 40 = c_custkey % 60 AND c_custkey % 60 < 40 GROUP BY 1")
def j3_match_by_external_id(spark, d):
    def orcid(k):
        return F.concat(F.lit("see 0000-0002-1825-"), F.lpad(k.cast("string"), 4, "0"), F.lit(" there"))

    people = table(spark, d, "customer").select(F.col("c_custkey").alias("entity"), orcid(F.col("c_custkey") % 60).alias("t"))
    authors = table(spark, d, "supplier").select(F.col("s_suppkey").alias("author"), orcid(F.col("s_suppkey") % 40).alias("t"))
    return resolve.match_by_external_id(people, authors, "entity", "author", "t")


@query("WITH r AS (SELECT p_name AS name, min(p_partkey) AS e FROM part GROUP BY 1), t AS (SELECT name, unnest(list_distinct(list_filter(string_split(lower(name), ' '), lambda x: len(x) > 1 AND x NOT IN ('de','da','do','dos','das','e','a','o','em','no','na')))) AS k FROM r), s AS (SELECT name, count(*) AS n FROM t GROUP BY 1), p AS (SELECT a.name, b.name AS other, count(*) AS c FROM t a JOIN t b ON a.k = b.k GROUP BY 1, 2) SELECT p.name, min(r.e) AS entity FROM p JOIN s ON s.name = p.other JOIN r ON r.name = p.other WHERE c = n OR (n >= 3 AND c >= 3) GROUP BY 1")
def j8_match_tokens(spark, d):
    people = roster(spark, d)
    return resolve.match_tokens(people.select("name"), people.select(F.col("entity_id").alias("entity"), F.col("entity_id").alias("pos"), "name"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F'")
def j11_keep_referenced(spark, d):
    ref = table(spark, d, "orders").filter("o_orderstatus = 'F'").withColumnRenamed("o_orderkey", "l_orderkey")
    return resolve.keep_referenced(table(spark, d, "lineitem"), ref, "l_orderkey").select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey, (SELECT min_by(l_suppkey, (l_linenumber, l_suppkey)) FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 30) AS advisor FROM orders")
def j12_attach_first(spark, d):
    lists = table(spark, d, "lineitem").filter("l_quantity > 30").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))), lambda x: x["l_suppkey"]).alias("s"))
    return resolve.attach_first(table(spark, d, "orders").select("o_orderkey"), lists, "o_orderkey", "s")


@query("SELECT l_orderkey AS work, CAST(l_suppkey AS VARCHAR) AS author, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) AS INTEGER) AS position FROM lineitem QUALIFY l_suppkey % 2 = 0")
def j13_known_authors(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("work")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))), lambda x: x["l_suppkey"].cast("string")), "; ").alias("ids"))
    known = table(spark, d, "supplier").filter("s_suppkey % 2 = 0").select(F.col("s_suppkey").cast("string").alias("author"))
    return resolve.known_authors(rows, known, "work", "ids")


@query(f"SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed' WHEN a.o_totalprice IS DISTINCT FROM b.o_totalprice THEN 'changed' ELSE 'unchanged' END AS status, CASE WHEN a.o_totalprice <> b.o_totalprice THEN 'o_totalprice' ELSE '' END AS changed_fields FROM {PREVIOUS} a FULL JOIN {CURRENT} b ON a.o_orderkey = b.o_orderkey")
def j15_diff(spark, d):
    return snapshot.diff(*snapshots(spark, d), "o_orderkey").withColumn("changed_fields", F.array_join("changed_fields", ","))


@query("WITH m AS (SELECT l_suppkey AS author, CASE WHEN l_orderkey % 10 = 3 THEN l_orderkey - 1 ELSE l_orderkey END AS work, l_linenumber AS position, l_returnflag = 'R' AS c FROM lineitem) SELECT author, work, CAST(min(position) AS INTEGER) AS position, bool_or(c) AS corresponding FROM m WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = work AND o_orderkey % 10 <> 3) GROUP BY 1, 2")
def j16_remap_references(spark, d):
    edges = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("author"), F.col("l_orderkey").alias("work"), F.col("l_linenumber").alias("position"), (F.col("l_returnflag") == "R").alias("corresponding"))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    aliases = orders.select("id", F.when(F.col("id") % 10 == 3, F.col("id") - 1).otherwise(F.col("id")).alias("canonical"))
    return dedup.remap_references(edges, orders.filter("id % 10 <> 3"), aliases)


@query("SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, TRUE AS active FROM customer WHERE c_custkey % 3 > 0 UNION ALL SELECT c_custkey, NULL, c_mktsegment, FALSE FROM customer WHERE c_custkey % 3 = 0")
def j17_merge_roster(spark, d):
    c = table(spark, d, "customer")
    return resolve.merge_roster(c.filter("c_custkey % 3 > 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), c.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))).select("id", "name", "segment", "active")


@query("SELECT l_orderkey AS k, 'unknown' AS problem FROM lineitem WHERE l_orderkey % 7 = 0 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderkey % 2 = 0) GROUP BY 1 UNION ALL SELECT o_orderkey, 'missing' FROM orders WHERE o_orderkey % 2 = 0 AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_orderkey % 7 = 0)")
def j19_completeness(spark, d):
    staged = table(spark, d, "lineitem").filter("l_orderkey % 7 = 0").select(F.col("l_orderkey").alias("k"))
    return snapshot.completeness(staged, table(spark, d, "orders").filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("k")), "k")


@query("SELECT 'reference:l_partkey' AS rule, CAST(l_orderkey AS VARCHAR) AS key, CAST(l_partkey AS VARCHAR) AS message FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5) UNION ALL SELECT 'reference:l_suppkey', CAST(l_orderkey AS VARCHAR), CAST(l_suppkey AS VARCHAR) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def j20_referential_integrity(spark, d):
    rules = [("l_partkey", table(spark, d, "part").filter("p_size > 5"), "p_partkey"), ("l_suppkey", table(spark, d, "supplier").filter("s_acctbal > 0"), "s_suppkey")]
    return quality.referential_integrity(table(spark, d, "lineitem"), "l_orderkey", rules)


@query("SELECT coalesce(n.path, o.path) AS path, CASE WHEN n.path IS NULL THEN 'deleted' ELSE 'changed' END AS status FROM (SELECT url AS path, max(md5(html)) AS h FROM pages WHERE page_id % 9 > 0 GROUP BY 1) n FULL JOIN (SELECT url AS path, max(md5(CASE WHEN page_id % 5 = 0 THEN html || 'x' ELSE html END)) AS h FROM pages WHERE page_id % 8 > 0 GROUP BY 1) o ON o.path = n.path WHERE n.h IS DISTINCT FROM o.h")
def j23_manifest_diff(spark, d):
    p = table(spark, d, "pages")
    new = p.filter("page_id % 9 > 0").groupBy(F.col("url").alias("path")).agg(F.max(F.md5("html")).alias("hash"))
    old = p.filter("page_id % 8 > 0").groupBy(F.col("url").alias("path")).agg(F.max(F.md5(F.when(F.col("page_id") % 5 == 0, F.concat("html", F.lit("x"))).otherwise(F.col("html")))).alias("hash"))
    return snapshot.manifest_diff(old, new)


@query("SELECT c_custkey AS k FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 4 = 0)")
def j25_without_matches(spark, d):
    return resolve.without_matches(table(spark, d, "customer").select(F.col("c_custkey").alias("k")), table(spark, d, "orders").filter("o_orderkey % 4 = 0").select(F.col("o_custkey").alias("k")), "k")


@query("SELECT count(*) AS used FROM (SELECT DISTINCT upper(p_name) AS n FROM part WHERE p_size > 20) WHERE lower(n) IN (SELECT lower(p_name) FROM part WHERE p_size <= 30)")
def j26_aliases_used(spark, d):
    part = table(spark, d, "part")
    return resolve.aliases_used(part.filter("p_size > 20").select(F.upper("p_name").alias("name")).distinct(), part.filter("p_size <= 30").select(F.col("p_name").alias("name")))


@query("SELECT c_nationkey AS author, min(c_name) AS name, CAST(NULL AS VARCHAR) AS orcid, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS areas FROM customer WHERE c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'MACHINERY') GROUP BY 1")
def j27_author_roster(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("author"), F.col("c_name").alias("name"), F.lit(None).cast("string").alias("orcid"), F.array(F.when(F.col("c_mktsegment").isin("AUTOMOBILE", "BUILDING", "MACHINERY"), F.lit("Instituto de Aeronáutica")).otherwise(F.lit("Other"))).alias("affiliations"), F.array("c_mktsegment").alias("areas"))
    return resolve.author_roster([c.filter("author % 2 = 0"), c.filter("author % 2 = 1")], "AERONAUTICA").withColumn("areas", F.array_join("areas", ","))


def _works(spark, d):
    """Orders as works that share DOIs or titles."""
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k.cast("string").alias("id"), F.concat(F.lit("2-s2.0-"), k).alias("eid"), F.when(k % 4 == 0, F.concat(F.lit("https://doi.org/10.1/X"), (k / 40).cast("long"))).when(k % 4 == 1, F.lit("")).alias("doi"), F.when(k % 4 == 3, "o_orderpriority").otherwise(F.concat(F.lit("Título "), (k / 40).cast("long"))).alias("title"), F.when(k % 4 != 3, F.year("o_orderdate").cast("string")).alias("year"), F.col("o_orderstatus").alias("journal"), F.col("o_totalprice").cast("int").alias("citations"))


_DUP = "(SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'doi|10.1/x' || (o_orderkey // 40) WHEN o_orderkey % 4 = 3 THEN 'eid|2-s2.0-' || o_orderkey ELSE 'tyj|' || (o_orderkey // 40) || '|' || year(o_orderdate) || '|' || o_orderstatus END AS key, CAST(trunc(o_totalprice) AS INTEGER) AS citations, o_orderstatus AS journal FROM orders)"


@query(f"SELECT id, min(id) OVER (PARTITION BY key) AS canonical FROM {_DUP}")
def d2_deduplicate(spark, d):
    return dedup.deduplicate(_works(spark, d))[1]


@query(f"SELECT id FROM {_DUP} QUALIFY id = min(id) OVER (PARTITION BY key)")
def d2_survivors(spark, d):
    return dedup.deduplicate(_works(spark, d))[0].select("id")


@query(f"SELECT min(id) AS id, max(citations) AS citations, min_by(journal, id) AS journal, count(*) AS members FROM {_DUP} GROUP BY key")
def d3_merge_duplicates(spark, d):
    w = _works(spark, d)
    return dedup.merge_duplicates(w, dedup.deduplicate(w)[1], ["journal"], maxima=["citations"]).select("id", "citations", "journal", "members")


@query(f"SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CAST(CASE WHEN b.o_orderkey IS NULL THEN a.o_totalprice ELSE b.o_totalprice END AS DOUBLE) AS o_totalprice, CASE WHEN b.o_orderkey % 3 > 0 THEN b.o_orderstatus ELSE coalesce(a.o_orderstatus, CASE WHEN b.o_orderkey % 3 = 0 THEN '' END) END AS o_orderstatus FROM {PREVIOUS} a FULL JOIN {CURRENT} b ON a.o_orderkey = b.o_orderkey")
def d4_merge_same_id(spark, d):
    old, new = snapshots(spark, d)
    new = new.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderstatus")).otherwise(""))
    got = dedup.merge_same_id(old, new, "o_orderkey", ["o_totalprice"], ["o_orderstatus"])
    return got.withColumn("o_totalprice", F.col("o_totalprice").cast("double")).withColumn("o_orderstatus", F.when(F.col("o_orderstatus").isNull() & (F.col("o_orderkey") % 3 == 0), "").otherwise(F.col("o_orderstatus")))


@query("WITH e AS (SELECT l_orderkey AS work, l_suppkey % 10 AS s, min(l_linenumber) AS seq, arg_max(l_returnflag, (l_linenumber, l_returnflag)) FILTER (l_returnflag <> 'N') AS p FROM lineitem GROUP BY 1, 2) SELECT work, string_agg(CAST(s AS VARCHAR) || ':' || coalesce(p, ''), ',' ORDER BY seq, s) AS authors, coalesce(string_agg(DISTINCT p, ',' ORDER BY p), '') AS people FROM e GROUP BY 1")
def d5_merge_authors(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("work"), F.col("l_linenumber").alias("seq"), (F.col("l_suppkey") % 10).alias("source_id"), F.lit("n").alias("name"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).otherwise("").alias("person"))
    return dedup.merge_authors(rows).select("work", F.array_join(F.transform("authors", lambda a: F.concat(a["source_id"], F.lit(":"), F.coalesce(a["person"], F.lit("")))), ",").alias("authors"), F.array_join("people", ",").alias("people"))


@query("SELECT l_partkey AS work, min_by(l_orderkey, l_orderkey * 10 + l_linenumber) AS o, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS people FROM lineitem GROUP BY 1")
def d6_dedup_first(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("work"), F.col("l_orderkey").alias("o"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.col("l_returnflag").alias("person"))
    return dedup.dedup_first(rows, "work", "pos", "person").select("work", "o", F.array_join("people", ",").alias("people"))


@query(f"SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS o_totalprice FROM {PREVIOUS} WHERE o_orderkey NOT IN (SELECT o_orderkey FROM {CURRENT}) UNION ALL SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) FROM {CURRENT}")
def u6_upsert(spark, d):
    return snapshot.upsert(*snapshots(spark, d), "o_orderkey", update_existing=True).select("o_orderkey", F.col("o_totalprice").cast("double").alias("o_totalprice"))


@query(f"SELECT o_orderkey, o_custkey, CAST(o_totalprice AS DOUBLE) AS o_totalprice FROM {PREVIOUS} WHERE o_custkey % 5 <> 0 UNION ALL SELECT o_orderkey, o_custkey, CAST(o_totalprice AS DOUBLE) FROM {CURRENT} WHERE o_custkey % 5 = 0")
def u7_replace_processed(spark, d):
    old, new = snapshots(spark, d)
    keys = table(spark, d, "orders").filter("o_custkey % 5 = 0").select("o_custkey").distinct()
    return snapshot.replace_processed(old, new.join(keys, "o_custkey", "left_semi").select(*old.columns), keys, "o_custkey").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("double").alias("o_totalprice"))


@query(f"SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS o_totalprice FROM {PREVIOUS} UNION ALL SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) FROM {CURRENT} WHERE o_orderkey NOT IN (SELECT o_orderkey FROM {PREVIOUS})")
def u8_add_only(spark, d):
    return snapshot.add_only(*snapshots(spark, d), "o_orderkey").select("o_orderkey", F.col("o_totalprice").cast("double").alias("o_totalprice"))


@query("SELECT * FROM (SELECT o_custkey, count(*) FILTER (o_orderkey % 3 > 0) AS old_n, count(*) FILTER (o_orderkey % 2 = 0) AS new_n FROM orders GROUP BY 1) WHERE old_n > 0 AND new_n < 0.8 * old_n")
def q2_gate_per_key(spark, d):
    o = table(spark, d, "orders")
    return snapshot.gate_per_key(o.filter("o_orderkey % 3 > 0"), o.filter("o_orderkey % 2 = 0"), "o_custkey")


@query("SELECT 'enum:o_orderstatus' AS rule, CAST(o_orderkey AS VARCHAR) AS key, o_orderstatus AS message FROM orders WHERE o_orderstatus NOT IN ('F', 'O') UNION ALL SELECT 'pattern:o_orderpriority', CAST(o_orderkey AS VARCHAR), o_orderpriority FROM orders WHERE NOT regexp_matches(o_orderpriority, '^[1-3]-') UNION ALL SELECT 'minimum:o_custkey', CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR) FROM orders WHERE o_custkey < 10 UNION ALL SELECT 'when:finished', CAST(o_orderkey AS VARCHAR), 'finished' FROM orders WHERE o_orderstatus = 'F' AND NOT o_totalprice > 1000")
def q4_validate_schema(spark, d):
    rules = quality.Rules(key="o_orderkey", required=["o_custkey"], enums={"o_orderstatus": ["F", "O"]}, patterns={"o_orderpriority": "^[1-3]-"}, bounds={"o_custkey": (10, None)}, when=[("finished", F.col("o_orderstatus") == "F", F.col("o_totalprice") > 1000)])
    return quality.validate_schema(table(spark, d, "orders"), rules)


@query("SELECT 'unique:l_orderkey,l_suppkey' AS rule, l_orderkey || '|' || l_suppkey AS key, CAST(count(*) AS VARCHAR) AS message FROM lineitem GROUP BY l_orderkey, l_suppkey HAVING count(*) > 1")
def q5_unique(spark, d):
    return quality.unique(table(spark, d, "lineitem"), ["l_orderkey", "l_suppkey"])


@query("SELECT 'link:u' AS rule, CAST(page_id AS VARCHAR) AS key, 'ftp' || url AS message FROM pages WHERE page_id % 4 = 0")
def h9_scan_schemes(spark, d):
    u = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("ftp"), "url")).otherwise(F.col("url"))
    return quality.scan_schemes(table(spark, d, "pages").withColumn("u", u), "page_id", ["url"], ["u"])


@query("SELECT c_custkey AS k FROM customer WHERE c_custkey % 4 > 0 AND c_custkey % 6 = 0")
def q13_deactivated(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    return snapshot.deactivated(c.withColumn("active", F.col("k") % 4 > 0), c.withColumn("active", F.col("k") % 6 != 0), "k")


@query(f"SELECT status, count(*) AS n, greatest(0, count(*) - 100) AS omitted FROM (SELECT CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed' WHEN a.o_totalprice <> b.o_totalprice THEN 'changed' ELSE 'unchanged' END AS status FROM {PREVIOUS} a FULL JOIN {CURRENT} b ON a.o_orderkey = b.o_orderkey) GROUP BY 1")
def q15_report(spark, d):
    return snapshot.report(snapshot.diff(*snapshots(spark, d), "o_orderkey"), "o_orderkey").select("status", "n", "omitted")


@query(f"WITH RECURSIVE t AS (SELECT id, parent AS want, CAST(id AS VARCHAR) AS path, 0 AS depth FROM {NODES} UNION ALL SELECT t.id, n.parent, t.path || '/' || n.id, t.depth + 1 FROM t JOIN {NODES} n ON n.id = t.want) SELECT id, path, depth, false AS is_cycle, false AS dangling FROM t WHERE want IS NULL")
def t1_ancestors(spark, d):
    return _way(tree.ancestors(nodes(spark, d)))


def _way(found):
    return found.withColumn("path", F.array_join(F.transform("path", lambda x: x.cast("string")), "/"))


#: Chains of 150 customers: the first of a chain is a root, or goes on from the last (a cycle), or names a parent that isn't there.
_CHAINS = "(SELECT c_custkey AS id, CASE WHEN c_custkey % 150 > 0 THEN c_custkey - 1 WHEN c_custkey // 150 % 3 = 1 THEN c_custkey + 149 WHEN c_custkey // 150 % 3 = 2 THEN -1 - c_custkey END AS parent, c_custkey % 7 AS position FROM customer)"


def _chains(spark, d):
    k = F.col("c_custkey")
    turn = F.expr("c_custkey div 150") % 3
    parent = F.when(k % 150 > 0, k - 1).when(turn == 1, k + 149).when(turn == 2, -1 - k)
    return table(spark, d, "customer").select(k.alias("id"), parent.alias("parent"), (k % 7).alias("position"))


@query(f"WITH RECURSIVE n AS {_CHAINS}, t AS (SELECT id, parent AS want, [id] AS path FROM n UNION ALL SELECT t.id, n.parent, list_append(path, n.id) FROM t JOIN n ON n.id = t.want WHERE NOT list_contains(path, n.id)) SELECT id, array_to_string(path, '/') AS path, CAST(len(path) - 1 AS INTEGER) AS depth, coalesce(list_contains(path, want), false) AS is_cycle, coalesce(want NOT IN (SELECT id FROM n), false) AS dangling FROM t WHERE want IS NULL OR list_contains(path, want) OR want NOT IN (SELECT id FROM n)")
def t1_ancestors_of_chains(spark, d):
    """Deep chains, cycles and parents that aren't there."""
    return _way(tree.ancestors(_chains(spark, d)))


@query(f"WITH RECURSIVE t AS (SELECT id, parent, 0 AS depth, position || ':' || id AS sort_path FROM {NODES} WHERE id = 0 AND visible UNION ALL SELECT n.id, n.parent, t.depth + 1, t.sort_path || '/' || n.position || ':' || n.id FROM t JOIN {NODES} n ON n.parent = t.id WHERE n.visible) SELECT id, parent, depth, sort_path FROM t")
def t2_subtree(spark, d):
    return _sorted(tree.subtree(nodes(spark, d), 0, F.col("visible")))


def _sorted(found):
    return found.withColumn("sort_path", F.array_join(F.transform("sort_path", lambda x: F.concat_ws(":", x["p"], x["i"])), "/"))


@query(f"WITH RECURSIVE n AS {_CHAINS}, t AS (SELECT id, parent, 0 AS depth, position || ':' || id AS sort_path FROM n WHERE id = 2 UNION ALL SELECT n.id, n.parent, t.depth + 1, t.sort_path || '/' || n.position || ':' || n.id FROM t JOIN n ON n.parent = t.id) SELECT id, parent, depth, sort_path FROM t")
def t2_subtree_of_chains(spark, d):
    return _sorted(tree.subtree(_chains(spark, d), 2))


@query(f"WITH RECURSIVE t AS (SELECT id, parent FROM {NODES} WHERE id % 37 = 5 UNION SELECT n.id, n.parent FROM t JOIN {NODES} n ON n.id = t.parent) SELECT DISTINCT id FROM t")
def t3_active_path(spark, d):
    n = nodes(spark, d)
    return tree.active_path(n, n.filter("id % 37 = 5"))


@query(f"SELECT n.id, p.label AS parent_label, NOT EXISTS (SELECT 1 FROM {NODES} k WHERE k.parent = n.id) AND n.id % 5 <> 0 AS removable FROM {NODES} n LEFT JOIN {NODES} p ON p.id = n.parent")
def t4_removable(spark, d):
    return tree.removable(nodes(spark, d), F.col("id") % 5 == 0)


@query(f"SELECT CASE WHEN a.o_orderkey IS NULL THEN 'create' WHEN b.o_orderkey IS NULL THEN 'delete' ELSE 'update' END AS action, coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey FROM {PREVIOUS} a FULL JOIN {CURRENT} b ON a.o_orderkey = b.o_orderkey WHERE a.o_totalprice IS DISTINCT FROM b.o_totalprice")
def k6_preview(spark, d):
    return sources.preview(*snapshots(spark, d), "o_orderkey")


@query("SELECT count(*) AS records, CAST(max(o_orderdate) AS VARCHAR) AS updated, count(*) FILTER (o_orderstatus = 'F') AS finished FROM orders")
def k5_manifest(spark, d):
    got = snapshot.build_manifest(table(spark, d, "orders"), {"finished": F.col("o_orderstatus") == "F"}, "o_orderdate")
    return got.select("records", F.col("updated").cast("string").alias("updated"), F.col("counts")["finished"].alias("finished"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def p16_overlay(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return snapshot.overlay(o, o.filter("o_orderkey % 3 = 0").withColumn("o_orderstatus", F.lit("")), "o_orderkey")


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey % 2 = 0 THEN 'c_mktsegment' ELSE '' END AS changes FROM customer")
def p24_enrich_missing(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    patch = c.filter("c_custkey % 2 = 0").select("c_custkey", F.lit("ignored").alias("c_name"), F.lit("NEW").alias("c_mktsegment"))
    return snapshot.enrich_missing(c, patch, "c_custkey", {"c_name": "if_absent", "c_mktsegment": "replace"}).select("c_custkey", "c_mktsegment", F.array_join("changes", ",").alias("changes"))
