"""Queries of text functions, pages, scans and search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from biblio.functions import names, text
from biblio.functions.flatten import flatten_json
from biblio.operators import classify, pages, search, textindex

from .base import query, scratch, table

# ASCII forms in SQL: compatibility forms beyond accents do not occur in these tables.
_ASCII = r"regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g')"


def _fold(name: str, mode: str, sql: str):
    def f(spark, d):
        return table(spark, d, "documents").select("doc_id", F.md5(text.fold(F.col("text"), mode)).alias("folded"))

    f.__name__ = name
    query(f"SELECT doc_id, md5({sql}) AS folded FROM documents")(f)


_fold("f1_library_name", "library_name", rf"trim(regexp_replace(replace(lower({_ASCII}), '-', ' '), '[\s\x0B]+', ' ', 'g'), ' ')")
_fold("f2_validate_name", "validate_name", rf"trim(regexp_replace(lower({_ASCII}), '[\s\x0B]+', ' ', 'g'), ' ')")
_fold("f3_work_text", "work_text", rf"trim(regexp_replace(lower({_ASCII}), '[^a-z0-9]+', ' ', 'g'), ' ')")
_fold("f4_author_name", "author_name", rf"trim(regexp_replace(regexp_replace(lower({_ASCII}), '[^\w\s\x0B]', '', 'g'), '[\s\x0B]+', ' ', 'g'), ' ')")


# fixed values: characters beyond Latin and what their decomposition without marks is
_OTHERS = [("ά", "α"), ("Έ", "ε"), ("й", "и"), ("Ї", "і"), ("ё", "е"), ("が", "か"), ("ｶ", "カ"), ("①", "1"), ("㎏", "kg"), ("ﬁ", "fi"), ("Ｑ", "q"), ("½", "1⁄2"), ("Å", "a")]


@query("SELECT doc_id, md5(lower(strip_accents(text)) || ' ' || CASE " + " ".join(f"WHEN doc_id % {len(_OTHERS)} = {i} THEN '{b}'" for i, (_, b) in enumerate(_OTHERS)) + " END) AS folded FROM documents")
def f5_combining(spark, d):
    other = F.element_at(F.array(*(F.lit(a) for a, _ in _OTHERS)), (F.col("doc_id") % len(_OTHERS) + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", F.md5(text.fold(F.concat("text", F.lit(" "), other), "combining")).alias("folded"))


_fold("f6_lower_punct", "lower_punct", r"trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{M}\p{Nd}_\s\x0B]', ' ', 'g'), '[\s\x0B]+', ' ', 'g'), ' ')")
_fold("f7_alias_key", "alias_key", r"trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '[\s\x0B]+', ' ', 'g'), ' ')")
_fold("f8_token_norm", "token_norm", rf"trim(lower({_ASCII}), ' ')")


@query(r"SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(doi)), '^https?://(dx\.)?doi\.org/', ''), '[. ]+$', '') AS doi FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN ' HTTPS://doi.org/10.1/' || p_brand || '. ' WHEN 1 THEN 'http://dx.doi.org/10.2/' || p_brand ELSE p_brand END AS doi FROM part)")
def f9_normalize_doi(spark, d):
    k = F.col("p_partkey") % 3
    raw = F.when(k == 0, F.concat(F.lit(" HTTPS://doi.org/10.1/"), "p_brand", F.lit(". "))).when(k == 1, F.concat(F.lit("http://dx.doi.org/10.2/"), "p_brand")).otherwise(F.col("p_brand"))
    return table(spark, d, "part").select("p_partkey", text.normalize_doi(raw).alias("doi"))


@query(r"SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def f12_slug(spark, d):
    return table(spark, d, "part").select("p_partkey", text.slug(F.col("p_name")).alias("slug"))


@query("WITH t AS (SELECT p_partkey, list_distinct(string_split(lower(p_name), ' ')) AS a, list_distinct(string_split(lower(p_type), ' ')) AS b FROM part) SELECT p_partkey, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS similarity FROM t")
def f13_token_jaccard(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(text.token_jaccard(F.col("p_name"), F.col("p_type")), 6).alias("similarity"))


@query(r"SELECT doc_id, TRY_CAST(nullif(regexp_extract(text, '(\d+)', 1), '') AS BIGINT) AS number FROM documents")
def f22_first_digits(spark, d):
    return table(spark, d, "documents").select("doc_id", text.extract_int(F.col("text")).alias("number"))


@query("SELECT page_id, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page, nullif(regexp_extract(url, '[?&]ref=([^&#]*)', 1), '') AS ref FROM pages")
def p23_query_param(spark, d):
    return table(spark, d, "pages").select("page_id", text.query_param(F.col("url"), "page").alias("page"), text.query_param(F.col("url"), "ref").alias("ref"))


@query("SELECT event_id, '$.' || k AS path, json_extract_string(props, '$.' || k) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events) UNION ALL SELECT event_id, '$.list[' || i || '].kind', event_type FROM (SELECT event_id, event_type, unnest(range(event_id % 3)) AS i FROM events) UNION ALL SELECT event_id, '$.user', CAST(user_id AS VARCHAR) FROM events")
def f29_flatten_json(spark, d):
    more = F.to_json(F.struct(F.transform(F.filter(F.array(F.lit(0), F.lit(1)), lambda i: i < F.col("event_id") % 3), lambda i: F.struct(F.col("event_type").alias("kind"))).alias("list"), F.col("user_id").alias("user")))
    whole = F.concat(F.regexp_replace("props", r"\}\s*$", ", "), F.substring(more, 2, 1 << 20))
    return flatten_json(table(spark, d, "events").select("event_id", whole.alias("props")), "event_id", "props")


@query("SELECT o_orderkey, CAST(regexp_matches(id, '^[a-z0-9]+(-[a-z0-9]+)*$') AS BOOLEAN) AS ok FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'w-' || o_orderkey ELSE 'W_' || o_orderkey END AS id FROM orders)")
def f30_id_pattern(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", text.id_valid(F.when(k % 2 == 0, F.concat(F.lit("w-"), k)).otherwise(F.concat(F.lit("W_"), k))).alias("ok"))


@query("SELECT doc_id, substr(text, 1, 200) AS t, CASE WHEN text LIKE '%Mestrado%' THEN 'M' ELSE 'D' END AS c, array_to_string((string_split(source || ' a b c', ' '))[1:3], ',') AS ad FROM documents")
def p1_compact_index(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("title"), F.col("source").alias("author"), F.lit("2000").alias("year"), F.col("text").alias("course"), F.split(F.concat("source", F.lit(" a b c")), " ").alias("advisors"), F.array(F.lit(None).cast("string")).alias("advisor_ids"), F.array("lang").alias("keywords"))
    return search.compact_index(docs).select(F.col("id").alias("doc_id"), "t", "c", F.array_join("ad", ",").alias("ad"))


@query("SELECT doc_id FROM documents WHERE contains(lower(strip_accents(text)), 'ereal') AND lang = 'en'")
def p9_faceted_search(spark, d):
    return search.faceted_search(table(spark, d, "documents"), "ÉREAL", ["text"], {"lang": "en", "source": ""}).select("doc_id")


@query("SELECT query, doc_id FROM documents JOIN (VALUES ('ÉREAL'), ('thation'), ('à'), ('none of these')) q(query) ON contains(lower(strip_accents(text)), lower(strip_accents(query)))")
def p9_text_index(spark, d):
    """Several queries of one written index."""
    folder = scratch(spark)
    textindex.build(table(spark, d, "documents"), "doc_id", ["text"], folder)
    found = [textindex.find(spark, folder, q).select(F.lit(q).alias("query"), F.col("id").alias("doc_id")) for q in ("ÉREAL", "thation", "à", "none of these")]
    return reduce(lambda a, b: a.unionByName(b), found)


@query("SELECT DISTINCT source FROM documents WHERE coalesce(source, '') <> ''")
def p10_facet_values(spark, d):
    return search.facet_values(table(spark, d, "documents"), "source")


@query("SELECT doc_id FROM documents WHERE lang IN ('fr', 'de')")
def p11_allow(spark, d):
    return search.allow(table(spark, d, "documents"), "lang", ["fr", "de"]).select("doc_id")


@query("SELECT o_orderkey FROM orders WHERE year(o_orderdate) BETWEEN 1994 AND 1998")
def p12_works_in_period(spark, d):
    return search.works_in_period(table(spark, d, "orders").withColumn("year", F.year("o_orderdate")), "last5", 1998).select("o_orderkey")


@query("SELECT p_partkey, CASE WHEN lower(p_type) LIKE '%conference%' OR lower(p_type) LIKE '%proceeding%' THEN 'conference' WHEN lower(p_type) LIKE '%review%' THEN 'review' WHEN lower(p_type) LIKE '%book%' OR lower(p_type) LIKE '%chapter%' THEN 'book' ELSE 'article' END AS kind FROM part")
def p15_classify_type(spark, d):
    return table(spark, d, "part").select("p_partkey", search.classify_type(F.col("p_type")).alias("kind"))


@query("SELECT trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')) AS title, url, regexp_extract(html, '(?i)<html[^>]*\\blang=\"([^\"]*)\"', 1) AS language, string_split(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*/?', ''), '/')[1] AS section FROM pages".replace("\\\\", "\\"))
def p17_search_index(spark, d):
    return search.search_index(table(spark, d, "pages"))


@query("SELECT event_type, age_days, CASE WHEN age_days <= 30 THEN 'ok' WHEN age_days <= 60 THEN 'warn' ELSE 'old' END AS state FROM (SELECT event_type, greatest(0, CAST(floor((epoch(TIMESTAMP '2024-03-01') - epoch(date_trunc('second', max(ts)))) / 86400) AS BIGINT)) AS age_days FROM events GROUP BY 1)")
def p18_freshness(spark, d):
    return search.freshness(table(spark, d, "events"), "event_type", "ts", 30, "2024-03-01")


@query("SELECT c_custkey, c_mktsegment LIKE 'A%' OR c_mktsegment LIKE 'B%' AS fellow, CASE WHEN c_mktsegment LIKE 'A%' OR c_mktsegment LIKE 'B%' THEN c_mktsegment END AS level FROM customer")
def p21_fellowship(spark, d):
    raw = F.when(F.col("c_mktsegment").rlike("^[AB]"), F.concat(F.lit("Sim - "), "c_mktsegment")).otherwise(F.lit("Não"))
    return search.fellowship(table(spark, d, "customer").withColumn("f", raw), "f").select("c_custkey", "fellow", "level")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN w / h > 1.1 THEN 'landscape' WHEN w / h < 0.9 THEN 'portrait' ELSE 'square' END AS orientation FROM (SELECT *, l_quantity * 20 AS w, 500.0 AS h FROM lineitem)")
def p22_classify_dimensions(spark, d):
    rows = table(spark, d, "lineitem").withColumns({"width": F.col("l_quantity") * 20, "height": F.lit(500.0)})
    return search.classify_dimensions(rows).select("l_orderkey", "l_linenumber", "orientation")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE regexp_matches(c_mktsegment, '^[A-F]') AND c_acctbal > 0")
def p29_apply_view(spark, d):
    rows = table(spark, d, "customer").withColumn("positive", F.col("c_acctbal") > 0)
    return search.apply_view(rows, {"c_mktsegment": "^[A-F]"}, {"positive": True}, ["c_mktsegment"], "c_custkey", ["c_custkey"]).select("c_custkey", "c_mktsegment")


RULES = [
    {"topic": "alpha", "keywords": ["erent"], "title_terms": ["thation"], "exclusions": ["!!"]},
    {"topic": "beta", "keywords": [], "title_terms": ["ungheit", "Élle"], "exclusions": []},
    {"topic": "none", "keywords": ["zzzzqq"], "title_terms": [], "exclusions": []},
]
_F = "lower(strip_accents(text))"


@query(f"WITH t AS (SELECT doc_id, {_F} AS f, lower(strip_accents(source)) || ' ' || {_F} AS b FROM documents), h AS (SELECT 'alpha' AS topic, doc_id FROM t WHERE (contains(f, 'erent') OR contains(b, 'thation')) AND NOT contains(b, '!!') UNION ALL SELECT 'beta', doc_id FROM t WHERE contains(b, 'ungheit') OR contains(b, 'elle')) SELECT l.topic, doc_id FROM (VALUES ('alpha'), ('beta'), ('none')) l(topic) LEFT JOIN h ON h.topic = l.topic")
def j9_classify(spark, d):
    return classify.classify(table(spark, d, "documents"), RULES, "doc_id", "source", "text")


@query("WITH t AS (SELECT doc_id, lower(strip_accents(source || ' ' || text)) AS t, lang, source FROM documents) SELECT 'alpha' AS topic, doc_id FROM t WHERE lang = 'fr' OR contains(t, 'thation') UNION ALL SELECT 'beta', doc_id FROM t WHERE contains(t, 'ungheit') OR (lang = 'en' AND source = 'src3')")
def j10_classify_works(spark, d):
    rules = [{"topic": "alpha", "keywords": ["fr"], "title_terms": ["Thation"]}, {"topic": "beta", "title_terms": ["ungheit"], "areas": ["src3"]}]
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("title"), F.col("text").alias("abstract"), F.when(F.col("lang") == "en", F.array().cast("array<string>")).otherwise(F.array("lang")).alias("keywords"), F.array("source").alias("areas"))
    return classify.classify_works(docs, rules, "doc_id")


_HREF = """unnest(regexp_extract_all(html, '(?is)<[a-z][^>]*>')) AS tag"""


@query(f"""SELECT page, attr, value FROM (SELECT page_id AS page, 'href' AS attr, regexp_extract(tag, '(?is)\\shref\\s*=\\s*"([^"]*)"', 1) AS value FROM (SELECT page_id, {_HREF} FROM pages) WHERE regexp_matches(tag, '(?is)\\shref\\s*=') UNION ALL SELECT page_id, 'src', regexp_extract(tag, '(?is)\\ssrc\\s*=\\s*"([^"]*)"', 1) FROM (SELECT page_id, {_HREF} FROM pages) WHERE regexp_matches(tag, '(?is)\\ssrc\\s*='))""")
def h3_references(spark, d):
    return pages.extract_references(table(spark, d, "pages")).drop("pos")


@query(r"""WITH d AS (SELECT doc_id, text || CASE WHEN doc_id % 7 = 0 THEN chr(10) || 'api_key = "' || md5(text) || '"' || chr(10) || 'AUTH-TOKEN: "' || md5(lang) || '"' WHEN doc_id % 7 = 1 THEN ' ghp_' || md5(text) WHEN doc_id % 7 = 2 THEN ' AKIA' || substr(upper(md5(text)), 1, 16) || ' ' WHEN doc_id % 7 = 3 THEN ' -----BEGIN RSA PRIVATE KEY-----' WHEN doc_id % 7 = 4 THEN ' api_key = "short"' ELSE '' END AS text FROM documents) SELECT doc_id, label, CAST(count(*) AS BIGINT) AS n FROM (SELECT doc_id, 'literal secret' AS label, unnest(regexp_extract_all(text, '(?i)\b(?:api[_-]?key|client[_-]?secret|access[_-]?token|auth[_-]?token)\s*[:=]\s*[''"][A-Za-z0-9_./+=-]{16,}[''"]')) AS hit FROM d UNION ALL SELECT doc_id, 'cloud access key', unnest(regexp_extract_all(text, '\b(?:AKIA|ASIA)[A-Z0-9]{16}\b')) FROM d UNION ALL SELECT doc_id, 'hosting token', unnest(regexp_extract_all(text, '\b(?:gh[pousr]_[A-Za-z0-9_]{20,}|github_pat_[A-Za-z0-9_]{20,})\b')) FROM d UNION ALL SELECT doc_id, 'private key', unnest(regexp_extract_all(text, '-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----')) FROM d) GROUP BY 1, 2""")
def h7_scan_secrets(spark, d):
    k = F.col("doc_id") % 7
    made = (
        F.when(k == 0, F.concat(F.lit('\napi_key = "'), F.md5("text"), F.lit('"\nAUTH-TOKEN: "'), F.md5("lang"), F.lit('"')))
        .when(k == 1, F.concat(F.lit(" ghp_"), F.md5("text")))
        .when(k == 2, F.concat(F.lit(" AKIA"), F.substring(F.upper(F.md5("text")), 1, 16), F.lit(" ")))
        .when(k == 3, " -----BEGIN RSA PRIVATE KEY-----")
        .when(k == 4, ' api_key = "short"')
        .otherwise("")
    )
    docs = table(spark, d, "documents").select("doc_id", F.concat("text", made).alias("text"))
    return pages.scan_secrets(docs, "doc_id", "text").groupBy("doc_id", "label").agg(F.count(F.lit(1)).alias("n"))


@query(r"""SELECT page_id, label, CAST(count(*) AS BIGINT) AS n FROM (SELECT page_id, 'script tag' AS label, unnest(regexp_extract_all(html, '(?i)<\s*script\b')) AS hit FROM pages UNION ALL SELECT page_id, 'event handler', unnest(regexp_extract_all(html, '(?i)\bon[a-z]+\s*=')) FROM pages UNION ALL SELECT page_id, 'script protocol', unnest(regexp_extract_all(html, '(?i)javascript\s*:')) FROM pages UNION ALL SELECT page_id, 'embedded content', unnest(regexp_extract_all(html, '(?i)<\s*(?:iframe|object|embed)\b')) FROM pages UNION ALL SELECT page_id, 'html data url', unnest(regexp_extract_all(html, '(?i)data\s*:\s*text/html')) FROM pages) GROUP BY 1, 2""")
def h8_scan_unsafe(spark, d):
    return pages.scan_unsafe(table(spark, d, "pages"), "page_id", "html").groupBy("page_id", "label").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT page_id AS page FROM pages WHERE page_id % 3 > 0 AND page_id % 5 > 0 AND lower(html) LIKE '%<h1%'")
def p8_published_pages(spark, d):
    k = F.col("page_id")
    rows = table(spark, d, "pages").select(k.alias("page"), ((k % 3 > 0) & F.lower("html").contains("<h1")).alias("published"), F.when(k % 5 > 0, "page").otherwise("group").alias("kind"))
    return search.published_pages(rows).select("page")


_TAGS = "(SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<[a-z][^>]*>')) AS tag FROM pages)"
_LINKS = f"""SELECT page_id AS page, url, regexp_extract(tag, '(?is)\\shref\\s*=\\s*"([^"]*)"', 1) AS value FROM {_TAGS} WHERE regexp_matches(tag, '(?is)\\shref\\s*=') UNION ALL SELECT page_id, url, regexp_extract(tag, '(?is)\\ssrc\\s*=\\s*"([^"]*)"', 1) FROM {_TAGS} WHERE regexp_matches(tag, '(?is)\\ssrc\\s*=')"""


# links in these tables are whole addresses, begin with / or #, or are relative
@query(rf"""WITH l AS (SELECT page, value, 'http://site.example' || regexp_replace(url, '^[a-z]+://[^/]*', '') AS url FROM ({_LINKS})),
w AS (SELECT page, value, CASE WHEN regexp_matches(value, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN value WHEN value LIKE '//%' THEN 'http:' || value WHEN value LIKE '/%' THEN 'http://site.example' || value WHEN value LIKE '?%' THEN regexp_replace(url, '[?#].*$', '') || value WHEN value = '' THEN url ELSE regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '') || regexp_replace(value, '^(\./)+', '') END AS whole FROM l WHERE NOT regexp_matches(value, '(?i)^(?:mailto|tel|data|javascript):|^#')),
p AS (SELECT page, value, regexp_replace(regexp_replace(whole, '[?#].*$', ''), '^http://site\.example/?', '') AS path FROM w WHERE regexp_matches(whole, '^http://site\.example([/?#]|$)')),
t AS (SELECT page, value, CASE WHEN path = '' OR path LIKE '%/' THEN path || 'index.html' WHEN regexp_extract(path, '([^/]*)$', 1) LIKE '%.%' THEN path ELSE path || '/index.html' END AS target FROM p)
SELECT page, value, target FROM t WHERE target NOT IN ('The/index.html', 'and/index.html')""")
def j21_check_links(spark, d):
    every = table(spark, d, "pages")
    targets = spark.createDataFrame([("The/index.html",), ("and/index.html",)], "path string")
    host = F.regexp_replace("url", r"^[a-z]+://[^/]*", "http://site.example")
    return pages.check_links(every.withColumn("url", host), targets, "http://site.example/")


@query("SELECT page_id AS page, unnest(list_distinct(regexp_extract_all(html, '(?i)\\sclass\\s*=\\s*[\"'']([^\"'']*)[\"'']', 1))) AS id FROM pages".replace("\\\\", "\\"))
def j22_marker_values(spark, d):
    return pages.marker_values(table(spark, d, "pages"), "class")


@query(r"""WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS pos, trim(unnest(string_split(text, chr(10))), ' ') AS line FROM documents),
m AS (SELECT doc_id, pos, line, regexp_matches(line, '^.{1,40}$') AS head, regexp_matches(line, '^.*? \| ') AS listed FROM l WHERE NOT regexp_matches(line, '^\d+$')),
f AS (SELECT *, CAST(sum(CASE WHEN head THEN 1 ELSE 0 END) OVER w AS BIGINT) AS block, last_value(CASE WHEN listed THEN 'list' WHEN head OR regexp_matches(line, '^\s*$') THEN '' END IGNORE NULLS) OVER w AS field, trim(CASE WHEN listed THEN regexp_replace(line, '^.*? \| ', '') ELSE line END, ' ') AS rest FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING))
SELECT doc_id, block, field, string_agg(rest, ' ' ORDER BY pos) AS value FROM f WHERE block > 0 AND field <> '' AND rest <> '' GROUP BY 1, 2, 3""")
def h6_extract_blocks(spark, d):
    """Documents as report texts: a short line opens a block, lines with a bar are a field."""
    return pages.extract_blocks(table(spark, d, "documents"), "doc_id", "text", r"^.{1,40}$", {"list": r"^.*? \| "}, r"^\s*$")


@query("SELECT c_custkey, CASE WHEN a = '' OR b = '' THEN 0.0 WHEN a = b THEN 1.0 WHEN contains(a, b) OR contains(b, a) THEN 0.9 WHEN list_last(string_split(a, ' ')) = list_last(string_split(b, ' ')) THEN CASE WHEN substr(a, 1, 1) = substr(b, 1, 1) THEN 0.7 + 0.2 ELSE 0.7 END ELSE round(len(list_intersect(list_distinct(string_split(a, ' ')), list_distinct(string_split(b, ' ')))) / greatest(len(string_split(a, ' ')), len(string_split(b, ' '))), 6) END AS score FROM (SELECT c_custkey, trim(regexp_replace(regexp_replace(lower(p.p_name), '[^a-z0-9_ ]', '', 'g'), ' +', ' ', 'g')) AS a, trim(regexp_replace(regexp_replace(lower(q.p_name), '[^a-z0-9_ ]', '', 'g'), ' +', ' ', 'g')) AS b FROM customer JOIN part p ON p.p_partkey = c_custkey % (SELECT count(*) FROM part) JOIN part q ON q.p_partkey = c_custkey * 7 % (SELECT count(*) FROM part))")
def f14_author_name_similarity(spark, d):
    part = table(spark, d, "part").select("p_partkey", text.fold(F.col("p_name"), "author_name").alias("n"))
    k, n = F.col("c_custkey"), part.count()
    rows = table(spark, d, "customer").select("c_custkey", (k % n).alias("x"), (k * 7 % n).alias("y"))
    both = rows.join(part.toDF("x", "a"), "x").join(part.toDF("y", "b"), "y")
    return both.select("c_custkey", F.round(names.author_name_similarity(F.col("a"), F.col("b")), 6).alias("score"))
