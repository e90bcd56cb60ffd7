"""Text functions against plain Python on chosen and generated texts."""

import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from biblio.functions import names, text
from biblio.functions.flatten import flatten_json


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["o"] for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def ascii_of(form, value):
    return unicodedata.normalize(form, value).encode("ascii", "ignore").decode()


SAMPLES = ["José  da-Silva", "Ångström Ølsen", "ﬁnal ½ … test", "straße GROẞ", "áê combining", "  x\ty\n z ", "№ 5 ™ ª º", "don't-stop: it!", "", "Ａｂｃ １２"]


@pytest.mark.parametrize(
    "mode, plain",
    [
        ("library_name", lambda v: " ".join(ascii_of("NFKD", v).casefold().replace("-", " ").split())),
        ("validate_name", lambda v: " ".join(ascii_of("NFKD", v).casefold().split())),
        ("work_text", lambda v: " ".join(re.sub("[^a-z0-9]+", " ", ascii_of("NFKD", v).casefold()).split())),
        ("author_name", lambda v: " ".join(re.sub(r"[^\w\s]", "", ascii_of("NFD", v).lower()).split())),
        ("combining", lambda v: "".join(c for c in unicodedata.normalize("NFKD", v) if not unicodedata.combining(c)).lower()),
        ("token_norm", lambda v: ascii_of("NFD", v).lower().strip()),
    ],
)
def test_fold(spark, mode, plain):
    got = column(spark, SAMPLES, lambda c: text.fold(c, mode))
    assert [g.strip() for g in got] == [plain(v).strip() for v in SAMPLES]


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet=st.characters(min_codepoint=32, max_codepoint=0x24F, exclude_categories=["Cc"])), min_size=1, max_size=40))
def test_fold_of_any_latin_text(spark, values):
    got = column(spark, values, lambda c: text.fold(c, "library_name"))
    assert got == [" ".join(ascii_of("NFKD", v).casefold().replace("-", " ").split()) for v in values]


def test_identifiers(spark):
    dois = [" HTTPS://doi.org/10.1/Ab. ", "http://dx.doi.org/10.2/x", "10.3/y..", None]
    assert column(spark, dois, text.normalize_doi) == ["10.1/ab", "10.2/x", "10.3/y", ""]
    orcids = ["0000-0002-1825-0097", "0000-0001-5109-3700", "0000-0002-1694-233X", "0000-0002-1825-0098", "x", None]
    assert column(spark, orcids, text.orcid_valid) == [True, True, True, False, False, False]
    assert column(spark, ["at https://orcid.org/0000-0002-1694-233X now", "none"], text.extract_orcid) == ["0000-0002-1694-233X", None]
    assert column(spark, ["2-s2.0-123", "123", "2-s2.0-x"], text.eid_number) == ["123", None, None]
    assert column(spark, ["ab-c1", "Ab", "a--b", "-a"], text.id_valid) == [True, False, False, False]


def test_slugs(spark):
    v = ["João D'Ávila  (Jr.)", "a_b--c"]
    assert column(spark, v, text.slug) == ["joao-d-avila-jr", "a-b-c"]
    assert column(spark, v, lambda c: text.slug(c, "delete")) == ["joao-davila-jr", "ab-c"]
    assert column(spark, ["x" * 80], lambda c: text.slug(c, "cut")) == ["x" * 60]


def test_urls(spark):
    base = "http://h.org/a/b.html?x=1"
    links = ["c.html", "/d", "//o.org/e", "http://z/", "?q=2", "#f", ""]
    assert column(spark, links, lambda c: text.url_join(F.lit(base), c)) == ["http://h.org/a/c.html", "http://h.org/d", "http://o.org/e", "http://z/", "http://h.org/a/b.html?q=2", base + "#f", base]
    routes = ["http://h.org/site/", "http://h.org/site/x", "http://h.org/site/x.pdf?y", "/site/a%20b/"]
    assert column(spark, routes, lambda c: text.route_file(c, "/site")) == ["index.html", "x/index.html", "x.pdf", "a b/index.html"]
    assert column(spark, ["p?num_tese=000%2012&x", "p"], lambda c: text.query_param(F.concat(F.lit("http://h/"), c), "num_tese")) == ["000 12", None]


def test_small_functions(spark):
    assert column(spark, ["Năo Acadęmico"], text.mojibake_fix) == ["Não Acadêmico"]
    assert column(spark, ["12", "x", None, "1.5"], text.to_int_or_zero)[:3] == [12, 0, 0]
    assert column(spark, ["Total: 123 of 9", "none"], text.extract_int) == [123, None]
    assert column(spark, ["a  b \n c "], text.clean_text) == ["a b c"]
    assert column(spark, ["Bolsista de Produtividade em Pesquisa do CNPq - Nível 1d", "Bolsista CNPq nível 2", "x"], text.fellowship_from_text) == ["1D", "2", None]
    assert column(spark, ['"Math"', '{"$": "Physics"}', '[{"$": "Bio"}, {"$": "x"}]', '["Chem"]', "plain"], text.subject_area) == ["Math", "Physics", "Bio", "Chem", "plain"]
    got = column(spark, ["A, B; C, D . A title . Journal of X , v. 1, 2020", "short"], text.citation_split)
    assert got[0].asDict() == {"authors": ["A, B", "C, D"], "title": "A title", "journal": "Journal of X"} and got[1]["title"] == "short"
    days = spark.sql("select timestamp'2024-01-01' a, timestamp'2024-01-31 12:00:00' b").select(text.age_days(F.col("a"), F.col("b")).alias("x"), text.age_days(F.col("b"), F.col("a")).alias("y")).first()
    assert (days["x"], days["y"]) == (30, 0)
    two = spark.sql("select named_struct('pt', 'olá', 'en', '') s")
    assert two.select(text.localized(F.col("s"), "en").alias("x")).first()["x"] == "olá"
    assert spark.sql("select array('a', 'b') a").select(text.first_of(F.col("a")).alias("x")).first()["x"] == "a"
    assert column(spark, ["João da Silva e Souza"], text.significant_tokens) == [["joao", "silva", "souza"]]


def pairs(spark, rows, f):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i int, a string, b string")
    return [r["o"] for r in df.select("i", f(F.col("a"), F.col("b")).alias("o")).orderBy("i").collect()]


def test_author_similarity_ladder(spark):
    rows = [("ana lima", "ana lima"), ("ana", "ana lima"), ("ana lima", "alda lima"), ("ana lima", "beto lima"), ("ana x lima", "ana y costa"), ("", "ana"), ("rui", "xrui y")]
    assert pairs(spark, rows, names.author_name_similarity) == [1.0, 0.9, 0.7 + 0.2, 0.7, 1 / 3, 0.0, 0.9]


def test_advisor_similarity_ladder(spark):
    def f(a, b):
        return names.advisor_name_similarity(names.name_parts(a), names.name_parts(b))

    rows = [
        ("Ana Bicalho", "ana bicalho"), ("Ana Bicalho", "Ana Bicalho Costa"), ("Ana Bicalho", "Rui Bicalho"), ("Ana Maria Bicalho", "Ana Bicalho"),
        ("Ana Pinto Silva", "Ana Pinto de Moraes Silva"), ("Ana Pinto Silva", "Ana Pinto"), ("Ana Rui Silva", "Ana Tito Lima"), ("Ana Zorzi Pinto X", "Ana Pinto Zorzi Y"),
    ]
    assert pairs(spark, rows, f) == [1.0, 0.95, 0.0, 0.9, 0.85, 0.95, 0.0, 0.8]


def test_title_similarity(spark):
    assert pairs(spark, [("A b c", "a B d"), ("", "x"), ("é x", "É x")], text.token_jaccard) == [0.5, 0.0, 1.0]


def test_json_leaves(spark):
    df = spark.createDataFrame([(1, '{"a": {"b": [1, "x"]}, "c": null}'), (2, "no json"), (3, None)], "k int, j string")
    got = {(r["k"], r["path"], r["value"]) for r in flatten_json(df, "k", "j").collect()}
    assert got == {(1, "$.a.b[0]", "1"), (1, "$.a.b[1]", "x"), (1, "$.c", None)}
