"""Queries against their SQL on small tables with what the test tables lack."""

import random

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from biblio.functions.text import carried
from biblio.operators import pages, textindex, tree
from biblio.plans.registry import ORACLE, QUERIES


def same(spark, folder, name, **tables):
    """Whether a query gives the rows of its SQL over (schema, rows) tables."""
    duck = duckdb.connect()
    for t, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{t}.parquet")
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    got = QUERIES[name](spark, str(folder))
    cols = sorted(got.columns)
    mine = sorted(map(repr, (tuple(r) for r in got.select(*cols).collect())))
    theirs = sorted(map(repr, duck.execute(f"SELECT {', '.join(cols)} FROM ({ORACLE[name]})").fetchall()))
    assert mine == theirs
    return len(mine)


@pytest.mark.parametrize("texts", [(None, "", "a"), ("a\nb", "", None), ("n", "t", " ")])
def test_text_tree_keeps_null_and_empty_texts(spark, tmp_path, texts):
    rows = [(k, t) for k, t in enumerate([*texts, *texts, *texts])] + [(None, "x"), (-1, "y")]
    assert same(spark, tmp_path, "s7_read_text_tree", documents=("doc_id long, text string", rows)) == 6


def test_rounds_of_a_tree_keep_estimates_small(spark, monkeypatch):
    """A join's estimate is the product of its sides'; carried from round to round it gets twice as many digits each time."""
    sizes = []

    def watched(df, f=tree.written):
        sizes.append(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length())
        return f(df)

    monkeypatch.setattr(tree, "written", watched)
    chain = spark.range(200).selectExpr("id", "nullif(id - 1, -1) AS parent", "id % 7 AS position")
    assert tree.subtree(chain, 190).count() == 10
    assert max(sizes) < 300


def test_rounds_of_a_tree_go_by_the_longest_way(spark, monkeypatch):
    """Ever more short cycles take no more rounds, and a way that ends late is followed to its end."""
    rounds = []
    monkeypatch.setattr(tree, "written", lambda df, f=tree.written: rounds.append(1) or f(df))

    def taken(n):
        rounds.clear()
        turns = spark.range(n).selectExpr("id", "id - id % 3 + (id + 1) % 3 AS parent")
        got = tree.ancestors(turns.unionByName(spark.range(n, n + 9).selectExpr("id", f"IF(id > {n}, id - 1, 0) AS parent")))
        assert got.groupBy("is_cycle").count().collect() == [(True, n + 9)] and got.agg({"depth": "max"}).first()[0] == 11
        return len(rounds)

    assert taken(6) == taken(600)


def test_chains_of_other_tables(spark, tmp_path):
    rows = [(k, "c", k % 25) for k in [*range(160), *range(290, 460), 7000]]
    assert same(spark, tmp_path / "a", "t1_ancestors_of_chains", customer=("c_custkey long, c_name string, c_nationkey int", rows)) == len(rows)


def test_details_of_repeated_pages_stay_apart(spark, tmp_path):
    """An order that comes twice is two pages, each read by itself, and nothing is shuffled or settled on the way."""
    rows = [(k, 5, "F", f"{k}-HIGH") for k in (0, 1, 2, 3, 3, None)]
    assert same(spark, tmp_path, "h2_extract_detail", orders=("o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string", rows)) == 3 * 6 + 3
    found = pages.extract_detail(spark.createDataFrame([(1, "<table></table>")], "page_id int, html string"), "http://h/")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_labels_carry_over_blocks(spark):
    rng = random.Random(3)
    lists = [[rng.choice(["", "t", "a", "b"]) for _ in range(n)] for n in (0, 1, 5, 256, 257, 600)] + [[""] * 300 + ["x"] + ["t"] * 600]
    for (labels, got) in spark.createDataFrame([(x,) for x in lists], "x array<string>").select("x", carried(F.col("x"))).collect():
        want, last = [], ""
        for x in labels:
            last = x if x not in ("", "t") else last
            want.append(last)
        assert got == want


@pytest.mark.parametrize("markup", ["<table><tr><td>a <b>b</b><td>c</table><table><tr><td>no", '<tr><td>x<table class="k"><td>no<tr><th>h<td><a href="u">l</a>m<table><tr><td>in</table>o</tr>', '<table><tr><td><a>n</a><a href="v">w</a></td><td>open'])
def test_plain_pages_are_read_as_others_are(markup):
    assert pages._table(markup) == pages._table(markup + "<!-- -->") == pages._table("<!-- & -->" + markup.replace("<td>", "<TD >"))
    assert pages._table("<table><tr><td>x</table>") == [[("x", None, "", False)]] and pages._table("") == pages._table("<p>&amp;") == []


def test_text_index_of_segments_and_blocks(spark, tmp_path, monkeypatch):
    """Lists come by segments and blocks, with nothing shuffled, and have every gram of every text once."""
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcdefghijé€😀 ") for _ in range(rng.choice([0, 3, 4, 5, 50, 400]))) for _ in range(90)]
    batch = pa.RecordBatch.from_arrays([pa.array([*range(65_500, 65_580), *range(1 << 33, (1 << 33) + 10)]), pa.array(texts)], names=["number", "text"])
    monkeypatch.setattr(textindex, "SEGMENT", 300)
    got = []
    for x in textindex._postings([batch.slice(0, 0), batch.slice(7)]):
        for gram, block, n, places in zip(*(c.to_pylist() for c in x.columns), strict=True):
            found = [(block << 16) + p for p in memoryview(places).cast("H")]
            assert len(found) == n
            got += [(gram, k) for k in found]
    numbers = batch.column(0).to_pylist()
    want = {(int(textindex._hashed(textindex._codes(t[i : i + 4].encode()))[0]), k) for k, t in list(zip(numbers, texts, strict=True))[7:] for i in range(len(t) - 3)}
    assert len(got) == len(set(got)) and set(got) == want
    rows = [(None if k == 5 else k % 80, t) for k, t in enumerate([*texts, "xx thation €😀", None])]
    assert same(spark, tmp_path, "p9_text_index", documents=("doc_id long, text string", rows)) > 1


def test_text_index_is_built_without_a_shuffle(spark, tmp_path, monkeypatch):
    plans = []
    writer = type(spark.range(1).write)
    monkeypatch.setattr(writer, "parquet", lambda self, path, *a, f=writer.parquet, **b: plans.append(self._df._jdf.queryExecution().executedPlan().toString()) or f(self, path, *a, **b))
    textindex.build(spark.createDataFrame([(1, "some text")], "k int, text string"), "k", ["text"], str(tmp_path / "index"))
    assert len(plans) == 2 and not any("Exchange" in p for p in plans)
