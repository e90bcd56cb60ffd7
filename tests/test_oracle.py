"""Every query against its SQL twin in DuckDB."""

import duckdb
import pytest

from biblio.plans.registry import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def rows(values):
    return sorted(tuple("" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v).removesuffix(" 00:00:00") for v in r) for r in values)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, FOLDER)
    cols = sorted(got.columns)
    mine = rows(tuple(r) for r in got.select(*cols).collect())
    if name not in ORACLE:
        assert mine
        return
    theirs = duck.execute(f"SELECT {', '.join(cols)} FROM ({ORACLE[name]})").fetchall()
    assert mine == rows(theirs)
