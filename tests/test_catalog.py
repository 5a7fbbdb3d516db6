"""Every query with SQL gives DuckDB's rows on the smallest tables; the others give rows and repeat themselves."""

import math
import os

import duckdb
import pytest

from helixlake.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, sf_dir, duck, name):
    out = QUERIES[name](spark, sf_dir)
    names = sorted(out.columns)
    want = duck.sql(SQL[name])
    assert sorted(want.columns) == names
    at = [want.columns.index(c) for c in names]
    got = sorted((tuple(plain(v) for v in r) for r in out.select(*names).collect()), key=repr)
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


#: Long runs of several jobs, which have tests of their own.
SLOW = {"gibbs_walks", "resume_walk", "gibbs_blocked", "multi_seed_best", "score_population", "em_refine", "map_refine"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - SLOW))
def test_gives_rows_again(spark, sf_dir, name):
    first = sorted(map(repr, QUERIES[name](spark, sf_dir).collect()))
    assert first and first == sorted(map(repr, QUERIES[name](spark, sf_dir).collect()))


def test_every_query_is_registered(spark):
    import __spark_entry__ as e

    assert set(catalog.queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert os.path.isdir(os.path.dirname(catalog.__file__))
