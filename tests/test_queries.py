"""Every registered query with SQL gives DuckDB's rows at the smallest scale; the others run."""

import math
import os

import duckdb
import pytest

from trailweave import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, db, name):
    df = queries.QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in queries.SQL:
        assert df.columns and isinstance(rows, list)
        return
    found = db.sql(queries.SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(plain(v) for v in r) for r in found.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in names) for r in rows), key=repr) == want


def test_anchors(spark):
    """Numbers computed once for the smallest scale."""
    q2 = queries.QUERIES["corpus_q2"](spark, SF)
    assert (q2.count(), q2.filter("violated is not null").count()) == (1500, 1286)
    q5 = queries.QUERIES["corpus_q5"](spark, SF)
    assert (q5.count(), q5.filter("violated is not null").count()) == (1500, 813)
    assert queries.QUERIES["corpus_q6"](spark, SF).first()["max_dur"] == f"{213_148_800 // 3600}h0m0s"
    assert queries.QUERIES["corpus_q7"](spark, SF).count() == 15_000
    assert queries.QUERIES["size_num_childs_zero"](spark, SF).count() == 27


def test_entry_points():
    import __spark_entry__ as entry

    assert set(queries.QUERIES) <= set(entry.queries()) and set(queries.SQL) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())
