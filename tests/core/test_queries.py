"""Every registered query of the core against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from quillstack import queries as Q

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(name, spark, con):
    df = Q.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(columns).collect()), key=str)
    if name not in Q.ORACLE_SQL:
        assert got
        return
    want = con.sql(Q.ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    assert got == sorted((tuple(map(plain, r)) for r in want.project(", ".join(f'"{c}"' for c in columns)).fetchall()), key=str)
