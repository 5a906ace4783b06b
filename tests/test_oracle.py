"""Every query of the library against its SQL, as sorted rows."""

import math

import duckdb
import pytest

from cartolode.plans.bindings import TABLES
from cartolode.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=lambda k: names[k])
    plain = lambda v: None if v is None else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) and not math.isnan(v) else str(v)
    return sorted(names), sorted((tuple(plain(r[k]) for k in order) for r in values), key=repr)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    want = duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert got == rows(names, want.fetchall())
