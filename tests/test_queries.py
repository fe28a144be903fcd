"""Every query that has SQL against that SQL in DuckDB; the others for rows and stability."""

import duckdb
import pytest

from sumi import queries as Q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    cell = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(cell(r[k]) for k in order) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_equals_sql(spark, sf_dir, duck, name):
    got = Q.QUERIES[name](spark, sf_dir)
    want = duck.sql(Q.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    a, b = plain([tuple(r) for r in got.collect()], got.columns), plain(want.fetchall(), want.columns)
    assert len(a) == len(b)
    assert [tuple(map(float_or_same, r)) for r in a] == [tuple(map(float_or_same, r)) for r in b]


def float_or_same(v):
    return float(v) if isinstance(v, int) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLES)))
def test_gives_rows_twice_alike(spark, sf_dir, name):
    first, again = (sorted(map(str, Q.QUERIES[name](spark, sf_dir).collect())) for _ in range(2))
    assert first and first == again
