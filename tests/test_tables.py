"""Queries on odd and larger tables against their SQL."""

import functools
import itertools
import operator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from sumi import queries as Q
from sumi.config import Border
from sumi.operators import glyphs as G

from .test_queries import plain


def differ(spark, folder, name, **tables):
    """Rows of one side only: of the query and of its SQL, over these Arrow tables."""
    con = duckdb.connect()
    for t, rows in tables.items():
        pq.write_table(rows, f"{folder}/{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got, want = Q.QUERIES[name](spark, str(folder)), con.sql(Q.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    a, b = plain([tuple(r) for r in got.collect()], got.columns), plain(want.fetchall(), want.columns)
    assert a
    return [r for r in a if r not in set(b)], [r for r in b if r not in set(a)], len(a) - len(b)


SAME = [], [], 0


def vectors(*ids):
    """Vectors by id: a repeated id repeats its vector; no id, no raster."""
    values = [[((7 * (k or 0) + 13 * i * i + i) % 64) / 32 - 1 for i in range(64)] for k in ids]
    return pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(values, pa.list_(pa.float32()))})


def no_pixel_joins(df):
    """A join of pixel tables is broadcast by the size of the vectors they come from, a fraction of what the driver then holds."""
    return "Join" not in df._jdf.queryExecution().executedPlan().toString()


def test_adaptive_mask_without_joins(spark, sf_dir, tmp_path):
    assert no_pixel_joins(Q.QUERIES["adaptive_mean_mask"](spark, sf_dir))
    assert differ(spark, tmp_path, "adaptive_mean_mask", embeddings=vectors(1, 2, 2, 5, None)) == SAME


def test_stencils_without_joins(spark, sf_dir, tmp_path):
    for name in ("sobel_mag2", "laplacian_abs"):
        assert no_pixel_joins(Q.QUERIES[name](spark, sf_dir))
        assert differ(spark, tmp_path, name, embeddings=vectors(1, 2, 2, 5, None)) == SAME


def test_base64_on_one_line(spark, tmp_path):
    urls = [None, "", "a", *("http://é漢.example/" + "x" * n for n in (34, 35, 36, 300, 5_000))]
    assert differ(spark, tmp_path, "base64_bytes", pages=pa.table({"page_id": range(len(urls)), "url": urls})) == SAME


def events(rows):
    users, ids, values = zip(*rows, strict=True)
    return pa.table({"event_id": pa.array(ids, pa.int64()), "user_id": pa.array(users, pa.int64()), "value": pa.array(values, pa.float64())})


def test_waves_do_not_depend_on_the_order(spark, tmp_path):
    """In some orders the doubles add up to 471.99999999999994."""
    orders = list(itertools.permutations([100.41, 63.69, 22.89, 194.96, 90.05]))
    pq.write_table(events([(u, 18 + 50 * k, v) for u, order in enumerate(orders) for k, v in enumerate(order)]), f"{tmp_path}/events.parquet")
    assert {functools.reduce(operator.add, order) < 472 for order in orders} == {True, False}
    assert {(r.mass[18], sum(r.mass)) for r in Q._waves(spark, str(tmp_path)).collect()} == {(472, 472)}


def test_spikes_of_odd_events(spark, tmp_path):
    rows = [(None, 1, 50.0), (None, 51, 3.0), (1, None, 9.0), (1, 2, None), (2, 3, -40.0), (2, 30, 100.0), (2, 5, 35.0), (3, -4, 7.0), (3, 4, 7.0)]
    assert differ(spark, tmp_path, "border_spikes", events=events(rows)) == SAME


def test_spikes_decide_ties_exactly():
    """Drops of just 2 / 5 of the top, in thirds: borders, and none with a top one larger."""
    for top, *mass in ((5, 3, 3, 5, 1, 1, 3), (10, 4, 4, 5, 0, 0, 1), (20, 8, 8, 10, 0, 0, 2), (40, 19, 19, 20, 3, 3, 4), (70, 33, 33, 35, 5, 5, 7)):
        for more in (0, 1):
            found = G.spikes(np.array([*mass, 0, 0, 0, 0]), top + more, 50, Border())
            assert [(s["start"], s["end"], s["border"]) for s in found][0] == (0, 3, not more)
