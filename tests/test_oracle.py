"""Every registered query with an oracle equals its DuckDB SQL (sf0.001; spatial ones also at sf0.01)."""

import hashlib
import math

import pytest

import __spark_entry__ as E
from tests.conftest import SF_MID, SF_SMALL

SQL = E.oracle_sql()
QUERIES = E.queries()


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return repr(v)


def _digest(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted("|".join(_norm(r[i]) for i in order) for r in rows)


TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
         "array<int>": "INTEGER[]"}


def _check(spark, con, sf, key):
    df = QUERIES[key](spark, sf)
    got = _digest([tuple(r) for r in df.collect()], df.columns)
    res = con.execute(SQL[key])
    cols = [d[0] for d in res.description]
    want = _digest(res.fetchall(), cols)
    assert sorted(df.columns) == sorted(cols)
    duck_types = {r[0]: r[1] for r in con.execute(f"DESCRIBE {SQL[key]}").fetchall()}
    assert {c: TYPES.get(t, t) for c, t in df.dtypes} == duck_types
    assert len(got) == len(want)
    assert hashlib.md5("\n".join(got).encode()).hexdigest() == hashlib.md5("\n".join(want).encode()).hexdigest(), \
        (sorted(set(got) - set(want))[:3], sorted(set(want) - set(got))[:3])


@pytest.mark.parametrize("key", sorted(SQL))
def test_query_matches_oracle_small(spark, duck_small, key):
    _check(spark, duck_small, SF_SMALL, key)


@pytest.mark.parametrize("key", ["nearest_anchor", "cluster_density_wide", "assign_area", "explanation"])
def test_spatial_matches_oracle_mid(spark, duck_mid, key):
    _check(spark, duck_mid, SF_MID, key)


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 20
    assert df.columns == ["venue_id", "name", "rating", "predicted_rating", "residual", "value_label"]
