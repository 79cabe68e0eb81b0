"""Every query with SQL agrees with it on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from pitframe.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return db


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 5) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return x if x is None or isinstance(x, (str, bool, int)) else str(x) if not hasattr(x, "as_tuple") else round(float(x), 5) + 0.0


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracles()))
def test_oracle(spark, duck, sf_dir, name):
    df = catalog.queries()[name](spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = duck.execute(catalog.oracles()[name])
    names = [c[0] for c in cursor.description]
    want = rows(names, cursor.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert len(got) == len(want)
    near = [(a, b) for a, b in zip(got, want) if a != b and not all(x == y or isinstance(x, (int, float)) and isinstance(y, (int, float)) and math.isclose(x, y, rel_tol=1e-9, abs_tol=2e-5) for x, y in zip(a, b))]
    assert not near, near[:3]
