"""Every query against its SQL in DuckDB, rows as a multiset, columns by name."""

import datetime
import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    return x


def rows(names, found):
    order = sorted(range(len(names)), key=names.__getitem__)
    return Counter(tuple(plain(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_like_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    cursor = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    want = rows(names, cursor.fetchall())
    assert sorted(got.columns) == sorted(names)
    have = rows(got.columns, [tuple(r) for r in got.collect()])
    assert have == want, (list((have - want).items())[:3], list((want - have).items())[:3])
    assert want or name in ("amnesia", "decay_events")


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql()) - {"pipeline"} - {n for n in entry.queries() if n.startswith("op")}))
def test_runs(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
