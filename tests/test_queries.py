"""Every core query against its SQL on the smallest tables."""

import glob
import math
import os
from collections import Counter

import duckdb
import pytest

from inkmill.plans import catalog

FOLDER = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(FOLDER + "/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    sql = catalog.oracle_sql().get(name)
    if sql:
        cursor = duck.execute(sql)
        names = [x[0] for x in cursor.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        assert Counter(rows) == Counter(tuple(plain(r[i]) for i in at) for r in cursor.fetchall())
