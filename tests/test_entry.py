import math
import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]


def plain(rows):
    return sorted(([None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 5) if isinstance(v, float) else v for v in r] for r in rows), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", [n for n in NAMES if n in entry.oracle_sql()])
def test_query_equals_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from read_parquet('{SF}/{f}')")
    got, want = entry.queries()[name](spark, SF), con.sql(entry.oracle_sql()[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert plain(tuple(r[c] for c in columns) for r in got.collect()) == plain(want.select(*(f'"{c}"' for c in columns)).fetchall())
