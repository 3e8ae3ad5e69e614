import duckdb
import pytest

from factlake.plans import registry
from factlake.plans.views import TABLES

registry.load()
FOLDER = "/root/testdata/sf0.001"


def plain(v):
    import datetime
    import decimal
    import math

    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_twin(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{FOLDER}/{t}.parquet')")
    df = registry.QUERIES[name](spark, FOLDER)
    twin = con.sql(registry.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(twin.columns)
    mine = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    theirs = sorted(repr([plain(r[twin.columns.index(c)]) for c in columns]) for r in twin.fetchall())
    assert mine == theirs
