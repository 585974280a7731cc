"""Every registered query against its SQL on the small tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from loredeck import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal) or isinstance(v, int) and not isinstance(v, bool):
        return float(v)
    return str(v) if isinstance(v, (list, tuple, datetime.date)) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query_equals_its_sql(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted(str(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    if name not in registry.oracles():
        return
    got = duck.execute(registry.oracles()[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows == sorted(str(tuple(plain(r[i]) for i in at)) for r in got.fetchall())


def test_names_are_unique_and_oracles_belong_to_queries():
    assert set(registry.oracles()) <= set(registry.queries())
    with pytest.raises(ValueError):
        registry.operator("search_bm25_topk")(lambda s, d: None)
