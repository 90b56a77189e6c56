"""Every query with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pandas as pd
import pytest

from pointloom import plans
from pointloom.plans import evaluation_queries, join_queries, lidar_queries, metric_queries, point_queries, scene_queries, stream_queries  # noqa: F401

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{DATA}/{t}.parquet"
        c.sql(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    try:
        return round(float(v), 9) + 0.0
    except (TypeError, ValueError):
        return str(v)


def rows(df: pd.DataFrame) -> list[str]:
    df = df[sorted(df.columns)]
    return sorted(str([plain(v) for v in r]) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_against_sql(spark, duck, name):
    got = plans.QUERIES[name](spark, DATA).toPandas()
    assert len(got)
    if name in plans.ORACLE:
        assert rows(got) == rows(duck.sql(plans.ORACLE[name]).df())
