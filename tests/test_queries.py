"""Each own query against its DuckDB SQL on the same tables."""

import math
from pathlib import Path

import duckdb
import pytest

from sparkquarry.plans import detection_queries, project_queries, structure_queries
from sparkquarry.plans.queries import ORACLE_SQL, QUERIES

assert detection_queries and project_queries and structure_queries  # they register their queries
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def _plain(v):
    return round(v, 6) if isinstance(v, float) and math.isfinite(v) else v


def _sorted(rows):
    return sorted((tuple(map(_plain, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    rows = _sorted(df.select(*names).collect())
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == names
    assert rows == _sorted(want.select(*[duckdb.ColumnExpression(n) for n in names]).fetchall())
