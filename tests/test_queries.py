"""Every registered query against its SQL in DuckDB."""

import math
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest

from duoscope.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    return round(float(v), 5) + 0.0 if isinstance(v, (int, float)) or type(v).__name__ == "Decimal" else str(v)


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES.split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def answers(request, spark, sf):
    """Columns and rows of the queries asked for, some at a time: most of a small query's time is planning."""

    def run(name):
        df = registry.QUERIES[name](spark, sf)
        return sorted(df.columns), [tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()]

    asked = [i.callspec.params["name"] for i in request.session.items if i.module is request.module and hasattr(i, "callspec")]
    with ThreadPoolExecutor(4) as pool:
        yield {name: pool.submit(run, name) for name in asked}


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(name, answers, con):
    columns, rows = answers[name].result()
    assert rows
    if name in registry.SQL:
        rel = con.sql(registry.SQL[name])
        assert sorted(rel.columns) == columns
        at = [rel.columns.index(c) for c in sorted(rel.columns)]
        assert sorted(map(repr, rows)) == sorted(repr(tuple(plain(r[k]) for k in at)) for r in rel.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
