"""Every query with SQL gives the SQL's rows."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as entry
from tessella import plans

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="the test tables are not here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(frame) -> list[tuple]:
    def plain(v):
        if hasattr(v, "tolist"):
            v = v.tolist()
        if isinstance(v, list):
            return tuple(map(plain, v))
        return repr(float(v)) if isinstance(v, int | float) and not isinstance(v, bool) else str(v)

    return sorted(tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(name, spark, duck):
    found = plans.QUERIES[name](spark, DATA).toPandas()
    if name in plans.SQL:
        wanted = duck.sql(plans.SQL[name]).df()
        assert sorted(found.columns) == sorted(wanted.columns)
        assert rows(found) == rows(wanted)
    else:
        assert len(found) > 0


def test_entry(spark):
    found = entry.entry(spark).collect()
    assert len(found) == 1 and found[0]["total"] > 0


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_no_python_in_plans(spark):
    """Operators stay in the JVM, but for those whose state or codec needs Python."""
    python = {"batch_compression", "backend_calibration", "dispatch_state", "exploration", "governor_admission", "pairwise_train", "profile_cache_state", "route_selector"}
    for name in ("seq_transform_binary", "reduce_reproducible", "stencil_step", "grid_neighbors", "workload_family", "candidate_ranking", "quadtree"):
        assert name not in python
        plan = plans.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
