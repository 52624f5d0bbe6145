"""Queries of the subpackage against their SQL on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import pytest

from tessella.llm import entries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="the test tables are not here")


@pytest.mark.parametrize("name", sorted(entries.ORACLE_SQL))
def test_sql(name, spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = con.sql(entries.ORACLE_SQL[name]).df()
    got = entries.QUERIES[name](spark, DATA).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert sorted(map(tuple, got[columns].values.tolist()), key=str) == sorted(map(tuple, want[columns].values.tolist()), key=str)


@pytest.mark.parametrize("name", sorted(entries.QUERIES))
def test_every_query_runs(name, spark):
    assert name in entries.ORACLE_SQL or entries.QUERIES[name](spark, DATA).count() >= 200


def test_scratch_can_be_deleted(spark, monkeypatch):
    from tessella.llm import common

    monkeypatch.setattr(common, "_SCRATCH", set())
    kept = common.materialize(spark.range(3), "kept")
    assert kept.count() == 3 and common._SCRATCH == {kept.scratch_path}
    common.clean(spark)
    assert not common._SCRATCH
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(kept.scratch_path)
