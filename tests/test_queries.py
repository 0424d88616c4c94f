"""Every registered engine query against its SQL in DuckDB, on the smallest tables."""

import datetime
import os
import time

import duckdb
import pytest

import ruleweave.queries as Q

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def normal(x):
    if x is None or x != x:
        return None
    if isinstance(x, bool) or type(x).__name__ == "bool":
        return bool(x)
    if isinstance(x, list):
        return str([normal(y) for y in x])
    if isinstance(x, (datetime.date, str)):
        return str(x)
    return round(float(x) + 0.0, 9)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query(spark, duck, name):
    df = Q.QUERIES[name](spark, SF)
    expected = duck.sql(Q.ORACLES[name])
    assert sorted(df.columns) == sorted(expected.columns)
    assert rows(df.columns, df.collect()) == rows(expected.columns, expected.fetchall())


def test_increments(spark):
    assert Q.QUERIES["events_foreach_batch"](spark, SF).count() == 1000


def test_increments_take_the_latest_of_each_key(spark, tmp_path):
    from ruleweave.streaming.increments import run_increments

    # three files, three batches; keys 5 to 9 come again with other values
    for part, rows in enumerate(([(i, 1) for i in range(10)], [(i, 2) for i in range(5, 15)], [(9, 3)])):
        spark.createDataFrame(rows, "id int, x int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are taken in the order of their times
    got = {r.id: r.y for r in run_increments(spark, str(tmp_path / "in"), {"y": {"*": [{"var": "x"}, 10]}}, ["id"]).collect()}
    assert got == {i: 10.0 for i in range(5)} | {i: 20.0 for i in range(5, 15)} | {9: 30.0}


def test_shared_folders_must_be_named_on_a_cluster(spark, monkeypatch):
    from ruleweave.config import RuleError
    from ruleweave.streaming.increments import folder

    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, *a: None)
    with pytest.raises(RuleError, match="spark.checkpoint.dir"):
        folder(spark, "x")


def test_lookups_keep_rows_and_broadcast(spark):
    df = Q.QUERIES["valueat_match_fused_df"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "CartesianProduct" not in plan
