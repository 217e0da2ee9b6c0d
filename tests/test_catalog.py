import re
import sys

import duckdb
import pytest

sys.path.insert(0, "tools")

import __spark_entry__ as entry  # noqa: E402
from sievework.plans import catalog, oracle  # noqa: E402
from tools.check_queries import TABLES, canonical  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLE = catalog.queries(), oracle.oracle_sql()


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, database, name):
    df = QUERIES[name](spark, FOLDER)
    rows = df.collect()
    result = database.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(result.columns)
    assert canonical(df.columns, rows) == canonical(result.columns, result.fetchall())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin|PythonUDF|InPandas|BatchEvalPython", plan)
    # every window is partitioned
    assert not re.search(r"windowspecdefinition\((?:\w+#\d+L? (?:ASC|DESC))", plan)


def test_every_query_has_sql_or_trains_a_model():
    assert set(catalog.queries()) - set(ORACLE) == {
        "dt_grid", "rf_grid", "soft_vote", "experiment_scores", "tree_grid_results", "deep_forest",
    }


def test_entry(spark):
    assert entry.entry(spark).count() > 0
