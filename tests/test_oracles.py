"""Every query with SQL gives the same rows in Spark and in DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def cell(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, con, name):
    got = entry.queries()[name](spark, SF)
    cursor = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(got.columns) == sorted(names)
    want = sorted((tuple(cell(dict(zip(names, r))[c]) for c in sorted(names)) for r in cursor.fetchall()), key=str)
    rows = sorted((tuple(cell(r[c]) for c in sorted(names)) for r in got.collect()), key=str)
    assert rows == want


def test_entry(spark):
    first, again = entry.entry(spark), entry.entry(spark)
    assert first.columns == ["query_id", "id", "lang", "score"] and sorted(first.collect()) == sorted(again.collect())


def test_plans(spark):
    plan = entry.queries()["vector_topk"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    plan = entry.queries()["chat_history"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
