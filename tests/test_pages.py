"""Queries over placed text find their pages where the documents are."""

import pytest

import __spark_entry__ as entry
from lectern.operators import pages as P

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["reading_order", "find_positions", "page_prompts"])
def test_no_run_is_exchanged(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_places_are_grouped_once(spark):
    plan = entry.queries()["find_by_page"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan


def test_pages_of_any_kind(spark):
    """Pages without runs, null arrays, equal places; more pages than are looked at together."""
    run = "ord int, str string, x double, y double, w double, h double, eol boolean, low string"
    one = [(0, t, 1.0, 9.0, 1.0, 1.0, True, t) for t in ("b", "a")]
    rows = [(1, 1, 600.0, 800.0, one), (2, 1, 600.0, 800.0, []), (3, 1, 600.0, 800.0, None)] + [(9, i, None, None, one[:1]) for i in range(P.TOGETHER + 1)]
    df = spark.createDataFrame(rows, f"doc_id int, page int, page_w double, page_h double, runs array<struct<{run.replace(' ', ':').replace(',:', ',')}>>").coalesce(1)
    got = P.lines_of(df).orderBy("doc_id", "page").collect()
    assert (got[0]["doc_id"], got[0]["text"]) == (1, "ab") and len(got) == P.TOGETHER + 2
    assert P.places_of(df, "b").count() == P.TOGETHER + 2


@pytest.mark.parametrize("name", ["reference_lists", "bibliography_pages"])
def test_lines_are_sorted_once(spark, name):
    """A task held a document's lines once for each of many sorts."""
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    windows = plan[plan.index("Window") :]
    assert sum("Sort [doc_id" in line and "line" in line for line in windows.splitlines()) == 1 and "page#" in plan
    assert sum("Sort [" in line for line in windows.splitlines()) == 1
