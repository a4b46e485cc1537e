"""Plans that matter at scale: pruned scans, pushed filters, top-k, and where Python runs."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from conftest import SF
from parcelweave.operators import frontier as R
from parcelweave.plans.tables import bare_tasks, load

QUERIES = entry_point.queries()
PYTHON_STAGE = {
    "css_nav_links", "xpath_h1", "css_paragraph_index", "selector_coverage", "nav_cell", "node_counts", "parse_pages",
}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def read_columns(plan):
    return [sorted(re.findall(r"(\w+):", schema)) for schema in re.findall(r"ReadSchema: struct<(.*?)>", plan)]


@pytest.mark.parametrize(
    ("name", "columns"),
    [
        ("count_by_status", [["o_orderstatus"]]),
        ("event_counts", [["event_type"]]),
        ("page_title_by_host", [["html", "url"]]),
        ("css_nav_links", [["html", "page_id"]]),
        ("content_map", [["doc_id", "text"]]),
        ("retention_class", [["o_orderdate"]]),
    ],
)
def test_scans_read_only_what_they_need(spark, name, columns):
    assert read_columns(plan_of(QUERIES[name](spark, SF))) == columns


def test_filters_reach_the_scan(spark):
    pending = bare_tasks(spark, SF).where(F.col("created_at") >= F.lit("1998-01-01").cast("timestamp_ntz"))
    assert "GreaterThanOrEqual(o_orderdate" in plan_of(pending)
    late = load(spark, SF, "lineitem").where("l_quantity > 40").select("l_partkey")
    assert "GreaterThan(l_quantity,40.0)" in plan_of(late)


def test_pull_is_a_top_k(spark):
    assert "TakeOrderedAndProject" in plan_of(R.next_tasks(bare_tasks(spark, SF), 10))


@pytest.mark.parametrize("name", ["css_nav_links", "mapped_customers", "validation_errors", "raw_manifest", "signed_outbox"])
def test_python_runs_only_for_html(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    assert ("InArrow" in plan) == (name in PYTHON_STAGE)
    assert "EvalPython" not in plan


def test_newest_row_is_an_aggregate(spark):
    plan = plan_of(QUERIES["latest_snapshot"](spark, SF))
    assert "partial_max_by" in plan and "Window" not in plan
