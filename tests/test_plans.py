"""Plans: filters and columns reach the scan, and no join is a product."""

import re
from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def scan_of(text: str, table: str) -> str:
    return next(p for p in re.split(r"\n\(\d+\) ", text) if p.startswith("Scan parquet") and f"/{table}.parquet" in p)


def test_as_of_filters_reach_the_scan(spark):
    scan = scan_of(plan(entry.queries()["assert_filtered_topk"](spark, DATA)), "assertions")
    pushed = re.search(r"PushedFilters: (.*)", scan).group(1)
    for part in ("EqualTo(tenant_id,tn_brine)", "LessThanOrEqual(valid_from", "LessThanOrEqual(system_from", "status"):
        assert part in pushed
    assert "embedding_json" not in re.search(r"ReadSchema: (.*)", scan).group(1)


@pytest.mark.parametrize("name", ["p1_found", "p4_found", "p5_found"])
def test_only_needed_columns_are_read(spark, name):
    scan = scan_of(plan(entry.queries()[name](spark, DATA)), "assertions")
    read = re.search(r"ReadSchema: (.*)", scan).group(1)
    assert "embedding_json" not in read and "search_text" not in read


@pytest.mark.parametrize("name", ["p1_found", "p3_found", "p4_found", "p5_found", "resolve_none", "supersede_violations", "audit_questions", "lineage_dangling", "search_hybrid_graph", "intake_assertions"])
def test_no_products(spark, name):
    text = plan(entry.queries()[name](spark, DATA))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_entry_and_names(spark):
    assert entry.entry(spark).columns == ["effect_id", "assertion_id"]
    known = entry.queries()
    assert set(entry.oracle_sql()) <= set(known)
    assert {"p1_found", "p3_found", "p4_found", "p5_found"} <= set(known)
