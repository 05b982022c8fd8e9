"""Contract and plan checks."""

import re

import pytest

import __spark_entry__ as entry
from leadloom.plans import catalog

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 150


def test_entry(spark):
    assert entry.entry(spark).columns


@pytest.mark.parametrize("name", ["l3_validate_leads", "l4_dedupe_leads", "l6_limit_per_source", "c12_best_contact", "h7_dedupe_jobs"])
def test_first_per_key_limits_before_the_shuffle(spark, name):
    assert "WindowGroupLimit" in plan(catalog.QUERIES[name](spark, SF))


@pytest.mark.parametrize(
    "name",
    ["t2_tech_confidence", "p8_special_pages", "h2_match_keywords", "b5_classify", "i2_score_label", "e2_generate_addresses", "q2_qualification_score", "q5_opportunity_score", "k3_queue_gate", "site_report"],
)
def test_no_nested_loop_joins(spark, name):
    text = plan(catalog.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["t2_tech_confidence", "m2_mobile_result", "p6_page_links", "q2_qualification_score", "b5_classify", "o3_personalize"])
def test_row_local_jobs_do_not_shuffle(spark, name):
    assert "Exchange" not in plan(catalog.QUERIES[name](spark, SF)).replace("BroadcastExchange", "")


def test_scan_reads_needed_columns_only(spark):
    text = plan(catalog.QUERIES["l7_limit_run"](spark, SF))
    assert re.search(r"ReadSchema: struct<o_orderkey:bigint,o_orderpriority:string>", text)
    text = plan(catalog.QUERIES["s9_scan_store"](spark, SF))
    assert re.search(r"PushedFilters: \[IsNotNull\(o_orderkey", text) and "o_custkey" not in text


@pytest.mark.parametrize("job", ["site_report", "candidate_pages"])
def test_bodies_are_read_once_after_the_choice(spark, job):
    from leadloom.operators import pages as P
    from leadloom.plans import daily

    snapshots = spark.read.parquet(f"{SF}/pages.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # the tables here are small, those of a cluster are not
    try:
        if job == "site_report":
            text = plan(daily.site_report(snapshots))
        else:
            sized = snapshots.selectExpr("page_id", "url", "html", "100 as n_bytes")
            companies = snapshots.selectExpr("page_id as company_id", "url as base_url")
            text = plan(P.candidate_pages(companies, sized, ("/a", "/b")))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    schemas = [line for line in text.splitlines() if "ReadSchema" in line]
    assert sum("html" in line for line in schemas) == 1 and len(schemas) >= 2, schemas
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
