"""Recipes that turn the test tables into lead-shaped inputs, as Spark jobs and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.plans.registry import table

URL_SAMPLE = """CASE page_id % 8 WHEN 0 THEN url WHEN 1 THEN '  ' || url || '/ '
 WHEN 2 THEN replace(replace(url, 'http://', ''), 'https://', '') WHEN 3 THEN replace(url, '://', '://www.')
 WHEN 4 THEN 'https://www.producthunt.com/r/P' || CAST(page_id % 50 AS VARCHAR(10)) || '?utm_source=x'
 WHEN 5 THEN 'https://dash.cloudflare.com/x' WHEN 6 THEN replace(url, '.example', '.EXAMPLE')
 ELSE url || '/cdn-cgi/l' END"""

PAGE_MARKERS = """html || CASE page_id % 8
 WHEN 0 THEN '<script src="https://js.stripe.com/v3/"></script>' WHEN 1 THEN '<script id="__NEXT_DATA__" src="/_next/static/a.js"></script>'
 WHEN 2 THEN '<a href="https://play.google.com/store/apps/details?id=x">Get it on Google Play</a>' WHEN 3 THEN '<a href="https://boards.greenhouse.io/acme/jobs/1">Senior Flutter Engineer</a>'
 WHEN 4 THEN '<a href="/signup">Start free trial</a>' WHEN 5 THEN '<footer>Founded in 2019. Based in Berlin</footer>'
 WHEN 6 THEN '<script src="https://cdn.tailwindcss.com"></script><script src="/jquery.min.js"></script>' ELSE '' END"""

CONTACT_COLUMNS = [
    "c_custkey as pos",
    "c_nationkey as company_id",
    "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CASE c_custkey % 7 WHEN 0 THEN 'Ada' WHEN 1 THEN 'Jane' WHEN 2 THEN 'Ravi' WHEN 3 THEN 'Mia' WHEN 4 THEN 'Omar' WHEN 5 THEN 'Hello' ELSE 'Lee' END || ' ' || "
    "CASE c_custkey % 6 WHEN 0 THEN 'Stone' WHEN 1 THEN 'Rao' WHEN 2 THEN 'Kim' WHEN 3 THEN 'Policy' WHEN 4 THEN 'Diaz' ELSE 'West' END END AS full_name",
    "CASE c_custkey % 6 WHEN 0 THEN 'founder' WHEN 1 THEN 'CTO' WHEN 2 THEN 'cofounder' WHEN 3 THEN 'support' WHEN 4 THEN NULL ELSE 'Chief Executive Officer' END AS role",
    "CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CASE c_custkey % 8 WHEN 1 THEN 'info' WHEN 2 THEN 'jobs' WHEN 3 THEN 'noreply' ELSE 'p' || CAST(c_custkey % 90 AS VARCHAR(10)) END || '@n' || CAST(c_nationkey AS VARCHAR(10)) || '.io' END AS email",
    "CASE WHEN c_custkey % 3 = 0 THEN 'https://linkedin.com/in/p' || CAST(c_custkey % 50 AS VARCHAR(10)) ELSE NULL END AS linkedin",
]

JOB_COLUMNS = [
    "o_custkey as company_id",
    "o_orderkey as pos",
    "'https://jobs.x.io/' || CAST(o_orderkey % 3 AS VARCHAR(5)) AS url",
    "CASE o_orderpriority WHEN '1-URGENT' THEN 'Flutter Engineer' WHEN '2-HIGH' THEN 'Android Developer' WHEN '3-MEDIUM' THEN 'Frontend Engineer' WHEN '4-NOT SPECIFIED' THEN 'Software Engineer' ELSE 'Office Manager' END AS title",
    "CAST(35 + o_orderkey % 60 AS INT) AS conf_pct",
    "o_orderkey % 2 = 0 AS remote",
]

# The same rows as sub-queries, for the SQL side.
SQL_URLS = f"(select page_id, url as page_url, {URL_SAMPLE} as url from pages)"
SQL_PAGES = f"(select page_id, url, {PAGE_MARKERS} as html from pages)"
SQL_CONTACTS = f"(select {', '.join(CONTACT_COLUMNS)} from customer)"
SQL_JOBS = f"(select {', '.join(JOB_COLUMNS)} from orders)"
SQL_MAIL_DOCS = "(select doc_id, regexp_replace(text, 'example[.]com', 'acme.io', 'g') as text from documents)"
SQL_FEATURES = """(select c.c_custkey as company_id, CASE c.c_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE NULL END AS has_mobile_app,
 c.c_mktsegment IN ('MACHINERY','AUTOMOBILE') AS is_product, c.c_acctbal > 0 AS has_contact, c.c_acctbal > 5000 AS has_email, c.c_mktsegment = 'FURNITURE' AS is_agency,
 c.c_custkey % 13 = 0 AS is_generic, coalesce(o.n,0) AS jobs_found, coalesce(o.f,0) AS flutter_jobs, coalesce(o.recent,false) AS launched
 from customer c left join (select o_custkey, count(*) as n, sum(CASE WHEN o_orderpriority='1-URGENT' THEN 1 ELSE 0 END) as f, max(o_orderdate) >= TIMESTAMP '1998-07-01 00:00:00' as recent from orders group by o_custkey) o on o.o_custkey=c.c_custkey)"""


def url_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").selectExpr("page_id", "url as page_url", f"{URL_SAMPLE} as url")


def marked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").selectExpr("page_id", "url", f"{PAGE_MARKERS} as html")


def contact_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(*CONTACT_COLUMNS)


def job_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*JOB_COLUMNS)


def mail_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "regexp_replace(text, 'example[.]com', 'acme.io') as text"
    )


def company_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    per_company = orders.groupBy("o_custkey").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("f"),
        F.expr("max(o_orderdate) >= timestamp'1998-07-01 00:00:00'").alias("recent"),
    )
    return (
        table(spark, sf_dir, "customer")
        .join(per_company, F.col("c_custkey") == F.col("o_custkey"), "left")
        .selectExpr(
            "c_custkey as company_id",
            "case c_custkey % 3 when 0 then true when 1 then false else null end as has_mobile_app",
            "c_mktsegment in ('MACHINERY','AUTOMOBILE') as is_product",
            "c_acctbal > 0 as has_contact",
            "c_acctbal > 5000 as has_email",
            "c_mktsegment = 'FURNITURE' as is_agency",
            "c_custkey % 13 = 0 as is_generic",
            "coalesce(n, 0) as jobs_found",
            "coalesce(f, 0) as flutter_jobs",
            "coalesce(recent, false) as launched",
        )
    )
