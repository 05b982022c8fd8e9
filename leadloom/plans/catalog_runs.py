"""Whole-run queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadloom.plans import daily
from leadloom.plans.catalog_pages import sql_links, sql_unescape
from leadloom.plans.catalog_signals import SQL_MARKERS
from leadloom.plans.catalog_urls import sql_host
from leadloom.plans.inputs import SQL_PAGES, marked_pages
from leadloom.plans.registry import query, table

_HOST = sql_host("url")
_TITLE = f"trim({sql_unescape('regexp_extract(html, ' + chr(39) + '<title>([^<]*)</title>' + chr(39) + ', 1)')})"
SQL_SITES = f"""(select * from (select page_id, url, html, {_HOST} as identity, row_number() over (partition by {_HOST} order by page_id) as rn from {SQL_PAGES}
 where {_HOST} <> '' and not starts_with({_HOST}, 'blog.') and not starts_with({_HOST}, 'blogs.')) where rn = 1)"""


@query(
    "site_report",
    f"""select s.identity, s.page_id, nullif({_TITLE}, '') as title, cast(l.n as int) as n_links, t.name as technology, t.category, t.confidence, cast(row_number() over (partition by s.page_id order by t.confidence desc, t.rank) - 1 as int) as tech_pos
    from {SQL_SITES} s join (select page_id, count(distinct link) as n from {sql_links(SQL_PAGES)} group by 1) l on l.page_id = s.page_id
    join (select page_id, rank, name, category, cast(least(100, base + 5 * (count(*) - 1)) as int) as confidence from {SQL_PAGES}, {SQL_MARKERS} where contains(lower(html), lower(marker)) group by page_id, rank, name, category, base) t on t.page_id = s.page_id and t.confidence >= 50""",
)
def site_report(spark, sf_dir):
    return daily.site_report(marked_pages(spark, sf_dir))


def _run(spark, sf_dir):
    pages = marked_pages(spark, sf_dir)
    leads = table(spark, sf_dir, "pages").selectExpr(
        "'Site ' || cast(page_id as string) as name", "regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) as website", "cast(null as string) as description",
        "cast(array() as array<string>) as tags", "timestamp'2025-07-01 00:00:00' as discovered_at", "cast(page_id % 50 as int) as score", "page_id as pos",
        "map('k', 'v') as extra",
    )
    parts = {"a": leads.filter("pos % 2 = 0"), "b": leads.filter("pos % 2 = 1")}
    queue = table(spark, sf_dir, "customer").selectExpr("c_name as company_id", "'SENT' as status", "lower(c_name) || '@x.io' as recipient_email")
    settings = daily.RunSettings(as_of="2025-07-15 00:00:00")
    return daily.daily_run(parts, pages, queue, settings)


@query("daily_run_outcomes")
def run_outcomes(spark, sf_dir):
    return _run(spark, sf_dir)["outcomes"].select(
        "company_id", "website", "lead_score", "status", "opportunity_score", "priority", "qualification_score", "outreach_mode", "outcome", "email_subject"
    )


@query("validation_run_summary")
def validation(spark, sf_dir):
    seeds = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("Site "), F.col("page_id").cast("string")).alias("name"), F.regexp_extract("url", "^([a-z]+://[^/?#]+)", 1).alias("website"),
        F.lit(None).cast("string").alias("description"), F.lit("sample_data").alias("source"),
    )
    return daily.validation_run(seeds, marked_pages(spark, sf_dir), "2025-07-15 00:00:00")["summary"]
