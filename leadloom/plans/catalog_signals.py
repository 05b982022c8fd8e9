"""Technology and mobile queries (families T, M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadloom.operators import mobile as M
from leadloom.operators import pages as P
from leadloom.operators import technology as T
from leadloom.plans.catalog_pages import sql_links
from leadloom.plans.inputs import SQL_PAGES, marked_pages
from leadloom.plans.registry import query
from leadloom.rules.technology import APP_PHRASES, TECHNOLOGY_RULES


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


SQL_MARKERS = "(values " + ", ".join(
    f"({rank}, {_quote(r.name)}, {_quote(r.category)}, {r.confidence}, {_quote(m)})"
    for rank, r in enumerate(TECHNOLOGY_RULES)
    for m in r.markers
) + ") m(rank, name, category, base, marker)"

SQL_TECH = f"""(select page_id, url, rank, name, category, cast(least(100, base + 5 * (count(*) - 1)) as int) as confidence
 from {SQL_PAGES}, {SQL_MARKERS} where contains(lower(html), lower(marker)) group by page_id, url, rank, name, category, base)"""


@query(
    "t1_detect_markers",
    f"select page_id, name, category, 'Found marker: ' || marker as evidence from {SQL_PAGES}, {SQL_MARKERS} where contains(lower(html), lower(marker))",
)
def t1(spark, sf_dir):
    return T.marker_rows(marked_pages(spark, sf_dir))


@query(
    "t2_tech_confidence",
    f"""select page_id, name, confidence, cast(row_number() over (partition by page_id order by confidence desc, rank) - 1 as int) as tech_pos from {SQL_TECH} where confidence >= 80 and name <> 'jQuery'""",
)
def t2(spark, sf_dir):
    enabled = [r.name for r in TECHNOLOGY_RULES if r.name != "jQuery"]
    found = T.detect_technologies(marked_pages(spark, sf_dir), minimum=80, enabled=enabled)
    return T.technology_rows(found).select("page_id", "name", "confidence", "tech_pos")


@query(
    "t3_technology_report",
    f"""select p.page_id, cast(count(t.name) as int) as detected_count, coalesce(string_agg(t.name, ',' order by t.confidence desc, t.rank), '') as technologies
    from pages p left join {SQL_TECH} t on t.page_id = p.page_id and t.confidence >= 50 group by p.page_id""",
)
def t3(spark, sf_dir):
    found = T.detect_technologies(marked_pages(spark, sf_dir))
    return found.select(
        "page_id", "detected_count", F.array_join(F.transform("technologies", lambda t: t["name"]), ",").alias("technologies")
    )


_PHRASES = "(values " + ", ".join(f"({_quote(p)})" for p in APP_PHRASES) + ") p(phrase)"


def _mobile(spark, sf_dir, minimum=50):
    parsed = P.parse_pages(marked_pages(spark, sf_dir), keep_html=True)
    return M.detect_mobile(parsed.withColumn("links", P.page_links(F.col("url"))), "html_text", "links", minimum=minimum)


SQL_MOBILE = f"""(select page_id, 'google_play_link' as rule, 95 as percent, 'Google Play link detected: ' || link as evidence, true as android, false as ios from {sql_links(SQL_PAGES)} where contains(lower(link), 'play.google.com')
 union all select page_id, 'download_app_button', 75, 'Found mobile CTA text: ' || phrase, contains(phrase, 'google play'), contains(phrase, 'app store') from {SQL_PAGES}, {_PHRASES} where contains(lower(html), phrase)
 union all select page_id, 'mobile_cta_button', 70, 'Found mobile CTA button: ' || b, true, true from
   (select page_id, unnest(regexp_extract_all(html, '(?i)<a[^>]*>[^<]*(?:download|get the app|open in app|open app)[^<]*</a>')) as b from {SQL_PAGES}))"""


@query("m1_mobile_rules", f"select distinct page_id, rule, cast(percent as int) as percent, evidence, android, ios from {SQL_MOBILE}")
def m1(spark, sf_dir):
    rows = M.mobile_rows(_mobile(spark, sf_dir))
    return rows.select("page_id", "rule", "percent", F.explode("evidence").alias("evidence"), "android", "ios")


@query(
    "m2_mobile_result",
    f"""select p.page_id, count(rule) > 0 as has_mobile_app, cast(coalesce(max(percent), 0) as int) as percent, coalesce(bool_or(android), false) as android, coalesce(bool_or(ios), false) as ios,
    coalesce(string_agg(distinct evidence, '|' order by evidence), '') as evidence from pages p left join {SQL_MOBILE} m on m.page_id = p.page_id and percent >= 75 group by p.page_id""",
)
def m2(spark, sf_dir):
    rows = _mobile(spark, sf_dir, 75)
    return rows.select(
        "page_id", "mobile.has_mobile_app", "mobile.percent", "mobile.android", "mobile.ios", F.array_join("mobile.evidence", "|").alias("evidence")
    )
