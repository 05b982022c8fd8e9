"""URL queries (family U)."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadloom.functions import urls as U
from leadloom.plans.inputs import SQL_URLS, url_rows
from leadloom.plans.registry import query, table
from leadloom.rules import web

SCHEME = r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"


def sql_trim(c: str) -> str:
    return f"trim({c}, ' ' || chr(9) || chr(10) || chr(13))"


def sql_scheme(c: str) -> str:
    t = sql_trim(c)
    return f"(case when {t} = '' then '' when regexp_matches({t}, '^https?://') then {t} else 'https://' || {t} end)"


def sql_netloc(c: str) -> str:
    return f"lower(regexp_extract({c}, '{SCHEME}//([^/?#]*)', 1))"


def sql_path(c: str) -> str:
    return f"regexp_replace(regexp_extract({c}, '{SCHEME}//[^/?#]*([^?#]*)', 1), ';[^/]*$', '')"


def sql_host(c: str) -> str:
    return f"regexp_replace({sql_netloc(sql_scheme(c))}, '^www[.]', '')"


def sql_in(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def sql_any(parts) -> str:
    return "(" + " or ".join(parts) + ")"


def sql_suffix(host: str, suffixes) -> str:
    return sql_any([f"{host} in {sql_in(suffixes)}"] + [f"ends_with({host}, '.{s}')" for s in suffixes])


HOST = sql_host("url")
PATH = sql_path(sql_scheme("url"))
LAUNCH = f"({HOST} = 'producthunt.com' or ends_with({HOST}, '.producthunt.com'))"
REDIRECT = f"({LAUNCH} and starts_with({PATH}, '/r/'))"
CDN = f"({HOST} <> '' and ({HOST} = 'cloudflare.com' or ends_with({HOST}, '.cloudflare.com') or ends_with({HOST}, '.cloudflareinsights.com') or ends_with({HOST}, '.cf-ipfs.com') or contains(lower({PATH}), '/cdn-cgi/')))"
BLOG = f"(starts_with({HOST}, 'blog.') or starts_with({HOST}, 'blogs.'))"
USABLE = f"({HOST} <> '' and not {LAUNCH} and not {CDN} and not {BLOG})"
IDENTITY = f"(case when {REDIRECT} then 'producthunt.com' || lower(rtrim({PATH}, '/')) else {HOST} end)"
CANONICAL = f"(case when {REDIRECT} then 'https://www.producthunt.com' || rtrim({PATH}, '/') else {HOST} end)"


def _simple(name: str, sql_expr: str, column):
    @query(name, f"select page_id, {sql_expr} as value from {SQL_URLS}")
    def run(spark, sf_dir):
        return url_rows(spark, sf_dir).select("page_id", column(F.col("url")).alias("value"))

    return run


_simple("u1_host_of", HOST, U.host_of)
_simple("u2_normalize_website", HOST, U.normalize_website)
_simple("u4_is_cdn_host", CDN, U.is_cdn_host)
_simple("u5_is_blog_host", BLOG, U.is_blog_host)
_simple("u6_is_usable_website", USABLE, U.is_usable_website)
_simple("u7_website_identity", IDENTITY, U.website_identity)
_simple("u8_canonical_website", CANONICAL, U.canonical_website)


@query(
    "u3_launch_host_and_redirect",
    f"select page_id, {LAUNCH} as is_host, {REDIRECT} as is_redirect from {SQL_URLS}",
)
def u3(spark, sf_dir):
    c = F.col("url")
    return url_rows(spark, sf_dir).select(
        "page_id", U.is_launch_host(c).alias("is_host"), U.is_launch_redirect(c).alias("is_redirect")
    )


_QUERY_KEPT = """array_to_string(list_filter(string_split(regexp_extract(u, '^[^?#]*[?]([^#]*)', 1), '&'),
 lambda p: p <> '' and not starts_with(lower(p), 'utm_') and not starts_with(lower(p), 'ref=')), '&')"""


@query(
    "u9_strip_tracking",
    f"""select page_id, case when launch or kept = '' then head else head || '?' || kept end as value from (
    select page_id, {LAUNCH} as launch, regexp_replace(regexp_extract({sql_trim('url')}, '^([^?#]*)', 1), ';[^/]*$', '') as head,
    {_QUERY_KEPT.replace('(u,', '(' + sql_trim('url') + ',')} as kept from {SQL_URLS})""",
)
def u9(spark, sf_dir):
    return url_rows(spark, sf_dir).select("page_id", U.strip_tracking(F.col("url")).alias("value"))


@query(
    "u10_is_external_company_url",
    f"""select page_id, regexp_matches({sql_trim('url')}, '^https?://') and not {LAUNCH} and {HOST} <> ''
    and not ({HOST} in {sql_in(web.INTERMEDIATE_HOSTS)} or ends_with({HOST}, '.cloudflare.com') or ends_with({HOST}, '.cloudflareinsights.com') or contains(lower({sql_path(sql_trim('url'))}), '/cdn-cgi/'))
    and {HOST} not in {sql_in(web.BLOCKED_EXTERNAL_HOSTS)} as value from {SQL_URLS}""",
)
def u10(spark, sf_dir):
    return url_rows(spark, sf_dir).select("page_id", U.is_external_company_url(F.col("url")).alias("value"))


DOC_LINKS = """text || ' See https://a' || CAST(doc_id % 7 AS VARCHAR(10)) || '.io/x, (http://github.com/u' || CAST(doc_id AS VARCHAR(10)) || ') and HTTPS://A' || CAST(doc_id % 5 AS VARCHAR(10)) || '.io/x.'"""
SQL_DOC_LINKS = f"(select doc_id, {DOC_LINKS} as text from documents)"
_SQL_URLS_IN = """(select doc_id, i, rtrim(u, '.,);]') as u from (select doc_id, unnest(us) as u, generate_subscripts(us, 1) as i from
 (select doc_id, regexp_extract_all(text, '(?i)https?://[^\\s<>"'')\\]]+') as us from %s)))""" % SQL_DOC_LINKS


@query(
    "u11_urls_in_text",
    f"select doc_id, arg_min(u, i) as link from {_SQL_URLS_IN} group by doc_id, lower(u)",
)
def u11(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{DOC_LINKS} as text")
    return docs.select("doc_id", F.explode(U.urls_in(F.col("text"))).alias("link"))


@query(
    "u12_is_blocked_discovery_host",
    f"""select page_id, h = '' or {sql_suffix('h', web.BLOCKED_DISCOVERY_HOSTS)} as value from
    (select page_id, regexp_replace(regexp_replace({sql_netloc('url')}, '^.*@', ''), ':[0-9]*$', '') as h from {SQL_URLS})""",
)
def u12(spark, sf_dir):
    return url_rows(spark, sf_dir).select("page_id", U.is_blocked_discovery_host(F.col("url")).alias("value"))


_SQL_UHOST = f"regexp_replace(regexp_replace({sql_netloc('u')}, '^.*@', ''), ':[0-9]*$', '')"


@query(
    "u13_pick_company_website",
    f"""select d.doc_id, arg_min(u, i) as website from documents d left join (
      select doc_id, i, u, {_SQL_UHOST} as h from (
       select doc_id, 0 as i, case when doc_id % 3 = 0 then 'https://github.com/x' else 'https://s' || CAST(doc_id AS VARCHAR(10)) || '.io' end as u from documents where doc_id % 4 <> 0
       union all select doc_id, i, u from {_SQL_URLS_IN})
      ) c on c.doc_id = d.doc_id and not (h = '' or {sql_suffix('h', web.BLOCKED_DISCOVERY_HOSTS)}) group by d.doc_id""",
)
def u13(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").selectExpr(
        "doc_id",
        "case when doc_id % 4 = 0 then null when doc_id % 3 = 0 then 'https://github.com/x' else 'https://s' || cast(doc_id as string) || '.io' end as homepage",
        f"{DOC_LINKS} as text",
    )
    return docs.select("doc_id", U.pick_company_website([F.col("homepage")], F.col("text")).alias("website"))


HREF = """CASE page_id % 7 WHEN 0 THEN '/a/b?x=1' WHEN 1 THEN 'c/d' WHEN 2 THEN '//cdn.io/x' WHEN 3 THEN '#top'
 WHEN 4 THEN 'https://o.io/p#q/' WHEN 5 THEN 'mailto:a@b.io' ELSE '?page=3' END"""
_ORIGIN = f"regexp_extract(url, '({SCHEME}//[^/?#]*)', 1)".replace("'(^", "'^(")
_SQL_ABS = f"""case when h = '' or regexp_matches(h, '^(#|mailto:|tel:|javascript:)') then null when regexp_matches(h, '{SCHEME}') then h
 when starts_with(h, '//') then regexp_extract(url, '^([a-z]+):', 1) || ':' || h when starts_with(h, '/') then {_ORIGIN} || h
 when starts_with(h, '?') then regexp_extract(url, '^([^?#]*)', 1) || h
 else (case when regexp_matches(url, '{SCHEME}//[^/?#]*/') then regexp_extract(regexp_extract(url, '^([^?#]*)', 1), '^(.*/)', 1) else {_ORIGIN} || '/' end) || h end"""


@query("u14_absolute_url", f"select page_id, {_SQL_ABS} as value from (select page_id, url, {HREF} as h from pages)")
def u14(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").selectExpr("page_id", "url", f"{HREF} as h")
    return rows.select("page_id", U.absolute_url(F.col("h"), F.col("url")).alias("value"))


@query(
    "u15_normalize_job_url",
    f"""select page_id, rtrim(case when regexp_matches(h, '^https?://') then regexp_extract(h, '^([^#]*)', 1)
    when starts_with(h, '/') then {_ORIGIN} || h else {_ORIGIN} || '/' || h end, '/') as value from (select page_id, url, {HREF} as h from pages)""",
)
def u15(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").selectExpr("page_id", "url", f"{HREF} as h")
    return rows.select("page_id", U.normalize_job_url(F.col("h"), F.col("url")).alias("value"))


_PLATFORMS = ("example.com", "spam-farm.example.org", "cloudflare.com")


@query("u16_is_platform_host", f"select page_id, {sql_suffix(HOST, _PLATFORMS)} as value from {SQL_URLS}")
def u16(spark, sf_dir):
    return url_rows(spark, sf_dir).select("page_id", U.is_platform_host(F.col("url"), _PLATFORMS).alias("value"))


_SUFFIXES = (".net", ".in", "farm.example.org")


@query(
    "u17_website_has_suffix",
    f"""select page_id, h <> '' and {sql_any([f"ends_with(h, '{s}')" for s in _SUFFIXES])} as value from
    (select page_id, regexp_replace(regexp_replace({sql_netloc('url')}, '^.*@', ''), ':[0-9]*$', '') as h from {SQL_URLS})""",
)
def u17(spark, sf_dir):
    return url_rows(spark, sf_dir).select("page_id", U.website_has_suffix(F.col("url"), _SUFFIXES).alias("value"))


@query(
    "u_enrich_urls",
    f"""select page_id, {HOST} as host, {IDENTITY} as identity, {CANONICAL} as canonical_website, {USABLE} as is_usable,
    {REDIRECT} as is_launch_redirect from {SQL_URLS}""",
)
def u_all(spark, sf_dir):
    return U.enrich_urls(url_rows(spark, sf_dir)).select(
        "page_id", "host", "identity", "canonical_website", "is_usable", "is_launch_redirect"
    )
