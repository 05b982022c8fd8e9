"""Page queries (family P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadloom.functions.html import READ_TAGS
from leadloom.operators import pages as P
from leadloom.plans.catalog_urls import SCHEME, sql_netloc
from leadloom.plans.inputs import SQL_PAGES, marked_pages
from leadloom.plans.registry import query, table
from leadloom.rules import web
from leadloom.sources.pages import scan_pages


def _parsed(spark, sf_dir, marked=False):
    pages = marked_pages(spark, sf_dir) if marked else table(spark, sf_dir, "pages")
    return P.parse_pages(pages)


def sql_unescape(c: str) -> str:
    return f"replace(replace(replace(replace(replace(replace({c}, '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"


def sql_pieces(c: str) -> str:
    split = f"list_transform(regexp_split_to_array({c}, '<[^>]*>'), lambda x: regexp_replace({sql_unescape('x')}, '^\\s+|\\s+$', '', 'g'))"
    return f"array_to_string(list_filter({split}, lambda x: x <> ''), ' ')"


_TAGS = sorted(READ_TAGS)


@query(
    "p1_page_elements",
    "select page_id, tag, cast(n as bigint) as n from (select page_id, t.tag, length(html) - length(regexp_replace(html, '<' || t.tag || '[ >]', repeat('x', length(t.tag) + 1), 'g')) as n from pages, (values "
    + ", ".join(f"('{t}')" for t in _TAGS)
    + ") t(tag)) where n > 0",
)
def p1(spark, sf_dir):
    return P.page_elements(_parsed(spark, sf_dir)).groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@query(
    "z6_html_table_function",
    f"""select page_id, tag, n, text from (select page_id, t.tag, cast(length(html) - length(regexp_replace(html, '<' || t.tag || '[ >]', repeat('x', length(t.tag) + 1), 'g')) as bigint) as n,
     case when t.tag in ('h1', 'title', 'nav', 'footer', 'article') then {sql_pieces("regexp_extract(html, '(?s)<' || t.tag || '>(.*?)</' || t.tag || '>', 1)")} end as text from pages, (values """
    + ", ".join(f"('{t}')" for t in _TAGS)
    + ") t(tag)) where n > 0",
)
def z6(spark, sf_dir):
    """The pages' elements by SQL; equal to the rows of ``page_elements`` and to the tags of the pages."""
    P.register_table_functions(spark)
    table(spark, sf_dir, "pages").createOrReplaceTempView("landed_pages")
    rows = spark.sql("select p.page_id, e.tag, e.text from landed_pages p, lateral page_elements(p.html) e")
    read = F.when(F.col("tag").isin("h1", "title", "nav", "footer", "article"), F.col("text"))
    return rows.groupBy("page_id", "tag").agg(F.count("*").alias("n"), F.max(read).alias("text"))


@query(
    "p2_page_title",
    f"select page_id, trim({sql_unescape('regexp_extract(html, ' + chr(39) + '<title>([^<]*)</title>' + chr(39) + ', 1)')}) as title from pages",
)
def p2(spark, sf_dir):
    return _parsed(spark, sf_dir).select("page_id", P.page_title().alias("title"))


_DESC = """replace(html, '</head>', CASE page_id % 3 WHEN 0 THEN '<meta name="description" content=" About ' || CAST(page_id AS VARCHAR(10)) || ' "><meta property="og:description" content="no"></head>'
 WHEN 1 THEN '<meta content="Graph &amp; more" property="og:description"><meta property="og:title" content="T1"><meta name="twitter:card" content="c"><meta property="og:title" content="T2"><meta name="generator" content="Gen"><link rel="shortcut icon" href="/i.png"><link href="/canon" rel="canonical"></head>' ELSE '</head>' END)"""


def _described(spark, sf_dir):
    return P.parse_pages(table(spark, sf_dir, "pages").selectExpr("page_id", "url", f"{_DESC} as html"))


@query(
    "p3_page_description",
    "select page_id, case page_id % 3 when 0 then 'About ' || page_id when 1 then 'Graph & more' end as description from pages",
)
def p3(spark, sf_dir):
    return _described(spark, sf_dir).select("page_id", P.page_description().alias("description"))


_ORIGIN = f"regexp_extract(url, '^({SCHEME[1:]}//[^/?#]*)', 1)"


@query(
    "p4_canonical_favicon_language",
    f"""select page_id, case when page_id % 3 = 1 then {_ORIGIN} || '/canon' end as canonical_url,
    {_ORIGIN} || case when page_id % 3 = 1 then '/i.png' else '/favicon.ico' end as favicon, nullif(regexp_extract(html, '<html lang="([^"]*)"', 1), '') as language from pages""",
)
def p4(spark, sf_dir):
    base = F.col("url")
    return _described(spark, sf_dir).select(
        "page_id",
        P.canonical_url(base).alias("canonical_url"),
        P.favicon(base).alias("favicon"),
        P.page_language().alias("language"),
    )


@query(
    "p5_social_meta",
    """select page_id, k as name, v as content from pages, (values (0, 'og:description', 'no'), (1, 'og:description', 'Graph & more'), (1, 'og:title', 'T2'), (1, 'twitter:card', 'c')) t(m, k, v) where page_id % 3 = m""",
)
def p5(spark, sf_dir):
    rows = _described(spark, sf_dir).select(
        "page_id", F.map_concat(P.social_meta("property", "og:"), P.social_meta("name", "twitter:")).alias("m")
    )
    return rows.select("page_id", F.explode("m").alias("name", "content"))


_SQL_HREFS = f"""(select page_id, url, h, min(i) as i from (select page_id, url, unnest(hs) as h, generate_subscripts(hs, 1) as i from
 (select page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) as hs from {{pages}})) group by page_id, url, h)"""
_SQL_LINKS = f"""(select page_id, url, i, case when regexp_matches(h, '^https?://') then h else {_ORIGIN} || h end as link from {_SQL_HREFS})"""


def sql_links(pages: str) -> str:
    return _SQL_LINKS.replace("{pages}", pages)


@query(
    "p6_page_links",
    f"select page_id, link, {sql_netloc('link')} = {sql_netloc('url')} as is_internal from {sql_links(SQL_PAGES)}",
)
def p6(spark, sf_dir):
    base = F.col("url")
    internal, external = P.split_links(F.col("links"), base)
    linked = _parsed(spark, sf_dir, True).select("page_id", "url", P.page_links(base).alias("links"))
    rows = linked.select("page_id", internal.alias("i"), external.alias("e"))
    own = rows.select("page_id", F.explode("i").alias("link"), F.lit(True).alias("is_internal"))
    return own.unionByName(rows.select("page_id", F.explode("e").alias("link"), F.lit(False).alias("is_internal")))


_SOCIAL = """html || '<a href="https://www.linkedin.com/in/p' || CAST(page_id AS VARCHAR(10)) || '">x</a><a href="https://x.com/u">y</a><a href="https://nox.com/u">z</a><a href="https://apps.apple.com/a' || CAST(page_id % 3 AS VARCHAR(10)) || '">s</a><a href="https://gist.github.com/q">g</a><a href="mailto:info@a.io?subject=1">m</a><a href="tel:+1 555 0100">t</a>'"""


def _social_pages(spark, sf_dir):
    return P.parse_pages(table(spark, sf_dir, "pages").selectExpr("page_id", "url", f"{_SOCIAL} as html"))


@query(
    "p7_social_links",
    "select page_id, n as network, l as link from pages, lateral (values ('linkedin', 'https://www.linkedin.com/in/p' || page_id), ('twitter', 'https://x.com/u'), ('github', 'https://gist.github.com/q')) t(n, l)",
)
def p7(spark, sf_dir):
    rows = _social_pages(spark, sf_dir).select("page_id", P.social_links(P.page_links(F.col("url"))).alias("m"))
    return rows.select("page_id", F.explode("m").alias("network", "links")).select(
        "page_id", "network", F.explode("links").alias("link")
    )


_GROUPS = {"alpha_pages": ("the", "ing"), "beta_pages": ("que", "aux"), "gamma_pages": ("in", "de")}


@query(
    "p8_special_pages",
    f"select page_id, g as page_group, link from {sql_links('pages')}, (values "
    + ", ".join(f"('{g}', '{'|'.join(w)}')" for g, w in _GROUPS.items())
    + ") t(g, words) where regexp_matches(lower(regexp_extract(link, '://[^/?#]*([^?#]*)', 1)), words)",
)
def p8(spark, sf_dir):
    rows = _parsed(spark, sf_dir).select("page_id", P.special_pages(P.page_links(F.col("url")), _GROUPS).alias("g"))
    pairs = F.array(*[F.struct(F.lit(g).alias("page_group"), F.col(f"g.{g}").alias("links")) for g in _GROUPS])
    return rows.select("page_id", F.explode(pairs).alias("x")).select(
        "page_id", "x.page_group", F.explode("x.links").alias("link")
    )


@query("p9_store_links", "select page_id, 'https://apps.apple.com/a' || (page_id % 3) as link from pages")
def p9(spark, sf_dir):
    rows = _social_pages(spark, sf_dir).select(
        "page_id", P.store_links(P.page_links(F.col("url")), ("apps.apple.com", "itunes.apple.com")).alias("l")
    )
    return rows.select("page_id", F.explode("l").alias("link"))


@query(
    "p10_emails_in_text",
    f"select distinct doc_id, unnest(regexp_extract_all(text, '{web.EMAIL_PATTERN}')) as email from documents",
)
def p10(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(P.emails_in(F.col("text"))).alias("email"))


@query(
    "p10_page_emails_and_phones",
    f"""with t as (select page_id, regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g') as t from pages)
    select page_id, 'email' as kind, lower(unnest(regexp_extract_all(t, '{web.EMAIL_PATTERN}'))) as value from t union select page_id, 'email', 'info@a.io' from pages union select page_id, 'phone', '+1 555 0100' from pages
    union select page_id, 'phone', trim(p) from (select page_id, unnest(regexp_extract_all({sql_unescape('t')}, '{web.PHONE_PATTERN}')) as p from t) where length(regexp_replace(p, '[^0-9]', '', 'g')) between 7 and 15""",
)
def p10_page(spark, sf_dir):
    rows = _social_pages(spark, sf_dir).select("page_id", P.page_emails().alias("e"), P.page_phones().alias("t"))
    named = lambda kind, values: F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    return rows.select("page_id", F.explode(F.concat(named("email", F.col("e")), named("phone", F.col("t")))).alias("x")).select("page_id", "x.*")


@query(
    "p11_phones_in_text",
    f"""select distinct doc_id, trim(p) as phone from (select doc_id, unnest(regexp_extract_all(text || ' call +44 20 7946 0' || (100 + doc_id % 900), '{web.PHONE_PATTERN}')) as p from documents)
    where length(regexp_replace(p, '[^0-9]', '', 'g')) between 7 and 15""",
)
def p11(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "text || ' call +44 20 7946 0' || cast(100 + doc_id % 900 as string) as text"
    )
    return docs.select("doc_id", F.explode(P.phones_in(F.col("text"))).alias("phone"))


@query(
    "p12_server_hints",
    "select page_id, case when page_id % 2 = 1 then 'Express,' else '' end || case when page_id % 3 = 1 then 'Gen,' else '' end || 'nginx' as hints from pages",
)
def p12(spark, sf_dir):
    raw = table(spark, sf_dir, "pages").selectExpr(
        "page_id",
        "case when page_id % 2 = 0 then map('Server', ' nginx ') else map('server', 'nginx', 'X-Powered-By', 'Express') end as headers",
        f"{_DESC} as html",
    )
    return P.parse_pages(raw).select("page_id", F.array_join(P.server_hints(F.col("headers")), ",").alias("hints"))


_SNAP = """page_id, url, CASE WHEN page_id % 7 = 0 THEN ' ' ELSE url END AS final_url, CASE WHEN page_id % 5 = 0 THEN 404 WHEN page_id % 11 = 0 THEN NULL ELSE 200 END AS status,
 CASE WHEN page_id % 13 = 0 THEN NULL WHEN page_id % 3 = 0 THEN '' ELSE html END AS html, CASE WHEN page_id % 4 = 0 THEN ' ' ELSE 'T' END AS title"""


@query(
    "p13_validate_pages",
    f"""select page_id, array_to_string(list_filter([case when html is null then 'HTML download failed' end,
     case when html = '' then 'HTML content is empty' end, case when html is not null and status = 404 then 'Invalid status code: 404' end,
     case when html is not null and trim(final_url) = '' then 'Final URL is missing' end, case when trim(final_url) = '' then 'Final URL is missing' end,
     case when trim(title) = '' then 'Title is missing' end, case when status is null then 'Status code is missing' end, case when status = 404 then 'Invalid status code: 404' end],
     lambda x: x is not null), '; ') as errors,
     coalesce(html <> '', false) and coalesce(status = 200, false) and trim(final_url) <> '' and trim(title) <> '' as valid from (select {_SNAP} from pages)""",
)
def p13(spark, sf_dir):
    snaps = table(spark, sf_dir, "pages").selectExpr(
        "page_id", "url", "case when page_id % 7 = 0 then ' ' else url end as final_url",
        "case when page_id % 5 = 0 then 404 when page_id % 11 = 0 then null else 200 end as status",
        "case when page_id % 13 = 0 then null when page_id % 3 = 0 then '' else html end as html",
        "case when page_id % 4 = 0 then ' ' else 'T' end as title",
    )
    return P.validate_pages(snaps).select("page_id", F.array_join("validation_errors", "; ").alias("errors"), "valid")


_LD = """html || '<script type="application/ld+json">{"@graph":[{"@type":"Organization","name":"Org ' || CAST(page_id AS VARCHAR(10)) || '","address":{"@type":"PostalAddress","addressLocality":"Pune"}},{"@type":["JobPosting","Thing"],"title":"Flutter Engineer","url":"https://j.io/' || CAST(page_id AS VARCHAR(10)) || '"}]}</script><script type="application/ld+json">{broken</script>'"""


def ld_pages(spark, sf_dir):
    return P.parse_pages(table(spark, sf_dir, "pages").selectExpr("page_id", "url", f"{_LD} as html"))


@query(
    "p14_json_ld_items",
    "select page_id, cast(i as int) as item_pos, k as kinds, top, case i when 1 then 'Org ' || page_id end as name from pages, (values (0, '', true), (1, 'Organization', true), (2, 'PostalAddress', false), (3, 'JobPosting,Thing', true)) t(i, k, top)",
)
def p14(spark, sf_dir):
    rows = P.json_ld_items(ld_pages(spark, sf_dir))
    return rows.select(
        "page_id", "item_pos", F.array_join("kinds", ",").alias("kinds"), "top", F.get_json_object("body", "$.name").alias("name")
    )


@query(
    "p15_text_blocks",
    f"""with found as (select page_id, 'li' as tag, unnest(regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a></li>', 1)) as t from pages
     union all select page_id, 'div', unnest(regexp_extract_all(html, '<div class="ad">([^<]*)</div>', 1)) from pages),
    articles as (select page_id, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) as a from pages),
    sized as (select *, {sql_pieces('a')} as whole from articles),
    parts as (select page_id, unnest(string_split(a, '<p>')) as part, unnest(range(length(string_split(a, '<p>')))) as i from sized where length(whole) > 280 and contains(a, '<p>')),
    blocks as (select page_id, tag, trim({sql_unescape('t')}) as block from found
     union all select page_id, 'article', whole from sized where length(whole) <= 280 or not contains(a, '<p>')
     union all select page_id, case when i = 0 then 'article' else 'p' end, {sql_pieces("string_split(part, '</p>')[1]")} from parts)
    select page_id, tag, block, count(*) as n from blocks where block <> '' group by 1, 2, 3""",
)
def p15(spark, sf_dir):
    rows = _parsed(spark, sf_dir).select("page_id", F.explode(P.text_blocks("jobs")).alias("b"))
    return rows.groupBy("page_id", "b.tag", F.col("b.text").alias("block")).agg(F.count("*").alias("n"))


_KEY = "lower(rtrim(url, '/'))"


@query(
    "p16_candidate_pages",
    f"""with snaps as (select {_KEY} as key, min_by(url, page_id) as url from pages where length(html) >= 40 group by 1),
    comp as (select page_id as company_id, url as base_url, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) as origin, lang from
      (select page_id, url, regexp_extract(url, '://[^/]*/([a-z]{{2}})/', 1) as lang from pages)),
    cand as (select company_id, base_url, i, lower(rtrim(u, '/')) as key from comp, lateral (values (0, origin || '/en/10'), (1, origin || '/fr/825?page=2&ref=x'), (2, base_url), (3, origin || '/' || lang)) t(i, u)
      union all select a.page_id, a.url, 4 + row_number() over (partition by a.page_id order by b.page_id), lower(rtrim(b.url, '/')) from pages a join pages b
        on regexp_extract(a.url, '://([^/?#]*)', 1) = regexp_extract(b.url, '://([^/?#]*)', 1) and contains(lower(b.url), '/en/')),
    firsts as (select company_id, key, min(i) as i from cand where key <> lower(rtrim(base_url, '/')) group by 1, 2)
    select company_id, s.url, cast(rn as int) as page_rank from (select f.*, row_number() over (partition by company_id order by i) as rn from firsts f where key in (select key from snaps)) f
    join snaps s on s.key = f.key where rn <= 3""",
)
def p16(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", "://([^/?#]*)", 1).alias("site")
    lang = F.regexp_extract("url", "://[^/]*/([a-z]{2})/", 1)
    origin = F.regexp_extract("url", "^([a-z]+://[^/?#]+)", 1)
    companies = pages.select(
        F.col("page_id").alias("company_id"), F.col("url").alias("base_url"), host, F.array(F.col("url"), F.concat(origin, F.lit("/"), lang)).alias("links")
    )
    site_links = pages.select(host, F.col("page_id").alias("pos"), "url").filter(F.contains(F.lower("url"), F.lit("/en/")))
    return P.candidate_pages(companies, pages, ("/en/10", "/fr/825?page=2&ref=x"), 3, "links", site_links=site_links).select(
        "company_id", "url", "page_rank"
    )


_LAUNCH = """CASE page_id % 5 WHEN 0 THEN '<a data-test="visit-website-button" href="https://site' || CAST(page_id AS VARCHAR(10)) || '.io/?utm_source=p">v</a>'
 WHEN 1 THEN '<a href="/r/X1">r</a><a href="https://github.com/a">g</a><a href="https://ext.io/?ref=1&q=2">e</a>'
 WHEN 2 THEN '<script type="application/ld+json">{"@type":"Product","name":"x","offers":{"url":"https://www.producthunt.com/r/1"}}</script><script type="application/ld+json">{"a":{"siteUrl":"https://ld.io"}}</script>'
 WHEN 3 THEN '<script id="__NEXT_DATA__" type="application/json">{"props":{"website_url":"https://next.io#a"}}</script>'
 ELSE '<meta property="og:url" content="https://www.producthunt.com/posts/a"><meta name="twitter:url" content="https://meta.io">' END"""


@query(
    "p17_resolve_from_snapshot",
    """select page_id, case page_id % 5 when 0 then 'https://site' || page_id || '.io/' when 1 then 'https://ext.io/?q=2' when 2 then 'https://ld.io' when 3 then 'https://next.io' else 'https://meta.io' end as website,
    case page_id % 5 when 0 then 'visit_button' when 1 then 'external_links' when 2 then 'json_ld' when 3 then 'next_data' else 'meta_tags' end as source from pages""",
)
def p17(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").selectExpr("page_id", "'https://www.producthunt.com/posts/p' as url", f"{_LAUNCH} || html as html")
    rows = P.parse_pages(pages).withColumn("s", P.resolve_from_snapshot(F.col("url")))
    return rows.select("page_id", "s.website", "s.source")


@query(
    "p_page_profiles",
    f"""select p.page_id, nullif(trim({sql_unescape("regexp_extract(p.html, '<title>([^<]*)</title>', 1)")}), '') as title, nullif(regexp_extract(p.html, '<html lang="([^"]*)"', 1), '') as language,
    cast(count(l.link) filter ({sql_netloc('l.link')} = {sql_netloc('p.url')}) as int) as n_internal, cast(count(l.link) filter ({sql_netloc('l.link')} <> {sql_netloc('p.url')}) as int) as n_external,
    coalesce(string_agg(l.link, ',' order by l.link) filter (contains(l.link, 'play.google.com')), '') as play
    from {SQL_PAGES} p left join {sql_links(SQL_PAGES)} l on l.page_id = p.page_id group by p.page_id, p.url, p.html""",
)
def profiles(spark, sf_dir):
    return P.page_profiles(P.parse_pages(scan_pages(marked_pages(spark, sf_dir)))).select(
        "page_id", "title", "language", F.size("internal_links").alias("n_internal"), F.size("external_links").alias("n_external"),
        F.array_join("play_store_links", ",").alias("play"),
    )
