"""Feeds, normalization and lead tables (families S, N, L)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from leadloom.functions import naming
from leadloom.operators import leads as L
from leadloom.plans.catalog_urls import CANONICAL, IDENTITY, USABLE, sql_host
from leadloom.plans.inputs import SQL_URLS, url_rows
from leadloom.plans.registry import query, table
from leadloom.rules import web
from leadloom.session import ensure_checkpoint_dir
from leadloom.sources import feeds, normalize, pages as page_sources, store

AS_OF = "2025-01-01 00:00:00"


def _payloads(spark, sf_dir, item: str, wrap: str, extra: str = "''"):
    """One payload per customer with the items k and k+1, so neighbours repeat."""
    base = table(spark, sf_dir, "customer").selectExpr("c_custkey as k", "c_mktsegment as seg")
    one = lambda n: item.replace("$k", f"(k + {n})")
    return base.selectExpr(
        f"to_json({wrap.replace('$items', f'array({one(0)}, {one(1)})')}) as payload",
        "cast(k % 2 as int) as query_rank",
        "cast(k as int) as request_pos",
        f"{extra} as label",
    )


SQL_ITEMS = """(select c_custkey as req, c_custkey % 2 as query_rank, i as item_pos, c_custkey + i as k, c_mktsegment as seg
 from customer, (values (0), (1)) t(i))"""
SQL_FIRST = """(select * from (select *, row_number() over (partition by k order by query_rank, req, item_pos) as rn from %s) where rn = 1)""" % SQL_ITEMS


@query(
    "s1_read_seeds_shape",
    "select s_name as name, 'https://s' || CAST(s_suppkey AS VARCHAR(10)) || '.io' as website, case when s_suppkey % 2 = 0 then 'list' else 'sample_data' end as source from supplier",
)
def s1(spark, sf_dir):
    """Seed files written from the table and read by the seed reader."""
    folder = f"{ensure_checkpoint_dir(spark)}/seeds-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "supplier").selectExpr(
        "s_name as name", "'https://s' || cast(s_suppkey as string) || '.io' as website", "case when s_suppkey % 2 = 0 then 'list' end as source"
    )
    rows.write.json(folder)
    return feeds.read_seeds(spark, folder, lines=True).select("name", "website", "source")


@query(
    "z1_register_source",
    "select s_name as name, 's' || s_suppkey || '.io' as website, 'suppliers' as source, cast(s_suppkey as bigint) as pos from supplier",
)
def z1(spark, sf_dir):
    """A source registered at run time, read out of its landing folder and validated like any other."""
    folder = f"{ensure_checkpoint_dir(spark)}/landing-{uuid.uuid4().hex}"
    table(spark, sf_dir, "supplier").selectExpr("s_name as name", "'https://www.S' || cast(s_suppkey as string) || '.io/' as website", "s_suppkey as pos").write.json(folder)

    @normalize.register_source(" Suppliers ")
    def read(spark, path, as_of):
        return spark.read.schema("name string, website string, pos long").json(path).withColumns({"source": F.lit("suppliers"), "discovered_at": F.lit(as_of)})

    try:
        leads = normalize.source_leads(spark, "suppliers", folder, "2025-07-15 00:00:00")
    finally:
        normalize.SOURCES.pop("suppliers")
    return L.validate_leads(leads).select("name", "website", "source", "pos")


@query(
    "z1_feed_data_source",
    """select 'Site ' || c_custkey as name, 'https://c' || c_custkey || '.io' as website, 'hackernews' as source, c_mktsegment as description,
    c_nationkey::bigint * 10**9 + row_number() over (partition by c_nationkey order by c_custkey) - 1 as pos from customer""",
)
def z1_data_source(spark, sf_dir):
    """Stories of every customer, landed as one payload for each nation and read back through the data source."""
    folder = f"{ensure_checkpoint_dir(spark)}/landing-{uuid.uuid4().hex}"
    story = F.expr("struct(cast(c_custkey as string) as objectID, concat('Show HN: Site ', c_custkey, ' - ', c_mktsegment) as title, concat('https://c', c_custkey, '.io') as url)")
    payloads = table(spark, sf_dir, "customer").groupBy(F.lit(0).alias("query_rank"), F.col("c_nationkey").alias("request_pos"), F.lit("a b").alias("label")).agg(
        F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", story.alias("s")))), lambda x: x["s"]).alias("hits"))).alias("value")
    )
    payloads.repartition("request_pos").write.partitionBy("query_rank", "request_pos", "label").text(folder)
    leads = normalize.payload_leads("hackernews", normalize.feed_rows(spark, "hackernews", folder), AS_OF)
    return leads.select("name", "website", "source", "description", F.col("pos").cast("double").alias("pos"))


PRODUCT_ITEM = """named_struct('node', named_struct('id', cast($k as string), 'name', case when $k % 7 = 0 then null else 'Product ' || cast($k as string) end,
 'tagline', 'Line ' || cast($k as string), 'slug', 'p', 'url', 'https://www.producthunt.com/posts/p' || cast($k as string),
 'website', case when $k % 3 = 0 then 'https://www.producthunt.com/r/R' || cast($k as string) || '?utm_source=a' else 'https://www.p' || cast($k as string) || '.io/?ref=x&b=1' end,
 'createdAt', '2025-07-0' || cast($k % 9 + 1 as string) || 'T10:00:00Z',
 'topics', named_struct('edges', array(named_struct('node', named_struct('name', seg)), named_struct('node', named_struct('name', ''))))))"""
PRODUCT_WRAP = "named_struct('data', named_struct('posts', named_struct('edges', $items)))"


def _products(spark, sf_dir):
    return feeds.flatten_product_launches(_payloads(spark, sf_dir, PRODUCT_ITEM, PRODUCT_WRAP))


@query(
    "s2_flatten_product_launches",
    f"select cast(req as int) as request_pos, cast(k as varchar) as id, seg as topic from {SQL_ITEMS} where k % 7 <> 0",
)
def s2(spark, sf_dir):
    return _products(spark, sf_dir).select("request_pos", "id", F.explode("topics").alias("topic"))


STORY_ITEM = """named_struct('objectID', case when $k % 5 = 0 then '' else cast($k as string) end, 'story_id', cast($k as string),
 'title', 'Show HN: Name' || cast($k as string) || ' – ' || seg || ' tool', 'url', case when $k % 4 = 0 then 'https://blog.x.io' else 'https://h' || cast($k as string) || '.in/a' end,
 'created_at', '2025-07-01T10:00:00Z', 'story_text', 'Made in Pune', 'author', 'a', 'points', 3)"""
STORY_WRAP = "named_struct('hits', $items)"


def _stories(spark, sf_dir):
    return feeds.flatten_stories(_payloads(spark, sf_dir, STORY_ITEM, STORY_WRAP))


@query("s3_flatten_stories", f"select cast(k as varchar) as story_id, cast(req as int) as request_pos, cast(item_pos as int) as item_pos from {SQL_FIRST}")
def s3(spark, sf_dir):
    return _stories(spark, sf_dir).select("story_id", "request_pos", "item_pos")


YC_ITEM = """named_struct('id', case when $k % 3 = 0 then null else $k end, 'slug', 'c' || cast($k as string), 'name', 'Co ' || cast($k as string),
 'website', case when $k % 5 = 0 then '' else 'https://www.y' || cast($k as string) || '.com' end, 'one_liner', case when $k % 2 = 0 then '' else 'One' end, 'long_description', 'Long text',
 'all_locations', case when $k % 4 = 0 then 'Bengaluru, KA' else 'Paris' end, 'regions', array(seg), 'industry', seg, 'tags', array(seg, 'B2B'), 'launched_at', 1700000000 + $k)"""
YC_WRAP = "$items"


def _accelerator(spark, sf_dir):
    raw = _payloads(spark, sf_dir, YC_ITEM, YC_WRAP)
    return feeds.flatten_accelerator(
        raw.withColumn("payload", F.when(F.col("request_pos") % 11 == 0, F.lit("[{broken")).otherwise(F.col("payload")))
    )


SQL_YC = f"""(select * from (select *, row_number() over (partition by k order by query_rank, req, item_pos) as rn from {SQL_ITEMS}
 where k % 5 <> 0 and req % 11 <> 0) where rn = 1)"""


@query("s4_flatten_accelerator", f"select 'c' || k as slug, cast(req as int) as request_pos from {SQL_YC}")
def s4(spark, sf_dir):
    return _accelerator(spark, sf_dir).select("slug", "request_pos")


REPO_ITEM = """named_struct('id', $k, 'name', 'repo' || cast($k as string), 'full_name', 'org/repo' || cast($k as string), 'description', 'Tool, see https://d' || cast($k as string) || '.dev/x).',
 'homepage', case when $k % 3 = 0 then 'https://github.com/org' when $k % 3 = 1 then null else 'https://r' || cast($k as string) || '.co.in' end, 'html_url', 'h',
 'pushed_at', case when $k % 2 = 0 then '2025-06-01T00:00:00Z' else '' end, 'updated_at', '2025-05-01T00:00:00+05:30', 'stargazers_count', $k)"""


def _repositories(spark, sf_dir):
    return feeds.flatten_repositories(_payloads(spark, sf_dir, REPO_ITEM, "named_struct('items', $items)"))


@query("s5_flatten_repositories", f"select 'org/repo' || k as full_name, cast(req as int) as request_pos from {SQL_FIRST}")
def s5(spark, sf_dir):
    return _repositories(spark, sf_dir).select("full_name", "request_pos")


POST_ITEM = """named_struct('data', named_struct('id', cast($k as string), 'title', 'Post ' || cast($k as string), 'selftext', 'text https://t' || cast($k as string) || '.io', 'subreddit', case when $k % 2 = 0 then '' else 'IndianStartups' end,
 'url', 'https://www.reddit.com/r/x', 'url_overridden_by_dest', null, 'created_utc', 1700000000.0D, 'permalink', '/r/x/' || cast($k as string)))"""


def _posts(spark, sf_dir):
    return feeds.flatten_posts(
        _payloads(spark, sf_dir, POST_ITEM, "named_struct('data', named_struct('children', $items))", "'startups'")
    )


@query(
    "s6_flatten_posts",
    f"""select cast(k as varchar) as id, cast(req as int) as request_pos, cast(p as int) as item_pos,
    case when k % 2 = 1 then 'IndianStartups' when query_rank = 0 then '' else 'startups' end as subreddit from (
    select *, row_number() over (partition by k order by query_rank, req, p) as rn from
      (select *, case when query_rank = 0 then -item_pos else item_pos end as p from {SQL_ITEMS})) where rn = 1""",
)
def s6(spark, sf_dir):
    return _posts(spark, sf_dir).select("id", "request_pos", "item_pos", "subreddit")


RSS_TEXT = """case when k % 3 = 0 then '<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><entry><title>Title ' || cast(k as string)
 || '</title><link rel="self" href="https://self.io/"/><link rel="alternate" href="https://f' || cast(k as string) || '.io/a"/><summary>&lt;b&gt;Sum&lt;/b&gt; ' || seg || '</summary><updated>2025-07-01T10:00:00Z</updated></entry></feed>'
 else '<rss version="2.0"><channel><title>c</title><item><title> Title ' || cast(k as string) || '</title><link>https://f' || cast(k as string)
 || '.io/a</link><description><![CDATA[<b>Sum</b> ' || seg || ']]></description><pubDate>Tue, 01 Jul 2025 10:00:00 GMT</pubDate></item><item><title>Second</title><link>https://news.google.com/x</link><description>See https://g' || cast(k as string) || '.io now</description><pubDate>Tue, 01 Jul 2025 15:30:00 +0530</pubDate></item></channel></rss>' end"""


def _feed_items(spark, sf_dir):
    # dealt out before the payloads are built and parsed: a small file of short rows would be one task
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey as k", "c_mktsegment as seg").repartition("k", "seg")
    raw = rows.selectExpr(
        f"{RSS_TEXT} as payload", "0 as query_rank", "cast(k as int) as request_pos", "'https://feed.io/rss' as label"
    )
    return feeds.flatten_feeds(raw)


SQL_FEED = """(select c_custkey as k, 'Title ' || c_custkey as title, 'https://f' || c_custkey || '.io/a' as link, trim(' ' || 'Sum' || ' ' || ' ' || c_mktsegment) as description from customer
 union all select c_custkey, 'Second', 'https://news.google.com/x', 'See https://g' || c_custkey || '.io now' from customer where c_custkey % 3 <> 0)"""


@query("s7_flatten_feeds", f"select cast(k as int) as request_pos, title, link, description from {SQL_FEED}")
def s7(spark, sf_dir):
    return _feed_items(spark, sf_dir).select("request_pos", "title", "link", "description")


@query(
    "s8_scan_pages",
    """select page_id, 'https://' || regexp_replace(url, '^https?://', '') as url, case when page_id % 9 > 0 then length(html) end as n,
    case when page_id % 9 = 0 then 'HTML download failed' when octet_length(encode(html)) > 6000 then 'HTML is too large' end as scan_error from pages""",
)
def s8(spark, sf_dir):
    raw = table(spark, sf_dir, "pages").withColumns(
        {"url": F.regexp_replace("url", "^https?://", ""), "html": F.when(F.col("page_id") % 9 > 0, F.col("html"))}
    )
    return page_sources.scan_pages(raw, max_bytes=6000).select("page_id", "url", F.length("html").cast("bigint").alias("n"), "scan_error")


@query(
    "s9_scan_store",
    """select o_orderkey, o_totalprice from orders where o_orderstatus in ('O', 'P') and o_orderkey < 30000
    and regexp_matches(o_orderpriority, '(?i)urgent|high')""",
)
def s9(spark, sf_dir):
    rows = store.scan_store(
        table(spark, sf_dir, "orders"),
        isin={"o_orderstatus": ["O", "P"]},
        below={"o_orderkey": 30000},
        regex={"o_orderpriority": "(?i)urgent|high"},
    )
    return rows.select("o_orderkey", "o_totalprice")


@query(
    "s10_lookup_default",
    """select c_custkey, coalesce(s.ok, true) as accepts from customer c left join
    (select n_nationkey, bool_and(n_regionkey <> 1) as ok from nation where n_nationkey % 2 = 0 group by 1) s on s.n_nationkey = c.c_nationkey""",
)
def s10(spark, sf_dir):
    answers = table(spark, sf_dir, "nation").filter("n_nationkey % 2 = 0").selectExpr(
        "n_nationkey as c_nationkey", "n_regionkey <> 1 as accepts"
    )
    lookup = feeds.read_lookup(answers, "c_nationkey", "accepts")
    return feeds.with_lookup(table(spark, sf_dir, "customer"), lookup, "c_nationkey", "accepts", True).select(
        "c_custkey", "accepts"
    )


def _out(df, *extra):
    return df.select(
        "name",
        "website",
        "description",
        F.array_join("tags", ",").alias("tags"),
        F.date_format("discovered_at", "yyyy-MM-dd HH:mm:ss").alias("found"),
        "score",
        *extra,
    )


@query(
    "n1_normalize_product_launches",
    f"""select 'Product ' || k as name, case when k % 3 = 0 then 'https://res' || k || '.io' else 'https://www.p' || k || '.io/?b=1' end as website,
    'Line ' || k as description, seg as tags, '2025-07-0' || (k % 9 + 1) || ' 10:00:00' as found, cast(0 as int) as score
    from {SQL_ITEMS} where k % 7 <> 0 and (k % 3 <> 0 or k % 2 = 0)""",
)
def n1(spark, sf_dir):
    answers = table(spark, sf_dir, "customer").selectExpr("explode(array(c_custkey, c_custkey + 1)) as k").distinct().filter(
        "k % 2 = 0"
    ).selectExpr(
        "'https://www.producthunt.com/r/R' || cast(k as string) as redirect", "'https://res' || cast(k as string) || '.io' as website"
    )
    return _out(normalize.normalize_product_launches(_products(spark, sf_dir), answers, AS_OF))


@query(
    "n2_normalize_stories",
    f"""select 'Name' || k as name, 'https://h' || k || '.in/a' as website, seg || ' tool' as description, 'show_hn,india' as tags,
    '2025-07-01 10:00:00' as found, cast(60 as int) as score from {SQL_FIRST} where k % 4 <> 0""",
)
def n2(spark, sf_dir):
    return _out(normalize.normalize_stories(_stories(spark, sf_dir), AS_OF))


_SEPS = "CASE doc_id % 5 WHEN 0 THEN ' – ' WHEN 1 THEN ' — ' WHEN 2 THEN ' - ' WHEN 3 THEN ': ' ELSE '_' END"
_TITLE = f"'Show HN: ' || source || CAST(doc_id AS VARCHAR(10)) || {_SEPS} || text"


def _sql_ws(c: str) -> str:
    return f"trim({c}, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))"


def _sql_cut(c: str, sep: str) -> tuple[str, str, str]:
    has = f"contains({c}, '{sep}')"
    left = _sql_ws(f"substr({c}, 1, instr({c}, '{sep}') - 1)")
    right = _sql_ws(f"substr({c}, instr({c}, '{sep}') + {len(sep)})")
    return has, left, right


def _sql_show(part: int) -> str:
    out = "case"
    for sep in web.SHOW_SEPARATORS:
        has, left, right = _sql_cut("t", sep)
        out += f" when {has} and {left} <> '' then " + (left if part == 1 else f"nullif({right}, '')")
    return out + (" else t end" if part == 1 else " else null end")


@query(
    "n2_show_title_split",
    f"select doc_id, {_sql_show(1)} as name, {_sql_show(2)} as tagline from (select doc_id, {_sql_ws(f'regexp_replace({_TITLE}, ' + chr(39) + '^Show HN: *' + chr(39) + ', ' + chr(39) * 2 + ')')} as t from documents)",
)
def n2_split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_TITLE} as title")
    return docs.withColumn("t", naming.show_title(F.col("title"))).select("doc_id", "t.name", "t.tagline")


@query(
    "n3_normalize_accelerator",
    f"""select 'Co ' || k as name, 'https://www.y' || k || '.com' as website, case when k % 2 = 0 then 'Long text' else 'One' end as description,
    seg || ',B2B' || case when k % 4 = 0 then ',india' else '' end as tags,
    strftime(make_timestamp((1700000000 + k) * 1000000), '%Y-%m-%d %H:%M:%S') as found, cast(case when k % 4 = 0 then 50 else 0 end as int) as score from {SQL_YC}""",
)
def n3(spark, sf_dir):
    return _out(normalize.normalize_accelerator(_accelerator(spark, sf_dir), AS_OF))


@query(
    "n4_normalize_repositories",
    f"""select 'repo' || k as name, case when k % 3 = 2 then 'https://r' || k || '.co.in' else 'https://d' || k || '.dev/x' end as website,
    'Tool, see https://d' || k || '.dev/x).' as description, 'github' || case when k % 3 = 2 then ',india' else '' end as tags,
    case when k % 2 = 0 then '2025-06-01 00:00:00' else '2025-04-30 18:30:00' end as found, cast(case when k % 3 = 2 then 40 else 0 end as int) as score from {SQL_FIRST}""",
)
def n4(spark, sf_dir):
    return _out(normalize.normalize_repositories(_repositories(spark, sf_dir), AS_OF))


@query(
    "n5_normalize_posts",
    f"""select 'Post ' || k as name, 'https://t' || k || '.io' as website, 'text https://t' || k || '.io' as description,
    'reddit' || case when k % 2 = 1 then ',IndianStartups,india' when query_rank = 0 then '' else ',startups' end as tags, '2023-11-14 22:13:20' as found,
    cast(case when k % 2 = 1 then 40 else 0 end as int) as score from (
    select *, row_number() over (partition by k order by query_rank, req, p) as rn from
      (select *, case when query_rank = 0 then -item_pos else item_pos end as p from {SQL_ITEMS})) where rn = 1""",
)
def n5(spark, sf_dir):
    return _out(normalize.normalize_posts(_posts(spark, sf_dir), AS_OF))


@query(
    "n6_normalize_feed_items",
    f"""select title as name, case when title = 'Second' then 'https://g' || k || '.io' else link end as website, description, 'rss' as tags,
    '2025-07-01 10:00:00' as found, cast(0 as int) as score from {SQL_FEED}""",
)
def n6(spark, sf_dir):
    return _out(normalize.normalize_feed_items(_feed_items(spark, sf_dir), AS_OF))


_TERMS = ("the", "aux", r"en\s+la", "sch")


@query(
    "n7_geo_score",
    r"""select doc_id, cast(case when doc_id % 3 = 0 then 40 else 0 end + case when regexp_matches(lang, '(?i)(^|[^\p{L}\p{N}_])(the|aux|en\s+la|sch)([^\p{L}\p{N}_]|$)') then 50 else 0 end
    + case when regexp_matches(text, '(?i)(^|[^\p{L}\p{N}_])(the|aux|en\s+la|sch)([^\p{L}\p{N}_]|$)') then 20 else 0 end as int) as score from documents""",
)
def n7(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    site = F.expr("'https://d.co.' || case when doc_id % 3 = 0 then 'in' else 'uk' end || '/x'")
    score = naming.geo_score(site, F.col("lang"), F.col("text"), naming.geo_pattern(_TERMS))
    return docs.select("doc_id", score.cast("int").alias("score"))


_DISPLAY = """CASE doc_id % 6 WHEN 0 THEN 'Brand: ' || text WHEN 1 THEN 'Brand  Two — sub ' || source WHEN 2 THEN 'A | b' WHEN 3 THEN 'Long brand name that goes on and on for more than forty: ' || lang || ' - tail end here'
 WHEN 4 THEN text ELSE ' - ' || source END"""


def sql_display(c: str) -> str:
    out = "case"
    for sep in web.TAGLINE_SEPARATORS:
        has, left, right = _sql_cut(c, sep)
        out += f" when {has} and {left} <> '' and length({left}) <= 40 and (length({right}) >= 8 or length({c}) > 35) then {left}"
    return out + f" else {c} end"


@query(
    "n8_clean_display_name",
    f"select doc_id, {sql_display('t')} as name from (select doc_id, trim(regexp_replace({_DISPLAY}, '\\s+', ' ', 'g')) as t from documents)",
)
def n8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_DISPLAY} as raw")
    return docs.select("doc_id", naming.clean_display_name(F.col("raw")).alias("name"))


_SEED = "CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN c_name WHEN 2 THEN c_mktsegment WHEN 3 THEN 'Acme' ELSE 'A much longer brand ' || c_name END"
_PROFILE = "CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN lower(c_name) WHEN 2 THEN c_mktsegment || ' Cloud Suite' WHEN 3 THEN 'Acme Inc' WHEN 4 THEN c_name ELSE 'Bee' END"


@query(
    "n9_prefer_name",
    f"""select c_custkey, case when s = '' and p = '' then 'your company' when p = '' then s when s = '' then p when lower(s) = lower(p) then s
    when contains(lower(p), lower(s)) and length(p) > length(s) + 3 then s when contains(lower(s), lower(p)) and length(s) > length(p) + 3 then p
    when abs(length(p) - length(s)) >= 10 then case when length(s) < length(p) then s else p end else s end as name
    from (select c_custkey, coalesce({_SEED}, '') as s, coalesce({_PROFILE}, '') as p from customer)""",
)
def n9(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{_SEED} as s", f"{_PROFILE} as p")
    return rows.select("c_custkey", naming.prefer_name(F.col("s"), F.col("p")).alias("name"))


# --- leads ---------------------------------------------------------------------------------

def _leads(spark, sf_dir):
    return url_rows(spark, sf_dir).selectExpr(
        "page_id as pos",
        "case when page_id % 9 = 0 then ' ' else 'Site ' || cast(page_id as string) end as name",
        "url as website",
        "case page_id % 3 when 0 then 'a' when 1 then 'b' else 'c' end as source",
        "cast(2 - page_id % 3 as int) as source_rank",
        "cast(page_id % 4 * 20 as int) as score",
    )


SQL_LEADS = f"""(select page_id as pos, case when page_id % 9 = 0 then '' else 'Site ' || page_id end as name, {USABLE} as usable, {IDENTITY} as identity, {CANONICAL} as canonical, {sql_host('url')} as host,
 case page_id % 3 when 0 then 'a' when 1 then 'b' else 'c' end as source, 2 - page_id % 3 as source_rank, page_id % 4 * 20 as score, url from {SQL_URLS})"""


@query(
    "l1_resolve_sources",
    "select source, cast(row_number() over (order by p) as int) as source_rank from (select event_type as source, min(event_id) as p from events group by 1 order by 2 limit 3)",
)
def l1(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    requested = events.selectExpr("' ' || upper(event_type) as name", "event_id as pos")
    return L.resolve_sources(requested, events.selectExpr("event_type as source").distinct(), 3)


@query(
    "l2_union_sources",
    """select event_id, event_type as source, cast(case event_type when 'view' then 1 when 'click' then 2 when 'signup' then 3 when 'purchase' then 4 else 5 end as int) as source_rank from events""",
)
def l2(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    parts = {name: events.filter(F.col("event_type") == name).select("event_id") for name in ("view", "click", "signup", "purchase", "error")}
    return L.union_sources(parts)


@query(
    "l3_validate_leads",
    f"""select source, pos, name, canonical as website from (select *, row_number() over (partition by source, identity order by pos) as rn
    from {SQL_LEADS} where usable and name <> '' and identity <> '') where rn = 1""",
)
def l3(spark, sf_dir):
    return L.validate_leads(_leads(spark, sf_dir)).select("source", "pos", "name", "website")


@query(
    "l4_dedupe_leads",
    f"select identity, pos, source from (select *, row_number() over (partition by identity order by source_rank, pos) as rn from {SQL_LEADS} where identity <> '') where rn = 1",
)
def l4(spark, sf_dir):
    return L.dedupe_leads(_leads(spark, sf_dir)).select("identity", "pos", "source")


@query(
    "l4_dedupe_counts",
    f"""select count(*) as total, count(distinct nullif(identity, '')) as "unique", count(*) - count(distinct nullif(identity, '')) as duplicates_removed from {SQL_LEADS}""",
)
def l4_counts(spark, sf_dir):
    return L.dedupe_counts(_leads(spark, sf_dir))


@query(
    "l5_prioritize",
    """select pos, cast(score as int) as score from (select c_custkey as pos, case when c_custkey % 3 = 0 or c_custkey % 90 = 0 then case when c_mktsegment = 'BUILDING' then 20 else 0 end else c_custkey % 90 end as score from customer)""",
)
def l5(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey as pos",
        "c_nationkey as source_rank",
        "c_mktsegment as source",
        "case when c_custkey % 3 = 0 then 0 else cast(c_custkey % 90 as int) end as score",
    )
    rescored = L.with_score(rows, naming.geo_score(F.lit(""), F.lit(""), F.col("source"), "(?i)building"))
    return L.prioritize(rescored).select("pos", F.col("score").cast("int").alias("score"))


@query(
    "l6_limit_per_source",
    """select o_orderpriority as source, o_orderkey as pos, cast(rn as int) as source_pos from (select *, row_number() over (partition by o_orderpriority order by cast(o_totalprice as int) desc, o_orderkey) as rn from orders)
    where rn <= case when o_orderpriority = '1-URGENT' then 40 else 50 end""",
)
def l6(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr(
        "o_orderpriority as source", "o_orderkey as pos", "cast(o_totalprice as int) as score"
    )
    return L.limit_per_source(rows, {"1-URGENT": 40}, 50).select("source", "pos", "source_pos")


@query("l7_limit_run", "select o_orderkey as pos from orders order by o_orderpriority, o_orderkey limit 80")
def l7(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderpriority as source_rank", "o_orderkey as pos")
    return L.limit_run(rows, 80).select("pos")


@query(
    "l8_count_new",
    """with b as (select c_custkey as pos, c_mktsegment as source, case c_mktsegment when 'BUILDING' then 1 when 'MACHINERY' then 2 when 'FURNITURE' then 3 when 'AUTOMOBILE' then 4 else 5 end as source_rank, 'site' || c_custkey % 400 as website from customer),
    s as (select distinct 'site' || s_suppkey * 3 as website from supplier), f as (select *, row_number() over (partition by website order by source_rank, pos) as rn from b)
    select source, cast(sum(case when rn = 1 and website not in (select website from s) then 1 else 0 end) as bigint) as saved,
    cast(sum(case when rn = 1 and website not in (select website from s) then 0 else 1 end) as bigint) as duplicates from f group by source""",
)
def l8(spark, sf_dir):
    batch = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey as pos",
        "c_mktsegment as source",
        "case c_mktsegment when 'BUILDING' then 1 when 'MACHINERY' then 2 when 'FURNITURE' then 3 when 'AUTOMOBILE' then 4 else 5 end as source_rank",
        "'site' || cast(c_custkey % 400 as string) as website",
    )
    known = table(spark, sf_dir, "supplier").selectExpr("'site' || cast(s_suppkey * 3 as string) as website")
    return L.count_new(batch, known)


@query("l9_filter_qualified", "select c_custkey as company_id from customer where c_acctbal >= 6000")
def l9(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey as company_id", "c_acctbal >= 6000 as qualified")
    return L.filter_qualified(rows.select("company_id"), rows)


@query("l10_enrichment_gate", f"select pos, usable as enrich, cast(case when usable then 0 else 1 end as int) as n_warnings from {SQL_LEADS}")
def l10(spark, sf_dir):
    return L.enrichment_gate(_leads(spark, sf_dir)).select("pos", "enrich", F.size("warnings").alias("n_warnings"))
