"""Hiring, profile and intelligence queries (families H, B, I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadloom.operators import hiring as H
from leadloom.operators import keywords as K
from leadloom.operators import pages as P
from leadloom.operators import profile as B
from leadloom.plans.catalog_leads import sql_display
from leadloom.plans.catalog_pages import ld_pages, sql_links, sql_pieces, sql_unescape
from leadloom.plans.catalog_signals import _quote
from leadloom.plans.inputs import SQL_FEATURES, SQL_JOBS, SQL_PAGES, company_features, job_rows, marked_pages
from leadloom.plans.registry import query, table


def _parsed(spark, sf_dir):
    return P.parse_pages(marked_pages(spark, sf_dir))


@query("h1_ats_provider", f"select page_id, case when contains(lower(html), 'greenhouse.io') then 'Greenhouse' end as provider from {SQL_PAGES}")
def h1(spark, sf_dir):
    return marked_pages(spark, sf_dir).select("page_id", H.ats_provider(F.col("url"), F.col("html")).alias("provider"))


_WORDS = ("the", "ing ", "auxment", "que", "keit", "schaft")


@query(
    "h2_match_keywords",
    "select doc_id, array_to_string(list_filter(["
    + ", ".join(f"case when contains(lower(text), {_quote(w)}) then {_quote(w)} end" for w in sorted(_WORDS, key=len, reverse=True))
    + "], lambda x: x is not null), ',') as hits from documents",
)
def h2(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.array_join(H.match_keywords(F.col("text"), _WORDS), ",").alias("hits")
    )


_W = "(^|[^\\p{L}\\p{N}_])"
_E = "([^\\p{L}\\p{N}_]|$)"


def _sql_word(c: str, word: str) -> str:
    return f"regexp_matches({c}, '{_W}{word}{_E}')"


@query(
    "h3_job_attributes",
    f"""select doc_id, case when {_sql_word('t', 'the')} then 'The' when {_sql_word('t', 'les')} then 'Les' when {_sql_word('t', 'el')} then 'El' end as seniority,
    case when contains(t, 'ation') then true when contains(t, 'keit') or contains(t, 'ment') then false end as remote,
    case when contains(t, 'que') then 'a' when contains(t, 'ing') then 'b' end as employment_type,
    case when contains(t, 'thing') then 'Mobile Engineering' when contains(t, 'eau') then 'Frontend Engineering' when contains(t, 'ung') then 'Engineering' end as department from
    (select doc_id, lower(text) as t from documents)""",
)
def h3(spark, sf_dir):
    text = F.col("text")
    kw = H.match_keywords(text, ("thing", "eau", "ung"))
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        H.seniority(text, ("the", "les", "el")).alias("seniority"),
        H.work_mode(text, ("ation",), ("keit", "ment")).alias("remote"),
        H.employment_type(text, {"a": ("que",), "b": ("ing",)}).alias("employment_type"),
        H.department(kw, ("thing",), ("eau",), ("ung",)).alias("department"),
    )


_SQL_MENU = """(select distinct page_id, url, h, t from (select page_id, url, unnest(regexp_extract_all(html, '<li><a href="([^"]*)"', 1)) as h, unnest(regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a>', 1)) as t from pages)
 where contains(lower(t), 'ios') and length(t) between 4 and 160)"""


@query(
    "h4_extract_jobs",
    f"""select page_id, 'Senior Flutter Engineer' as title, 'https://boards.greenhouse.io/acme/jobs/1' as url, 'Greenhouse' as provider, cast(35 + 2 * 8 + 10 + 15 + 10 as int) as percent, 'Senior' as seniority, 'Mobile Engineering' as department
    from pages where page_id % 8 = 3
    -- words of the menus that hold a keyword are openings, too
    union all select page_id, t, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || h, null, 53, null, 'Mobile Engineering' from {_SQL_MENU}""",
)
def h4(spark, sf_dir):
    rows = H.extract_jobs(_parsed(spark, sf_dir))
    return H.dedupe_page_jobs(rows).select("page_id", "title", "url", "provider", "percent", "seniority", "department")


@query(
    "h4_json_ld_jobs",
    f"select page_id, 'Flutter Engineer' as title, 'https://j.io/' || page_id as url, cast(71 as int) as percent from pages union all select page_id, t, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || h, 53 from {_SQL_MENU}",
)
def h4_ld(spark, sf_dir):
    rows = H.extract_jobs(ld_pages(spark, sf_dir))
    return rows.select("page_id", "title", "url", "percent")


@query(
    "h5_job_confidence",
    """select c_custkey, cast(least(100, 35 + least(40, 8 * (c_custkey % 8)) + case when c_custkey % 2 = 0 then 10 else 0 end + case when c_custkey % 3 = 0 then 15 else 0 end
    + case when c_custkey % 8 > 2 then 10 else 0 end) as int) as percent from customer""",
)
def h5(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey",
        "slice(array('ios', 'android', 'flutter', 'a', 'b', 'c', 'd'), 1, cast(c_custkey % 8 as int)) as kw",
        "c_custkey % 2 = 0 as has_url",
        "case when c_custkey % 3 = 0 then 'Lever' end as provider",
    )
    return rows.select("c_custkey", H.job_confidence(F.col("kw"), F.col("has_url"), F.col("provider")).alias("percent"))


@query(
    "h6_ats_board_rows",
    f"""select page_id, 'Greenhouse careers board' as title, link as url, cast(55 as int) as percent from {sql_links(SQL_PAGES)}
    where contains(lower(link), 'greenhouse.io') and page_id % 16 <> 3""",
)
def h6(spark, sf_dir):
    parsed = _parsed(spark, sf_dir)
    links = P.unnest(parsed, P.page_links(F.col("url")), "link", ["page_id"])
    taken = marked_pages(spark, sf_dir).filter("page_id % 16 = 3").select(
        "page_id", F.lit("https://boards.greenhouse.io/acme/jobs/1/").alias("url")
    )
    return H.ats_board_rows(links, taken, ["page_id"]).select("page_id", "title", "url", "percent")


@query(
    "h7_dedupe_jobs",
    f"""select company_id, title, url, pos, cast(conf_pct as int) as percent from (select *, row_number() over (partition by company_id, lower(url), lower(title) order by conf_pct desc, pos) as rn from {SQL_JOBS}) where rn = 1""",
)
def h7(spark, sf_dir):
    rows = job_rows(spark, sf_dir).withColumnRenamed("conf_pct", "percent")
    return H.dedupe_jobs(rows).select("company_id", "title", "url", "pos", "percent")


def _jobs(spark, sf_dir):
    rows = job_rows(spark, sf_dir).withColumnRenamed("conf_pct", "percent")
    return rows.withColumns(
        {
            "matched_keywords": H.match_keywords(F.col("title")),
            "provider": F.expr("case when pos % 4 = 0 then 'Lever' when pos % 5 = 0 then 'Ashby' end"),
        }
    )


SQL_JOB_REPORT = f"""(select company_id, count(*) as jobs_found, count(*) filter (title = 'Flutter Engineer') as flutter_jobs, count(*) filter (title in ('Flutter Engineer', 'Android Developer')) as mobile_jobs,
 count(*) filter (title = 'Frontend Engineer') as frontend_jobs, count(*) filter (title <> 'Office Manager') as engineering_jobs, coalesce(bool_or(title <> 'Office Manager' and remote), false) as has_remote_engineering,
 arg_max(title, (case title when 'Flutter Engineer' then 200 when 'Android Developer' then 10 else 0 end) * 1000000000000 + conf_pct * 10000000000 + (case title when 'Flutter Engineer' then 2 when 'Office Manager' then 0 else 1 end) * 1000000000 - pos) as best_job, max(conf_pct) as best_percent
 from {SQL_JOBS} group by company_id)"""


@query(
    "h8_hiring_report",
    f"""select c.c_custkey as company_id, coalesce(jobs_found, 0) as jobs_found, coalesce(flutter_jobs, 0) as flutter_jobs, coalesce(mobile_jobs, 0) as mobile_jobs, coalesce(frontend_jobs, 0) as frontend_jobs,
    coalesce(engineering_jobs, 0) as engineering_jobs, coalesce(has_remote_engineering, false) as has_remote_engineering, best_job, p.provider,
    coalesce(engineering_jobs, 0) > 0 or c_custkey % 7 = 0 as has_engineering_careers_page,
    cast(least(100, coalesce(best_percent, case when c_custkey % 7 = 0 then 30 end, 0) + case when p.provider is not null then 10 else 0 end) as int) as percent
    from customer c left join {SQL_JOB_REPORT} j on j.company_id = c.c_custkey left join
    (select company_id, provider from (select company_id, provider, row_number() over (partition by company_id order by count(*) desc, min(pos)) as rn from
      (select company_id, pos, case when pos % 4 = 0 then 'Lever' when pos % 5 = 0 then 'Ashby' end as provider from {SQL_JOBS}) where provider is not null group by company_id, provider) where rn = 1) p on p.company_id = c.c_custkey""",
)
def h8(spark, sf_dir):
    jobs = _jobs(spark, sf_dir)
    companies = table(spark, sf_dir, "customer").selectExpr("c_custkey as company_id", "c_custkey % 7 = 0 as homepage_keywords")
    return H.hiring_report(jobs, companies, jobs.select("company_id", "provider", "pos")).drop("homepage_keywords")


@query(
    "h9_hiring_summary",
    f"""select f.company_id, coalesce(string_agg(title, '; ' order by rn), case when flutter_jobs > 0 then flutter_jobs || ' Flutter role(s)' when jobs_found > 0 then jobs_found || ' open role(s)' else 'No public job titles detected' end) as hiring_summary
    from {SQL_FEATURES} f left join (select *, row_number() over (partition by company_id order by conf_pct desc, lower(title), pos) as rn from {SQL_JOBS}) j on j.company_id = f.company_id and rn <= 3 group by f.company_id, flutter_jobs, jobs_found""",
)
def h9(spark, sf_dir):
    reports = company_features(spark, sf_dir).select("company_id", "jobs_found", "flutter_jobs", F.lit(0).alias("mobile_jobs"))
    jobs = _jobs(spark, sf_dir)
    return H.hiring_summary(reports, jobs).select("company_id", "hiring_summary")


# --- profile ---------------------------------------------------------------------------------

_TITLE = f"trim({sql_unescape('regexp_extract(html, ' + chr(39) + '<title>([^<]*)</title>' + chr(39) + ', 1)')})"
_HEADED = """CASE page_id % 4 WHEN 0 THEN replace(html, '</head>', '<meta property="og:site_name" content="Acme: the very best site"><meta property="og:description" content="Short but fine"></head>')
 WHEN 1 THEN replace(html, '</head>', '<meta property="og:title" content="Beta | Tools for everyone"><meta name="description" content="tiny"></head>')
 WHEN 2 THEN replace(html, '<nav>', '<header class="hero">Hello  there</header><nav>') ELSE '<html><body><h1>Gamma</h1><h2>A subtitle that fits</h2><main>Main text</main><footer>Since 2015. Located in New Delhi, India</footer></body></html>' END"""


def _headed(spark, sf_dir):
    return P.parse_pages(table(spark, sf_dir, "pages").selectExpr("page_id", "url", f"{_HEADED} as html"))


# The first paragraph; one left open holds all that follow.
_SQL_LEAD = f"trim(regexp_replace({sql_pieces("case when contains(p, '</p>') then string_split(p, '</p>')[1] else tail end")}, '\\s+', ' ', 'g'))"


@query(
    "b1_profile_fields",
    f"""with heads as (select page_id, nullif(trim(regexp_replace({_TITLE}, '\\s+', ' ', 'g')), '') as title, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) as a from pages),
    leads as (select page_id, title, string_split(a, '<p>')[2] as p, array_to_string(string_split(a, '<p>')[2:], '<p>') as tail from heads),
    texts as (select page_id, title, {_SQL_LEAD} as lead from leads)
    select page_id, case page_id % 4 when 0 then 'Acme' when 1 then 'Beta' when 2 then {sql_display('title')} when 3 then 'Gamma' end as company_name,
    case page_id % 4 when 0 then 'Short but fine' when 3 then 'A subtitle that fits' else case when length(lead) between 8 and 160 then lead end end as tagline from texts""",
)
def b1(spark, sf_dir):
    return _headed(spark, sf_dir).select(
        "page_id", B.company_name(P.page_title()).alias("company_name"), B.tagline(P.page_description()).alias("tagline")
    )


@query(
    "b2_page_regions",
    f"""select page_id, case page_id % 4 when 3 then 'Gamma Main text' when 2 then trim(regexp_replace({_TITLE}, '\\s+', ' ', 'g')) || ' Hello there' else trim(regexp_replace({_TITLE}, '\\s+', ' ', 'g')) end as hero,
    case when page_id % 4 = 3 then 'Since 2015. Located in New Delhi, India' else trim(regexp_replace({sql_unescape("regexp_replace(regexp_extract(html, '(?s)<footer>(.*?)</footer>', 1), '<[^>]*>', ' ', 'g')")}, '\\s+', ' ', 'g')) end as footer_text from pages""",
)
def b2(spark, sf_dir):
    return P.page_regions(_headed(spark, sf_dir)).select("page_id", "hero", "footer_text")


@query("b3_primary_cta", "select page_id, case when page_id % 8 = 4 then 'Start free trial' end as cta from pages")
def b3(spark, sf_dir):
    return _parsed(spark, sf_dir).select("page_id", B.primary_cta().alias("cta"))


@query(
    "b4_headquarters_and_year",
    """select page_id, case when page_id % 4 = 3 then 2015 end as founded_year, case when page_id % 4 = 3 then 'New Delhi, India' end as headquarters from pages""",
)
def b4(spark, sf_dir):
    rows = P.page_regions(_headed(spark, sf_dir))
    none = F.lit(None).cast("string")
    return rows.select(
        "page_id",
        B.founded_year(none, F.col("footer_text"), F.col("hero")).alias("founded_year"),
        B.headquarters(none, F.col("footer_text")).alias("headquarters"),
    )


TEXT_RULES = K.rules_of({"alpha": ("whst", "ingea"), "beta": ("schtz", "keit"), "gamma": ("eaux", "ment"), "delta": ("ción",)})


def sql_scores(rules, column="lower(text)", weight=1) -> str:
    return ", ".join(
        "(" + " + ".join(f"cast(contains({column}, {_quote(k)}) as int)" for k in r.keywords) + f") * {r.weight} as s{i}"
        for i, r in enumerate(rules)
    )


def sql_best(rules) -> str:
    top = "greatest(" + ", ".join(f"s{i}" for i in range(len(rules))) + ")"
    return f"case when {top} = 0 then null " + " ".join(f"when s{i} = {top} then {_quote(r.label)}" for i, r in enumerate(rules)) + " end"


@query(
    "b5_classify",
    f"select doc_id, {sql_best(TEXT_RULES)} as label, nullif(cast(greatest(s0, s1, s2, s3) as int), 0) as score from (select doc_id, {sql_scores(TEXT_RULES)} from documents)",
)
def b5(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").withColumn("b", K.best_label(F.lower("text"), TEXT_RULES))
    return rows.select("doc_id", "b.label", "b.score")


@query(
    "b5_rules_from_table",
    f"select doc_id, {sql_best(TEXT_RULES)} as label from (select doc_id, {sql_scores(TEXT_RULES)} from documents)",
)
def b5_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    row = lambda i, j, label, word, weight: (
        f"named_struct('rule_rank', {i}, 'label', {_quote(label)}, 'keyword_rank', {j}, 'keyword', {_quote(word)}, 'weight', {weight})"
    )
    lists = [", ".join(row(i, j, r.label, w, r.weight) for j, w in enumerate(r.keywords)) for i, r in enumerate(TEXT_RULES)]
    cases = " ".join(f"when {i} then array({rows})" for i, rows in enumerate(lists))
    # each region holds one rule; the last ones a rule that no text meets
    rules = table(spark, sf_dir, "region").selectExpr(f"inline(case cast(r_regionkey as int) {cases} else array({row(99, 0, 'none', chr(1), 1)}) end)")
    return K.classify_by_table(docs.select("doc_id", F.lower("text").alias("text")), "text", rules).select("doc_id", "label")


@query("b6_profile_corpus", f"select page_id, lower(url || ' ' || {_TITLE}) as corpus from pages")
def b6(spark, sf_dir):
    rows = P.parse_pages(table(spark, sf_dir, "pages"))
    return rows.select(
        "page_id", B.profile_corpus([F.col("url"), F.lit(""), F.lit(None), P.page_title()]).alias("corpus")
    )


@query(
    "b7_profile_confidence",
    """select c_custkey, round(least(1.0, ((c_custkey % 2 = 0)::int + (c_acctbal > 0)::int + (c_nationkey > 10)::int + 1) / 4.0 + case when c_custkey % 3 = 0 then 0.05 else 0 end), 2) as confidence from customer""",
)
def b7(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    values = [F.expr(x) for x in ("if(c_custkey % 2 = 0, 1, null)", "if(c_acctbal > 0, 1, null)", "if(c_nationkey > 10, 1, null)", "c_name")]
    return rows.select("c_custkey", F.bround(B.profile_confidence(values, F.expr("c_custkey % 3 = 0")), 2).alias("confidence"))


@query("b_company_profiles")
def b_all(spark, sf_dir):
    profiles = P.page_regions(P.page_profiles(_parsed(spark, sf_dir)))
    return B.company_profiles(profiles).select("page_id", *B.PROFILE_FIELDS, "profile_confidence")


# --- intelligence ----------------------------------------------------------------------------

@query(
    "i1_intel_corpus",
    f"""with pg as (select page_id, regexp_extract(url, '://([^/?#]*)', 1) as company_id, {_TITLE} as t, row_number() over (partition by regexp_extract(url, '://([^/?#]*)', 1) order by page_id) as rn from pages)
    select company_id, lower(string_agg(t, ' ' order by rn) filter (t <> '')) as corpus, count(*) as pages_scanned from pg group by company_id""",
)
def i1(spark, sf_dir):
    rows = P.parse_pages(table(spark, sf_dir, "pages")).select(
        F.regexp_extract("url", "://([^/?#]*)", 1).alias("company_id"),
        F.col("page_id").alias("page_rank"),
        F.coalesce(P.page_title(), F.lit("")).alias("intel_text"),
    )
    return B.intel_corpus(rows)


@query(
    "i2_score_label",
    f"select doc_id, {sql_best(TEXT_RULES)} as label, " + " || ".join(
        f"case when s{i} > 0 and s{i} = greatest(s0, s1, s2, s3)" + "".join(f" and s{j} < s{i}" for j in range(i)) + " then " +
        " || ".join(f"case when contains(lower(text), {_quote(k)}) then {_quote(r.label + ':' + k + ';')} else '' end" for k in r.keywords) + " else '' end"
        for i, r in enumerate(TEXT_RULES)
    ) + f" as evidence from (select doc_id, text, {sql_scores(TEXT_RULES)} from documents)",
)
def i2(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").withColumn("b", K.best_label(F.lower("text"), TEXT_RULES))
    evidence = F.array_join(F.transform(K.label_evidence(F.col("b")), lambda e: F.concat(e, F.lit(";"))), "")
    return rows.select("doc_id", "b.label", evidence.alias("evidence"))


_MODEL_RULES = K.rules_of({"SaaS": ("whst", "ingea"), "FinTech": ("schtz", "keit"), "Developer Tool": ("eaux", "ment")})
_STAGE_RULES = K.rules_of({"Growth": ("thing",), "Idea": ("auxqu",)})
_PRICE_RULES = K.rules_of({"Free": ("ungen",), "Paid": ("oion",)})


def _labelled(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "lower(text) || case when doc_id % 10 = 0 then ' for developers' else '' end as corpus",
        "doc_id % 4 = 0 as has_pricing_page", "cast(doc_id % 7 as int) as jobs_found", "case when doc_id % 3 = 0 then 'crypto-wallet' end as first_keyword",
    )
    labelled = B.company_labels(docs, rule_sets={"model": _MODEL_RULES, "stage": _STAGE_RULES, "pricing": _PRICE_RULES})
    return B.label_overrides(labelled)


_SQL_I3 = f"""(select *, case when (m0 is null or m0 = 'SaaS') and doc_id % 10 = 0 then 'Developer Tool' else m0 end as model from
 (select *, {sql_best(_MODEL_RULES)} as m0 from (select doc_id, lower(text) as t, {sql_scores(_MODEL_RULES)} from documents)))"""
_SUBS = "case " + " ".join(f"when contains(t, {_quote(k)}) then {_quote(v)}" for k, v in B.rules.SUBCATEGORIES) + " else model end"


@query(
    "i3_label_overrides",
    f"""select doc_id, model, case when contains(t, 'thing') then 'Growth' when contains(t, 'auxqu') then 'Idea' when doc_id % 7 >= 5 then 'Growth' when doc_id % 7 >= 1 then 'Early Startup' end as stage,
    case when contains(t, 'ungen') then 'Free' when contains(t, 'oion') then 'Paid' when doc_id % 4 = 0 then 'Paid' else 'Unknown' end as pricing,
    case model when 'FinTech' then 'FinTech' when 'Developer Tool' then 'Developer Tools' else case when contains(t, 'fintech') or contains(t, 'payments') then 'FinTech' when contains(t, 'health') then 'Healthcare'
      when contains(t, 'education') or contains(t, 'learning') then 'EdTech' when doc_id % 3 = 0 then 'Crypto-Wallet' end end as industry, {_SUBS.replace('contains(t,', "contains(t || case when doc_id % 10 = 0 then ' for developers' else '' end,")} as subcategory from {_SQL_I3}""",
)
def i3(spark, sf_dir):
    return _labelled(spark, sf_dir).select("doc_id", "model", "stage", "pricing", "industry", "subcategory")


@query(
    "i4_top_keywords",
    f"""select doc_id, token, n, cast(rn as int) as keyword_rank from (select doc_id, token, count(*) as n, row_number() over (partition by doc_id order by count(*) desc, token) as rn from
    (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9-]{{2,}}')) as token from documents) where token not in ({', '.join(_quote(w) for w in B.rules.STOP_WORDS)}) group by doc_id, token) where rn <= 20""",
)
def i4(spark, sf_dir):
    return B.top_keywords(table(spark, sf_dir, "documents"), "doc_id", "text")


_VERSUS = "'x ' || text || ' Better than slackly. vs Jira, unlike the rest, alternative to n' || CAST(doc_id % 5 AS VARCHAR(10)) || 'cloud'"
_SQL_KNOWN = "(values (0, 'Thing'), (1, 'Slackly'), (2, 'Jira'), (3, 'EAUX')) k(r, name)"


@query(
    "i5_competitors",
    f"""select doc_id, string_agg(name, ',' order by o) as names from (select doc_id, name, min(o) as o from (
      select doc_id, i as o, case when n = lower(n) then case when regexp_matches(n, '[0-9]') then upper(n[1:1]) || n[2:2] || upper(n[3:3]) || n[4:] else upper(n[1:1]) || n[2:] end else n end as name from (select doc_id, trim(unnest(ns), ' .,;:') as n, generate_subscripts(ns, 1) as i from
        (select doc_id, regexp_extract_all({_VERSUS}, '(?i)(?:vs\\.?|versus|alternative to|compared to|better than|unlike)\\s+([A-Za-z][A-Za-z0-9&.\\-]*)', 1) as ns from documents)) where lower(n) <> 'the' and length(n) > 2
      union all select doc_id, 1000 + r, name from documents, {_SQL_KNOWN} where contains(lower({_VERSUS}), lower(name))) group by doc_id, name) group by doc_id""",
)
def i5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_VERSUS} as text")
    return docs.select(
        "doc_id", F.array_join(B.competitors(F.col("text"), ("Thing", "Slackly", "Jira", "EAUX")), ",").alias("names")
    )


_PATTERNS = ((r"(?i)(thing|wh)", "P1"), (r"(?i)auxqu", "P2"), (r"(?i)keit", "P1"), (r"(?iu)ción", "P3"))


@query(
    "i6_tag_patterns",
    """select doc_id, array_to_string(list_filter([case when regexp_matches(text, '(?i)(thing|wh)') then 'P1' end, case when regexp_matches(text, '(?i)auxqu') then 'P2' end, case when regexp_matches(text, '(?i)keit') and not regexp_matches(text, '(?i)(thing|wh)') then 'P1' end, case when regexp_matches(text, '(?i)ción') then 'P3' end,
    case when doc_id % 2 = 0 then 'Flutter hiring / mobile engineering demand' end, case when doc_id % 3 = 0 then 'Active engineering hiring' end], lambda x: x is not null), ',') as tags from documents""",
)
def i6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    tags = K.tag_patterns(F.col("text"), _PATTERNS)
    hiring = B.intel_opportunities(F.lit(""), F.expr("cast(doc_id % 2 = 0 as int)"), F.expr("cast(doc_id % 3 = 0 as int)"))
    return docs.select("doc_id", F.array_join(F.concat(tags, hiring), ",").alias("tags"))


@query(
    "i7_team_size_and_maturity",
    f"""select doc_id, case when contains(t, 'global team') then '1000+' when doc_id % 11 >= 8 then '50-200' when contains(t, 'small team') or doc_id % 5 >= 3 then '10-50' when contains(t, '1-10 ') then '1-10' when doc_id % 11 > 0 then '10-50' end as team_size,
    case when doc_id % 6 = 0 or doc_id % 4 = 0 then 'Mature' when doc_id % 6 = 1 or doc_id % 4 = 1 then 'Growing' when doc_id % 6 = 2 or doc_id % 4 = 2 then 'Early' when doc_id % 6 = 3 then 'Nascent' end as maturity from
    (select doc_id, lower(text) || case doc_id % 13 when 0 then ' global team' when 1 then ' a small team' when 2 then ' 1-10 ' else '' end as t from documents)""",
)
def i7(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "lower(text) || case doc_id % 13 when 0 then ' global team' when 1 then ' a small team' when 2 then ' 1-10 ' else '' end as t",
        "cast(doc_id % 11 as int) as jobs", "cast(doc_id % 5 as int) as eng",
        "case doc_id % 6 when 0 then 'Scale-up' when 1 then 'Growth' when 2 then 'MVP' when 3 then 'Idea' end as stage",
        "case doc_id % 4 when 0 then 'Acquired' when 1 then 'Series A' when 2 then 'Seed' end as funding",
    )
    return docs.select(
        "doc_id", B.team_size(F.col("t"), F.col("jobs"), F.col("eng")).alias("team_size"), B.maturity(F.col("stage"), F.col("funding")).alias("maturity")
    )


@query(
    "i8_main_product_and_fields",
    "select page_id, 'Org ' || page_id as structured_name, 'Org ' || page_id as main_product, cast(1 as int) as n_fields from pages",
)
def i8(spark, sf_dir):
    rows = B.intel_pages(ld_pages(spark, sf_dir))
    name = F.try_element_at("structured", F.lit("name"))
    return rows.select(
        "page_id",
        name.alias("structured_name"),
        B.main_product(name, P.first_text(P.tagged("h1")), P.page_title()).alias("main_product"),
        F.size("structured").alias("n_fields"),
    )


@query(
    "i8_last_fields",
    "select regexp_extract(url, '://([^/?#]*)', 1) as company_id, 'Org ' || max(page_id) as name from pages group by 1",
)
def i8_last(spark, sf_dir):
    rows = ld_pages(spark, sf_dir).select(
        F.regexp_extract("url", "://([^/?#]*)", 1).alias("company_id"), F.col("page_id").alias("page_rank"), B.structured_fields().alias("structured")
    )
    return B.last_fields(rows, "structured", ("name",))


_SQL_CUSTOMER = "case doc_id % 5 when 0 then 'B2B' when 1 then 'B2C' when 2 then 'Enterprise' when 3 then 'Developers' end"


@query(
    "i9_intel_flags",
    f"""select doc_id, coalesce(m = 'SaaS' and c in ('B2B', 'Enterprise', 'Developers'), false) as is_b2b_saas, coalesce(c = 'Enterprise', false) and (m is null or m = 'SaaS') as is_enterprise_software,
    coalesce(m = 'Developer Tool', false) or coalesce(c = 'Developers', false) as is_developer_tools, coalesce(c = 'B2C', false) and (m is null) as is_consumer_only, m is not null and c is not null as has_clear_icp from
    (select doc_id, {sql_best(_MODEL_RULES)} as m, {_SQL_CUSTOMER} as c from (select doc_id, {sql_scores(_MODEL_RULES)} from documents))""",
)
def i9(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id", "text", f"{_SQL_CUSTOMER} as c").withColumn(
        "m", K.best_label(F.lower("text"), _MODEL_RULES)["label"]
    )
    return docs.select("doc_id", *[c.alias(n) for n, c in B.intel_flags(F.col("m"), F.col("c")).items()])


@query(
    "i10_intel_confidence",
    """select c_custkey, cast(least(100, 15 + case when c_custkey % 2 = 0 then 20 else 0 end + case when c_custkey % 3 = 0 then 15 else 0 end + case when c_custkey % 5 = 0 then 10 else 0 end
    + case when c_custkey % 7 = 0 then 10 else 0 end + case when c_acctbal > 0 then 10 else 0 end + case when c_nationkey > 1 then 10 else 0 end + case when c_nationkey % 2 = 0 then 5 else 0 end + case when c_custkey % 4 > 0 then 5 else 0 end) as int) as percent from customer""",
)
def i10(spark, sf_dir):
    e = F.expr
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        B.intel_confidence(
            e("if(c_custkey % 2 = 0, 'SaaS', null)"), e("if(c_custkey % 3 = 0, 'B2B', null)"), e("if(c_custkey % 7 = 0, 'Paid', 'Unknown')"),
            e("if(c_custkey % 5 = 0, 'x', null)"), e("c_acctbal > 0"), e("c_nationkey"), e("c_nationkey % 2 = 0"), e("c_custkey % 4"),
        ).alias("percent"),
    )
