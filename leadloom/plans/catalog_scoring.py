"""Scoring and assembly queries (families Q, X, Z)."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadloom.operators import contacts as C
from leadloom.operators import scoring as Q
from leadloom.plans.catalog_people import _WITH_GROUPS, merged_contacts
from leadloom.plans.inputs import SQL_FEATURES, company_features
from leadloom.plans.registry import query, table
from leadloom.rules.scoring import LEAD, ScoreConfig, ScoreRule

AS_OF = "2025-07-15 00:00:00"

_POINTS = ScoreConfig(
    rules=(
        ScoreRule("jobs", 30, "jobs_found > 10", "{p} busy ({jobs_found})"),
        ScoreRule("app", -20, "has_mobile_app", "{p} app"),
        ScoreRule("mail", 60, "has_email", "{p} mail"),
        ScoreRule("note", 0, "is_generic", "generic site", True),
        ScoreRule("contact", 15, "has_contact", "{p} contact"),
    ),
    enabled=frozenset({"jobs", "app", "mail", "note"}),
)


@query(
    "q0_score_signals",
    f"""select company_id, cast(greatest(0, least(100, case when jobs_found > 10 then 30 else 0 end - case when has_mobile_app then 20 else 0 end + case when has_email then 60 else 0 end)) as int) as score,
    array_to_string(list_filter([case when jobs_found > 10 then '+30 busy (' || jobs_found || ')' end, case when has_email then '+60 mail' end], lambda x: x is not null), '; ') as reasons,
    array_to_string(list_filter([case when has_mobile_app then '-20 app' end, case when is_generic then 'generic site' end], lambda x: x is not null), '; ') as warnings from {SQL_FEATURES}""",
)
def q0(spark, sf_dir):
    scored = Q.score_signals(company_features(spark, sf_dir), _POINTS)
    return scored.select("company_id", "score", F.array_join("reasons", "; ").alias("reasons"), F.array_join("warnings", "; ").alias("warnings"))


_QUAL = """c_custkey as company_id, CASE c_custkey % 9 WHEN 0 THEN 'acme' || CAST(c_custkey AS VARCHAR(10)) || '.com' WHEN 1 THEN 'http://x' || CAST(c_custkey AS VARCHAR(10)) || '.io' WHEN 2 THEN 'https://github.com/a/b' WHEN 3 THEN 'https://me.github.io' WHEN 4 THEN ''
  WHEN 5 THEN 'https://blog.x.com' WHEN 6 THEN 'https://www.producthunt.com/r/1' WHEN 7 THEN 'https://demo.y.com' ELSE 'https://z.vercel.app' END as website,
 CASE c_custkey % 4 WHEN 0 THEN 'A long description that goes on about scheduling for busy clinics and teams, really long text.' WHEN 1 THEN 'coming soon' WHEN 2 THEN 'We are hiring a flutter person' ELSE NULL END as description,
 CASE WHEN c_custkey % 5 = 0 THEN TIMESTAMP '2025-07-01 12:00:00' WHEN c_custkey % 5 = 1 THEN TIMESTAMP '2025-01-01 00:00:00' ELSE NULL END as launch_date,
 CASE WHEN c_custkey % 3 = 0 THEN 'https://final.com' ELSE '' END as final_url, c_custkey % 2 = 0 as has_contact_page, c_acctbal > 5000 as has_valid_business_email, c_acctbal > 0 as has_any_contact,
 c_custkey % 7 = 0 as has_mobile_app, CAST(CASE WHEN c_custkey % 11 = 0 THEN 1 ELSE 0 END AS INT) as mobile_jobs, c_custkey % 6 = 0 as is_b2b_saas, c_custkey % 12 = 0 as is_consumer_only,
 CASE WHEN c_custkey % 8 = 0 THEN 'Built with React' ELSE '' END as corpus_text"""

_SQL_HIRE = "(contains(lower(coalesce(nullif(hiring_text, ''), corpus_text)), 'hir') and contains(lower(coalesce(nullif(hiring_text, ''), corpus_text)), '{w}'))"
SQL_QUALIFICATION = f"""(select company_id, cast(greatest(0, least(100, total)) as int) as score, total, usable, website from (select *, case when usable then 10 else 0 end + case when usable and not platform then 12 else 0 end + case when usable and (https or not regexp_matches(website, '^https?://')) then 10 else 0 end
 + case when launch_date = timestamp '2025-07-01 12:00:00' then 10 else 0 end + case when length(d) > 80 then 10 else 0 end + case when has_contact_page then 10 else 0 end + case when has_valid_business_email then 15 else 0 end
 + case when final_url <> '' and usable and not has_mobile_app then 15 else 0 end + case when contains(lower(corpus_text), 'react') then 12 else 0 end + case when contains(lower(d), 'flutter') and false then 25 else 0 end
 + case when mobile_jobs > 0 then 35 else 0 end + case when is_b2b_saas and not is_consumer_only then 10 else 0 end
 - case when m = 2 and not (final_url <> '') then 40 else 0 end - case when m = 3 then 30 else 0 end - case when m = 7 then 20 else 0 end - case when d = 'coming soon' then 20 else 0 end - case when m = 8 then 20 else 0 end
 - case when not has_any_contact and not has_contact_page and final_url <> '' then 15 else 0 end - case when has_mobile_app then 25 else 0 end - case when m = 6 then 50 else 0 end - case when m = 5 then 40 else 0 end as total from
 (select q.*, c_custkey % 9 as m, coalesce(description, '') as d, c_custkey % 9 not in (4, 5, 6) as usable, c_custkey % 9 in (2, 3, 8) as platform, starts_with(case when final_url <> '' then final_url else website end, 'https://') as https from (select c_custkey, {_QUAL} from customer) q)))"""


def _qual_rows(spark, sf_dir):
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey as company_id",
        """case c_custkey % 9 when 0 then 'acme' || cast(c_custkey as string) || '.com' when 1 then 'http://x' || cast(c_custkey as string) || '.io' when 2 then 'https://github.com/a/b' when 3 then 'https://me.github.io' when 4 then ''
        when 5 then 'https://blog.x.com' when 6 then 'https://www.producthunt.com/r/1' when 7 then 'https://demo.y.com' else 'https://z.vercel.app' end as website""",
        """case c_custkey % 4 when 0 then 'A long description that goes on about scheduling for busy clinics and teams, really long text.' when 1 then 'coming soon' when 2 then 'We are hiring a flutter person' else null end as description""",
        "case when c_custkey % 5 = 0 then timestamp'2025-07-01 12:00:00' when c_custkey % 5 = 1 then timestamp'2025-01-01 00:00:00' end as launch_date",
        "case when c_custkey % 3 = 0 then 'https://final.com' else '' end as final_url",
        "c_custkey % 2 = 0 as has_contact_page", "c_acctbal > 5000 as has_valid_business_email", "c_acctbal > 0 as has_any_contact",
        "c_custkey % 7 = 0 as has_mobile_app", "cast(case when c_custkey % 11 = 0 then 1 else 0 end as int) as mobile_jobs",
        "c_custkey % 6 = 0 as is_b2b_saas", "c_custkey % 12 = 0 as is_consumer_only",
        "case when c_custkey % 8 = 0 then 'Built with React' else '' end as corpus_text",
    )


@query(
    "q1_qualification_features",
    """select c_custkey as company_id, coalesce(n, 0) > 0 as has_careers_page, c_custkey % 2 = 0 as has_pricing_page, case when c_custkey % 3 = 0 then 'React' else '' end as technologies, coalesce(n, 0) as flutter_jobs,
    trim(case when c_custkey % 2 = 0 and n is not null then 'Lever ' else '' end || 'about ' || c_mktsegment) as hiring_text, c_name || ' about ' || c_mktsegment || case when c_custkey % 3 = 0 then ' React' else '' end as corpus_text
    from customer left join (select o_custkey, count(*) as n from orders group by 1) o on o_custkey = c_custkey""",
)
def q1(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    leads = customer.selectExpr("c_custkey as company_id", "c_name as name", "'about ' || c_mktsegment as description")
    profiles = customer.filter("c_custkey % 2 = 0").selectExpr("c_custkey as company_id", "array('https://x/pricing') as pricing_pages")
    tech = customer.filter("c_custkey % 3 = 0").selectExpr("c_custkey as company_id", "array('React ', 'React') as technologies")
    hiring = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("company_id")).agg(
        F.count("*").alias("flutter_jobs")
    ).withColumn("jobs_found", F.col("flutter_jobs")).withColumn("provider", F.expr("case when company_id % 2 = 0 then 'Lever' end"))
    rows = Q.qualification_features(leads, profiles=profiles, technology=tech, hiring=hiring)
    out = rows.select(
        "company_id", "has_careers_page", "has_pricing_page", F.array_join("technologies", ",").alias("technologies"), "flutter_jobs", "hiring_text", "corpus_text"
    )
    return out


@query("q2_qualification_score", f"select company_id, score, case when score >= 80 then 'Excellent' when score >= 60 then 'Good' when score >= 40 then 'Fair' else 'Poor' end as band, score >= 60 and (website = '' or usable) as qualified from {SQL_QUALIFICATION}")
def q2(spark, sf_dir):
    return Q.qualification_score(_qual_rows(spark, sf_dir), AS_OF).select("company_id", "score", "band", "qualified")


@query(
    "q3_hiring_mention",
    """select doc_id, case when contains(t, 'ingre') or contains(t, 'ement') then contains(t, 'thing') or contains(t, 'que') else regexp_matches(t, '(^|[^\\p{L}\\p{N}_])(hiring|hire|looking for)([^\\p{L}\\p{N}_].{0,39}|)[^\\p{L}\\p{N}_](thing|que)([^\\p{L}\\p{N}_]|$)') end as hires from
    (select doc_id, lower(text) || case when doc_id % 3 = 0 then ' looking for a new thing' else '' end as t from documents)""",
)
def q3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "text || case when doc_id % 3 = 0 then ' looking for a new thing' else '' end as t"
    )
    return docs.select("doc_id", Q.hiring_mention(F.col("t"), ("thing", "que"), ("ingre", "ement")).alias("hires"))


@query(
    "q4_simple_rules",
    """select c_custkey, cast(20 + case when c_name <> '' and c_custkey % 4 > 0 then 10 else 0 end + case when c_custkey % 3 > 0 then 10 else 0 end + case when c_custkey % 3 = 2 then 15 else 0 end + case when c_acctbal > 0 then 10 else 0 end as int) as score,
    c_custkey % 4 = 0 or c_custkey % 5 in (1, 2) as blocked from customer""",
)
def q4(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey", "case when c_custkey % 4 > 0 then c_name else ' ' end as name",
        "case c_custkey % 5 when 1 then 'http://localhost:3' when 2 then 'https://a.GITHUB.io' else 'https://a.com' end as website",
        "case c_custkey % 3 when 0 then null when 1 then 'short' else 'This one is long enough to earn the bonus points' end as description",
        "case when c_acctbal > 0 then array('x') end as tags",
    )
    return Q.simple_rules(rows).select("c_custkey", "score", "blocked")


_OPP = [
    "company_id", "'https://acme.com' as url", "case when is_generic then 'producthunt' else 'rss' end as source",
    "has_mobile_app", "cast(flutter_jobs as int) as flutter_jobs", "cast(jobs_found as int) as jobs_found", "has_contact as has_founder_contact", "has_email as has_founder_email",
    "is_product as is_b2b_saas", "case when is_agency then 'Growth' when is_generic then 'MVP' end as company_stage",
    "case when company_id % 4 = 0 then array('React') when company_id % 4 = 1 then array('Next.js', 'React Native') else cast(array() as array<string>) end as technologies",
    "case when company_id % 6 = 0 then 'we raised a seed round, backed by yc' else '' end as corpus", "cast(1 as int) as decision_makers_found",
    "cast(2015 + company_id % 12 as int) as founded_year", "company_id % 5 = 0 as has_store_links", "true as has_hiring", "true as has_profile",
]
SQL_OPPORTUNITY = f"""(select *, cast(greatest(0, least(100, total - greatest(0, contact - 25))) as int) as score from (select *,
 case when has_mobile_app = false then 12 else 0 end + case when flutter_jobs > 0 then 40 else 0 end + case when is_product then 12 else 0 end + contact + case when 2025 - (2015 + company_id % 12) between 0 and 5 then 8 else 0 end
 + case when is_agency then 8 when is_generic then 8 else 0 end + case when is_generic then 5 else 0 end + case when company_id % 6 = 0 then 15 + 10 else 0 end + case when jobs_found > 0 then 12 else 0 end
 + case when company_id % 4 in (0, 1) and not app then 10 else 0 end + case when company_id % 4 = 0 then 8 else 0 end + case when company_id % 4 = 1 then 8 + 8 else 0 end - case when app and company_id % 5 = 0 then 30 else 0 end as total from
 (select *, coalesce(has_mobile_app, company_id % 5 = 0) as app, case when has_contact then 12 else 8 end + case when has_email then 15 else 0 end as contact from {SQL_FEATURES})))"""


def _opportunities(spark, sf_dir):
    return Q.opportunity_score(company_features(spark, sf_dir).selectExpr(*_OPP), AS_OF)


@query("q5_opportunity_score", f"select company_id, score, contact > 25 as capped from {SQL_OPPORTUNITY}")
def q5(spark, sf_dir):
    rows = _opportunities(spark, sf_dir)
    return rows.select("company_id", "score", F.exists("warnings", lambda w: w.startswith("Contact signal cap")).alias("capped"))


@query(
    "q6_opportunity_features",
    f"""select company_id, company_id % 4 in (0, 1) as has_web_stack, company_id % 4 = 1 as has_react_native, company_id % 6 = 0 as is_yc, company_id % 6 = 0 as has_funding_news, is_generic as is_product_hunt,
    cast(case when 2015 + company_id % 12 <= 2025 then 10 - company_id % 12 end as int) as age_years, app as has_mobile_app from {SQL_OPPORTUNITY}""",
)
def q6(spark, sf_dir):
    rows = Q.opportunity_signals(company_features(spark, sf_dir).selectExpr(*_OPP), AS_OF)
    return rows.select("company_id", "has_web_stack", "has_react_native", "is_yc", "has_funding_news", "is_product_hunt", "age_years", "has_mobile_app")


_PRIORITY = "case when score >= 85 and flutter_jobs > 0 then 'Critical' when score >= 70 then 'High' when score >= 50 then 'Medium' when score >= 30 then 'Low' else 'Very Low' end"


@query(
    "q7_opportunity_priority",
    f"""select company_id, priority, case when priority = 'Critical' then 'Exceptional' when score >= 70 then 'Strong' when score >= 50 then 'Moderate' when score >= 30 then 'Weak' else 'Negligible' end as level,
    case priority when 'Critical' then 'Send immediately' when 'High' then case when has_email then 'Send founder email' else 'Send immediately' end when 'Medium' then 'Research manually' when 'Low' then 'Wait' else 'Ignore' end as action
    from (select *, {_PRIORITY} as priority from {SQL_OPPORTUNITY})""",
)
def q7(spark, sf_dir):
    return _opportunities(spark, sf_dir).select("company_id", "priority", "level", "action")


@query(
    "q8_lead_signals",
    """select c_custkey as company_id, c_custkey % 3 = 0 or c_custkey % 5 = 0 as recently_launched, c_mktsegment = 'MACHINERY' or c_custkey % 4 = 0 as is_product_company, c_acctbal > 0 as has_founder_or_contact,
    c_mktsegment = 'FURNITURE' or c_custkey % 7 = 0 as is_agency_or_recruitment, c_custkey % 6 in (1, 2, 3) as is_generic_website from customer""",
)
def q8(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey as company_id", "case when c_custkey % 3 = 0 then 'ProductHunt' else 'rss' end as source",
        "case when c_custkey % 5 = 0 then timestamp'2025-06-20 00:00:00' else timestamp'2024-01-01 00:00:00' end as launch_date",
        "case c_mktsegment when 'MACHINERY' then 'API' end as product_type", "case c_mktsegment when 'FURNITURE' then 'Staffing firms' end as industry",
        "case when c_custkey % 4 = 0 then 'a B2B shop' else 'plain' end || case when c_custkey % 7 = 0 then ' digital agency' else '' end as corpus",
        "c_acctbal > 0 as has_named_contact", "case c_custkey % 6 when 1 then '' when 2 then 'https://blog.a.com' when 3 then 'x.carrd.co' else 'https://acme.com' end as website",
    )
    return Q.lead_signals(rows, AS_OF).select(
        "company_id", "recently_launched", "is_product_company", "has_founder_or_contact", "is_agency_or_recruitment", "is_generic_website"
    )


SQL_LEAD_SCORE = f"""(select *, cast(greatest(0, least(100, case when launched then 30 else 0 end + case when has_mobile_app then -30 when not has_mobile_app then 25 else 0 end + case when is_product then 20 else 0 end + case when has_contact then 15 else 0 end + case when has_email then 10 else 0 end
 - case when is_agency then 30 else 0 end - case when is_generic then 20 else 0 end - case when not has_email and not has_contact then 20 else 0 end)) as int) as score from {SQL_FEATURES})"""


def lead_scores(spark, sf_dir):
    rows = company_features(spark, sf_dir).selectExpr(
        "company_id", "launched as recently_launched", "has_mobile_app", "is_product as is_product_company", "has_contact as has_founder_or_contact",
        "has_email as has_valid_email", "is_agency as is_agency_or_recruitment", "is_generic as is_generic_website",
    )
    return Q.lead_score(rows)


@query(
    "q9_lead_score",
    f"""select company_id, score, case when score >= 80 then 'HIGH' when score >= 60 then 'MEDIUM' when score >= 40 then 'LOW' else 'REJECT' end as status, score >= 60 as eligible from {SQL_LEAD_SCORE}""",
)
def q9(spark, sf_dir):
    return lead_scores(spark, sf_dir).select("company_id", "score", "status", "eligible")


@query(
    "q9_band_counts",
    f"select case when score >= 80 then 'HIGH' when score >= 60 then 'MEDIUM' when score >= 40 then 'LOW' else 'REJECT' end as status, count(*) as n from {SQL_LEAD_SCORE} group by 1",
)
def q9_bands(spark, sf_dir):
    return lead_scores(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


@query(
    "q10_validation_lead_score",
    f"select company_id, greatest(0.0, least(100.0, flutter_jobs * 7.0 + least(20.0, jobs_found * 5.0) + least(10.0, cast(jobs_found as double)) - case when has_mobile_app then 15.0 else 0.0 end + case when has_email then 10.0 else 0.0 end)) as score from {SQL_FEATURES}",
)
def q10(spark, sf_dir):
    c = F.col
    return company_features(spark, sf_dir).select(
        "company_id", Q.validation_lead_score(c("flutter_jobs") * 7, c("jobs_found"), c("jobs_found"), c("has_mobile_app"), c("has_email")).alias("score")
    )


@query(
    "q11_count_decision_makers",
    _WITH_GROUPS + """select n_nationkey as company_id, cast(coalesce(nullif(case when n_nationkey % 2 = 0 then n_nationkey else 0 end, 0), k, 0) as bigint) as decision_makers from nation left join
    (select company_id, count(*) filter (lower(role) in ('founder', 'co-founder', 'ceo', 'cto', 'vp engineering', 'engineering manager', 'product manager', 'hiring manager', 'mobile lead', 'owner', 'director')) as k from classed group by 1) d on d.company_id = n_nationkey""",
)
def q11(spark, sf_dir):
    companies = table(spark, sf_dir, "nation").selectExpr("n_nationkey as company_id", "case when n_nationkey % 2 = 0 then n_nationkey else 0 end as decision_makers_found")
    return Q.count_decision_makers(companies, merged_contacts(spark, sf_dir)).select("company_id", "decision_makers")


@query(
    "x1_assemble_leads",
    """select c_custkey as company_id, o.shown as orders_n, s.total as spent, case when c_custkey % 10 = 0 and o.n is not null then 'orders: broken' else '' end as errors from
    customer left join (select o_custkey, case when o_custkey % 10 = 0 then null else count(*) end as shown, count(*) as n from orders group by 1) o on o.o_custkey = c_custkey
    left join (select o_custkey, sum(o_orderkey) % 1000 as total from orders group by 1) s on s.o_custkey = c_custkey""",
)
def x1(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    counts = orders.groupBy(F.col("o_custkey").alias("company_id")).agg(F.count("*").alias("n")).withColumn(
        "error", F.expr("case when company_id % 10 = 0 then 'broken' end")
    )
    spent = orders.groupBy(F.col("o_custkey").alias("company_id")).agg((F.sum("o_orderkey") % 1000).alias("total"))
    companies = table(spark, sf_dir, "customer").selectExpr("c_custkey as company_id")
    rows = Q.assemble_leads(companies, {"orders": counts, "spending": spent})
    return rows.select("company_id", F.col("orders.n").alias("orders_n"), F.col("spending.total").alias("spent"), F.array_join("errors", "; ").alias("errors"))


@query(
    "x2_lead_intelligence",
    _WITH_GROUPS + """select n_nationkey as company_id, b.full_name as best_contact, f.who as primary_founder, coalesce(b.email, e.email) as primary_email, n_regionkey = 1 as is_good_lead from nation
    left join (select * from (select *, row_number() over (partition by company_id order by contact_score desc, first_pos) as rn from classed) where rn = 1) b on b.company_id = n_nationkey
    left join (select company_id, coalesce(full_name, email) as who from (select *, row_number() over (partition by company_id order by contact_score desc, first_pos) as rn from classed where lower(role) in ('founder', 'co-founder', 'ceo', 'owner')) where rn = 1) f on f.company_id = n_nationkey
    left join (select company_id, min(lower(email)) as email from classed group by 1) e on e.company_id = n_nationkey""",
)
def x2(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    contacts = merged_contacts(spark, sf_dir).drop("contact_class")
    qualified = nation.filter("n_nationkey % 2 = 0 or n_regionkey = 1").selectExpr("n_nationkey as company_id", "n_regionkey = 1 as qualified")
    return Q.lead_intelligence(nation.selectExpr("n_nationkey as company_id"), contacts, qualified)


@query(
    "x3_flutter_evidence",
    """select doc_id, doc_id % 9 = 0 or doc_id % 7 = 0 or doc_id % 5 = 0 or regexp_matches(text, '(?i)(^|[^\\p{L}\\p{N}_])(the thand|aux)([^\\p{L}\\p{N}_]|$)') as is_flutter from documents""",
)
def x3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "text", "case when doc_id % 9 = 0 then array('React', ' Flutter ') else array('React') end as tech", "case when doc_id % 7 = 0 then 1 end as jobs",
        "case when doc_id % 5 = 0 then array('the thand seen') else array('x') end as ev",
    )
    c = F.col
    return docs.select("doc_id", Q.flutter_evidence(c("tech"), c("jobs"), c("ev"), c("text"), r"(?iU)\b(the thand|aux)\b").alias("is_flutter"))


@query(
    "z3_score_with_other_weights",
    f"select company_id, cast(greatest(0, least(100, case when launched then 50 else 0 end + case when is_product then 20 else 0 end)) as int) as score from {SQL_FEATURES}",
)
def z3(spark, sf_dir):
    from dataclasses import replace

    config = replace(Q.with_weights(LEAD, {"recently_launched": 50}), enabled=frozenset({"recently_launched", "product_company"}))
    rows = company_features(spark, sf_dir).selectExpr("company_id", "launched as recently_launched", "is_product as is_product_company")
    return Q.score_signals(rows, config).select("company_id", "score")


@query(
    "q_founder_flags",
    "select company_id, coalesce(bool_or(regexp_matches(lower(coalesce(role, '')), 'founder|ceo|owner|chief executive')), false) as has_founder_contact from (select c_nationkey as company_id, CASE c_custkey % 6 WHEN 0 THEN 'founder' WHEN 1 THEN 'CTO' WHEN 2 THEN 'cofounder' WHEN 3 THEN 'support' WHEN 4 THEN NULL ELSE 'Chief Executive Officer' END AS role from customer) group by 1",
)
def q_founders(spark, sf_dir):
    from leadloom.plans.inputs import contact_rows

    return Q.founder_flags(C.with_optional(contact_rows(spark, sf_dir), ("email",))).select("company_id", "has_founder_contact")


@query(
    "z5_total_points",
    f"""select company_id, cast(greatest(0, case when jobs_found > 10 then 30 else 0 end - case when has_mobile_app then 20 else 0 end + case when has_email then 60 else 0 end) as int) as score from {SQL_FEATURES}
    where jobs_found > 10 or has_mobile_app or has_email or is_generic""",
)
def z5(spark, sf_dir):
    return Q.total_points(Q.fired_rows(company_features(spark, sf_dir), _POINTS))
