"""Outreach, queue, store and report queries (families O, K, D, R)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from leadloom.functions.urls import is_usable_website
from leadloom.operators import contacts as C
from leadloom.operators import directory as G
from leadloom.operators import outreach as O
from leadloom.operators import queue as K
from leadloom.operators import reports as R
from leadloom.operators import store as D
from leadloom.plans.catalog_people import BEST_CONTACT, _WITH_GROUPS, merged_contacts, sql_valid
from leadloom.plans.catalog_signals import _quote
from leadloom.plans.catalog_urls import CANONICAL, sql_in
from leadloom.plans.inputs import SQL_CONTACTS, SQL_FEATURES, SQL_URLS, company_features, contact_rows, url_rows
from leadloom.plans.registry import query, table
from leadloom.rules import outreach as rules
from leadloom.rules import people
from leadloom.session import ensure_checkpoint_dir


@query(
    "o1_outreach_mode",
    f"select company_id, case when flutter_jobs > 0 or (jobs_found > 0 and is_product) then 'hiring' when not coalesce(has_mobile_app, false) then 'freelance' else 'none' end as mode from {SQL_FEATURES}",
)
def o1(spark, sf_dir):
    c = F.col
    return company_features(spark, sf_dir).select(
        "company_id", O.outreach_mode(c("flutter_jobs"), F.lit(0), c("jobs_found"), c("is_product"), c("has_mobile_app")).alias("mode")
    )


_BOX = "lower(regexp_extract(trim(email), '^([^@+]*)', 1))"
_ALL_GENERIC = tuple(dict.fromkeys(people.SKIP_MAILBOXES + people.HIRING_MAILBOXES))


@query(
    "o2_pick_recipient",
    _WITH_GROUPS + f""", cand as (select company_id, 'contact' as kind, -contact_score as a, first_pos as b, full_name, email from classed where email is not null
      union all select company_id, 'best', 0, 0, full_name, email from ({BEST_CONTACT}) where email is not null and company_id % 3 > 0
      union all select company_id, 'plain', 0, 0, null, lower(email) from clean where email is not null and pos % 2 = 0),
    judged as (select *, company_id % 2 = 0 and {_BOX} in {sql_in(people.HIRING_MAILBOXES)} as box from cand where {sql_valid('lower(email)')} and ((company_id % 2 = 0 and {_BOX} in {sql_in(people.HIRING_MAILBOXES)}) or {_BOX} not in {sql_in(_ALL_GENERIC)})),
    stepped as (select *, case when box and kind = 'plain' then 1 when box and kind = 'contact' then 2 when kind = 'best' then 3 when kind = 'contact' then 4 else 5 end as step from judged)
    select company_id, recipient_name, recipient_email from (select company_id, case when step = 1 then 'Hiring team' else coalesce(split_part(full_name, ' ', 1), 'there') end as recipient_name, email as recipient_email,
      row_number() over (partition by company_id order by step, a, case when kind = 'contact' then b end, length(email), email) as rn from stepped) where rn = 1""",
)
def o2(spark, sf_dir):
    contacts = merged_contacts(spark, sf_dir)
    companies = table(spark, sf_dir, "nation").selectExpr("n_nationkey as company_id", "case when n_nationkey % 2 = 0 then 'hiring' else 'freelance' end as outreach_mode")
    plain = C.normalize_candidates(contact_rows(spark, sf_dir)).filter("email is not null and pos % 2 = 0").selectExpr("company_id", "lower(email) as email")
    best = C.best_contact(contacts).filter("company_id % 3 > 0")  # every third company has not chosen one
    return O.pick_recipient(companies, contacts, best, plain)


_LEAD = [
    "c_custkey as company_id", "c_name as company_name", "case when c_custkey % 3 = 0 then 'We help ' || lower(c_mktsegment) || ' teams ship. Fast!' end as short_description",
    "case when c_custkey % 3 = 1 then 'Tiny' end as description", "case when c_custkey % 5 = 0 then 'API' end as product_type", "case when c_custkey % 4 = 0 then c_mktsegment end as industry",
    "case c_custkey % 3 when 0 then array('React') when 1 then array('React', 'Vue') else array('A', 'B', 'C') end as technologies",
    "case c_custkey % 3 when 0 then true when 1 then false end as has_mobile_app", "c_custkey % 2 = 0 as android", "true as ios", "case when c_custkey % 7 > 0 then c_acctbal > 0 end as qualified",
    "cast(c_custkey % 100 as int) as qualification_score", "array('r1', 'r2') as reasons", "case c_custkey % 3 when 0 then 'none' when 1 then 'hiring' else 'freelance' end as outreach_mode",
    "'Flutter Engineer' as hiring_summary", "case when c_custkey % 2 = 0 then 'Ada' end as contact_name", "c_custkey % 11 = 0 as is_flutter_lead", "true as has_contacts", "c_acctbal > 0 as has_profile",
]


def _lead_texts(spark, sf_dir):
    return O.personalize(table(spark, sf_dir, "customer").selectExpr(*_LEAD))


_SQL_O3 = """select c_custkey as company_id, 'I came across ' || c_name || ' — ' || case when c_custkey % 3 = 0 then 'we help ' || lower(c_mktsegment) || ' teams ship' else 'building ' || case when c_custkey % 5 = 0 then 'API' else 'SaaS platform' end || ' for growing teams' end || '.' as opening,
    case when c_custkey % 3 = 0 then c_name || ' already appears to offer a mobile presence on ' || case when c_custkey % 2 = 0 then 'Google Play and the App Store' else 'the App Store' end || ', so a complementary Flutter engagement may be less urgent.'
      else 'I couldn''t find a mobile app for ' || c_name || ', so I was curious whether mobile is already on your roadmap or still later.' end as mobile_line,
    'Internal stack signals (do not recite in email): ' || case c_custkey % 3 when 0 then 'React' when 1 then 'React and Vue' else 'A, B, and C' end || '.' as technology_line,
    case when c_custkey % 7 = 0 then 'Qualification data was not available for this lead.' when c_acctbal > 0 then 'Qualification passed with a score of ' || c_custkey % 100 || '/100 based on r1 and r2.' else 'Qualification did not pass (score ' || c_custkey % 100 || '/100) based on r1 and r2.' end as qualification_line,
    case when c_custkey % 4 = 0 then c_name || ' appears to be a software company focused on ' || c_mktsegment || '. ' else c_name || ' is a ' || case when c_custkey % 5 = 0 then 'API' else 'SaaS platform' end || ' company. ' end || case c_custkey % 3 when 0 then 'We help ' || lower(c_mktsegment) || ' teams ship. Fast!' when 1 then 'Tiny' else 'Their product focus is still being clarified.' end as company_summary,
    case c_custkey % 3 when 1 then case when c_custkey % 2 = 0 then 'Would Ada be open to a quick note on how I fit the mobile role at ' || c_name || '?' else 'Open to a short intro about the mobile / Flutter opening at ' || c_name || '?' end when 2 then case when c_custkey % 2 = 0 then 'Would Ada be open to a 15-min chat about a scoped Flutter build for ' || c_name || '?' else 'Worth a quick chat about a Flutter MVP for ' || c_name || '?' end
      else case when c_custkey % 2 = 0 then 'Curious if mobile is on the roadmap — open to a short reply either way?' when c_custkey % 11 = 0 then 'Worth a quick chat about a Flutter mobile MVP, or is that off the table for now?' else 'Is mobile something you''re considering for ' || c_name || ', or is it later?' end end as cta,
    cast(greatest(0, 35 + case when c_acctbal > 0 then 15 else 0 end + 5 * (c_custkey % 3 + 1) + case when c_custkey % 7 > 0 then 15 else 0 end + 15 + case when c_custkey % 3 < 2 then 5 else 0 end - case when c_custkey % 3 = 0 then 10 else 0 end
      - 5 * (case when c_custkey % 7 = 0 then 1 else 0 end + case when c_custkey % 3 = 2 then 1 else 0 end + case when c_custkey % 3 = 0 then 1 else 0 end)) as int) as text_percent from customer"""


@query("o3_personalize", _SQL_O3)
def o3(spark, sf_dir):
    return _lead_texts(spark, sf_dir).select(
        "company_id", "opening", "mobile_line", "technology_line", "qualification_line", "company_summary", "cta", "text_percent"
    )


_WITH_APP = "['{c} mobile — next step?', 'noticed {c}''s app', '{c} beyond the current app?', 'flutter angle for {c}?', '{h} — on more devices?', 'saw {c}: {h}?']"
_NO_APP = "['{c} on mobile?', '{c} outside the browser?', 'pocket version of {c}?', 'noticed {c} — mobile yet?', 'native app for {c}?', '{c} on iPhone yet?', '{h} — mobile?', '{c}: {h} on phone?', 'saw {h} — app yet?']"


@query(
    "o4_fallback_email",
    f"""select company_id, case when company_id % 2 = 0 then 'Hi Ada,' else opening end as email_opening, cta as email_cta,
    case when company_id % 2 = 0 then opening || chr(10) || chr(10) else '' end || mobile_line || chr(10) || chr(10) as body_start, true as subject_fits from ({_SQL_O3})""",
)
def o4(spark, sf_dir):
    texts = _lead_texts(spark, sf_dir).withColumns(
        {"product_description": F.concat("company_name", F.lit(" is a "), F.lower("cta")), "contact_first_name": F.coalesce("contact_name", F.lit(""))}
    )
    # The choice of the subject hangs on crc32, which has no SQL twin here; it names the company or its hook in at most nine words.
    mails = O.fallback_emails(texts)
    start = F.concat_ws("\n\n", F.when(F.col("company_id") % 2 == 0, F.col("opening")), F.col("mobile_line"), F.lit(""))
    fits = (F.size(F.split("email_subject", " ")) <= 9) & (
        F.contains("email_subject", F.col("company_name")) | F.contains("email_subject", O.product_keyword(F.col("product_description"), F.col("company_name")))
    )
    return mails.select(
        "company_id", "email_opening", "email_cta", F.when(F.startswith("email_body", start), start).alias("body_start"), fits.alias("subject_fits")
    )


@query(
    "o4_product_keyword",
    """select c_custkey, case c_custkey % 3 when 0 then 'a tool for busy ' || lower(c_mktsegment) when 1 then 'ship ' || c_mktsegment else c_mktsegment end as hook from customer""",
)
def o4_hook(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey", "c_name",
        "case c_custkey % 3 when 0 then c_name || ' is a tool for busy ' || lower(c_mktsegment) || ' people and more. Really' when 1 then 'We are ship ' || c_mktsegment || ' - now' else c_mktsegment || '.' end as d",
    )
    return rows.select("c_custkey", O.product_keyword(F.col("d"), F.col("c_name")).alias("hook"))


@query(
    "o5_check_generated_text",
    """select conv_id, turn, case when turn % 4 = 0 then 'S ' || conv_id end as subject, turn % 4 = 0 as ok from conversations""",
)
def o5(spark, sf_dir):
    raw = """case turn % 4 when 0 then 'Sure: ' || to_json(map('subject', 'S ' || cast(conv_id as string), 'opening', 'Hi', 'body', text, 'cta', 'Ok?')) || ' done'
     when 1 then to_json(map('subject', 'S', 'opening', '', 'body', text, 'cta', 'x')) when 2 then text else '{broken ' || text end"""
    rows = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", f"{raw} as raw")
    parsed = rows.withColumn("m", O.parse_generated(F.col("raw")))
    return parsed.select("conv_id", "turn", F.try_element_at("m", F.lit("subject")).alias("subject"), F.col("m").isNotNull().alias("ok"))


@query(
    "o5_subject_checks",
    """select conv_id, turn, conv_id % 3 = 0 as is_generic, conv_id % 3 = 1 and turn % 2 = 0 as wrong_brand from conversations""",
)
def o5_subject(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").selectExpr(
        "conv_id", "turn", "case conv_id % 3 when 0 then ' Quick  thought on ' || text when 1 then 'about Dojo ' || cast(turn as string) else 'noticed it' end as s",
        "case when turn % 2 = 0 then 'Acme' else 'The DOJO club' end as c",
    )
    return rows.select("conv_id", "turn", O.is_generic_subject(F.col("s")).alias("is_generic"), O.has_wrong_brand(F.col("s"), F.col("c")).alias("wrong_brand"))


_DRAFT = "'Hi {{first_name}},' || chr(10) || text || '   ' || chr(10) || chr(10) || chr(10) || chr(10) || ' {{unknown}}{{ Sender_Name }}'"
_CLEAN_TEXT = """trim(regexp_replace(regexp_replace(case when conv_id % 2 = 0 then 'Hi Ada,' || chr(10) else '' end || text || '   ' || chr(10) || chr(10) || chr(10) || chr(10) || ' Mia', '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9) || chr(13))"""


@query("o6_scrub_placeholders", f"select conv_id, turn, {_CLEAN_TEXT} as text from conversations")
def o6(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").selectExpr(
        "conv_id", "turn", f"{_DRAFT} as text", "case when conv_id % 2 = 0 then 'ada Stone' else '' end as recipient"
    )
    return O.scrub_texts(rows, "text", "recipient", "Mia").select("conv_id", "turn", "text")


@query(
    "o7_compose_body",
    """select conv_id, turn, 'Hello' || chr(10) || chr(10) || trim(regexp_replace(regexp_replace(text, '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9) || chr(13)) || chr(10) || chr(10) || 'Best regards,' || chr(10) || 'Mia West' || chr(10) || 'GitHub: gh' || case when conv_id % 2 = 0 then chr(10) || 'Call or WhatsApp: +1 23' else '' end as body from conversations""",
)
def o7(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    body = O.compose_body(
        F.lit(" Hello "), F.col("text"), F.lit(""), F.lit("Ada"), F.lit("Mia West"), F.lit(""), F.lit("gh"),
        F.expr("case when conv_id % 2 = 0 then '+1 23' else 'none' end"),
    )
    return rows.select("conv_id", "turn", body.alias("body"))


@query(
    "o8_build_prompts",
    """select c_custkey as company_id, greatest(0.0, least(100.0, c_custkey % 100 + 10.0 + (c_custkey % 3 + 1) - case when c_custkey % 3 = 0 then 15.0 else 0.0 end + case when c_custkey % 11 = 0 then 10.0 else 0.0 end)) as prompt_score,
    case c_custkey % 3 when 0 then 'We help ' || lower(c_mktsegment) || ' teams ship. Fast!' when 1 then 'Tiny' else c_name || case when c_custkey % 4 = 0 then ' appears to be a software company focused on ' || c_mktsegment || '. ' else ' is a ' || case when c_custkey % 5 = 0 then 'API' else 'SaaS platform' end || ' company. ' end || 'Their product focus is still being clarified.' end as described from customer""",
)
def o8(spark, sf_dir):
    rows = O.build_prompts(_lead_texts(spark, sf_dir).withColumn("emails_found", F.lit(2)))
    described = F.regexp_extract("prompt", r"What they build \(use this\): ([^\n]*)", 1)
    return rows.select("company_id", "prompt_score", described.alias("described"))


@query(
    "o8_contacts_summary",
    _WITH_GROUPS + """select company_id, coalesce(string_agg(line, '; ' order by rn), 'No contacts discovered') as contacts_summary from (select company_id, rn, case when full_name is not null then split_part(full_name, ' ', 1) || case when role is not null then ' (' || role || ')' else '' end || case when email is not null then ' <' || email || '>' else '' end end as line from
    (select *, row_number() over (partition by company_id order by contact_score desc, contact_priority, first_pos) as rn from classed)) group by company_id""",
)
def o8_contacts(spark, sf_dir):
    return O.contacts_summary(merged_contacts(spark, sf_dir))


# --- queue -----------------------------------------------------------------------------------

_STATUS_SQL = """CASE o_orderpriority WHEN '1-URGENT' THEN 'PENDING' WHEN '2-HIGH' THEN 'APPROVED' WHEN '3-MEDIUM' THEN 'READY_TO_SEND' WHEN '4-NOT SPECIFIED' THEN 'FAILED' ELSE 'SKIPPED' END"""
_QUEUE_COLS = [
    "o_orderkey as queue_id", "'site' || cast(o_custkey % 200 as varchar(10)) || '.com' as company_id", "'c' || cast(o_custkey as varchar(10)) as contact_id", "'P' || cast(o_custkey % 300 as varchar(10)) || '@mail.io' as recipient_email",
    f"{_STATUS_SQL} as status", "o_orderdate as created_at", "cast(o_orderkey % 5 as int) as retry_count",
]
SQL_QUEUE = f"(select {', '.join(_QUEUE_COLS)} from orders)"


def _queue(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr(*_QUEUE_COLS)


@query(
    "k7_edit_drafts",
    f"""select queue_id, status, case when status = 'PENDING' and queue_id % 3 = 0 then 'New ' || queue_id else 'Old' end as subject,
    case when status = 'PENDING' and queue_id % 2 = 0 then 'Body ' || queue_id else 'Text' end as body from {SQL_QUEUE}""",
)
def k7_edits(spark, sf_dir):
    queue = _queue(spark, sf_dir).selectExpr("*", "'Old' as subject", "'Text' as body")
    edits = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as queue_id", "case when o_orderkey % 3 = 0 then concat(' New ', o_orderkey) else ' ' end as subject", "case when o_orderkey % 2 = 0 then concat('Body ', o_orderkey) end as body"
    )
    return K.edit_drafts(queue, edits).select("queue_id", "status", "subject", "body")


@query(
    "k0_append_rows",
    """select c_name as company_id, 'a' || c_custkey || '@x.io' as contact_id, 'A' || c_custkey || '@x.io' as recipient_email, 'PENDING' as status, cast(c_custkey % 100 as double) as lead_score, cast(0 as int) as retry_count,
    true as greeted, true as signed from customer""",
)
def k0(spark, sf_dir):
    texts = _lead_texts(spark, sf_dir).withColumns(
        {"product_description": F.lit("tools"), "contact_first_name": F.lit("Ada"), "website": F.concat(F.lit("https://"), F.col("company_name"), F.lit("/")),
         "recipient_name": F.lit("Ada"), "recipient_email": F.concat(F.lit("A"), F.col("company_id").cast("string"), F.lit("@x.io")), "lead_score": F.col("qualification_score")}
    )
    rows = K.append_rows(O.fallback_emails(texts).drop("company_id"), "Mia")
    return rows.select(
        "company_id", "contact_id", "recipient_email", "status", "lead_score", "retry_count",
        F.startswith(F.col("body"), F.lit("Hi Ada,\n\nI came across ")).alias("greeted"), F.endswith(F.col("body"), F.lit("\n\nBest regards,\nMia")).alias("signed"),
    )


_SITES = "CASE WHEN c_custkey % 3 = 0 THEN 'https://www.Site' || CAST(c_custkey % 400 AS VARCHAR(10)) || '.com/' ELSE 'site' || CAST(c_custkey % 400 AS VARCHAR(10)) || '.com' END"


@query(
    "k1_known_companies",
    f"select c_custkey as pos from customer where 'site' || c_custkey % 400 || '.com' in (select company_id from {SQL_QUEUE} where status in {sql_in(rules.KNOWN_STATUSES)})",
)
def k1(spark, sf_dir):
    leads = table(spark, sf_dir, "customer").selectExpr("c_custkey as pos", f"{_SITES} as website")
    return K.known_companies(leads, _queue(spark, sf_dir))


@query(
    "k2_known_recipients",
    f"select c_custkey, 'p' || c_custkey || '@mail.io' in (select lower(recipient_email) from {SQL_QUEUE} where status in {sql_in(rules.KNOWN_STATUSES)}) as recipient_known from customer",
)
def k2(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey", "' p' || cast(c_custkey as string) || '@MAIL.io' as recipient_email")
    return K.known_recipients(rows, _queue(spark, sf_dir)).select("c_custkey", "recipient_known")


SQL_GATE = f"""(select c.c_custkey as company_id, r.email as recipient_email, c.c_acctbal > 3000 as eligible, c.c_custkey % 4 <> 1 as has_opportunity,
 exists (select 1 from orders o where o.o_custkey = c.c_custkey and o.o_orderstatus = 'O' and o.o_orderpriority = '1-URGENT') as known_company,
 CASE WHEN r.company_id % 5 = 0 THEN false WHEN r.company_id % 5 = 1 THEN NULL ELSE true END AS mx_ok from customer c left join {SQL_CONTACTS} r on r.pos = c.c_custkey)"""
_SQL_OUTCOME = f"""(with g as (select *, case when known_company then 'duplicate' when not has_opportunity then 'no_opportunity' when recipient_email is null then 'no_recipient' end as before,
 case when not coalesce(mx_ok, true) then 'no_mx' when not eligible then 'low_score' end as after from {SQL_GATE}), w as (select lower(recipient_email) as m, min(company_id) as f from g where before is null and after is null group by 1)
 select g.company_id, coalesce(before, case when g.company_id > w.f then 'duplicate_recipient' end, after, 'queued') as outcome from g left join w on w.m = lower(g.recipient_email))"""


def _gate_rows(spark, sf_dir):
    contacts = contact_rows(spark, sf_dir).select(F.col("pos").alias("company_id"), F.col("email").alias("recipient_email"), F.col("company_id").alias("nation"))
    customer = table(spark, sf_dir, "customer").selectExpr("c_custkey as company_id", "c_acctbal > 3000 as eligible", "c_custkey % 4 <> 1 as has_opportunity")
    known = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O' and o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("company_id")).distinct().withColumn("known_company", F.lit(True))
    rows = customer.join(contacts, "company_id", "left").join(known, "company_id", "left")
    return rows.withColumn("mx_ok", F.expr("case when nation % 5 = 0 then false when nation % 5 = 1 then null else true end"))


@query("k3_queue_gate", f"select company_id, outcome from {_SQL_OUTCOME}")
def k3(spark, sf_dir):
    return K.queue_gate(_gate_rows(spark, sf_dir)).select("company_id", "outcome")


@query("k3_gate_outcomes", f"select outcome, count(*) as n from {_SQL_OUTCOME} group by 1")
def k3_counts(spark, sf_dir):
    return K.queue_gate(_gate_rows(spark, sf_dir)).groupBy("outcome").agg(F.count("*").alias("n"))


@query(
    "k4_review_list",
    f"""select queue_id, q.company_id, c.c_name as company_name, status from {SQL_QUEUE} q left join (select 'site' || c_custkey || '.com' as company_id, c_name from customer) c on c.company_id = q.company_id
    where status in {sql_in(rules.REVIEW_STATUSES)}""",
)
def k4(spark, sf_dir):
    companies = table(spark, sf_dir, "customer").selectExpr("'site' || cast(c_custkey as string) || '.com' as company_id", "c_name as company_name")
    return K.review_list(_queue(spark, sf_dir), companies).select("queue_id", "company_id", "company_name", "status")


@query("k5_queue_statistics", f"select s as status, (select count(*) from {SQL_QUEUE} where status = s) as n from (values {', '.join(f'({_quote(s)})' for s in rules.STATUSES)}) t(s)")
def k5(spark, sf_dir):
    return K.queue_statistics(_queue(spark, sf_dir))


@query(
    "k5_queue_statistics_wide",
    "select " + ", ".join(f"count(*) filter (status = {_quote(s)}) as {s.lower()}" for s in rules.STATUSES) + f", count(*) as total from {SQL_QUEUE}",
)
def k5_wide(spark, sf_dir):
    return K.queue_statistics_wide(_queue(spark, sf_dir))


_TARGET = "CASE event_type WHEN 'signup' THEN 'PENDING' WHEN 'view' THEN 'APPROVED' WHEN 'click' THEN 'READY_TO_SEND' WHEN 'purchase' THEN 'SENT' ELSE 'FAILED' END"
_CURRENT = "CASE event_id % 4 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'APPROVED' WHEN 2 THEN 'READY_TO_SEND' ELSE 'SENT' END"
_EDGES = sql_in([f"{a}>{b}" for a, b in rules.TRANSITIONS])
SQL_EVENTS = f"(select event_id, ts, user_id as item_id, {_TARGET} as target from events)"


def queue_events(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr("event_id", "cast(ts as timestamp) as ts", "user_id as item_id", f"{_TARGET} as target")


@query("k6_transition_check", f"select event_id, {_CURRENT} || '>' || {_TARGET} in {_EDGES} as allowed from events")
def k6(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("event_id", f"{_CURRENT} as current", f"{_TARGET} as target")
    return K.transition_check(rows).select("event_id", "allowed")


@query(
    "k7_apply_transitions",
    f"""select event_id as queue_id, case when {_CURRENT} || '>' || {_TARGET} in {_EDGES} then {_TARGET} else {_CURRENT} end as status, cast(case when {_CURRENT} || '>' || {_TARGET} in {_EDGES} and {_TARGET} = 'FAILED' then 1 else 0 end as int) as retry_count,
    case when event_id % 3 > 0 then {_CURRENT} || '>' || {_TARGET} in {_EDGES} end as accepted, case when event_id % 3 > 0 and {_CURRENT} || '>' || {_TARGET} in {_EDGES} and {_TARGET} = 'FAILED' then 'boom' end as error_message from events where event_id % 3 > 0
    union all select event_id, {_CURRENT}, 0, null, null from events where event_id % 3 = 0""",
)
def k7(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    queue = events.selectExpr("event_id as queue_id", f"{_CURRENT} as status", "0 as retry_count", "cast(null as timestamp) as approved_at", "cast(null as timestamp) as sent_at", "cast(null as string) as error_message")
    requests = events.filter("event_id % 3 > 0").selectExpr("event_id as queue_id", f"{_TARGET} as target", "'boom' as error", "event_id as pos")
    return K.apply_transitions(queue, requests, "2025-01-01").select("queue_id", "status", "retry_count", "accepted", "error_message")


_SENDABLE = """CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE CAST(c_custkey AS VARCHAR(10)) END as company_id, 'x' as contact_id, CASE c_custkey % 6 WHEN 0 THEN ' ' WHEN 1 THEN 'nope' WHEN 2 THEN 'info@acme.io' WHEN 3 THEN 'a@n' || CAST(c_nationkey AS VARCHAR(10)) || '.io' WHEN 4 THEN 'jobs@acme.io' ELSE 'b@x.test' END as recipient_email,
 CASE WHEN c_custkey % 10 = 0 THEN '' ELSE 's' END as subject, CASE WHEN c_custkey % 14 = 0 THEN ' ' ELSE 'b' END as body"""
_SQL_SENDABLE_ERROR = f"""case when company_id is null then {_quote(rules.ERROR_IDS)} when trim(recipient_email) = '' then {_quote(rules.ERROR_NO_EMAIL)} when recipient_email = 'nope' then {_quote(rules.ERROR_BAD_EMAIL)} when recipient_email in ('info@acme.io', 'b@x.test') and not {sql_valid('recipient_email')} or recipient_email = 'info@acme.io' then {_quote(rules.ERROR_GENERIC)}
 when subject = '' then {_quote(rules.ERROR_SUBJECT)} when trim(body) = '' then {_quote(rules.ERROR_BODY)} end"""


def _sendable(spark, sf_dir):
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey", "case when c_custkey % 17 = 0 then null else cast(c_custkey as string) end as company_id", "'x' as contact_id",
        "case c_custkey % 6 when 0 then ' ' when 1 then 'nope' when 2 then 'info@acme.io' when 3 then 'a@n' || cast(c_nationkey as string) || '.io' when 4 then 'jobs@acme.io' else 'b@x.test' end as recipient_email",
        "case when c_custkey % 10 = 0 then '' else 's' end as subject", "case when c_custkey % 14 = 0 then ' ' else 'b' end as body",
        "case when c_acctbal > 0 then 'READY_TO_SEND' else 'PENDING' end as status", "c_custkey as queue_id", "c_acctbal as created_at",
        "case when c_nationkey % 3 = 0 then false when c_nationkey % 3 = 1 then true end as mx_ok",
    )


@query("k8_sendable_check", f"select c_custkey, {_SQL_SENDABLE_ERROR} as error from (select c_custkey, {_SENDABLE} from customer)")
def k8(spark, sf_dir):
    return _sendable(spark, sf_dir).select("c_custkey", K.sendable_error().alias("error"))


_SQL_PLAN = f"""(select *, coalesce({_SQL_SENDABLE_ERROR}, case when c_nationkey % 3 = 0 and recipient_email <> 'b@x.test' then 'No MX records for domain ''' || split_part(recipient_email, '@', 2) || '''' end) as error from
 (select c_custkey, c_nationkey, c_acctbal, {_SENDABLE} from customer where c_acctbal > 0 order by c_acctbal, c_custkey limit 500))"""


@query("k9_send_batch_plan", f"select c_custkey as queue_id, case when error is null then 'SENT' else 'FAILED' end as planned, error from {_SQL_PLAN}")
def k9(spark, sf_dir):
    return K.send_batch_plan(_sendable(spark, sf_dir), 500).select("queue_id", "planned", "error")


@query("k9_send_totals", f"select count(*) as attempted, count(*) filter (error is null) as sent, count(*) filter (error is not null) as failed, cast(0 as bigint) as skipped from {_SQL_PLAN}")
def k9_totals(spark, sf_dir):
    return K.send_totals(K.send_batch_plan(_sendable(spark, sf_dir), 500))


@query("k10_retryable_failed", f"select queue_id from {SQL_QUEUE} where status = 'FAILED' and retry_count < 3")
def k10(spark, sf_dir):
    return K.retryable_failed(_queue(spark, sf_dir)).select("queue_id")


@query("k11_queue_slice", f"select queue_id, status from {SQL_QUEUE} where status in ('PENDING', 'APPROVED')")
def k11(spark, sf_dir):
    return K.queue_slice(_queue(spark, sf_dir), "PENDING", "APPROVED").select("queue_id", "status")


# --- store -----------------------------------------------------------------------------------

def _upsert(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    batch = customer.filter("c_custkey % 2 = 0").selectExpr("c_custkey", "c_name", "c_acctbal + 1 as c_acctbal", "'NEW' as c_mktsegment")
    return D.upsert(customer.filter("c_custkey % 3 <> 0"), batch, ["c_custkey"])


SQL_UPSERT = """(select c_custkey, c_name, case when c_custkey % 2 = 0 then c_acctbal + 1 else c_acctbal end as c_acctbal, case when c_custkey % 2 = 0 then 'NEW' else c_mktsegment end as c_mktsegment,
 case when c_custkey % 3 = 0 then 'created' when c_custkey % 2 = 0 then 'updated' else 'kept' end as action from customer where c_custkey % 3 <> 0 or c_custkey % 2 = 0)"""


@query("d1_upsert", f"select * from {SQL_UPSERT}")
def d1(spark, sf_dir):
    return _upsert(spark, sf_dir)


def _ladder(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    target = customer.filter("c_custkey % 3 <> 0").selectExpr("c_custkey as id", "case when c_custkey % 2 = 0 then 'e' || cast(c_custkey as string) || '@x.io' end as email", "c_nationkey as company_id", "c_name as full_name")
    batch = customer.selectExpr(
        "c_custkey as pos", "case when c_custkey % 4 = 0 then 'e' || cast(c_custkey as string) || '@x.io' when c_custkey % 4 = 1 then 'new' || cast(c_custkey % 40 as string) || '@x.io' end as email",
        "c_nationkey as company_id", "case when c_custkey % 7 = 0 then '' when c_custkey % 4 = 1 then 'N' || cast(c_custkey % 40 as string) else c_name end as full_name",
    )
    return D.upsert_ladder(target, batch, [["email"], ["company_id", "full_name"]], "full_name")


SQL_LADDER = """(with t as (select c_custkey as id, case when c_custkey % 2 = 0 then 'e' || c_custkey || '@x.io' end as email, c_nationkey as company_id, c_name as full_name from customer where c_custkey % 3 <> 0),
    b as (select c_custkey as pos, case when c_custkey % 4 = 0 then 'e' || c_custkey || '@x.io' when c_custkey % 4 = 1 then 'new' || c_custkey % 40 || '@x.io' end as email, c_nationkey as company_id, case when c_custkey % 7 = 0 then '' when c_custkey % 4 = 1 then 'N' || c_custkey % 40 else c_name end as full_name from customer),
    m as (select b.*, coalesce(t1.id, t2.id) as matched_id from b left join t t1 on t1.email = b.email left join t t2 on t2.company_id = b.company_id and t2.full_name = b.full_name),
    k as (select *, coalesce('id' || matched_id, 'e' || email, 'n' || company_id || full_name) as ident from m), l as (select ident, max(pos) as last from k where full_name <> '' group by 1)
    select pos, matched_id, case when full_name = '' then 'skipped' when pos < last then 'duplicate' when matched_id is null then 'created' else 'updated' end as action from k left join l using (ident))"""


@query("d2_upsert_ladder", f"select * from {SQL_LADDER}")
def d2(spark, sf_dir):
    return _ladder(spark, sf_dir).select("pos", "matched_id", "action")


@query(
    "d3_merge_tags",
    """select c_custkey, case when c_custkey % 3 = 0 and c_mktsegment = 'BUILDING' then 'BUILDING,x' when c_custkey % 3 = 0 then c_mktsegment || ',BUILDING,x' else c_mktsegment end
    || ',tech:React,email_pattern:first@' || c_nationkey as tags from customer""",
)
def d3(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey", "c_mktsegment", "case c_custkey % 3 when 0 then array('BUILDING', 'x', 'email_pattern:old') when 1 then array('email_pattern:old') end as tags", "'First@' || cast(c_nationkey as string) as p"
    )
    merged = D.merge_tags(F.col("tags"), F.col("c_mktsegment"), F.expr("array('React', 'React')"), F.col("p"))
    return rows.select("c_custkey", F.array_join(merged, ",").alias("tags"))


@query(
    "d4_apply_changes",
    """select cast(s_suppkey as varchar) as company_id, case when s_suppkey % 5 = 1 then 'Renamed' else s_name end as name, 's' || s_suppkey || '.io' as website, case s_suppkey % 5 when 0 then 'deleted' when 1 then 'updated' else 'kept' end as outcome from supplier
    union all select cast(sha256('new' || s_suppkey || '.io') as varchar), 'New', 'new' || s_suppkey || '.io', 'created' from supplier where s_suppkey % 5 = 2
    union all select null, 'New', 's' || (s_suppkey - 1) || '.io', 'conflict' from supplier where s_suppkey % 5 = 3
    union all select cast(s_suppkey as varchar), null, 's' || (s_suppkey - 1) || '.io', 'conflict' from supplier where s_suppkey % 5 = 4""",
)
def d4(spark, sf_dir):
    supplier = table(spark, sf_dir, "supplier")
    companies = supplier.selectExpr("s_suppkey as company_id", "s_name as name", "'s' || cast(s_suppkey as string) || '.io' as website", "cast(null as string) as description", "'x' as source")
    changes = supplier.selectExpr(
        "s_suppkey as pos", "case s_suppkey % 5 when 0 then 'delete' when 1 then 'update' when 4 then 'update' else 'create' end as op", "case when s_suppkey % 5 in (0, 1, 4) then s_suppkey end as company_id",
        "case s_suppkey % 5 when 1 then ' Renamed ' when 2 then 'New' when 3 then 'New' end as name",
        "case s_suppkey % 5 when 2 then 'https://www.NEW' || cast(s_suppkey as string) || '.io/' when 3 then 'http://s' || cast(s_suppkey - 1 as string) || '.io' when 4 then 's' || cast(s_suppkey - 1 as string) || '.io' end as website",
        "cast(null as string) as description", "cast(null as string) as source",
    )
    return D.apply_changes(companies, changes).select("company_id", "name", "website", "outcome")


@query(
    "d5_report_text",
    f"""select concat_ws(chr(10), repeat('=', 57), '', 'Name:', 'n' || company_id, '', 'Website:', 'w.io', '', 'Website Reachable:', case when has_contact then 'YES' else 'NO' end, '', 'Technologies:', case when is_product then 'React, Vue' else 'None' end, '',
    'Mobile App:', case when has_mobile_app then 'YES' else 'NO' end, '', 'Play Store:', case when is_product then 'YES' else 'NO' end, '', 'App Store:', case when is_agency then 'YES' else 'NO' end, '', 'Qualification:', case when has_email then 'PASS' else 'FAIL' end, '',
    'Qualification Score:', cast(jobs_found * 3 as varchar), '', 'Contact Emails Found:', cast(cast(flutter_jobs as int) as varchar), '', 'Decision Makers:', '0', '', 'Email Pattern:', 'None', '', 'Lead Score:', cast(cast(greatest(0.0, least(100.0, jobs_found * 3.0 + least(20.0, flutter_jobs * 5.0) + case when is_product then 2.0 else 0.0 end - case when has_mobile_app then 15.0 else 0.0 end + case when has_email then 10.0 else 0.0 end)) as int) as varchar), '') as value from {SQL_FEATURES}""",
)
def d5(spark, sf_dir):
    return D.report_text(_validation(spark, sf_dir))


def _companies(spark, sf_dir):
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey as company_id", "c_name as name", "'s' || cast(c_nationkey as string) || '.io' as website", "c_mktsegment as source", "c_acctbal as created_at"
    )


@query(
    "d6_search_companies",
    "select c_custkey as company_id from customer where regexp_matches(c_name, '(?i)7$') or regexp_matches('s' || c_nationkey || '.io', '(?i)7$') or regexp_matches(c_mktsegment, '(?i)7$') or regexp_matches(c_mktsegment, '(?i)^auto')",
)
def d6(spark, sf_dir):
    return D.search_companies(_companies(spark, sf_dir), " 7$|^auto ").select("company_id")


@query("d7_paginate", "select c_custkey as company_id from customer order by c_name desc, c_custkey limit 30 offset 60")
def d7(spark, sf_dir):
    return D.paginate(D.search_companies(_companies(spark, sf_dir), sort="name"), 3, 30).select("company_id")


_TIED = "case when c_custkey % 5 = 0 then null else c_mktsegment end"


def _tied(spark, sf_dir):
    return table(spark, sf_dir, "customer").selectExpr("c_custkey as company_id", f"{_TIED} as segment", "c_name as name")


@query("d7_page_directory", f"select c_custkey as company_id, {_TIED} as segment from customer order by {_TIED} desc nulls last, c_custkey limit 40 offset 400")
def d7_directory(spark, sf_dir):
    """Page 11 of an order with many ties: one or two of 16 ranges are read."""
    directory = G.PageDirectory(spark, f"{ensure_checkpoint_dir(spark)}/pages-{uuid.uuid4().hex}", [("segment", "desc")], "company_id")
    directory.write(_tied(spark, sf_dir), 16)
    return directory.page(11, 40).select("company_id", "segment")


@query("d7_page_after", f"select c_custkey as company_id, {_TIED} as segment from customer order by {_TIED} nulls first, c_custkey limit 150 offset 300")
def d7_after(spark, sf_dir):
    """The third page, reached over the last rows of the two before; the null rows come first."""
    rows, last = _tied(spark, sf_dir), None
    for _ in range(2):
        end = G.page_after(rows, [("segment", "asc")], "company_id", last, 150).collect()[-1]
        last = (end["segment"], end["company_id"])
    return G.page_after(rows, [("segment", "asc")], "company_id", last, 150).select("company_id", "segment")


@query(
    "d6_search_index",
    "select c_custkey as company_id from customer where regexp_matches(c_name, '(?i)#0+1[0-9]*7$|urnit') or regexp_matches('s' || c_nationkey || '.io', '(?i)#0+1[0-9]*7$|urnit') or regexp_matches(c_mktsegment, '(?i)#0+1[0-9]*7$|urnit|er#0000012')"
    " or regexp_matches(c_name, '(?i)er#0000012')",
)
def d6_index(spark, sf_dir):
    index = G.SearchIndex(spark, f"{ensure_checkpoint_dir(spark)}/search-{uuid.uuid4().hex}")
    index.write(_companies(spark, sf_dir))
    both = index.search("#0+1[0-9]*7$|urnit").unionByName(index.search("er#0000012", literal=True))
    return both.select("company_id").distinct()


@query("d7_page_info", "select count(*) as total, cast(ceil(count(*) / 30) as bigint) as total_pages from customer")
def d7_info(spark, sf_dir):
    return D.page_info(_companies(spark, sf_dir), 30)


@query("d8_exists_flags", "select n_nationkey, n_nationkey in (select c_nationkey from customer where c_acctbal > 9800) as found from nation")
def d8(spark, sf_dir):
    rich = table(spark, sf_dir, "customer").filter("c_acctbal > 9800").selectExpr("c_nationkey as n_nationkey")
    return D.exists_flags(table(spark, sf_dir, "nation").select("n_nationkey"), rich, ["n_nationkey"])


@query("d8_find_many", "select c_custkey from customer where c_nationkey in (select n_nationkey from nation where n_regionkey = 2)")
def d8_many(spark, sf_dir):
    keys = table(spark, sf_dir, "nation").filter("n_regionkey = 2").selectExpr("n_nationkey as c_nationkey")
    return D.find_many(table(spark, sf_dir, "customer"), keys, ["c_nationkey"]).select("c_custkey")


@query(
    "d9_website_conflicts",
    f"select website, company_id, first_id from (select *, min(company_id) over (partition by website) as first_id from (select page_id as company_id, {CANONICAL} as website from {SQL_URLS})) where company_id > first_id",
)
def d9(spark, sf_dir):
    return D.website_conflicts(url_rows(spark, sf_dir).selectExpr("page_id as company_id", "url as website"))


@query(
    "d10_company_view",
    "select o_orderkey, case when o_orderkey % 2 = 0 then o_orderpriority end as industry, strftime(o_orderdate + interval 330 minute, '%Y-%m-%d %H:%M') as created_at from orders",
)
def d10(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "case when o_orderkey % 2 = 0 then array(o_orderpriority, 'x') else cast(array() as array<string>) end as tags", "cast(o_orderdate as timestamp) as created_at"
    )
    return D.company_view(rows).select("o_orderkey", "industry", F.date_format("created_at", "yyyy-MM-dd HH:mm").alias("created_at"))


# --- reports ---------------------------------------------------------------------------------

@query(
    "r1_source_statistics",
    """select s as source, (select count(*) from events where event_type = s and event_type <> 'error') as count, s <> 'error' as success, case when s = 'error' then 'timeout' end as error from (select distinct event_type as s from events union select 'rss')""",
)
def r1(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumnRenamed("event_type", "source")
    sources = events.select("source").distinct().unionByName(events.select(F.lit("rss").alias("source")).limit(1))
    errors = events.filter("source = 'error'").select("source", F.lit("timeout").alias("error"))
    return R.source_statistics(events.filter("source <> 'error'").drop("ts"), sources, errors)


@query(
    "r2_collector_funnel",
    """select page_id % 4 as source, count(*) as collected, count(*) filter (page_id % 3 > 0) as normalized, count(*) filter (page_id % 3 > 0 and not starts_with(regexp_extract(url, '://([^/]*)', 1), 'blog.')) as valid, count(*) filter (page_id % 6 = 1) as saved from pages group by 1""",
)
def r2(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select(
        F.expr("page_id % 4 as source"), F.lit(True).alias("collected"), F.expr("page_id % 3 > 0 as normalized"),
        (F.expr("page_id % 3 > 0") & is_usable_website(F.col("url"))).alias("valid"), F.expr("page_id % 6 = 1 as saved"),
    )
    return R.collector_funnel(rows)


_WARNING = "CASE event_type WHEN 'view' THEN 'Skipped: No mail (MX) records for x' WHEN 'click' THEN 'No contact email available' WHEN 'error' THEN 'Skipped: recipient already in email queue' WHEN 'signup' THEN 'Lead score 3 below MIN_LEAD_SCORE 60' ELSE '' END"
_SKIP = "case when value > 50 then null when event_type = 'view' then 'no_mx' when event_type = 'click' then 'no_recipient' when event_type = 'error' then 'other_skip' when event_type = 'signup' then 'low_score' end"


def _outcomes(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr(
        "event_id", "event_type as source", "value > 50 as queued", f"array_compact(array(nullif({_WARNING}, ''))) as warnings", "event_id % 2 = 0 as persisted", "value > 20 as qualified", "value > 30 as emails_generated", "event_id % 50 > 0 as success"
    )
    return rows.withColumn("skip_reason", R.classify_skip(F.col("warnings"), F.col("queued")))


@query("r3_classify_skip", f"select event_id, {_SKIP} as skip_reason from events")
def r3(spark, sf_dir):
    return _outcomes(spark, sf_dir).select("event_id", "skip_reason")


_STATS = f"""count(*) as processed, count(*) filter (event_id % 2 = 0) as persisted, count(*) filter (value > 20) as qualified, count(*) filter (value > 30) as emails_generated, count(*) filter (value > 50) as queued, count(*) filter (event_id % 50 = 0) as failed,
 count(*) filter (({_SKIP}) = 'no_mx') as skipped_no_mx, count(*) filter (({_SKIP}) = 'other_skip') as skipped_other_skip, count(*) filter (event_id % 50 = 0) = 0 as run_success"""


@query("r4_run_statistics", f"select event_type as source, {_STATS} from events group by rollup(event_type)")
def r4(spark, sf_dir):
    return R.run_statistics(_outcomes(spark, sf_dir), ["source"]).select(
        "source", "processed", "persisted", "qualified", "emails_generated", "queued", "failed", "skipped_no_mx", "skipped_other_skip", "run_success"
    )


@query("r4_skip_reason_map", f"select skip_reason, count(*) as n from (select {_SKIP} as skip_reason from events) where skip_reason is not null group by 1")
def r4_map(spark, sf_dir):
    rows = R.skip_reason_map(R.run_statistics(_outcomes(spark, sf_dir)))
    return rows.select(F.explode("skip_reasons").alias("skip_reason", "n"))


def _summary_line(label: str, value: str) -> str:
    return f"'[RUN SUMMARY] {label}' || {value}"


_SUMMARY = ", ".join(
    [_summary_line("========== Lead generation run ==========", "''")]
    + [
        _summary_line(label, value)
        for label, value in (
            ("Fetched (raw from sources):     ", "0"), ("Unique after dedupe:           ", "'0 (duplicates removed: 0)'"), ("Selected for pipeline:          ", "0"),
            ("Processed:                      ", "processed"), ("Saved to DB (companies):         ", "persisted"), ("Qualified:                      ", "qualified"),
            ("Personalized:                   ", "0"), ("Emails generated:               ", "emails_generated"), ("Shortlisted / queued:           ", "queued"), ("Failed:                         ", "failed"),
            ("Skipped — duplicate:            ", "0"), ("Skipped — no recipient email:   ", "no_recipient"), ("Skipped — no MX:                ", "skipped_no_mx"), ("Skipped — mailbox rejected:     ", "0"),
            ("Skipped — low score:            ", "low_score"), ("Skipped — no opportunity:       ", "0"), ("Skipped — other:                ", "skipped_other_skip"), ("Duration:                       ", "'0 ms'"),
            ("Status:                         ", "case when run_success then 'SUCCESS' else 'FAILED' end"),
        )
    ]
    + [_summary_line("========================================", "''")]
)


@query(
    "r5_run_summary_text",
    f"select concat_ws(chr(10), {_SUMMARY}) as value from (select {_STATS}, count(*) filter (({_SKIP}) = 'no_recipient') as no_recipient, count(*) filter (({_SKIP}) = 'low_score') as low_score from events)",
)
def r5(spark, sf_dir):
    return R.run_summary_text(R.run_statistics(_outcomes(spark, sf_dir)))


@query(
    "r6_stage_percentiles",
    "select event_type as stage, count(*) as runs, count(*) filter (event_id % 10 = 0) as failures, quantile_disc(value, 0.5) as p50_ms, quantile_disc(value, 0.95) as p95_ms from events group by 1",
)
def r6(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("event_type as stage", "value as duration_ms", "case when event_id % 10 = 0 then 'x' end as error")
    return R.stage_percentiles(rows)


@query(
    "r6_merged_percentiles",
    """select event_type as stage, count(*) as runs, count(*) filter (event_id % 10 = 0) as failures, round(avg(value), 6) as mean_ms, true as p50_near, true as p95_near,
    count(distinct ts::date) as days from events group by 1""",
)
def r6_merged(spark, sf_dir):
    """All days out of their stored sketches; a percentile counts as near if its rank is within 1 % of what it stands for."""
    rows = table(spark, sf_dir, "events").selectExpr("event_type as stage", "value as duration_ms", "case when event_id % 10 = 0 then 'x' end as error", "ts")
    path = f"{ensure_checkpoint_dir(spark)}/timings-{uuid.uuid4().hex}"
    for part in (0, 1):  # two runs, each with days of its own
        R.store_timings(R.timing_sketches(rows.filter(F.day("ts") % 2 == part), "ts"), path)
    sketches = spark.read.parquet(path)
    merged = R.merged_percentiles(sketches).join(sketches.groupBy("stage").agg(F.count_distinct("day").alias("days")), "stage")
    ranked = rows.join(F.broadcast(merged.select(F.col("stage").alias("_stage"), "p50_ms", "p95_ms")), F.col("stage") == F.col("_stage"))
    share = lambda p: F.avg((F.col("duration_ms") <= F.col(p)).cast("int"))
    near = ranked.groupBy("_stage").agg((F.abs(share("p50_ms") - 0.5) < 0.01).alias("p50_near"), (F.abs(share("p95_ms") - 0.95) < 0.01).alias("p95_near"))
    found = merged.join(near, F.col("stage") == F.col("_stage"))
    return found.select("stage", "runs", "failures", F.round("mean_ms", 6).alias("mean_ms"), "p50_near", "p95_near", "days")


@query(
    "r6_stage_timings",
    """select user_id as company_id, cast(count(*) as int) as stages, count(*) filter (event_id % 10 = 0) = 0 as success, round(sum(value), 4) as total_ms, string_agg(event_type || '=' || round(value, 3)::varchar, ';' order by event_type) as durations,
    coalesce(string_agg(event_type || ': x', ';' order by event_type) filter (event_id % 10 = 0), '') as errors from (select *, row_number() over (partition by user_id, event_type order by event_id desc) as rn from events) where rn = 1 group by 1""",
)
def r6_map(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr(
        "user_id as company_id", "event_type as stage", "value as duration_ms", "event_id as pos",
        "case when event_id % 10 = 0 then 'x' else '' end as error",
    )
    out = R.stage_timings(rows)
    shown = F.array_join(F.transform(F.map_entries("durations"), lambda e: F.concat_ws("=", e["key"], F.round(e["value"], 3).cast("string"))), ";")
    return out.select(
        "company_id", F.size("durations").alias("stages"), "success", F.round("total_ms", 4).alias("total_ms"), shown.alias("durations"), F.array_join("errors", ";").alias("errors")
    )


def _validation(spark, sf_dir):
    rows = company_features(spark, sf_dir).selectExpr(
        "company_id", "'n' || cast(company_id as string) as name", "'w.io' as website", "has_contact as site_valid", "case when is_product then array('React', 'Vue') else cast(array() as array<string>) end as technologies",
        "has_mobile_app", "is_product as android", "is_agency as ios", "has_email as qualified", "cast(jobs_found as int) * 3 as score", "cast(flutter_jobs as int) as emails_found", "cast(0 as bigint) as decision_makers", "cast(null as string) as email_pattern",
    )
    return R.validation_rows(rows)


SQL_VALIDATION = f"""(select company_id, has_contact as website_reachable, coalesce(has_mobile_app, false) as mobile_app, has_email as qualification_pass, flutter_jobs as contact_emails_found, is_product as tech,
 greatest(0.0, least(100.0, jobs_found * 3.0 + least(20.0, flutter_jobs * 5.0) + case when is_product then 2.0 else 0.0 end - case when has_mobile_app then 15.0 else 0.0 end + case when has_email then 10.0 else 0.0 end)) as lead_score from {SQL_FEATURES})"""


@query("r7_validation_rows", f"select company_id, website_reachable, mobile_app, qualification_pass, lead_score from {SQL_VALIDATION}")
def r7(spark, sf_dir):
    return _validation(spark, sf_dir).select("company_id", "website_reachable", "mobile_app", "qualification_pass", "lead_score")


@query(
    "r8_validation_summary",
    f"""select count(*) as companies_processed, count(*) filter (website_reachable) as reachable, count(*) filter (qualification_pass) as qualified, count(*) filter (mobile_app) as mobile_apps, cast(sum(contact_emails_found) as bigint) as emails_found,
    count(*) filter (tech) as technology_detection_success, count(*) filter (qualification_pass) as good_leads, round(avg(lead_score), 1) as average_lead_score from {SQL_VALIDATION}""",
)
def r8(spark, sf_dir):
    return R.validation_summary(_validation(spark, sf_dir))


@query(
    "r9_job_metrics",
    """select j as job, strftime(ts, '%Y-%m-%d %H:%M:%S') as finished_at, value as duration_ms, event_id % 2 = 0 as success from (select distinct event_type as j from events union select 'never') left join
    (select * from (select *, row_number() over (partition by event_type order by ts desc, event_id desc) as rn from events) where rn = 1) e on e.event_type = j""",
)
def r9(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    runs = events.selectExpr("event_type as job", "event_id as run_id", "cast(ts as timestamp) as started_at", "cast(ts as timestamp) as finished_at", "value as duration_ms", "event_id % 2 = 0 as success", "cast(null as string) as error")
    jobs = events.selectExpr("event_type as job").distinct().unionByName(events.select(F.lit("never").alias("job")).limit(1))
    return R.job_metrics(runs, jobs).select("job", F.date_format("finished_at", "yyyy-MM-dd HH:mm:ss").alias("finished_at"), "duration_ms", "success")


@query("r10_validation_job_totals", "select count(*) as processed, count(*) filter (event_id % 3 = 0) as failed, cast(2 * count(*) filter (event_id % 3 = 0) as bigint) as errors from events")
def r10(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("case when event_id % 3 = 0 then array('a', 'b') else cast(array() as array<string>) end as errors")
    return R.validation_job_totals(rows)


@query(
    "r11_persist_statistics",
    f"""select t as "table", count(*) filter (action = 'created') as created, count(*) filter (action = 'updated') as updated, count(*) filter (action in ('skipped', 'duplicate')) as skipped,
    count(*) filter (action = 'duplicate') as duplicates_skipped from (select 'companies' as t, action from {SQL_UPSERT} union all select 'contacts', action from {SQL_LADDER}) group by 1""",
)
def r11(spark, sf_dir):
    actions = _upsert(spark, sf_dir).select(F.lit("companies").alias("table"), "action").unionByName(
        _ladder(spark, sf_dir).select(F.lit("contacts").alias("table"), "action")
    )
    return R.persist_statistics(actions)
