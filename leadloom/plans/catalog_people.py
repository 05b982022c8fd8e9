"""Mailbox, contact, founder and address pattern queries (families C, F, E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadloom.functions import people as N
from leadloom.operators import contacts as C
from leadloom.operators import pages as P
from leadloom.operators import patterns as E
from leadloom.plans.catalog_signals import _quote
from leadloom.plans.catalog_urls import sql_in
from leadloom.plans.inputs import SQL_CONTACTS, SQL_MAIL_DOCS, contact_rows, mail_documents
from leadloom.plans.catalog_pages import sql_pieces, sql_unescape
from leadloom.plans.registry import query, table
from leadloom.rules import people as rules
from leadloom.rules.web import EMAIL_PATTERN


_STRIPPED = r"regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g')"


def sql_valid(e: str) -> str:
    local = f"regexp_extract({e}, '^(.*)@[^@]*$', 1)"
    domain = f"regexp_extract({e}, '@([^@]*)$', 1)"
    labels = f"list_filter(string_split({domain}, '.'), lambda p: p <> '')"
    return f"""(regexp_full_match({e}, '{EMAIL_PATTERN}') and not ({domain} in {sql_in(rules.FAKE_DOMAINS)} or contains({domain}, 'localhost')
 or {local} in {sql_in(rules.REJECTED_MAILBOXES)} or regexp_matches({local}, '^(noreply|no-reply|donotreply)|privacy') or regexp_matches({e}, '[.](png|jpg|jpeg|gif|svg|webp|ico|bmp)$')
 or len({labels}) < 2 or {labels}[-1] in {sql_in(rules.BAD_TLDS)} or list_has_any({labels}[:-2], [{', '.join(_quote(x) for x in rules.FAKE_DOMAIN_LABELS)}]) or contains({domain}, 'cloudflare')))"""


@query(
    "c1_extract_emails",
    f"""select distinct doc_id, e as email from (select doc_id, lower(unnest(regexp_extract_all(text, '{EMAIL_PATTERN}'))) as e from {SQL_MAIL_DOCS}
      union all select doc_id, lower(n || '@' || h || '.' || x) from (select doc_id, unnest(regexp_extract_all(text, '{rules.OBFUSCATED_EMAIL}', 1)) as n, unnest(regexp_extract_all(text, '{rules.OBFUSCATED_EMAIL}', 2)) as h, unnest(regexp_extract_all(text, '{rules.OBFUSCATED_EMAIL}', 3)) as x from {SQL_MAIL_DOCS})) where {sql_valid('e')}""",
)
def c1(spark, sf_dir):
    return P.unnest(mail_documents(spark, sf_dir), N.emails_from_text(F.col("text")), "email", ["doc_id"])


_MAILS = """CASE c_custkey % 12 WHEN 0 THEN 'info@' WHEN 1 THEN 'Jane.Doe+x@' WHEN 2 THEN 'noreply-1@' WHEN 3 THEN 'hr@' WHEN 4 THEN 'privacy.team@' WHEN 5 THEN ' p' || CAST(c_custkey AS VARCHAR(10)) || '@' WHEN 6 THEN 'a@b@' WHEN 7 THEN 'x@img.png' WHEN 8 THEN 'legal@' WHEN 9 THEN NULL WHEN 10 THEN 'careers+de@' ELSE 'm@' END ||
 CASE c_nationkey % 9 WHEN 0 THEN 'acme.io' WHEN 1 THEN 'example.com' WHEN 2 THEN 'mail.test.io' WHEN 3 THEN 'gmail.com' WHEN 4 THEN 'corp.internal' WHEN 5 THEN 'localhost' WHEN 6 THEN 'cloudflare-x.net' WHEN 7 THEN 'acme.example' ELSE 'sub.acme.co.uk' END"""
_SQL_MAILS = f"(select c_custkey, {_MAILS} as email, lower(trim({_MAILS})) as e from customer)"


def _mails(spark, sf_dir):
    return table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{_MAILS} as email")


@query("c2_email_validity", f"select c_custkey, coalesce({sql_valid('e')}, false) as email_valid from {_SQL_MAILS}")
def c2(spark, sf_dir):
    return N.classify_emails(_mails(spark, sf_dir)).select("c_custkey", "email_valid")


_LOCAL = "lower(regexp_extract(trim(email), '^([^@+]*)', 1))"
_GENERIC = tuple(dict.fromkeys(rules.SKIP_MAILBOXES + rules.HIRING_MAILBOXES))


@query(
    "c3_inbox_class",
    f"""select c_custkey, case when email is null then null when {_LOCAL} in {sql_in(rules.HIRING_MAILBOXES)} then 'hiring' when {_LOCAL} in {sql_in(_GENERIC)} then 'generic' else 'person' end as inbox_class,
    coalesce({sql_valid('e')} and not {_LOCAL} in {sql_in(_GENERIC)}, false) as outbound_safe from {_SQL_MAILS}""",
)
def c3(spark, sf_dir):
    return N.classify_emails(_mails(spark, sf_dir)).select("c_custkey", "inbox_class", "outbound_safe")


_TOKENS = "list_filter(string_split_regex(replace(n, '-', ' '), '\\s+'), lambda t: t <> '')"


def sql_fake(name: str) -> str:
    n = f"lower(trim(regexp_replace(coalesce({name}, ''), '\\s+', ' ', 'g')))"
    t = _TOKENS.replace("(n,", f"({n},")
    lst = lambda x: "[" + ", ".join(_quote(v) for v in x) + "]"
    junk = f"len(list_filter({t}, lambda x: list_contains({lst(rules.NON_PERSON_TOKENS)}, x)))"
    return f"""({n} <> '' and (len({t}) = 0 or {n} in {sql_in(rules.FAKE_LABELS + rules.SINGLE_REJECTS)} or {t}[1] in {sql_in(rules.GREETINGS)} or list_has_any({t}, {lst(rules.NAV_TOKENS + rules.CONNECTIVES)})
 or len(list_filter({t}, lambda x: not list_contains({lst(rules.SINGLE_REJECTS)}, x))) = 0 or {junk} = len({t}) or (len({t}) >= 2 and {junk} * 2 >= len({t}))))"""


_NAMES = """CASE c_custkey % 11 WHEN 0 THEN 'Hi ' || c_name WHEN 1 THEN 'Sign-In' WHEN 2 THEN 'Ada Stone' WHEN 3 THEN 'Cloud Connector' WHEN 4 THEN ' jane  DOE ' WHEN 5 THEN 'Dear Ravi Kim,' WHEN 6 THEN 'Team' WHEN 7 THEN 'Account Lee West' WHEN 8 THEN c_mktsegment WHEN 9 THEN '' ELSE c_name END"""


@query("c4_person_name_filter", f"select c_custkey, {sql_fake('nm')} as is_fake_name from (select c_custkey, {_NAMES} as nm from customer)")
def c4(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{_NAMES} as nm")
    return rows.select("c_custkey", N.is_fake_name(F.col("nm")).alias("is_fake_name"))


@query(
    "c5_normalize_and_split_name",
    f"""select c_custkey, case when n <> '' and not {sql_fake('n')} then case when len(string_split(n, ' ')) >= 2 and len(list_filter(string_split(n, ' '), lambda p: not regexp_matches(p, '^\\p{{Lu}}'))) = 0 then string_split(n, ' ')[1] else n end end as greeting_name,
    nullif(regexp_extract(s, '^(\\S+)', 1), '') as first_name, nullif(regexp_extract(s, '^\\S+ (.*)$', 1), '') as last_name from
    (select c_custkey, trim(regexp_replace(s, '(?i)^(hi|hello|hey|dear)\\s+', ''), ' ,.-') as n, s from (select c_custkey, trim(regexp_replace({_NAMES}, '\\s+', ' ', 'g')) as s from customer))""",
)
def c5(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{_NAMES} as nm")
    parts = N.split_name(F.col("nm"))
    return rows.select(
        "c_custkey", N.normalize_person_name(F.col("nm")).alias("greeting_name"), parts["first"].alias("first_name"), parts["last"].alias("last_name")
    )


def sql_role(r: str) -> str:
    alias = " ".join(f"when lower({r}) = {_quote(a)} then {_quote(v)}" for a, v in rules.ROLE_ALIASES.items())
    inside = " ".join(f"when contains(lower({r}), {_quote(s.lower())}) then {_quote(s)}" for s in rules.SUPPORTED_ROLES)
    return f"case when {r} is null then null {alias} {inside} else upper({r}[1:1]) || lower({r}[2:]) end"


_ROLES = "CASE WHEN c_custkey % 9 = 0 THEN 'Senior Software Engineer' WHEN c_custkey % 9 = 1 THEN c_mktsegment ELSE role END"
_SQL_ROLE_ROWS = f"(select c.c_custkey, {_ROLES} as r from customer c join {SQL_CONTACTS} x on x.pos = c.c_custkey)"


@query("c6_normalize_role", f"select c_custkey, {sql_role('r')} as role from {_SQL_ROLE_ROWS}")
def c6(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").join(contact_rows(spark, sf_dir), F.col("pos") == F.col("c_custkey"))
    return rows.selectExpr("c_custkey", f"{_ROLES} as r").select("c_custkey", N.normalize_role(F.col("r")).alias("role"))


_TEAM = """'<main><p class="nav-menu">Nav Person CEO</p><section><p>' || CASE c_custkey % 4 WHEN 0 THEN 'meet Ada Stone, co-founder. ada@acme.io hello@acme.io' WHEN 1 THEN 'Our work https://linkedin.com/in/p' || CAST(c_custkey AS VARCHAR(10)) || ' Head of Engineering' WHEN 2 THEN 'Sign In or Learn More' ELSE 'Contact Ravi Kim at ravi [at] corp [dot] io or https://x.com/ravi' END || '</p></section></main>' || html"""


def _pages_as_customers(spark, sf_dir):
    return table(spark, sf_dir, "pages").withColumnRenamed("page_id", "c_custkey")


def _team_pages(spark, sf_dir):
    return P.parse_pages(_pages_as_customers(spark, sf_dir).selectExpr("c_custkey as company_id", "'https://t.io' as url", f"{_TEAM} as html"))


# Blocks of the pages' articles: each paragraph's own text; an open paragraph holds all that follow and counts as a
# card while it has 500 characters, and so does the article. Menus, adverts and footers hold no address.
_SQL_BLOCKS = f"""(with parts as (select page_id, unnest(string_split(a, '<p>')) as part, unnest(range(length(string_split(a, '<p>')))) as i
   from (select page_id, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) as a from pages)),
 tails as (select page_id, i, part, string_agg(part, '<p>') over (partition by page_id order by i rows between current row and unbounded following) as tail from parts)
 select page_id, t from (select page_id, {sql_pieces("string_split(part, '</p>')[1]")} as t from tails where i > 0
   union all select page_id, {sql_pieces("tail")} from tails where length({sql_pieces("tail")}) <= 500 and (i = 0 or not contains(part, '</p>'))) where regexp_matches(t, '(?i)@|\\[at\\]|\\(at\\)| at '))"""
_SQL_BLOCK_ROLE = "case " + " ".join(f"when contains(lower(t), {_quote(a)}) then {_quote(v)}" for a, v in sorted(rules.ROLE_ALIASES.items(), key=lambda x: -len(x[0]))) + " ".join(
    f" when contains(lower(t), {_quote(r.lower())}) then {_quote(r)}" for r in rules.SUPPORTED_ROLES) + " end"
_SQL_BLOCK_PEOPLE = f"""(select page_id, {_SQL_BLOCK_ROLE} as role, coalesce(min(e) filter (not regexp_extract(e, '^([^@]*)', 1) in {sql_in(rules.SHARED_MAILBOXES)}), min(e)) as e
 from (select page_id, t, lower(unnest(regexp_extract_all(t, '{EMAIL_PATTERN}'))) as e from {_SQL_BLOCKS}
  union all select page_id, t, lower(n || '@' || h || '.' || x) from (select page_id, t, unnest(regexp_extract_all(t, '{rules.OBFUSCATED_EMAIL}', 1)) as n,
   unnest(regexp_extract_all(t, '{rules.OBFUSCATED_EMAIL}', 2)) as h, unnest(regexp_extract_all(t, '{rules.OBFUSCATED_EMAIL}', 3)) as x from {_SQL_BLOCKS})) where {sql_valid('e')} group by page_id, t)"""


@query(
    "c7_people_from_blocks",
    f"""select c_custkey as company_id, case c_custkey % 4 when 0 then 'Ada Stone' when 3 then 'Contact Ravi Kim' end as full_name, case c_custkey % 4 when 0 then 'ada@acme.io' when 3 then 'ravi@corp.io' end as email,
    case c_custkey % 4 when 0 then 'Co-Founder' when 1 then 'VP Engineering' end as role, case when c_custkey % 4 = 1 then 'https://linkedin.com/in/p' || c_custkey end as linkedin, case when c_custkey % 4 = 3 then 'https://x.com/ravi' end as twitter
    from (select page_id as c_custkey from pages) where c_custkey % 4 <> 2 union select page_id, null, e, role, null, null from {_SQL_BLOCK_PEOPLE}""",
)
def c7(spark, sf_dir):
    rows = P.unnest(_team_pages(spark, sf_dir), C.people_from_blocks(), "p", ["company_id"])
    return rows.select("company_id", "p.full_name", "p.email", "p.role", "p.linkedin", "p.twitter").distinct()


_PERSON_LD = """'<div><a href="https://github.com/u' || CAST(c_custkey AS VARCHAR(10)) || '">g</a><a href="https://github.com/u/repo">r</a><a href="https://www.linkedin.com/in/me">l</a><script type="application/ld+json">{"@type":"Person","name":"Mia West","jobTitle":"Chief Technology Officer","email":"mia@w' || CAST(c_custkey AS VARCHAR(10)) || '.io"}</script><p>write to jobs@acme.io</p></div>' || html"""


def _person_pages(spark, sf_dir):
    return P.parse_pages(_pages_as_customers(spark, sf_dir).selectExpr("c_custkey as company_id", "'https://t.io' as url", f"{_PERSON_LD} as html"))


_SQL_PAGE_TEXT = f"(select page_id, {sql_unescape(_STRIPPED)} as text from pages)"
_SQL_PAGE_MAILS = f"""(select distinct page_id, e from (select page_id, lower(unnest(regexp_extract_all(text, '{EMAIL_PATTERN}'))) as e from {_SQL_PAGE_TEXT}
 union all select page_id, lower(n || '@' || h || '.' || x) from (select page_id, unnest(regexp_extract_all(text, '{rules.OBFUSCATED_EMAIL}', 1)) as n, unnest(regexp_extract_all(text, '{rules.OBFUSCATED_EMAIL}', 2)) as h, unnest(regexp_extract_all(text, '{rules.OBFUSCATED_EMAIL}', 3)) as x from {_SQL_PAGE_TEXT})) where {sql_valid('e')})"""


@query(
    "c8_contact_candidates",
    f"""select c_custkey as company_id, s as discovery_source, n as full_name, case when s = 'json_ld' then 'mia@w' || c_custkey || '.io' else e end as email, r as role, l as linkedin, case g when 'g' then 'https://github.com/u' || c_custkey when 'r' then 'https://github.com/u' end as github
    from (select page_id as c_custkey from pages) c, (values ('json_ld', 'Mia West', null, 'CTO', null, null), ('email', null, 'jobs@acme.io', 'Jobs', null, null), ('social', null, null, null, 'https://www.linkedin.com/in/me', null), ('social', null, null, null, null, 'g'), ('social', null, null, null, null, 'r')) t(s, n, e, r, l, g)
    union select page_id, 'email', null, e, null, null, null from {_SQL_PAGE_MAILS}
    union select page_id, 'html', null, 'jobs@acme.io', null, null, null from pages
    union select page_id, 'html', null, e, role, null, null from {_SQL_BLOCK_PEOPLE}""",
)
def c8(spark, sf_dir):
    return C.contact_candidates(_person_pages(spark, sf_dir)).select(
        "company_id", "discovery_source", "full_name", "email", "role", "linkedin", "github"
    ).distinct()


def sql_rank(role: str, email: str, linkedin: str, name: str) -> tuple[str, str]:
    local = f"lower(regexp_extract(coalesce({email}, ''), '^([^@]*)', 1))"
    role_score = "case lower(" + role + ") " + " ".join(f"when {_quote(r.lower())} then {s}" for r, s, _ in rules.ROLE_SCORES) + " end"
    role_prio = "case lower(" + role + ") " + " ".join(f"when {_quote(r.lower())} then {p}" for r, _, p in rules.ROLE_SCORES) + " end"
    box = f"case {local} " + " ".join(f"when {_quote(k)} then {v}" for k, v in rules.MAILBOX_SCORES.items()) + " end"
    box_prio = f"case when {local} in {sql_in(rules.HIGH_VALUE_MAILBOXES)} then 3 when {local} in {sql_in(rules.SHARED_MAILBOXES)} then 10 else 99 end"
    score = f"""least(100, coalesce({role_score}, {box}, case when {name} is not null then 50 when {linkedin} is not null then 35 else 15 end)
      + case when {email} is not null and {linkedin} is not null then 3 else 0 end + case when {name} is not null and {email} is not null then 2 else 0 end)"""
    prio = f"coalesce({role_prio}, case when {box} is not null then {box_prio} when {name} is not null then 9 when {linkedin} is not null then 11 else 99 end)"
    return score, prio


_SCORE, _PRIO = sql_rank("role", "email", "linkedin", "full_name")


@query(
    "c9_rank_contact",
    f"select pos, cast({_SCORE} as int) as score, cast({_PRIO} as int) as priority from (select pos, {sql_role('role')} as role, email, linkedin, full_name from {SQL_CONTACTS})",
)
def c9(spark, sf_dir):
    c = F.col
    rows = contact_rows(spark, sf_dir).withColumn(
        "r", N.rank_contact(c("email"), N.normalize_role(c("role")), c("linkedin"), F.lit(None).cast("string"), c("full_name"))
    )
    return rows.select("pos", "r.score", "r.priority")


# Candidates cleaned as in the merge, then connected groups by a recursive query over shared keys.
SQL_CLEAN = f"""(select pos, company_id, full_name, case when {sql_valid('lower(email)')} then email end as email, {sql_role('role')} as role, linkedin from {SQL_CONTACTS} where not {sql_fake('full_name')})"""
_WITH_GROUPS = f"""with recursive clean as materialized (select * from {SQL_CLEAN} where full_name is not null or email is not null or linkedin is not null or (case when {sql_valid("lower(coalesce(email, ''))")} then 1 end) is not null),
 keys as materialized (select company_id, pos, 'e:' || lower(email) as key from clean where email is not null union select company_id, pos, 'l:' || lower(linkedin) from clean where linkedin is not null
   union select company_id, pos, 'n:' || lower(full_name) || ':' || lower(role) from clean where full_name is not null and role is not null),
 walk(company_id, pos, root) as (select company_id, pos, pos from keys union select w.company_id, b.pos, w.root from walk w join keys a on a.company_id = w.company_id and a.pos = w.pos join keys b on b.company_id = a.company_id and b.key = a.key),
 groups as materialized (select company_id, pos, min(root) as g from walk group by 1, 2),
 lab as materialized (select c.*, coalesce(cast(g as varchar), 'bare:' || lower(full_name)) as gid from clean c left join groups g on g.company_id = c.company_id and g.pos = c.pos),
 merged as materialized (select company_id, gid, min(pos) as first_pos, count(*) as n_merged, arg_min(full_name, case when full_name is not null then pos end) as full_name, arg_min(email, case when email is not null then pos end) as email,
   arg_min(role, case when role is not null then pos end) as role, arg_min(linkedin, case when linkedin is not null then pos end) as linkedin from lab group by company_id, gid),
 ranked as materialized (select *, cast({_SCORE} as int) as contact_score, cast({_PRIO} as int) as contact_priority from merged),
 classed as materialized (select *, case when lower(role) in {sql_in(rules.DECISION_ROLES)} or regexp_extract(coalesce(email, ''), '^([^@]*)', 1) in {sql_in(rules.DECISION_MAILBOXES)} then 'decision'
   when case when full_name is not null and not {sql_fake('full_name')} and role is not null and lower(role) not in {sql_in(rules.SHARED_MAILBOXES)} then false when email is null then full_name is null else regexp_extract(lower(email), '^([^@]*)', 1) in {sql_in(rules.SHARED_MAILBOXES)} end then 'generic' else 'other' end as contact_class from ranked)
"""


def merged_contacts(spark, sf_dir):
    return C.split_contacts(C.merge_contacts(contact_rows(spark, sf_dir)))


@query(
    "c10_merge_contacts",
    _WITH_GROUPS + "select company_id, first_pos, n_merged, full_name, email, role, linkedin, contact_score, contact_priority from ranked",
)
def c10(spark, sf_dir):
    return C.merge_contacts(contact_rows(spark, sf_dir)).select(
        "company_id", "first_pos", "n_merged", "full_name", "email", "role", "linkedin", "contact_score", "contact_priority"
    )


@query("c11_split_contacts", _WITH_GROUPS + "select company_id, first_pos, contact_class from classed")
def c11(spark, sf_dir):
    return merged_contacts(spark, sf_dir).select("company_id", "first_pos", "contact_class")


BEST_CONTACT = """select * from (select *, row_number() over (partition by company_id order by case contact_class when 'decision' then 1 when 'other' then 2 else 3 end, contact_score desc, contact_priority, first_pos) as rn from classed) where rn = 1"""


@query("c12_best_contact", _WITH_GROUPS + f"select company_id, first_pos, full_name, email, role from ({BEST_CONTACT})")
def c12(spark, sf_dir):
    return C.best_contact(merged_contacts(spark, sf_dir)).select("company_id", "first_pos", "full_name", "email", "role")


@query(
    "c13_contact_report",
    _WITH_GROUPS + f"""select a.company_id, contact_count, decision_makers_found, generic_contacts_found, email_count, linkedin_count, b.full_name as best_full_name, b.contact_score as best_contact_score from
    (select company_id, count(*) as contact_count, count(*) filter (contact_class = 'decision' and coalesce(full_name, email, linkedin) is not null) as decision_makers_found, count(*) filter (contact_class = 'generic') as generic_contacts_found, count(distinct lower(email)) as email_count, count(distinct linkedin) as linkedin_count from classed group by 1) a
    left join ({BEST_CONTACT}) b on b.company_id = a.company_id""",
)
def c13(spark, sf_dir):
    return C.contact_report(merged_contacts(spark, sf_dir)).drop("best_email", "best_role")


@query(
    "c14_social_profiles",
    """select c_custkey, 'https://www.linkedin.com/in/a-' || c_custkey as linkedin_people, 'http://linkedin.com/company/co' as linkedin_companies, 'https://twitter.com/b_1,https://x.com/u' || c_custkey as twitter, 'https://github.com/dev' || c_custkey as github from customer""",
)
def c14(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey",
        """'see https://www.linkedin.com/in/a-' || cast(c_custkey as string) || ' and http://linkedin.com/company/co https://x.com/u' || cast(c_custkey as string) || ' https://twitter.com/b_1 https://x.com/home https://github.com/topics https://github.com/dev' || cast(c_custkey as string) || '/ end' as t""",
    )
    s = rows.select("c_custkey", C.social_profiles(F.col("t")).alias("s"))
    return s.select("c_custkey", *[F.array_join(f"s.{n}", ",").alias(n) for n in ("linkedin_people", "linkedin_companies", "twitter", "github")])


@query("c15_is_business_email", f"select c_custkey, coalesce(contains(e, '@') and regexp_extract(e, '@([^@]*)$', 1) not in {sql_in(rules.FREE_MAIL_DOMAINS)}, false) as is_business from {_SQL_MAILS}")
def c15(spark, sf_dir):
    return N.classify_emails(_mails(spark, sf_dir)).select("c_custkey", "is_business")


@query(
    "c_classify_people",
    f"""select pos, company_id, full_name, role, role_normal, {sql_fake('full_name')} as is_fake_name, case when full_name like 'Hello %' and not {sql_fake("split_part(full_name, ' ', 2)")} then split_part(full_name, ' ', 2) when full_name is not null and not {sql_fake('full_name')} then split_part(full_name, ' ', 1) end as greeting_name,
    split_part(full_name, ' ', 1) as first_name, split_part(full_name, ' ', 2) as last_name, coalesce(lower(role_normal) in {sql_in(rules.DECISION_ROLES)}, false) as is_decision_role
    from (select *, {sql_role('role')} as role_normal from {SQL_CONTACTS})""",
)
def c_people(spark, sf_dir):
    rows = contact_rows(spark, sf_dir)
    return N.classify_people(rows).drop("email", "linkedin")


# --- founders --------------------------------------------------------------------------------

SQL_FOUNDER_ROWS = f"""(select *, {_SCORE} as score, case when email is not null then 'email:' || lower(email) when linkedin is not null then 'linkedin:' || lower(linkedin) else 'name:' || lower(coalesce(full_name, '')) end as fkey
 from (select pos, company_id, full_name, email, {sql_role('role')} as role, linkedin from {SQL_CONTACTS}) where regexp_matches(lower(coalesce(role, '')), 'founder|ceo|owner|chief executive') and not {sql_fake('full_name')})"""
SQL_FOUNDERS = f"""(select company_id, fkey, min(pos) as pos, arg_min(full_name, case when full_name is not null then pos end) as full_name, arg_min(role, pos) as role, arg_min(email, case when email is not null then pos end) as email,
 arg_min(linkedin, case when linkedin is not null then pos end) as linkedin, max(score) as percent, arg_min(score, pos) as contact_score from {SQL_FOUNDER_ROWS} group by company_id, fkey)"""
SQL_SCORED = f"""(select *, cast(least(100, greatest(greatest(15, least(50, percent)), least(70, contact_score)) + case when full_name is not null then 10 else 0 end + 15 + case when email is not null then 15 else 0 end + case when linkedin is not null then 10 else 0 end) as int) as founder_percent from {SQL_FOUNDERS})"""


def _founders(spark, sf_dir):
    rows = contact_rows(spark, sf_dir).withColumn("role", N.normalize_role(F.col("role")))
    ranked = C.ranked_contacts(C.with_optional(rows, ("github",)))
    return C.select_founders(ranked)


@query("f1_select_founders", f"select company_id, pos, full_name, role, email, linkedin, cast(percent as int) as percent from {SQL_FOUNDERS}")
def f1(spark, sf_dir):
    return _founders(spark, sf_dir).select("company_id", "pos", "full_name", "role", "email", "linkedin", "percent")


_HOME = """'<html><body><p>Short Ada</p><p>Ada Stone started the company in Berlin after ten years of work on boats.</p><img src="/ada.png" alt="Ada Stone"><a href="https://adastone.me/x">site</a></body></html>'"""


@query(
    "f2_enrich_founders",
    f"""select company_id, pos, split_part(full_name, ' ', 1) as first_name, split_part(full_name, ' ', 2) as last_name, case when full_name = 'Ada Stone' or full_name like 'Ada %' then 'Ada Stone started the company in Berlin after ten years of work on boats.' when full_name like '% Stone' then null end as bio,
    case when full_name like 'Ada %' then 'https://n.io/ada.png' end as avatar_url, case when full_name like 'Ada %' then 'https://adastone.me/x' end as personal_website, case when full_name like 'Ada %' then 'Berlin' end as location from {SQL_FOUNDERS}""",
)
def f2(spark, sf_dir):
    homes = P.parse_pages(table(spark, sf_dir, "nation").selectExpr("n_nationkey as company_id", "'https://n.io/' as url", f"{_HOME} as html"))
    rows = C.enrich_founders(_founders(spark, sf_dir), homes)
    return rows.select("company_id", "pos", "first_name", "last_name", "bio", "avatar_url", "personal_website", "location")


@query("f3_founder_confidence", f"select company_id, pos, founder_percent from {SQL_SCORED}")
def f3(spark, sf_dir):
    return C.score_founders(_founders(spark, sf_dir)).select("company_id", "pos", "founder_percent")


@query(
    "f4_founder_report",
    f"""select n.n_nationkey as company_id, coalesce(c.n, 0) as founders_found, f.full_name as primary_founder, cast(coalesce(f.founder_percent, 0) as int) as percent, c.n is null as empty from nation n left join
    (select company_id, count(*) as n from {SQL_SCORED} group by 1) c on c.company_id = n.n_nationkey left join
    (select *, row_number() over (partition by company_id order by founder_percent desc, lower(coalesce(full_name, '')), pos) as rn from {SQL_SCORED}) f on f.company_id = n.n_nationkey and rn = 1""",
)
def f4(spark, sf_dir):
    companies = table(spark, sf_dir, "nation").selectExpr("n_nationkey as company_id")
    return C.founder_report(C.score_founders(_founders(spark, sf_dir)), companies).drop("primary_founder_email")


# --- address patterns ------------------------------------------------------------------------

SQL_PATTERN_RULES = "(values " + ", ".join(f"({i}, {_quote(n)}, {p})" for i, (n, _, p) in enumerate(E.rules.PATTERNS)) + ") r(rank, pattern, base)"
_DOC_MAILS = f"""(select distinct e as email, regexp_extract(e, '@([^@]*)$', 1) as domain, regexp_extract(e, '^(.*)@[^@]*$', 1) as local from
 (select lower(unnest(regexp_extract_all(text, '{EMAIL_PATTERN}'))) as e from {SQL_MAIL_DOCS} union all select case c_custkey % 4 when 0 then 'info' when 1 then 'j_doe' when 2 then 'jane' else 'x.y' || c_custkey end || '@n' || c_nationkey || '.io' from customer))"""
_MATCH = """case when contains(local, '.') and length(split_part(local, '.', 1)) = 1 and local <> split_part(local, '.', 1) || '.' then 'f.lastname'
 when contains(local, '.') and split_part(local, '.', 1) <> '' and local <> split_part(local, '.', 1) || '.' then 'first.last'
 when contains(local, '_') and split_part(local, '_', 1) <> '' and local <> split_part(local, '_', 1) || '_' then 'first_last'
 when regexp_full_match(regexp_replace(local, '[^a-z0-9]', '', 'g'), '[a-z]+') then 'firstname' end"""
SQL_INFERRED = f"""(select d.domain, r.rank, r.pattern, case when p.n is not null and g.n > 0 then least(98, least(95, 80 + 5 * (p.n - 1)) + 10) when p.n is not null then least(95, 80 + 5 * (p.n - 1)) when g.n > 0 then least(85, r.base + 10) end as percent
 from (select distinct domain from {_DOC_MAILS}) d cross join {SQL_PATTERN_RULES}
 left join (select domain, {_MATCH} as pattern, count(*) as n from {_DOC_MAILS} where local not in {sql_in(E.rules.GENERIC)} group by 1, 2) p on p.domain = d.domain and p.pattern = r.pattern
 left join (select domain, count(*) as n from {_DOC_MAILS} where local in {sql_in(E.rules.GENERIC)} group by 1) g on g.domain = d.domain where p.n is not null or g.n > 0)"""


def known_mails(spark, sf_dir):
    docs = P.unnest(mail_documents(spark, sf_dir), N.find_emails(F.col("text")), "email", [])
    more = table(spark, sf_dir, "customer").selectExpr(
        "case c_custkey % 4 when 0 then 'info' when 1 then 'j_doe' when 2 then 'jane' else 'x.y' || cast(c_custkey as string) end || '@n' || cast(c_nationkey as string) || '.io' as email"
    )
    return docs.select(F.lower("email").alias("email")).unionByName(more).distinct()


@query("e1_infer_email_patterns", f"select domain, pattern, cast(percent as int) as percent from {SQL_INFERRED}")
def e1(spark, sf_dir):
    return E.infer_patterns(known_mails(spark, sf_dir)).select("domain", "pattern", "percent")


_SQL_TOKENS = f"""(select pos, company_id, 'n' || company_id || '.io' as domain, case when len(t) >= 1 then t[1] end as first, case when len(t) >= 2 then t[-1] else '' end as last from
 (select pos, company_id, list_filter(list_transform(string_split_regex(lower(trim(full_name)), '\\s+'), lambda x: regexp_replace(x, '[^a-z0-9]', '', 'g')), lambda x: x <> '') as t from {SQL_CONTACTS} where full_name is not null))"""
_SQL_ADDRESS = """case pattern when 'firstname' then first when 'lastname' then nullif(last, '') when 'first.last' then case when last <> '' then first || '.' || last end when 'first_last' then case when last <> '' then first || '_' || last end
 when 'firstlast' then case when last <> '' then first || last end when 'flast' then case when last <> '' then first[1:1] || last end when 'firstl' then case when last <> '' then first || last[1:1] end else case when last <> '' then first[1:1] || '.' || last end end"""
SQL_ADDRESSES = f"""(select a.company_id, a.pos, a.domain, a.rank, a.pattern, a.local || '@' || a.domain as address, coalesce(i.percent, case when a.last <> '' then a.base else greatest(35, a.base - 15) end) as percent from
 (select t.*, rank, pattern, base, {_SQL_ADDRESS} as local from {_SQL_TOKENS} t cross join {SQL_PATTERN_RULES} where first is not null) a left join {SQL_INFERRED} i on i.domain = a.domain and i.pattern = a.pattern where a.local is not null)"""


def _named(spark, sf_dir):
    return contact_rows(spark, sf_dir).withColumn("domain", F.concat(F.lit("n"), F.col("company_id").cast("string"), F.lit(".io")))


@query("e2_generate_addresses", f"select pos, pattern, address, cast(percent as int) as percent from {SQL_ADDRESSES}")
def e2(spark, sf_dir):
    rows = E.generate_addresses(_named(spark, sf_dir), E.infer_patterns(known_mails(spark, sf_dir)))
    return rows.select("pos", "pattern", "address", "percent")


@query(
    "e3_email_pattern_report",
    f"""select b.domain, b.pattern as inferred_pattern, cast(b.percent as int) as percent, s.candidates from (select domain, pattern, max(percent) as percent, row_number() over (partition by domain order by max(percent) desc, rank) as rn from {SQL_ADDRESSES} group by domain, rank, pattern) b
    join (select domain, count(distinct lower(address)) as candidates from {SQL_ADDRESSES} group by 1) s on s.domain = b.domain where rn = 1""",
)
def e3(spark, sf_dir):
    addresses = E.generate_addresses(_named(spark, sf_dir), E.infer_patterns(known_mails(spark, sf_dir)))
    return E.pattern_report(addresses)


@query("e4_name_tokens", f"select pos, first, last from {_SQL_TOKENS}")
def e4(spark, sf_dir):
    rows = contact_rows(spark, sf_dir).filter("full_name is not null").withColumn("t", E.name_tokens(F.col("full_name")))
    return rows.select("pos", "t.first", "t.last")
