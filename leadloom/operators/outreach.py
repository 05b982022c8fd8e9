"""Outreach texts and recipients (family O): projections over the assembled lead table."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions.people import is_hiring_inbox, is_outbound_safe, normalize_person_name
from leadloom.functions.text import blank_to_null, first_case, let, squash, strip, text_or_empty, title_case, words
from leadloom.operators.ordering import first_per_key, top_per_key
from leadloom.operators.scoring import NO_STRINGS, NO_TEXT, validation_lead_score, with_defaults
from leadloom.rules import outreach as rules


def fill(template: str, **values: Column) -> Column:
    """Template with ``{name}`` placeholders as one concatenation."""
    pieces = re.split(r"\{(\w+)\}", template)
    parts = [F.lit(p) if i % 2 == 0 else text_or_empty(values[p].cast("string")) for i, p in enumerate(pieces) if p]
    return F.concat(*parts)


def outreach_mode(flutter_jobs: Column, mobile_jobs: Column, jobs_found: Column, engineering: Column, has_mobile_app: Column) -> Column:
    """hiring, freelance or none; an unknown app counts as no app."""
    n = lambda c: F.coalesce(c, F.lit(0))
    hiring = (n(flutter_jobs) > 0) | (n(mobile_jobs) > 0) | ((n(jobs_found) > 0) & F.coalesce(engineering, F.lit(False)))
    return F.when(hiring, "hiring").when(~F.coalesce(has_mobile_app, F.lit(False)), "freelance").otherwise("none")


def pick_recipient(companies: DataFrame, contacts: DataFrame, best: DataFrame, emails: DataFrame) -> DataFrame:
    """One mail recipient per company, or none.

    ``companies`` holds company_id and outreach_mode; ``contacts`` first_pos, contact_score, full_name
    and email; ``best`` the chosen contact; ``emails`` plain addresses. Order: hiring mailboxes (hiring
    mode only), best contact, contacts by confidence, plain addresses; only outbound-safe ones.
    """
    cols = ["company_id", "kind", "rank_a", "rank_b", "full_name", "email"]
    none = F.lit(None).cast("string")
    people = contacts.select(
        "company_id", F.lit("contact").alias("kind"), (-F.col("contact_score")).cast("bigint").alias("rank_a"),
        F.col("first_pos").cast("string").alias("rank_b"), "full_name", "email",
    )
    chosen = best.select("company_id", F.lit("best").alias("kind"), F.lit(0).cast("bigint").alias("rank_a"), F.lit("").alias("rank_b"), "full_name", "email")
    plain = emails.select("company_id", F.lit("plain").alias("kind"), F.lit(0).cast("bigint").alias("rank_a"), F.col("email").alias("rank_b"), none.alias("full_name"), "email")
    rows = people.select(*cols).unionByName(chosen.select(*cols)).unionByName(plain.select(*cols)).filter(F.col("email").isNotNull())
    hiring_mode = companies.select("company_id", (F.col("outreach_mode") == "hiring").alias("_hiring"))
    judged = rows.join(hiring_mode, "company_id").withColumn("_box", F.col("_hiring") & is_hiring_inbox(F.col("email")))
    safe = judged.filter(is_outbound_safe(F.col("email"), F.col("_hiring")))
    step = (
        F.when(F.col("_box") & (F.col("kind") == "plain"), 1)
        .when(F.col("_box") & (F.col("kind") == "contact"), 2)
        .when(F.col("kind") == "best", 3)
        .when(F.col("kind") == "contact", 4)
        .otherwise(5)
    )
    stepped = safe.withColumn("_step", step)
    top = first_per_key(stepped, ["company_id"], ["_step", "rank_a", F.length("rank_b"), "rank_b"])
    name = F.when(F.col("_step") == 1, F.lit("Hiring team")).otherwise(
        F.coalesce(normalize_person_name(F.col("full_name")), F.lit("there"))
    )
    return top.select("company_id", name.alias("recipient_name"), F.col("email").alias("recipient_email"))


# --- texts -----------------------------------------------------------------------------------

def join_names(values: Column) -> Column:
    """``a``, ``a and b``, ``a, b, and c``."""

    def shape(v: Column) -> Column:
        n = F.size(v)
        head = F.array_join(F.slice(v, F.lit(1), F.greatest(n - 1, F.lit(0))), ", ")
        last = F.try_element_at(v, F.lit(-1))
        return (
            F.when(n == 0, "their product")
            .when(n == 1, last)
            .when(n == 2, F.concat(head, F.lit(" and "), last))
            .otherwise(F.concat(head, F.lit(", and "), last))
        )

    return let(F.filter(F.transform(values, lambda v: strip(v)), lambda v: v != ""), shape)


def first_sentence(text: Column, separators: Sequence[str] = (". ", "! ", "? ")) -> Column:
    """Text before the first separator that occurs, in the order given."""

    def cut(t: Column) -> Column:
        return first_case(
            [(F.contains(t, F.lit(s)), strip(F.substring_index(t, s, 1))) for s in separators], t
        )

    return let(squash(text_or_empty(text)), cut)


def product_hook(candidates: Sequence[Column], product_label: Column, audience: Column, limit: int | None = None) -> Column:
    """Product phrase: first sentence of the first usable description, lower-case start; abbreviated beyond ``limit``."""

    def shorten(t: Column) -> Column:
        if limit is None:
            return t
        cut = F.regexp_replace(F.substring(t, 1, limit - 3), r" [^ ]*$", "")
        return F.when(F.length(t) > limit, F.concat(F.rtrim(cut, F.lit(",;:")), F.lit("…"))).otherwise(t)

    def lower_start(t: Column) -> Column:
        return F.concat(F.lower(F.substring(t, 1, 1)), F.substr(t, F.lit(2), F.length(t)))

    texts = F.transform(F.array(*candidates), lambda c: let(first_sentence(c), shorten))
    first = F.try_element_at(F.filter(texts, lambda t: F.length(t) >= 12), F.lit(1))
    return F.coalesce(lower_start(first), F.concat(F.lit("building "), product_label, F.lit(" for "), audience))


PERSONALIZE_DEFAULTS = {
    "company_name": "'your company'", "short_description": NO_TEXT, "description": NO_TEXT, "site_description": NO_TEXT,
    "product_type": NO_TEXT, "business_category": NO_TEXT, "industry": NO_TEXT, "target_audience": NO_TEXT,
    "technologies": NO_STRINGS, "has_mobile_app": "cast(null as boolean)", "android": "false", "ios": "false",
    "qualified": "cast(null as boolean)", "qualification_score": "0", "reasons": NO_STRINGS, "outreach_mode": "'none'",
    "hiring_summary": "''", "contact_name": NO_TEXT, "is_flutter_lead": "false", "has_contacts": "false",
    "has_profile": "false", "has_errors": "false", "site_valid": "true",
}


def personalize(leads: DataFrame) -> DataFrame:
    """Adds the text pieces of a message: summary, opening, mobile, technology and qualification lines,
    value proposition, call to action, warnings and confidence (percent)."""
    df = with_defaults(leads, PERSONALIZE_DEFAULTS)
    c = F.col
    company = c("company_name")
    given = lambda *names: F.coalesce(*[blank_to_null(strip(c(n))) for n in names])
    label = F.coalesce(given("product_type", "business_category"), F.lit("SaaS platform"))
    audience = F.coalesce(given("target_audience"), F.lit("growing teams"))
    description = F.coalesce(given("short_description", "description", "site_description"), F.lit(rules.NO_DESCRIPTION))
    known = given("business_category", "industry").isNotNull()
    has_app = F.coalesce(c("has_mobile_app"), F.lit(False))
    hook = product_hook([c("short_description"), c("description"), c("site_description")], label, audience)
    stores = F.array_compact(
        F.array(F.when(c("android"), F.lit("Google Play")), F.when(c("ios"), F.lit("the App Store")))
    )
    store_clause = F.when(F.size(stores) > 0, F.concat(F.lit(" on "), join_names(stores))).otherwise("")
    reasons = F.when(
        F.size("reasons") > 0, F.concat(F.lit(" based on "), join_names(F.col("reasons")))
    ).otherwise("")
    mode, name = c("outreach_mode"), blank_to_null(c("contact_name"))
    roles = F.coalesce(blank_to_null(c("hiring_summary")), F.lit("your open mobile/engineering roles"))
    value = (
        F.when(mode == "hiring", fill(rules.VALUE_HIRING, roles=roles, company=company))
        .when(mode == "freelance", fill(rules.VALUE_FREELANCE, company=company))
        .when(c("is_flutter_lead"), fill(rules.VALUE_FLUTTER, company=company))
        .otherwise(F.when(has_app, rules.VALUE_MOBILE).otherwise(rules.VALUE_GENERIC))
    )
    cta = (
        F.when((mode == "hiring") & name.isNotNull(), fill(rules.CTA_HIRING_NAMED, name=name, company=company))
        .when(mode == "hiring", fill(rules.CTA_HIRING, company=company))
        .when((mode == "freelance") & name.isNotNull(), fill(rules.CTA_FREELANCE_NAMED, name=name, company=company))
        .when(mode == "freelance", fill(rules.CTA_FREELANCE, company=company))
        .when(name.isNotNull(), rules.CTA_NAMED)
        .when(c("is_flutter_lead"), rules.CTA_FLUTTER)
        .otherwise(fill(rules.CTA_GENERIC, company=company))
    )
    n_tech = F.size("technologies")
    warnings = F.array_compact(
        F.array(
            F.when(n_tech == 0, F.lit(rules.WARN_TECHNOLOGY)),
            F.when(~c("has_contacts"), F.lit(rules.WARN_CONTACTS)),
            F.when(c("qualified").isNull(), F.lit(rules.WARN_QUALIFICATION)),
            F.when(c("has_mobile_app").isNull(), F.lit(rules.WARN_MOBILE)),
            F.when(has_app, F.lit(rules.WARN_APP)),
            F.when(c("has_errors"), F.lit(rules.WARN_ERRORS)),
            F.when(~c("site_valid"), F.lit(rules.WARN_INVALID)),
        )
    )
    pct = lambda test, points: F.when(test, points).otherwise(0)
    confidence = (
        F.lit(35)
        + pct(c("has_profile"), 15)
        + F.least(F.lit(20), n_tech * 5)
        + pct(c("qualified").isNotNull(), 15)
        + pct(c("has_contacts"), 15)
        + pct(c("has_mobile_app").isNotNull(), 5)
        - pct(has_app, 10)
        - F.least(F.lit(25), F.size(warnings) * 5)
    )
    return df.withColumns(
        {
            "company_summary": F.when(
                known,
                fill(
                    rules.SUMMARY_FULL, company=company, category=F.coalesce(given("business_category"), F.lit("software")),
                    industry=F.coalesce(given("industry"), label), description=description,
                ),
            ).otherwise(fill(rules.SUMMARY_BASIC, company=company, product_label=label, description=description)),
            "opening": fill(rules.OPENING, company=company, hook=hook),
            "mobile_line": F.when(has_app, fill(rules.MOBILE_PRESENT, company=company, stores=store_clause)).otherwise(
                fill(rules.MOBILE_NONE, company=company)
            ),
            "technology_line": F.when(n_tech == 0, rules.TECH_MISSING).otherwise(
                fill(rules.TECH_PRESENT, technologies=join_names(c("technologies")))
            ),
            "qualification_line": F.when(c("qualified").isNull(), rules.QUALIFICATION_MISSING)
            .when(c("qualified"), fill(rules.QUALIFIED, score=c("qualification_score"), reasons=reasons))
            .otherwise(fill(rules.UNQUALIFIED, score=c("qualification_score"), reasons=reasons)),
            "value_proposition": value,
            "cta": cta,
            "text_warnings": warnings,
            "text_percent": F.greatest(F.lit(0), F.least(F.lit(100), confidence)),
        }
    )


def product_keyword(description: Column, company: Column) -> Column:
    """Short phrase from a product description: first sentence, leading "Company is" dropped, five words."""
    separators = (". ", "! ", "? ", " — ", " - ")

    def trim_lead(x: Column) -> Column:
        t, name = x["t"], x["c"]
        lowered = F.lower(t)
        leads = F.concat(
            F.transform(words((" is ", " are ", " — ", " - ")), lambda s: F.concat(name, s)), words(("we are ", "we're "))
        )
        lead = F.try_element_at(F.filter(leads, lambda p: F.startswith(lowered, p)), F.lit(1))
        return strip(F.when(lead.isNull(), t).otherwise(F.substr(t, F.length(lead) + 1, F.length(t))))

    def five_words(t: Column) -> Column:
        parts = F.split(t, r"\s+")
        return F.when(F.size(parts) > 5, F.rtrim(F.array_join(F.slice(parts, 1, 5), " "), F.lit(",;:"))).otherwise(t)

    start = F.struct(first_sentence(description, separators).alias("t"), F.lower(strip(text_or_empty(company))).alias("c"))
    return F.btrim(let(let(start, trim_lead), five_words), F.lit(" ."))


def fallback_subject(company: Column, description: Column, has_mobile_app: Column) -> Column:
    """One of the subject lines, chosen by a stable hash of the company name, at most nine words."""
    name = F.coalesce(blank_to_null(strip(company)), F.lit("your product"))

    def choose(x: Column) -> Column:
        lines = lambda table: F.array(*[fill(t, company=x["c"], hook=x["h"]) for t in table])
        none = F.array().cast("array<string>")
        hooked = lambda table: F.when(x["h"] != "", lines(table)).otherwise(none)
        candidates = F.when(
            F.coalesce(has_mobile_app, F.lit(False)),
            F.concat(lines(rules.SUBJECTS_WITH_APP), hooked(rules.SUBJECTS_WITH_APP_HOOK)),
        ).otherwise(F.concat(lines(rules.SUBJECTS), hooked(rules.SUBJECTS_HOOK)))
        pick = let(candidates, lambda s: F.get(s, F.pmod(F.crc32(F.lower(x["c"])), F.size(s)).cast("int")))
        return F.array_join(F.slice(F.split(strip(pick), r"\s+"), 1, rules.SUBJECT_WORDS), " ")

    return let(F.struct(name.alias("c"), product_keyword(description, name).alias("h")), choose)


def fallback_emails(texts: DataFrame) -> DataFrame:
    """Deterministic message out of the text pieces: email_subject, email_opening, email_body, email_cta.

    Needs the columns of ``personalize`` plus product_description and contact_first_name.
    """
    first = blank_to_null(strip(text_or_empty(F.col("contact_first_name"))))
    greeted = first.isNotNull()
    return texts.withColumns(
        {
            "email_subject": fallback_subject(F.col("company_name"), F.col("product_description"), F.col("has_mobile_app")),
            "email_opening": F.when(greeted, F.concat(F.lit("Hi "), first, F.lit(","))).otherwise(F.col("opening")),
            "email_body": F.concat_ws(
                "\n\n", F.when(greeted, blank_to_null(F.col("opening"))), blank_to_null(F.col("mobile_line")), blank_to_null(F.col("value_proposition"))
            ),
            "email_cta": F.col("cta"),
            "generation_source": F.lit("fallback"),
        }
    )


def is_generic_subject(subject: Column) -> Column:
    text = F.lower(squash(text_or_empty(subject)))
    return text.rlike("^($|" + "|".join(re.escape(p) for p in rules.GENERIC_SUBJECTS) + ")")


def has_wrong_brand(subject: Column, company: Column) -> Column:
    """A brand of the prompt examples that is not part of this company's name."""
    pair = F.struct(F.lower(squash(text_or_empty(subject))).alias("s"), F.lower(squash(text_or_empty(company))).alias("c"))
    return let(
        pair,
        lambda x: F.exists(words(rules.EXAMPLE_BRANDS), lambda b: F.contains(x["s"], b) & ~F.contains(x["c"], b)),
    )


def parse_generated(raw: Column, required: Sequence[str] = rules.REQUIRED_FIELDS) -> Column:
    """Model answer to a field map; null unless it is one JSON object with the required fields and no code fence."""
    body = F.when(
        F.startswith(strip(raw), F.lit("```")), F.regexp_replace(raw, r"(?m)^\s*```.*$\n?", "")
    ).otherwise(raw)
    fields = F.from_json(F.regexp_extract(body, r"(?s)(\{.*\})", 1), "map<string,string>")

    def check(m: Column) -> Column:
        complete = F.forall(words(required), lambda k: strip(text_or_empty(F.try_element_at(m, k))) != "")
        fenced = F.exists(F.map_values(m), lambda v: F.contains(text_or_empty(v), F.lit("```")))
        return F.when(m.isNotNull() & complete & ~fenced, m)

    return let(fields, check)


def check_generated(answers: DataFrame, fallback: DataFrame, key: str = "company_id") -> DataFrame:
    """Model answers (key, raw, company_name) over the fallback messages; bad answers and subjects fall back."""
    parsed = answers.select(key, parse_generated(F.col("raw")).alias("_m"))
    joined = fallback.join(parsed, key, "left")
    take = lambda name: F.try_element_at("_m", F.lit(name))
    ok = F.col("_m").isNotNull()
    bad_subject = is_generic_subject(take("subject")) | has_wrong_brand(take("subject"), F.col("company_name"))
    return joined.withColumns(
        {
            "email_subject": F.when(ok & ~bad_subject, take("subject")).otherwise(F.col("email_subject")),
            "email_opening": F.when(ok, take("opening")).otherwise(F.col("email_opening")),
            "email_body": F.when(ok, take("body")).otherwise(F.col("email_body")),
            "email_cta": F.when(ok, take("cta")).otherwise(F.col("email_cta")),
            "generation_source": F.when(ok, F.lit("model")).otherwise(F.col("generation_source")),
        }
    ).drop("_m")


# --- placeholders ----------------------------------------------------------------------------

def resolve_first_name(name: Column) -> Column:
    """First word of a person-like name in title case; blank for generic or title-like names."""

    def shape(n: Column) -> Column:
        unlikely = (
            (n == "") | F.lower(n).isin(*rules.GENERIC_NAMES) | n.rlike("[:—]") | (F.length(n) > 40)
            | (F.size(F.split(n, " ")) >= 4)
        )
        return F.when(unlikely, "").otherwise(title_case(F.regexp_extract(n, r"^(\S+)", 1)))

    return let(squash(text_or_empty(name)), shape)


def _slot(keys: str) -> str:
    return r"\{\{\s*(?i:" + keys + r")\s*\}\}"


def _quoted(c: Column) -> Column:
    """Replacement text taken literally."""
    return F.regexp_replace(c, r"([\\$])", r"\\$1")


def scrub_text(text: Column, recipient: Column, sender: Column, keep_sender: bool = True) -> Column:
    """Fill or drop template placeholders, remove empty greetings, tidy blank lines."""
    first = resolve_first_name(recipient)
    whole = F.when(F.lower(strip(text_or_empty(recipient))).isin(*rules.GENERIC_NAMES), "").otherwise(
        strip(text_or_empty(recipient))
    )
    sent_by = strip(text_or_empty(sender))
    unknown = r"\{\{\s*(?!(?i:" + rules.SENDER_KEYS + r")\s*\}\})[a-zA-Z0-9_]+\s*\}\}"
    out = text_or_empty(text)
    named = F.regexp_replace(out, F.lit(_slot(rules.SENDER_KEYS)), _quoted(sent_by))
    out = F.when(sent_by != "", named).otherwise(
        out if keep_sender else F.regexp_replace(out, _slot(rules.SENDER_KEYS), "")
    )
    out = F.regexp_replace(out, F.lit(_slot(rules.FIRST_NAME_KEYS)), _quoted(first))
    out = F.regexp_replace(out, F.lit(_slot(rules.FULL_NAME_KEYS)), _quoted(F.coalesce(blank_to_null(first), whole)))
    out = F.regexp_replace(out, unknown, "")
    out = F.regexp_replace(out, r"(?imd)^(?:hi|hello|hey)\s*,\s*(?:\n|$)", "")
    out = F.regexp_replace(out, r"(?imd)^(?:hi|hello|hey)\s+,", "")
    out = F.regexp_replace(out, r"[ \t]+\n", "\n")
    return strip(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def has_contact_placeholder(text: Column) -> Column:
    return text_or_empty(text).rlike(r"\{\{\s*(?!(?i:" + rules.SENDER_KEYS + r")\s*\}\})[a-zA-Z0-9_]+\s*\}\}")


def scrub_texts(df: DataFrame, text_col: str, recipient_col: str, sender_name: str = "", keep_sender: bool = True) -> DataFrame:
    """The placeholder job over one text column."""
    return df.withColumn(text_col, scrub_text(F.col(text_col), F.col(recipient_col), F.lit(sender_name), keep_sender))


def signature_block(name: Column, linkedin: Column, github: Column, phone: Column) -> Column:
    line = lambda label, c: F.when(strip(text_or_empty(c)) != "", F.concat(F.lit(label), strip(c)))
    digits = F.regexp_replace(text_or_empty(phone), r"\D", "")
    return F.concat_ws(
        "\n",
        F.lit(rules.CLOSING),
        F.coalesce(blank_to_null(strip(text_or_empty(name))), F.lit(rules.SENDER_PLACEHOLDER)),
        line("LinkedIn: ", linkedin),
        line("GitHub: ", github),
        F.when(digits != "", line("Call or WhatsApp: ", phone)),
    )


def compose_body(
    opening: Column, body: Column, cta: Column, recipient: Column, sender: Column,
    linkedin: Column | None = None, github: Column | None = None, phone: Column | None = None,
) -> Column:
    """Opening, body, call to action and signature joined by blank lines, placeholders resolved."""
    blank = F.lit("")
    signature = signature_block(sender, linkedin if linkedin is not None else blank, github if github is not None else blank, phone if phone is not None else blank)
    whole = F.concat_ws("\n\n", *[blank_to_null(strip(text_or_empty(c))) for c in (opening, body, cta)], signature)
    return scrub_text(whole, recipient, sender, keep_sender=True)


def finalize_body(body: Column, recipient: Column, sender: Column, linkedin: Column, github: Column, phone: Column) -> Column:
    """Last pass before sending: placeholders gone, signature links added once."""
    name = strip(text_or_empty(sender))
    clean = scrub_text(body, recipient, sender, keep_sender=False)
    signature = signature_block(sender, linkedin, github, phone)
    simple = F.concat(F.lit(rules.CLOSING + "\n"), name)
    head = F.substr(clean, F.lit(1), F.length(clean) - F.length(simple))
    return F.when((name != "") & F.endswith(clean, simple), F.concat(head, signature)).otherwise(clean)


# --- prompts ---------------------------------------------------------------------------------

# Task lines per outreach mode.
TASKS = {
    "hiring": "Write one short hiring / contract outreach email for a Flutter mobile developer applying to or offering help with this company's open roles.",
    "freelance": "Write one short freelance / contract cold email offering a Flutter mobile build for this product team.",
    "none": "Write one cold email that shows a real observation about this company's product.",
}
FACTS = (
    "Company brand name: {company_name}\nWebsite: {website}\nWhat they build (use this): {product_description}\n"
    "Outreach mode: {outreach_mode}\nHiring / roles signal: {hiring_summary}\nIndustry/category: {industry} / {category}\n"
    "Native mobile app found: {app}\nMobile note: {mobile_line}\nFlutter/Dart evidence: {flutter}\n"
    "Contact first name (only if real): {first_name}\nKnown contacts: {contacts}\n\n"
    "Stack signals: {stack}\nLead score: {score}"
)


def contacts_summary(
    contacts: DataFrame, emails: DataFrame | None = None, most_contacts: int | None = None, most_emails: int | None = None
) -> DataFrame:
    """Per company the usable names among its contacts in order, else its addresses; top-n only where asked."""
    order = [F.desc("contact_score"), F.asc("contact_priority"), F.asc("first_pos")]
    if most_contacts is None:
        sort_key = F.struct((-F.col("contact_score")).alias("a"), F.col("contact_priority").alias("b"), F.col("first_pos").alias("c"))
        top = contacts.withColumn("_n", sort_key)
    else:
        top = top_per_key(contacts, ["company_id"], order, most_contacts, "_n")
    name = normalize_person_name(F.col("full_name"))
    line = F.concat_ws(
        " ", name, F.concat(F.lit("("), F.col("role"), F.lit(")")), F.concat(F.lit("<"), F.col("email"), F.lit(">"))
    )
    lines = top.withColumn("_line", F.when(name.isNotNull(), line)).groupBy("company_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.when(F.col("_line").isNotNull(), F.struct("_n", "_line")))), lambda x: x["_line"]), "; "
        ).alias("_names")
    )
    if emails is None:
        return lines.select("company_id", F.coalesce(blank_to_null(F.col("_names")), F.lit("No contacts discovered")).alias("contacts_summary"))
    listed = emails.select("company_id", "email").distinct()
    if most_emails is not None:
        listed = top_per_key(listed, ["company_id"], ["email"], most_emails, "_n")
    three = listed.groupBy("company_id").agg(
        F.array_join(F.array_sort(F.collect_list("email")), ", ").alias("_mails")
    )
    joined = lines.join(three, "company_id", "full_outer")
    mails = F.concat(F.lit("Emails found: "), F.col("_mails"))
    return joined.select(
        "company_id", F.coalesce(blank_to_null(F.col("_names")), mails, F.lit("No contacts discovered")).alias("contacts_summary")
    )


PROMPT_DEFAULTS = {
    "website": "''", "product_description": NO_TEXT, "contacts_summary": "'No contacts discovered'", "contact_first_name": "''",
    "emails_found": "0", "mobile_line": "''", "company_summary": "''",
}


def build_prompts(texts: DataFrame, kind: str = "email", guide: str = "", previous_subject: str = "", days_since_sent: int = 3) -> DataFrame:
    """Prompt table for offline inference: prompt, prompt_length and token_estimate.

    ``kind`` is email, subject or followup; ``guide`` is free text put under the task line.
    """
    df = with_defaults(with_defaults(texts, PERSONALIZE_DEFAULTS), PROMPT_DEFAULTS)
    c = F.col
    has_app = F.coalesce(c("has_mobile_app"), F.lit(False))
    description = F.coalesce(
        *[blank_to_null(strip(c(n))) for n in ("product_description", "short_description", "description", "site_description", "company_summary")],
        F.lit("Product description unavailable"),
    )
    score = validation_lead_score(c("qualification_score"), c("emails_found"), F.size("technologies"), has_app, c("is_flutter_lead"))
    or_text = lambda col, default: F.coalesce(blank_to_null(strip(text_or_empty(col))), F.lit(default))
    if kind == "subject":
        task: Column = F.lit("Write ONLY a subject line of at most 8 words for this company.")
    elif kind == "followup":
        task = F.lit(f'Write a short follow-up sent {days_since_sent} days after the email with subject "{previous_subject}".')
    else:
        task = F.when(c("outreach_mode") == "hiring", TASKS["hiring"]).when(c("outreach_mode") == "freelance", TASKS["freelance"]).otherwise(TASKS["none"])
    facts = fill(
        FACTS, company_name=c("company_name"), website=or_text(c("website"), "Unknown"), product_description=description,
        outreach_mode=c("outreach_mode"), hiring_summary=or_text(c("hiring_summary"), "none"), industry=or_text(c("industry"), "Unknown"),
        category=or_text(c("business_category"), "Unknown"), app=F.when(has_app, "yes").otherwise("no"), mobile_line=c("mobile_line"),
        flutter=F.when(c("is_flutter_lead"), "yes").otherwise("no"), first_name=or_text(c("contact_first_name"), "(none)"),
        contacts=c("contacts_summary"), stack=or_text(F.array_join("technologies", ", "), "none detected"), score=F.format_string("%.1f", score),
    )
    prompt = F.concat_ws("\n\n", task, blank_to_null(F.lit(guide)), facts)
    return df.withColumn("prompt", prompt).withColumns(
        {
            "prompt_length": F.length("prompt"),
            "token_estimate": F.size(F.split(squash(F.col("prompt")), " ")),
            "prompt_score": score,
        }
    )
