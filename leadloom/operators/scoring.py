"""Additive scoring, qualification, opportunity and lead scores, assembly (families Q, X)."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions.people import is_founder_role, is_valid_email
from leadloom.functions.text import blank_to_null, contains_any, first_case, let, sql_string, strip, text_or_empty
from leadloom.functions.urls import (
    host_of,
    is_blog_host,
    is_cdn_host,
    is_launch_host,
    is_platform_host,
    is_usable_website,
    site_path,
)
from leadloom.operators.ordering import first_per_key
from leadloom.operators.rows import unnest
from leadloom.rules import scoring as rules
from leadloom.rules.scoring import ScoreConfig, ScoreRule
from leadloom.sources.normalize import moment


# --- generic scorer --------------------------------------------------------------------------

def _message(rule: ScoreRule) -> str:
    """SQL text of a rule's message with its placeholders filled."""
    signed = f"+{rule.points}" if rule.points >= 0 else str(rule.points)
    pieces = re.split(r"\{(\w+)\}", rule.message.replace("{p}", signed))
    parts = [sql_string(p) if i % 2 == 0 else f"coalesce(cast(`{p}` as string), '')" for i, p in enumerate(pieces) if p]
    return f"concat({', '.join(parts)})" if parts else "''"


def fired_rules(config: ScoreConfig) -> Column:
    """Rules whose predicate holds, in rule order, as an array of structs (one SQL expression)."""
    active = [r for r in config.rules if not config.enabled or r.name in config.enabled]
    rows = [
        f"case when {r.predicate} then named_struct('name', {sql_string(r.name)}, 'points', {r.points}, "
        f"'message', {_message(r)}, 'warns', {str(r.is_warning or r.points < 0).lower()}, "
        f"'blocking', {str(r.blocking).lower()}) end"
        for r in active
    ]
    return F.expr("array_compact(array(" + ", ".join(rows) + "))")


def score_signals(features: DataFrame, config: ScoreConfig, prefix: str = "") -> DataFrame:
    """Adds score, band, reasons, warnings, breakdown and blocked (each with ``prefix``).

    Everything happens in the row: no shuffle, no Python.
    """
    fired = features.withColumn("_fired", fired_rules(config))
    f = F.col("_fired")

    def total(rows: Column) -> Column:
        return F.aggregate(rows, F.lit(0), lambda acc, r: acc + r["points"])

    capped = F.filter(f, lambda r: r["name"].isin(*config.capped)) if config.capped else None
    excess = F.greatest(F.lit(0), total(capped) - config.cap) if capped is not None else F.lit(0)
    notes = F.transform(F.filter(f, lambda r: (r["message"] != "") & r["warns"]), lambda r: r["message"])
    if capped is not None:
        cap_note = F.when(excess > 0, F.concat(F.lit("Contact signal cap applied (-"), excess.cast("string"), F.lit(")")))
        notes = F.array_compact(F.array_append(notes, cap_note))
    clamped = F.greatest(F.lit(config.minimum), F.least(F.lit(config.maximum), total(f) - excess))
    scored = fired.withColumns(
        {
            f"{prefix}score": clamped,
            f"{prefix}reasons": F.transform(
                F.filter(f, lambda r: (r["message"] != "") & ~r["warns"]), lambda r: r["message"]
            ),
            f"{prefix}warnings": notes,
            f"{prefix}breakdown": F.map_from_entries(F.transform(f, lambda r: F.struct(r["name"], r["points"]))),
            f"{prefix}blocked": F.exists(f, lambda r: r["blocking"]),
        }
    ).drop("_fired")
    if config.bands:
        s = F.col(f"{prefix}score")
        scored = scored.withColumn(
            f"{prefix}band", first_case([(s >= floor, name) for floor, name in config.bands], F.lit(config.lowest_band))
        )
    return scored


def fired_rows(features: DataFrame, config: ScoreConfig, key: str = "company_id") -> DataFrame:
    """Long form: one row per company and fired rule (key, name, points)."""
    rows = unnest(features, fired_rules(config), "r", [key])
    return rows.select(key, "r.name", "r.points")


def total_points(rows: DataFrame, key: str = "company_id", minimum: int = 0, maximum: int = 100) -> DataFrame:
    """Clamped sum of rule points per key, whatever job wrote the rows."""
    total = F.coalesce(F.sum("points"), F.lit(0))
    return rows.groupBy(key).agg(F.greatest(F.lit(minimum), F.least(F.lit(maximum), total)).cast("int").alias("score"))


def with_weights(config: ScoreConfig, weights: Mapping[str, int]) -> ScoreConfig:
    """The same rules with other points."""
    return replace(config, rules=tuple(replace(r, points=weights.get(r.name, r.points)) for r in config.rules))


def with_defaults(df: DataFrame, defaults: Mapping[str, str]) -> DataFrame:
    """Missing feature columns with their default (SQL), present nulls filled where the default is not null."""
    out = {}
    for name, default in defaults.items():
        value = F.expr(default)
        if name not in df.columns:
            out[name] = value
        elif not default.startswith("cast(null"):
            out[name] = F.coalesce(F.col(name), value)
    return df.withColumns(out)


# --- qualification ---------------------------------------------------------------------------

NO_STRINGS = "cast(array() as array<string>)"
NO_TIME = "cast(null as timestamp)"
NO_TEXT = "cast(null as string)"

QUALIFICATION_DEFAULTS = {
    "name": "''", "website": "''", "description": "''", "source": "''", "launch_date": NO_TIME, "final_url": "''",
    "page_title": "''", "has_contact_page": "false", "has_careers_page": "false", "has_valid_business_email": "false",
    "has_any_contact": "false", "has_mobile_app": "false", "has_engineering_careers_page": "false",
    "has_remote_engineering": "false", "flutter_jobs": "0", "mobile_jobs": "0", "frontend_jobs": "0",
    "engineering_jobs": "0", "is_b2b_saas": "false", "is_enterprise_software": "false", "is_developer_tools": "false",
    "is_consumer_only": "false", "has_clear_icp": "false", "has_pricing_page": "false", "technologies": NO_STRINGS,
    "hiring_text": "''", "corpus_text": "''",
}


def age_days(launch: Column, as_of: Column | str) -> Column:
    """Whole days from launch to the reference time, rounded down."""
    seconds = F.unix_timestamp(moment(as_of)) - F.unix_timestamp(launch)
    return F.floor(seconds / 86400)


def hiring_mention(text: Column, roles: Sequence[str], markers: Sequence[str] = rules.HIRING_MARKERS) -> Column:
    """Role named next to any hiring word, else "hiring … role" within 40 characters."""
    role_pattern = "|".join(re.escape(r) for r in roles)

    def check(t: Column) -> Column:
        explicit = t.rlike(rf"\b(hiring|hire|looking for)\b.{{0,40}}\b({role_pattern})\b")
        return F.when(contains_any(t, markers), contains_any(t, roles)).otherwise(explicit)

    return let(F.lower(text_or_empty(text)), check)


def qualification_signals(features: DataFrame, as_of: Column | str) -> DataFrame:
    """Feature row to the columns the qualification rules read."""
    base = with_defaults(features, QUALIFICATION_DEFAULTS).withColumns(
        {"website": strip(F.col("website")), "description": strip(F.col("description"))}
    )
    site = F.coalesce(blank_to_null(F.col("website")), F.col("final_url"))
    effective = F.coalesce(blank_to_null(strip(F.col("final_url"))), F.col("website"))
    hired = F.coalesce(blank_to_null(F.col("hiring_text")), F.col("corpus_text"))
    tech = F.transform("technologies", lambda t: F.lower(t))
    text = F.lower(F.concat_ws(" ", "page_title", "description", "corpus_text"))
    demo_text = F.lower(F.concat_ws(" ", "website", "page_title", "description"))
    parts = F.filter(F.split(site_path(effective), "/"), lambda p: p != "")
    in_repository_space = F.lower(effective).rlike(r"^(https?://)?(www\.)?github\.com([/?#]|$)|github\.com/")
    website = F.col("website")
    return base.withColumns(
        {
            "host": host_of(site),
            "is_usable": is_usable_website(website),
            "is_platform": is_platform_host(site, rules.PLATFORM_HOSTS),
            "is_https": F.startswith(effective, F.lit("https://")) | ~website.rlike("^https?://"),
            "is_launch_host": is_launch_host(website),
            "is_cdn_host": is_cdn_host(website),
            "is_blog_host": is_blog_host(website),
            "age_days": age_days(F.col("launch_date"), as_of),
            "mentions_react": F.exists(tech, lambda t: t.isin("react", "next.js", "nextjs", "next"))
            | F.lower("corpus_text").rlike(r"react|next\.js|nextjs"),
            "mentions_flutter": F.array_contains(tech, "flutter")
            | F.lower(F.concat_ws(" ", "corpus_text", "hiring_text")).rlike("flutter"),
            "hires_flutter": hiring_mention(hired, rules.FLUTTER_ROLES),
            "hires_mobile": hiring_mention(hired, rules.MOBILE_ROLES),
            "hires_frontend": hiring_mention(hired, rules.FRONTEND_ROLES),
            "is_repository": in_repository_space
            & let(parts, lambda p: (F.size(p) >= 2) & ~p[0].isin("topics", "features", "pricing", "marketplace")),
            "is_portfolio": contains_any(text, rules.PORTFOLIO_WORDS),
            "is_demo": contains_any(demo_text, rules.DEMO_WORDS) | host_of(site).rlike(r"^demo\.|\.demo\."),
            "is_placeholder": contains_any(text, rules.PLACEHOLDER_WORDS),
        }
    )


def qualification_score(
    features: DataFrame, as_of: Column | str, config: ScoreConfig = rules.QUALIFICATION
) -> DataFrame:
    """Adds score, band, qualified, reasons and warnings."""
    scored = score_signals(qualification_signals(features, as_of), config)
    usable = (F.col("website") == "") | F.col("is_usable")
    return scored.withColumn("qualified", (F.col("score") >= config.passing) & usable)


def simple_rules(leads: DataFrame, config: ScoreConfig = rules.SIMPLE_RULES) -> DataFrame:
    """The older rule list: points plus blocking rules."""
    base = with_defaults(leads, {"name": "''", "website": "''", "description": "''", "tags": NO_STRINGS})
    cleaned = base.withColumns({c: strip(F.col(c)) for c in ("name", "website", "description")})
    local = F.lower("website").rlike(r"localhost|^127\.0\.0\.1")
    return score_signals(cleaned.withColumn("is_localhost", local), config)


def _joined(*parts: Column) -> Column:
    """Non-blank parts joined by one blank."""
    return strip(F.concat_ws(" ", *[blank_to_null(p) for p in parts]))


def qualification_features(
    leads: DataFrame,
    profiles: DataFrame | None = None,
    technology: DataFrame | None = None,
    mobile: DataFrame | None = None,
    contacts: DataFrame | None = None,
    hiring: DataFrame | None = None,
    intelligence: DataFrame | None = None,
) -> DataFrame:
    """One wide feature row per lead out of the per-company reports, all keyed by company_id.

    Every report is one row per company, so each join keeps the row count; columns a report lacks
    take their default.
    """
    out = leads
    for part in (profiles, technology, mobile, contacts, hiring, intelligence):
        if part is not None:
            clash = [c for c in part.columns if c in out.columns and c != "company_id"]
            out = out.join(part.drop(*clash), "company_id", "left")
    columns = set(out.columns)

    def get(name: str, default: str) -> Column:
        return F.coalesce(F.col(name), F.expr(default)) if name in columns else F.expr(default)

    strings = {c: get(c, NO_STRINGS) for c in ("career_pages", "jobs_pages", "contact_pages", "pricing_pages", "tags")}
    description = F.coalesce(
        blank_to_null(get("description", "''")), get("profile_description", NO_TEXT), F.lit("")
    )
    techs = F.array_distinct(F.transform(get("technologies", NO_STRINGS), lambda t: strip(t)))
    careers = (F.size(strings["career_pages"]) > 0) | (F.size(strings["jobs_pages"]) > 0)
    hiring_seen = (get("jobs_found", "0") > 0) | get("has_engineering_careers_page", "false") | get("provider", NO_TEXT).isNotNull()
    shaped = out.withColumns(
        {
            "description": description,
            "page_title": get("title", "''"),
            "launch_date": F.coalesce(get("launch_date", NO_TIME), get("discovered_at", NO_TIME)),
            "technologies": techs,
            "has_contact_page": F.size(strings["contact_pages"]) > 0,
            "has_careers_page": careers | hiring_seen,
            "has_pricing_page": get("has_pricing_page", "false") | (F.size(strings["pricing_pages"]) > 0),
            "hiring_text": _joined(
                F.array_join(strings["career_pages"], " "), F.array_join(strings["jobs_pages"], " "),
                get("roles", NO_TEXT), get("job_text", NO_TEXT), get("provider", NO_TEXT), description,
            ),
            "corpus_text": _joined(
                get("name", "''"), description, F.array_join(strings["tags"], " "), get("title", "''"),
                F.array_join(techs, " "), get("intel_text", NO_TEXT), get("keywords", NO_TEXT),
            ),
        }
    )
    return with_defaults(shaped, QUALIFICATION_DEFAULTS)


# --- opportunity -----------------------------------------------------------------------------

OPPORTUNITY_DEFAULTS = {
    "url": "''", "source": "''", "corpus": "''", "technologies": NO_STRINGS, "has_profile": "false",
    "has_technology": "false", "has_contacts": "false", "has_hiring": "false", "has_intelligence": "false",
    "has_mobile_app": "cast(null as boolean)", "android": "false", "ios": "false", "mobile_evidence": NO_STRINGS,
    "flutter_jobs": "0", "mobile_jobs": "0", "frontend_jobs": "0", "jobs_found": "0", "is_developer_tools": "false",
    "is_b2b_saas": "false", "is_enterprise_software": "false", "has_pricing_page": "false",
    "has_founder_contact": "false", "has_founder_email": "false", "decision_makers_found": "0",
    "founded_year": "cast(null as int)", "company_stage": NO_TEXT, "funding_status": NO_TEXT, "launch_date": NO_TIME,
    "has_store_links": "false", "has_viewport": "false",
}


def founder_flags(contacts: DataFrame) -> DataFrame:
    """has_founder_contact and has_founder_email per company."""
    founder = is_founder_role(F.col("role"))
    return contacts.groupBy("company_id").agg(
        F.bool_or(founder).alias("has_founder_contact"),
        F.bool_or(founder & (text_or_empty(F.col("email")) != "")).alias("has_founder_email"),
    )


def opportunity_signals(features: DataFrame, as_of: Column | str) -> DataFrame:
    """Feature row to the columns the opportunity rules read. A technology matches as a part of a name."""
    base = with_defaults(features, OPPORTUNITY_DEFAULTS).withColumn(
        "_tech", F.transform("technologies", lambda t: F.lower(strip(t)))
    ).withColumn("_text", F.lower("corpus"))
    has = lambda *names: F.exists("_tech", lambda t: t.rlike("|".join(re.escape(n) for n in names)))
    text = F.col("_text")
    year = F.year(moment(as_of))
    founded = F.when((F.col("founded_year") >= 1970) & (F.col("founded_year") <= year), F.col("founded_year"))
    report = F.col("has_mobile_app").isNotNull()
    flutter_seen = F.exists("mobile_evidence", lambda e: F.contains(F.lower(e), F.lit("flutter")))
    return base.withColumns(
        {
            "has_mobile_report": report,
            "has_mobile_app": F.coalesce("has_mobile_app", "has_store_links"),
            "has_native": F.coalesce(F.col("android") | F.col("ios"), F.lit(False)),
            "age_years": (year - founded).cast("int"),
            "age_days": age_days(F.col("launch_date"), as_of),
            "is_usable": is_usable_website(F.col("url")),
            "is_product_hunt": F.lower("source").rlike("producthunt|product_hunt|product-hunt")
            | contains_any(text, rules.LAUNCH_WORDS),
            "is_yc": contains_any(F.concat(F.lit(" "), text, F.lit(" ")), rules.YC_WORDS),
            "has_funding_news": (text_or_empty(F.col("funding_status")) != "") | contains_any(text, rules.FUNDING_WORDS),
            "has_web_stack": has("react", "next.js", "nextjs", "vue", "angular", "svelte"),
            "has_react": has("react"),
            "has_react_native": has("react native"),
            "mentions_react_native": F.contains(text, F.lit("react native")),
            "has_next": has("next"),
            "has_pwa": has("pwa") | F.contains(text, F.lit("progressive web")),
            "has_viewport": F.col("has_viewport") | F.contains(text, F.lit("responsive")),
            "has_flutter": has("flutter") | flutter_seen,
        }
    ).drop("_tech", "_text")


def opportunity_priority(score: Column, critical_hiring: Column) -> Column:
    return (
        F.when((score >= 85) & critical_hiring, "Critical")
        .when(score >= 70, "High")
        .when(score >= 50, "Medium")
        .when(score >= 30, "Low")
        .otherwise("Very Low")
    )


def opportunity_level(score: Column, priority: Column) -> Column:
    return (
        F.when(priority == "Critical", "Exceptional")
        .when(score >= 70, "Strong")
        .when(score >= 50, "Moderate")
        .when(score >= 30, "Weak")
        .otherwise("Negligible")
    )


def recommended_action(priority: Column, has_founder_email: Column) -> Column:
    return (
        F.when(priority == "Critical", "Send immediately")
        .when((priority == "High") & has_founder_email, "Send founder email")
        .when(priority == "High", "Send immediately")
        .when(priority == "Medium", "Research manually")
        .when(priority == "Low", "Wait")
        .otherwise("Ignore")
    )


def opportunity_score(features: DataFrame, as_of: Column | str, config: ScoreConfig = rules.OPPORTUNITY) -> DataFrame:
    """Adds score, priority, level, action, percent, reasons, warnings and breakdown."""
    scored = score_signals(opportunity_signals(features, as_of), config)
    critical = (F.col("flutter_jobs") > 0) | (F.col("mobile_jobs") > 0)
    ranked = scored.withColumn("priority", opportunity_priority(F.col("score"), critical))
    present = lambda c, points: F.when(F.col(c), points).otherwise(0)
    fired = F.size(F.map_keys("breakdown"))
    return ranked.withColumns(
        {
            "level": opportunity_level(F.col("score"), F.col("priority")),
            "action": recommended_action(F.col("priority"), F.col("has_founder_email")),
            "percent": F.least(
                F.lit(100),
                F.lit(20)
                + present("has_profile", 10)
                + present("has_technology", 10)
                + present("has_mobile_report", 10)
                + present("has_contacts", 10)
                + present("has_hiring", 15)
                + present("has_intelligence", 15)
                + F.least(F.lit(15), fired * 2),
            ),
        }
    )


# --- outbound lead score ---------------------------------------------------------------------

LEAD_DEFAULTS = {
    "source": "''", "website": "''", "launch_date": NO_TIME, "has_mobile_app": "cast(null as boolean)",
    "product_type": "''", "business_category": "''", "industry": "''", "intel_industry": "''", "corpus": "''",
    "is_b2b_saas": "false", "is_developer_tools": "false", "is_enterprise_software": "false", "founders_found": "0",
    "has_named_contact": "false", "has_valid_email": "false",
}


def lead_signals(features: DataFrame, as_of: Column | str) -> DataFrame:
    """The seven flags of the lead score; has_mobile_app stays null where nothing was detected."""
    f = with_defaults(features, LEAD_DEFAULTS)
    low = {c: F.lower(strip(F.col(c))) for c in ("source", "product_type", "business_category", "industry", "intel_industry", "corpus")}
    hint = "|".join(rules.PRODUCT_WORDS)
    site = F.col("website")
    return f.withColumns(
        {
            "recently_launched": low["source"].rlike("producthunt|^product_hunt$")
            | F.coalesce(age_days(F.col("launch_date"), as_of).between(0, rules.RECENT_DAYS), F.lit(False)),
            "is_product_company": low["product_type"].isin(*rules.PRODUCT_TYPES)
            | low["business_category"].rlike(hint)
            | low["industry"].rlike(hint)
            | F.col("is_b2b_saas")
            | F.col("is_developer_tools")
            | F.col("is_enterprise_software")
            | contains_any(low["corpus"], rules.PRODUCT_TEXT_WORDS),
            "has_founder_or_contact": (F.col("founders_found") > 0) | F.col("has_named_contact"),
            "is_agency_or_recruitment": low["business_category"].isin("agencies", "agency", "recruitment", "staffing")
            | low["industry"].rlike("agency|recruit|staffing")
            | low["intel_industry"].rlike("agency|^recruitment$|^staffing$")
            | contains_any(low["corpus"], rules.AGENCY_WORDS),
            "is_generic_website": ~is_usable_website(site) | is_platform_host(site, rules.GENERIC_SITE_HOSTS),
        }
    )


def lead_score(signals: DataFrame, config: ScoreConfig = rules.LEAD, min_score: int = 60) -> DataFrame:
    """Adds score, status, reasons and eligible. Every message counts as a reason."""
    scored = score_signals(signals, config)
    lines = F.concat("reasons", "warnings")
    return scored.withColumns(
        {"status": F.col("band"), "eligible": F.col("score") >= min_score, "all_reasons": lines}
    )


def validation_lead_score(score: Column, emails: Column, technologies: Column, mobile_app: Column, good: Column) -> Column:
    total = (
        score.cast("double")
        + F.least(F.lit(20.0), emails * 5.0)
        + F.least(F.lit(10.0), technologies.cast("double"))
        - F.when(mobile_app, 15.0).otherwise(0.0)
        + F.when(good, 10.0).otherwise(0.0)
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), total))


def count_decision_makers(companies: DataFrame, contacts: DataFrame) -> DataFrame:
    """Report counter where positive, else contacts in a decision role."""
    from leadloom.rules.people import DECISION_ROLES

    in_role = F.lower(text_or_empty(F.col("role"))).isin(*DECISION_ROLES)
    counts = contacts.groupBy("company_id").agg(F.count_if(in_role).alias("_n"))
    joined = companies.join(counts, "company_id", "left")
    return joined.withColumn(
        "decision_makers", F.coalesce(F.nullif("decision_makers_found", F.lit(0)), F.col("_n"), F.lit(0)).cast("bigint")
    ).drop("_n")


# --- assembly --------------------------------------------------------------------------------

def assemble_leads(companies: DataFrame, reports: Mapping[str, DataFrame]) -> DataFrame:
    """One row per company with every report as a struct, plus ``errors`` and ``missing``.

    A report with an ``error`` column that is set leaves a null struct and an error line; the other
    reports stay. Reports are keyed by company_id, one row each.
    """
    out, errors, missing = companies, [], []
    for name, report in reports.items():
        fields = [c for c in report.columns if c not in ("company_id", "error")]
        error = F.col("error") if "error" in report.columns else F.lit(None).cast("string")
        packed = report.select(
            "company_id",
            F.when(error.isNull(), F.struct(*fields)).alias(name),
            F.when(error.isNotNull(), F.concat(F.lit(f"{name}: "), error)).alias(f"_{name}_error"),
        )
        out = out.join(packed, "company_id", "left")
        errors.append(F.col(f"_{name}_error"))
        missing.append(F.when(F.col(name).isNull(), F.lit(name)))
    return out.withColumns(
        {"errors": F.array_compact(F.array(*errors)), "missing": F.array_compact(F.array(*missing))}
    ).drop(*[f"_{name}_error" for name in reports])


def lead_intelligence(companies: DataFrame, contacts: DataFrame, qualified: DataFrame | None = None) -> DataFrame:
    """Best contact, primary mail and primary founder per company.

    The best contact is the report's choice (contact_class order) when classes are known, else the
    highest score. ``contacts`` holds first_pos, contact_score, full_name, email, role.
    """
    order = [F.desc("contact_score"), F.asc("first_pos")]
    if "contact_class" in contacts.columns:
        order.insert(0, F.when(F.col("contact_class") == "decision", 1).when(F.col("contact_class") == "other", 2).otherwise(3))
    best = first_per_key(contacts, ["company_id"], order).select(
        "company_id", F.col("full_name").alias("best_contact"), F.col("email").alias("_best_email")
    )
    founders = contacts.filter(F.lower(text_or_empty(F.col("role"))).isin("founder", "co-founder", "ceo", "owner"))
    founder = first_per_key(founders, ["company_id"], [F.desc("contact_score"), F.asc("first_pos")]).select(
        "company_id", F.coalesce("full_name", "email").alias("primary_founder")
    )
    first_email = contacts.groupBy("company_id").agg(F.min(F.lower("email")).alias("_first_email"))
    out = companies
    for part in (best, founder, first_email):
        out = out.join(part, "company_id", "left")
    out = out.withColumn("primary_email", F.coalesce("_best_email", "_first_email")).drop("_best_email", "_first_email")
    if qualified is None:
        return out
    good = qualified.select("company_id", F.col("qualified").alias("is_good_lead"))
    return out.join(good, "company_id", "left").withColumn("is_good_lead", F.coalesce("is_good_lead", F.lit(False)))


# Words that count as explicit cross-platform evidence.
FLUTTER_TECHNOLOGIES = ("flutter", "dart")
FLUTTER_PATTERN = r"(?i)\bflutter\b|\bdart\b"


def flutter_evidence(
    technologies: Column, flutter_jobs: Column, evidence: Column, corpus: Column, pattern: str = FLUTTER_PATTERN
) -> Column:
    """Named technology, open role, detector evidence or text that says so."""
    named = F.exists(technologies, lambda t: F.lower(strip(t)).isin(*FLUTTER_TECHNOLOGIES))
    shown = F.exists(evidence, lambda e: e.rlike(pattern))
    return (
        F.coalesce(named, F.lit(False))
        | (F.coalesce(flutter_jobs, F.lit(0)) > 0)
        | F.coalesce(shown, F.lit(False))
        | text_or_empty(corpus).rlike(pattern)
    )


def valid_email_flags(contacts: DataFrame) -> DataFrame:
    """has_named_contact and has_valid_email per company."""
    return contacts.groupBy("company_id").agg(
        F.bool_or(text_or_empty(F.col("full_name")) != "").alias("has_named_contact"),
        F.bool_or(is_valid_email(F.col("email"))).alias("has_valid_email"),
    )
