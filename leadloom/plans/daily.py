"""Whole runs: the site report, the daily lead run and the validation run."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions.text import blank_to_null, text_or_empty
from leadloom.functions.urls import is_usable_website, website_identity
from leadloom.operators import contacts as C
from leadloom.operators import hiring as H
from leadloom.operators import leads as L
from leadloom.operators import mobile as M
from leadloom.operators import outreach as O
from leadloom.operators import pages as P
from leadloom.operators import patterns as E
from leadloom.operators import profile as B
from leadloom.operators import queue as K
from leadloom.operators import reports as R
from leadloom.operators import scoring as Q
from leadloom.operators import store as D
from leadloom.operators import technology as T
from leadloom.operators.ordering import first_per_key, join_sparse
from leadloom.rules import company as company_rules
from leadloom.rules import web
from leadloom.session import cut_lineage
from leadloom.sources.normalize import normalize_product_launches
from leadloom.sources.pages import scan_pages

def site_report(pages: DataFrame) -> DataFrame:
    """Which technologies does each distinct, usable site run, and how surely?

    The site filter and the one-page-per-site choice run on the addresses alone; page bodies are
    joined for the chosen pages only, so the large column is shuffled once and never for a dropped page.
    """
    sized = scan_pages(pages)
    chosen = first_per_key(
        sized.select("page_id", "url")
        .filter(is_usable_website(F.col("url")))
        .withColumn("identity", website_identity(F.col("url")))
        .filter(F.col("identity") != ""),
        ["identity"],
        ["page_id"],
    )
    bodies = sized.select("page_id", "html").join(chosen, "page_id")
    detected = T.detect_technologies(bodies)
    parsed = P.parse_pages(detected)
    linked = parsed.select(
        "page_id", "identity", "technologies", P.page_title().alias("title"), F.size(P.page_links(F.col("url"))).alias("n_links")
    )
    rows = T.technology_rows(linked, ("page_id", "identity", "title", "n_links"))
    return rows.select("identity", "page_id", "title", "n_links", F.col("name").alias("technology"), "category", "confidence", "tech_pos")


@dataclass(frozen=True)
class RunSettings:
    """Job parameters of a daily run."""

    as_of: str
    per_source: int | None = None
    run_limit: int | None = None
    most_pages: int | None = None
    min_lead_score: int = 60
    skip_known: bool = True
    sender_name: str = ""
    text: Mapping[str, str] = field(default_factory=dict)


def company_key(identity: Column) -> Column:
    return F.sha2(identity, 256)


def _home_pages(leads: DataFrame, index: DataFrame, snapshots: DataFrame) -> DataFrame:
    """First snapshot per company, matched by site identity; bodies join after the choice."""
    keys = index.select("page_id", "url", "identity").join(leads.select("identity", "company_id"), "identity")
    first = first_per_key(keys, ["company_id"], [F.length("url"), "page_id"])
    return P.with_bodies(first.select("page_id", "company_id", F.lit(0).alias("page_rank")), snapshots)


def enrich(leads: DataFrame, snapshots: DataFrame, most_pages: int | None = None) -> dict[str, DataFrame]:
    """Every per-company report of the usable leads, each one row per company (long tables beside).

    Pages are parsed once and written to the shared checkpoint folder; all later stages read that table.
    """
    index = cut_lineage(P.page_index(snapshots))
    homes = _home_pages(leads, index, snapshots)
    signed = M.detect_mobile(T.detect_technologies(homes), "html")
    failed = F.when(F.col("html").isNull(), F.lit("HTML download failed"))
    viewport = signed.withColumns({"has_viewport": F.contains(F.lower("html"), F.lit("viewport")), "scan_error": failed})
    home = cut_lineage(
        P.page_regions(P.page_profiles(P.parse_pages(viewport.drop("mobile_signs"))))
    )
    links = home.select("company_id", F.col("url").alias("base_url"), "links")
    wanted = [
        P.candidate_keys(links, index, paths, most_pages, "links", tokens).withColumn("use", F.lit(use))
        for use, paths, tokens in (
            ("contact", web.CONTACT_PATHS, ("contact", "about", "team", "career", "job")),
            ("hiring", web.HIRING_PATHS, web.HIRING_LINK_TOKENS),
            ("intel", web.INTEL_PATHS, web.INTEL_LINK_TOKENS),
        )
    ]
    # A page wanted for several uses is fetched and parsed once; its ranks travel as a small map.
    merged = wanted[0].unionByName(wanted[1]).unionByName(wanted[2]).groupBy("company_id", "page_id").agg(
        F.map_from_entries(F.collect_list(F.struct("use", "page_rank"))).alias("uses")
    )
    more = cut_lineage(P.parse_pages(P.with_bodies(merged, snapshots)))
    base = ["company_id", "url", "elements", "page_text", "page_pieces", "text_runs", "link_boxes", "json_ld", "json_ld_texts", "json_ld_scripts"]

    def pages_for(use: str) -> DataFrame:
        rank = F.try_element_at("uses", F.lit(use))
        extra = more.filter(rank.isNotNull()).select(*base, rank.alias("page_rank"))
        return home.select(*base, "page_rank").unionByName(extra)


    contacts = cut_lineage(C.split_contacts(C.merge_contacts(C.contact_candidates(pages_for("contact")))))
    jobs_raw = H.dedupe_page_jobs(H.extract_jobs(pages_for("hiring"), keys=("company_id", "page_rank")), ("company_id", "page_rank"))
    openings = cut_lineage(
        H.dedupe_jobs(
            jobs_raw.withColumn("pos", F.col("page_rank").cast("bigint") * F.lit(10**9) + F.col("kind") * F.lit(10**7) + F.col("pos"))
        )
    )
    hiring_links = cut_lineage(
        pages_for("hiring").select("company_id", "page_rank", F.posexplode(P.page_links(F.col("url"))).alias("link_pos", "link"))
    )
    boards = H.ats_board_rows(hiring_links.select("company_id", "link").distinct(), openings)
    jobs = cut_lineage(openings.unionByName(boards.withColumn("pos", F.lit(10**15)), allowMissingColumns=True))
    careers = home.select("company_id", (F.size("career_pages") > 0).alias("has_careers_page"))
    seen = hiring_links.select(
        "company_id", H.ats_provider(F.col("link")).alias("provider"), (F.col("page_rank").cast("bigint") * F.lit(10**9) + F.col("link_pos")).alias("pos")
    )
    sightings = seen.unionByName(openings.select("company_id", "provider", "pos")).filter("provider is not null")
    hiring = H.hiring_report(jobs, careers, sightings)
    profiles = B.company_profiles(home)
    texts = B.intel_pages(pages_for("intel")).select("company_id", "page_rank", "intel_text")
    tech = F.array_join(F.transform("technologies", lambda t: t["name"]), " ")
    heads = home.select("company_id", F.concat_ws(" ", "title", "description", tech).alias("text"))
    listed = jobs.groupBy("company_id").agg(
        F.array_sort(
            F.collect_list(F.struct((-F.col("percent")).alias("a"), F.lower("title").alias("b"), "pos", F.concat_ws(" ", "title", F.array_join("matched_keywords", " ")).alias("t")))
        ).alias("_jobs")
    )
    named = home.select("company_id", tech.alias("_tech")).join(listed, "company_id", "left").join(hiring.select("company_id", "provider"), "company_id", "left")
    tails = named.select("company_id", F.concat_ws(" ", "_tech", F.array_join(F.transform("_jobs", lambda j: j["t"]), " "), "provider").alias("text"))
    corpus = cut_lineage(B.intel_corpus(texts, heads, tails))
    keywords = B.top_keywords(corpus, "company_id", "corpus")
    first_keyword = keywords.filter("keyword_rank = 1").select("company_id", F.col("token").alias("first_keyword"))
    labelled = B.company_labels(corpus).join(first_keyword, "company_id", "left").join(
        hiring.select("company_id", "jobs_found", "engineering_jobs", "flutter_jobs"), "company_id", "left"
    ).join(
        home.select("company_id", (F.size("pricing_pages") > 0).alias("has_pricing_page"), (F.size("json_ld") > 0).alias("has_structured")), "company_id", "left"
    )
    filled = Q.with_defaults(labelled, {"jobs_found": "0", "engineering_jobs": "0", "flutter_jobs": "0", "has_pricing_page": "false"})
    intelligence = B.label_overrides(filled)
    intelligence = intelligence.withColumns(
        {
            **B.intel_flags(F.col("model"), F.col("customer")),
            "competitors": B.competitors(F.col("corpus")),
            "pain_points": B.tag_patterns(F.col("corpus"), company_rules.PAIN_POINTS),
            "opportunities": B.intel_opportunities(F.col("corpus"), F.col("flutter_jobs"), F.col("engineering_jobs")),
            "team_size": B.team_size(F.col("corpus"), F.col("jobs_found"), F.col("engineering_jobs")),
            "maturity": B.maturity(F.col("stage"), F.col("funding")),
            "confidence": B.intel_confidence(
                F.col("model"), F.col("customer"), F.col("pricing"), F.col("industry"), F.col("has_pricing_page"),
                F.col("pages_scanned"), F.col("has_structured"), F.col("jobs_found"),
            ),
        }
    )
    page_errors = home.select("company_id", "url", F.coalesce("scan_error", "parse_error").alias("e")).unionByName(
        more.select("company_id", "url", F.col("parse_error").alias("e"))
    )
    errors = page_errors.filter("e is not null").groupBy("company_id").agg(
        F.array_sort(F.collect_set(F.concat_ws(": ", "url", "e"))).alias("errors")
    )
    ranked = contacts.withColumn("pos", F.col("first_pos"))
    founders = C.score_founders(C.enrich_founders(C.select_founders(ranked), home, C.contact_lists(contacts), keywords))
    return {
        "home": home,
        "contacts": contacts,
        "contact_report": C.contact_report(contacts),
        "contact_lists": C.contact_lists(contacts),
        "founders": founders,
        "founder_report": C.founder_report(founders, leads),
        "jobs": jobs,
        "hiring": hiring,
        "profiles": profiles,
        "intelligence": intelligence,
        "errors": errors,
    }


def score(leads: DataFrame, reports: Mapping[str, DataFrame], as_of: str) -> DataFrame:
    """Wide scored row per company: qualification, opportunity and lead score."""
    home, hiring, intelligence = reports["home"], reports["hiring"], reports["intelligence"]
    names = F.transform("technologies", lambda t: t["name"])
    site = home.select(
        "company_id", "title", F.col("description").alias("profile_description"), F.col("url").alias("final_url"), "contact_pages",
        "career_pages", "jobs_pages", "pricing_pages", names.alias("technologies"), F.col("mobile.has_mobile_app").alias("has_mobile_app"),
        F.col("mobile.android").alias("android"), F.col("mobile.ios").alias("ios"), F.col("mobile.evidence").alias("mobile_evidence"),
        "has_viewport", ((F.size("app_store_links") > 0) | (F.size("play_store_links") > 0)).alias("has_store_links"),
    )
    people = reports["contact_report"].select("company_id", "contact_count", "decision_makers_found", (F.col("contact_count") > 0).alias("has_any_contact"))
    flags = Q.founder_flags(reports["contacts"]).join(Q.valid_email_flags(reports["contacts"]), "company_id", "full_outer")
    business = reports["contacts"].groupBy("company_id").agg(F.bool_or(C.is_valid_email(F.col("email"))).alias("has_valid_business_email"))
    intel = intelligence.select(
        "company_id", "model", "customer", "pricing", F.col("stage").alias("company_stage"), F.col("funding").alias("funding_status"), "industry", "subcategory",
        "is_b2b_saas", "is_enterprise_software", "is_developer_tools", "is_consumer_only", "has_clear_icp",
        F.concat_ws(" ", "industry", "subcategory", "model", "customer", "pricing").alias("intel_text"),
    )
    profile = reports["profiles"].select(
        "company_id", F.col("company_name").alias("profile_name"), "short_description", "business_category", F.col("industry").alias("profile_industry"),
        "product_type", "target_audience", "founded_year",
    )
    founders = reports["founder_report"].select("company_id", "founders_found")
    titles = reports["jobs"].groupBy("company_id").agg(
        F.concat_ws(" ", F.array_sort(F.collect_list("title"))).alias("job_text")
    )
    joined = Q.qualification_features(
        leads, site, people.join(flags, "company_id", "full_outer").join(business, "company_id", "left"), profile.join(founders, "company_id", "left"),
        titles, hiring.drop("percent", "best_job"), intel,
    )
    features = cut_lineage(joined)
    qualified = Q.qualification_score(features.withColumn("has_mobile_app", F.coalesce("has_mobile_app", F.lit(False))), as_of).select(
        "company_id", F.col("score").alias("qualification_score"), F.col("band").alias("qualification_level"), "qualified", "reasons",
    )
    opportunity = Q.opportunity_score(
        features.withColumns(
            {
                "url": F.coalesce(blank_to_null(F.col("final_url")), F.col("website")),
                "corpus": F.col("corpus_text"),
                **{n: F.col("final_url") != "" for n in ("has_profile", "has_technology", "has_contacts", "has_hiring", "has_intelligence")},
            }
        ),
        as_of,
    ).select("company_id", F.col("score").alias("opportunity_score"), "priority", "level", "action")
    lead = Q.lead_score(
        Q.lead_signals(features.withColumns({"corpus": F.lower("corpus_text"), "intel_industry": F.col("industry"), "industry": F.col("profile_industry")}), as_of)
    ).select("company_id", F.col("score").alias("lead_score"), "status", "eligible")
    return (
        features.join(qualified, "company_id", "left").join(opportunity, "company_id", "left").join(lead, "company_id", "left")
    )


def outreach(
    scored: DataFrame, reports: Mapping[str, DataFrame], settings: RunSettings, queue: DataFrame,
    mail_verdicts: DataFrame | None = None, mailbox_verdicts: DataFrame | None = None, answers: DataFrame | None = None,
) -> DataFrame:
    """Message texts, recipient and gate outcome per company.

    Verdicts are looked up by mail domain (domain, mx_ok) and by address (email, mailbox_ok); ``answers`` are model
    texts (company_id, raw), used where they pass the checks.
    """
    c = F.col
    mode = O.outreach_mode(c("flutter_jobs"), c("mobile_jobs"), c("jobs_found"), (c("engineering_jobs") > 0) | c("has_engineering_careers_page"), c("has_mobile_app"))
    failing = scored.join(reports["errors"], "company_id", "left").withColumn("errors", F.coalesce("errors", F.array().cast("array<string>")))
    staged = failing.withColumns({"outreach_mode": mode, "has_errors": F.size("errors") > 0, "has_contacts": F.coalesce(c("contact_count") > 0, F.lit(False))})
    best = C.best_contact(reports["contacts"]).withColumn("contact_name", C.normalize_person_name(c("full_name")))
    plain = reports["contact_lists"].filter("kind = 'email'").select("company_id", c("value").alias("email"))
    recipients = O.pick_recipient(staged.select("company_id", "outreach_mode"), reports["contacts"], best, plain)
    summaries = H.hiring_summary(reports["hiring"], reports["jobs"]).select("company_id", "hiring_summary")
    joined = (
        staged.join(summaries, "company_id", "left")
        .join(best.select("company_id", "contact_name"), "company_id", "left")
        .join(recipients, "company_id", "left")
    )
    from leadloom.functions.naming import prefer_name

    named = joined.withColumns(
        {
            "company_name": prefer_name(c("name"), c("profile_name")),
            "site_description": c("profile_description") if "profile_description" in joined.columns else F.lit(None).cast("string"),
            "is_flutter_lead": Q.flutter_evidence(c("technologies"), c("flutter_jobs"), c("mobile_evidence"), c("corpus_text")),
            "has_profile": c("final_url") != "",
            "contact_first_name": text_or_empty(c("contact_name")),
        }
    )
    texts = O.personalize(named).withColumn(
        "product_description", F.coalesce(blank_to_null(c("short_description")), blank_to_null(c("description")), c("company_summary"))
    )
    mails = O.fallback_emails(texts)
    if answers is not None:
        mails = O.check_generated(answers.join(mails.select("company_id", "company_name"), "company_id"), mails)
    known = K.known_companies(mails.select("company_id", "website"), queue, "company_id", settings.skip_known).withColumn("known_company", F.lit(True))
    gate_in = K.known_recipients(mails.join(known, "company_id", "left"), queue).withColumn("has_opportunity", c("outreach_mode") != "none")
    if mail_verdicts is not None:
        domain = F.lower(F.regexp_extract(text_or_empty(c("recipient_email")), "@([^@]*)$", 1))
        gate_in = gate_in.withColumn("domain", domain).join(mail_verdicts.select("domain", "mx_ok"), "domain", "left")
    if mailbox_verdicts is not None:
        checked = mailbox_verdicts.groupBy(F.lower("email").alias("_mail_key")).agg(F.bool_and("mailbox_ok").alias("mailbox_ok"))
        gate_in = join_sparse(gate_in.withColumn("_mail_key", F.lower(F.trim("recipient_email"))), checked, ["_mail_key"]).drop("_mail_key")
    return K.queue_gate(gate_in)


STORE_SCHEMAS = {
    "companies": "company_id string, name string, website string, source string, description string, tags array<string>",
    "contacts": "id string, company_id string, email string, full_name string, role string, linkedin string",
    "founders": "id string, company_id string, email string, full_name string, role string, linkedin string",
    "jobs": "company_id string, job_key string, title string, url string, provider string",
}
PEOPLE_LADDER = (("company_id", "email"), ("company_id", "linkedin"), ("company_id", "full_name"))


def persist(outcomes: DataFrame, reports: Mapping[str, DataFrame], store: Mapping[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """The stored tables after a run, and ``actions`` (table, company_id, action), one row per written row.

    Companies and openings are upserted by key, people by the first rung of a ladder that finds them; tags keep what
    was there. Nothing is written here: the caller saves the tables.
    """
    spark = outcomes.sparkSession
    old = {n: (store or {}).get(n, spark.createDataFrame([], schema)) for n, schema in STORE_SCHEMAS.items()}
    tech = F.transform(F.coalesce("technologies", F.array().cast("array<string>")), lambda t: t)
    before = old["companies"].select("company_id", F.col("tags").alias("_tags"))
    batch = outcomes.join(before, "company_id", "left").select(
        "company_id", "name", "website", "source", "description", D.merge_tags(F.col("_tags"), F.col("industry"), tech).alias("tags")
    )
    companies = D.upsert(old["companies"], batch, ["company_id"], ["website"])
    openings = reports["jobs"].withColumn("job_key", H.job_key(F.col("url"), F.col("title")))
    jobs = D.upsert(old["jobs"], openings.select("company_id", "job_key", "title", "url", "provider", "percent", "pos"), ["company_id", "job_key"], [F.desc("percent"), "pos"])
    after = {"companies": companies.drop("action"), "jobs": jobs.drop("action")}
    actions = companies.select(F.lit("companies").alias("table"), "company_id", "action").unionByName(
        jobs.select(F.lit("jobs").alias("table"), "company_id", "action")
    ).filter("action <> 'kept'")
    people = {
        "contacts": reports["contacts"].withColumn("pos", F.col("first_pos")),
        "founders": reports["founders"],
    }
    for name, rows in people.items():
        named = rows.select("company_id", "email", "full_name", "role", "linkedin", "pos").withColumn(
            "full_name", D.contact_name(F.col("full_name"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("email"))
        )
        resolved = cut_lineage(D.upsert_ladder(old[name], named, PEOPLE_LADDER, "full_name"))
        after[name] = D.apply_ladder(old[name], resolved)
        actions = actions.unionByName(resolved.select(F.lit(name).alias("table"), "company_id", "action"))
    return {**{f"stored_{n}": t for n, t in after.items()}, "actions": actions}


def launch_leads(items: DataFrame, snapshots: DataFrame, as_of: str) -> DataFrame:
    """Launch items as leads; redirects are answered by the snapshots of their launch pages (column redirect)."""
    return normalize_product_launches(items, P.resolve_redirects(P.parse_pages(snapshots)), as_of)


def daily_run(
    parts: Mapping[str, DataFrame], snapshots: DataFrame, queue: DataFrame, settings: RunSettings,
    mail_verdicts: DataFrame | None = None, mailbox_verdicts: DataFrame | None = None, answers: DataFrame | None = None,
    store: Mapping[str, DataFrame] | None = None,
) -> dict[str, DataFrame]:
    """Collect, enrich, score, write texts, gate and persist: every table of one run, nothing is delivered.

    Unusable sites take the short way: scored, warned, not enriched. The statistics count what happened: written
    companies, messages with a body, page errors.
    """
    merged = L.collect_leads(parts, settings.per_source, settings.run_limit, keep_unusable=True)
    keyed = merged.withColumn("company_id", company_key(F.col("identity")))
    leads = cut_lineage(L.enrichment_gate(K.without_known_companies(keyed, queue, "company_id", settings.skip_known)))
    reports = enrich(leads.filter("enrich"), scan_pages(snapshots), settings.most_pages)
    scored = cut_lineage(score(leads.drop("score", "enrich"), reports, settings.as_of))
    outcomes = cut_lineage(outreach(scored, reports, settings, queue, mail_verdicts, mailbox_verdicts, answers))
    stored = persist(outcomes, reports, store)
    written = stored["actions"].filter("table = 'companies'").select("company_id", F.lit(True).alias("persisted"))
    flat = outcomes.join(written, "company_id", "left").select(
        "company_id", "source", F.coalesce("persisted", F.lit(False)).alias("persisted"), "qualified",
        (text_or_empty(F.col("email_body")) != "").alias("emails_generated"), (F.col("outcome") == "queued").alias("queued"),
        (F.size("errors") == 0).alias("success"),
        F.when(F.col("outcome") != "queued", F.col("outcome")).alias("skip_reason"),
    )
    return {
        **reports,
        **stored,
        "leads": leads,
        "scored": scored,
        "outcomes": outcomes,
        "queue_rows": K.append_rows(outcomes.filter(F.col("outcome") == "queued"), settings.sender_name),
        "statistics": R.run_statistics(flat),
        "persist_statistics": R.persist_statistics(stored["actions"]),
    }


def validation_run(seeds: DataFrame, snapshots: DataFrame, as_of: str) -> dict[str, DataFrame]:
    """Check run over seeds: flat rows, summary and report text, no queue. Of seeds with one site the first by ``pos`` counts
    (without one: in the order of the input)."""
    placed = seeds if "pos" in seeds.columns else seeds.withColumn("pos", F.monotonically_increasing_id())
    rows = placed.withColumns({"identity": website_identity(F.col("website")), "source_rank": F.lit(1)})
    unique = L.dedupe_leads(rows)
    leads = cut_lineage(unique.withColumn("company_id", company_key(F.col("identity"))))
    reports = enrich(leads, scan_pages(snapshots))
    scored = score(leads.drop("score"), reports, as_of)
    named = reports["contacts"].join(leads.select("company_id", F.col("identity").alias("domain")), "company_id")
    mails = named.filter(F.col("email").isNotNull()).select("email")
    pattern = E.pattern_report(E.generate_addresses(named.select("company_id", "domain", "full_name"), E.infer_patterns(mails))).select(
        F.col("domain").alias("identity"), F.col("inferred_pattern").alias("email_pattern")
    )
    emails = reports["contact_report"].select("company_id", F.col("email_count").alias("emails_found"))
    full = Q.count_decision_makers(scored, reports["contacts"]).join(emails, "company_id", "left").join(pattern, "identity", "left")
    checks = R.validation_rows(
        full.withColumns(
            {"site_valid": F.col("final_url") != "", "score": F.col("qualification_score"), "emails_found": F.coalesce("emails_found", F.lit(0)),
             "qualified": F.coalesce("qualified", F.lit(False))}
        )
    )
    return {"rows": checks, "summary": R.validation_summary(checks), **reports}
