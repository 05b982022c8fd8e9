"""Scoring tables. Fixed values; every predicate is SQL over the feature columns of the scorer.

A rule is (name, points, predicate, message). The message may use ``{p}`` for the signed points and
``{column}`` for a feature value. A rule with zero points and a message only warns.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ScoreRule:
    name: str
    points: int
    predicate: str
    message: str = ""
    is_warning: bool = False
    blocking: bool = False


@dataclass(frozen=True)
class ScoreConfig:
    rules: tuple[ScoreRule, ...]
    bands: tuple[tuple[int, str], ...] = ()
    lowest_band: str = ""
    minimum: int = 0
    maximum: int = 100
    passing: int = 60
    enabled: frozenset[str] = frozenset()
    capped: tuple[str, ...] = ()
    cap: int | None = None


PLATFORM_HOSTS = (
    "github.com", "github.io", "gitlab.com", "gitlab.io", "vercel.app", "netlify.app", "notion.site",
    "herokuapp.com", "pages.dev", "web.app", "firebaseapp.com", "producthunt.com", "cloudflare.com",
)
GENERIC_SITE_HOSTS = (
    "github.io", "gitlab.io", "vercel.app", "netlify.app", "herokuapp.com", "pages.dev", "web.app",
    "firebaseapp.com", "notion.site", "carrd.co",
)
PORTFOLIO_WORDS = ("portfolio", "personal website", "my work", "selected works")
DEMO_WORDS = ("demo.", "/demo", " demo ", "sandbox", "example app")
PLACEHOLDER_WORDS = (
    "coming soon", "under construction", "lorem ipsum", "placeholder", "launching soon", "site is being built",
)
HIRING_MARKERS = ("hir", "job", "career", "recruit", "opening", "we are looking", "engineer")
FLUTTER_ROLES = ("flutter",)
MOBILE_ROLES = ("mobile", "ios", "android", "react native")
FRONTEND_ROLES = ("frontend", "front-end", "front end", "react", "vue", "angular")
RECENT_DAYS = 30
LONG_DESCRIPTION = 80

QUALIFICATION = ScoreConfig(
    rules=(
        ScoreRule("website_missing", 0, "website = ''", "Website is missing", True),
        ScoreRule("website_exists", 10, "is_usable", "{p} Website exists"),
        ScoreRule("custom_domain", 12, "is_usable and not is_platform", "{p} Custom domain ({host})"),
        ScoreRule("https_enabled", 10, "is_usable and is_https", "{p} HTTPS enabled"),
        ScoreRule("recently_launched", 10, "age_days between 0 and 30", "{p} Recently launched ({age_days} days ago)"),
        ScoreRule("description_long", 10, "length(description) > 80", "{p} Description longer than 80 characters"),
        ScoreRule("contact_page_exists", 10, "has_contact_page", "{p} Contact page exists"),
        ScoreRule("valid_business_email", 15, "has_valid_business_email", "{p} Valid business email discovered"),
        ScoreRule("no_mobile_app", 15, "final_url <> '' and is_usable and not has_mobile_app", "{p} No mobile app detected"),
        ScoreRule("react_or_nextjs", 12, "mentions_react", "{p} React or Next.js detected"),
        ScoreRule("flutter_mentioned", 25, "mentions_flutter", "{p} Flutter mentioned"),
        ScoreRule("careers_page", 20, "has_careers_page", "{p} Careers page detected"),
        ScoreRule("hiring_flutter", 40, "flutter_jobs > 0 or hires_flutter", "{p} Hiring Flutter"),
        ScoreRule("hiring_mobile", 35, "mobile_jobs > 0 or hires_mobile", "{p} Hiring Mobile"),
        ScoreRule("hiring_frontend", 20, "frontend_jobs > 0 or hires_frontend", "{p} Hiring Frontend"),
        ScoreRule("engineering_careers_page", 15, "has_engineering_careers_page or engineering_jobs > 0", "{p} Engineering careers page"),
        ScoreRule("remote_engineering", 10, "has_remote_engineering", "{p} Remote engineering role"),
        ScoreRule("intelligence_b2b_saas", 10, "is_b2b_saas and not is_consumer_only", "{p} B2B SaaS"),
        ScoreRule("intelligence_enterprise_software", 5, "is_enterprise_software", "{p} Enterprise software"),
        ScoreRule("intelligence_clear_icp", 10, "has_clear_icp", "{p} Clear ICP"),
        ScoreRule("intelligence_pricing_page", 5, "has_pricing_page", "{p} Pricing page exists"),
        ScoreRule("intelligence_developer_tools", 10, "is_developer_tools and not is_consumer_only", "{p} Developer tools"),
        ScoreRule("github_repository_website", -40, "is_repository", "{p} GitHub repository used as website", True),
        ScoreRule("github_pages", -30, "host rlike '(^|[.])github[.]io$'", "{p} GitHub Pages", True),
        ScoreRule("gitlab_pages", -30, "host rlike '(^|[.])gitlab[.]io$'", "{p} GitLab Pages", True),
        ScoreRule("portfolio_website", -20, "is_portfolio", "{p} Portfolio website", True),
        ScoreRule("demo_website", -20, "is_demo", "{p} Demo website", True),
        ScoreRule("placeholder_landing", -20, "is_placeholder", "{p} Placeholder landing page", True),
        ScoreRule("only_vercel_app", -20, "host rlike '(^|[.])vercel[.]app$'", "{p} Only vercel.app domain", True),
        ScoreRule("only_netlify_app", -20, "host rlike '(^|[.])netlify[.]app$'", "{p} Only netlify.app domain", True),
        ScoreRule(
            "no_contact_information", -15,
            "not has_any_contact and not has_contact_page and (final_url <> '' or has_careers_page or size(technologies) > 0)",
            "{p} No contact information", True,
        ),
        ScoreRule("mobile_app_exists", -25, "has_mobile_app", "{p} Mobile app already exists", True),
        ScoreRule(
            "producthunt_or_platform_website", -50, "is_launch_host or host rlike '(^|[.])(producthunt|cloudflare)[.]com$'",
            "{p} Product Hunt / platform website", True,
        ),
        ScoreRule("intermediate_or_blog_host", -40, "is_cdn_host or is_blog_host", "{p} Intermediate CDN or blog host", True),
    ),
    bands=((80, "Excellent"), (60, "Good"), (40, "Fair")),
    lowest_band="Poor",
)

SIMPLE_RULES = ScoreConfig(
    rules=(
        ScoreRule("website_exists", 20, "website <> ''", "Website exists"),
        ScoreRule("website_missing", 0, "website = ''", "Website is missing", True, True),
        ScoreRule("company_name_exists", 10, "name <> ''", "Company name exists"),
        ScoreRule("company_name_missing", 0, "name = ''", "Company name is missing", True, True),
        ScoreRule("description_exists", 10, "description <> ''", "Description exists"),
        ScoreRule("description_missing", 0, "description = ''", "Description is missing", True),
        ScoreRule("not_localhost", 0, "not is_localhost", "Website is not localhost"),
        ScoreRule("localhost", 0, "is_localhost", "Website is localhost", True, True),
        ScoreRule("not_github_io", 0, "not endswith(lower(website), 'github.io')", "Website is not github.io"),
        ScoreRule("github_io", 0, "endswith(lower(website), 'github.io')", "Website uses github.io", True, True),
        ScoreRule("not_vercel_app", 0, "not endswith(lower(website), 'vercel.app')", "Website is not vercel.app"),
        ScoreRule("vercel_app", 0, "endswith(lower(website), 'vercel.app')", "Website uses vercel.app", True, True),
        ScoreRule("not_netlify_app", 0, "not endswith(lower(website), 'netlify.app')", "Website is not netlify.app"),
        ScoreRule("netlify_app", 0, "endswith(lower(website), 'netlify.app')", "Website uses netlify.app", True, True),
        ScoreRule("not_notion_site", 0, "not endswith(lower(website), 'notion.site')", "Website is not notion.site"),
        ScoreRule("notion_site", 0, "endswith(lower(website), 'notion.site')", "Website uses notion.site", True, True),
        ScoreRule("description_length", 15, "length(description) > 40", "Description length exceeds 40 characters"),
        ScoreRule("description_short", 0, "length(description) <= 40", "Description is too short for bonus points", True),
        ScoreRule("has_topic", 10, "size(tags) > 0", "Has at least one topic/tag"),
        ScoreRule("no_topic", 0, "size(tags) = 0", "No topics/tags provided", True),
    ),
)

OPPORTUNITY = ScoreConfig(
    rules=(
        ScoreRule("no_mobile_app", 12, "has_mobile_report and not has_mobile_app", "{p} No mobile app"),
        ScoreRule("flutter_hiring", 40, "flutter_jobs > 0", "{p} Flutter hiring"),
        ScoreRule("mobile_hiring", 35, "mobile_jobs > 0", "{p} Mobile hiring"),
        ScoreRule("frontend_hiring", 20, "frontend_jobs > 0", "{p} Frontend hiring"),
        ScoreRule("developer_tools", 12, "is_developer_tools", "{p} Developer tools"),
        ScoreRule("b2b_saas", 12, "is_b2b_saas", "{p} B2B SaaS"),
        ScoreRule("enterprise", 8, "is_enterprise_software", "{p} Enterprise"),
        ScoreRule("pricing_page", 5, "has_pricing_page", "{p} Pricing page"),
        ScoreRule("founder_contact", 12, "has_founder_contact", "{p} Founder contact"),
        ScoreRule("decision_maker_found", 8, "not has_founder_contact and decision_makers_found > 0", "{p} Decision maker found"),
        ScoreRule("founder_email", 15, "has_founder_email", "{p} Founder email"),
        ScoreRule("company_age_young", 8, "age_years between 0 and 5", "{p} Young company ({age_years}y)"),
        ScoreRule("early_startup", 8, "company_stage in ('Idea', 'MVP', 'Early Startup')", "{p} Early startup ({company_stage})"),
        ScoreRule("growth_startup", 8, "company_stage in ('Growth', 'Scale-up')", "{p} Growth startup ({company_stage})"),
        ScoreRule("recently_launched", 8, "age_days between 0 and 30", "{p} Recently launched ({age_days}d)"),
        ScoreRule("product_hunt", 5, "is_product_hunt", "{p} Product Hunt"),
        ScoreRule("yc", 15, "is_yc", "{p} YC"),
        ScoreRule("funding_news", 10, "has_funding_news", "{p} Funding news"),
        ScoreRule("recent_hiring", 12, "jobs_found > 0", "{p} Recent hiring"),
        ScoreRule("technology_fit", 10, "has_web_stack and not has_mobile_app", "{p} Technology fit"),
        ScoreRule("react_website", 8, "has_react and not has_react_native", "{p} React website"),
        ScoreRule("nextjs", 8, "has_next", "{p} Next.js"),
        ScoreRule("pwa", 15, "has_pwa", "{p} PWA"),
        ScoreRule("responsive_only", 8, "has_viewport and not has_mobile_app", "{p} Responsive only"),
        ScoreRule("react_native_detected", 8, "has_react_native or mentions_react_native", "{p} React Native detected"),
        ScoreRule("flutter_already_detected", -35, "has_flutter", "{p} Flutter already detected", True),
        ScoreRule("existing_native_apps", -30, "has_mobile_app and (has_store_links or has_native)", "{p} Existing native apps", True),
        ScoreRule("non_company_website", -50, "url <> '' and not is_usable", "{p} Non-company website", True),
    ),
    capped=("founder_contact", "decision_maker_found", "founder_email"),
    cap=25,
)
YC_WORDS = ("y combinator", "ycombinator", "backed by yc", "yc batch", "yc w", "yc s", " yc ")
LAUNCH_WORDS = ("product hunt", "producthunt", "launched on product hunt")
FUNDING_WORDS = ("raised", "funding", "seed round", "series a", "series b", "series c", "venture", "investors")
OPPORTUNITY_LEVELS = ((85, "critical"), (70, "high"), (50, "medium"), (30, "low"))

LEAD = ScoreConfig(
    rules=(
        ScoreRule("recently_launched", 30, "recently_launched", "Recently launched / startup signal ({p})"),
        ScoreRule("no_mobile_app", 25, "not has_mobile_app", "No mobile app detected ({p})"),
        ScoreRule("mobile_app_exists", -30, "has_mobile_app", "Existing mobile app detected ({p})"),
        ScoreRule("product_company", 20, "is_product_company", "Product/software/startup company ({p})"),
        ScoreRule("founder_or_contact", 15, "has_founder_or_contact", "Founder/contact person discovered ({p})"),
        ScoreRule("valid_email", 10, "has_valid_email", "Valid email discovered ({p})"),
        ScoreRule("agency_or_recruitment", -30, "is_agency_or_recruitment", "Agency/recruitment lead ({p})"),
        ScoreRule("generic_website", -20, "is_generic_website", "Generic/non-business website ({p})"),
        ScoreRule(
            "no_usable_contact", -20, "not has_valid_email and not has_founder_or_contact", "No usable contact ({p})",
        ),
    ),
    bands=((80, "HIGH"), (60, "MEDIUM"), (40, "LOW")),
    lowest_band="REJECT",
)
PRODUCT_WORDS = (
    "saas", "software", "platform", "developer", "devtools", "ai", "product", "startup", "app", "fintech", "edtech", "b2b",
)
PRODUCT_TYPES = ("saas", "platform", "mobile app", "software", "api", "marketplace")
PRODUCT_TEXT_WORDS = ("saas", "software product", "startup", "b2b")
AGENCY_WORDS = (
    "recruitment", "recruiting", "staffing", "headhunt", "talent agency", "recruitment agency", "hiring agency",
    "consulting agency", "marketing agency", "digital agency", "design agency", "creative agency", "outsourcing",
)
