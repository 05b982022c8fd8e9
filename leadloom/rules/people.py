"""Mailbox, name and role vocabulary. Fixed values."""

# role, score, priority (a lower priority number is preferred)
ROLE_SCORES = (
    ("Founder", 100, 1),
    ("Co-Founder", 98, 2),
    ("CEO", 95, 3),
    ("CTO", 90, 4),
    ("VP Engineering", 85, 5),
    ("Engineering Manager", 80, 6),
    ("Product Manager", 78, 7),
    ("Hiring Manager", 75, 8),
    ("Mobile Lead", 72, 9),
)
MAILBOX_SCORES = {
    "founder": 100, "ceo": 95, "cto": 90, "hiring": 75, "careers": 40, "jobs": 40, "team": 35, "hello": 25,
    "contact": 22, "support": 20, "info": 15, "sales": 18, "marketing": 18, "admin": 12, "hr": 30,
}
NAMED_SCORE = 50
SOCIAL_SCORE = 35
PLAIN_SCORE = 15

FAKE_LABELS = (
    "terms", "privacy", "privacy policy", "terms of service", "terms of use", "support center", "documentation",
    "docs", "pricing", "marketplace", "sign in", "sign up", "log in", "login", "register", "cookie", "cookies",
    "cookie policy", "cookie banner", "blog", "blog authors", "authors", "navigation", "menu", "home", "about us",
    "learn more", "read more", "get started", "subscribe", "newsletter", "follow us", "all rights reserved",
)
SINGLE_REJECTS = (
    "terms", "privacy", "pricing", "docs", "documentation", "marketplace", "blog", "login", "home", "menu",
    "cookies", "cookie", "subscribe", "newsletter", "navigation", "policy", "support", "info", "contact", "hello",
    "sign", "in", "up", "hi", "hey", "there", "team", "beta", "tester", "testers",
)
GREETINGS = ("hi", "hello", "hey", "dear")
NAV_TOKENS = ("privacy", "pricing", "terms", "policy", "cookie", "cookies")
CONNECTIVES = ("for", "and", "the", "of", "to", "a", "an", "with", "from", "into", "our", "your")
NON_PERSON_TOKENS = (
    "custom", "account", "accounts", "wallet", "wallets", "cloud", "connector", "connectors", "for", "and", "the",
    "our", "your", "with", "from", "into", "of", "to", "a", "an", "app", "apps", "platform", "product", "products",
    "service", "services", "solution", "solutions", "feature", "features", "tool", "tools", "api", "sdk",
    "dashboard", "portal", "workspace", "workspaces", "mobile", "web", "native", "desktop", "software", "hardware",
    "free", "pro", "premium", "basic", "advanced", "new", "best", "get", "started", "learn", "more", "read", "try",
    "buy", "now", "sign", "login", "register", "subscribe", "newsletter", "privacy", "policy", "terms", "cookie",
    "cookies", "support", "help", "docs", "documentation", "pricing", "blog", "home", "menu", "navigation",
    "marketplace", "company", "business", "enterprise", "startup", "team", "beta", "tester", "testers", "project",
    "coding", "browser", "arena", "monster", "general", "users", "customer", "customers",
)

REJECTED_MAILBOXES = (
    "example", "test", "value", "noreply", "no-reply", "donotreply", "do-not-reply", "privacy", "unsubscribe",
    "mailer-daemon", "postmaster", "localhost", "null", "undefined", "sample", "dummy", "fake", "governance", "live",
    "legal", "abuse", "newsletter", "mailer", "webmaster", "security", "compliance", "dmarc", "bounce", "noreply-",
)
FAKE_DOMAINS = (
    "example.com", "example.org", "example.net", "test.com", "domain.com", "email.com", "yourdomain.com",
    "company.com", "sentry.io", "localhost", "localdomain", "invalid",
)
FAKE_DOMAIN_LABELS = (
    "example", "test", "localhost", "invalid", "fake", "sample", "dummy", "sentry", "cloudflare",
)
BAD_TLDS = ("we", "pay", "local", "internal", "invalid", "test", "localhost")
IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp", ".ico", ".bmp")

SHARED_MAILBOXES = (
    "support", "hello", "contact", "info", "careers", "jobs", "hr", "sales", "marketing", "team", "admin",
)
SKIP_MAILBOXES = (
    "support", "hello", "contact", "info", "sales", "marketing", "team", "admin", "hi", "hey", "mail", "office",
    "help", "enquiries", "enquiry", "inquiries", "inquiry", "press", "media", "lists", "list", "newsletter",
    "billing", "orders", "order", "noreply", "no-reply", "donotreply", "do-not-reply",
)
HIRING_MAILBOXES = ("jobs", "careers", "hiring", "hr", "talent", "recruiting", "recruitment", "people", "join")
HIGH_VALUE_MAILBOXES = ("founder", "ceo", "cto", "owner", "hiring")
DECISION_MAILBOXES = ("founder", "ceo", "cto", "hiring")
ROLE_MAILBOXES = ("founder", "ceo", "cto", "hiring", "support", "careers", "jobs", "hr", "sales", "marketing")
FREE_MAIL_DOMAINS = (
    "gmail.com", "googlemail.com", "yahoo.com", "yahoo.co.uk", "hotmail.com", "outlook.com", "live.com",
    "icloud.com", "me.com", "aol.com", "protonmail.com", "proton.me", "mail.com", "gmx.com", "yandex.com",
)

SUPPORTED_ROLES = (
    "Co-Founder", "Founder", "CEO", "CTO", "VP Engineering", "Engineering Manager", "Product Manager",
    "Hiring Manager", "Mobile Lead", "Owner", "Director", "Software Engineer", "Developer", "Marketing", "Sales",
    "Support", "Recruiter", "HR",
)
ROLE_ALIASES = {
    "co-founder": "Co-Founder", "cofounder": "Co-Founder", "founder": "Founder", "chief executive officer": "CEO",
    "ceo": "CEO", "chief technology officer": "CTO", "cto": "CTO", "vp engineering": "VP Engineering",
    "vice president of engineering": "VP Engineering", "vice president engineering": "VP Engineering",
    "head of engineering": "VP Engineering", "engineering manager": "Engineering Manager",
    "eng manager": "Engineering Manager", "product manager": "Product Manager", "hiring manager": "Hiring Manager",
    "mobile lead": "Mobile Lead", "head of mobile": "Mobile Lead", "owner": "Owner", "director": "Director",
    "software engineer": "Software Engineer", "developer": "Developer", "marketing": "Marketing", "sales": "Sales",
    "support": "Support", "recruiter": "Recruiter", "hr": "HR", "human resources": "HR",
}
DECISION_ROLES = tuple(role.lower() for role, _, _ in ROLE_SCORES) + ("owner", "director")
FOUNDER_ROLE_WORDS = ("founder", "co-founder", "cofounder", "co founder", "ceo", "owner", "chief executive")

OBFUSCATED_EMAIL = (
    r"(?i)([a-zA-Z0-9._%+\-]+)\s*(?:\[at\]|\(at\)|@| at )\s*([a-zA-Z0-9.\-]+)\s*"
    r"(?:\[dot\]|\(dot\)|\.| dot )\s*([a-zA-Z]{2,})"
)
AT_SIGN = r"(?i)@|\[at\]|\(at\)| at "
PERSON_NAME = r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,2})\b"
PERSON_LINKEDIN = r"(?i)https?://(?:www\.)?linkedin\.com/in/[a-zA-Z0-9\-_%]+/?"
COMPANY_LINKEDIN = r"(?i)https?://(?:www\.)?linkedin\.com/company/[a-zA-Z0-9\-_%]+/?"
TWITTER = r"(?i)https?://(?:www\.)?(?:twitter\.com|x\.com)/[A-Za-z0-9_]+/?"
GITHUB_USER = r"(?i)https?://(?:www\.)?github\.com/([A-Za-z0-9_.\-]+)/?"
GITHUB_PAGES = (
    "topics", "features", "pricing", "marketplace", "login", "join", "settings", "orgs", "organizations", "sponsors",
    "about", "events", "collections", "trending", "pulls", "issues", "notifications", "explore",
)
AVATAR_WORDS = ("avatar", "profile", "headshot", "portrait", "team", "founder", "photo")
PERSONAL_SITE_WORDS = ("personal", "portfolio", "about-me", "me.", "blog.")
SOCIAL_HOST_WORDS = ("linkedin.", "twitter.", "x.com", "github.", "facebook.")
FOUNDER_PLACES = (
    "san francisco", "new york", "london", "berlin", "toronto", "austin", "seattle", "bangalore", "bengaluru",
    "singapore", "amsterdam", "paris", "mumbai", "dublin", "chicago", "boston", "los angeles", "united states",
    "india", "germany", "uk", "usa", "remote",
)
