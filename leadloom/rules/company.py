"""Company profile and intelligence vocabulary. Fixed values."""

from leadloom.operators.keywords import rules_of

CATEGORY_RULES = rules_of({
    "Developer Tools": ("developer tools", "devtools", "for developers", "sdk", "ide"),
    "Healthcare": ("healthcare", "healthtech", "medical", "patient", "clinic"),
    "Fintech": ("fintech", "banking", "finance", "lending", "wealth"),
    "EdTech": ("edtech", "education", "learning", "classroom", "course"),
    "HR": ("human resources", "hr software", "recruiting", "payroll", "talent"),
    "Marketing": ("marketing", "campaign", "seo", "growth", "ads"),
    "CRM": ("crm", "customer relationship", "pipeline", "salesforce"),
    "Cybersecurity": ("security", "cyber", "threat", "vulnerability", "identity"),
    "AI": ("artificial intelligence", "machine learning", "llm", "generative ai", " ai "),
    "Analytics": ("analytics", "metrics", "telemetry", "insights", "data platform"),
    "Productivity": ("productivity", "workflow", "collaboration", "task", "notes"),
    "Legal": ("legal", "law", "compliance", "contract", "attorney"),
    "E-commerce": ("ecommerce", "e-commerce", "shopify", "storefront", "retail"),
    "Payments": ("payments", "checkout", "billing", "invoicing", "stripe"),
    "DevOps": ("devops", "ci/cd", "deployment", "kubernetes", "observability"),
    "Infrastructure": ("infrastructure", "cloud", "hosting", "serverless", "cdn"),
    "Open Source": ("open source", "opensource", "oss", "github.com"),
    "Communication": ("messaging", "chat", "communication", "video calls", "meetings"),
})
INDUSTRY_RULES = rules_of({
    "Project Management": ("issue tracking", "project management", "roadmap", "sprints"),
    "Scheduling": ("scheduling", "calendar", "booking", "appointments"),
    "Identity": ("authentication", "identity", "sso", "login"),
    "Databases": ("database", "postgres", "sql", "storage"),
    "Email": ("email api", "transactional email", "newsletter"),
    "Design": ("design", "prototyping", "figma", "ui kit"),
    "Video": ("video", "recording", "streaming"),
    "Commerce": ("payments", "checkout", "subscriptions"),
})
PRODUCT_TYPE_RULES = rules_of({
    "API": ("api", "rest api", "graphql", "sdk"),
    "Marketplace": ("marketplace", "two-sided", "buyers and sellers"),
    "Browser Extension": ("browser extension", "chrome extension", "firefox add"),
    "Desktop App": ("desktop app", "mac app", "windows app", "electron"),
    "Mobile App": ("mobile app", "ios app", "android app", "app store"),
    "Platform": ("platform", "ecosystem", "integrations"),
    "Consulting": ("consulting", "agency services", "professional services"),
    "SaaS": ("saas", "software as a service", "cloud software", "subscription"),
})
AUDIENCE_RULES = rules_of({
    "Developers": ("developers", "engineers", "software teams", "devops"),
    "Designers": ("designers", "design teams", "product designers"),
    "Sales Teams": ("sales teams", "revenue teams", "account executives"),
    "HR Teams": ("hr teams", "people ops", "recruiters"),
    "Students": ("students", "learners", "campus"),
    "Teachers": ("teachers", "educators", "instructors"),
    "Startups": ("startups", "founders", "early-stage"),
    "Enterprises": ("enterprise", "enterprises", "large organizations"),
    "SMBs": ("smb", "small business", "small businesses"),
    "Agencies": ("agencies", "agency", "clients"),
})
PROFILE_PRICING_RULES = rules_of({
    "Freemium": ("freemium", "free plan", "free forever", "start free", "try free"),
    "Free": ("100% free", "completely free", "free and open"),
    "Custom Pricing": ("custom pricing", "contact sales", "talk to sales", "get a quote"),
    "Enterprise": ("enterprise plan", "enterprise pricing", "for enterprise"),
    "Paid": ("pricing", "paid plan", "pro plan", "premium", "$"),
})
PROFILE_RULE_SETS = {
    "business_category": CATEGORY_RULES,
    "industry": INDUSTRY_RULES,
    "product_type": PRODUCT_TYPE_RULES,
    "target_audience": AUDIENCE_RULES,
    "pricing_model": PROFILE_PRICING_RULES,
}

CTA_PATTERN = (
    r"(?i)\b(start\s+free|get\s+started|try\s+(?:for\s+)?free|sign\s+up|book\s+(?:a\s+)?demo|request\s+(?:a\s+)?demo|"
    r"contact\s+sales|start\s+trial|free\s+trial|subscribe|join\s+(?:now|free))\b"
)
YEAR_PATTERN = r"\b((?:19|20)\d{2})\b"
FOUNDED_PATTERN = r"(?i)(?:founded|established|since)\s*(?:in\s*)?((?:19|20)\d{2})"
HEADQUARTERS_PATTERN = r"(?i)(?:headquarters|based\s+in|located\s+in)\s*[:\-]?\s*([A-Za-z][A-Za-z\s,.\-]{2,60})"
ORGANIZATION_KINDS = ("Organization", "Corporation", "LocalBusiness", "SoftwareApplication")

BUSINESS_MODEL_RULES = rules_of({
    "SaaS": ("saas", "software as a service", "cloud software", "subscription software"),
    "Marketplace": ("marketplace", "two-sided", "buyers and sellers", "multi-vendor"),
    "Agency": ("agency", "consulting firm", "client projects", "professional services"),
    "Developer Tool": ("developer tools", "devtools", "for developers", "sdk", "api platform", "cli tool"),
    "Ecommerce": ("ecommerce", "e-commerce", "online store", "shopify", "storefront"),
    "Open Source": ("open source", "opensource", "oss ", "github.com/", "mit license"),
    "AI Platform": ("ai platform", "artificial intelligence", "machine learning", "generative ai", "llm"),
    "Enterprise Software": ("enterprise software", "for enterprise", "enterprise platform", "fortune 500"),
    "Consumer App": ("consumer app", "for consumers", "personal use", "mobile app for everyone"),
    "FinTech": ("fintech", "financial technology", "banking", "payments platform", "lending"),
    "Healthcare": ("healthcare", "healthtech", "medical", "patient care", "clinical"),
    "EdTech": ("edtech", "education technology", "online learning", "classroom", "for students"),
})
TARGET_CUSTOMER_RULES = rules_of({
    "B2B": ("b2b", "business-to-business", "for businesses", "for companies", "business customers"),
    "B2C": ("b2c", "business-to-consumer", "for consumers", "for individuals", "personal"),
    "Enterprise": ("enterprise", "large organizations", "fortune 500", "global companies"),
    "SMB": ("smb", "small business", "small businesses", "mid-market"),
    "Startup": ("startups", "for startups", "founders", "early-stage companies"),
    "Developers": ("developers", "software engineers", "engineering teams", "devops"),
    "Creators": ("creators", "content creators", "influencers", "creators economy"),
    "Students": ("students", "learners", "campus", "universities"),
})
INTEL_PRICING_RULES = rules_of({
    "Freemium": ("freemium", "free plan", "free forever", "start free", "try free"),
    "Free": ("100% free", "completely free", "free and open", "no cost"),
    "Subscription": ("subscription", "monthly plan", "per month", "/mo", "billed annually"),
    "Enterprise": ("enterprise plan", "enterprise pricing", "contact sales", "custom pricing"),
    "Paid": ("paid plan", "pro plan", "premium plan", "pricing starts", "$"),
})
STAGE_RULES = rules_of({
    "Idea": ("coming soon", "join waitlist", "launching soon", "idea stage"),
    "MVP": ("mvp", "beta", "early access", "private beta"),
    "Early Startup": ("seed", "pre-seed", "early-stage", "just launched", "founded in 202"),
    "Growth": ("series a", "series b", "growing team", "scaling fast", "thousands of"),
    "Scale-up": ("series c", "series d", "hypergrowth", "global expansion"),
    "Enterprise": ("public company", "ipo", "fortune 500", "enterprise-grade at scale"),
})
FUNDING_RULES = rules_of({
    "Bootstrapped": ("bootstrapped", "self-funded", "profitable without funding"),
    "Seed": ("seed round", "seed funding", "raised seed"),
    "Series A": ("series a",),
    "Series B": ("series b",),
    "Series C+": ("series c", "series d", "series e"),
    "Acquired": ("acquired by", "acquisition"),
})
INTEL_RULE_SETS = {
    "model": BUSINESS_MODEL_RULES,
    "customer": TARGET_CUSTOMER_RULES,
    "pricing": INTEL_PRICING_RULES,
    "stage": STAGE_RULES,
    "funding": FUNDING_RULES,
}

PAIN_POINTS = (
    (r"(?i)\b(too complex|complicated|overwhelming)\b", "Complexity / hard to use"),
    (r"(?i)\b(manual|spreadsheet|busywork)\b", "Manual workflows"),
    (r"(?i)\b(expensive|costly|overpriced)\b", "High cost of alternatives"),
    (r"(?i)\b(slow|latency|takes forever)\b", "Performance / speed"),
    (r"(?i)\b(fragmented|scattered|silos)\b", "Fragmented tools"),
    (r"(?i)\b(hard to (hire|find|recruit))\b", "Hiring difficulty"),
)
OPPORTUNITIES = (
    (r"(?i)\b(automate|automation)\b", "Automation opportunity"),
    (r"(?i)\b(ai[- ]powered|artificial intelligence)\b", "AI-assisted workflows"),
    (r"(?i)\b(integrations?|connects? with)\b", "Integration ecosystem"),
    (r"(?i)\b(mobile|flutter|react native)\b", "Mobile product opportunity"),
    (r"(?i)\b(self[- ]serve|no[- ]code)\b", "Self-serve / no-code"),
)
FLUTTER_OPPORTUNITY = "Flutter hiring / mobile engineering demand"
HIRING_OPPORTUNITY = "Active engineering hiring"

COMPETITOR_PATTERN = (
    r"(?i)(?:vs\.?|versus|alternative to|compared to|better than|unlike)\s+([A-Za-z][A-Za-z0-9&.\-]*)"
)
COMPETITOR_SKIP = ("the", "a", "an", "our", "their", "other")
KNOWN_COMPETITORS = (
    "Salesforce", "HubSpot", "Slack", "Notion", "Asana", "Jira", "Monday.com", "Shopify", "Stripe", "Twilio", "AWS",
    "Azure", "Google Cloud", "Zapier", "Intercom", "Zendesk", "Figma", "Linear", "Airtable", "Postman", "Insomnia",
)
STOP_WORDS = (
    "the", "and", "for", "with", "your", "our", "you", "this", "that", "from", "are", "has", "have", "will", "can",
    "all", "into", "more", "than", "when", "what", "about", "their", "they", "http", "https", "www", "com",
)
SUBCATEGORIES = (
    ("crm", "CRM"), ("analytics", "Analytics"), ("devops", "DevOps"), ("security", "Security"),
    ("marketing", "Marketing"), ("hr ", "HR"), ("recruit", "Recruiting"), ("project management", "Project Management"),
    ("api", "API Platform"), ("mobile", "Mobile"), ("flutter", "Mobile / Flutter"),
)
TEAM_SIZES = (
    (r"\b(1000\+|thousands of employees|global team)\b", "1000+", 0, 0),
    (r"\b(200[-–]500|hundreds of|large team)\b", "200-500", 0, 0),
    (r"\b(50[-–]200|growing team of)\b", "50-200", 8, 0),
    (r"\b(10[-–]50|small team|lean team)\b", "10-50", 0, 3),
    (r"\b(1[-–]10|solo founder|two founders|tiny team)\b", "1-10", 0, 0),
)
MODEL_INDUSTRIES = {
    "FinTech": "FinTech", "Healthcare": "Healthcare", "EdTech": "EdTech", "Ecommerce": "Ecommerce",
    "Developer Tool": "Developer Tools", "AI Platform": "Artificial Intelligence",
    "Enterprise Software": "Enterprise Software",
}
BUSINESS_CUSTOMERS = ("B2B", "Enterprise", "SMB", "Startup", "Developers")
