"""Hosts, domains and page keywords used by the URL and page jobs. Fixed values."""

LAUNCH_HOST = "producthunt.com"
REDIRECT_PREFIX = "/r/"

CDN_HOSTS = ("cloudflare.com",)
CDN_SUFFIXES = (".cloudflare.com", ".cloudflareinsights.com", ".cf-ipfs.com")
CDN_PATH = "/cdn-cgi/"
BLOG_PREFIXES = ("blog.", "blogs.")

BLOCKED_EXTERNAL_HOSTS = (
    "twitter.com", "x.com", "linkedin.com", "facebook.com", "instagram.com", "youtube.com",
    "youtu.be", "github.com", "apps.apple.com", "play.google.com", "lu.ma",
)

INTERMEDIATE_HOSTS = (
    "cloudflare.com", "challenges.cloudflare.com", "cdnjs.cloudflare.com",
    "cloudflareinsights.com", "cf-ipfs.com",
)

BLOCKED_DISCOVERY_HOSTS = (
    "github.com", "githubusercontent.com", "reddit.com", "redd.it", "news.ycombinator.com",
    "producthunt.com", "twitter.com", "x.com", "linkedin.com", "facebook.com", "instagram.com",
    "youtube.com", "youtu.be", "medium.com", "news.google.com", "google.com", "t.co", "bit.ly",
)

INDIAN_SUFFIXES = (".in", ".co.in", ".org.in", ".net.in", ".firm.in", ".gen.in")

INDIA_TERMS = (
    "india", "indian", "bharat", "bangalore", "bengaluru", "mumbai", "delhi", r"new\s*delhi",
    "hyderabad", "chennai", "pune", "kolkata", "gurgaon", "gurugram", "noida", "ahmedabad",
    "jaipur", "kochi", "trivandrum", "thiruvananthapuram", "indore", "chandigarh", "coimbatore",
    "surat", "karnataka", "maharashtra", r"tamil\s*nadu", "telangana", "kerala", "gujarat",
)

SOCIAL_DOMAINS = {
    "linkedin": ("linkedin.com",),
    "twitter": ("twitter.com", "x.com"),
    "github": ("github.com",),
    "facebook": ("facebook.com", "fb.com"),
    "instagram": ("instagram.com",),
    "youtube": ("youtube.com", "youtu.be"),
    "discord": ("discord.com", "discord.gg"),
    "medium": ("medium.com",),
}

SPECIAL_PAGES = {
    "contact_pages": ("contact", "support", "get-in-touch", "reach-us"),
    "about_pages": ("about", "company", "team", "who-we-are"),
    "career_pages": ("career", "careers", "join-us", "work-with-us"),
    "jobs_pages": ("jobs", "job-openings", "openings", "hiring"),
    "pricing_pages": ("pricing", "plans", "plan", "buy"),
    "blog_pages": ("blog", "news", "articles", "posts"),
    "documentation_pages": ("docs", "documentation", "help", "guide", "guides"),
    "api_pages": ("api", "developers", "developer", "reference"),
}

EMAIL_PATTERN = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
PHONE_PATTERN = r"(?:\+?\d{1,3}[\s\-.]?)?(?:\(?\d{2,4}\)?[\s\-.]?)?\d{3,4}[\s\-.]?\d{3,4}"
URL_PATTERN = r"(?i)https?://[^\s<>\"')\]]+"
TAGLINE_SEPARATORS = (": ", " — ", " – ", " - ", " | ")
SHOW_SEPARATORS = (" – ", " — ", " - ", ": ")


CONTACT_PATHS = ("/about", "/team", "/company", "/contact", "/careers", "/jobs", "/join-us")
HIRING_PATHS = ("/careers", "/jobs", "/join-us", "/work-with-us", "/hiring", "/openings", "/team", "/company/careers")
INTEL_PATHS = ("/about", "/about-us", "/company", "/pricing", "/plans", "/features", "/product",
               "/products", "/solutions", "/faq", "/faqs")
HIRING_LINK_TOKENS = ("career", "job", "hiring", "join-us", "work-with-us", "opening", "/team")
INTEL_LINK_TOKENS = ("about", "pricing", "plan", "feature", "product", "solution", "faq", "company")
