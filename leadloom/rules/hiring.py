"""Job and career-page vocabulary. Fixed values."""

ATS_PROVIDERS = {
    "Greenhouse": ("greenhouse.io", "boards.greenhouse.io", "job-boards.greenhouse.io"),
    "Lever": ("lever.co", "jobs.lever.co"),
    "Ashby": ("ashbyhq.com", "jobs.ashbyhq.com"),
    "Workable": ("workable.com", "apply.workable.com"),
    "Teamtailor": ("teamtailor.com",),
    "BreezyHR": ("breezy.hr", "breezyhr.com"),
    "Recruitee": ("recruitee.com",),
    "SmartRecruiters": ("smartrecruiters.com",),
    "Workday": ("myworkdayjobs.com", "workday.com"),
    "Notion Jobs": ("notion.site", "notion.so"),
}

HIRING_KEYWORDS = (
    "flutter developer", "flutter engineer", "flutter", "react native", "mobile developer", "mobile engineer",
    "android", "ios", "react developer", "frontend engineer", "frontend developer", "front-end engineer",
    "front-end developer", "full stack engineer", "full-stack engineer", "fullstack engineer", "software engineer",
    "software developer", "backend engineer", "back-end engineer",
)
FLUTTER_KEYWORDS = ("flutter", "flutter developer", "flutter engineer")
MOBILE_KEYWORDS = (
    "flutter", "flutter developer", "flutter engineer", "react native", "mobile developer", "mobile engineer",
    "android", "ios",
)
FRONTEND_KEYWORDS = (
    "react developer", "react native", "frontend engineer", "frontend developer", "front-end engineer",
    "front-end developer",
)
ENGINEERING_KEYWORDS = HIRING_KEYWORDS  # every hiring keyword counts as engineering

SENIORITY_KEYWORDS = ("intern", "junior", "mid-level", "mid level", "mid", "senior", "lead", "principal", "staff")
REMOTE_KEYWORDS = ("remote", "work from home", "wfh", "distributed")
OFFICE_KEYWORDS = ("hybrid", "on-site", "onsite", "in-office", "office-based")
EMPLOYMENT_TYPES = {
    "full_time": ("full-time", "full time", "permanent"),
    "part_time": ("part-time", "part time"),
    "contract": ("contract", "contractor", "freelance"),
    "internship": ("internship", "intern"),
}

JOB_LINK_HINTS = (
    "job", "jobs", "career", "careers", "opening", "position", "role", "apply", "greenhouse", "lever", "ashby",
    "workable", "teamtailor", "breezy", "recruitee", "smartrecruiters", "workday",
)
NAV_LABELS = ("careers", "jobs", "join us", "openings", "hiring", "view all jobs")
JOB_ROW_WORDS = ("engineer", "developer", "flutter", "mobile", "frontend", "react")
LOCATIONS = (
    "remote", "hybrid", "on-?site", "san francisco", "new york", "london", "berlin", "toronto", "austin", "seattle",
    "bangalore", "bengaluru", "singapore", "amsterdam", "paris", "mumbai", "dublin", "chicago", "boston",
    "los angeles", "united states", "india", "germany", "uk", "usa",
)
CAREER_PAGE_WORDS = ("career", "job", "hiring", "join")
