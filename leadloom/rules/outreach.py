"""Message templates, queue states and their texts. Fixed values."""

OPENING = "I came across {company} — {hook}."
SUMMARY_FULL = "{company} appears to be a {category} company focused on {industry}. {description}"
SUMMARY_BASIC = "{company} is a {product_label} company. {description}"
NO_DESCRIPTION = "Their product focus is still being clarified."
MOBILE_NONE = (
    "I couldn't find a mobile app for {company}, so I was curious whether mobile is already on your roadmap or still later."
)
MOBILE_PRESENT = (
    "{company} already appears to offer a mobile presence{stores}, so a complementary Flutter engagement may be less urgent."
)
TECH_PRESENT = "Internal stack signals (do not recite in email): {technologies}."
TECH_MISSING = "No clear technology signals were detected on the website."
QUALIFIED = "Qualification passed with a score of {score}/100{reasons}."
UNQUALIFIED = "Qualification did not pass (score {score}/100){reasons}."
QUALIFICATION_MISSING = "Qualification data was not available for this lead."
VALUE_HIRING = (
    "I'm a Flutter / mobile app developer available for {roles} — full-time, contract, or a scoped project with {company}."
)
VALUE_FREELANCE = (
    "I build Flutter mobile apps for early-stage products like {company} as a freelance / contract partner when teams "
    "want iOS+Android without a full in-house mobile hire."
)
VALUE_FLUTTER = (
    "I build Flutter apps and can help turn the existing product into a mobile experience without {company} needing "
    "another full-time engineer."
)
VALUE_MOBILE = (
    "I help teams ship or unify Flutter mobile apps so product engineering can stay focused on the core product."
)
VALUE_GENERIC = (
    "I help early-stage teams build and ship Flutter mobile apps without adding another full-time engineer — your web "
    "team can stay focused on the product."
)
CTA_HIRING_NAMED = "Would {name} be open to a quick note on how I fit the mobile role at {company}?"
CTA_HIRING = "Open to a short intro about the mobile / Flutter opening at {company}?"
CTA_FREELANCE_NAMED = "Would {name} be open to a 15-min chat about a scoped Flutter build for {company}?"
CTA_FREELANCE = "Worth a quick chat about a Flutter MVP for {company}?"
CTA_NAMED = "Curious if mobile is on the roadmap — open to a short reply either way?"
CTA_FLUTTER = "Worth a quick chat about a Flutter mobile MVP, or is that off the table for now?"
CTA_GENERIC = "Is mobile something you're considering for {company}, or is it later?"

WARN_TECHNOLOGY = "Missing technology signals"
WARN_CONTACTS = "Missing contacts"
WARN_QUALIFICATION = "Missing qualification data"
WARN_MOBILE = "Missing mobile detection data"
WARN_APP = "Mobile app already detected; Flutter pitch may be weaker"
WARN_ERRORS = "Pipeline reported processing errors"
WARN_INVALID = "Website profile marked invalid"

SUBJECTS_WITH_APP = (
    "{company} mobile — next step?", "noticed {company}'s app", "{company} beyond the current app?",
    "flutter angle for {company}?",
)
SUBJECTS_WITH_APP_HOOK = ("{hook} — on more devices?", "saw {company}: {hook}?")
SUBJECTS = (
    "{company} on mobile?", "{company} outside the browser?", "pocket version of {company}?",
    "noticed {company} — mobile yet?", "native app for {company}?", "{company} on iPhone yet?",
)
SUBJECTS_HOOK = ("{hook} — mobile?", "{company}: {hook} on phone?", "saw {hook} — app yet?")
SUBJECT_WORDS = 9
GENERIC_SUBJECTS = (
    "quick thought on", "idea for", "inquiry about", "exploring ", "mobile idea for", "flutter for", "flutter idea for",
)
EXAMPLE_BRANDS = ("univex", "dojo", "pesterly", "zephyrax", "monster battle arena")
REQUIRED_FIELDS = ("subject", "opening", "body", "cta")

GENERIC_NAMES = ("there", "unknown", "team", "friend", "sir", "madam")
SENDER_KEYS = "sender_name|sender|your_name"
FIRST_NAME_KEYS = "first_name|firstname|first"
FULL_NAME_KEYS = "name|recipient_name|contact_name|full_name"
SENDER_PLACEHOLDER = "{{sender_name}}"
CLOSING = "Best regards,"

STATUSES = ("PENDING", "APPROVED", "READY_TO_SEND", "SKIPPED", "SENDING", "SENT", "FAILED", "CANCELLED")
KNOWN_STATUSES = ("PENDING", "APPROVED", "READY_TO_SEND", "SENDING", "SENT")
REVIEW_STATUSES = ("PENDING", "APPROVED", "READY_TO_SEND", "FAILED")
TRANSITIONS = (
    ("PENDING", "APPROVED"), ("PENDING", "SKIPPED"), ("APPROVED", "READY_TO_SEND"), ("READY_TO_SEND", "SENT"),
    ("READY_TO_SEND", "FAILED"),
)
MAX_RETRIES = 3
RESERVED_SUFFIXES = (".example", ".test", ".invalid", ".localhost")

ERROR_IDS = "Missing company/contact association"
ERROR_NO_EMAIL = "Missing recipient email"
ERROR_BAD_EMAIL = "Invalid recipient email"
ERROR_GENERIC = "Recipient is a generic inbox (hello@/info@/support@) — skip to avoid bounces"
ERROR_SUBJECT = "Missing email subject"
ERROR_BODY = "Missing email body"
RECIPIENT_PATTERN = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"

# Skip reasons by warning text, first match wins.
SKIP_TEXTS = (
    ("duplicate", ("duplicate",)),
    ("no_recipient", ("no contact email", "no_recipient")),
    ("no_mx", ("no mail (mx)", "no_mx")),
    ("mailbox_rejected", ("mailbox rejected", "mailbox_rejected")),
    ("low_score", ("below min_lead_score", "below_min_score")),
    ("no_opportunity", ("no opportunity signal", "no_opportunity")),
)
