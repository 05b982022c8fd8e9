"""Address patterns. Name, template, base confidence in percent."""

PATTERNS = (
    ("firstname", "{first}", 55),
    ("lastname", "{last}", 50),
    ("first.last", "{first}.{last}", 70),
    ("first_last", "{first}_{last}", 60),
    ("firstlast", "{first}{last}", 65),
    ("flast", "{f}{last}", 68),
    ("firstl", "{first}{l}", 58),
    ("f.lastname", "{f}.{last}", 72),
    ("initial.lastname", "{f}.{last}", 72),
)
GENERIC = ("support", "hello", "contact", "admin", "info", "jobs", "careers", "team", "sales", "hr", "marketing")
