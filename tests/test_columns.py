"""Column jobs against value tables."""

import pytest
from pyspark.sql import functions as F

from leadloom.functions import naming, people, urls
from leadloom.functions.text import title_case
from leadloom.operators import outreach, patterns
from leadloom.operators import profile as intel
from leadloom.rules import company


def values(spark, column, inputs):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    return [r[0] for r in rows.repartition(3).select("i", column(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def test_website(spark):
    raw = ["https://abc.com/", "http://abc.com", "  https://www.abc.com/path  ", "ABC.com:8080/x", "user@abc.com/x", "", None, "HTTP://x.com"]
    assert values(spark, urls.normalize_website, raw) == ["abc.com", "abc.com", "abc.com", "abc.com:8080", "user@abc.com", "", "", "http:"]


def test_launch_urls(spark):
    raw = ["https://www.producthunt.com/r/AbC", "https://www.producthunt.com/products/abc", "https://www.acme.com/about"]
    assert values(spark, urls.is_launch_redirect, raw) == [True, False, False]
    assert values(spark, urls.website_identity, raw)[0] == "producthunt.com/r/abc"
    assert values(spark, urls.canonical_website, raw) == ["https://www.producthunt.com/r/AbC", "producthunt.com", "acme.com"]


def test_usable(spark):
    raw = [
        "https://acme.com", "https://www.producthunt.com/r/abc", "https://www.producthunt.com/products/x",
        "https://blog.cloudflare.com/wallets", "https://challenges.cloudflare.com/", "https://blog.acme.com",
        "https://www.blog.acme.com", "acme.com/cdn-cgi/x", "", "https://notproducthunt.com", "   ",
    ]
    assert values(spark, urls.is_usable_website, raw) == [True, False, False, False, False, False, False, False, False, True, False]


def test_tracking(spark):
    raw = ["https://a.io/x?utm_source=1&q=2&ref=z#f", "https://a.io/?ref=1", "https://producthunt.com/r/1?x=2", "https://a.io/p;v=1?b=1"]
    assert values(spark, urls.strip_tracking, raw) == ["https://a.io/x?q=2", "https://a.io/", "https://producthunt.com/r/1", "https://a.io/p?b=1"]


def test_resolve(spark):
    base = F.lit("https://h.io/a/b/c.html?q=1#f")
    raw = ["x", "../x", "./y", "/z", "//cdn.io/k", "?p=2", "https://o.io", "../../../w", "mailto:a@b.c", "#top", ""]
    got = values(spark, lambda c: urls.absolute_url(c, base), raw)
    assert got == [
        "https://h.io/a/b/x", "https://h.io/a/x", "https://h.io/a/b/y", "https://h.io/z", "https://cdn.io/k",
        "https://h.io/a/b/c.html?p=2", "https://o.io", "https://h.io/w", None, None, None,
    ]


def test_urls_in_text(spark):
    assert values(spark, urls.urls_in, ["see (http://a.io/x). and HTTP://A.IO/x, https://b.io;"]) == [["http://a.io/x", "https://b.io"]]
    pick = lambda c: urls.pick_company_website([F.lit("https://github.com/x"), F.lit(" ")], c)
    assert values(spark, pick, ["at https://www.linkedin.com/in/x or https://ok.io.", "none"]) == ["https://ok.io", None]


def test_names(spark):
    raw = ["Pesterly: somebody has to nag. It is not you.", "Zephyrax — Monster Battle Arena", "A - b", None]
    assert values(spark, naming.clean_display_name, raw) == ["Pesterly", "Zephyrax", "A - b", ""]
    pairs = spark.createDataFrame(
        [("Acme", "Acme: the best tool ever made"), ("Acme Widgets International", "Acme"), ("", ""), ("Acme", "ACME"), ("Bee", "Completely Other Name")],
        "s string, p string",
    )
    got = [r[0] for r in pairs.select(naming.prefer_name(F.col("s"), F.col("p"))).collect()]
    assert got == ["Acme", "Acme", "your company", "Acme", "Bee"]


def test_show_title(spark):
    got = values(spark, naming.show_title, ["Show HN: Foo – a bar", "show hn:  Baz: thing - x", "Plain", "Show HN: "])
    assert [(g["name"], g["tagline"]) for g in got] == [("Foo", "a bar"), ("Baz: thing", "x"), ("Plain", None), ("", None)]


def test_email_validity(spark):
    bad = [
        "test@acme.example", "value@acme.example", "noreply@acme.example", "admin@example.com", "user@localhost",
        "governance@runtime.we", "live@research.example.cloudflare.pay", "x@y.png", "a b@c.io", None, "plain", "javascript:a@b.io",
    ]
    good = ["founder@acme.example", " Jane.Doe+x@Sub.Acme.co.uk "]
    assert values(spark, people.is_valid_email, bad + good) == [False] * len(bad) + [True] * len(good)


def test_emails_from_text(spark):
    got = values(spark, people.emails_from_text, ["Contact jane [at] acme [dot] example or Hello@Acme.example, test@acme.example"])
    assert got == [["hello@acme.example", "jane@acme.example"]]


def test_inboxes(spark):
    raw = ["hello@a.io", "jobs+x@a.io", "jane@a.io"]
    assert values(spark, people.inbox_class, raw) == ["generic", "hiring", "person"]
    assert values(spark, lambda c: people.is_outbound_safe(c, True), raw) == [False, True, True]
    assert values(spark, people.is_business_email, ["a@gmail.com", "a@acme.io", "x"]) == [False, True, False]


def test_person_names(spark):
    fake = ["Privacy Policy", "Pricing", "Custom For", "Account Wallets", "Cloud Connector", "Beta Testers", "Hi Priya", "Zephyrax Project Team"]
    real = ["Jane Founder", "", None, "Ada Lovelace"]
    assert values(spark, people.is_fake_name, fake + real) == [True] * 8 + [False] * 4
    assert values(spark, people.normalize_person_name, ["Hi Priya", "Ada Lovelace", "Beta Testers", "jane doe"]) == ["Priya", "Ada", None, "jane doe"]


def test_roles(spark):
    raw = ["chief executive officer", "Senior Software Engineer", "senior-ios lead", None, " co-founder "]
    assert values(spark, people.normalize_role, raw) == ["CEO", "Software Engineer", "Senior-Ios Lead", None, "Co-Founder"]
    assert values(spark, title_case, ["senior-ios"]) == ["Senior-Ios"]


def test_placeholders(spark):
    scrub = lambda name: (lambda c: outreach.scrub_text(c, F.lit(name), F.lit("")))
    text = ["Hi {{first_name}},\n\nNice product. {{ foo }} {{sender_name}}"]
    assert values(spark, scrub("Priya Sharma"), text) == ["Hi Priya,\n\nNice product.  {{sender_name}}"]
    assert values(spark, scrub("there"), text) == ["Nice product.  {{sender_name}}"]
    assert values(spark, outreach.resolve_first_name, ["A very long title here", "Ada Lovelace", "Acme: x"]) == ["", "Ada", ""]
    dollars = lambda c: outreach.scrub_text(c, F.lit("Ann"), F.lit("M$1\\x"))
    assert values(spark, dollars, ["by {{sender}}"]) == ["by M$1\\x"]


def test_mailbox_patterns(spark):
    raw = ["j.doe", "jane.doe", "jane_doe", "jane", "x9", "9"]
    assert values(spark, patterns.mailbox_pattern, raw) == ["f.lastname", "first.last", "first_last", "firstname", None, None]


def test_intelligence_labels(spark):
    from leadloom.operators.keywords import best_label

    label = lambda rules: (lambda c: best_label(c, rules)["label"])
    assert values(spark, label(company.BUSINESS_MODEL_RULES), ["our saas cloud software as a service", "nothing"]) == ["SaaS", None]
    assert values(spark, label(company.TARGET_CUSTOMER_RULES), ["built for businesses and companies b2b"]) == ["B2B"]
    found = values(spark, intel.competitors, ["Unlike Slack and better than Notion, we focus. Alternative to asana."])[0]
    assert found[:3] == ["Slack", "Notion", "Asana"]


@pytest.mark.parametrize(
    ("subject", "company_name", "expected"),
    [("Quick thought on Acme", "Acme", True), ("about Dojo", "Acme", True), ("about Dojo", "The Dojo", False), ("", "A", True), ("noticed it", "A", False)],
)
def test_subject_replacement(spark, subject, company_name, expected):
    row = spark.range(1).select(
        (outreach.is_generic_subject(F.lit(subject)) | outreach.has_wrong_brand(F.lit(subject), F.lit(company_name))).alias("o")
    ).first()
    assert row["o"] is expected
