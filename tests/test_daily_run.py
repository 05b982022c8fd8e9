"""One daily run over three hand-written sites, end to end."""

from leadloom.plans import daily

HOME = """<html lang="en"><head><title>{name} | SaaS</title><meta name="description" content="{name} is a B2B SaaS for busy clinics and their teams.">
<script src="https://js.stripe.com/v3/"></script></head><body><h1>{name}</h1><a href="/careers">Careers</a><a href="/contact">Contact</a>
<a href="/pricing">Pricing</a><section><p>Jane Stone is the Founder of {name}. Mail jane.stone@{site}</p></section></body></html>"""
CAREERS = '<html><body><h1>Join us</h1><a href="https://boards.greenhouse.io/acme/jobs/1">Senior Flutter Engineer - Remote</a></body></html>'


def test_three_sites(spark):
    pages = [
        (1, "https://acme.io/", HOME.format(name="Acme", site="acme.io")),
        (2, "https://acme.io/careers", CAREERS),
        (3, "https://known.io", HOME.format(name="Known", site="known.io")),
        (4, "https://quiet.io/", "<html><head><title>Quiet</title></head><body><p>Get it on Google Play https://play.google.com/x</p></body></html>"),
    ]
    snapshots = spark.createDataFrame(pages, "page_id long, url string, html string")
    rows = [
        ("Acme", "https://www.acme.io", "rss", 1, 10), ("Acme again", "http://acme.io/", "hn", 1, 0), ("Known", "known.io", "hn", 2, 0),
        ("Quiet", "https://quiet.io", "hn", 3, 0), ("Blog", "https://blog.x.io", "hn", 4, 0),
    ]
    leads = spark.createDataFrame(rows, "name string, website string, source string, pos long, score int").selectExpr(
        "*", "cast(null as string) as description", "cast(array() as array<string>) as tags", "timestamp'2025-07-10 00:00:00' as discovered_at", "map('k', 'v') as extra"
    )
    parts = {s: leads.filter(leads.source == s).drop("source") for s in ("rss", "hn")}
    queue = spark.createDataFrame([("known.io", "SENT", "x@known.io")], "company_id string, status string, recipient_email string")
    verdicts = spark.createDataFrame([("Jane.Stone@acme.io", True)], "email string, mailbox_ok boolean")
    store = {"companies": spark.createDataFrame([("old", "Old", "old.io", "rss", None, ["x"])], daily.STORE_SCHEMAS["companies"])}
    settings = daily.RunSettings(as_of="2025-07-15 00:00:00", sender_name="Mia")
    run = daily.daily_run(parts, snapshots, queue, settings, mailbox_verdicts=verdicts, store=store)

    got = {r["website"]: r for r in run["outcomes"].collect()}
    assert set(got) == {"acme.io", "quiet.io", "https://blog.x.io"}
    blog = got["https://blog.x.io"]  # unusable: scored and warned, not enriched
    assert len(blog["warnings"]) >= 1 and blog["outcome"] == "no_recipient" and blog["lead_score"] is not None
    acme, quiet = got["acme.io"], got["quiet.io"]
    assert acme["name"] == "Acme" and acme["outcome"] == "queued" and acme["recipient_email"] == "jane.stone@acme.io"
    assert acme["outreach_mode"] == "hiring" and acme["lead_score"] == 100 and acme["priority"] == "Critical"
    assert "Stripe" in acme["technologies"] and acme["flutter_jobs"] == 1 and acme["has_remote_engineering"]
    assert quiet["has_mobile_app"] and quiet["outcome"] == "no_opportunity"
    row = run["queue_rows"].first()
    assert row["status"] == "PENDING" and row["body"].startswith("Hi Jane,") and row["body"].endswith("Best regards,\nMia")
    stats = run["statistics"].first()
    assert (stats["processed"], stats["queued"], stats["skipped_no_opportunity"], stats["skipped_no_recipient"], stats["persisted"], stats["failed"]) == (3, 1, 1, 1, 3, 0)
    saved = {r["table"]: r for r in run["persist_statistics"].collect()}
    assert saved["companies"]["created"] == 3 and saved["contacts"]["created"] >= 1 and saved["jobs"]["created"] >= 1
    companies = {r["website"]: r for r in run["stored_companies"].collect()}
    assert set(companies) == {"old.io", *got} and "tech:Stripe" in companies["acme.io"]["tags"]
    corpus = run["intelligence"].filter("corpus like '%senior flutter engineer%'").first()
    assert "greenhouse" in corpus["corpus"] and corpus["confidence"] > 15
    founder = run["founders"].first()
    assert (founder["full_name"], founder["role"]) == ("Jane Stone", "Founder")
