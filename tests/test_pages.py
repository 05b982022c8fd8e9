"""Page parsing, signals, jobs and people on hand-written pages."""

from pyspark.sql import functions as F

from leadloom.operators import contacts as C
from leadloom.operators import hiring as H
from leadloom.operators import mobile as M
from leadloom.operators import pages as P
from leadloom.operators import profile as B
from leadloom.operators import technology as T

FULL = """<!DOCTYPE html><html lang="en"><head><title> Acme Labs </title>
<meta content="Acme builds tools." name="description"><meta property="og:title" content="Acme OG">
<meta name="twitter:card" content="summary"><link rel="canonical" href="https://acme.example/"><link rel="icon" href="/f.ico"></head>
<body><a href="/contact">Contact</a><a href="/careers">Careers</a><a href="/jobs">Jobs</a><a href="/docs">Docs</a>
<a href="https://linkedin.com/company/acme">in</a><a href="https://x.com/acme">x</a><a href="https://gist.github.com/a">g</a>
<a href="https://apps.apple.com/app/id1">ios</a><a href="https://play.google.com/store/apps/details?id=c">play</a>
<a href="mailto:hello@acme.example?subject=a">mail</a><a href="tel:+1-555-0100">call</a><a href="#x">frag</a><a href="/contact">again</a>
<script>var x = "</p>";</script><p>Reach support@acme.example or +1 555 0199 now<br>ok</body></html>"""


def test_profile(page):
    row = P.page_profiles(page(FULL)).first()
    assert row["title"] == "Acme Labs" and row["description"] == "Acme builds tools." and row["language"] == "en"
    assert row["canonical_url"] == "https://acme.example/" and row["favicon"] == "https://acme.example/f.ico"
    assert row["contact_pages"] == ["https://acme.example/contact"]
    assert row["career_pages"] == ["https://acme.example/careers", "https://acme.example/jobs"]
    assert row["social_links"] == {"linkedin": ["https://linkedin.com/company/acme"], "twitter": ["https://x.com/acme"], "github": ["https://gist.github.com/a"]}
    assert row["emails"] == ["hello@acme.example", "support@acme.example"]
    assert row["phones"] == ["+1 555 0199", "+1-555-0100"]
    assert row["open_graph"] == {"og:title": "Acme OG"} and row["twitter"] == {"twitter:card": "summary"}
    assert len(row["internal_links"]) == 4 and "Acme Labs Contact Careers" in row["page_text"] and "var x" not in row["page_text"]


def test_broken_markup(page):
    row = page("<div><p>one<p>two</div></section><b>three <a href='/x'>l<").first()
    assert row["page_text"] == "one two three l" or row["page_text"].startswith("one two three")
    assert page(None).first()["page_text"] == ""


def tech(spark, html, headers=None, **kw):
    df = spark.createDataFrame([(1, html, headers or {})], "page_id int, html string, headers map<string,string>")
    return T.detect_technologies(df, headers_col="headers", **kw).first()["technologies"]


def test_technologies(spark):
    html = '<script id="__NEXT_DATA__"></script><div data-reactroot></div><script src="https://cdn.tailwindcss.com"></script><script src="https://js.stripe.com/v3/">'
    found = tech(spark, html, {"Server": "cloudflare", "CF-Ray": "1"})
    names = [t["name"] for t in found]
    assert {"Next.js", "React", "Tailwind", "Stripe", "Cloudflare"} <= set(names)
    assert [t["confidence"] for t in found] == sorted((t["confidence"] for t in found), reverse=True)
    cloud = next(t for t in found if t["name"] == "Cloudflare")
    assert cloud["confidence"] == 95 and "Found header cf-ray: 1" in cloud["evidence"]
    assert tech(spark, "<p>Hello world</p>") == []
    assert [t["name"] for t in tech(spark, html, enabled=["stripe"])] == ["Stripe"]


def mobile(page, html):
    parsed = page(html).withColumn("links", P.page_links(F.col("url")))
    return M.detect_mobile(parsed, "html_text", "links").first()["mobile"]


def test_mobile(page):
    both = mobile(page, '<meta name="apple-itunes-app" content="a"><a href="https://play.google.com/x">P</a><button>Open in App</button>')
    assert both["has_mobile_app"] and both["android"] and both["ios"] and both["percent"] == 95
    assert both["evidence"] == sorted(both["evidence"]) and len(both["evidence"]) >= 3
    none = mobile(page, "<p>Hello world</p>")
    assert (none["has_mobile_app"], none["percent"], none["android"], none["ios"]) == (False, 0, False, False)
    assert mobile(page, '<link rel="alternate" href="x">')["percent"] == 70
    deep = mobile(page, '<a href="myapp://open">o</a>')
    assert deep["percent"] == 65 and "myapp://open" in deep["links"]


def jobs(page, html, url="https://acme.example/careers"):
    return H.dedupe_page_jobs(H.extract_jobs(page(html, url))).collect()


def test_jobs(page):
    rows = jobs(page, '<a href="/jobs/se">Software Engineer — Remote</a><a href="/careers">Careers</a>')
    assert [(r["title"], r["remote"], r["url"]) for r in rows] == [("Software Engineer — Remote", True, "https://acme.example/jobs/se")]
    assert rows[0]["percent"] == 35 + 8 + 10
    twice = '<a href="/jobs/f">Flutter Developer</a><div><a href="/jobs/f">Flutter Developer</a></div>'
    assert len(jobs(page, twice)) == 1
    ld = '<script type="application/ld+json">[{"@type":"JobPosting","title":"iOS Engineer","jobLocation":{"address":{"addressLocality":"Oslo"}},"employmentType":"FULL_TIME"}]</script>'
    row = jobs(page, ld)[0]
    assert (row["title"], row["location"], row["employment_type"], row["url"]) == ("iOS Engineer", "Oslo", "full_time", "https://acme.example/careers")
    assert jobs(page, "<p>We like tea</p>") == []


def test_people(page):
    html = """<section><h2>Meet the team</h2><p>Jane Founder is the Founder of Acme. Reach her at jane@acme.example</p>
    <a href="https://linkedin.com/in/jane-founder">LinkedIn</a></section>"""
    contacts = C.split_contacts(C.merge_contacts(C.contact_candidates(page(html))))
    best = C.best_contact(contacts).first()
    assert (best["full_name"], best["email"], best["role"], best["contact_score"], best["contact_class"]) == (
        "Jane Founder", "jane@acme.example", "Founder", 100, "decision",
    )


def test_company_profile(page):
    html = """<html><head><title>Linear</title></head><body><header><h1>Plan and build</h1> For developers and software teams</header>
    <a href="/go">Start Free</a><p>The issue tracker</p><footer>Founded in 2019. Based in San Francisco, CA</footer></body></html>"""
    row = B.company_profiles(P.page_regions(P.page_profiles(page(html)))).first()
    assert row["company_name"] == "Linear" and row["primary_cta"] == "Start Free"
    assert row["founded_year"] == 2019 and "San Francisco" in row["headquarters"]
    assert row["business_category"] == "Developer Tools" and row["target_audience"] == "Developers"


ODD = ["<html><![foo[bar]]></html>", "<![ <p>x", "<!doctype [", "<p <b>x</p", "&#xFFFFFFFF;", "<a href='x", "<![CDATA[a]]>b", "</", "<?x", "<!-"]


def test_odd_pages_do_not_end_the_job(spark):
    deep = "[" * 100_000 + "]" * 100_000
    nested = "{\"a\":" * 2000 + "1" + "}" * 2000
    pages = [*ODD, *(f'<script type="application/ld+json">{t}</script><p>after</p>' for t in (deep, nested, "{"))]
    df = spark.createDataFrame([(i, "https://a.io/", h) for i, h in enumerate(pages)], "page_id int, url string, html string")
    rows = {r["page_id"]: r for r in P.parse_pages(df).collect()}
    assert len(rows) == len(pages)
    assert rows[len(ODD)]["parse_error"] == "JSON nested too deep" and rows[len(ODD)]["page_text"] == "after"
    assert rows[len(ODD) + 1]["parse_error"] is None or rows[len(ODD) + 1]["parse_error"] == "JSON nested too deep"


def test_json_ld_objects_are_ranges_of_one_text(page):
    ld = '{"@type":["A","B"],"x":[{"@type":"C","n":"é \\" }"},1,null],"@graph":[{"@type":"D"}]}'
    rows = P.json_ld_items(page(f'<script type="application/ld+json">{ld}</script>')).orderBy("item_pos").collect()
    import json

    whole = json.loads(ld)
    assert [json.loads(r["body"]) for r in rows] == [whole, whole["x"][0], whole["@graph"][0]]
    assert [(r["kinds"], r["top"]) for r in rows] == [(["A", "B"], True), (["C"], False), (["D"], True)]


def test_large_pages_take_linear_time_and_size():
    import time

    from leadloom.functions.html import parse_page

    def cost(html):
        start = time.perf_counter()
        row = parse_page(html)
        return time.perf_counter() - start, len(str(row))

    shapes = [
        lambda n: "<div>" + "<a href='/x'>y</a> " * n,
        lambda n: "<div class='hero'>z" * n,
        lambda n: '<script type="application/ld+json">' + '{"@type":"T","b":' * min(n, 800) + "1" + "}" * min(n, 800) + "</script>",
        lambda n: "<p>" * n + "</b>" * n,
        lambda n: '<a "x ' * n,
        lambda n: "<!-- " * n,
        lambda n: '<a b=">" ' * n,
        lambda n: "<!-- " * n + ">" + "<i>x</i>" * n,
    ]
    for shape in shapes:
        cost(shape(500))
        (small, small_size), (large, large_size) = cost(shape(5_000)), cost(shape(50_000))
        assert large < 40 * max(small, 0.02) and large_size < 15 * small_size


def test_long_blocks_are_read_whole(page):
    bio = "Jane Founder is the Founder of Acme. " + "She writes about tools and teams. " * 40
    found = page(f"<div><p>{bio}</p><p>x</p></div>").select(F.transform(P.text_blocks("people"), lambda b: b["text"]).alias("t")).first()["t"]
    assert bio.strip() in found and len(found) == 2


def test_elements_do_not_depend_on_partitioning(spark):
    rows = [(i, f"https://s{i % 3}.io/", FULL.replace("Acme", f"A{i}")) for i in range(12)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string")
    one = sorted(P.page_elements(P.parse_pages(df.coalesce(1))).select("page_id", "pos", "tag", "first_piece", "pieces").collect(), key=str)
    many = sorted(P.page_elements(P.parse_pages(df.repartition(7))).select("page_id", "pos", "tag", "first_piece", "pieces").collect(), key=str)
    assert one == many


def texts(page, html, kind, **kw):
    return page(html).select(F.transform(P.text_blocks(kind, **kw), lambda b: F.struct(b["tag"], b["text"])).alias("t")).first()["t"]


def test_every_stretch_of_text_in_a_block_is_in_a_text_block(page):
    for kind, limit in (("jobs", 280), ("people", 500), ("bios", 600)):
        for size in (limit, limit + 1):
            lead = "Flutter engineer " + "x" * (size - 28)
            html = f"<div>{lead} <span>tail</span><ul><li>inner</li></ul></div>"
            assert len(f"{lead} tail inner") == size
            found = [tuple(t) for t in texts(page, html, kind)]
            whole = ("div", f"{lead} tail inner")
            assert (whole in found) == (size == limit) and ("li", "inner") in found
            assert (("div", f"{lead} tail") in found) == (size > limit)


def test_long_paragraphs_of_a_row_are_job_blocks(page):
    for size in (200, 281, 900):
        text = "We look for a Flutter engineer. " + "x" * (size - 32)
        rows = jobs(page, f"<ul><li><p>{text}</p><footer>Apply to Ada</footer></li></ul>")
        assert any("flutter" in r["matched_keywords"] for r in rows), size
    before, after = "Senior Flutter engineer " + "y" * 280, "React developer, remote"
    found = [t["text"] for t in texts(page, f"<div>{before}<div>inner</div>{after}<a href='/x'>Apply</a></div>", "jobs")]
    assert found == ["inner", before, f"{after} Apply"]
    assert [t["text"] for t in texts(page, "<div>aa<div>b</div></div>", "jobs", card_chars=3)] == ["b", "aa"]


def test_links_read_all_of_their_parent(page):
    html = "<ul><li><a href='/jobs/1'>Backend Engineer</a> <a href='/jobs/1/apply'>Apply</a> Berlin, remote, Flutter</li></ul>"
    row = next(r for r in jobs(page, html) if r["title"] == "Backend Engineer")
    assert row["remote"] is True and row["location"] == "Berlin"
    title = "Flutter Engineer " + "and more " * 20
    rows = jobs(page, f"<p><a href='/jobs/2'>{title}</a></p>")
    assert [r["title"] for r in rows] == [title.strip()]
    parsed = page("<div>" + "<a href='/a'>y</a>" * 2000 + "</div>").first()
    assert len(parsed["link_boxes"]) == 1  # once for all its links


def test_bios_of_any_length(page):
    for size in (600, 601, 2000):
        bio = "Jane Founder builds tools. " + "z" * (size - 33)
        parsed = page(f"<div>{bio}<p>other</p></div>")
        fact = parsed.select(C.founder_page_facts(F.lit("Jane"), F.lit("Jane Founder"), F.col("url")).alias("f")).first()["f"]
        assert fact["bio"] == (f"{bio} other" if size <= 600 else bio)


def test_tokens_of_broken_markup():
    from leadloom.functions.markup import tokens

    assert list(tokens('a < b<p class=x id="y>z" hidden>t &amp; u</p ><!-- c --><br/>')) == [
        ("text", "a < b"), ("start", "p", [("class", "x"), ("id", "y>z"), ("hidden", None)], False), ("text", "t & u"), ("end", "p"), ("start", "br", [], True)]
    assert list(tokens("<script>if (a<b) '</p>'</script>x")) == [("start", "script", [], False), ("raw", "if (a<b) '</p>'"), ("end", "script"), ("text", "x")]
    assert list(tokens("<!-- a <b>c</b>")) == [("broken", "<!-- a <b>"), ("text", "c"), ("end", "b")]
    assert list(tokens("x<a href='y")) == [("text", "x"), ("broken", "<a href='y")]
    assert list(tokens("<a href=x/>y")) == [("start", "a", [("href", "x/")], False), ("text", "y")]
    assert "".join(t[1] for t in tokens("&#" + "9" * 9000 + ";")) == "&#" + "9" * 9000 + ";"


def test_page_elements_in_sql(spark):
    import pytest
    from pyspark.errors import AnalysisException

    pages = [FULL, None, "", *ODD, "<script type='application/ld+json'>" + "[" * 100_000 + "]" * 100_000 + "</script><p>x</p>", "<i>no element</i><script type='application/ld+json'>" + "[" * 100_000 + "</script>"]
    df = spark.createDataFrame([(i, "https://a.io/", h) for i, h in enumerate(pages)], "page_id int, url string, html string")
    df.createOrReplaceTempView("odd_pages")
    P.register_table_functions(spark)
    rows = spark.sql("select p.page_id, e.* from odd_pages p, lateral page_elements(p.html) e").collect()
    parsed = P.parse_pages(df)
    want = parsed.select("page_id", F.explode("elements").alias("e"), "page_pieces", "elements").select("page_id", "e.pos", "e.last", "e.tag", P.element_text(F.col("e")).alias("text"), P.inner_href(F.col("e")).alias("link")).collect()
    key = lambda r: (r["page_id"], r["pos"])
    assert [tuple(r[c] for c in ("page_id", "pos", "last", "tag", "text", "link")) for r in sorted((r for r in rows if r["pos"] is not None), key=key)] == [tuple(r) for r in sorted(want, key=key)]
    errors = {r["page_id"]: r["parse_error"] for r in rows if r["parse_error"]}
    assert errors == {r["page_id"]: r["parse_error"] for r in parsed.where("parse_error is not null").collect()} and len(errors) >= 1
    with pytest.raises(AnalysisException, match="takes one string"):
        spark.sql("select * from page_elements(1)").collect()


def test_site_links_follow_companies_not_pairs(spark):
    """Of a site's links each company meets the few that can rank; the rows are those of all links together."""
    rows = [(i, f"https://s{i % 3}.io/{'en' if i % 2 else 'fr'}/{i // 4}", "x" * (50 if i % 5 else 9)) for i in range(240)] + [(900, None, "x" * 50)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    site = F.regexp_extract("url", "://([^/?#]*)", 1).alias("site")
    companies = pages.select(F.col("page_id").alias("company_id"), F.col("url").alias("base_url"), site, F.array("url", F.lit("https://s1.io/en/7")).alias("links"))
    links = pages.select(site, F.col("page_id").alias("pos"), "url").filter(F.contains("url", F.lit("/en/")))
    for cap in (2, None):
        got = P.candidate_pages(companies, pages, ("/fr/5", "/en/3"), cap, "links", site_links=links).collect()
        usable = {}
        for i, url, html in rows:
            if url and len(html) >= 40:
                usable.setdefault(url, i)
        want = []
        for i, base, _ in rows:
            origin = base and base[: base.index("/", 8)]
            wanted = base and [origin + "/fr/5", origin + "/en/3", base, "https://s1.io/en/7", *(u for _, u, _ in rows if u and u.startswith(origin) and "/en/" in u)]
            found = [u for u in dict.fromkeys(wanted or []) if u != base and u in usable]
            want += [(i, u, rank + 1) for rank, u in enumerate(found[:cap])]
        assert sorted((r["company_id"], r["url"], r["page_rank"]) for r in got) == sorted(want)
    own = companies.withColumn("_own", F.lit(4))
    shared = P._shared_keys(own, links, P.page_index(pages).filter("n_bytes >= 40"), 2, ())
    assert shared.groupBy("company_id").count().agg(F.max("count")).first()[0] <= 2 + 1 + 4
