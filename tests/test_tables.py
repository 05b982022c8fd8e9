"""Table jobs: dedupe, merge, gate, upsert, scores."""

import random
import re

import pytest
from pyspark.sql import functions as F

from leadloom.operators import contacts as C
from leadloom.operators import leads as L
from leadloom.operators import patterns as E
from leadloom.operators import queue as K
from leadloom.operators import reports as R
from leadloom.operators import scoring as Q
from leadloom.operators import store as D


def leads(spark):
    rows = [
        ("A", "https://www.acme.com/x", "rss", 1, 1), ("B", "acme.com", "rss", 1, 2), ("C", "https://b.io", "hn", 2, 1),
        ("D", "http://acme.com/", "hn", 2, 2), (" ", "https://c.io", "hn", 2, 3), ("E", "https://blog.x.io", "hn", 2, 4),
    ]
    return spark.createDataFrame(rows, "name string, website string, source string, source_rank int, pos long")


def test_validate_and_dedupe(spark):
    valid = L.validate_leads(leads(spark))
    assert sorted((r["source"], r["website"], r["pos"]) for r in valid.collect()) == [("hn", "acme.com", 2), ("hn", "b.io", 1), ("rss", "acme.com", 1)]
    for parts in (1, 7):
        unique = L.dedupe_leads(leads(spark).repartition(parts))
        assert sorted((r["name"], r["identity"]) for r in unique.filter("name <> ' '").collect()) == [("A", "acme.com"), ("C", "b.io"), ("E", "blog.x.io")]
    counts = L.dedupe_counts(leads(spark)).first()
    assert counts["total"] == counts["unique"] + counts["duplicates_removed"] == 6


def test_unknown_source(spark):
    requested = spark.createDataFrame([("HN ", 1), ("nope", 2)], "name string, pos int")
    known = spark.createDataFrame([("hn",)], "source string")
    with pytest.raises(L.UnknownSourceError):
        L.resolve_sources(requested, known, 3)
    assert L.resolve_sources(requested.limit(1), known, 3).collect()[0]["source"] == "hn"


def test_count_new(spark):
    store = spark.createDataFrame([("b.io",)], "website string")
    batch = spark.createDataFrame([("a.io", "x", 1, 1), ("a.io", "x", 1, 2), ("a.io", "y", 2, 1), ("b.io", "y", 2, 2)], "website string, source string, source_rank int, pos int")
    assert {r["source"]: (r["saved"], r["duplicates"]) for r in L.count_new(batch, store).collect()} == {"x": (1, 1), "y": (0, 2)}
    assert L.new_leads(batch, store).count() == 1


def brute_groups(rows):
    parent = {p: p for p, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    owner = {}
    for pos, keys in rows:
        for key in keys:
            if key in owner:
                a, b = sorted((find(pos), find(owner[key])))
                parent[b] = a
            else:
                owner[key] = pos
    return {p: find(p) for p, _ in rows}


def test_connected_groups_match_brute_force(spark):
    rng = random.Random(7)
    # a long chain, a key shared by a third of the rows, and random keys
    rows = [(i, [f"c{i}", f"c{i + 1}"]) for i in range(25)]
    rows += [(100 + i, ["hot"] if i % 3 == 0 else [f"r{rng.randrange(40)}", f"r{rng.randrange(40)}"]) for i in range(90)]
    pairs = [(1, pos, key) for pos, keys in rows for key in keys]
    df = spark.createDataFrame(pairs, "company_id int, pos long, key string").repartition(5)
    for most in (C.EDGES, 3):  # every company in one task, and in parts with star steps after
        got = {r["pos"]: r["group_pos"] for r in C.connected_groups(df, most).collect()}
        assert got == brute_groups(rows)
    assert C.connected_groups(df.limit(0)).count() == 0


def test_contraction_inside_tasks(monkeypatch):
    import pyarrow as pa

    from leadloom.functions import groups

    rows = [(1, i, f"k{j}") for i in range(30) for j in (i, i + 1)] + [(2, 5, "k1"), (2, 9, "x")]
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.int64(), pa.string()))], names=["company_id", "pos", "key"])
    (out,) = groups.contract_keys(iter([batch]))
    assert {(r["company_id"], r["pos"]): r["root"] for r in out.to_pylist() if r["key"] is None} == {**{(1, i): 0 for i in range(30)}, (2, 5): 5, (2, 9): 9}
    monkeypatch.setattr(groups, "HELD", 10)
    parts = list(groups.contract_keys(batch.slice(i, 4) for i in range(0, batch.num_rows, 4)))
    assert len(parts) > 3 and {r["pos"] for p in parts for r in p.to_pylist() if r["key"] is None} == set(range(30))


def test_merge_keeps_bridged_rows(spark):
    rows = [
        (1, 1, "Ada Stone", "ada@a.io", None, None), (1, 2, "Lee West", None, None, "https://linkedin.com/in/lee"),
        (1, 3, None, "ada@a.io", "cto", "https://linkedin.com/in/lee/"), (1, 4, "Privacy Policy", "x@a.io", None, None),
        (1, 5, "Omar Diaz", None, None, None), (2, 6, None, "info@b.io", "support", None),
    ]
    df = spark.createDataFrame(rows, "company_id int, pos long, full_name string, email string, role string, linkedin string")
    merged = {r["first_pos"]: r for r in C.split_contacts(C.merge_contacts(df)).collect()}
    assert set(merged) == {1, 5, 6}
    first = merged[1]
    assert (first["full_name"], first["role"], first["n_merged"], first["contact_score"]) == ("Ada Stone", "CTO", 3, 95)
    assert merged[6]["contact_class"] == "generic" and merged[1]["contact_class"] == "decision"


@pytest.mark.parametrize(
    ("flags", "score", "status"),
    [
        (dict(recently_launched=True, has_mobile_app=False, is_product_company=True, has_founder_or_contact=True, has_valid_email=True), 100, "HIGH"),
        (dict(has_mobile_app=False, is_product_company=True, has_founder_or_contact=True, has_valid_email=True), 70, "MEDIUM"),
        (dict(has_mobile_app=False, is_product_company=True, has_valid_email=True), 55, "LOW"),
        (dict(has_mobile_app=True, is_agency_or_recruitment=True, is_generic_website=True), 0, "REJECT"),
        (dict(has_mobile_app=None, is_product_company=True, has_valid_email=True, has_founder_or_contact=True), 45, "LOW"),
    ],
)
def test_lead_score(spark, flags, score, status):
    names = ["recently_launched", "has_mobile_app", "is_product_company", "has_founder_or_contact", "has_valid_email", "is_agency_or_recruitment", "is_generic_website"]
    values = tuple(flags.get(n, None if n == "has_mobile_app" else False) for n in names)
    df = spark.createDataFrame([values], ", ".join(f"{n} boolean" for n in names))
    row = Q.lead_score(df).first()
    assert (row["score"], row["status"], row["eligible"]) == (score, status, score >= 60)


def test_qualification(spark):
    df = spark.createDataFrame(
        [("https://acme.com", "https://acme.com", True, "x" * 81, ["React"]), ("https://github.com/u/repo", "", False, "", []), ("", "", False, "", [])],
        "website string, final_url string, has_contact_page boolean, description string, technologies array<string>",
    )
    rows = Q.qualification_score(df, "2025-07-15").collect()
    assert rows[0]["score"] == 10 + 12 + 10 + 10 + 10 + 15 + 12 and rows[0]["qualified"]
    assert rows[1]["score"] == 0 and any("GitHub repository" in w for w in rows[1]["warnings"])
    assert rows[2]["warnings"][0] == "Website is missing"


def test_opportunity_needs_mobile_job_for_critical(spark):
    base = "'https://acme.com' as url, true as is_b2b_saas, true as is_developer_tools, true as has_founder_contact, true as has_founder_email, false as has_mobile_app, true as has_pricing_page, array('React') as technologies, 'raised backed by yc' as corpus"
    row = Q.opportunity_score(spark.sql(f"select {base}, 1 as frontend_jobs, 0 as flutter_jobs, 1 as jobs_found"), "2025-07-15").first()
    assert row["score"] >= 85 and row["priority"] == "High" and row["action"] == "Send founder email"
    assert any("Contact signal cap applied (-2)" == w for w in row["warnings"])
    row = Q.opportunity_score(spark.sql(f"select {base}, 0 as frontend_jobs, 1 as flutter_jobs, 1 as jobs_found"), "2025-07-15").first()
    assert (row["priority"], row["level"], row["action"]) == ("Critical", "Exceptional", "Send immediately")


def test_patterns(spark):
    contacts = spark.createDataFrame([("acme.example", "John Smith", 1), ("acme.example", "Cher", 2)], "domain string, full_name string, pos int")
    mails = spark.createDataFrame([("ada.lovelace@acme.example",), ("Support@acme.example",)], "email string")
    rows = E.generate_addresses(contacts, E.infer_patterns(mails))
    got = {(r["full_name"], r["pattern"]): (r["address"], r["percent"]) for r in rows.collect()}
    assert got[("John Smith", "first.last")] == ("john.smith@acme.example", 90)
    assert got[("John Smith", "f.lastname")] == ("j.smith@acme.example", 82)
    assert ("Cher", "first.last") not in got
    assert E.pattern_report(rows).first()["inferred_pattern"] == "first.last"
    plain = E.generate_addresses(contacts, E.infer_patterns(mails.limit(0)))
    assert {r["percent"] for r in plain.filter("full_name = 'Cher'").collect()} == {40}


@pytest.mark.parametrize("current,target,ok", [
    ("PENDING", "APPROVED", True), ("PENDING", "SKIPPED", True), ("APPROVED", "READY_TO_SEND", True), ("READY_TO_SEND", "SENT", True),
    ("READY_TO_SEND", "FAILED", True), ("PENDING", "SENT", False), ("APPROVED", "SENT", False), ("SENT", "PENDING", False), ("FAILED", "SENT", False), ("PENDING", "READY_TO_SEND", False),
])
def test_transitions(spark, current, target, ok):
    df = spark.createDataFrame([(current, target)], "current string, target string")
    assert K.transition_check(df).first()["allowed"] is ok


def test_gate_within_batch(spark):
    rows = [
        (1, "a@x.io", True, True, None), (2, "A@x.io", True, True, None), (3, "a@x.io", False, True, None), (4, None, True, True, None),
        (5, "b@x.io", True, False, None), (6, "c@x.io", True, True, False), (7, "c@x.test", True, True, False), (8, "d@x.io", False, True, None), (9, "d@x.io", True, True, None),
    ]
    df = spark.createDataFrame(rows, "company_id int, recipient_email string, eligible boolean, has_opportunity boolean, mx_ok boolean")
    got = {r["company_id"]: r["outcome"] for r in K.queue_gate(df.repartition(5)).collect()}
    assert got == {1: "queued", 2: "duplicate_recipient", 3: "duplicate_recipient", 4: "no_recipient", 5: "no_opportunity", 6: "no_mx", 7: "queued", 8: "low_score", 9: "queued"}


def test_upsert_twice_is_once(spark):
    target = spark.createDataFrame([(1, "a", None), (2, "b", 5)], "k int, v string, n int")
    batch = spark.createDataFrame([(2, None, 7), (3, "c", 1), (3, "late", 2)], "k int, v string, n int")
    once = D.upsert(target, batch, ["k"], ["n"])
    assert {(r["k"], r["v"], r["n"], r["action"]) for r in once.collect()} == {(1, "a", None, "kept"), (2, "b", 7, "updated"), (3, "c", 1, "created")}
    twice = D.upsert(once.drop("action"), batch, ["k"], ["n"]).drop("action")
    assert sorted(twice.collect()) == sorted(once.drop("action").collect())


def test_ladder(spark):
    target = spark.createDataFrame([(1, "a@x.io", 7, "Ada"), (2, None, 7, "Bea")], "id long, email string, company_id int, full_name string")
    batch = spark.createDataFrame(
        [(1, "a@x.io", 7, "Ada Stone"), (2, None, 7, "Bea"), (3, "n@x.io", 7, "New"), (4, "n@x.io", 7, "Newer"), (5, None, 7, "")],
        "pos long, email string, company_id int, full_name string",
    )
    rows = D.upsert_ladder(target, batch, [["email"], ["company_id", "full_name"]], "full_name")
    assert {r["pos"]: (r["matched_id"], r["action"]) for r in rows.collect()} == {
        1: (1, "updated"), 2: (2, "updated"), 3: (None, "duplicate"), 4: (None, "created"), 5: (None, "skipped"),
    }
    after = D.apply_ladder(target, rows)
    assert {(r["email"], r["full_name"]) for r in after.collect()} == {("a@x.io", "Ada Stone"), (None, "Bea"), ("n@x.io", "Newer")}


def test_replay_matches_fold(spark):
    rng = random.Random(3)
    targets = ["PENDING", "APPROVED", "READY_TO_SEND", "SENT", "FAILED", "SKIPPED"]
    rows = [(i, rng.randrange(50), rng.choice([1, 1, 2, 3]), rng.choice(targets)) for i in range(400)]
    df = spark.createDataFrame(rows, "event_id long, s int, item_id long, target string").selectExpr("event_id", "timestamp_seconds(s) as ts", "item_id", "target")
    edges = {("PENDING", "APPROVED"), ("PENDING", "SKIPPED"), ("APPROVED", "READY_TO_SEND"), ("READY_TO_SEND", "SENT"), ("READY_TO_SEND", "FAILED")}
    want = {}
    for event, second, item, target in sorted(rows, key=lambda r: (r[1], r[0])):
        status, accepted, rejected = want.get(item, ("PENDING", 0, 0))
        want[item] = (target, accepted + 1, rejected) if (status, target) in edges else (status, accepted, rejected + 1)
    got = {r["item_id"]: (r["status"], r["accepted"], r["rejected"]) for r in K.replay_events(df.repartition(5)).collect()}
    assert got == want


def test_website_conflicts_are_linear(spark):
    df = spark.createDataFrame([(i, "https://www.acme.com") for i in range(200)] + [(500, "b.io")], "company_id int, website string")
    rows = D.website_conflicts(df)
    assert rows.count() == 199 and {r["first_id"] for r in rows.collect()} == {0}


def test_skip_reasons(spark):
    df = spark.createDataFrame([(["Skipped: no mail (MX) records"], False), (["x"], False), ([], False), (["duplicate"], True)], "w array<string>, q boolean")
    assert [r[0] for r in df.select(R.classify_skip(F.col("w"), F.col("q"))).collect()] == ["no_mx", "other_skip", None, None]


def test_paginate_limits(spark):
    with pytest.raises(ValueError):
        D.paginate(spark.range(5), 0, 10)
    with pytest.raises(ValueError):
        D.paginate(spark.range(5), 1, 0)


@pytest.mark.parametrize("way", ["asc", "desc"])
def test_pages_lose_no_tie_and_no_null(spark, tmp_path, way):
    from leadloom.operators import directory as G

    rows = [(i, [None, "a", "b", "b"][i % 4], i % 3) for i in range(97)]
    df = spark.createDataFrame(rows, "id int, k string, n int").repartition(5)
    order = [("k", way), ("n", "desc")]
    whole = [r["id"] for r in df.orderBy(*G.order_columns(order, "id")).collect()]
    pages = G.PageDirectory(spark, str(tmp_path / "p"), order, "id")
    pages.write(df, 6)
    assert [r["id"] for k in range(1, 12) for r in pages.page(k, 10).collect()] == whole and pages.page(12, 10).count() == 0
    seen, last = [], None
    while page := G.page_after(df, order, "id", last, 10).collect():
        seen += [r["id"] for r in page]
        last = (page[-1]["k"], page[-1]["n"], page[-1]["id"])
    assert seen == whole
    plan = pages.page(6, 10)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[range#\d+ (IN \(\d+,\d+\)|= \d+)|PartitionFilters: \[isnotnull\(range#\d+\), \(range#\d+ = \d+\)", plan), plan
    with pytest.raises(ValueError):
        pages.page(0, 10)


def test_search_index_equals_the_scan(spark, tmp_path):
    from leadloom.operators import directory as G
    from leadloom.operators import store as D

    rows = [(i, f"Company {w} {i}", f"https://{w}{i}.io", "hn" if i % 2 else None, i) for i, w in enumerate(["acme", "Beta", "gamma", "delta", "müller", "ab"] * 30)]
    df = spark.createDataFrame(rows, "company_id int, name string, website string, source string, created_at int")
    index = G.SearchIndex(spark, str(tmp_path / "i"), buckets=16)
    index.write(df)
    for term in ("acme", "^https://beta1", "gam+a|DELTA 3", "7$", "", None, "(acme|beta) 1[0-9]", "a.me", "müller 4", "co(mp)any x", "zzz", "x{2,3}", "(?:gamma)?12", "[", "io$"):
        for literal in (False, True):
            if term == "[" and not literal:
                continue
            want = [r["company_id"] for r in D.search_companies(df, term, literal=literal).collect()]
            assert [r["company_id"] for r in index.search(term, literal=literal).collect()] == want, term
    assert G.trigrams_of("7$") is None and G.trigrams_of("ab|cde") is None and G.trigrams_of("abc|cdef") == [{"abc"}, {"cde", "def"}]
    postings = index.candidates([{"acm", "cme"}])
    plan = postings._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[bucket#\d+ IN \(\d+,\d+\)", plan), plan  # two of 16 buckets


def test_rules_by_join(spark):
    from leadloom.operators import keywords as K

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcé ") for _ in range(rng.randint(1, 6)))
    texts = [(i, "".join(word() for _ in range(rng.randint(0, 30)))) for i in range(60)] + [(100, None), (101, "")]
    rules = [(i, f"L{i % 40}", j, word(), 1 + i % 3) for i in range(80) for j in range(3)] + [(99, "empty", 0, "", 9)]
    docs = spark.createDataFrame(texts, "doc_id int, text string")
    table = spark.createDataFrame(rules, "rule_rank int, label string, keyword_rank int, keyword string, weight int")
    got = {r["doc_id"]: (r["label"], r["score"], sorted(r["hits"] or [])) for r in K.classify_by_table(docs, "text", table).collect()}
    for i, text in texts:
        score, first, hits = {}, {}, {}
        for rank, label, _, keyword, weight in rules:
            if keyword and text and keyword in text:
                score[label] = score.get(label, 0) + weight
                first[label] = min(first.get(label, rank), rank)
                hits.setdefault(label, []).append(keyword)
        best = max(score, key=lambda x: (score[x], -first[x]), default=None)
        assert got[i] == (best, score.get(best), sorted(hits.get(best, [])))


def test_a_hundred_thousand_rules_stay_out_of_the_plan(spark):
    from leadloom.operators import keywords as K

    rules = spark.range(100_000).selectExpr("cast(id as int) as rule_rank", "concat('L', id) as label", "0 as keyword_rank", "concat('kw', id, 'x') as keyword", "1 as weight")
    docs = spark.createDataFrame([(1, "see kw77123x here"), (2, "kw5x and kw99999x"), (3, "none")], "doc_id int, text string")
    found = K.classify_by_table(docs, "text", rules)
    assert {r["doc_id"]: r["label"] for r in found.collect()} == {1: "L77123", 2: "L5", 3: None}
    assert len(found._jdf.queryExecution().optimizedPlan().toString()) < 20_000


def test_pieces_are_not_shuffled_to_meet_few_rules(spark):
    """Only pieces as long as the rules' are made, and small rules come to them."""
    from leadloom.operators import keywords as K

    rules = spark.createDataFrame([(0, "a", 0, "kéw", 1), (1, "b", 0, "long word", 1), (2, "c", 0, "😀x1", 1)], "rule_rank int, label string, keyword_rank int, keyword string, weight int")
    docs = spark.createDataFrame([(1, "a kéw\nhere"), (2, "a long word"), (3, "so 😀x1 😀"), (4, "none"), (5, None)], "doc_id int, text string")
    found = K.classify_by_table(docs, "text", rules)
    assert {r["doc_id"]: r["label"] for r in found.collect()} == {1: "a", 2: "b", 3: "c", 4: None, 5: None}
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(anchor" not in text and ".{2}" not in text and ".{3}" in text
    grams = docs.select(K.grams_of(F.col("text")).alias("g")).filter("doc_id = 4").first()["g"]
    assert sorted(grams) == sorted({"n", "o", "e", "no", "on", "ne", "non", "one"})


def test_event_time_replay_orders_over_batches_and_gives_late_rows(spark, tmp_path):
    from datetime import datetime, timedelta

    from leadloom.operators import queue as K
    from leadloom.streaming import jobs as W

    start = datetime(2025, 1, 1)
    rng = random.Random(11)
    names = ["APPROVED", "READY_TO_SEND", "SENT", "FAILED", "PENDING"]
    events = [(n, start + timedelta(seconds=rng.randrange(7200)), 1 if n % 3 == 0 else n % 4, rng.choice(names)) for n in range(120)]
    schema = "event_id long, ts timestamp, item_id long, target string"
    batches = [events[i::4] for i in range(4)]  # out of order within two hours
    batches.append([(-1, start + timedelta(hours=9), -1, None)])  # all above is released
    late = (500, start + timedelta(seconds=30), 1, "APPROVED")
    batches.append([late, (501, start + timedelta(hours=9, minutes=1), 7, "APPROVED")])
    batches.append([(-1, start + timedelta(hours=20), -1, None)])
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    W.use_rocksdb(spark)
    try:
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
            W.run_to_table(W.replay_in_event_time(stream, delay_s=3 * 3600, late_s=86_400, slot_s=300), str(tmp_path / "out"), str(tmp_path / "ckpt"), "update")
    finally:
        spark.conf.set(key, before)
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r["item_id"], r["event_id"], r["ts"], r["target"]) for r in out if r["late"]] == [(1, 500, late[1], "APPROVED")]
    got = {}
    for r in out:
        if not r["late"] and r["accepted"] + r["rejected"] >= sum(got.get(r["item_id"], ("", 0, 0))[1:3]):
            got[r["item_id"]] = (r["status"], r["accepted"], r["rejected"], r["retry_count"])
    twin = K.replay_events(spark.createDataFrame([*events, batches[5][1]], schema)).collect()
    assert got == {r["item_id"]: (r["status"], r["accepted"], r["rejected"], r["retry_count"]) for r in twin}


def test_sketches_of_days_merge_within_their_error(spark, tmp_path):
    from leadloom.operators import reports as R

    rng = random.Random(5)
    rows = [("s", rng.expovariate(1 / 50) if i % 9 else None, "x" if i % 7 == 0 else None, f"2025-01-{1 + i % 20:02d}") for i in range(8000)] + [("t", None, None, "2025-01-03")]
    df = spark.createDataFrame(rows, "stage string, duration_ms double, error string, day string")
    for _ in range(2):  # a repeated run replaces its days
        R.store_timings(R.timing_sketches(df, "day"), str(tmp_path / "s"))
    sketches = spark.read.parquet(str(tmp_path / "s"))
    found = {r["stage"]: r for r in R.merged_percentiles(sketches, shares=(0.5, 0.95, 0.99)).collect()}
    values = sorted(r[1] for r in rows if r[1] is not None)
    s = found["s"]
    assert s["runs"] == 8000 and s["failures"] == sum(r[2] is not None for r in rows)
    assert s["mean_ms"] == pytest.approx(sum(values) / len(values))
    for name, share in (("p50_ms", 0.5), ("p95_ms", 0.95), ("p99_ms", 0.99)):
        assert abs(sum(v <= s[name] for v in values) / len(values) - share) < 0.01
    assert found["t"]["p50_ms"] is None and found["t"]["runs"] == 1
    assert R.merged_percentiles(sketches.limit(0)).count() == 0
