"""Landed files to leads, in batch and as a stream."""

import json
import re

import pytest
from pyspark.sql import functions as F

from leadloom.operators import leads as L
from leadloom.sources import feeds, normalize
from leadloom.sources.store import BucketedTable, GrowingTable
from leadloom.streaming import jobs as W

AS_OF = "2025-07-15 00:00:00"


def land(folder, rank, request, label, text, name="f.json"):
    target = folder / f"query_rank={rank}" / f"request_pos={request}" / f"label={label}"
    target.mkdir(parents=True, exist_ok=True)
    (target / name).write_text(text)


def test_seeds(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps([{"name": "A", "website": "a.io"}, {"name": "B", "website": "b.io", "source": "x"}]))
    assert sorted((r["name"], r["source"]) for r in feeds.read_seeds(spark, str(tmp_path / "s.json")).collect()) == [("A", "sample_data"), ("B", "x")]
    (tmp_path / "bad.json").write_text('{"name": "A"}')
    with pytest.raises(ValueError):
        feeds.read_seeds(spark, str(tmp_path / "bad.json"))


def story(i, **kw):
    return {"objectID": str(i), "title": f"Show HN: N{i} – tool", "url": f"https://n{i}.com", "created_at": "2025-07-01T00:00:00Z", **kw}


def test_stories_prefer_first_query(spark, tmp_path):
    land(tmp_path, 1, 0, "g", json.dumps({"hits": [story(1, title="Show HN: Other"), story(2)]}))
    land(tmp_path, 0, 0, "i", json.dumps({"hits": [story(1), story(3, url="https://blog.x.io")]}))
    land(tmp_path, 0, 1, "i", "{broken", "g.json")
    items = feeds.flatten_stories(feeds.read_landing(spark, str(tmp_path)))
    rows = normalize.normalize_stories(items, AS_OF).orderBy("pos").collect()
    assert [(r["name"], r["description"]) for r in rows] == [("N1", "tool"), ("N2", "tool")]


def test_posts_order(spark, tmp_path):
    post = lambda i, **kw: {"data": {"id": str(i), "title": f"P{i}", "url": f"https://p{i}.io", **kw}}
    land(tmp_path, 1, 0, "startups", json.dumps({"data": {"children": [post(1), post(2)]}}))
    land(tmp_path, 0, 0, "search", json.dumps({"data": {"children": [post(3), post(4), post(2, subreddit="IndianStartups")]}}))
    rows = normalize.normalize_posts(feeds.flatten_posts(feeds.read_landing(spark, str(tmp_path))), AS_OF).orderBy("pos").collect()
    assert [r["name"] for r in rows] == ["P2", "P4", "P3", "P1"]
    assert rows[0]["score"] == 40 and rows[0]["tags"] == ["reddit", "IndianStartups", "india"] and rows[3]["tags"] == ["reddit", "startups"]


def test_feeds_and_dates(spark, tmp_path):
    rss = """<rss><channel><item><title>T</title><link>https://a.io/x</link><description>&lt;b&gt;Hi&lt;/b&gt;</description><pubDate>Tue, 01 Jul 2025 15:30:00 +0530</pubDate></item>
    <item><title>U</title><link>https://news.google.com/q</link><description>see https://u.io now</description><pubDate>nonsense</pubDate></item></channel></rss>"""
    land(tmp_path, 0, 0, "f", rss, "a.xml")
    rows = normalize.normalize_feed_items(feeds.flatten_feeds(feeds.read_landing(spark, str(tmp_path))), AS_OF).orderBy("pos").collect()
    assert [(r["name"], r["website"], str(r["discovered_at"])) for r in rows] == [("T", "https://a.io/x", "2025-07-01 10:00:00"), ("U", "https://u.io", AS_OF)]
    assert rows[0]["description"] == "Hi"


def test_registry():
    @normalize.register_source(" Extra ")
    def reader(spark, path):
        return None

    assert normalize.SOURCES["extra"] is reader
    names = ["producthunt", "hackernews", "ycombinator", "github", "reddit", "rss", "googlenews"]
    assert [n for n in normalize.SOURCES if n in names] == names


def test_registered_source_reads_its_folder(spark, tmp_path):
    land(tmp_path, 0, 0, "i", json.dumps({"hits": [story(1)]}))
    assert [r["website"] for r in normalize.source_leads(spark, "HackerNews", str(tmp_path), AS_OF).collect()] == ["https://n1.com"]
    assert normalize.placeholder_source(spark, "", AS_OF).count() == 0


def test_stream_keeps_first_identity(spark, tmp_path):
    raw, store, ckpt = tmp_path / "raw", str(tmp_path / "store"), str(tmp_path / "ckpt")

    def to_leads(batch):
        ranked = normalize.normalize_stories(feeds.flatten_stories(batch), AS_OF)
        return L.union_sources({"hackernews": ranked})

    def run():
        W.stream_leads(W.read_landing_stream(spark, str(raw)), store, ckpt, to_leads).awaitTermination()
        return sorted((r["identity"], r["name"]) for r in spark.read.parquet(store).collect())

    land(raw, 0, 0, "i", json.dumps({"hits": [story(1), story(2)]}))
    assert run() == [("n1.com", "N1"), ("n2.com", "N2")]
    land(raw, 0, 1, "i", json.dumps({"hits": [story(9, url="https://www.N1.com/later"), story(3)]}), "b.json")
    assert run() == [("n1.com", "N1"), ("n2.com", "N2"), ("n3.com", "N3")]


def test_upsert_batches_apply_once(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path / "t"), ["k"], buckets=8)
    write = W.upsert_batch_writer(table, ["k"])
    write(spark.createDataFrame([(k, "a") for k in range(40)], "k int, v string"), 0)

    def files():
        return {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}

    before = files()
    write(spark.createDataFrame([(1, "b"), (40, "c")], "k int, v string"), 1)
    write(spark.createDataFrame([(1, "b"), (40, "c")], "k int, v string"), 1)  # a repeated batch
    assert {r["k"]: r["v"] for r in table.read().collect()} == {k: {1: "b", 40: "c"}.get(k, "a") for k in range(41)}
    new = {p.parent.parent.name for p in files() if p not in before}
    assert before.items() <= files().items() and 1 <= len(new) <= 2  # other buckets are not rewritten


def test_feed_data_source(spark, tmp_path):
    land(tmp_path, 1, 0, "g", json.dumps({"hits": [story(1, title="Show HN: Other"), story(2)]}))
    land(tmp_path, 0, 0, "a%20b", json.dumps({"hits": [story(1)]}))
    land(tmp_path, 0, 1, "__HIVE_DEFAULT_PARTITION__", "{broken", "g.json")
    land(tmp_path, 0, 1, "x", "{}", "_SUCCESS")
    rows = normalize.feed_rows(spark, " HackerNews ", str(tmp_path), partitionBytes=1)
    assert rows.rdd.getNumPartitions() == 3  # a partition for each file
    seen = sorted((r["source"], r["query_rank"], r["request_pos"], r["label"]) for r in rows.collect())
    assert sorted(map(str, seen)) == sorted(map(str, [("hackernews", 0, 0, "a b"), ("hackernews", 0, 1, None), ("hackernews", 1, 0, "g")]))
    own = sorted(map(str, feeds.read_landing(spark, str(tmp_path)).select("payload", "query_rank", "request_pos").collect()))
    assert sorted(map(str, rows.select("payload", "query_rank", "request_pos").collect())) == own
    leads = normalize.payload_leads("hackernews", rows, AS_OF).orderBy("pos").collect()
    assert [r["name"] for r in leads] == ["N1", "N2"]
    assert normalize.feed_rows(spark, "rss", f"file://{tmp_path}").count() == 3
    assert normalize.feed_rows(spark, "rss", str(tmp_path / "none")).count() == 0
    with pytest.raises(ValueError, match="not registered"):
        normalize.feed_rows(spark, "nowhere", str(tmp_path))
    for name in normalize.PAYLOADS:
        assert normalize.payload_leads(name, normalize.feed_rows(spark, name, str(tmp_path)), AS_OF).count() >= 0


def test_feed_stream_resumes_from_its_offset(spark, tmp_path):
    raw, store, ckpt = tmp_path / "raw", str(tmp_path / "store"), str(tmp_path / "ckpt")
    read = []

    def to_leads(batch):
        read.append(sorted(r["file"].rsplit("/", 1)[-1] for r in batch.select("file").collect()))
        return L.union_sources({"hackernews": normalize.payload_leads("hackernews", batch, AS_OF)})

    def run():
        W.stream_leads(normalize.feed_rows(spark, "hackernews", str(raw), stream=True), store, ckpt, to_leads).awaitTermination()
        return sorted((r["identity"], r["name"]) for r in spark.read.parquet(store).collect())

    land(raw, 0, 0, "i", json.dumps({"hits": [story(1), story(2)]}), "a.json")
    assert run() == [("n1.com", "N1"), ("n2.com", "N2")]
    land(raw, 0, 1, "i", json.dumps({"hits": [story(1, title="Show HN: Late"), story(3)]}), "b.json")
    assert run() == [("n1.com", "N1"), ("n2.com", "N2"), ("n3.com", "N3")]
    assert run() == [("n1.com", "N1"), ("n2.com", "N2"), ("n3.com", "N3")]
    assert [f for f in read if f] == [["a.json"], ["b.json"]]


def test_growing_table_splits_its_buckets(spark, tmp_path):
    table = GrowingTable(spark, str(tmp_path / "t"), ["k"], max_rows=40)
    write = W.upsert_batch_writer(table, ["k"])
    want = {k: "a" for k in range(3000)}
    write(spark.createDataFrame(list(want.items()), "k int, v string"), 0)
    layout = table.layout().collect()
    assert sum(r["rows"] for r in layout) == 3000 and len(layout) >= 64 and sum(2.0 ** -r["depth"] for r in layout) == 1
    batch = {k: "b" for k in (5, 1000, 2999, 7001)}
    for _ in range(2):  # a repeated batch
        write(spark.createDataFrame(list(batch.items()), "k int, v string"), 1)
    want |= batch
    assert {r["k"]: r["v"] for r in table.read().collect()} == want
    touched = table.with_bucket(spark.createDataFrame([(k,) for k in batch], "k int"))
    assert table.read(None, touched).count() < len(want) / 10  # of the table, a batch reads its own buckets
    now = {r["bucket"]: r["versions"] for r in table.layout().collect()}
    assert sum(v == [1] for v in now.values()) <= 4 + 4 and sum(v == [0] for v in now.values()) >= 50
    before = {r["k"]: r["v"] for r in table.read(before=1).collect()}
    assert before == {k: "a" for k in range(3000)}
    write(spark.createDataFrame([(k, "c") for k in range(2000, 9000)], "k int, v string"), 2)
    want |= {k: "c" for k in range(2000, 9000)}
    assert {r["k"]: r["v"] for r in table.read().collect()} == want
    assert max(r["rows"] for r in table.layout().collect()) <= 3 * 40
    files = len(list((tmp_path / "t").rglob("*.parquet")))
    table.vacuum(1)
    assert {r["k"]: r["v"] for r in table.read().collect()} == want and len(list((tmp_path / "t").rglob("*.parquet"))) < files


def test_growing_table_merges_the_files_of_added_rows(spark, tmp_path):
    table, seen = GrowingTable(spark, str(tmp_path / "t"), ["k"], max_rows=50, merge_after=3, replace=False), set()
    assert table.read() is None
    for batch in range(6):
        rows = [(batch * 12 + i,) for i in range(12)]
        df = table.with_bucket(spark.createDataFrame(rows, "k int"), batch)
        table.write(df, batch)
        seen |= {k for (k,) in rows}
        assert {r["k"] for r in table.read().collect()} == seen
        assert all(len(r["versions"]) < 3 for r in table.layout().collect())
    table.write(table.with_bucket(spark.createDataFrame([], "k int"), 6), 6)
    assert {r["k"] for r in table.read().collect()} == seen
    assert len(table.layout().collect()) >= 2


def test_layout_is_written_by_several_tasks(spark, tmp_path):
    """One task that drew all buckets through its joins held their sort buffers together."""
    table, key = GrowingTable(spark, str(tmp_path / "t"), ["k"], max_rows=20), "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        table.write(table.with_bucket(spark.range(2000).withColumnRenamed("id", "k")), 0)
    finally:
        spark.conf.unset(key)
    assert len(list((tmp_path / "t" / "layout" / "batch_id=0").glob("*.parquet"))) > 1
    assert sum(r["rows"] for r in table.layout().collect()) == 2000


def test_feed_dates_of_all_forms(spark):
    from leadloom.sources.normalize import feed_timestamp, iso_timestamp

    texts = ["Tue, 01 Jul 2025 10:00:00 GMT", "Tue, 1 Jul 2025 15:30:00 +0530", "01 Jul 2025 15:30:00 -0800", "1 Jul 2025 15:30:00 PST", "1 Jul 2025 15:30:00 +05:30", "1 Jul 2025 15:30:00 Z",
             "1 Jul 2025 15:30:00 GMT+0530", "1 Jul 2025 15:30:00", "2025-07-01T10:00:00Z", "2025-07-01 10:00:00", "2025-07-01", "2025-07-01 10:00:00 +0530", " Wed,  2 Jul 2025 01:02:03 UTC", "1 Jul 2025", "soon", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    bare = F.regexp_replace("t", r"^\s*[A-Za-z]{3,9},\s*", "")
    formats = ("d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss")
    plain = F.coalesce(*[F.try_to_timestamp(bare, F.lit(f)) for f in formats], iso_timestamp(F.col("t")))
    for r in rows.select("t", feed_timestamp(F.col("t")).alias("got"), plain.alias("want")).collect():
        assert r["got"] == r["want"], r
    assert rows.filter(feed_timestamp(F.col("t")).isNotNull()).count() >= 9


def test_feed_payloads_are_dealt_out_and_parsed_once(spark):
    from leadloom.plans import catalog

    text = catalog.QUERIES["n6_normalize_feed_items"](spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(k" in text
    assert len(re.findall(r"CASE WHEN (?:\(?NOT )?_is_atom#\d+\)? THEN from_xml", text)) == 2, text
