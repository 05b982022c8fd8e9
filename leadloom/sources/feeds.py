"""Landed feed payloads to item rows.

A landing folder holds one file per API response, under ``query_rank=…/request_pos=…/label=…``
folders that Spark reads as columns. Every flattening job takes those rows, so payloads built
by another job (or a stream) work the same way. A payload that does not parse gives no items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom import schemas
from leadloom.functions.text import blank_to_null, strip, text_or_empty
from leadloom.operators.ordering import first_per_key
from leadloom.operators.rows import unnest


def read_landing(spark: SparkSession, path: str) -> DataFrame:
    """Columns: payload, query_rank, request_pos, label."""
    raw = spark.read.text(path, wholetext=True).withColumnRenamed("value", "payload")
    for name, default in (("query_rank", F.lit(0)), ("request_pos", F.lit(0)), ("label", F.lit(""))):
        if name not in raw.columns:
            raw = raw.withColumn(name, default)
    return raw


def read_seeds(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Seed companies: a JSON array per file, or one object per line (which Spark splits); anything else is an error."""
    if lines:
        seeds = spark.read.schema(schemas.SEED).option("mode", "FAILFAST").json(path)
    else:
        first = spark.read.text(path, wholetext=True).filter(~F.ltrim(F.col("value")).startswith("["))
        if not first.isEmpty():
            raise ValueError(f"{path}: a seed file must hold a JSON array")
        seeds = spark.read.schema(schemas.SEED).option("multiLine", True).json(path)
    return seeds.withColumn("source", F.coalesce("source", F.lit("sample_data")))


def parse_seeds(raw: DataFrame) -> DataFrame:
    """Seed rows out of payloads that hold the same JSON array."""
    rows = unnest(raw, F.from_json("payload", f"array<struct<{schemas.SEED_FIELDS}>>"), "seed", [])
    return rows.select("seed.*").withColumn("source", F.coalesce("source", F.lit("sample_data")))


def _items(raw: DataFrame, schema: str, array: str) -> DataFrame:
    parsed = raw.withColumn("_doc", F.from_json("payload", schema))
    rows = unnest(parsed, F.expr(array), "item", ["query_rank", "request_pos", "label"], "item_pos")
    return rows.select("query_rank", "request_pos", "label", "item_pos", "item.*")


def _first_by(rows: DataFrame, *keys: Column) -> DataFrame:
    keyed = rows.withColumn("_key", F.coalesce(*[blank_to_null(k) for k in keys])).filter(F.col("_key").isNotNull())
    return first_per_key(keyed, ["_key"], ["query_rank", "request_pos", "item_pos"]).drop("_key")


def flatten_product_launches(raw: DataFrame) -> DataFrame:
    rows = _items(raw, schemas.PRODUCT_FEED, "transform(_doc.data.posts.edges, e -> e.node)")
    topics = F.expr("transform(filter(topics.edges, t -> coalesce(t.node.name, '') <> ''), t -> t.node.name)")
    return rows.filter(text_or_empty(F.col("name")) != "").withColumn(
        "topics", F.coalesce(topics, F.array().cast("array<string>"))
    )


def flatten_stories(raw: DataFrame) -> DataFrame:
    """Hits of the preferred query (rank 0) come first; first hit per object id wins."""
    rows = _items(raw, schemas.STORY_FEED, "_doc.hits")
    return _first_by(rows, F.col("objectID"), F.col("story_id"), F.col("url"))


def flatten_accelerator(raw: DataFrame) -> DataFrame:
    rows = _items(raw, schemas.ACCELERATOR_FEED, "_doc")
    named = rows.filter((text_or_empty(F.col("website")) != "") & (text_or_empty(F.col("name")) != ""))
    return _first_by(named, F.col("id"), F.col("slug"), F.col("website"))


def flatten_repositories(raw: DataFrame) -> DataFrame:
    return _first_by(_items(raw, schemas.REPO_FEED, "_doc.items"), F.col("id"), F.col("full_name"))


def flatten_posts(raw: DataFrame) -> DataFrame:
    """Listing posts take the sub-forum of their request; search posts (rank 0) go in front, last one first."""
    rows = _items(raw, schemas.POST_FEED, "transform(_doc.data.children, c -> c.data)").filter(
        F.coalesce("id", "name", "title", "url", "selftext", "permalink").isNotNull()
    )
    is_search = F.col("query_rank") == 0
    rows = rows.withColumns(
        {
            "item_pos": F.when(is_search, -F.col("item_pos")).otherwise(F.col("item_pos")),
            "subreddit": F.when(is_search, F.col("subreddit")).otherwise(
                F.coalesce(blank_to_null(F.col("subreddit")), F.col("label"))
            ),
        }
    )
    return _first_by(rows, F.col("id"), F.col("name"))


def flatten_feeds(raw: DataFrame) -> DataFrame:
    """RSS items and Atom entries; markup in descriptions becomes blanks."""
    options = {"ignoreNamespace": "true"}
    is_atom = F.coalesce(F.col("payload").rlike(r"(?s)^(\s|<\?.*?\?>|<!--.*?-->)*<([A-Za-z0-9]+:)?feed[\s>]"), F.lit(False))
    parsed = raw.withColumn("_is_atom", is_atom).withColumns(  # each payload is parsed once, as what it is
        {
            "_rss": F.when(~F.col("_is_atom"), F.from_xml("payload", schemas.RSS_FEED, options)),
            "_atom": F.when(F.col("_is_atom"), F.from_xml("payload", schemas.ATOM_FEED, options)),
        }
    )
    rss_items = F.expr(
        """transform(coalesce(_rss.channel.item, _rss.item), x -> named_struct('title', x.title, 'link', x.link,
        'raw_description', x.description, 'published', x.pubDate))"""
    )
    atom_items = F.expr(
        """transform(_atom.entry, x -> named_struct('title', x.title, 'link',
        coalesce(try_element_at(filter(x.link, l -> coalesce(l._href, '') <> '' and coalesce(l._rel, 'alternate') in ('alternate', '')), 1)._href,
                 try_element_at(filter(x.link, l -> coalesce(l._href, '') <> ''), 1)._href, ''),
        'raw_description', coalesce(nullif(x.summary, ''), x.content), 'published', x.updated))"""
    )
    items = F.when(F.col("_is_atom"), atom_items).otherwise(rss_items)
    rows = unnest(parsed, items, "item", ["query_rank", "request_pos", F.col("label").alias("feed_url")], "item_pos")
    body = text_or_empty(F.col("item.raw_description"))
    return rows.select(
        "query_rank",
        "request_pos",
        "item_pos",
        "feed_url",
        strip(text_or_empty(F.col("item.title"))).alias("title"),
        strip(text_or_empty(F.col("item.link"))).alias("link"),
        strip(F.regexp_replace(body, "<[^>]+>", " ")).alias("description"),
        body.alias("raw_description"),
        strip(text_or_empty(F.col("item.published"))).alias("published"),
    )


def read_lookup(df: DataFrame, key: str, value: str) -> DataFrame:
    """Side table of answers (redirect targets, mail verdicts), one row per key."""
    keyed = df.filter(F.col(key).isNotNull())
    return first_per_key(keyed, [key], [F.col(value).asc_nulls_last()]).select(key, value)


def with_lookup(df: DataFrame, lookup: DataFrame, on: str, value: str, default: object | None = None) -> DataFrame:
    """Left join of a one-row-per-key answer table; a missing row means ``default``."""
    joined = df.join(lookup.select(on, value), on, "left")
    return joined if default is None else joined.withColumn(value, F.coalesce(value, F.lit(default)))
