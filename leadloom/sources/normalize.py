"""Feed items to the common lead table (families N and Z1)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.functions.naming import geo_score, show_title
from leadloom.functions.text import blank_to_null, strip, text_or_empty
from leadloom.functions.urls import (
    is_external_company_url,
    is_launch_host,
    is_usable_website,
    pick_company_website,
    strip_tracking,
)
from leadloom.operators.rows import with_checked
from leadloom.schemas import LEAD
from leadloom.sources import feed_source, feeds

cloudpickle.register_pickle_by_value(feed_source)

# Forums whose posts always count as local, and their floor score.
LOCAL_FORUMS = ("indianstartups", "developersindia")
LOCAL_FLOOR = 40


def moment(as_of: Column | str) -> Column:
    """The job's reference time; never the wall clock."""
    return F.lit(as_of).cast("timestamp") if isinstance(as_of, str) else as_of


def iso_timestamp(c: Column) -> Column:
    return F.try_to_timestamp(c)


def epoch_timestamp(c: Column) -> Column:
    seconds = c.try_cast("double")
    return F.when(seconds > 0, F.timestamp_seconds(seconds))


def feed_timestamp(c: Column) -> Column:
    """RFC 822 date (named zone or offset), else ISO."""
    bare = F.regexp_replace(c, r"^\s*[A-Za-z]{3,9},\s*", "")
    # a format that fails costs an exception: an offset in digits is no zone name, and without blanks none of them fits
    named = F.when(~bare.rlike(r" [+-]\d{4}$"), F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss z")))
    dated = F.coalesce(
        named, F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss"))
    )
    return F.coalesce(F.when(F.contains(bare, F.lit(" ")), dated), iso_timestamp(c))


def _position() -> Column:
    """One order column out of (query, request, item); items may count down from zero."""
    return (
        F.col("query_rank").cast("bigint") * F.lit(10**15)
        + F.col("request_pos").cast("bigint") * F.lit(10**9)
        + F.col("item_pos")
    )


def _lead(
    df: DataFrame,
    source: str,
    name: Column,
    website: Column,
    description: Column,
    tags: Column,
    discovered: Column,
    score: Column,
    as_of: Column | str,
    extra: dict[str, Column],
) -> DataFrame:
    pairs = [x for key, value in extra.items() for x in (F.lit(key), value.cast("string"))]
    return df.select(
        name.alias("name"),
        website.alias("website"),
        blank_to_null(description).alias("description"),
        F.lit(source).alias("source"),
        tags.alias("tags"),
        F.coalesce(discovered, moment(as_of)).alias("discovered_at"),
        score.cast("int").alias("score"),
        _position().alias("pos"),
        F.create_map(*pairs).alias("extra"),
    )


def is_usable(u: Column) -> Column:
    return is_usable_website(u)


def _tags(base: Column, score: Column) -> Column:
    return F.when(score > 0, F.array_append(base, F.lit("india"))).otherwise(base)


def normalize_product_launches(items: DataFrame, resolved: DataFrame, as_of: Column | str) -> DataFrame:
    """Launch items keep only a usable company site, direct or from the redirect answers (redirect, website)."""
    rows = items.withColumn("redirect", strip_tracking(F.col("website"))).filter(strip(F.col("website")) != "")
    # several snapshots of one launch page are one answer, so no launch is multiplied
    answers = resolved.groupBy("redirect").agg(F.min("website").alias("_answer"))
    joined = rows.join(answers, "redirect", "left")
    final = F.when(is_launch_host(F.col("redirect")), F.col("_answer")).otherwise(
        F.coalesce("_answer", "redirect")
    )
    kept = with_checked(joined, "_site", strip(final), lambda u: is_external_company_url(u) & is_usable_website(u))
    return _lead(
        kept,
        "producthunt",
        F.col("name"),
        F.col("_site"),
        F.col("tagline"),
        F.col("topics"),
        iso_timestamp(F.col("createdAt")),
        F.lit(0),
        as_of,
        {"launch_url": F.col("url"), "launch_date": F.col("createdAt"), "slug": F.col("slug"), "launch_id": F.col("id"),
         "website_redirect": F.col("redirect")},
    )


def normalize_stories(items: DataFrame, as_of: Column | str) -> DataFrame:
    title = strip(text_or_empty(F.col("title")))
    sited = items.withColumns(
        {"_site": strip(text_or_empty(F.col("url"))), "_text": text_or_empty(F.col("story_text"))}
    ).filter(is_usable_website(F.col("_site")))
    rows = with_checked(sited, "_title", show_title(title), lambda t: t["name"] != "")
    score = geo_score(
        F.col("_site"), F.lit(""), F.concat_ws(" ", F.col("_title.tagline"), F.col("_title.name"), title, F.col("_text"))
    )
    return _lead(
        rows.withColumn("_score", score),
        "hackernews",
        F.col("_title.name"),
        F.col("_site"),
        F.coalesce("_title.tagline", "_text"),
        _tags(F.array(F.lit("show_hn")), F.col("_score")),
        iso_timestamp(F.col("created_at")),
        F.col("_score"),
        as_of,
        {"story_id": F.col("objectID"), "author": F.col("author"), "points": F.col("points")},
    )


def normalize_accelerator(items: DataFrame, as_of: Column | str) -> DataFrame:
    rows = items.withColumns(
        {
            "_name": strip(text_or_empty(F.col("name"))),
            "_site": strip(text_or_empty(F.col("website"))),
            "_line": F.coalesce(blank_to_null(F.col("one_liner")), F.col("long_description"), F.lit("")),
            "_regions": F.filter(F.coalesce("regions", F.array().cast("array<string>")), lambda r: r != ""),
        }
    ).filter((F.col("_name") != "") & is_usable_website(F.col("_site")))
    where = F.concat_ws(" ", F.col("all_locations"), F.array_join("_regions", " "))
    score = geo_score(F.col("_site"), where, F.concat_ws(" ", "_line", "_name"))
    labels = F.filter(
        F.concat(F.array(F.col("industry")), F.coalesce("tags", F.array().cast("array<string>"))), lambda t: t != ""
    )
    return _lead(
        rows.withColumn("_score", score),
        "ycombinator",
        F.col("_name"),
        F.col("_site"),
        F.col("_line"),
        _tags(F.array_distinct(labels), F.col("_score")),
        epoch_timestamp(F.col("launched_at")),
        F.col("_score"),
        as_of,
        {"company_id": F.col("id"), "batch": F.col("batch"), "all_locations": F.col("all_locations"),
         "regions": F.array_join("_regions", ","), "stage": F.col("stage"), "status": F.col("status")},
    )


def normalize_repositories(items: DataFrame, as_of: Column | str) -> DataFrame:
    about = text_or_empty(F.col("description"))
    named = items.withColumn("_name", strip(text_or_empty(F.col("name")))).filter(F.col("_name") != "")
    rows = with_checked(named, "_site", pick_company_website([F.col("homepage")], about), is_usable)
    score = geo_score(F.col("_site"), F.lit(""), F.concat_ws(" ", about, "_name", "full_name"))
    return _lead(
        rows.withColumn("_score", score),
        "github",
        F.col("_name"),
        F.col("_site"),
        about,
        _tags(F.array(F.lit("github")), F.col("_score")),
        iso_timestamp(F.coalesce(blank_to_null(F.col("pushed_at")), F.col("updated_at"))),
        F.col("_score"),
        as_of,
        {"full_name": F.col("full_name"), "html_url": F.col("html_url"), "stars": F.col("stargazers_count")},
    )


def normalize_posts(items: DataFrame, as_of: Column | str) -> DataFrame:
    body, forum = text_or_empty(F.col("selftext")), text_or_empty(F.col("subreddit"))
    titled = items.withColumn("_title", strip(text_or_empty(F.col("title")))).filter(F.col("_title") != "")
    site = pick_company_website([F.col("url_overridden_by_dest"), F.col("url")], body)
    rows = with_checked(titled, "_site", site, is_usable)
    score = geo_score(F.col("_site"), F.lit(""), F.concat_ws(" ", body, "_title", forum))
    floor = F.when(F.lower(forum).isin(*LOCAL_FORUMS), F.greatest(score, F.lit(LOCAL_FLOOR))).otherwise(score)
    tags = F.filter(F.array(F.lit("reddit"), forum), lambda t: t != "")
    return _lead(
        rows.withColumn("_score", floor),
        "reddit",
        F.col("_title"),
        F.col("_site"),
        body,
        _tags(tags, F.col("_score")),
        epoch_timestamp(F.col("created_utc")),
        F.col("_score"),
        as_of,
        {"post_id": F.col("id"), "permalink": F.concat(F.lit("https://www.reddit.com"), F.nullif("permalink", F.lit(""))),
         "subreddit": F.col("subreddit")},
    )


def normalize_feed_items(items: DataFrame, as_of: Column | str, source: str = "rss") -> DataFrame:
    """RSS and news items; the site is the item link, else the first company link in the text."""
    site = pick_company_website([F.col("link")], F.concat_ws(" ", "raw_description", "description"))
    rows = with_checked(items.filter(F.col("title") != ""), "_site", site, is_usable)
    score = geo_score(F.col("_site"), F.lit(""), F.concat_ws(" ", "description", "title", "feed_url"))
    return _lead(
        rows.withColumn("_score", score),
        source,
        F.col("title"),
        F.col("_site"),
        F.col("description"),
        _tags(F.array(F.lit(source)), F.col("_score")),
        feed_timestamp(F.col("published")),
        F.col("_score"),
        as_of,
        {"feed_url": F.col("feed_url"), "item_link": F.col("link")},
    )


SourceReader = Callable[..., DataFrame]
SOURCES: dict[str, SourceReader] = {}


def register_source(name: str) -> Callable[[SourceReader], SourceReader]:
    """Add a reader under a name; the name order is the default source order."""

    def add(reader: SourceReader) -> SourceReader:
        SOURCES[name.strip().lower()] = reader
        return reader

    return add


def source_leads(spark: SparkSession, name: str, path: str, as_of: Column | str, **options: object) -> DataFrame:
    """Leads of a registered source out of its landing folder."""
    return SOURCES[name.strip().lower()](spark, path, as_of, **options)


PayloadLeads = Callable[..., DataFrame]
PAYLOADS: dict[str, PayloadLeads] = {}


def register_payloads(name: str, flatten: Callable[[DataFrame], DataFrame], normalize: Callable[..., DataFrame]) -> None:
    """A source by what its payloads hold: item rows out of payload rows, leads out of item rows.

    It is then a registered source (``source_leads``) and a source of the data source "feed" (``feed_rows``).
    """

    def leads(raw: DataFrame, as_of: Column | str, **options: object) -> DataFrame:
        return normalize(flatten(raw), as_of=as_of, **options)

    PAYLOADS[name.strip().lower()] = leads

    @register_source(name)
    def read(spark: SparkSession, path: str, as_of: Column | str, **options: object) -> DataFrame:
        return leads(feeds.read_landing(spark, path), as_of, **options)


def payload_leads(name: str, raw: DataFrame, as_of: Column | str, **options: object) -> DataFrame:
    """Leads of payload rows (payload, query_rank, request_pos, label) of a source."""
    return PAYLOADS[name.strip().lower()](raw, as_of, **options)


def feed_rows(spark: SparkSession, name: str, path: str, stream: bool = False, **options: object) -> DataFrame:
    """Payload rows of a registered source through the data source "feed", as a table or as a stream."""
    source = name.strip().lower()
    if source not in PAYLOADS:
        raise ValueError(f"{name} is not registered with register_payloads; known: {', '.join(PAYLOADS)}")
    spark.dataSource.register(feed_source.FeedDataSource)
    reader = (spark.readStream if stream else spark.read).format("feed").option("source", source)
    return reader.options(**{k: str(v) for k, v in options.items()}).load(path)


def _launch_leads(items: DataFrame, as_of: Column | str, resolved: DataFrame | None = None) -> DataFrame:
    answers = resolved if resolved is not None else items.sparkSession.createDataFrame([], "redirect string, website string")
    return normalize_product_launches(items, answers, as_of)


register_payloads("producthunt", feeds.flatten_product_launches, _launch_leads)
register_payloads("hackernews", feeds.flatten_stories, normalize_stories)
register_payloads("ycombinator", feeds.flatten_accelerator, normalize_accelerator)
register_payloads("github", feeds.flatten_repositories, normalize_repositories)
register_payloads("reddit", feeds.flatten_posts, normalize_posts)
register_payloads("rss", feeds.flatten_feeds, lambda items, as_of: normalize_feed_items(items, as_of, "rss"))
register_payloads("googlenews", feeds.flatten_feeds, lambda items, as_of: normalize_feed_items(items, as_of, "googlenews"))


def placeholder_source(spark: SparkSession, path: str, as_of: Column | str) -> DataFrame:
    """A planned source: no leads yet, the common columns."""
    return spark.createDataFrame([], LEAD).drop("source_rank")
