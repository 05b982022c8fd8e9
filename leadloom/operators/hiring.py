"""Job openings per page and company (family H). Confidences are whole percents."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions.text import (
    blank_to_null,
    contains_any,
    first_case,
    found,
    let,
    strip,
    text_or_empty,
    title_case,
    words,
)
from leadloom.functions.urls import normalize_job_url, resolve_url
from leadloom.operators.ordering import first_per_key, first_value, top_per_key
from leadloom.operators.pages import attr, element_text, elements, inner_href, object_body, text_around, text_blocks
from leadloom.operators.rows import unnest
from leadloom.rules import hiring as rules


def ats_provider(
    url: Column, html: Column | None = None, providers: Mapping[str, Sequence[str]] = rules.ATS_PROVIDERS
) -> Column:
    """First provider, in table order, whose host occurs in the address or the page."""
    blob = F.lower(F.concat_ws("\n", text_or_empty(url), *([html] if html is not None else [])))

    def pick(text: Column) -> Column:
        return first_case([(contains_any(text, hosts), name) for name, hosts in providers.items()])

    return let(blob, pick)


def match_keywords(text: Column, keywords: Sequence[str] = rules.HIRING_KEYWORDS) -> Column:
    """Keywords in the text, longest first (equal lengths keep table order)."""
    return found(F.lower(text), sorted(keywords, key=len, reverse=True))


def seniority(text: Column, levels: Sequence[str] = rules.SENIORITY_KEYWORDS) -> Column:
    def pick(t: Column) -> Column:
        return first_case(
            [(t.rlike(rf"\b{word}\b"), "Mid" if word == "mid-level" else word.title()) for word in levels]
        )

    return let(F.lower(text), pick)


def work_mode(text: Column, remote: Sequence[str] = rules.REMOTE_KEYWORDS, office: Sequence[str] = rules.OFFICE_KEYWORDS) -> Column:
    """True for remote, false for hybrid or office, null when unstated."""
    return let(
        F.lower(text),
        lambda t: F.when(contains_any(t, remote), True).when(contains_any(t, office), False),
    )


def employment_type(text: Column, types: Mapping[str, Sequence[str]] = rules.EMPLOYMENT_TYPES) -> Column:
    return let(F.lower(text), lambda t: first_case([(contains_any(t, w), label) for label, w in types.items()]))


def location(text: Column, places: Sequence[str] = rules.LOCATIONS) -> Column:
    match = F.regexp_extract(text, r"(?i)\b(" + "|".join(places) + r")\b", 0)
    return title_case(blank_to_null(strip(match)))


def has_any(keywords: Column, group: Sequence[str]) -> Column:
    return F.arrays_overlap(keywords, words(group))


def department(
    keywords: Column,
    mobile: Sequence[str] = rules.MOBILE_KEYWORDS,
    frontend: Sequence[str] = rules.FRONTEND_KEYWORDS,
    engineering: Sequence[str] = rules.ENGINEERING_KEYWORDS,
) -> Column:
    return first_case(
        [
            (has_any(keywords, mobile), "Mobile Engineering"),
            (has_any(keywords, frontend), "Frontend Engineering"),
            (has_any(keywords, engineering), "Engineering"),
        ]
    )


def job_confidence(keywords: Column, has_url: Column, provider: Column, flutter: Sequence[str] = rules.FLUTTER_KEYWORDS) -> Column:
    return F.least(
        F.lit(100),
        F.lit(35)
        + F.least(F.lit(40), F.size(keywords) * 8)
        + F.when(has_url, 10).otherwise(0)
        + F.when(provider.isNotNull(), 15).otherwise(0)
        + F.when(has_any(keywords, flutter), 10).otherwise(0),
    )


def job_attributes(jobs: DataFrame, text: Column, keywords: Column) -> DataFrame:
    return jobs.withColumns(
        {
            "department": department(keywords),
            "location": location(text),
            "remote": work_mode(text),
            "employment_type": employment_type(text),
            "seniority": seniority(text),
        }
    )


def _facts(text: Column) -> Column:
    """What the text around a link says of the opening."""
    return F.struct(
        location(text).alias("location"),
        work_mode(text).alias("remote"),
        employment_type(text).alias("employment_type"),
        seniority(text).alias("seniority"),
        match_keywords(text).alias("keywords"),
    )


_FACTS = "struct<location:string,remote:boolean,employment_type:string,seniority:string,keywords:array<string>>"


def _candidate(kind: int, near: Column | None = None, direct: Column | None = None, **fields: Column) -> Column:
    names = ("pos", "title", "href", "text", "stated_url", "stated_type", "stated_place")
    columns = [F.lit(kind).alias("kind")]
    for name in names:
        value = fields.get(name, F.lit(None).cast("string"))
        columns.append(value.cast("int" if name == "pos" else "string").alias(name))
    columns.append((F.lit(None) if near is None else near).cast(_FACTS).alias("near"))
    columns.append((F.lit(None) if direct is None else direct).cast("array<string>").alias("direct"))
    return F.struct(*columns)


def _json(body: Column, *paths: str) -> Column:
    return F.coalesce(*[blank_to_null(F.get_json_object(body, p)) for p in paths])


def _links(least_title: int, most_title: int | None) -> Column:
    """Anchors that lead to an opening, with what the text around them says.

    That text is the whole text of the anchor's parent; it is read once for each parent, however many anchors share it.
    """
    sizes = (lambda n: n >= least_title) if most_title is None else (lambda n: n.between(least_title, most_title))
    anchors = elements(lambda e: (e["tag"] == "a") & (text_or_empty(attr(e, "href")) != "") & sizes(e["chars"]))
    shaped = F.transform(
        anchors,
        lambda e: let(
            F.struct(strip(element_text(e)).alias("title"), strip(attr(e, "href")).alias("href")),
            lambda x: F.struct(
                e["pos"].alias("pos"), x["title"].alias("title"), x["href"].alias("href"), e["around"].alias("around"),
                match_keywords(F.concat_ws(" ", x["title"], x["href"])).alias("direct"),
            ),
        ),
    )

    def wanted(x: Column) -> Column:
        hinted = contains_any(F.lower(x["href"]), rules.JOB_LINK_HINTS)
        title = F.lower(x["title"])
        return (
            (hinted | contains_any(title, rules.JOB_LINK_HINTS) | (F.size(match_keywords(x["title"])) > 0))
            & ((F.size(x["direct"]) > 0) | hinted)
            & ~title.isin(*rules.NAV_LABELS)
        )

    def with_facts(links: Column) -> Column:
        places = F.array_distinct(F.array_compact(F.transform(links, lambda x: x["around"])))
        facts = F.map_from_entries(F.transform(places, lambda p: F.struct(p, _facts(text_around(p)))))
        return let(
            facts,
            lambda near: F.transform(
                links,
                lambda x: _candidate(
                    0, F.coalesce(F.try_element_at(near, x["around"]), _facts(x["title"])), x["direct"],
                    pos=x["pos"], title=x["title"], href=x["href"], text=x["title"],
                ),
            ),
        )

    return let(F.filter(shaped, wanted), with_facts)


def job_candidates(least_title: int = 4, most_title: int | None = None) -> Column:
    """Anchors, JobPosting objects and job-like text blocks of one parsed page, in reading order.

    One array, so the parsed page is read once for all three kinds.
    """
    linked = _links(least_title, most_title)
    postings = F.filter(
        F.col("json_ld"), lambda o: F.exists(o["kinds"], lambda k: F.lower(k).rlike("jobposting|^job$"))
    )
    bodies = F.transform(postings, lambda o: F.struct(object_body(o).alias("body")))
    structured = F.transform(
        bodies,
        lambda o, i: _candidate(
            1,
            pos=i,
            title=strip(_json(o["body"], "$.title", "$.name")),
            text=F.concat_ws(" ", strip(_json(o["body"], "$.title", "$.name")), _json(o["body"], "$.description")),
            stated_url=_json(o["body"], "$.url[0]", "$.url", "$.sameAs[0]", "$.sameAs"),
            stated_type=F.lower(_json(o["body"], "$.employmentType")),
            stated_place=_json(
                o["body"], "$.jobLocation.address.addressLocality", "$.jobLocation.address.name", "$.jobLocation.name"
            ),
        ),
    )
    job_blocks = F.filter(text_blocks("jobs"), lambda e: F.lower(e["text"]).rlike("|".join(rules.JOB_ROW_WORDS)))
    blocks = F.transform(job_blocks, lambda e: _candidate(2, pos=e["pos"], text=e["text"], href=inner_href(e)))
    return F.concat(linked, structured, blocks)


def extract_jobs(
    parsed: DataFrame, base_col: str = "url", provider_col: str | None = None, keys: Sequence[str] = ("page_id",),
    least_title: int = 4, most_title: int | None = None, most_block_title: int | None = None,
) -> DataFrame:
    """Openings of each page: title, url, provider, percent, keywords and attributes, one row per opening.

    Titles of links shorter than ``least_title`` (or, where asked, longer than ``most_title``) are passed over; a block
    whose first part is shorter (or longer than ``most_block_title``) is named by its first keyword.
    """
    default = F.col(provider_col) if provider_col else F.lit(None).cast("string")
    kept = [*keys, F.col(base_col).alias("source_page"), default.alias("page_provider")]
    candidates = job_candidates(least_title, most_title)
    rows = unnest(parsed, candidates, "c", kept).select(*keys, "source_page", "page_provider", "c.*")
    title, href = text_or_empty(F.col("title")), text_or_empty(F.col("href"))
    is_link, is_posting, is_block = F.col("kind") == 0, F.col("kind") == 1, F.col("kind") == 2
    stage = rows.withColumn("_direct", F.coalesce("direct", match_keywords(F.col("text"))))
    wanted = is_link | F.when(is_posting, title != "").otherwise(F.size("_direct") > 0)
    # The test becomes a generated column, so it is not repeated below the projection.
    kept_rows = unnest(stage, F.filter(F.array(wanted), lambda ok: ok), "_ok").drop("_ok")
    keywords = F.when(is_link & (F.size("_direct") == 0), F.col("near.keywords")).otherwise(F.col("_direct"))
    short = strip(F.regexp_extract(F.col("text"), r"^([^·|\-]*)", 1))
    fits = F.length(short) >= least_title
    if most_block_title is not None:
        fits &= F.length(short) <= most_block_title
    block_title = F.when(fits, short).otherwise(title_case(F.get("_direct", F.lit(0))))
    resolved = normalize_job_url(resolve_url(F.col("href"), F.col("source_page")), F.col("source_page"))
    url = F.when(
        is_posting, normalize_job_url(F.coalesce("stated_url", "source_page"), F.col("source_page"))
    ).otherwise(F.coalesce(resolved, F.col("source_page")))
    shaped = kept_rows.select(
        *keys,
        "kind",
        "pos",
        "source_page",
        "page_provider",
        F.when(is_block, block_title).otherwise(title).alias("title"),
        url.alias("url"),
        (~is_block | (href != "")).alias("has_url"),
        "text",
        "near",
        keywords.alias("matched_keywords"),
        "stated_type",
        "stated_place",
    )
    provided = shaped.withColumn("provider", F.coalesce(ats_provider(F.col("url")), F.col("page_provider")))
    full = job_attributes(provided, F.col("text"), F.col("matched_keywords"))
    near = lambda name: F.when(F.col("near").isNotNull(), F.col(f"near.{name}")).otherwise(F.col(name))
    return full.select(
        *keys,
        "kind",
        "pos",
        "source_page",
        "title",
        "url",
        "provider",
        job_confidence(F.col("matched_keywords"), F.col("has_url"), F.col("provider")).alias("percent"),
        "matched_keywords",
        "department",
        F.coalesce("stated_place", "location", "near.location").alias("location"),
        near("remote").alias("remote"),
        F.coalesce(F.col("stated_type"), near("employment_type")).alias("employment_type"),
        near("seniority").alias("seniority"),
    )


def job_key(url: Column, title: Column) -> Column:
    return F.concat_ws("|", F.rtrim(F.lower(text_or_empty(url)), F.lit("/")), F.lower(strip(title)))


def dedupe_page_jobs(jobs: DataFrame, keys: Sequence[str] = ("page_id",)) -> DataFrame:
    """One row per address and title on a page: a later row wins with more confidence or more keywords.

    The rule depends on reading order, so the few candidates of one opening on one page are folded in order.
    """
    payload = [c for c in jobs.columns if c not in keys]
    row = F.struct(F.col("kind"), F.col("pos"), *[F.col(c).alias(f"v_{c}") for c in payload])
    grouped = jobs.groupBy(*keys, job_key(F.col("url"), F.col("title")).alias("job_key")).agg(
        F.array_sort(F.collect_list(row)).alias("rows")
    )

    def better(kept: Column, new: Column) -> Column:
        return (new["v_percent"] > kept["v_percent"]) | (
            F.size(new["v_matched_keywords"]) > F.size(kept["v_matched_keywords"])
        )

    best = F.aggregate(
        F.slice("rows", F.lit(2), F.greatest(F.size("rows") - 1, F.lit(0))),
        F.get("rows", F.lit(0)),
        lambda kept, new: F.when(better(kept, new), new).otherwise(kept),
    )
    return grouped.withColumn("best", best).select(*keys, *[F.col(f"best.v_{c}").alias(c) for c in payload])


def dedupe_jobs(jobs: DataFrame, keys: Sequence[str] = ("company_id",), order: Sequence[str] = ("pos",)) -> DataFrame:
    """One row per company, address and title: highest confidence, first on ties."""
    keyed = jobs.withColumn("job_key", job_key(F.col("url"), F.col("title")))
    return first_per_key(keyed, [*keys, "job_key"], [F.desc("percent"), *order])


def ats_board_rows(links: DataFrame, jobs: DataFrame, keys: Sequence[str] = ("company_id",)) -> DataFrame:
    """Candidate links on a job-board host that are no known opening become one board row each (55 percent)."""
    hosted = unnest(
        links.withColumn("_p", ats_provider(F.col("link"))), F.array_compact(F.array("_p")), "provider",
        [*keys, "link"],
    )
    keyed = hosted.withColumn("_key", F.rtrim("link", F.lit("/")))
    taken = jobs.select(*keys, F.rtrim(F.col("url"), F.lit("/")).alias("_key")).distinct()
    fresh = keyed.join(taken, [*keys, "_key"], "left_anti")
    matched = match_keywords(F.col("link"))
    return fresh.select(
        *keys,
        F.concat("provider", F.lit(" careers board")).alias("title"),
        F.col("link").alias("url"),
        "provider",
        F.lit(55).alias("percent"),
        matched.alias("matched_keywords"),
        F.when(F.size(matched) > 0, F.lit("Engineering")).alias("department"),
    )


def hiring_counts(jobs: DataFrame, keys: Sequence[str] = ("company_id",)) -> DataFrame:
    """Per company counters, best job and confidence; partial aggregation runs before the shuffle.

    ``jobs`` holds pos, title, percent, matched_keywords, provider and remote, one row per opening.
    """
    kw = F.col("matched_keywords")
    overlap = lambda group: F.size(F.array_intersect(kw, words(group)))
    engineering = has_any(kw, rules.ENGINEERING_KEYWORDS)
    rank = F.struct(
        overlap(rules.FLUTTER_KEYWORDS), overlap(rules.MOBILE_KEYWORDS), F.col("percent"), F.size(kw), -F.col("pos")
    )
    return jobs.groupBy(*keys).agg(
        F.count("*").alias("jobs_found"),
        F.count_if(has_any(kw, rules.FLUTTER_KEYWORDS)).alias("flutter_jobs"),
        F.count_if(has_any(kw, rules.MOBILE_KEYWORDS)).alias("mobile_jobs"),
        F.count_if(has_any(kw, rules.FRONTEND_KEYWORDS)).alias("frontend_jobs"),
        F.count_if(engineering).alias("engineering_jobs"),
        F.coalesce(F.bool_or(engineering & F.col("remote")), F.lit(False)).alias("has_remote_engineering"),
        F.max_by("title", rank).alias("best_job"),
        F.max("percent").alias("best_percent"),
        first_value(F.col("provider"), F.col("pos")).alias("job_provider"),
    )


def company_provider(sightings: DataFrame, keys: Sequence[str] = ("company_id",)) -> DataFrame:
    """Most frequent provider per company; the one seen first wins a tie. Input: provider, pos per page or link."""
    counted = sightings.filter(F.col("provider").isNotNull()).groupBy(*keys, "provider").agg(
        F.count("*").alias("n"), F.min("pos").alias("first_pos")
    )
    return first_per_key(counted, keys, [F.desc("n"), "first_pos"]).select(*keys, "provider")


def hiring_report(
    jobs: DataFrame,
    companies: DataFrame,
    sightings: DataFrame | None = None,
    keys: Sequence[str] = ("company_id",),
) -> DataFrame:
    """One row per company. ``companies`` may hold has_careers_page and homepage_keywords flags."""
    report = companies.join(hiring_counts(jobs, keys), list(keys), "left")
    if sightings is not None:
        report = report.join(company_provider(sightings, keys), list(keys), "left")
    else:
        report = report.withColumn("provider", F.lit(None).cast("string"))
    careers = F.col("has_careers_page") if "has_careers_page" in companies.columns else F.lit(False)
    keywords = F.col("homepage_keywords") if "homepage_keywords" in companies.columns else F.lit(False)
    signals = F.coalesce(careers, F.lit(False)) | F.coalesce(keywords, F.lit(False))
    counters = ("jobs_found", "flutter_jobs", "mobile_jobs", "frontend_jobs", "engineering_jobs")
    base = F.coalesce("best_percent", F.when(signals, 30), F.lit(0))
    filled = report.withColumns({c: F.coalesce(c, F.lit(0)) for c in counters}).withColumns(
        {
            "provider": F.coalesce("provider", "job_provider"),
            "has_remote_engineering": F.coalesce("has_remote_engineering", F.lit(False)),
        }
    )
    return filled.withColumns(
        {
            "has_engineering_careers_page": (F.col("engineering_jobs") > 0)
            | (signals & F.coalesce(keywords, F.lit(False))),
            "percent": F.when(F.col("provider").isNotNull(), F.least(F.lit(100), base + 10)).otherwise(base),
        }
    ).drop("job_provider", "best_percent")


def job_order() -> list[Column]:
    """Order of a company's openings: surest first, then by title."""
    return [F.desc("percent"), F.lower(F.col("title")), F.col("pos")]


def listed_jobs(jobs: DataFrame, limit: int, keys: Sequence[str] = ("company_id",)) -> DataFrame:
    """First ``limit`` openings of each company's list with their place in it."""
    return top_per_key(jobs, keys, job_order(), limit, "job_rank")


def hiring_summary(reports: DataFrame, jobs: DataFrame, keys: Sequence[str] = ("company_id",), limit: int = 3) -> DataFrame:
    """Up to ``limit`` titles joined by ``; ``, else count phrases."""
    named = listed_jobs(jobs.filter(strip(text_or_empty(F.col("title"))) != ""), limit, keys)
    titles = named.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("job_rank", strip(F.col("title")).alias("t")))).alias("titles")
    )
    joined = reports.join(titles, list(keys), "left")
    counts = F.concat_ws(
        "; ",
        F.when(F.col("flutter_jobs") > 0, F.concat(F.col("flutter_jobs").cast("string"), F.lit(" Flutter role(s)"))),
        F.when(F.col("mobile_jobs") > 0, F.concat(F.col("mobile_jobs").cast("string"), F.lit(" mobile role(s)"))),
    )
    phrase = F.coalesce(
        blank_to_null(counts),
        F.when(F.col("jobs_found") > 0, F.concat(F.col("jobs_found").cast("string"), F.lit(" open role(s)"))),
        F.lit("No public job titles detected"),
    )
    text = F.array_join(F.transform("titles", lambda t: t["t"]), "; ")
    return joined.withColumn("hiring_summary", F.coalesce(text, phrase)).drop("titles")
