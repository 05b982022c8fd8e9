"""Stored tables: upserts, changes, search and pages (family D)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions.text import blank_to_null, strip, text_or_empty
from leadloom.functions.urls import canonical_website
from leadloom.operators.ordering import first_per_key, join_sparse

# Tag prefixes and sortable company columns.
TECH_TAG = "tech:"
PATTERN_TAG = "email_pattern:"
SORTABLE = ("name", "website", "source", "created_at")


def upsert(target: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[Column | str] = ()) -> DataFrame:
    """Target after the batch: new non-null values win. Adds ``action`` (created, updated, kept).

    The batch is reduced to one row per key first, so a repeated key cannot multiply rows.
    """
    fresh = first_per_key(batch, keys, list(order) or [c for c in batch.columns if c not in keys])
    values = [c for c in target.columns if c not in keys]
    old = target.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in values], F.lit(True).alias("_in_target"))
    new = fresh.select(
        *keys,
        *[(F.col(c) if c in batch.columns else F.lit(None).cast(target.schema[c].dataType)).alias(f"_new_{c}") for c in values],
        F.lit(True).alias("_in_batch"),
    )
    joined = old.join(new, list(keys), "full_outer")
    action = (
        F.when(F.col("_in_target").isNull(), "created").when(F.col("_in_batch").isNull(), "kept").otherwise("updated")
    )
    return joined.select(
        *keys, *[F.coalesce(f"_new_{c}", f"_old_{c}").alias(c) for c in values], action.alias("action")
    )


def action_counts(actions: DataFrame) -> DataFrame:
    """created, updated and skipped counts per table. Input: table, action."""
    return actions.groupBy("table").agg(
        *[F.count_if(F.col("action") == a).alias(a) for a in ("created", "updated", "skipped", "duplicate")]
    )


def contact_name(full_name: Column, first: Column, last: Column, email: Column) -> Column:
    """Full name, else first and last, else the mailbox name."""
    joined = F.concat_ws(" ", blank_to_null(strip(first)), blank_to_null(strip(last)))
    return F.coalesce(
        blank_to_null(strip(full_name)), blank_to_null(joined), blank_to_null(strip(F.regexp_extract(email, "^([^@]*)@", 1)))
    )


def match_ladder(target: DataFrame, batch: DataFrame, ladder: Sequence[Sequence[str]], id_col: str = "id") -> DataFrame:
    """Adds ``matched_id``: the target id found by the first key of the ladder that hits.

    Every rung is one key join against a reduced key table (smallest id per key), so no rung can
    multiply batch rows; null key parts never match.
    """
    out = batch
    found = []
    for i, keys in enumerate(ladder):
        complete = [F.col(k).isNotNull() for k in keys]
        usable = target
        for test in complete:
            usable = usable.filter(test)
        rung = usable.groupBy(*keys).agg(F.min(id_col).alias(f"_m{i}"))
        out = join_sparse(out, rung, list(keys))
        found.append(F.col(f"_m{i}"))
    return out.withColumn("matched_id", F.coalesce(*found)).drop(*[f"_m{i}" for i in range(len(ladder))])


def upsert_ladder(
    target: DataFrame, batch: DataFrame, ladder: Sequence[Sequence[str]], name_col: str, id_col: str = "id", pos: str = "pos"
) -> DataFrame:
    """Batch rows with their ``action`` against the target: created, updated, duplicate or skipped (no name).

    Rows that resolve to one target row (or to one new identity) collapse to the last one; the
    earlier ones are duplicates.
    """
    named = batch.withColumn("_named", text_or_empty(F.col(name_col)) != "")
    matched = match_ladder(target, named, ladder, id_col)
    new_keys = [
        F.when(F.concat_ws("", *[F.when(F.col(k).isNull(), "x") for k in keys]) == "", F.concat_ws("|", F.lit(str(i)), *[F.col(k).cast("string") for k in keys]))
        for i, keys in enumerate(ladder)
    ]
    identity = F.when(F.col("matched_id").isNotNull(), F.concat(F.lit("id|"), F.col("matched_id").cast("string"))).otherwise(
        F.coalesce(*new_keys)
    )
    keyed = matched.withColumn("_identity", identity)
    last = keyed.filter("_named").groupBy("_identity").agg(F.max(pos).alias("_last"))
    joined = keyed.join(last, "_identity", "left")
    action = (
        F.when(~F.col("_named"), "skipped")
        .when(F.col(pos) < F.col("_last"), "duplicate")
        .when(F.col("matched_id").isNull(), "created")
        .otherwise("updated")
    )
    return joined.withColumn("action", action).drop("_named", "_identity", "_last")


def apply_ladder(target: DataFrame, resolved: DataFrame, id_col: str = "id") -> DataFrame:
    """Target rows after a resolved ladder batch: updated rows replaced field by field, created rows added."""
    values = [c for c in target.columns if c != id_col]
    changes = resolved.filter(F.col("action") == "updated").select(
        F.col("matched_id").alias(id_col), *[F.col(c).alias(f"_n_{c}") for c in values if c in resolved.columns]
    )
    updated = target.join(changes, id_col, "left").select(
        id_col, *[(F.coalesce(f"_n_{c}", c) if c in resolved.columns else F.col(c)).alias(c) for c in values]
    )
    created = resolved.filter(F.col("action") == "created").select(*[c for c in values if c in resolved.columns])
    return updated.unionByName(created, allowMissingColumns=True)


def merge_tags(existing: Column, industry: Column, technologies: Column, pattern: Column | None = None) -> Column:
    """Existing order kept; a new industry goes first, new technologies last, one pattern tag replaces the old."""
    none = F.array().cast("array<string>")
    tags = F.coalesce(existing, none)
    name = blank_to_null(industry)
    front = F.when(name.isNotNull() & ~F.array_contains(tags, name), F.concat(F.array(name), tags)).otherwise(tags)
    named = F.transform(F.coalesce(technologies, none), lambda t: F.concat(F.lit(TECH_TAG), t))
    merged = F.concat(front, F.array_except(F.array_distinct(named), front))
    if pattern is None:
        return merged
    kept = F.filter(merged, lambda t: ~t.startswith(PATTERN_TAG))
    tag = F.concat(F.lit(PATTERN_TAG), F.lower(pattern))
    return F.when(pattern.isNotNull(), F.array_append(kept, tag)).otherwise(merged)


def apply_changes(companies: DataFrame, changes: DataFrame) -> DataFrame:
    """Companies after create, update and delete requests, plus refused ones.

    ``changes`` holds pos, op, company_id, name, website, description, source. Only given (non-null)
    fields change. A website that another company has is refused. Result: the company columns and
    ``outcome`` (kept, created, updated, deleted, conflict).
    """
    trimmed = changes.withColumns(
        {
            **{c: blank_to_null(strip(F.col(c))) for c in ("name", "description", "source")},
            "website": F.when(F.col("website").isNotNull(), canonical_website(F.col("website"))),
        }
    )
    owners = companies.groupBy("website").agg(F.min("company_id").alias("_owner"))
    asked = join_sparse(trimmed, owners, ["website"])
    first_ask = asked.filter(F.col("website").isNotNull() & (F.col("op") != "delete")).groupBy("website").agg(F.min("pos").alias("_first"))
    judged = join_sparse(asked, first_ask, ["website"]).withColumn(
        "_conflict",
        F.col("website").isNotNull()
        & (F.col("op") != "delete")
        & (
            (F.col("_owner").isNotNull() & ~F.coalesce(F.col("_owner") == F.col("company_id"), F.lit(False)))
            | (F.col("pos") > F.col("_first"))
        ),
    )
    fields = ("name", "website", "description", "source")
    per_company = first_per_key(
        judged.filter((F.col("op") != "create") & ~F.col("_conflict")), ["company_id"], ["pos"]
    ).select("company_id", F.col("op").alias("_op"), *[F.col(c).alias(f"_n_{c}") for c in fields])
    current = companies.join(per_company, "company_id", "left").select(
        "company_id",
        *[F.coalesce(f"_n_{c}", c).alias(c) for c in fields],
        F.when(F.col("_op") == "delete", "deleted").when(F.col("_op") == "update", "updated").otherwise("kept").alias("outcome"),
    )
    created = judged.filter((F.col("op") == "create") & ~F.col("_conflict")).select(
        F.sha2("website", 256).alias("company_id"), *fields, F.lit("created").alias("outcome")
    )
    refused = judged.filter("_conflict").select("company_id", *fields, F.lit("conflict").alias("outcome"))
    cast = lambda df: df.withColumn("company_id", F.col("company_id").cast("string"))
    return cast(current).unionByName(cast(created)).unionByName(cast(refused))


def search_companies(
    companies: DataFrame, term: str | None = None, sort: str = "created_at", order: str = "desc", literal: bool = False
) -> DataFrame:
    """Case-insensitive search over name, website and source (a regular expression unless ``literal``)."""
    out = companies
    if term and term.strip():
        if literal:
            hit = lambda c: F.contains(F.lower(F.col(c)), F.lit(term.strip().lower()))
        else:
            hit = lambda c: F.col(c).rlike("(?i)" + term.strip())
        out = out.filter(hit("name") | hit("website") | hit("source"))
    column = sort if sort in SORTABLE else "created_at"
    direction = F.desc if order.lower() == "desc" else F.asc
    return out.orderBy(direction(column), F.asc("company_id"))


def paginate(rows: DataFrame, page: int = 1, size: int = 20) -> DataFrame:
    """One page of an ordered table by skipping rows; deep pages of large tables: ``directory.PageDirectory``."""
    if page < 1 or size < 1:
        raise ValueError("page and size must be at least 1")
    return rows.offset((page - 1) * size).limit(size)


def page_info(rows: DataFrame, size: int = 20) -> DataFrame:
    """total and total_pages as one row."""
    return rows.agg(F.count("*").alias("total")).withColumn("total_pages", F.ceil(F.col("total") / size))


def find_many(table: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """All rows whose key is in a key table (batch form of point lookups)."""
    return table.join(keys.select(*on).distinct(), list(on), "left_semi")


def exists_flags(keys: DataFrame, table: DataFrame, on: Sequence[str]) -> DataFrame:
    """Adds ``found`` per key row."""
    known = table.select(*on).distinct().withColumn("_hit", F.lit(True))
    return keys.join(known, list(on), "left").withColumn("found", F.coalesce("_hit", F.lit(False))).drop("_hit")


def website_conflicts(companies: DataFrame) -> DataFrame:
    """Stored rows that share a canonical website with a row of a smaller id, with that id.

    The smallest id per site comes from a grouped minimum, so a site with very many rows gives one
    line per row, never all pairs.
    """
    keyed = companies.withColumn("website", canonical_website(F.col("website")))
    first = keyed.groupBy("website").agg(F.min("company_id").alias("first_id"), F.count("*").alias("_n")).filter("_n > 1")
    return keyed.join(first.drop("_n"), "website").filter(F.col("company_id") > F.col("first_id")).select("website", "company_id", "first_id")


def company_view(companies: DataFrame, zone: str = "Asia/Kolkata") -> DataFrame:
    """Response shape: industry is the first tag, times in the display zone."""
    return companies.withColumns(
        {"industry": F.get("tags", F.lit(0)), "created_at": F.from_utc_timestamp("created_at", zone)}
    )


def report_text(rows: DataFrame) -> DataFrame:
    """One text section per company of a validation run (column ``value``)."""
    yes = lambda c: F.when(F.coalesce(F.col(c), F.lit(False)), "YES").otherwise("NO")
    line = "=" * 57
    parts: list[Column] = [F.lit(line), F.lit("")]

    def section(title: str, value: Column) -> None:
        parts.extend([F.lit(title + ":"), value.cast("string"), F.lit("")])

    section("Name", F.col("name"))
    section("Website", F.col("website"))
    section("Website Reachable", yes("website_reachable"))
    section("Technologies", F.coalesce(blank_to_null(F.array_join("technologies", ", ")), F.lit("None")))
    section("Mobile App", yes("mobile_app"))
    section("Play Store", yes("play_store"))
    section("App Store", yes("app_store"))
    section("Qualification", F.when(F.col("qualification_pass"), "PASS").otherwise("FAIL"))
    section("Qualification Score", F.col("qualification_score"))
    section("Contact Emails Found", F.col("contact_emails_found"))
    section("Decision Makers", F.col("decision_makers"))
    section("Email Pattern", F.coalesce(F.col("email_pattern"), F.lit("None")))
    section("Lead Score", F.format_string("%.0f", F.col("lead_score")))
    return rows.select(F.concat_ws("\n", *parts).alias("value"))


def write_report(rows: DataFrame, path: str) -> None:
    report_text(rows).write.mode("overwrite").text(path)
