"""Lead tables: source choice, union, validation, dedupe, order and caps (family L)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions.text import strip, text_or_empty
from leadloom.functions.naming import geo_score
from leadloom.functions.urls import DEFAULT_RULES, UrlRules, canonical_website, is_usable_website, website_identity
from leadloom.operators.ordering import first_per_key, top_per_key


class UnknownSourceError(ValueError):
    """A requested source is not registered."""


def resolve_sources(requested: DataFrame, known: DataFrame, max_sources: int) -> DataFrame:
    """Requested names (name, pos) to (source, source_rank): trimmed, lower case, first mention wins.

    ``known`` holds one column ``source``. An unknown name raises. At most ``max_sources`` rows
    survive, so numbering them takes one small task.
    """
    names = requested.select(F.lower(strip(F.col("name"))).alias("source"), "pos").filter(F.col("source") != "")
    ordered = names.groupBy("source").agg(F.min("pos").alias("pos"))
    unknown = ordered.join(known.select("source"), "source", "left_anti").limit(1)
    if not unknown.isEmpty():
        raise UnknownSourceError("a requested source is not registered")
    chosen = ordered.orderBy("pos").limit(max_sources)
    return top_per_key(chosen.withColumn("_all", F.lit(0)), ["_all"], ["pos"], max_sources, "source_rank").select(
        "source", "source_rank"
    )


def union_sources(parts: Mapping[str, DataFrame]) -> DataFrame:
    """Bag union in source order; the order becomes the column ``source_rank``."""
    out = None
    for rank, (name, part) in enumerate(parts.items(), start=1):
        ranked = part.withColumns({"source": F.lit(name), "source_rank": F.lit(rank)})
        out = ranked if out is None else out.unionByName(ranked, allowMissingColumns=True)
    if out is None:
        raise ValueError("no sources given")
    return out


def validate_leads(leads: DataFrame, rules: UrlRules = DEFAULT_RULES, keep_unusable: bool = False) -> DataFrame:
    """Named leads with a usable site, first one per site identity within each source.

    With ``keep_unusable`` leads on shared hosts stay, too; their identity is the whole address.
    """
    rows = leads.withColumns({"name": strip(F.col("name")), "_site": strip(F.col("website"))})
    usable = is_usable_website(F.col("_site"), rules)
    identity, site = website_identity(F.col("_site"), rules), canonical_website(F.col("_site"), rules)
    named = rows.filter(text_or_empty(F.col("name")) != "")
    if keep_unusable:
        identity = F.when(usable, identity).otherwise(F.lower(F.rtrim("_site", F.lit("/"))))
        site = F.when(usable, site).otherwise(F.col("_site"))
    else:
        named = named.filter(usable)
    keyed = named.withColumn("identity", identity).filter(F.col("identity") != "")
    kept = first_per_key(keyed, ["source", "identity"], ["pos"])
    return kept.withColumn("website", site).drop("_site")


def _identity(leads: DataFrame, rules: UrlRules) -> DataFrame:
    return leads if "identity" in leads.columns else leads.withColumn(
        "identity", website_identity(F.col("website"), rules)
    )


def dedupe_leads(leads: DataFrame, rules: UrlRules = DEFAULT_RULES) -> DataFrame:
    """First lead per identity across sources, by (source_rank, pos)."""
    keyed = _identity(leads, rules).filter(F.col("identity") != "")
    return first_per_key(keyed, ["identity"], ["source_rank", "pos"])


def dedupe_counts(leads: DataFrame, rules: UrlRules = DEFAULT_RULES) -> DataFrame:
    """total, unique and duplicates_removed; a blank identity counts as a duplicate."""
    per_identity = _identity(leads, rules).groupBy("identity").agg(F.count("*").alias("n"))
    return per_identity.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.count_if(text_or_empty(F.col("identity")) != "").alias("unique"),
    ).withColumn("duplicates_removed", F.col("total") - F.col("unique"))


def with_score(leads: DataFrame, recomputed: Column) -> DataFrame:
    """Stored score where positive, else the recomputed one."""
    stored = F.coalesce(F.col("score"), F.lit(0))
    return leads.withColumn("score", F.when(stored > 0, stored).otherwise(recomputed))


def prioritize(leads: DataFrame) -> DataFrame:
    """Best score first; equal scores keep their order."""
    return leads.orderBy(F.desc("score"), F.asc("source_rank"), F.asc("pos"))


def limit_per_source(leads: DataFrame, limits: int | Mapping[str, int], default: int | None = None) -> DataFrame:
    """Best ``n`` leads of every source, with their rank.

    Sources without a limit of their own take ``default``; without a default they keep all leads, unranked, and no
    window runs over them.
    """
    order = [F.desc("score"), F.asc("pos")]
    if isinstance(limits, int):
        return top_per_key(leads, ["source"], order, limits, "source_pos")
    cap = F.lit(default)
    if default is not None:
        for name, n in limits.items():
            cap = F.when(F.col("source") == name, n).otherwise(cap)
        largest = max([default, *limits.values()])
        return top_per_key(leads, ["source"], order, largest, "source_pos").filter(F.col("source_pos") <= cap)
    named = F.col("source").isin(*limits)
    for name, n in limits.items():
        cap = F.when(F.col("source") == name, n).otherwise(cap)
    best = top_per_key(leads.filter(named), ["source"], order, max(limits.values(), default=0), "source_pos")
    others = leads.filter(~F.coalesce(named, F.lit(False))).withColumn("source_pos", F.lit(None).cast("int"))
    return best.filter(F.col("source_pos") <= cap).unionByName(others)


def limit_run(leads: DataFrame, n: int) -> DataFrame:
    """First ``n`` leads of the merged list."""
    return leads.orderBy("source_rank", "pos").limit(n)


def mark_new(leads: DataFrame, store: DataFrame, key: str = "website") -> DataFrame:
    """Adds ``is_new``: not in the store and the first of its key in the batch."""
    known = store.select(key).distinct().withColumn("_known", F.lit(True))
    first = first_per_key(leads, [key], ["source_rank", "pos"]).select(
        key, F.col("source_rank").alias("_rank"), F.col("pos").alias("_pos")
    )
    joined = leads.join(known, key, "left").join(first, key, "left")
    is_first = (F.col("source_rank") == F.col("_rank")) & (F.col("pos") == F.col("_pos"))
    return joined.withColumn("is_new", F.col("_known").isNull() & F.coalesce(is_first, F.lit(False))).drop(
        "_known", "_rank", "_pos"
    )


def new_leads(leads: DataFrame, store: DataFrame, key: str = "website") -> DataFrame:
    return first_per_key(leads.join(store.select(key), key, "left_anti"), [key], ["source_rank", "pos"])


def count_new(leads: DataFrame, store: DataFrame, key: str = "website") -> DataFrame:
    """Saved and skipped rows per source.

    Rows are counted per (source, key) before the store is looked up, so a repeated key
    reaches the join once per source.
    """
    per_key = leads.groupBy("source", "source_rank", key).agg(F.count("*").alias("n"))
    known = store.select(key).distinct().withColumn("_known", F.lit(True))
    first_rank = per_key.groupBy(key).agg(F.min("source_rank").alias("_first"))
    joined = per_key.join(first_rank, key).join(known, key, "left")
    saved = F.when(F.col("_known").isNull() & (F.col("source_rank") == F.col("_first")), 1).otherwise(0)
    return joined.groupBy("source").agg(
        F.sum(saved).cast("bigint").alias("saved"),
        F.sum(F.col("n") - saved).cast("bigint").alias("duplicates"),
    )


def filter_qualified(leads: DataFrame, scored: DataFrame, key: str = "company_id") -> DataFrame:
    return leads.join(scored.filter(F.col("qualified")).select(key), key, "left_semi")


def enrichment_gate(leads: DataFrame, rules: UrlRules = DEFAULT_RULES) -> DataFrame:
    """Adds ``enrich`` and ``warnings``: a lead without a usable site is only scored, not enriched."""
    usable = is_usable_website(F.col("website"), rules)
    warning = F.array(F.lit("website is not a usable company site; enrichment skipped"))
    return leads.withColumns(
        {
            "enrich": usable,
            "warnings": F.when(usable, F.array().cast("array<string>")).otherwise(warning),
        }
    )


def split_by_gate(leads: DataFrame, rules: UrlRules = DEFAULT_RULES) -> tuple[DataFrame, DataFrame]:
    """(to enrich, to score only): the filter sits before any Python stage, so it reaches the scan."""
    gated = enrichment_gate(leads, rules)
    return gated.filter("enrich"), gated.filter("not enrich")


def collect_leads(
    parts: Mapping[str, DataFrame],
    per_source: int | Mapping[str, int] | None = None,
    run_limit: int | None = None,
    rules: UrlRules = DEFAULT_RULES,
    keep_unusable: bool = False,
) -> DataFrame:
    """Daily collection: score again, validate, merge, dedupe; top-n per source and per run only where asked.

    Without a limit no window runs over a source, however large it is.
    """
    merged = union_sources(parts)
    merged = with_score(merged, geo_score(F.col("website"), F.lit(""), F.concat_ws(" ", "description", "name")))
    if per_source is not None:
        ranked = limit_per_source(merged, per_source)
        merged = ranked.withColumn("pos", F.coalesce(F.col("source_pos").cast("bigint"), "pos"))
    valid = validate_leads(merged, rules, keep_unusable)
    unique = dedupe_leads(valid, rules)
    return unique if run_limit is None else limit_run(unique, run_limit)


def source_order(names: Sequence[str], column: Column) -> Column:
    """Rank of a source name in a given order."""
    return F.array_position(F.array(*[F.lit(n) for n in names]), column)
