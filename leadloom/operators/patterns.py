"""Likely addresses from names and known mail (family E). Confidences are whole percents."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions.text import let, squash, text_or_empty
from leadloom.operators.ordering import first_per_key
from leadloom.operators.rows import unnest
from leadloom.rules import addresses as rules

PatternBuilder = Callable[[Column, Column], Column]


def template_builder(template: str) -> PatternBuilder:
    """Builder for a mailbox template over {first}, {last}, {f} and {l}; null when a part is missing."""

    def build(first: Column, last: Column) -> Column:
        parts = {"first": first, "last": last, "f": F.substring(first, 1, 1), "l": F.substring(last, 1, 1)}
        pieces = [parts[p[1:-1]] if p.startswith("{") else F.lit(p) for p in re.findall(r"\{\w+\}|[^{]+", template)]
        used = [parts[p[1:-1]] for p in re.findall(r"\{\w+\}", template)]
        missing = F.lit(False)
        for part in used:
            missing = missing | (text_or_empty(part) == "")
        return F.when(~missing, F.concat(*pieces))

    return build


def pattern_table(patterns=rules.PATTERNS) -> list[tuple[str, PatternBuilder, int]]:
    """(name, builder, base percent); a caller may pass its own builders."""
    return [(n, t if callable(t) else template_builder(t), p) for n, t, p in patterns]


def name_tokens(full_name: Column) -> Column:
    """struct(first, last): first and last word as lower-case letters and digits; last is blank for one word."""

    def pick(tokens: Column) -> Column:
        return F.struct(
            F.try_element_at(tokens, F.lit(1)).alias("first"),
            F.when(F.size(tokens) >= 2, F.try_element_at(tokens, F.lit(-1))).otherwise("").alias("last"),
        )

    words = F.transform(F.split(F.lower(squash(full_name)), r"\s+"), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}]", ""))
    return let(F.filter(words, lambda w: w != ""), pick)


def mailbox_pattern(local: Column) -> Column:
    """Pattern a known personal mailbox follows, null when it follows none."""
    return (
        F.when(local.rlike(r"^[^.]\..+$"), "f.lastname")
        .when(local.rlike(r"^[^.]+\..+$"), "first.last")
        .when(local.rlike(r"^[^_]+_.+$"), "first_last")
        .when(F.regexp_replace(local, r"[^\p{L}\p{N}]", "").rlike(r"^\p{L}+$"), "firstname")
    )


def infer_patterns(emails: DataFrame, patterns=rules.PATTERNS) -> DataFrame:
    """(domain, pattern, percent, matches, shared) from known addresses, one row per supported pattern.

    Addresses are counted per domain and mailbox pattern before anything is joined; the pattern table is a
    constant array, so a domain with many addresses costs one pre-aggregated row per pattern.
    """
    e = F.lower(F.trim("email"))
    split = emails.select(
        F.regexp_extract(e, r"^(.*)@[^@]*$", 1).alias("local"), F.regexp_extract(e, r"@([^@]*)$", 1).alias("domain")
    ).filter((F.col("domain") != "") & (F.col("local") != ""))
    shared = F.col("local").isin(*rules.GENERIC)
    per_domain = split.groupBy("domain").agg(
        F.count_if(shared).alias("shared"),
        *[
            F.count_if(~shared & (mailbox_pattern(F.col("local")) == name)).alias(f"_n{i}")
            for i, (name, _, _) in enumerate(patterns)
        ],
    )
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("rank"), F.lit(name).alias("pattern"), F.lit(base).alias("base"), F.col(f"_n{i}").alias("matches"))
            for i, (name, _, base) in enumerate(patterns)
        ]
    )
    long = unnest(
        per_domain, F.filter(rows, lambda r: (r["matches"] > 0) | (F.col("shared") > 0)), "r", ["domain", "shared"]
    ).select("domain", "shared", "r.*")
    personal = F.least(F.lit(95), F.lit(75) + F.col("matches") * 5)
    boosted = (
        F.when((F.col("matches") > 0) & (F.col("shared") > 0), F.least(F.lit(98), personal + 10))
        .when(F.col("matches") > 0, personal)
        .otherwise(F.least(F.lit(85), F.col("base") + 10))
    )
    return long.select("domain", "rank", "pattern", boosted.cast("int").alias("percent"), "matches", "shared")


def generate_addresses(contacts: DataFrame, inferred: DataFrame, patterns=rules.PATTERNS) -> DataFrame:
    """Every pattern applied to every named contact of a domain, with its confidence.

    ``contacts`` holds domain and full_name. The patterns unfold inside the row; the inferred
    percents arrive as one small map per domain, so the join has one row per domain on that side.
    """
    known = inferred.groupBy("domain").agg(F.map_from_entries(F.collect_list(F.struct("pattern", "percent"))).alias("_known"))
    named = contacts.withColumn("_t", name_tokens(F.col("full_name"))).filter(F.col("_t.first").isNotNull())
    joined = named.join(known, "domain", "left")
    first, last = F.col("_t.first"), F.col("_t.last")
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("rank"), F.lit(name).alias("pattern"), F.lit(base).alias("base"), build(first, last).alias("local")
            )
            for i, (name, build, base) in enumerate(pattern_table(patterns))
        ]
    )
    unfolded = unnest(joined, F.filter(rows, lambda r: r["local"].isNotNull()), "r")
    partial = F.when(F.col("_t.last") != "", F.col("r.base")).otherwise(F.greatest(F.lit(35), F.col("r.base") - 15))
    percent = F.coalesce(F.try_element_at("_known", F.col("r.pattern")), partial)
    kept = [c for c in contacts.columns]
    return unfolded.select(
        *kept,
        "r.rank",
        "r.pattern",
        F.concat("r.local", F.lit("@"), "domain").alias("address"),
        percent.alias("percent"),
    )


def pattern_report(addresses: DataFrame, known_domains: DataFrame | None = None) -> DataFrame:
    """Per domain the surest pattern (rule order on ties), its percent and the number of distinct addresses.

    Domains with known mail but no named contact get 40 percent and no pattern.
    """
    best = addresses.groupBy("domain", "rank", "pattern").agg(F.max("percent").alias("percent"))
    top = first_per_key(best, ["domain"], [F.desc("percent"), "rank"])
    counts = addresses.groupBy("domain").agg(F.count_distinct(F.lower("address")).alias("candidates"))
    report = top.join(counts, "domain").select("domain", F.col("pattern").alias("inferred_pattern"), "percent", "candidates")
    if known_domains is None:
        return report
    missing = known_domains.select("domain").distinct().join(report, "domain", "left_anti")
    return report.unionByName(
        missing.select("domain", F.lit(None).cast("string").alias("inferred_pattern"), F.lit(40).alias("percent"), F.lit(0).cast("bigint").alias("candidates"))
    )


def pattern_addresses(addresses: DataFrame) -> DataFrame:
    """Distinct lower-case addresses per domain and pattern with the best percent, as rows."""
    return addresses.groupBy("domain", "pattern", F.lower("address").alias("address")).agg(F.max("percent").alias("percent"))


def best_candidates(addresses: DataFrame, order: Sequence[str] = ("pos",)) -> DataFrame:
    """First address of the surest pattern per domain."""
    return first_per_key(addresses, ["domain"], [F.desc("percent"), "rank", *order]).select("domain", "address")
