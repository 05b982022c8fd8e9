"""Technologies per page (family T)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions.text import let, sql_string, text_or_empty
from leadloom.operators.rows import unnest
from leadloom.rules.technology import TECHNOLOGY_RULES, TechnologyRule

MINIMUM_CONFIDENCE = 50


def search_blob(html: Column, *extra: Column) -> Column:
    """Lower-case text the markers are searched in."""
    return F.lower(F.concat_ws("\n", html, *extra))


def rule_table(rules: Sequence[TechnologyRule], enabled: Sequence[str] | None = None) -> Column:
    """The marker rules as one constant array of structs."""
    allowed = None if enabled is None else {n.strip().lower() for n in enabled}
    rows = []
    for rank, rule in enumerate(rules):
        if allowed is not None and rule.name.lower() not in allowed:
            continue
        markers = ", ".join(
            f"named_struct('needle', {sql_string(m.lower())}, 'shown', {sql_string(m)})" for m in rule.markers
        )
        headers = ", ".join(
            f"named_struct('name', {sql_string(n.lower())}, 'expected', {sql_string(x.lower())})" for n, x in rule.headers
        )
        rows.append(
            f"named_struct('rank', {rank}, 'name', {sql_string(rule.name)}, 'category', {sql_string(rule.category)}, "
            f"'base', {rule.confidence}, 'markers', array({markers}), "
            f"'headers', cast(array({headers}) as array<struct<name:string,expected:string>>))"
        )
    return F.expr("array(" + ", ".join(rows) + ")")


def technologies(
    blob: Column,
    headers: Column | None = None,
    rules: Sequence[TechnologyRule] = TECHNOLOGY_RULES,
    minimum: int = MINIMUM_CONFIDENCE,
    enabled: Sequence[str] | None = None,
) -> Column:
    """Array of struct(order, rank, name, category, confidence, evidence): surest first, then rule order."""

    def scored(text: Column) -> Column:
        def row(rule: Column) -> Column:
            hits = F.filter(rule["markers"], lambda m: F.contains(text, m["needle"]))
            evidence = F.transform(hits, lambda m: F.concat(F.lit("Found marker: "), m["shown"]))
            if headers is not None:
                evidence = F.concat(evidence, _header_evidence(rule["headers"], headers))
            return let(evidence, lambda e: build(rule, e))

        return F.transform(rule_table(rules, enabled), row)

    def build(rule: Column, evidence: Column) -> Column:
        confidence = F.least(F.lit(100), rule["base"] + F.size(evidence) * 5 - 5)
        return F.struct(
            (-confidence).alias("order"),
            rule["rank"].alias("rank"),
            rule["name"].alias("name"),
            rule["category"].alias("category"),
            confidence.alias("confidence"),
            evidence.alias("evidence"),
        )

    kept = F.filter(
        let(blob, scored), lambda t: (F.size(t["evidence"]) > 0) & (t["confidence"] >= minimum)
    )
    return F.array_sort(kept)


def _header_evidence(rules: Column, headers: Column) -> Column:
    entries = F.map_entries(headers)

    def named(name: Column) -> Column:
        return F.try_element_at(F.filter(entries, lambda x: F.lower(x["key"]) == name), F.lit(1))["value"]

    stated = F.transform(rules, lambda h: F.struct(h.alias("h"), text_or_empty(named(h["name"])).alias("v")))
    hit = F.filter(stated, lambda x: (x["v"] != "") & F.contains(F.lower(x["v"]), x["h"]["expected"]))
    return F.transform(hit, lambda x: F.concat(F.lit("Found header "), x["h"]["name"], F.lit(": "), x["v"]))


def detect_technologies(
    pages: DataFrame,
    html_col: str = "html",
    extra: Sequence[str] = (),
    headers_col: str | None = None,
    rules: Sequence[TechnologyRule] = TECHNOLOGY_RULES,
    minimum: int = MINIMUM_CONFIDENCE,
    enabled: Sequence[str] | None = None,
) -> DataFrame:
    """Adds ``technologies`` and ``detected_count``."""
    headers = F.col(headers_col) if headers_col else None
    blob = search_blob(F.col(html_col), *[F.col(c) for c in extra])
    found = pages.withColumn("technologies", technologies(blob, headers, rules, minimum, enabled))
    return found.withColumn("detected_count", F.size("technologies"))


def technology_rows(pages: DataFrame, keys: Sequence[str] = ("page_id",)) -> DataFrame:
    """Long form: one row per page and technology."""
    rows = unnest(pages, "technologies", "t", keys, "tech_pos")
    return rows.select(*keys, "tech_pos", "t.name", "t.category", "t.confidence", "t.evidence")


def marker_rows(
    pages: DataFrame, html_col: str = "html", rules: Sequence[TechnologyRule] = TECHNOLOGY_RULES,
    keys: Sequence[str] = ("page_id",),
) -> DataFrame:
    """Every marker hit: (keys, name, category, evidence), before confidence filtering."""
    found = detect_technologies(pages, html_col, rules=rules, minimum=0)
    rows = technology_rows(found, keys)
    return unnest(rows, "evidence", "evidence", [*keys, "name", "category"])
