"""Company names, titles and the geographic match score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom.functions.text import blank_to_null, first_case, squash, strip, text_or_empty
from leadloom.functions.urls import website_has_suffix
from leadloom.rules import web


def _cut(c: Column, separator: str) -> tuple[Column, Column]:
    left = F.substring_index(c, separator, 1)
    right = F.substr(c, F.length(left) + F.lit(len(separator) + 1))
    return strip(left), strip(right)


def show_title(title: Column) -> Column:
    """``Show HN: Name - tagline`` as struct(name, tagline)."""
    cleaned = strip(F.regexp_replace(strip(text_or_empty(title)), r"(?i)^Show\s+HN:\s*", ""))
    names, taglines = [], []
    for separator in web.SHOW_SEPARATORS:
        left, right = _cut(cleaned, separator)
        applies = F.contains(cleaned, F.lit(separator)) & (left != "")
        names.append((applies, left))
        taglines.append((applies, blank_to_null(right)))
    return F.struct(
        first_case(names, cleaned).alias("name"),
        first_case(taglines, F.lit(None).cast("string")).alias("tagline"),
    )


def clean_display_name(name: Column, separators: Sequence[str] = web.TAGLINE_SEPARATORS) -> Column:
    """Cut a title at the first tagline separator that leaves a brand-like left side."""
    cleaned = squash(text_or_empty(name))
    cases = []
    for separator in separators:
        left, right = _cut(cleaned, separator)
        slogan = (F.length(right) >= 8) | (F.length(cleaned) > 35)
        cases.append(
            (F.contains(cleaned, F.lit(separator)) & (left != "") & (F.length(left) <= 40) & slogan, left)
        )
    return first_case(cases, cleaned)


def prefer_name(seed_name: Column, profile_name: Column, default: str = "your company") -> Column:
    """Choose between the feed name and the name read from the site."""
    seed, profile = clean_display_name(seed_name), clean_display_name(profile_name)
    seed_len, profile_len = F.length(seed), F.length(profile)
    return first_case(
        [
            ((seed == "") & (profile == ""), F.lit(default)),
            (profile == "", seed),
            (seed == "", profile),
            (F.lower(seed) == F.lower(profile), seed),
            (F.contains(F.lower(profile), F.lower(seed)) & (profile_len > seed_len + 3), seed),
            (F.contains(F.lower(seed), F.lower(profile)) & (seed_len > profile_len + 3), profile),
            ((F.abs(profile_len - seed_len) >= 10) & (seed_len >= profile_len), profile),
        ],
        seed,
    )


def geo_pattern(terms: Sequence[str] = web.INDIA_TERMS) -> str:
    return r"(?iU)\b(" + "|".join(terms) + r")\b"


def geo_score(
    website: Column,
    locations: Column,
    texts: Column,
    pattern: str | None = None,
    suffixes: Sequence[str] = web.INDIAN_SUFFIXES,
    weights: tuple[int, int, int] = (40, 50, 20),
) -> Column:
    """Additive match score: site suffix, stated location, mention in the texts."""
    regex = pattern or geo_pattern()

    def points(condition: Column, value: int) -> Column:
        return F.when(F.coalesce(condition, F.lit(False)), value).otherwise(0)

    return (
        points(website_has_suffix(website, suffixes), weights[0])
        + points(locations.rlike(regex), weights[1])
        + points(texts.rlike(regex), weights[2])
    )
