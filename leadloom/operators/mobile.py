"""Mobile app signs per page (family M)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions.text import contains_any, found, is_in, let
from leadloom.operators.rows import unnest
from leadloom.rules.technology import (
    APP_PHRASES,
    BUTTON_PATTERNS,
    MOBILE_CONFIDENCE,
    PLAIN_SCHEMES,
    UNIVERSAL_MARKS,
)

MINIMUM_PERCENT = 50
PLAY = "play.google.com"
APPLE = ("apps.apple.com", "itunes.apple.com")
_NO_STRINGS = "array<string>"


def _none() -> Column:
    return F.array().cast(_NO_STRINGS)


def _rule(name: str, evidence: Column, links: Column, android: Column, ios: Column) -> Column:
    return F.when(
        F.size(evidence) > 0,
        F.struct(
            F.lit(name).alias("rule"),
            F.lit(MOBILE_CONFIDENCE[name]).alias("percent"),
            evidence.alias("evidence"),
            links.alias("links"),
            android.alias("android"),
            ios.alias("ios"),
        ),
    )


def _prefixed(prefix: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.concat(F.lit(prefix), v))


def _linked(name: str, prefix: str, links: Column, android: bool, ios: bool) -> Column:
    return let(links, lambda l: _rule(name, _prefixed(prefix, l), l, F.lit(android), F.lit(ios)))


def _store_region(name: str, where: str, html: Column, tag: str) -> Column:
    region = F.lower(F.regexp_extract(html, rf"(?is)<{tag}.*?</{tag}>", 0))

    def build(r: Column) -> Column:
        play = F.contains(r, F.lit(PLAY))
        apple = contains_any(r, APPLE)
        evidence = F.array_compact(
            F.array(
                F.when(play, F.lit(f"Google Play link found in {where}")),
                F.when(apple, F.lit(f"App Store link found in {where}")),
            )
        )
        links = F.array_compact(F.array(F.when(play, F.lit(PLAY)), F.when(apple, F.lit(APPLE[0]))))
        return _rule(name, evidence, links, play, apple)

    return let(region, build)


def mobile_signs(html: Column, blob: Column, links: Column) -> Column:
    """Matched rules as an array of structs. Arguments must be plain columns.

    ``blob`` is the lower-case page text with its links, ``links`` the absolute link array.
    """
    play_links = F.filter(links, lambda u: F.contains(F.lower(u), F.lit(PLAY)))
    play = F.when(F.size(play_links) > 0, F.array_distinct(play_links)).when(
        F.contains(blob, F.lit(PLAY)), F.array(F.lit(PLAY))
    ).otherwise(_none())
    apple_links = F.filter(links, lambda u: contains_any(F.lower(u), APPLE))
    apple = F.when(F.size(apple_links) > 0, F.array_distinct(apple_links)).otherwise(found(blob, APPLE))
    html_lower = F.lower(html)
    banner_ios = F.contains(html_lower, F.lit("apple-itunes-app"))
    banner_android = F.contains(html_lower, F.lit("google-play-app"))
    banner = F.array_compact(
        F.array(
            F.when(banner_ios, F.lit("Found apple-itunes-app smart banner meta tag")),
            F.when(banner_android, F.lit("Found google-play-app smart banner meta tag")),
        )
    )
    universal = _prefixed("Found universal link marker: ", found(blob, UNIVERSAL_MARKS))
    intent_links = F.filter(links, lambda u: F.startswith(F.lower(u), F.lit("intent:")))
    intent = F.when(F.size(intent_links) > 0, intent_links).when(
        F.contains(blob, F.lit("intent://")), F.array(F.lit("intent://"))
    ).otherwise(_none())
    plain = list(PLAIN_SCHEMES) + ["intent"]
    scheme = lambda u: F.lower(F.regexp_extract(u, r"^([a-zA-Z][a-zA-Z0-9+.\-]*):", 1))
    deep_links = F.filter(links, lambda u: (scheme(u) != "") & ~is_in(scheme(u), plain))
    stated = F.array_distinct(F.regexp_extract_all(html, F.lit(r"(?i)\b([a-z][a-z0-9+\-.]*)://"), 0))
    deep_text = F.filter(stated, lambda v: ~is_in(scheme(v), plain))

    def deep(pair: Column) -> Column:
        fresh = F.array_except(pair["text"], pair["links"])
        evidence = F.concat(
            _prefixed("Custom deep link scheme detected: ", pair["links"]),
            F.transform(fresh, lambda v: F.concat(F.lit("Custom URI scheme detected: "), F.lower(v))),
        )
        return _rule("deep_link", evidence, F.concat(pair["links"], fresh), F.lit(True), F.lit(True))

    def phrases(hits: Column) -> Column:
        ios = F.exists(hits, lambda p: F.contains(p, F.lit("app store")))
        android = F.exists(hits, lambda p: F.contains(p, F.lit("google play")))
        return _rule(
            "download_app_button", _prefixed("Found mobile CTA text: ", hits), _none(), android | ~ios, ios | ~android
        )

    buttons = F.concat(*[F.regexp_extract_all(html, F.lit("(?i)" + p), 0) for p in BUTTON_PATTERNS])
    button_text = F.transform(
        buttons, lambda b: F.concat(F.lit("Found mobile CTA button: "), F.trim(b))
    )
    return F.array_compact(
        F.array(
            _linked("google_play_link", "Google Play link detected: ", play, True, False),
            _linked("apple_app_store_link", "Apple App Store link detected: ", apple, False, True),
            _rule("smart_banner", banner, _none(), banner_android, banner_ios),
            let(
                universal,
                lambda e: _rule("universal_link", e, _none(), F.contains(blob, F.lit("android:host")), F.lit(True)),
            ),
            _linked("android_intent_link", "Android intent link detected: ", intent, True, False),
            let(F.struct(deep_links.alias("links"), deep_text.alias("text")), deep),
            let(found(blob, APP_PHRASES), phrases),
            _store_region("footer_app_link", "footer", html, "footer"),
            _store_region("navigation_app_link", "navigation", html, "nav"),
            let(button_text, lambda e: _rule("mobile_cta_button", e, _none(), F.lit(True), F.lit(True))),
        )
    )


def mobile_result(signs: Column, minimum: int = MINIMUM_PERCENT) -> Column:
    """struct(has_mobile_app, percent, android, ios, evidence, links) out of the matched rules."""

    def build(kept: Column) -> Column:
        percent = F.coalesce(F.array_max(F.transform(kept, lambda r: r["percent"])), F.lit(0))
        return F.struct(
            ((F.size(kept) > 0) & (percent >= minimum)).alias("has_mobile_app"),
            percent.alias("percent"),
            F.exists(kept, lambda r: r["android"]).alias("android"),
            F.exists(kept, lambda r: r["ios"]).alias("ios"),
            F.array_sort(F.array_distinct(F.flatten(F.transform(kept, lambda r: r["evidence"])))).alias("evidence"),
            F.array_sort(F.array_distinct(F.flatten(F.transform(kept, lambda r: r["links"])))).alias("links"),
        )

    return let(F.filter(signs, lambda r: r["percent"] >= minimum), build)


def detect_mobile(
    pages: DataFrame,
    html_col: str = "html",
    links_col: str | None = None,
    extra: Sequence[str] = (),
    minimum: int = MINIMUM_PERCENT,
) -> DataFrame:
    """Adds ``mobile_signs`` and ``mobile``."""
    links = F.coalesce(F.col(links_col), _none()) if links_col else _none()
    blob = F.concat_ws("\n", F.col(html_col), *[F.col(c) for c in extra], F.array_join("_links", "\n"))
    rows = pages.withColumn("_links", links).withColumn("_blob", F.lower(blob))
    signed = rows.withColumn("mobile_signs", mobile_signs(F.col(html_col), F.col("_blob"), F.col("_links")))
    return signed.withColumn("mobile", mobile_result(F.col("mobile_signs"), minimum)).drop("_links", "_blob")


def mobile_rows(pages: DataFrame, keys: Sequence[str] = ("page_id",)) -> DataFrame:
    """Long form: one row per page and matched rule."""
    return unnest(pages, "mobile_signs", "r", keys).select(*keys, "r.*")
