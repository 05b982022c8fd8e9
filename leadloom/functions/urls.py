"""URL cleaning and classification (native columns, no UDF)."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions.text import any_of, host_matches, let, ordered_distinct_by, strip, text_or_empty
from leadloom.rules import web


@dataclass(frozen=True)
class UrlRules:
    """Site lists behind the URL tests; defaults are the production lists."""

    launch_host: str = web.LAUNCH_HOST
    redirect_prefix: str = web.REDIRECT_PREFIX
    cdn_hosts: tuple[str, ...] = web.CDN_HOSTS
    cdn_suffixes: tuple[str, ...] = web.CDN_SUFFIXES
    cdn_path: str = web.CDN_PATH
    blog_prefixes: tuple[str, ...] = web.BLOG_PREFIXES
    blocked_external: tuple[str, ...] = web.BLOCKED_EXTERNAL_HOSTS
    intermediate: tuple[str, ...] = web.INTERMEDIATE_HOSTS
    blocked_discovery: tuple[str, ...] = web.BLOCKED_DISCOVERY_HOSTS


DEFAULT_RULES = UrlRules()


# Optional scheme and one leading ``www.`` in front of the host. Every test below is a single
# regular expression over the address, so the address expression is evaluated once per test
# even where the optimizer pushes the test into a scan filter.
_HEAD = r"^\s*(?:https?://)?+(?i:www\.)?+"
_HOST_END = r"(?:[/?#]|\s*$)"


def _one_of(hosts: Sequence[str]) -> str:
    return "(?:" + "|".join(re.escape(h) for h in hosts) + ")"


def _under(hosts: Sequence[str]) -> str:
    return r"(?i:(?:[^/?#]*\.)?" + _one_of(hosts) + ")" + _HOST_END


def with_scheme(c: Column) -> Column:
    return F.regexp_replace(strip(text_or_empty(c)), "^(?!https?://)(?=.)", "https://")


def netloc(c: Column) -> Column:
    """Authority part as written (port and user info kept), lower case."""
    return F.lower(F.regexp_extract(c, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1))


def path_of(c: Column) -> Column:
    raw = F.regexp_extract(c, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    return F.regexp_replace(raw, r";[^/]*$", "")


def site_path(c: Column) -> Column:
    """Path of an address that may lack its scheme."""
    raw = F.regexp_extract(strip(text_or_empty(c)), r"^(?:https?://)?+[^/?#]*([^?#]*)", 1)
    return F.regexp_replace(raw, r";[^/]*$", "")


def hostname(c: Column) -> Column:
    """Host without user info and port."""
    return F.lower(F.regexp_extract(c, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#]*@)?([^/?#:]*)", 1))


def host_of(c: Column) -> Column:
    return F.lower(F.regexp_extract(strip(text_or_empty(c)), r"^(?:https?://)?+(?i:www\.)?+([^/?#]*)", 1))


def normalize_website(c: Column) -> Column:
    return F.rtrim(host_of(c), F.lit("/"))


def _test(c: Column, pattern: str) -> Column:
    return text_or_empty(c).rlike(pattern)


def is_launch_host(c: Column, rules: UrlRules = DEFAULT_RULES) -> Column:
    return _test(c, _HEAD + _under((rules.launch_host,)))


def is_launch_redirect(c: Column, rules: UrlRules = DEFAULT_RULES) -> Column:
    host = r"(?i:(?:[^/?#]*\.)?" + re.escape(rules.launch_host) + ")"
    return _test(c, _HEAD + host + "(?=/)" + re.escape(rules.redirect_prefix))


def _cdn(rules: UrlRules) -> str:
    hosts = r"(?i:" + _one_of(rules.cdn_hosts) + ")" + _HOST_END
    suffixes = r"(?i:[^/?#]*" + _one_of(rules.cdn_suffixes) + ")" + _HOST_END
    path = r"[^/?#]+[^?#]*(?i:" + re.escape(rules.cdn_path) + ")"
    slash_after_host = r"[^/?#]+(?i:" + re.escape(rules.cdn_path) + ")"
    return f"(?:{hosts}|{suffixes}|{path}|{slash_after_host})"


def is_cdn_host(c: Column, rules: UrlRules = DEFAULT_RULES) -> Column:
    return _test(c, _HEAD + _cdn(rules))


def is_blog_host(c: Column, rules: UrlRules = DEFAULT_RULES) -> Column:
    return _test(c, _HEAD + "(?i:" + _one_of(rules.blog_prefixes) + ")")


def is_usable_website(c: Column, rules: UrlRules = DEFAULT_RULES) -> Column:
    """Has a host and is no launch site, delivery network or blog host."""
    refuse = f"(?!{_under((rules.launch_host,))})(?!{_cdn(rules)})(?!(?i:{_one_of(rules.blog_prefixes)}))"
    return _test(c, _HEAD + refuse + r"[^/?#\s]")


def website_identity(c: Column, rules: UrlRules = DEFAULT_RULES) -> Column:
    path = F.lower(F.rtrim(site_path(c), F.lit("/")))
    return F.when(is_launch_redirect(c, rules), F.concat(F.lit(rules.launch_host), path)).otherwise(normalize_website(c))


def canonical_website(c: Column, rules: UrlRules = DEFAULT_RULES) -> Column:
    path = F.rtrim(site_path(c), F.lit("/"))
    full = F.concat(F.lit(f"https://www.{rules.launch_host}"), path)
    return F.when(is_launch_redirect(c, rules), full).otherwise(normalize_website(c))


def strip_tracking(c: Column, rules: UrlRules = DEFAULT_RULES) -> Column:
    """Drop ``utm_*`` and ``ref=`` query parts and the fragment; launch URLs lose the whole query."""

    def clean(u: Column) -> Column:
        head = F.regexp_replace(F.regexp_extract(u, r"^([^?#]*)", 1), r";[^/]*$", "")
        query = F.when(is_launch_host(u, rules), "").otherwise(F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1))
        kept = F.filter(F.split(query, "&"), lambda p: ~F.lower(p).rlike("^(utm_|ref=|$)"))
        return F.concat_ws("?", head, F.nullif(F.array_join(kept, "&"), F.lit("")))

    return let(strip(text_or_empty(c)), clean)


def is_external_company_url(c: Column, rules: UrlRules = DEFAULT_RULES) -> Column:
    """Web address that is no launch site, intermediate host or listed social and store host."""
    relay = r"(?i:" + _one_of(rules.intermediate) + ")" + _HOST_END
    relay_under = r"(?i:[^/?#]*(?:\.cloudflare\.com|\.cloudflareinsights\.com))" + _HOST_END
    relay_path = r"[^/?#]*[^?#]*(?i:" + re.escape(rules.cdn_path) + ")"
    blocked = r"(?i:" + _one_of(rules.blocked_external) + ")" + _HOST_END
    refuse = "".join(f"(?!{p})" for p in (_under((rules.launch_host,)), relay, relay_under, relay_path, blocked))
    return _test(c, r"^\s*https?://(?i:www\.)?+" + refuse + r"[^/?#\s]")


def urls_in(c: Column) -> Column:
    """All web addresses in a text, closing punctuation trimmed, first spelling of each kept."""
    raw = F.regexp_extract_all(text_or_empty(c), F.lit(web.URL_PATTERN), 0)
    return ordered_distinct_by(F.transform(raw, lambda u: F.rtrim(u, F.lit(".,);]"))), lambda u: F.lower(u))


def _company_link(rules: UrlRules) -> str:
    listed = r"(?i:(?:[^/?#:]*\.)?" + _one_of(rules.blocked_discovery) + r")(?::\d*)?(?:[/?#]|$)"
    return r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#]*@)?+(?!" + listed + r")[^/?#:]"


def is_blocked_discovery_host(c: Column, rules: UrlRules = DEFAULT_RULES) -> Column:
    """No host at all, or a forge, forum or social host."""
    return ~_test(c, _company_link(rules))


def pick_company_website(
    candidates: Sequence[Column], fallback_text: Column, rules: UrlRules = DEFAULT_RULES
) -> Column:
    """First company link among the explicit candidates, then among the links in the text."""
    explicit = F.array(*[F.nullif(strip(c), F.lit("")) for c in candidates])
    ordered = F.concat(F.array_compact(explicit), urls_in(fallback_text))
    return F.try_element_at(F.filter(ordered, lambda u: u.rlike(_company_link(rules))), F.lit(1))


def _fold_dot_segments(u: Column) -> Column:
    origin = F.regexp_extract(u, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)", 1)
    rest = F.regexp_extract(u, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    tail = F.regexp_extract(u, r"^[^?#]*(.*)$", 1)
    ends_in_dot = rest.rlike(r"/\.{1,2}$")
    folded = F.aggregate(
        F.split(F.ltrim(rest, F.lit("/")), "/"),
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(s))),
    )
    path = F.concat(F.lit("/"), F.array_join(folded, "/"), F.when(ends_in_dot, "/").otherwise(""))
    return F.concat(origin, F.regexp_replace(path, "//$", "/"), tail)


_SCHEME = r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"


def _join(h: Column, base: Column) -> Column:
    origin = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)", 1)
    no_query = F.regexp_extract(base, r"^([^?#]*)", 1)
    folder = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)(/(?:[^?#]*/)?)?", 0)
    relative = F.concat(folder, F.when(F.endswith(folder, F.lit("/")), "").otherwise("/"), h)
    return (
        F.when(h.rlike(_SCHEME), h)
        .when(h == "", base)
        .when(F.startswith(h, F.lit("//")), F.concat(F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.\-]*:)", 1), h))
        .when(F.startswith(h, F.lit("/")), F.concat(origin, h))
        .when(F.startswith(h, F.lit("?")), F.concat(no_query, h))
        .when(F.startswith(h, F.lit("#")), F.concat(F.regexp_extract(base, r"^([^#]*)", 1), h))
        .otherwise(relative)
    )


def _fold_if_dotted(u: Column) -> Column:
    return F.when(u.rlike(r"^https?://[^?#]*/\.{1,2}(/|[?#]|$)"), _fold_dot_segments(u)).otherwise(u)


def resolve_url(href: Column, base: Column) -> Column:
    """Resolve a link against its page; dot segments are folded only where they occur."""
    return let(let(strip(href), lambda h: _join(h, base)), _fold_if_dotted)


def absolute_url(href: Column, base: Column) -> Column:
    """Resolved link; null for blank links, fragments, mail, phone and script links."""
    wanted = F.regexp_extract(strip(href), r"^((?!#|mailto:|tel:|javascript:).+)$", 1)
    return F.when(wanted != "", resolve_url(wanted, base))


def normalize_job_url(href: Column, base: Column) -> Column:
    h = strip(href)
    origin = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]+)", 1)
    return F.rtrim(
        F.when(h.rlike("^https?://"), F.regexp_extract(h, r"^([^#]*)", 1))
        .when(base.isNull(), h)
        .when(F.startswith(h, F.lit("/")), F.concat(origin, h))
        .otherwise(F.concat(origin, F.lit("/"), h)),
        F.lit("/"),
    )


def is_platform_host(c: Column, platforms: Sequence[str]) -> Column:
    return host_matches(host_of(c), platforms)


def website_has_suffix(c: Column, suffixes: Sequence[str] = web.INDIAN_SUFFIXES) -> Column:
    host = hostname(text_or_empty(c))
    return (host != "") & any_of([F.endswith(host, F.lit(s)) for s in suffixes])


def enrich_urls(df: DataFrame, url_col: str = "url", rules: UrlRules = DEFAULT_RULES) -> DataFrame:
    """The URL job: every derived URL column, computed once per lead or link row."""
    c = F.col(url_col)
    return df.withColumns(
        {
            "host": host_of(c),
            "website": normalize_website(c),
            "identity": website_identity(c, rules),
            "canonical_website": canonical_website(c, rules),
            "clean_url": strip_tracking(c, rules),
            "is_launch_host": is_launch_host(c, rules),
            "is_launch_redirect": is_launch_redirect(c, rules),
            "is_cdn_host": is_cdn_host(c, rules),
            "is_blog_host": is_blog_host(c, rules),
            "is_usable": is_usable_website(c, rules),
            "is_external": is_external_company_url(c, rules),
        }
    )
