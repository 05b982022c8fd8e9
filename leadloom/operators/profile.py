"""Company profile fields of a page (family B) and per-company intelligence (family I)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions.naming import clean_display_name
from leadloom.functions.text import (
    blank_to_null,
    contains_any,
    first_case,
    found,
    is_in,
    let,
    squash,
    strip,
    text_or_empty,
    title_case,
    words,
)
from leadloom.operators.keywords import KeywordRule, best_label, tag_patterns
from leadloom.operators.ordering import top_per_key
from leadloom.operators.pages import attr, element_text, elements, first_text, meta, object_body, tagged
from leadloom.operators.rows import unnest
from leadloom.rules import company as rules


def _clean(c: Column) -> Column:
    return blank_to_null(squash(c))


def _first_that(candidates: Sequence[Column], test) -> Column:
    return F.try_element_at(F.filter(F.array(*[_clean(c) for c in candidates]), lambda v: v.isNotNull() & test(v)), F.lit(1))


def company_name(title: Column) -> Column:
    """First usable of site name, social titles, page title and first heading, cut to its brand part."""
    candidates = [
        meta("property", "og:site_name"),
        meta("property", "og:title"),
        meta("name", "twitter:title"),
        title,
        first_text(tagged("h1")),
    ]
    named = F.transform(F.array(*[_clean(c) for c in candidates]), lambda c: blank_to_null(clean_display_name(c)))
    return F.try_element_at(F.array_compact(named), F.lit(1))


def tagline(description: Column, least: int = 8, most: int = 160) -> Column:
    """First description or lead paragraph of ``least`` to ``most`` characters."""
    h1 = F.try_element_at(tagged("h1"), F.lit(1))
    after = first_text(elements(lambda e: e["tag"].isin("p", "h2") & (e["pos"] > h1["pos"])))
    candidates = [
        meta("property", "og:description"),
        meta("name", "twitter:description"),
        description,
        meta("name", "description"),
        after,
    ]
    return _first_that(candidates, lambda v: F.length(v).between(least, most))


def primary_cta() -> Column:
    """First short anchor, else button, that asks for an action."""

    def ask(tag: str) -> Column:
        texts = F.transform(tagged(tag), lambda e: squash(element_text(e)))
        return F.try_element_at(F.filter(texts, lambda t: (F.length(t) <= 40) & t.rlike(rules.CTA_PATTERN)), F.lit(1))

    return F.coalesce(ask("a"), ask("button"))


def organization_fields() -> Column:
    """First value per field over the Organization-like JSON-LD objects of the page."""
    kinds = words(rules.ORGANIZATION_KINDS)
    bodies = F.transform(
        F.filter("json_ld", lambda o: o["top"] & F.arrays_overlap(o["kinds"], kinds)), lambda o: object_body(o)
    )

    def pick(objects: Column) -> Column:
        def first(value) -> Column:
            return F.try_element_at(F.array_compact(F.transform(objects, lambda b: blank_to_null(value(b)))), F.lit(1))

        def address(b: Column) -> Column:
            parts = [F.get_json_object(b, f"$.address.{p}") for p in ("addressLocality", "addressRegion", "addressCountry")]
            whole = F.get_json_object(b, "$.address")
            return squash(F.when(whole.startswith("{"), F.concat_ws(", ", *[blank_to_null(p) for p in parts])).otherwise(whole))

        return F.struct(
            first(lambda b: F.get_json_object(b, "$.name")).alias("name"),
            first(lambda b: F.get_json_object(b, "$.description")).alias("description"),
            first(lambda b: F.get_json_object(b, "$.foundingDate")).alias("founding_date"),
            first(address).alias("headquarters"),
        )

    return let(bodies, pick)


def founded_year(stated: Column, footer: Column, hero: Column) -> Column:
    from_stated = blank_to_null(F.regexp_extract(text_or_empty(stated), rules.YEAR_PATTERN, 1))
    blob = F.concat_ws("\n", text_or_empty(footer), text_or_empty(hero))
    from_text = blank_to_null(F.regexp_extract(blob, rules.FOUNDED_PATTERN, 1))
    return F.coalesce(from_stated, from_text).try_cast("int")


def headquarters(stated: Column, footer: Column) -> Column:
    from_footer = _clean(F.regexp_extract(text_or_empty(footer), rules.HEADQUARTERS_PATTERN, 1))
    return F.coalesce(_clean(stated), from_footer)


def profile_corpus(parts: Sequence[Column]) -> Column:
    """Lower-case text the rule sets are searched in; blank parts leave no gap."""
    return F.lower(F.array_join(F.filter(F.array(*[p.cast("string") for p in parts]), lambda p: p != ""), " "))


def classify_profile(
    df: DataFrame,
    corpus: str = "corpus",
    pricing_pages: Column | None = None,
    rule_sets: Mapping[str, Sequence[KeywordRule]] = rules.PROFILE_RULE_SETS,
) -> DataFrame:
    """Winning label per rule set, as ``<name>`` with its hits in ``<name>_hits``."""
    found_labels = df.withColumns({f"_{name}": best_label(F.col(corpus), rs) for name, rs in rule_sets.items()})
    out = {}
    for name in rule_sets:
        label = F.col(f"_{name}.label")
        if name == "product_type":
            label = F.coalesce(label, F.lit("SaaS"))
        if name == "pricing_model" and pricing_pages is not None:
            label = F.coalesce(label, F.when(F.size(pricing_pages) > 0, F.lit("Paid")))
        out[name] = label
        out[f"{name}_hits"] = F.col(f"_{name}.hits")
    return found_labels.withColumns(out).drop(*[f"_{name}" for name in rule_sets])


def profile_confidence(values: Sequence[Column], has_socials: Column) -> Column:
    """Share of filled fields, plus five points with social links, in whole percents."""
    filled = sum((v.isNotNull().cast("int") for v in values), F.lit(0))
    return F.least(F.lit(1.0), filled / len(values) + F.when(has_socials, 0.05).otherwise(0.0))


PROFILE_FIELDS = (
    "company_name", "tagline", "short_description", "business_category", "industry", "product_type",
    "target_audience", "pricing_model", "primary_cta", "headquarters", "founded_year",
)


def company_profiles(pages: DataFrame) -> DataFrame:
    """Profile columns per page profile row (hero, nav_text and footer_text must be present)."""
    rows = pages.withColumns({"_org": organization_fields(), "tagline": tagline(F.col("description"))})
    hero = F.col("hero")
    named = rows.withColumns(
        {
            "company_name": F.coalesce(company_name(F.col("title")), blank_to_null(strip(F.col("_org.name")))),
            "short_description": F.coalesce(
                "tagline", _clean(hero), blank_to_null(strip(F.col("_org.description")))
            ),
            "primary_cta": primary_cta(),
            "headquarters": headquarters(F.col("_org.headquarters"), F.col("footer_text")),
            "founded_year": founded_year(F.col("_org.founding_date"), F.col("footer_text"), hero),
            "corpus": profile_corpus(
                [
                    F.col("title"),
                    F.col("description"),
                    F.try_element_at("open_graph", F.lit("og:title")),
                    F.try_element_at("open_graph", F.lit("og:description")),
                    F.try_element_at("twitter", F.lit("twitter:title")),
                    F.try_element_at("twitter", F.lit("twitter:description")),
                    hero,
                    F.col("nav_text"),
                    F.col("footer_text"),
                    F.col("_org.name"),
                    F.col("_org.description"),
                    F.array_join("pricing_pages", " "),
                    F.array_join("documentation_pages", " "),
                ]
            ),
        }
    )
    labelled = classify_profile(named, "corpus", F.col("pricing_pages"))
    confidence = profile_confidence([F.col(f) for f in PROFILE_FIELDS], F.size(F.map_keys("social_links")) > 0)
    return labelled.withColumn("profile_confidence", F.bround(confidence, 2)).drop("_org")


# --- intelligence ----------------------------------------------------------------------------


def intel_hero() -> Column:
    """Texts of headings, hero and banner regions.

    Regions with blocks inside count while they are short; the blocks themselves are in the page text anyway.
    """
    headers = tagged("header")

    def texts(condition) -> Column:
        kept = elements(lambda e: condition(e) & (e["chars"] > 0) & ((e["chars"] < 300) | e["leaf"]))
        return F.transform(kept, lambda e: element_text(e))

    def classed(word: str):
        return lambda e: F.contains(text_or_empty(attr(e, "class")), F.lit(word))

    def below_header(boxes: Column) -> Column:
        inside = lambda e: F.exists(boxes, lambda h: (h["pos"] < e["pos"]) & (e["pos"] <= h["last"]))
        return texts(lambda e: (e["tag"] == "p") & inside(e))

    return F.array_join(
        F.concat(
            texts(lambda e: e["tag"] == "h1"), texts(lambda e: e["tag"] == "h2"), texts(classed("hero")),
            texts(classed("banner")), let(headers, below_header),
        ),
        " ",
    )


def intel_faq() -> Column:
    """Question sections and disclosure boxes: outermost ones, so nested boxes add their text once."""
    boxes = elements(
        lambda e: F.contains(text_or_empty(attr(e, "class")), F.lit("faq"))
        | F.contains(text_or_empty(attr(e, "id")), F.lit("faq"))
        | (e["tag"] == "details")
        | text_or_empty(attr(e, "class")).rlike(r"(^|\s)accordion(\s|$)")
        | ((e["tag"] == "section") & F.contains(F.lower(text_or_empty(attr(e, "aria-label"))), F.lit("faq")))
    )

    def outer(found: Column) -> Column:
        # boxes stand in page order, so the furthest end before a box tells whether it lies inside another
        ends = F.aggregate(
            found,
            F.struct(F.lit(-1).alias("end"), F.array().cast("array<struct<first_piece:int,pieces:int>>").alias("kept")),
            lambda a, e: F.struct(
                F.greatest(a["end"], e["last"]).alias("end"),
                F.when(e["pos"] <= a["end"], a["kept"])
                .otherwise(F.concat(a["kept"], F.array(F.struct(e["first_piece"].alias("first_piece"), e["pieces"].alias("pieces")))))
                .alias("kept"),
            ),
        )
        return ends["kept"]

    return F.array_join(F.filter(F.transform(outer(boxes), lambda e: element_text(e)), lambda t: t != ""), " ")


# Meta names and JSON-LD keys that feed the company text.
META_NAMES = ("description", "og:description", "og:title", "keywords", "og:type", "twitter:description")
STRUCTURED_KEYS = ("name", "description", "industry", "slogan", "category")


def meta_signals() -> Column:
    """Map of the listed meta tags; the last tag of a name wins."""
    named = F.transform(
        elements(lambda e: (e["tag"] == "meta") & (strip(text_or_empty(attr(e, "content"))) != "")),
        lambda e: F.struct(
            F.lower(F.coalesce(blank_to_null(attr(e, "name")), attr(e, "property"), F.lit(""))).alias("k"),
            strip(attr(e, "content")).alias("v"),
        ),
    )

    def entry(name: str) -> Column:
        return F.struct(
            F.lit(name).alias("k"), F.try_element_at(F.filter(named, lambda x: x["k"] == name), F.lit(-1))["v"].alias("v")
        )

    return F.map_from_entries(F.filter(F.array(*[entry(n) for n in META_NAMES]), lambda x: x["v"].isNotNull()))


def structured_fields() -> Column:
    """Map of the first non-blank value per key over all JSON-LD objects of the page."""

    def entry(key: str, *paths: str) -> Column:
        values = F.transform(
            F.col("json_ld"), lambda o: F.coalesce(*[blank_to_null(F.get_json_object(object_body(o), p)) for p in paths])
        )
        return F.struct(F.lit(key).alias("k"), F.try_element_at(F.array_compact(values), F.lit(1)).alias("v"))

    entries = [entry(k, f"$.{k}") for k in STRUCTURED_KEYS]
    entries.append(entry("organization", "$.organization.name", "$.publisher.name"))
    return F.map_from_entries(F.filter(F.array(*entries), lambda x: x["v"].isNotNull()))


def intel_pages(parsed: DataFrame) -> DataFrame:
    """Per page: hero, faq, meta, structured and the text piece it adds to the company text."""
    rows = parsed.withColumns(
        {"intel_hero": intel_hero(), "intel_faq": intel_faq(), "intel_meta": meta_signals(), "structured": structured_fields()}
    )
    pick = lambda column, key: F.try_element_at(column, F.lit(key))
    piece = F.concat_ws(
        " ",
        *[
            blank_to_null(strip(c))
            for c in (
                F.col("intel_hero"),
                F.col("intel_faq"),
                pick("intel_meta", "description"),
                pick("intel_meta", "og:description"),
                pick("intel_meta", "keywords"),
                pick("structured", "description"),
                pick("structured", "industry"),
                F.col("page_text"),
            )
        ],
    )
    return rows.withColumn("intel_text", piece)


def intel_corpus(
    pages: DataFrame, heads: DataFrame | None = None, tails: DataFrame | None = None, most_pages: int | None = None
) -> DataFrame:
    """Company text: head, the texts of its pages in order, tail; lower case.

    ``pages`` holds company_id, page_rank and intel_text; all pages count unless ``most_pages`` says otherwise.
    """
    kept = pages if most_pages is None else top_per_key(pages, ["company_id"], ["page_rank"], most_pages)
    texts = kept.groupBy("company_id").agg(
        F.array_sort(F.collect_list(F.struct("page_rank", F.col("intel_text").alias("t")))).alias("_texts"),
        F.count("*").alias("pages_scanned"),
    )
    out = texts
    parts = [F.array_join(F.filter(F.transform("_texts", lambda x: x["t"]), lambda t: t != ""), " ")]
    if heads is not None:
        out = out.join(heads.select("company_id", F.col("text").alias("_head")), "company_id", "left")
        parts.insert(0, F.col("_head"))
    if tails is not None:
        out = out.join(tails.select("company_id", F.col("text").alias("_tail")), "company_id", "left")
        parts.append(F.col("_tail"))
    corpus = F.lower(F.concat_ws(" ", *[blank_to_null(strip(p)) for p in parts]))
    return out.select("company_id", corpus.alias("corpus"), "pages_scanned")


def last_fields(pages: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """Per company the value of each map key on its last page that has it."""
    picked = {k: F.try_element_at(column, F.lit(k)) for k in keys}
    return pages.groupBy("company_id").agg(
        *[F.max_by(v, F.when(v.isNotNull(), F.col("page_rank"))).alias(k.replace(":", "_")) for k, v in picked.items()]
    )


def top_keywords(docs: DataFrame, key: str, text: str, limit: int = 20, stop: Sequence[str] = rules.STOP_WORDS) -> DataFrame:
    """Most frequent tokens per text: count descending, then token. Counted inside the row, no shuffle.

    The sorted tokens of a text stand in runs; a run's length is the distance to the next run's head.
    """
    tokens = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[a-z][a-z0-9\-]{2,}"), 0)

    def heads(t: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(t) - 1)
        first = F.filter(places, lambda i: (i == 0) | (F.get(t, i) != F.get(t, i - 1)))
        return F.when(F.size(t) > 0, F.struct(t.alias("t"), first.alias("first")))

    def counted(x: Column) -> Column:
        ends = F.concat(F.slice(x["first"], 2, F.size(x["t"])), F.array(F.size(x["t"])))
        runs = F.zip_with(x["first"], ends, lambda i, j: F.struct((i - j).cast("bigint").alias("less"), F.get(x["t"], i).alias("token")))
        return F.slice(F.sort_array(F.filter(runs, lambda r: ~is_in(r["token"], stop))), 1, limit)

    ranked = let(let(F.sort_array(tokens), heads), counted)
    rows = unnest(docs, ranked, "k", [key], "_pos")
    return rows.select(key, "k.token", (-F.col("k.less")).alias("n"), (F.col("_pos") + 1).alias("keyword_rank"))


def competitors(text: Column, known: Sequence[str] = rules.KNOWN_COMPETITORS, limit: int | None = None) -> Column:
    """Names after comparison phrases, then known names in the text; distinct."""

    def pick(t: Column) -> Column:
        raw = F.transform(
            F.regexp_extract_all(t, F.lit(rules.COMPETITOR_PATTERN), 1), lambda n: F.btrim(n, F.lit(" .,;:"))
        )
        named = F.filter(raw, lambda n: ~F.lower(n).isin(*rules.COMPETITOR_SKIP) & (F.length(n) > 2))
        cased = F.transform(named, lambda n: F.when(n == F.lower(n), title_case(n)).otherwise(n))
        lowered = F.lower(t)
        known_hits = F.filter(words(known), lambda k: F.contains(lowered, F.lower(k)))
        names = F.array_distinct(F.concat(cased, known_hits))
        return names if limit is None else F.slice(names, 1, limit)

    return let(text, pick)


def intel_opportunities(corpus: Column, flutter_jobs: Column, engineering_jobs: Column) -> Column:
    hiring = F.array_compact(
        F.array(
            F.when(flutter_jobs > 0, F.lit(rules.FLUTTER_OPPORTUNITY)),
            F.when(engineering_jobs > 0, F.lit(rules.HIRING_OPPORTUNITY)),
        )
    )
    return F.array_distinct(F.concat(tag_patterns(corpus, rules.OPPORTUNITIES), hiring))


def team_size(corpus: Column, jobs: Column, engineering_jobs: Column, ladder=rules.TEAM_SIZES) -> Column:
    cases = []
    for pattern, label, min_jobs, min_engineering in ladder:
        test = corpus.rlike(pattern)
        if min_jobs:
            test = test | (jobs >= min_jobs)
        if min_engineering:
            test = test | (engineering_jobs >= min_engineering)
        cases.append((test, label))
    return first_case([*cases, (jobs > 0, "10-50")])


def maturity(stage: Column, funding: Column) -> Column:
    s, f = text_or_empty(stage), text_or_empty(funding)
    return first_case(
        [
            (s.isin("Scale-up", "Enterprise") | f.isin("Series C+", "Acquired"), "Mature"),
            ((s == "Growth") | f.isin("Series A", "Series B"), "Growing"),
            (s.isin("MVP", "Early Startup") | f.isin("Seed", "Bootstrapped"), "Early"),
            (s == "Idea", "Nascent"),
        ]
    )


def main_product(structured_name: Column, h1: Column, title: Column) -> Column:
    head = strip(F.regexp_extract(title, r"^([^|\-]*)", 1))
    return F.coalesce(
        blank_to_null(strip(structured_name)),
        blank_to_null(strip(h1)),
        head,
    )


def intel_industry(model: Column, first_keyword: Column, corpus: Column) -> Column:
    from leadloom.functions.text import lookup

    return F.coalesce(
        lookup(model, rules.MODEL_INDUSTRIES),
        first_case(
            [
                (contains_any(corpus, ("fintech", "payments")), "FinTech"),
                (F.contains(corpus, F.lit("health")), "Healthcare"),
                (contains_any(corpus, ("education", "learning")), "EdTech"),
            ]
        ),
        title_case(first_keyword),
    )


def intel_subcategory(corpus: Column, model: Column) -> Column:
    first = F.try_element_at(found(corpus, [token for token, _ in rules.SUBCATEGORIES]), F.lit(1))
    from leadloom.functions.text import lookup

    return F.coalesce(lookup(first, dict(rules.SUBCATEGORIES)), model)


def company_labels(df: DataFrame, corpus: str = "corpus", rule_sets: Mapping[str, Sequence[KeywordRule]] = rules.INTEL_RULE_SETS) -> DataFrame:
    """Winning label per intelligence rule set."""
    labelled = df.withColumns({f"_{n}": best_label(F.col(corpus), rs) for n, rs in rule_sets.items()})
    return labelled.withColumns({n: F.col(f"_{n}.label") for n in rule_sets}).drop(*[f"_{n}" for n in rule_sets])


def label_overrides(df: DataFrame, corpus: str = "corpus") -> DataFrame:
    """Developer override, pricing and stage defaults, industry and subcategory ladders.

    Needs model, customer, pricing, stage, first_keyword, has_pricing_page and jobs_found.
    """
    text = F.col(corpus)
    developer = contains_any(text, ("for developers", "devtools", "developer tools"))
    model = F.when(developer & F.coalesce(F.col("model") == "SaaS", F.lit(True)), F.lit("Developer Tool")).otherwise(
        F.col("model")
    )
    stage = F.coalesce(
        F.col("stage"), F.when(F.col("jobs_found") >= 5, "Growth").when(F.col("jobs_found") >= 1, "Early Startup")
    )
    pricing = F.coalesce(F.col("pricing"), F.when(F.col("has_pricing_page"), F.lit("Paid")), F.lit("Unknown"))
    staged = df.withColumns({"model": model, "stage": stage, "pricing": pricing})
    return staged.withColumns(
        {
            "industry": intel_industry(F.col("model"), F.col("first_keyword"), text),
            "subcategory": intel_subcategory(text, F.col("model")),
        }
    )


def intel_flags(model: Column, customer: Column) -> dict[str, Column]:
    """Null-safe flags out of business model and target customer."""
    m, c = text_or_empty(model), text_or_empty(customer)
    business = c.isin(*rules.BUSINESS_CUSTOMERS)
    return {
        "is_b2b_saas": (m == "SaaS") & business,
        "is_enterprise_software": (m == "Enterprise Software")
        | ((c == "Enterprise") & m.isin("SaaS", "Enterprise Software", "")),
        "is_developer_tools": (m == "Developer Tool") | (c == "Developers"),
        "is_consumer_only": ((m == "Consumer App") | (c == "B2C"))
        & ~business
        & ~m.isin("SaaS", "Developer Tool", "Enterprise Software", "FinTech", "Healthcare"),
        "has_clear_icp": (m != "") & (c != ""),
    }


def intel_confidence(
    model: Column, customer: Column, pricing: Column, industry: Column, has_pricing_page: Column,
    pages_scanned: Column, has_structured: Column, jobs: Column,
) -> Column:
    """Whole percents, at most 100."""
    on = lambda test, points: F.when(F.coalesce(test, F.lit(False)), points).otherwise(0)
    return F.least(
        F.lit(100),
        F.lit(15)
        + on(model.isNotNull(), 20)
        + on(customer.isNotNull(), 15)
        + on(industry.isNotNull(), 10)
        + on(pricing.isNotNull() & (pricing != "Unknown"), 10)
        + on(has_pricing_page, 10)
        + on(pages_scanned > 1, 10)
        + on(has_structured, 5)
        + on(jobs > 0, 5),
    )
