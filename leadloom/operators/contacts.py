"""Contacts and founders per company (families C, F). Confidences are whole percents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions import groups as group_stage
from leadloom.functions.people import (
    emails_from_text,
    is_decision_role,
    is_fake_name,
    is_founder_role,
    is_valid_email,
    normalize_email,
    normalize_person_name,
    normalize_role,
    rank_contact,
    role_in_text,
    role_near,
)
from leadloom.functions.text import blank_to_null, contains_any, is_in, let, squash, strip, text_or_empty, title_case
from leadloom.functions.urls import netloc, resolve_url
from leadloom.operators.ordering import first_per_key, first_value, top_per_key
from leadloom.operators.pages import attr, element_text, elements, text_blocks
from leadloom.operators.rows import unnest
from leadloom.rules import people as rules
from leadloom.session import cut_lineage

cloudpickle.register_pickle_by_value(group_stage)

CONTACT_FIELDS = ("full_name", "email", "role", "linkedin", "github", "twitter", "source_page", "discovery_source")


# --- social profiles -------------------------------------------------------------------------

def github_profiles(text: Column) -> Column:
    """User pages only: repositories and site pages are skipped."""
    hits = F.transform(
        F.regexp_extract_all(text, F.lit(rules.GITHUB_USER), 0), lambda u: F.rtrim(u, F.lit("/"))
    )
    user = lambda u: F.lower(F.regexp_extract(u, r"(?i)github\.com/([^/]*)$", 1))
    return F.array_sort(
        F.array_distinct(F.filter(hits, lambda u: ~is_in(user(u), rules.GITHUB_PAGES) & (user(u) != "")))
    )


def social_profiles(text: Column, links: Column | None = None) -> Column:
    """struct of sorted distinct linkedin people, linkedin companies, twitter and github profiles."""
    blob = text_or_empty(text) if links is None else F.concat_ws("\n", text_or_empty(text), F.array_join(links, "\n"))

    def pick(t: Column) -> Column:
        every = lambda pattern: F.array_sort(F.array_distinct(F.regexp_extract_all(t, F.lit(pattern), 0)))
        tweets = F.filter(every(rules.TWITTER), lambda u: ~F.lower(u).rlike("/intent/|/share|/home"))
        return F.struct(
            every(rules.PERSON_LINKEDIN).alias("linkedin_people"),
            every(rules.COMPANY_LINKEDIN).alias("linkedin_companies"),
            tweets.alias("twitter"),
            github_profiles(t).alias("github"),
        )

    return let(blob, pick)


# --- candidates ------------------------------------------------------------------------------

def _person(kind: int, source: str, **fields: Column) -> Column:
    out = [F.lit(kind).alias("kind"), fields.get("pos", F.lit(0)).cast("int").alias("pos")]
    for name in ("full_name", "email", "role", "linkedin", "github", "twitter"):
        out.append(fields.get(name, F.lit(None)).cast("string").alias(name))
    out.append(F.lit(source).alias("discovery_source"))
    return F.struct(*out)


def _best_email(emails: Column, full_name: Column) -> Column:
    """Only one: that; else a person mailbox, one that starts like the name first."""

    def pick(x: Column) -> Column:
        personal = F.filter(x["e"], lambda e: ~is_in(F.regexp_extract(e, "^([^@]*)", 1), rules.SHARED_MAILBOXES))
        pool = F.when(F.size(personal) > 0, personal).otherwise(x["e"])
        first = F.lower(F.regexp_extract(x["n"], r"^(\S+)", 1))
        prefix = F.substr(first, F.lit(1), F.greatest(F.lit(3), F.least(F.length(first), F.lit(4))))
        alike = F.filter(pool, lambda e: x["n"].isNotNull() & F.startswith(e, prefix))
        return F.when(F.size(x["e"]) == 1, F.get(x["e"], F.lit(0))).otherwise(
            F.coalesce(F.get(alike, F.lit(0)), F.get(pool, F.lit(0)))
        )

    return let(F.struct(emails.alias("e"), full_name.alias("n")), pick)


def person_in_text(text: Column) -> Column:
    """One contact candidate of a text block: struct, or null when the block names nobody."""

    def read(t: Column) -> Column:
        names = F.filter(F.regexp_extract_all(t, F.lit(rules.PERSON_NAME), 1), lambda n: ~is_fake_name(n))
        return let(
            F.struct(
                t.alias("t"),
                names.alias("names"),
                emails_from_text(t).alias("emails"),
                F.regexp_extract_all(t, F.lit(rules.PERSON_LINKEDIN), 0).alias("linkedin"),
            ),
            decide,
        )

    def decide(x: Column) -> Column:
        near = F.filter(
            F.transform(x["names"], lambda n: F.struct(n.alias("n"), role_near(x["t"], n).alias("r"))),
            lambda p: p["r"].isNotNull(),
        )
        reachable = (F.size(x["emails"]) > 0) | (F.size(x["linkedin"]) > 0)
        return let(F.struct(x.alias("x"), F.get(near, F.lit(0)).alias("near"), reachable.alias("reachable")), build)

    def build(y: Column) -> Column:
        x = y["x"]
        role = F.coalesce(y["near"]["r"], F.when(y["reachable"], role_in_text(x["t"])))
        name = F.coalesce(y["near"]["n"], F.get(x["names"], F.lit(0)))
        return F.when(
            role.isNotNull() | y["reachable"],
            F.struct(
                name.alias("full_name"),
                _best_email(x["emails"], name).alias("email"),
                role.alias("role"),
                F.get(x["linkedin"], F.lit(0)).alias("linkedin"),
                F.get(github_profiles(x["t"]), F.lit(0)).alias("github"),
                F.get(F.regexp_extract_all(x["t"], F.lit(rules.TWITTER), 0), F.lit(0)).alias("twitter"),
            ),
        )

    return let(text, read)


def people_from_blocks() -> Column:
    """Candidates out of the short text blocks of a parsed page."""
    people = F.transform(
        text_blocks("people"), lambda e: F.struct(e["pos"].alias("pos"), person_in_text(e["text"]).alias("p"))
    )
    return F.transform(
        F.filter(people, lambda x: x["p"].isNotNull()),
        lambda x: _person(0, "html", pos=x["pos"], **{f: x["p"][f] for f in ("full_name", "email", "role", "linkedin", "github", "twitter")}),
    )


def people_from_json_ld() -> Column:
    """One candidate per ld+json script that speaks of a person or employee."""
    scripts = F.filter("json_ld_scripts", lambda s: F.lower(s).rlike('"person"|"employee"'))

    def read(s: Column) -> Column:
        names = F.filter(F.regexp_extract_all(s, F.lit(rules.PERSON_NAME), 1), lambda n: ~is_fake_name(n))
        return F.struct(
            F.get(names, F.lit(0)).alias("full_name"),
            F.get(emails_from_text(s), F.lit(0)).alias("email"),
            role_in_text(s).alias("role"),
            F.get(F.regexp_extract_all(s, F.lit(rules.PERSON_LINKEDIN), 0), F.lit(0)).alias("linkedin"),
            F.get(github_profiles(s), F.lit(0)).alias("github"),
        )

    kept = F.filter(
        F.transform(scripts, lambda s: read(s)), lambda p: p["full_name"].isNotNull() | p["email"].isNotNull()
    )
    return F.transform(
        kept, lambda p, i: _person(1, "json_ld", pos=i, **{f: p[f] for f in ("full_name", "email", "role", "linkedin", "github")})
    )


def people_from_emails(emails: Column) -> Column:
    """Every valid address is a candidate; the mailbox name may tell the role."""
    local = lambda e: F.regexp_extract(e, "^([^@]*)", 1)
    return F.transform(
        F.filter(emails, lambda e: is_valid_email(e)),
        lambda e, i: _person(2, "email", pos=i, email=e, role=F.when(is_in(local(e), rules.ROLE_MAILBOXES), local(e))),
    )


def people_from_socials(profiles: Column) -> Column:
    return F.concat(
        F.transform(profiles["linkedin_people"], lambda u, i: _person(3, "social", pos=i, linkedin=u)),
        F.transform(profiles["github"], lambda u, i: _person(4, "social", pos=i, github=u)),
        F.transform(profiles["twitter"], lambda u, i: _person(5, "social", pos=i, twitter=u)),
    )


def contact_candidates(parsed: DataFrame, keys: Sequence[str] = ("company_id",), base_col: str = "url") -> DataFrame:
    """All candidates of every page in reading order; the page is read once for all four kinds.

    The order column ``pos`` joins page rank, kind and place on the page.
    """
    mails = F.array_distinct(F.concat(emails_from_text(F.col("page_text")), _mailto()))
    hrefs = F.transform(
        elements(lambda e: (e["tag"] == "a") & attr(e, "href").isNotNull()), lambda e: attr(e, "href")
    )
    people = F.concat(
        people_from_blocks(),
        people_from_json_ld(),
        people_from_emails(mails),
        people_from_socials(social_profiles(F.col("page_text"), hrefs)),
    )
    rank = F.col("page_rank") if "page_rank" in parsed.columns else F.lit(0)
    rows = unnest(parsed, people, "p", [*keys, F.col(base_col).alias("source_page"), rank.alias("_rank")])
    pos = F.col("_rank").cast("bigint") * F.lit(10**12) + F.col("p.kind") * F.lit(10**10) + F.col("p.pos")
    return normalize_candidates(
        rows.select(*keys, pos.alias("pos"), "source_page", *[f"p.{f}" for f in ("full_name", "email", "role", "linkedin", "github", "twitter", "discovery_source")])
    )


def _mailto() -> Column:
    hrefs = elements(lambda e: (e["tag"] == "a") & F.startswith(text_or_empty(attr(e, "href")), F.lit("mailto:")))
    found = F.transform(
        hrefs, lambda e: normalize_email(F.regexp_extract(attr(e, "href"), r"^mailto:([^?]*)", 1))
    )
    return F.filter(found, lambda e: is_valid_email(e))


def with_optional(df: DataFrame, names: Sequence[str]) -> DataFrame:
    missing = {n: F.lit(None).cast("string") for n in names if n not in df.columns}
    return df.withColumns(missing) if missing else df


def normalize_candidates(rows: DataFrame) -> DataFrame:
    """Junk names and bad addresses removed, roles normalized; rows without any identity dropped."""
    full = with_optional(rows, CONTACT_FIELDS)
    named = full.filter(~is_fake_name(F.col("full_name")))
    cleaned = named.withColumns(
        {
            "email": F.when(is_valid_email(F.col("email")), F.col("email")),
            "role": normalize_role(F.col("role")),
        }
    )
    return cleaned.filter(F.coalesce("full_name", "email", "linkedin", "github", "twitter").isNotNull())


# --- merge -----------------------------------------------------------------------------------

def identity_keys(df: DataFrame) -> Column:
    handle = lambda c: F.rtrim(F.lower(c), F.lit("/"))
    return F.array_compact(
        F.array(
            F.concat(F.lit("email:"), normalize_email(F.col("email"))),
            F.concat(F.lit("linkedin:"), handle(F.col("linkedin"))),
            F.concat(F.lit("github:"), handle(F.col("github"))),
            F.concat(F.lit("name-role:"), F.lower("full_name"), F.lit(":"), F.lower("role")),
        )
    )


#: Edges of a company that one task connects alone.
EDGES = 1_000_000


def _star_step(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step: every member moves to the smallest neighbour of its neighbours."""
    both = edges.union(edges.select("company_id", "v", "u"))
    low = cut_lineage(both.groupBy("company_id", "u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    large = both.filter("v > u").join(low, ["company_id", "u"]).select("company_id", F.col("v").alias("u"), F.col("m").alias("v"))
    large = cut_lineage(large.filter("u <> v").distinct())
    least = cut_lineage(large.groupBy("company_id", "u").agg(F.min("v").alias("m")))
    moved = F.expr("explode(array(struct(u as u, m as v), struct(v as u, m as v)))")
    small = large.join(least, ["company_id", "u"]).select("company_id", moved.alias("e"))
    return cut_lineage(small.select("company_id", "e.u", "e.v").filter("u <> v").distinct())


def _stars(edges: DataFrame, most: int) -> DataFrame:
    """company_id, u, v: every member of a group but the smallest, with the smallest.

    A company's edges are connected in one task if they are ``most`` or fewer, so most companies are done at once; larger
    ones are dealt out in parts that are connected alone, and star steps follow until nothing changes.
    """
    kinds = edges.schema
    ddl = f"company_id {kinds['company_id'].dataType.simpleString()}, u {kinds['u'].dataType.simpleString()}, v {kinds['u'].dataType.simpleString()}"

    def contracted(rows: DataFrame, part: Column) -> DataFrame:
        dealt = rows.select("company_id", part.alias("part"), "u", "v").repartition("company_id", "part").sortWithinPartitions("company_id", "part")
        return cut_lineage(dealt.mapInArrow(group_stage.contract_edges, ddl))

    sizes = edges.groupBy("company_id").agg(F.count("*").alias("_n")).filter(F.col("_n") > most)
    large = cut_lineage(sizes.select("company_id", F.ceil(F.col("_n") / most).alias("_parts")))
    if large.isEmpty():
        return contracted(edges, F.lit(0).cast("long"))
    done = contracted(edges.join(large, "company_id", "left_anti"), F.lit(0).cast("long"))
    rest = contracted(edges.join(large, "company_id"), F.pmod(F.xxhash64("u"), F.col("_parts")))
    state = F.struct(F.count("*").alias("n"), F.sum(F.xxhash64("company_id", "u", "v").cast("decimal(38,0)")).alias("h"))
    before = None
    while (now := rest.agg(state.alias("s")).first()["s"]) != before:
        before, rest = now, _star_step(rest)
    return done.unionByName(rest)


def connected_groups(pairs: DataFrame, most: int = EDGES) -> DataFrame:
    """Smallest member per connected group. Input: company_id, pos, key; output: company_id, pos, group_pos.

    Union-find runs inside each task before the first exchange, so rows that share keys in one task travel as one; keys
    that occur in several tasks then link those tasks' groups, and the links are contracted by company. Only companies
    with more than ``most`` links left need star steps over exchanges.
    """
    schema = pairs.schema
    kind = {c: schema[c].dataType.simpleString() for c in ("company_id", "pos")}
    local = cut_lineage(
        pairs.select("company_id", "pos", F.col("key").cast("string").alias("key")).mapInArrow(
            group_stage.contract_keys, f"company_id {kind['company_id']}, pos {kind['pos']}, root {kind['pos']}, key string"
        )
    )
    members = local.filter("key is null").groupBy("company_id", "pos").agg(F.collect_set("root").alias("_roots"))
    members = cut_lineage(members.withColumn("root", F.array_min("_roots")))
    keys = local.filter("key is not null").select("company_id", "root", "key")
    low = keys.groupBy("company_id", "key").agg(F.min("root").alias("v"), F.max("root").alias("_top")).filter("v <> _top")
    low = cut_lineage(low.drop("_top"))  # read back: both sides of the join are dealt out, a hot key can be split
    by_key = keys.join(low, ["company_id", "key"]).select("company_id", F.col("root").alias("u"), "v")
    by_row = members.filter("size(_roots) > 1").select("company_id", F.explode("_roots").alias("u"), F.col("root").alias("v"))
    edges = by_key.unionByName(by_row).filter("u <> v").distinct()
    stars = _stars(cut_lineage(edges), most)
    joined = members.join(stars.withColumnRenamed("u", "root"), ["company_id", "root"], "left")
    return joined.select("company_id", "pos", F.coalesce("v", "root").alias("group_pos"))


def merge_contacts(candidates: DataFrame) -> DataFrame:
    """Fold candidates of a company that share an address, a profile or name and role.

    Per field the first non-null value in ``pos`` order; then ranked anew. One row per group with
    group_pos, the fields, contact_score, contact_priority and n_merged.
    """
    rows = normalize_candidates(candidates)
    pairs = unnest(rows, identity_keys(rows), "key", ["company_id", "pos"])
    groups = connected_groups(pairs)
    # Rows without any key (a bare name) group by that name.
    labelled = rows.join(groups, ["company_id", "pos"], "left")
    bare = F.when(F.col("group_pos").isNull(), F.lower("full_name"))
    keyed = labelled.withColumn("_bare", F.coalesce(bare, F.lit("")))
    merged = keyed.groupBy("company_id", "group_pos", "_bare").agg(
        F.min("pos").alias("first_pos"),
        F.count("*").alias("n_merged"),
        *[first_value(F.col(f), F.col("pos")).alias(f) for f in CONTACT_FIELDS],
    )
    return ranked_contacts(merged.drop("_bare", "group_pos"))


def ranked_contacts(contacts: DataFrame) -> DataFrame:
    """Adds contact_score, contact_priority and percent (equal to the score)."""
    c = F.col
    rank = rank_contact(c("email"), c("role"), c("linkedin"), c("github"), c("full_name"))
    return contacts.withColumn("_r", rank).withColumns(
        {"contact_score": c("_r.score"), "contact_priority": c("_r.priority"), "percent": c("_r.score")}
    ).drop("_r")


def contact_order() -> list[Column]:
    """Best score, then priority, then reading order."""
    return [F.desc("contact_score"), F.asc("contact_priority"), F.asc("first_pos")]


def split_contacts(contacts: DataFrame) -> DataFrame:
    """Adds contact_class: decision, generic or other."""
    c = F.col
    local = F.lower(F.regexp_extract(text_or_empty(c("email")), "^([^@]*)", 1))
    decision = is_decision_role(c("role")) | (c("email").isNotNull() & is_in(local, rules.DECISION_MAILBOXES))
    role = F.lower(text_or_empty(c("role")))
    real_name = (text_or_empty(c("full_name")) != "") & ~is_fake_name(c("full_name"))
    real_role = real_name & (role != "") & ~is_in(role, rules.SHARED_MAILBOXES)
    generic = F.when(real_role, False).when(c("email").isNull(), c("full_name").isNull()).otherwise(
        is_in(local, rules.SHARED_MAILBOXES)
    )
    return contacts.withColumn(
        "contact_class", F.when(decision, "decision").when(generic, "generic").otherwise("other")
    )


def best_contact(contacts: DataFrame) -> DataFrame:
    """First decision maker, else first other, else first shared mailbox of each company."""
    rank = F.when(F.col("contact_class") == "decision", 1).when(F.col("contact_class") == "other", 2).otherwise(3)
    return first_per_key(contacts, ["company_id"], [rank, *contact_order()])


def contact_report(contacts: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Counters and the best contact per company (lists stay long tables, see ``contact_lists``)."""
    counts = contacts.groupBy("company_id").agg(
        F.count("*").alias("contact_count"),
        F.count_if((F.col("contact_class") == "decision") & F.coalesce("full_name", "email", "linkedin").isNotNull()).alias("decision_makers_found"),
        F.count_if(F.col("contact_class") == "generic").alias("generic_contacts_found"),
        F.count_distinct(F.lower("email")).alias("email_count"),
        F.count_distinct("linkedin").alias("linkedin_count"),
    )
    best = best_contact(contacts).select(
        "company_id", *[F.col(f).alias(f"best_{f}") for f in ("full_name", "email", "role")], F.col("contact_score").alias("best_contact_score")
    )
    out = counts.join(best, "company_id", "left")
    if pages is not None:
        out = out.join(pages.groupBy("company_id").agg(F.count_distinct("url").alias("pages_scanned")), "company_id", "left")
    return out


def contact_lists(contacts: DataFrame) -> DataFrame:
    """Distinct addresses and profiles of each company as rows (company_id, kind, value)."""
    kinds = F.array(
        *[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in (
            ("email", F.lower("email")), ("linkedin", F.col("linkedin")), ("github", F.col("github")), ("twitter", F.col("twitter")),
        )]
    )
    rows = unnest(contacts, F.filter(kinds, lambda x: x["value"].isNotNull()), "x", ["company_id"])
    return rows.select("company_id", "x.kind", "x.value").distinct()


# --- founders --------------------------------------------------------------------------------

def founder_key(name: Column, email: Column, linkedin: Column) -> Column:
    return F.coalesce(
        F.concat(F.lit("email:"), blank_to_null(normalize_email(email))),
        F.concat(F.lit("linkedin:"), blank_to_null(F.rtrim(F.lower(linkedin), F.lit("/")))),
        F.concat(F.lit("name:"), F.lower(strip(text_or_empty(name)))),
    )


def select_founders(contacts: DataFrame) -> DataFrame:
    """Founder-like people per company, one per address, profile or name; later rows fill gaps.

    ``contacts`` holds pos, full_name, role, email, linkedin, percent and contact_score in the order
    decision makers, contacts, best contact.
    """
    full = with_optional(contacts, ("github", "twitter"))
    people = full.filter(is_founder_role(F.col("role")) & ~is_fake_name(F.col("full_name")))
    keyed = people.withColumn("founder_key", founder_key(F.col("full_name"), F.col("email"), F.col("linkedin")))
    return keyed.groupBy("company_id", "founder_key").agg(
        F.min("pos").alias("pos"),
        *[first_value(F.col(f), F.col("pos")).alias(f) for f in ("full_name", "role", "email", "linkedin", "github", "twitter")],
        F.max("percent").alias("percent"),
        F.min_by("contact_score", "pos").alias("contact_score"),
    )


def founder_names(founders: DataFrame) -> DataFrame:
    """First word and last word of the name."""
    clean = blank_to_null(squash(F.col("full_name")))
    return founders.withColumns(
        {
            "full_name": clean,
            "first_name": blank_to_null(F.regexp_extract(clean, r"^(\S+)", 1)),
            "last_name": blank_to_null(F.regexp_extract(clean, r" (\S+)$", 1)),
        }
    )


def single_social(socials: DataFrame) -> DataFrame:
    """Company-level person profile per kind, only where there is exactly one (company_id, kind, value)."""
    value = F.lower("value")
    plausible = (
        F.when(F.col("kind") == "linkedin", F.contains(value, F.lit("linkedin.com/in/")))
        .when(
            F.col("kind") == "github",
            value.rlike(r"github\.com/[^/?#]+/?$") & ~value.rlike(r"github\.com/(features|pricing|about)/?$"),
        )
        .when(F.col("kind") == "twitter", value.rlike(r"(twitter|x)\.com/"))
    )
    distinct = socials.filter(plausible).select("company_id", "kind", "value").distinct()
    counted = distinct.groupBy("company_id", "kind").agg(F.count("*").alias("n"), F.max("value").alias("value"))
    return counted.filter(F.col("n") == 1).groupBy("company_id").agg(
        *[F.max(F.when(F.col("kind") == k, F.col("value"))).alias(f"only_{k}") for k in ("linkedin", "github", "twitter")]
    )


def founder_page_facts(first: Column, full_name: Column, base: Column, least_bio: int = 40) -> Column:
    """struct(bio, avatar_url, personal_website, location) read from one parsed page for one name.

    The bio is the first block of ``least_bio`` characters or more, in page order, that names the person.
    """
    name_first, name_full = F.lower(first), F.lower(full_name)
    texts = F.transform(F.array_sort(F.transform(text_blocks("bios"), lambda b: F.struct(b["pos"], b["text"]))), lambda b: b["text"])
    bio = F.get(
        F.filter(
            F.filter(texts, lambda t: F.length(t) >= least_bio),
            lambda t: F.contains(F.lower(t), name_first)
            & (
                F.contains(F.lower(t), name_full)
                | F.exists(F.split(name_full, r"\s+"), lambda p: (F.length(p) > 2) & F.contains(F.lower(t), p))
            ),
        ),
        F.lit(0),
    )
    images = elements(lambda e: (e["tag"] == "img"))
    source = lambda e: strip(F.coalesce(blank_to_null(attr(e, "src")), attr(e, "data-src")))
    avatar = F.get(
        F.filter(
            images,
            lambda e: (text_or_empty(source(e)) != "")
            & F.contains(F.lower(F.concat_ws(" ", source(e), attr(e, "alt"), attr(e, "class"), attr(e, "id"))), name_first),
        ),
        F.lit(0),
    )
    own = netloc(base)
    anchors = elements(lambda e: (e["tag"] == "a") & strip(text_or_empty(attr(e, "href"))).rlike("^https?://"))

    def personal(e: Column) -> Column:
        href = strip(attr(e, "href"))
        host = netloc(href)
        text = F.lower(text_or_empty(element_text(e)))
        foreign = (host != own) & ~F.endswith(host, F.concat(F.lit("."), own)) & ~contains_any(host, rules.SOCIAL_HOST_WORDS)
        named = F.contains(text, name_first) | F.contains(host, name_first)
        hinted = contains_any(F.concat_ws(" ", text, F.lower(href)), rules.PERSONAL_SITE_WORDS) & F.contains(
            F.concat_ws(" ", text, F.lower(href)), name_first
        )
        return foreign & (named | hinted)

    site = strip(attr(F.get(F.filter(anchors, personal), F.lit(0)), "href"))
    pattern = r"(?i)\b(" + "|".join(rules.FOUNDER_PLACES) + r")\b"
    near = F.filter(
        F.transform(elements(lambda e: e["tag"].isin("p", "div", "li", "span")), lambda e: element_text(e)),
        lambda t: F.contains(F.lower(t), name_first) & t.rlike(pattern),
    )
    place = title_case(blank_to_null(F.regexp_extract(F.get(near, F.lit(0)), pattern, 0)))
    return F.struct(
        bio.alias("bio"),
        F.when(avatar.isNotNull(), resolve_url(source(avatar), base)).alias("avatar_url"),
        site.alias("personal_website"),
        place.alias("location"),
    )


def enrich_founders(
    founders: DataFrame,
    homepages: DataFrame,
    socials: DataFrame | None = None,
    keywords: DataFrame | None = None,
) -> DataFrame:
    """Names, single company profiles, bio, avatar, personal site and place.

    ``homepages`` holds company_id, url and elements (one parsed page per company); ``keywords``
    holds company_id, keyword_rank and token for the place fallback.
    """
    named = founder_names(with_optional(founders, ("github", "twitter")))
    if socials is not None:
        named = named.join(single_social(socials), "company_id", "left").withColumns(
            {k: F.coalesce(k, f"only_{k}") for k in ("linkedin", "github", "twitter")}
        ).drop("only_linkedin", "only_github", "only_twitter")
    joined = named.join(homepages.select("company_id", F.col("url").alias("_url"), "elements", "page_pieces", "text_runs"), "company_id", "left")
    facts = joined.withColumn(
        "_facts", founder_page_facts(F.col("first_name"), F.col("full_name"), F.col("_url"))
    ).drop("elements", "page_pieces", "text_runs", "_url")
    out = facts.select(*[c for c in facts.columns if c != "_facts"], "_facts.*")
    if keywords is not None:
        pattern = r"(?i)\b(" + "|".join(rules.FOUNDER_PLACES) + r")\b"
        places = keywords.filter(F.col("token").rlike(pattern)).withColumn(
            "_place", title_case(F.regexp_extract("token", pattern, 0))
        )
        first = first_per_key(places, ["company_id"], ["keyword_rank"]).select("company_id", "_place")
        out = out.join(first, "company_id", "left").withColumn("location", F.coalesce("location", "_place")).drop("_place")
    return out


def founder_confidence(
    full_name: Column, role: Column, email: Column, linkedin: Column, github: Column, twitter: Column,
    bio: Column, avatar: Column, base_percent: Column, contact_score: Column,
) -> Column:
    """Whole percents, at most 100."""
    has = lambda c: text_or_empty(c) != ""
    on = lambda test, points: F.when(test, points).otherwise(0)
    base = F.when(F.coalesce(base_percent, F.lit(0)) > 0, F.greatest(F.lit(15), F.least(F.lit(50), base_percent))).otherwise(15)
    scored = F.greatest(base, F.least(F.lit(70), F.coalesce(contact_score, F.lit(0))))
    return F.least(
        F.lit(100),
        scored
        + on(has(full_name), 10)
        + on(is_founder_role(role), 15)
        + on(has(email), 15)
        + on(has(linkedin), 10)
        + on(has(github) | has(twitter), 5)
        + on(has(bio), 5)
        + on(has(avatar), 5),
    )


def score_founders(founders: DataFrame) -> DataFrame:
    full = with_optional(founders, ("github", "twitter", "bio", "avatar_url"))
    c = F.col
    return full.withColumn(
        "founder_percent",
        founder_confidence(
            c("full_name"), c("role"), c("email"), c("linkedin"), c("github"), c("twitter"), c("bio"), c("avatar_url"),
            c("percent"), c("contact_score"),
        ),
    )


def founder_report(scored: DataFrame, companies: DataFrame) -> DataFrame:
    """Founder count, primary founder and its confidence; companies without founders are listed as empty."""
    order = [F.desc("founder_percent"), F.lower(text_or_empty(F.col("full_name"))), F.col("pos")]
    primary = top_per_key(scored, ["company_id"], order, 1).select(
        "company_id", F.col("full_name").alias("primary_founder"), F.col("email").alias("primary_founder_email"), F.col("founder_percent").alias("percent")
    )
    counts = scored.groupBy("company_id").agg(F.count("*").alias("founders_found"))
    joined = companies.select("company_id").join(counts, "company_id", "left").join(primary, "company_id", "left")
    return joined.withColumns(
        {
            "founders_found": F.coalesce("founders_found", F.lit(0)),
            "percent": F.coalesce("percent", F.lit(0)),
            "empty": F.col("founders_found").isNull(),
        }
    )
