"""Review queue: gate, transitions, replay, statistics and send plan (family K)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions.people import domain_part, is_outbound_safe
from leadloom.functions.text import blank_to_null, strip, text_or_empty, words
from leadloom.functions.urls import canonical_website
from leadloom.operators.ordering import first_per_key, join_sparse
from leadloom.operators.outreach import compose_body, scrub_text
from leadloom.operators.rows import unnest
from leadloom.rules import outreach as rules


def bare_site(c: Column) -> Column:
    return F.btrim(F.regexp_replace(text_or_empty(c), "https://|http://", ""), F.lit("/"))


def append_rows(gated: DataFrame, sender_name: str = "", linkedin: str = "", github: str = "", phone: str = "") -> DataFrame:
    """PENDING rows for gated companies: composed body, clean subject, fallback ids."""
    c, sender = F.col, F.lit(sender_name)
    company = c("company_id").cast("string") if "company_id" in gated.columns else F.lit(None).cast("string")
    return gated.select(
        F.coalesce(blank_to_null(company), bare_site(c("website"))).alias("company_id"),
        F.lower(strip(c("recipient_email"))).alias("contact_id"),
        "recipient_name",
        "recipient_email",
        scrub_text(c("email_subject"), c("recipient_name"), sender, keep_sender=False).alias("subject"),
        compose_body(
            c("email_opening"), c("email_body"), c("email_cta"), c("recipient_name"), sender, F.lit(linkedin), F.lit(github), F.lit(phone)
        ).alias("body"),
        F.lit("PENDING").alias("status"),
        "generation_source",
        c("lead_score").cast("double").alias("lead_score"),
        F.lit(0).alias("retry_count"),
    )


def append_queue(rows: DataFrame, path: str) -> None:
    """Append, one folder per status, so status filters read only their folders."""
    rows.write.mode("append").partitionBy("status").parquet(path)


def company_keys(website: Column, company_id: Column | None = None) -> Column:
    """Every key under which a company may already be queued."""
    canonical = canonical_website(website)
    keys = [canonical, bare_site(canonical), strip(website), bare_site(strip(website))]
    if company_id is not None:
        keys.insert(2, company_id.cast("string"))
    return F.array_distinct(F.array_compact(F.array(*[blank_to_null(strip(k)) for k in keys])))


def known_companies(leads: DataFrame, queue: DataFrame, key: str = "pos", switch: bool = True) -> DataFrame:
    """Leads (by ``key``) with a live queue row under any lookup key."""
    if not switch:
        return leads.select(key).limit(0)
    active = queue.filter(F.col("status").isin(*rules.KNOWN_STATUSES)).select(F.col("company_id").cast("string").alias("_key")).distinct()
    stored = F.col("company_id") if "company_id" in leads.columns else None
    rows = unnest(leads, company_keys(F.col("website"), stored), "_key", [key])
    return rows.join(active, "_key", "left_semi").select(key).distinct()


def without_known_companies(leads: DataFrame, queue: DataFrame, key: str = "pos", switch: bool = True) -> DataFrame:
    return leads.join(known_companies(leads, queue, key, switch), key, "left_anti")


def known_recipients(rows: DataFrame, queue: DataFrame, email: str = "recipient_email") -> DataFrame:
    """Adds ``recipient_known``: the address has a live queue row, letter case ignored."""
    active = (
        queue.filter(F.col("status").isin(*rules.KNOWN_STATUSES) & F.col("recipient_email").isNotNull())
        .select(F.lower(F.trim("recipient_email")).alias("_mail"))
        .distinct()
        .withColumn("_known", F.lit(True))
    )
    keyed = rows.withColumn("_mail", F.lower(F.trim(F.col(email))))
    return join_sparse(keyed, active, ["_mail"]).withColumn("recipient_known", F.coalesce("_known", F.lit(False))).drop("_known", "_mail")


def reserved_domain(email: Column) -> Column:
    d = domain_part(text_or_empty(email))
    return d.rlike("(" + "|".join(s.replace(".", r"\.") for s in rules.RESERVED_SUFFIXES) + ")$")


def queue_gate(rows: DataFrame, order: str = "company_id") -> DataFrame:
    """Adds ``outcome``: the first failing check, or queued.

    Needs recipient_email, has_opportunity, eligible, known_company, recipient_known, mx_ok and
    mailbox_ok (null verdict = allowed). Of several rows with one address, the first that passes
    everything is queued; later ones that get as far as the address check are duplicates.
    """
    have = set(rows.columns)
    flag = lambda name, default: F.coalesce(F.col(name), F.lit(default)) if name in have else F.lit(default)
    email = F.lower(strip(F.col("recipient_email")))
    reserved = reserved_domain(F.col("recipient_email"))
    checked = rows.withColumns(
        {
            "_mail": email,
            "_before": F.when(flag("known_company", False), "duplicate")
            .when(~flag("has_opportunity", True), "no_opportunity")
            .when(text_or_empty(email) == "", "no_recipient")
            .when(flag("recipient_known", False), "duplicate_recipient"),
            "_after": F.when(~(flag("mx_ok", True) | reserved), "no_mx")
            .when(~(flag("mailbox_ok", True) | reserved), "mailbox_rejected")
            .when(~flag("eligible", True), "low_score"),
        }
    )
    winners = (
        checked.filter(F.col("_before").isNull() & F.col("_after").isNull())
        .groupBy("_mail")
        .agg(F.min(order).alias("_first"))
    )
    joined = join_sparse(checked, winners, ["_mail"])
    late = F.col("_first").isNotNull() & (F.col(order) > F.col("_first"))
    outcome = F.coalesce(
        F.col("_before"), F.when(late, "duplicate_recipient"), F.col("_after"), F.lit("queued")
    )
    return joined.withColumn("outcome", outcome).drop("_mail", "_before", "_after", "_first")


def review_list(queue: DataFrame, companies: DataFrame, sender_name: str = "") -> DataFrame:
    """Open items newest first with their company; an id without a company keeps its row."""
    open_items = queue.filter(F.col("status").isin(*rules.REVIEW_STATUSES))
    joined = open_items.join(companies, "company_id", "left")
    if "subject" in queue.columns:
        clean = lambda name: scrub_text(F.col(name), F.col("recipient_name"), F.lit(sender_name), keep_sender=False)
        joined = joined.withColumns({"subject": clean("subject"), "body": clean("body")})
    return joined.orderBy(F.desc("created_at"), F.desc("queue_id"))


def queue_statistics(queue: DataFrame, statuses: Sequence[str] = rules.STATUSES) -> DataFrame:
    """Rows per status, zero where none."""
    dimension = queue.sparkSession.range(1).select(F.explode(words(statuses)).alias("status"))
    counts = queue.groupBy("status").agg(F.count("*").alias("n"))
    return dimension.join(counts, "status", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def queue_statistics_wide(queue: DataFrame, statuses: Sequence[str] = rules.STATUSES) -> DataFrame:
    """One row with a column per status and the total."""
    return queue.agg(
        *[F.count_if(F.col("status") == s).alias(s.lower()) for s in statuses],
        F.count_if(F.col("status").isin(*statuses)).alias("total"),
    )


def edge_allowed(current: Column, target: Column, edges: Sequence[tuple[str, str]] = rules.TRANSITIONS) -> Column:
    return F.concat_ws(">", current, target).isin(*[f"{a}>{b}" for a, b in edges])


def transition_check(requests: DataFrame) -> DataFrame:
    """Adds ``allowed`` for (current, target) pairs."""
    return requests.withColumn("allowed", edge_allowed(F.col("current"), F.col("target")))


def apply_transitions(queue: DataFrame, requests: DataFrame, at: Column | str) -> DataFrame:
    """Queue after one round of requests (queue_id, target, error, pos): illegal ones change nothing.

    Adds ``accepted`` (null where nothing was asked). READY rows and legacy cancels keep their rules.
    """
    moment = F.lit(at).cast("timestamp") if isinstance(at, str) else at
    first = first_per_key(requests, ["queue_id"], ["pos"]).select("queue_id", F.col("target").alias("_target"), F.col("error").alias("_error"))
    joined = queue.join(first, "queue_id", "left")
    target = F.col("_target")
    legal = edge_allowed(F.col("status"), target) | (target == "CANCELLED")
    ok = F.coalesce(legal, F.lit(False))
    return joined.withColumns(
        {
            "accepted": F.when(target.isNotNull(), ok),
            "approved_at": F.when(ok & (target == "APPROVED"), moment).otherwise(F.col("approved_at")),
            "sent_at": F.when(ok & (target == "SENT"), moment).otherwise(F.col("sent_at")),
            "error_message": F.when(ok & target.isin("FAILED", "SKIPPED"), F.col("_error"))
            .when(ok & target.isin("APPROVED", "SENT"), F.lit(None).cast("string"))
            .otherwise(F.col("error_message")),
            "retry_count": F.col("retry_count") + F.when(ok & (target == "FAILED"), 1).otherwise(0),
            "status": F.when(ok, target).otherwise(F.col("status")),
        }
    ).drop("_target", "_error")


def edit_drafts(queue: DataFrame, edits: DataFrame) -> DataFrame:
    """New subject or body (queue_id, subject, body) for PENDING items; blank texts are ignored."""
    new = edits.select("queue_id", blank_to_null(strip(F.col("subject"))).alias("_subject"), blank_to_null(strip(F.col("body"))).alias("_body"))
    joined = queue.join(new, "queue_id", "left")
    pending = F.col("status") == "PENDING"
    return joined.withColumns(
        {n: F.when(pending, F.coalesce(f"_{n}", n)).otherwise(F.col(n)) for n in ("subject", "body")}
    ).drop("_subject", "_body")


def replay_events(events: DataFrame, edges: Sequence[tuple[str, str]] = rules.TRANSITIONS, start: str = "PENDING") -> DataFrame:
    """Current state per item out of its ordered events (item_id, event_id, ts, target).

    Every edge leads forward, so an item moves at most as often as the longest path. Each step takes
    the earliest event that is legal from the item's state and later than its last move: a grouped
    minimum, pre-aggregated in every map task, so an item with very many events is no single-task load.
    """
    depth = _longest_path(edges, start)
    at = F.struct("ts", "event_id")
    totals = events.groupBy("item_id").agg(F.count("*").alias("events"))
    state = totals.select(
        "item_id", F.lit(start).alias("status"), F.lit(None).cast(_order_type(events)).alias("moved"), F.lit(0).alias("accepted")
    )
    for _ in range(depth):
        joined = events.join(state, "item_id")
        later = F.col("moved").isNull() | (at > F.col("moved"))
        step = (
            joined.filter(later & edge_allowed(F.col("status"), F.col("target"), edges))
            .groupBy("item_id")
            .agg(F.min(F.struct("ts", "event_id", "target")).alias("_next"))
        )
        state = state.join(step, "item_id", "left").select(
            "item_id",
            F.coalesce("_next.target", "status").alias("status"),
            F.when(F.col("_next").isNotNull(), F.struct("_next.ts", "_next.event_id")).otherwise(F.col("moved")).alias("moved"),
            (F.col("accepted") + F.when(F.col("_next").isNotNull(), 1).otherwise(0)).alias("accepted"),
        )
    return state.join(totals, "item_id").select(
        "item_id",
        "status",
        F.col("moved.ts").alias("moved_at"),
        "accepted",
        (F.col("events") - F.col("accepted")).alias("rejected"),
        F.when(F.col("status") == "FAILED", 1).otherwise(0).alias("retry_count"),
    )


def _order_type(events: DataFrame) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    return f"struct<ts:{kinds['ts']},event_id:{kinds['event_id']}>"


def _longest_path(edges: Sequence[tuple[str, str]], start: str) -> int:
    following = [b for a, b in edges if a == start]
    return max((1 + _longest_path(edges, b) for b in following), default=0)


def sendable_error(row_prefix: str = "", allow_hiring: bool = True) -> Column:
    """First error of a queue row, null when it can be sent."""
    c = lambda n: F.col(row_prefix + n)
    blank = lambda n: strip(text_or_empty(c(n).cast("string"))) == ""
    email = strip(text_or_empty(c("recipient_email")))
    return (
        F.when(blank("company_id") | blank("contact_id"), rules.ERROR_IDS)
        .when(email == "", rules.ERROR_NO_EMAIL)
        .when(~email.rlike(rules.RECIPIENT_PATTERN), rules.ERROR_BAD_EMAIL)
        .when(~is_outbound_safe(email, allow_hiring), rules.ERROR_GENERIC)
        .when(blank("subject"), rules.ERROR_SUBJECT)
        .when(blank("body"), rules.ERROR_BODY)
    )


def send_batch_plan(queue: DataFrame, limit: int | None = None, allow_hiring: bool = True) -> DataFrame:
    """READY items (oldest first, at most ``limit``) with planned status and error; nothing is delivered.

    ``mx_ok`` and ``mailbox_ok`` verdict columns may be null or missing (= allowed).
    """
    ready = queue.filter(F.col("status") == "READY_TO_SEND")
    if limit is not None:
        ready = ready.orderBy("created_at", "queue_id").limit(limit)
    have = set(queue.columns)
    verdict = lambda n: F.coalesce(F.col(n), F.lit(True)) if n in have else F.lit(True)
    email = strip(text_or_empty(F.col("recipient_email")))
    reserved = reserved_domain(email)
    error = F.coalesce(
        sendable_error(allow_hiring=allow_hiring),
        F.when(~(verdict("mx_ok") | reserved), F.concat(F.lit("No MX records for domain '"), domain_part(email), F.lit("'"))),
        F.when(~(verdict("mailbox_ok") | reserved), F.concat(F.lit("Mailbox rejected by SMTP probe ("), email, F.lit(")"))),
    )
    return ready.withColumn("error", error).withColumn(
        "planned", F.when(F.col("error").isNull(), "SENT").otherwise("FAILED")
    )


def send_totals(plan: DataFrame) -> DataFrame:
    """attempted, sent, failed and skipped; error texts stay in the plan rows."""
    return plan.agg(
        F.count("*").alias("attempted"),
        F.count_if(F.col("planned") == "SENT").alias("sent"),
        F.count_if(F.col("planned") == "FAILED").alias("failed"),
        F.lit(0).cast("bigint").alias("skipped"),
    )


def retryable_failed(queue: DataFrame, max_retries: int = rules.MAX_RETRIES) -> DataFrame:
    return queue.filter((F.col("status") == "FAILED") & (F.col("retry_count") < max_retries))


def queue_slice(queue: DataFrame, *statuses: str) -> DataFrame:
    """Items in the given states; with the status folders only those folders are read."""
    return queue.filter(F.col("status").isin(*statuses))
