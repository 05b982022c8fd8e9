"""Run statistics and reports (family R)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions.text import any_of, text_or_empty
from leadloom.operators.scoring import validation_lead_score
from leadloom.rules import outreach as rules


def source_statistics(leads: DataFrame, sources: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Per source: count, success, error. Sources without a row show zero; ``errors`` holds source, error."""
    measures = [F.count("*").alias("count")]
    if "ts" in leads.columns:
        measures += [F.min("ts").alias("started"), F.max("ts").alias("finished")]
    counts = leads.groupBy("source").agg(*measures)
    out = sources.select("source").join(counts, "source", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    if errors is None:
        return out.withColumns({"success": F.lit(True), "error": F.lit(None).cast("string")})
    first = errors.groupBy("source").agg(F.min("error").alias("error"))
    return out.join(first, "source", "left").withColumn("success", F.col("error").isNull())


def collector_funnel(items: DataFrame, stages: Sequence[str] = ("collected", "normalized", "valid", "saved")) -> DataFrame:
    """Rows per source that reach each stage (boolean columns), in one pass."""
    return items.groupBy("source").agg(*[F.count_if(F.col(s)).alias(s) for s in stages])


def classify_skip(warnings: Column, queued: Column) -> Column:
    """Skip reason out of the warning texts: first match in table order, other_skip, or null."""
    text = F.lower(F.array_join(warnings, " "))
    expr = F.when(queued, F.lit(None).cast("string"))
    for reason, needles in rules.SKIP_TEXTS:
        expr = expr.when(any_of([F.contains(text, F.lit(n)) for n in needles]), reason)
    return expr.when(F.size(warnings) > 0, "other_skip")


# Skip reasons in report order.
REASONS = ("duplicate", "no_recipient", "no_mx", "mailbox_rejected", "low_score", "no_opportunity", "other_skip")


def run_statistics(outcomes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Run counters, one per skip reason, and the success flag; with ``by`` also per group (null = all)."""
    counters = [
        F.count("*").alias("processed"),
        *[F.count_if(F.col(c)).alias(c) for c in ("persisted", "qualified", "emails_generated", "queued")],
        F.count_if(~F.col("success")).alias("failed"),
        *[F.count_if(F.col("skip_reason") == r).alias(f"skipped_{r}") for r in REASONS],
    ]
    grouped = outcomes.rollup(*by) if by else outcomes.groupBy()
    return grouped.agg(*counters).withColumn("run_success", F.col("failed") == 0)


def skip_reason_map(statistics: DataFrame) -> DataFrame:
    """Adds ``skip_reasons``: the non-zero reasons as a map."""
    pairs = F.array(*[F.struct(F.lit(r).alias("k"), F.col(f"skipped_{r}").alias("v")) for r in REASONS])
    return statistics.withColumn("skip_reasons", F.map_from_entries(F.filter(pairs, lambda p: p["v"] > 0)))


def run_summary_text(statistics: DataFrame) -> DataFrame:
    """Twenty-line text summary of one run row."""
    c = lambda n: F.col(n) if n in statistics.columns else F.lit(0)
    mark = "[RUN SUMMARY] "
    rows = (
        ("Fetched (raw from sources):     ", c("total_found")),
        ("Unique after dedupe:           ", F.concat(c("unique_companies").cast("string"), F.lit(" (duplicates removed: "), c("duplicates_removed").cast("string"), F.lit(")"))),
        ("Selected for pipeline:          ", c("total_collected")),
        ("Processed:                      ", c("processed")),
        ("Saved to DB (companies):         ", c("persisted")),
        ("Qualified:                      ", c("qualified")),
        ("Personalized:                   ", c("personalized")),
        ("Emails generated:               ", c("emails_generated")),
        ("Shortlisted / queued:           ", c("queued")),
        ("Failed:                         ", c("failed")),
        ("Skipped — duplicate:            ", c("skipped_duplicate")),
        ("Skipped — no recipient email:   ", c("skipped_no_recipient")),
        ("Skipped — no MX:                ", c("skipped_no_mx")),
        ("Skipped — mailbox rejected:     ", c("skipped_mailbox_rejected")),
        ("Skipped — low score:            ", c("skipped_low_score")),
        ("Skipped — no opportunity:       ", c("skipped_no_opportunity")),
        ("Skipped — other:                ", c("skipped_other_skip")),
        ("Duration:                       ", F.concat(F.format_string("%.0f", c("duration_ms").cast("double")), F.lit(" ms"))),
        ("Status:                         ", F.when(c("run_success").cast("boolean"), "SUCCESS").otherwise("FAILED")),
    )
    lines = [F.lit(mark + "========== Lead generation run ==========")]
    lines += [F.concat(F.lit(mark + label), value.cast("string")) for label, value in rows]
    lines.append(F.lit(mark + "========================================"))
    return statistics.select(F.concat_ws("\n", *lines).alias("value"))


def stage_timings(stages: DataFrame, key: str = "company_id") -> DataFrame:
    """Per item the duration map of its stages, error list and success. Stages per item are few and fixed.

    Input: key, stage, pos, duration_ms, error (blank or null when it went well). A repeated stage
    counts with its last value.
    """
    last = stages.groupBy(key, "stage").agg(F.max_by("duration_ms", "pos").alias("duration_ms"), F.max_by(text_or_empty(F.col("error")), F.col("pos")).alias("error"))
    return last.groupBy(key).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", "duration_ms")))).alias("durations"),
        F.array_sort(
            F.collect_list(F.when(text_or_empty(F.col("error")) != "", F.concat("stage", F.lit(": "), "error")))
        ).alias("errors"),
        F.sum("duration_ms").alias("total_ms"),
    ).withColumn("success", F.size("errors") == 0)


def stage_percentiles(stages: DataFrame) -> DataFrame:
    """Run count, failures and latency percentiles per stage."""
    return stages.groupBy("stage").agg(
        F.count("*").alias("runs"),
        F.count_if(F.col("error").isNotNull()).alias("failures"),
        F.percentile_approx("duration_ms", 0.5).alias("p50_ms"),
        F.percentile_approx("duration_ms", 0.95).alias("p95_ms"),
    )


#: Size of the sketches: a merged percentile lies within about 0.7 % of the rows of the exact one (99 % of the time),
#: however many sketches were merged; a sketch has a few KB.
SKETCH_K = 500


def timing_sketches(stages: DataFrame, day: Column | str) -> DataFrame:
    """Per stage and day: runs, failures, total_ms and a sketch of the durations, to be stored and merged later.

    Null durations count as runs and are in no sketch; a stage without durations has an empty one.
    """
    value = F.col("duration_ms").cast("double")
    return stages.groupBy("stage", F.to_date(day).alias("day")).agg(
        F.count("*").alias("runs"),
        F.count_if(F.col("error").isNotNull()).alias("failures"),
        F.sum(value).alias("total_ms"),
        F.kll_sketch_agg_double(value, F.lit(SKETCH_K)).alias("sketch"),
    )


def store_timings(sketches: DataFrame, path: str) -> None:
    """Days as partitions: a repeated run replaces its own days only."""
    writer = sketches.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("day").parquet(path)


def merged_percentiles(sketches: DataFrame, keys: Sequence[str] = ("stage",), shares: Sequence[float] = (0.5, 0.95)) -> DataFrame:
    """Run count, failures, mean and percentiles over stored sketches: any days together, without their rows."""
    merged = sketches.groupBy(*keys).agg(
        F.sum("runs").alias("runs"), F.sum("failures").alias("failures"), F.sum("total_ms").alias("_total"), F.kll_merge_agg_double("sketch").alias("_sketch")
    )
    held = F.kll_sketch_get_n_double("_sketch")
    columns = {f"p{share * 100:g}_ms": F.when(held > 0, F.kll_sketch_get_quantile_double("_sketch", F.lit(share))) for share in shares}
    return merged.withColumns({"mean_ms": F.when(held > 0, F.col("_total") / held), **columns}).drop("_total", "_sketch")


def validation_rows(features: DataFrame) -> DataFrame:
    """Flat check row per company of a validation run."""
    c = F.col
    good = c("qualified")
    return features.select(
        "company_id",
        "name",
        "website",
        c("site_valid").alias("website_reachable"),
        "technologies",
        F.coalesce("has_mobile_app", F.lit(False)).alias("mobile_app"),
        F.coalesce("android", F.lit(False)).alias("play_store"),
        F.coalesce("ios", F.lit(False)).alias("app_store"),
        good.alias("qualification_pass"),
        c("score").alias("qualification_score"),
        c("emails_found").alias("contact_emails_found"),
        "decision_makers",
        "email_pattern",
        good.alias("is_good_lead"),
        validation_lead_score(
            c("score"), c("emails_found"), F.size("technologies"), F.coalesce("has_mobile_app", F.lit(False)), good
        ).alias("lead_score"),
    )


def validation_summary(rows: DataFrame) -> DataFrame:
    """Aggregate of the check rows; the mean score is zero for an empty run."""
    return rows.agg(
        F.count("*").alias("companies_processed"),
        F.count_if("website_reachable").alias("reachable"),
        F.count_if("qualification_pass").alias("qualified"),
        F.count_if("mobile_app").alias("mobile_apps"),
        F.coalesce(F.sum("contact_emails_found"), F.lit(0)).alias("emails_found"),
        F.count_if(F.size("technologies") > 0).alias("technology_detection_success"),
        F.count_if("is_good_lead").alias("good_leads"),
        F.coalesce(F.bround(F.avg("lead_score"), 1), F.lit(0.0)).alias("average_lead_score"),
    )


def job_metrics(runs: DataFrame, jobs: DataFrame) -> DataFrame:
    """Last execution per job; jobs that never ran are listed without values.

    ``runs`` holds job, run_id, started_at, finished_at, duration_ms, success and error.
    """
    fields = ("started_at", "finished_at", "duration_ms", "success", "error")
    last = runs.groupBy("job").agg(
        F.max_by(F.struct(*fields), F.struct("finished_at", "run_id")).alias("_last")
    ).select("job", *[F.col(f"_last.{f}").alias(f) for f in fields])
    return jobs.select("job").join(last, "job", "left")


def validation_job_totals(leads: DataFrame) -> DataFrame:
    """processed, failed and error count over processed seeds (``errors`` array per lead)."""
    return leads.agg(
        F.count("*").alias("processed"),
        F.count_if(F.size("errors") > 0).alias("failed"),
        F.coalesce(F.sum(F.size("errors")), F.lit(0)).alias("errors"),
    )


def persist_statistics(actions: DataFrame) -> DataFrame:
    """created, updated and skipped rows per table with the duplicate count. Input: table, action."""
    action = text_or_empty(F.col("action"))
    return actions.groupBy("table").agg(
        F.count_if(action == "created").alias("created"),
        F.count_if(action == "updated").alias("updated"),
        F.count_if(action.isin("skipped", "duplicate")).alias("skipped"),
        F.count_if(action == "duplicate").alias("duplicates_skipped"),
    )
