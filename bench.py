"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from leadloom.plans import catalog  # noqa: E402
from leadloom.session import get_session  # noqa: E402

HEADLINE = (
    "site_report",
    "u_enrich_urls",
    "n5_normalize_posts",
    "l3_validate_leads",
    "l4_dedupe_counts",
    "l6_limit_per_source",
    "p_page_profiles",
    "t3_technology_report",
    "m2_mobile_result",
    "h4_extract_jobs",
    "h8_hiring_report",
    "b5_classify",
    "i4_top_keywords",
    "c1_extract_emails",
    "c10_merge_contacts",
    "f4_founder_report",
    "e3_email_pattern_report",
    "q2_qualification_score",
    "q5_opportunity_score",
    "q9_lead_score",
    "o3_personalize",
    "o6_scrub_placeholders",
    "k3_queue_gate",
    "d1_upsert",
    "d2_upsert_ladder",
    "r4_run_statistics",
    "w3_replay_queue",
)


def run(spark, sf_dir: str, name: str) -> float:
    start = time.perf_counter()
    catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n]
    spark = get_session("bench", cpus, int(cpus) if cpus.isdigit() else None)
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in only or HEADLINE:
        run(spark, sf_dir, name)  # first run: code generation and page cache
        seconds[name] = round(run(spark, sf_dir, name), 3)
        if os.environ.get("BENCH_VERBOSE"):
            print(name, seconds[name], file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
