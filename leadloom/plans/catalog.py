"""All registered queries."""

from __future__ import annotations

import importlib
import os

from leadloom.plans.registry import ORACLES, QUERIES

FAMILIES = (
    "urls",
    "leads",
    "pages",
    "signals",
    "company",
    "people",
    "scoring",
    "outreach",
    "streaming",
    "runs",
)

for _name in FAMILIES:
    importlib.import_module(f"leadloom.plans.catalog_{_name}")


def flagship(spark, sf_dir):
    return QUERIES["site_report"](spark, sf_dir)
