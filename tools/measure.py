"""Wall time (second run) and shuffle bytes of the headline queries, as a Markdown table.

usage: python tools/measure.py [--sf 0.1] > table.md
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bench import HEADLINE, run
from leadloom.session import get_session


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.1")
    sf_dir = f"/root/testdata/sf{ap.parse_args().sf}"
    logs = tempfile.mkdtemp(prefix="measure-")
    os.environ["PYSPARK_SUBMIT_ARGS"] = (
        f"--conf spark.eventLog.enabled=true --conf spark.eventLog.dir=file://{logs} --conf spark.eventLog.compress=false "
        "--conf spark.eventLog.rolling.enabled=false --conf spark.ui.showConsoleProgress=false pyspark-shell"
    )
    spark = get_session("measure", 8, 8)
    spark.sparkContext.setLogLevel("ERROR")
    spans = []
    for name in HEADLINE:
        run(spark, sf_dir, name)
        start = time.time()
        spent = run(spark, sf_dir, name)
        spans.append((name, start, time.time(), spent))
    spark.stop()
    tasks = []
    for path in Path(logs).iterdir():
        for line in path.open():
            event = json.loads(line)
            if event["Event"] == "SparkListenerTaskEnd" and event.get("Task Metrics"):
                written = event["Task Metrics"]["Shuffle Write Metrics"]["Shuffle Bytes Written"]
                tasks.append((event["Task Info"]["Launch Time"] / 1000, written))
    print("| query | seconds | shuffle MB |\n|---|---|---|")
    for name, start, end, spent in spans:
        print(f"| {name} | {spent:.2f} | {sum(b for t, b in tasks if start <= t <= end) / 1e6:.2f} |")
    print(f"| **all** | {sum(s for *_, s in spans):.1f} | |")


if __name__ == "__main__":
    main()
