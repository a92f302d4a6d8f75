"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1), ``BENCH_CPUS`` (default 8) and
``BENCH_QUERIES`` (comma-separated names) select what runs.  ``build_ledger`` meters the raw
calls from scratch; the other queries read the stored ledger.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINES = [
    "session_report", "day_totals", "report_totals", "session_costs", "call_costs",
    "prefix_mutations", "paired_analysis", "experiment_plan", "skill_matches", "skill_prices",
    "admission_cap_tokens", "masking", "swe_agent_trajectories", "operating_points",
    "shared_ledger", "shared_traces", "submission_manifest",
]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.driver.memory", "12g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from tallyspark.checks.queries import QUERIES, stored

    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINES)).split(",") if n]
    seconds: dict[str, float] = {}

    def timed(name: str, run) -> None:
        start = time.perf_counter()
        run()
        seconds[name] = round(time.perf_counter() - start, 3)

    QUERIES["last_outcomes"](spark, SF_DIR).write.format("noop").mode("overwrite").save()  # warm up
    timed("build_ledger", lambda: stored(spark, SF_DIR))
    timed("build_conversation_ledger", lambda: stored(spark, SF_DIR, "named"))
    timed("build_chained_ledger", lambda: stored(spark, SF_DIR, "chained"))
    for name in names:
        timed(name, lambda n=name: QUERIES[n](spark, SF_DIR).write.format("noop").mode("overwrite").save())
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
        "spark": spark.version, "cores": int(CPUS), "shuffle_partitions": int(CPUS),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
