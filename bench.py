"""Headline queries over one scale factor; prints one line of JSON."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from codestrata.plans.queries import PLANS, corpus_for, run, snapshots_for

HEADLINES = [
    "walked_files", "language_breakdown", "todo_comments", "secret_lines", "import_edges", "key_files",
    "debt_score", "hotspots", "dead_modules", "readme_setup_steps", "glossary", "dependencies",
    "convention_report", "endpoints", "api_report", "security_findings", "risk_level", "env_vars",
    "contributors", "recent_files", "scorecard", "diff_findings", "report_items", "full_report",
]


def session() -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("codestrata-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINES))
    names = list(PLANS) if names == "all" else names.split(",")
    spark = session()
    times: dict[str, float] = {}
    start = time.perf_counter()
    corpus = corpus_for(spark, sf_dir)
    times["derive_corpus"] = round(time.perf_counter() - start, 3)
    if any(name.startswith("diff_") for name in names):  # stored states, as a deployment would have them
        start = time.perf_counter()
        snapshots_for(spark, sf_dir)
        times["write_snapshots"] = round(time.perf_counter() - start, 3)
    files = corpus.files.count()
    for name in names:
        start = time.perf_counter()
        run(name, spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    report = times.get("full_report")
    print(
        json.dumps(
            {
                "metric": "codebase analytics, headline queries, total wall time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "files": files,
                "full_report_files_per_sec": round(files / report, 1) if report else None,
            }
        )
    )


if __name__ == "__main__":
    main()
