"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores; ``--all`` times every query.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from clauselake.queries import load
from clauselake.session import recommended_conf

HEADLINE = (
    "term_frequencies", "bigram_frequencies", "keyword_scores", "content_hashes",
    "detect_policy_standard", "content_signals", "page_text", "page_links", "privacy_links",
    "homepage_confidence", "classify_crawled_links", "link_features", "score_links",
    "best_candidate", "best_validated_candidate", "best_per_type", "consensus_domain",
    "latest_version", "version_compare", "paragraph_diff_counts", "detect_changes",
    "changelog_rollup", "critical_changes", "risk_score", "breach_stats", "exposure_by_category",
    "top_concerns", "community_score", "log_sessions", "session_summary", "request_spacing",
)


def session(cpus: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("clauselake-bench")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in recommended_conf(int(cpus) if cpus.isdigit() else 8).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    found, _ = load()
    names = list(found) if "--all" in sys.argv else [a for a in sys.argv[1:]] or list(HEADLINE)
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_suppkey").count().count()
    took: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
        if "--all" in sys.argv:
            print(name, took[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
