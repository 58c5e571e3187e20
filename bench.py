"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from ampliq.plans import all_queries  # noqa: E402

HEADLINE = [
    "assay_amplification", "primer_site_counts", "target_coverage", "probe_identity", "inclusivity_by_group",
    "oligo_conservation", "drift_states", "snapshot_metrics", "cq_calls", "melt_products", "standard_curves",
    "detection_limits", "fold_changes", "oligo_thermodynamics", "degenerate_resolutions", "primer_gate_attrition",
    "diverse_assay_beam", "candidate_ranking", "assay_evidence", "subject_properties",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").config("spark.driver.host", "127.0.0.1")
             .config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    queries = all_queries()
    names = sys.argv[1:] or HEADLINE
    # One small query first, so that session start is not charged to the first timing.
    queries["dye_collisions"].build(spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.time()
        queries[name].build(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
