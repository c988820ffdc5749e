"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from stratalens.plans.queries import QUERIES

HEADLINE = (
    "dup_fact_rounded_conflict", "fact_signature_ids", "text_duplicate_sets", "anchor_defect_codes", "numeric_rule_violations", "identity_collapse_groups",
    "registry_exact_lookup", "registry_precedence_lookup", "registry_tiered_lookup", "ledger_scope_cap", "basis_transition", "alias_components", "candidate_rank",
    "marker_extension_churn", "prior_snapshot_asof", "same_quarter_prior_year", "set_added_removed", "incremental_seeds", "verify_manifest", "strip_tags_normalize",
    "detect_duplicate_facts", "detect_fact_rules", "detect_taxonomy", "detect_anchoring", "detect_collapse", "comparator_by_form", "detection_findings",
    "observation_rows", "identity_drift_events", "identity_scan", "snapshot_marker_m002", "schema_violations", "registry_increment", "pack_assembly",
)


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    run = lambda name: QUERIES[name](spark, root).write.format("noop").mode("overwrite").save()
    run("ledger_scope_cap")  # start the engine
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        began = time.perf_counter()
        run(name)
        times[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(root.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
