"""Headline queries, timed; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Every query is run to its last row into a sink that discards them.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from quadrille.plans import load_all
from quadrille.plans.registry import QUERIES
from quadrille.session import local_session

HEADLINE = [
    "m1_metric_sum", "m1_metric_count_distinct", "m5_metric_time_grains", "m6_metric_cross_entity", "m10_readmission_30_days",
    "z1_exposure_by_counterparty", "z2_connected_accounts", "z3_suspicious_transfers", "z5_volume_by_type_and_period",
    "z8_equipment_effectiveness", "g2_rows_to_triples", "g5_exposure_by_pattern", "g11_sequence_path", "g13_bounded_traversal",
    "g18_rdfs_closure", "e7_same_as_clusters", "v8_shape_report", "v9_quarantine_split", "v10_table_validation", "e2_vector_top_k",
    "e3_resolution_cascade", "e8_tfidf_similarity", "d1_parse_html", "d2_chunks", "d10_document_run", "r5_ranked_hyperedges",
    "q1_access_decisions", "l4_provenance_chain", "l10_audit_statistics", "l13_version_diff", "s5_fhir_bundles",
    "t2_request_counts_per_minute",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    shared = tempfile.TemporaryDirectory(prefix="spark-", dir="/tmp")
    spark = local_session(cpus, "bench", **{"spark.checkpoint.dir": shared.name})
    load_all()
    # One small query of each kind first: class loading and Python workers are not what is measured.
    for warm in ("m1_metric_count", "e2_vector_top_k"):
        QUERIES[warm](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        begin = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    shared.cleanup()
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
