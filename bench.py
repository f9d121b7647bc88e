"""Headline timings: one JSON line on stdout.

Each query runs once to warm up, then ``BENCH_RUNS`` times (default 3); the
median counts. The two training figures are the ones the published baseline
gives: time to train, and rows scored per second.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from palisade.fixtures import Tables  # noqa: E402
from palisade.operators import forest as iso  # noqa: E402
from palisade.plans.catalog import CATALOG  # noqa: E402
from palisade.plans.learning import KEY, stored_features  # noqa: E402
from palisade.session import build_session  # noqa: E402

HEADLINE = (
    "ag1_open_by_severity", "ag2_anomalies_by_type_severity", "ag3_hourly_timeline", "ag5_organisation_dashboard",
    "jn1_ag6_asset_exposure", "jn3_live_remediation_flag", "jn5_allowlist_check", "jn6_service_correlation",
    "flt3_so2_vulnerability_list", "flt5_threat_search", "wn3_oldest_audit_rows", "ups1_asset_upsert",
    "ups2_ups3_ups4_threat_sync", "fe2_window_features_300s", "src7_traffic_full", "ml9_fusion_batch",
    "ml5_fixed_forest_scores", "rm2_wn5_approvals", "dq1_rejected_rows", "dq2_injection_scan_documents",
    "st6_stream_last_seen",
)
#: Jobs of several runs each: timed once after the warm-up.
LONGER = ("ag9_scan_job_summary", "ml12_retrain_due_organisations", "st1_stream_window_features", "st2_stream_flood_watch_10s",
          "st4_stream_feed_ingest")


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(action, runs: int) -> float:
    action()
    spent = []
    for _ in range(runs):
        start = time.perf_counter()
        action()
        spent.append(time.perf_counter() - start)
    return round(statistics.median(spent), 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session("bench", f"local[{cpus}]", int(cpus), {
        "spark.ui.enabled": "false", "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g")})
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        seconds[name] = timed(lambda q=CATALOG[name]: run(q(spark, sf_dir)), runs)
    for name in LONGER:
        seconds[name] = timed(lambda q=CATALOG[name]: run(q(spark, sf_dir)), 1)

    # the reference's training job: 200 trees of at most 10,000 rows, 10 % contamination, then batch scoring
    features = stored_features(Tables(spark, sf_dir))
    params = iso.ForestParams(min_rows=1000)
    rows = features.count()
    start = time.perf_counter()
    forest, _ = iso.fit_forest(features, KEY, params)
    seconds["train_200_trees"] = round(time.perf_counter() - start, 3)
    seconds["score_all_windows"] = timed(lambda: run(iso.apply_forest(features, forest)), 1)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus), "training_rows": rows,
        "scored_rows_per_sec": round(rows / seconds["score_all_windows"])}))
    spark.stop()


if __name__ == "__main__":
    main()
