"""Time the headline queries on one machine and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose tables and
cores; each query runs once to warm up and then BENCH_RUNS times (default 1), median kept.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from checks.queries import queries
from ledgerlens.session import build_session

HEADLINE = (
    "ead_stage_summary ead_state_ead ead_ucid_lan ead_product_stage_dpd ead_pivot ead_negative_check"
    " ead_provision_check ead_portfolio_concentration exc_wide exc_long dup_pan dup_scope_person dup_address ucid"
    " audit_long cm_data_quality_summary cm_fraud_risk_flags cm_name_similarity cm_sequential_kyc"
    " cm_onboarding_velocity sample_selected sample_flags sample_book"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    chosen = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    registry, times = queries(), {}
    for name in chosen:
        taken = []
        for _ in range(runs + 1):
            start = time.time()
            registry[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.time() - start)
        times[name] = round(statistics.median(taken[1:]), 3)
        print(f"{name}: first {taken[0]:.2f}s, then {times[name]:.2f}s", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_headline_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
