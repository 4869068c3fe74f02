"""Headline-query benchmark: prints ONE JSON line.

Runs each registered headline query over the whole tables of $BENCH_SF_DIR
(default /root/testdata/sf0.1) on local[$BENCH_CPUS] and times a full
execution (``write.format("noop")`` forces every row to be computed without
collecting to the driver). The reported value is the sum of the per-query
times after one warm-up of the session.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "trial_balance", "trial_balance_posted", "general_ledger", "unbalanced_entries", "ar_aging",
    "ap_aging", "inventory_valuation", "stock_quantities", "moving_average_cost", "post_entries",
    "fifo_cogs", "dimension_pnl", "ledger_by_period", "bank_running_balance", "asof_rate",
    "audit_integrity",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from kontor.plans import registry
    from kontor.session import build_session

    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2,
                          extra={"spark.driver.memory": "16g"})
    qs = registry.queries()
    names = [n for n in HEADLINE if n in qs]
    # warm-up: JVM, codegen caches, file listing
    qs["trial_balance"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times, errors = {}, {}
    for n in names:
        t0 = time.time()
        try:
            qs[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[n] = round(time.time() - t0, 3)
        except Exception as e:  # noqa: BLE001 -- report, keep measuring the others
            times[n] = None
            errors[n] = repr(e)[:300]
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    out = {"metric": "headline_queries_total_sec",
           "value": round(sum(v for v in times.values() if v is not None), 3),
           "unit": "sec", "queries": times, "sf": sf}
    if errors:
        out["errors"] = errors
    print(json.dumps(out))


if __name__ == "__main__":
    main()
