"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from txlens import plans, session

HEADLINE = ["gate_funnel", "tx_labels", "eligible_packs", "pairs_expand", "reputation", "pool_priors", "oof_priors", "candidate_routes", "classifier_summary_unique",
            "policy_grid", "budget_grid", "gate_tradeoff", "tx_structure", "race_matrix", "later_arbs", "latency_spans", "prefix_gap", "three_hop_cycles",
            "vocabulary", "write_parts"]


def main() -> int:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    keys = sys.argv[1:] or HEADLINE
    spark = session.build("bench", int(os.environ.get("BENCH_CPUS", "8")))
    plans.QUERIES["masters"](spark, d).write.format("noop").mode("overwrite").save()  # starts the workers
    took = {}
    for k in keys:
        t0 = time.time()
        plans.QUERIES[k](spark, d).write.format("noop").mode("overwrite").save()
        took[k] = round(time.time() - t0, 3)
    sf = os.path.basename(d.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
