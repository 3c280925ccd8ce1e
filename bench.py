"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from voltgrain import plans  # noqa: F401
from voltgrain.plans.registry import QUERIES
from voltgrain.session import local_session

HEADLINE = [
    "a1_trace_ingest", "a3_dedup_initial_x", "e2_state_index", "e5_glitch_width", "c5_nearest_cause", "l1_leakage", "l2_leakage_per_cycle",
    "l5_internal_output", "l8_cell_power", "d10_group_power_table", "d15_cycle_power", "k5_lut_value", "l13_averaged_output", "m3_propagate", "m5_probability",
    "c2_annotate_signals", "g2_levelize", "g4_forward_arrival", "g5_required_slack", "g8_k_worst_paths", "g9_fanin_fanout", "g10_constants", "f1_two_level_top_k",
    "n1_register_checks", "n14_slew_limits", "n22_reconvergence_credit", "o4_exception_priority", "h2_pi_model", "h5_wire_load", "h6_cell_delay", "j4_sum_over_slices",
]


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    spark = local_session(cpus, **{"spark.driver.memory": os.environ.get("BENCH_MEM", "16g")})
    spark.range(1000).selectExpr("sum(id)").collect()
    took = {}
    for q in names:
        t0 = time.time()
        QUERIES[q](spark, d).write.format("noop").mode("overwrite").save()
        took[q] = round(time.time() - t0, 3)
    print(json.dumps({"metric": "total query time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(d.rstrip("/"))}))


if __name__ == "__main__":
    main()
