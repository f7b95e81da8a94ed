"""Benchmark of the headline queries; prints one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the tables and the number of cores. A warm-up, not timed,
materialises the tables that several operators share; their own cost is what the ``t*``,
``d4``, ``f4``, ``f12``, ``f21``, ``h1``, ``l3`` and ``j5`` entries time. Every headline query
is then timed once, written to the ``noop`` sink so that all rows and columns are produced.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from vintara import plans  # noqa: E402
from vintara.session import local_session  # noqa: E402

WARM_UP = ["h3_h4_band_scores", "j12_outside_shares", "g3_b10_revision_summary", "g4_b22_level_revisions"]
HEADLINE = [
    "t3_panel", "t6_vintages", "d4_report_panel", "e2_common_panel_rank", "f4_evaluation", "f7_bias_by_horizon", "f9_versus_naive",
    "f12_level_errors", "f13_level_summary", "f23_efficiency", "f30_downturn_risk", "g3_b10_revision_summary", "g4_b22_level_revisions",
    "g6_publication_revisions", "c7_as_of_join", "f21_f27_f32_projection_bands", "h1_h2_realtime_predictions", "h3_h4_band_scores",
    "l3_l4_l5_extended_errors", "l10_smooth_bands", "p7_p8_multipliers", "s2_scenarios", "j5_ratios_to_horizon", "j6_j7_trajectories",
    "j12_j13_aggregate_control", "a15_indexed_series",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4)))
    spark = local_session(cpus=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    queries, timings = plans.queries(), {}
    for name in [*WARM_UP, *HEADLINE]:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
    timings = {name: timings[name] for name in HEADLINE}
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(timings.values()), 3), "unit": "sec",
                      "queries": timings, "sf": Path(sf_dir).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
