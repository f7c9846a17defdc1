"""Times headline queries: one warm-up, then five runs each. Prints one JSON line: medians, with least and greatest beside."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path
from statistics import median

sys.path.insert(0, str(Path(__file__).resolve().parent))

from fringeflow.plans import registry  # noqa: E402
from fringeflow.session import local_session, sweep  # noqa: E402

HEADLINE = (
    "visstat_by_user_type", "visstat_flagged", "flag_summary", "flag_quack_beg", "flag_extend_time", "time_average_scan", "statwt_block", "statwt_sliding_time", "smoothcal_mean",
    "cal_asof_linear", "scan_assign_interval", "hanning", "boxcar", "continuum_sub_order1", "moments", "collapse_median", "image_smooth", "image_rebin", "region_polygon",
    "uvbin_weighted", "weights_briggs", "applycal", "slsearch", "phase_shift",
)
RUNS = 5


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores, cores, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    known = registry.queries()
    times, least, most = {}, {}, {}
    for name in HEADLINE:
        runs = []
        for _ in range(RUNS + 1):
            began = time.perf_counter()
            known[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        warm = runs[1:]
        times[name], least[name], most[name] = round(median(warm), 4), round(min(warm), 4), round(max(warm), 4)
    sweep(spark)
    print(
        json.dumps(
            {
                "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf, "cores": cores, "master": spark.sparkContext.master,
                "shuffle_partitions": int(spark.conf.get("spark.sql.shuffle.partitions")), "runs": RUNS, "min": least, "max": most,
            }
        )
    )


if __name__ == "__main__":
    main()
