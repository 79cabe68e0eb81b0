"""Times the headline queries and prints one line of JSON.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores.  Each query runs
once to warm up, then three times; its time is the median.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path
from statistics import median

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])

HEADLINE = (
    "j5_latest_return_asof", "j5_prices_asof", "j5_many_asof", "j3_price_at_or_before", "w1_returns", "w2_volatility", "w4_zscore", "w11_rolling_beta", "w5_w6_w7_all_series", "a10_covariance", "a18_calibration",
    "a19_auc", "i12_books", "o5_blend", "b7_navs", "m6_walk_forward_scores", "m8_m9_m10_asof_scores", "k1_upsert", "r1_snapshot", "r4_playbooks", "j22_all_paths",
)


def main() -> None:
    from pitframe.plans import catalog
    from pitframe.session import build

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = build("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    times = {}
    for name in HEADLINE:
        took = []
        for i in range(4):
            began = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i:
                took.append(time.perf_counter() - began)
        times[name] = round(median(took), 3)
    print(json.dumps({"metric": "headline queries, sum of warm medians", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": Path(sf_dir).name.removeprefix("sf"), "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
