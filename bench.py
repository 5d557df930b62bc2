"""Benchmark the headline queries.

Runs each query over ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on ``local[$BENCH_CPUS]``
and prints ONE JSON line: {"metric", "value" (total seconds), "unit", "queries", "sf", ...}.
Each query is executed fully with the ``noop`` sink (no collect), after one warm-up run of a
small query so JVM start-up is not charged to the first query.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from kestrel.plans import load_all  # noqa: E402
from kestrel.session import build_session  # noqa: E402

HEADLINE = ["h1_user_7d", "e1_feature_build", "f_text_features", "o5_merge_dedupe", "d1_ks", "d4_psi",
            "m9_threshold_sweep", "h9_strike_history", "o2_candidates", "h1_user_7d_prefix"]


def exchanges(df) -> int:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)", plan))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(master=f"local[{cpus}]", app="kestrel-bench",
                          shuffle_partitions=int(cpus) * 2, extra={"spark.driver.memory": "16g"})
    reg = load_all()
    names = [n for n in HEADLINE if n in reg]
    if len(sys.argv) > 1:
        names = [n for n in reg if any(p in n for p in sys.argv[1:])]
    reg["h6_channel_24h"].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
    times, shuffles = {}, {}
    for n in names:
        df = reg[n].build(spark, sf_dir)
        t0 = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        times[n] = round(time.perf_counter() - t0, 3)
        try:
            shuffles[n] = exchanges(df)
        except Exception:  # noqa: BLE001
            shuffles[n] = None
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf.group(1)) if sf else sf_dir,
                      "cpus": int(cpus), "exchanges": shuffles}))
    spark.stop()


if __name__ == "__main__":
    main()
