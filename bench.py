"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from graphloom.plans import registry
from graphloom.session import local_session

HEADLINE = ["flagship", "gcn_norm", "spmm", "gcn_layer_forward", "gcn_layer_backward", "tile_skew_stats", "tile_write_read_roundtrip", "train_loss_curve"]


def main() -> None:
    sf, repeats = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), int(os.environ.get("BENCH_REPEATS", "2"))
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}
    for name in HEADLINE:
        runs = []
        for k in range(1 + (1 if name == "train_loss_curve" else repeats)):
            began = time.perf_counter()
            registry.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
            spark.catalog.clearCache()
        took[name] = round(statistics.median(runs[1:]), 3)  # the first run compiles
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
