"""Time the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma-separated names, default the list below).
"""

from __future__ import annotations

import json
import os
import time

from oremill.queries import QUERIES
from oremill.session import local_session

HEADLINE = (
    "baskets_order_brand",
    "item_support",
    "frequent_itemsets",
    "frequent_itemsets_inverted",
    "son_candidates",
    "son_counts",
    "cooccurrence_edges",
    "lpa_labels",
    "connected_components",
    "modularity",
    "edge_betweenness",
    "kmeans_clusters",
    "bfr_ds_summary",
    "bfr_assign",
    "bfr_rounds",
    "bootstrap_batches",
    "bloom_fpr",
    "fm_estimate",
    "reservoir_snapshots",
    "stream_fm",
    "stream_reservoir",
    "stream_bloom",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=max(int(cpus), 1), memory="12g")
    spark.read.parquet(f"{folder}/region.parquet").groupBy().count().collect()  # start the executor
    QUERIES[names[0]](spark, folder).write.format("noop").mode("overwrite").save()  # compiles and warms up
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
