"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from meritlens.session import local_session
from meritlens.workload.registry import QUERIES

HEADLINE = (
    "review_signals", "product_proxy_signals", "split_summary", "good_value_posterior", "review_fusion",
    "product_review_score", "nb_graph_cpd", "nb_graph_predict", "auc_ap", "disjoint_split", "topk_similar",
    "combined_value", "neighbor_rerank", "dense_knn", "top_terms", "column_profile",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    QUERIES["review_signals"](spark, folder).write.format("noop").mode("overwrite").save()  # warm-up
    seconds = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
