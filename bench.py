"""Time the headline queries; one JSON line."""

from __future__ import annotations

import json
import os
import time

from quillgraph.plans import queries as core
from quillgraph.session import session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
HEADLINE = [
    "locate_refs", "neighborhood", "traverse_both", "induced_subgraph", "filter_attrs", "filter_since", "vector_topk", "mean_incident_confidence",
    "degree_global", "pagerank_fixed_rounds", "hybrid_rank", "edge_upsert_merge", "pending_resolve", "neighborhood_names", "metrics_rank", "token_cost",
]


def main() -> None:
    spark = session()
    known = core.queries()
    known["entry"] = lambda s, d: core.queries()["locate_refs"](s, d)
    known["entry"](spark, SF_DIR).collect()  # starts executors and compiles the reader
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        known[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    sf = os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}), flush=True)


if __name__ == "__main__":
    main()
