"""Times the headline queries at ``$BENCH_SF_DIR`` and prints one JSON line.

The session is warmed up on the first query.  Every query writes all of its rows to the no-op
sink, so that no column is pruned away; it runs three times, and fewer once ``$BENCH_BUDGET``
seconds (600) are used, and its median counts.  Queries share nothing but the session.
"""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pactlens.plans.queries import QUERIES  # noqa: E402
from pactlens.session import local_session  # noqa: E402

HEADLINES = [
    "c4_clean_text", "g10_clause_ids", "k9_classify", "t4_assign_levels", "s7_ingest", "r1_index", "r7_search",
    "x31_relationships", "q17_verdict", "d1_attention_counts", "d6_exposure_matrix", "e3_category_summary",
    "e6_retrieval_metrics", "e9_pair_detection", "e19_latency", "document_overview",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    began, runs = time.time(), {name: [] for name in HEADLINES}

    def once(name: str) -> float:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.time() - start

    once(HEADLINES[0])
    for turn in range(3):
        for name in HEADLINES:
            # The first turn is always whole; a later run starts only if it should end in time.
            if turn and time.time() - began + runs[name][0] > float(os.environ.get("BENCH_BUDGET", "600")):
                continue
            runs[name].append(once(name))
            print(name, turn + 1, round(runs[name][-1], 3), file=sys.stderr, flush=True)
    seconds = {name: round(median(taken), 3) for name, taken in runs.items()}
    print(json.dumps({
        "metric": "total wall time of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "runs": {n: len(r) for n, r in runs.items()}, "sf": os.path.basename(folder.rstrip("/")).replace("sf", ""),
    }))


if __name__ == "__main__":
    main()
