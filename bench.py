"""Times the headline queries at BENCH_SF_DIR on local[BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

from marlstone.plans import catalog
from marlstone.session import session

HEADLINE = "bm25_topk bm25_multi_query cosine_topk hybrid_topk fanout_per_schema term_idf sync_classify reconcile_status folder_rollup chunk_markdown rag_context_pack dup_groups recall_at_k".split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", int(cpus), **{"spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda name, d: catalog.QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
    run("bm25_topk", folder)  # starts the workers and compiles what the queries share
    seconds = {}
    for name in HEADLINE:
        began = time.perf_counter()
        run(name, folder)
        seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    sys.stdout.flush()


if __name__ == "__main__":
    main()
