"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line with the median of two warm runs of each."""

import contextlib
import io
import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["vector_topk", "bm25_topk", "bm25_stats", "hybrid_rrf", "chunk_window", "grep_literal", "grep_regex", "doc_dedup", "content_sha", "text_coverage", "tag_tree", "upsert_points"]


def main() -> None:
    from lodestar.queries import QUERIES
    from lodestar.session import get_session

    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    with contextlib.redirect_stdout(io.StringIO()):
        spark = get_session(f"local[{cpus}]", "bench", int(cpus), **{"spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g")})
        spark.sparkContext.setLogLevel("ERROR")
        took = {}
        for name in HEADLINE:
            runs = []
            for _ in range(3):
                start = time.perf_counter()
                QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
                runs.append(time.perf_counter() - start)
            took[name] = round(statistics.median(runs[1:]), 3)
    print(json.dumps({"metric": "total of median seconds of warm runs", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
