"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``: one warm-up, then the median of ``$BENCH_REPEATS`` runs each (1 unless set)."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quillset.plans.registry import QUERIES  # noqa: E402
from quillset.session import build_session  # noqa: E402

HEADLINE = (
    "html_to_text",
    "chunks",
    "document_chunks",
    "doc_id",
    "evidence_spans",
    "quality_scores",
    "review_summary",
    "parse_responses",
    "search_hybrid",
    "exact_dedup",
    "new_vs_existing",
    "near_dedup",
    "near_dedup_global",
    "legacy_dedup",
    "best_page_records",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    settings = {"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g"}
    spark = build_session(f"local[{cpus}]", **settings)
    spark.sparkContext.setLogLevel("OFF")
    times: dict[str, float] = {}
    for name in names:
        runs = []
        for attempt in range(repeats + 1):
            start = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if attempt or repeats == 0:
                runs.append(time.time() - start)
        times[name] = round(statistics.median(runs), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    report = {
        "metric": "headline queries, sum of medians",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")),
        "cpus": int(cpus),
    }
    print(json.dumps(report))


if __name__ == "__main__":
    main()
