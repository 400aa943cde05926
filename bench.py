"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (folder of the tables), BENCH_CPUS, BENCH_REPEAT, BENCH_QUERIES (names, or "all").
Each query runs once to warm up; the value is the median of the further runs.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from factweave.plans.catalog import QUERIES  # noqa: E402
from factweave.session import local_session  # noqa: E402
from factweave.sources.corpus import SCAN_TASKS  # noqa: E402

HEADLINE = (
    "eval_summary",
    "bleu_documents",
    "normalize_text",
    "completion_validate",
    "line_parse",
    "decomposer_examples",
    "parser_examples",
    "positional_split",
    "epoch_order",
    "batch_pad",
    "paraphrase_regroup",
    "shuffle_facts",
    "relabel_entities",
    "best_of_n",
    "rank_candidates",
    "semantic_rerank",
    "running_best",
    "early_stop",
    "retention",
    "complete_stub",
    "generate_stub",
    "pending_anti",
)


def seconds(spark, folder: str, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else chosen.split(",") if chosen else list(HEADLINE)
    # The given files have one row group each: deal them out, as a corpus of many files needs not.
    spark = local_session(cpus, "bench", **{"spark.sql.shuffle.partitions": cpus, SCAN_TASKS: cpus})
    times = {}
    for name in names:
        seconds(spark, folder, name)
        times[name] = round(statistics.median(seconds(spark, folder, name) for _ in range(repeat)), 4)
    scale = re.search(r"sf([0-9.]+)$", folder)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 4),
                "unit": "sec",
                "queries": times,
                "sf": float(scale.group(1)) if scale else folder,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
