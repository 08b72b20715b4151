"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the cores.
Every result is written to the no-op sink, so all of its rows and columns are computed.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "agg14_weak_areas",
    "agg15_weak_concepts",
    "agg10_workspace_overview",
    "agg11_workspace_stats",
    "agg12_performance_analysis",
    "agg36_period_report",
    "join4_due_questions",
    "join5_question_performance",
    "win1_latest_answers",
    "win3_study_streak",
    "top4_adaptive_questions",
    "sm2_3_replay",
    "doc1_clean_text",
    "doc3_quality_counts",
    "doc4_language_counts",
    "join7_near_duplicates",
    "doc6_preparation_stats",
    "sea1_content_search",
    "join8_vector_top_k",
    "topic6_topic_words",
    "topic2_threshold_clusters",
    "win4_context_windows",
    "join18_inc1_changes",
    "str1_activity_windows",
]


def main() -> None:
    from tutorloom.plans import catalog
    from tutorloom.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    spark = build_session(
        "bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "20g", "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("OFF")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # start the JVM's compilers
    seconds: dict[str, float] = {}
    for name in only or HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": float(sf.group(1)) if sf else None}))


if __name__ == "__main__":
    main()
