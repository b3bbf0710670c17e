"""Headline queries on the benchmark tables; prints one JSON line.

Every result is written in full to the no-op sink, so no column is pruned away.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lodeworks.plans import load_catalog  # noqa: E402
from lodeworks.session import local_session  # noqa: E402

HEADLINE = [
    "field_completeness",
    "amount_summary",
    "price_ratio_distribution",
    "grouped_counts",
    "column_profile",
    "priority_stratified_sample",
    "keep_best_by_name_state",
    "keep_best_normalised_key",
    "reject_reasons",
    "lexicon_tags",
    "contact_handles",
    "token_sets",
    "page_records",
    "range_overlap_penalty",
    "label_lookup_default",
    "validate_results",
    "item_state",
    "greedy_name_or_url",
    "stream_first_seen",
    "stream_item_state",
    "item_history",
    "funnel_steps",
    "match_top",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    catalog = load_catalog()
    # Start the JVM's code paths once, outside the clock.
    spark.read.parquet(f"{sf_dir}/region.parquet").write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalog[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")),
                "settings": {
                    "master": spark.sparkContext.master,
                    "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
                    "driver_memory": spark.conf.get("spark.driver.memory"),
                },
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
