"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from scoreloom.plans import catalog
from scoreloom.session import get_spark

HEADLINE = {
    "matchup_table": "A01_matchup_summary",
    "distribution": "A03_distribution_lineitem",
    "evaluation_metrics": "A06_evaluation_metrics",
    "choice_sets": "A07_choice_set_counts",
    "payoff_matrix": "A19_payoff_matrix",
    "measurement_cells": "A25_cell_summary",
    "reliability": "C01_reliability_summary",
    "rating_fit": "R01_fit_ratings",
    "rating_bootstrap_200": "R03_bootstrap_ratings",
    "spearman": "R13_spearman",
    "worlds_enumerate": "B01_enumerate_worlds",
    "worlds_prior_update": "B06_update",
    "quota_top_k": "W04_quota_top_parts",
    "landmarks": "W04_select_landmarks",
    "advantages": "W12_gae",
    "continuation_join": "J05_continuation",
    "split_by_game": "X01_split_by_game",
    "rating_residuals": "R02_rating_residuals",
    "latency_series": "A43_belief_player_cost",
    "belief_tracking": "B15_track_records",
    "live_beliefs": "Z01_live_beliefs",
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"), "spark.log.level": "ERROR",
        },
    )
    # One small query first, so that session start-up is not charged to a headline query.
    catalog.QUERIES["A02_seat_advantage"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for label, name in HEADLINE.items():
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[label] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
             "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
