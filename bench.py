"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from touchline.session import build_session
from touchline.workload import ENTRIES

HEADLINE = [
    "player_career_rates",
    "player_table_by_involvement",
    "player_touch_totals",
    "kick_outcomes",
    "goal_touch_credits",
    "goal_kick_credits",
    "skill_leaderboard",
    "training_manifest_replays",
    "event_pressure",
    "nearest_players_in_frame",
    "imitation_examples",
    "temporal_feature_stack",
    "replay_report_matches",
    "content_dedupe",
    "match_quality",
    "challenger_gate",
    "status_snapshot",
    "threshold_sweep",
    "inventory_digest",
    "leaderboard_audit",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g")},
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in HEADLINE:
        start = time.time()
        ENTRIES[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    spark.stop()
    scale = os.path.basename(os.path.normpath(folder)).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
            }
        )
    )


if __name__ == "__main__":
    main()
