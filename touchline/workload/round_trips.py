"""Queries that write through a sink and read the result back."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline import adapters
from touchline.functions.scalars import holdout_bucket
from touchline.operators import ingest as I
from touchline.operators import players as P
from touchline.session import shared_folder
from touchline.sources import files, sinks
from touchline.workload.imports import FILES_SQL
from touchline.workload.ledger_status import LEDGER_SQL
from touchline.workload.pitch_positions import EXAMPLES_SQL, NEIGHBOUR_SQL, POSITIONS_SQL, examples
from touchline.workload.player_ratings import CAREER_SQL, PLAYER_MATCH_SQL
from touchline.workload.registry import query


@query(
    "published_inventory", "SNK-01 AGG-01",
    f"WITH {FILES_SQL} SELECT sha256, min(path) AS path, any_value(size_bytes) AS size_bytes, count(*) AS copies FROM files GROUP BY sha256",
)
def published_inventory(spark, folder):
    groups = I.content_groups(adapters.files(spark, folder))
    path = f"{shared_folder(spark, 'published')}/replays"
    sinks.publish_json(groups, path, ["path"])
    sinks.publish_json(groups, path, ["path"])
    return spark.read.schema(groups.schema).json(path)


@query(
    "feature_shard_index", "SNK-04 ML-01 SET-01",
    f"""WITH {POSITIONS_SQL}, {NEIGHBOUR_SQL}, {EXAMPLES_SQL}
    SELECT CASE WHEN CAST('0x' || substr(sha256('holdout-v1:' || sha256(CAST(replay AS VARCHAR))), 1, 16) AS UBIGINT) % 10 = 0 THEN 'holdout' ELSE 'train' END AS split,
      count(*) AS samples, count(DISTINCT replay) AS replays, count(DISTINCT player) AS players FROM examples WHERE dir_x IS NOT NULL GROUP BY 1""",
)
def feature_shard_index(spark, folder):
    held = holdout_bucket(F.sha2(F.col("replay").cast("string"), 256), 10) == 0
    rows = examples(spark, folder).filter(F.col("dir_x").isNotNull()).withColumn("split", F.when(held, "holdout").otherwise("train"))
    path = f"{shared_folder(spark, 'shards')}/shards"
    sinks.write_shards(rows, path)
    return sinks.shard_index(spark.read.parquet(path))


@query(
    "appended_event_log", "SNK-05",
    "SELECT event_type, count(*) * 2 AS n FROM events GROUP BY ALL",
)
def appended_event_log(spark, folder):
    rows = adapters.table(spark, folder, "events").select("event_id", "event_type", "ts")
    path = f"{shared_folder(spark, 'log')}/events"
    sinks.append_log(rows, path)
    sinks.append_log(rows, path)
    return spark.read.parquet(path).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "ledger_tables", "SRC-06 SNK-03 WIN-11",
    f"""WITH {LEDGER_SQL} SELECT 'replay_processing' AS name, status, count(*) AS n FROM proc GROUP BY status
    UNION ALL SELECT 'replay_analysis_versions', CASE WHEN status = 'retry' THEN 'ok' ELSE status END, count(*) FROM ana GROUP BY 2""",
)
def ledger_tables(spark, folder):
    tables = adapters.ledger(spark, folder)
    root = shared_folder(spark, "ledger")
    events = adapters.runtime_events(spark, folder)
    names = {"source_files": tables["sources"], "raw_replays": tables["raw"], "replay_processing": tables["processing"],
             "replay_analysis_versions": tables["analysis"], "runtime_events": events}
    for name, rows in names.items():
        sinks.append_states(rows, f"{root}/{name}")
    # A retry that succeeds later is one more row; the newest row per key counts.
    later = tables["analysis"].filter("status = 'retry'").withColumn("status", F.lit("ok"))
    later = later.withColumn("updated_at", F.timestamp_seconds(F.unix_timestamp("updated_at") + 60))
    sinks.append_states(later, f"{root}/replay_analysis_versions")
    read = files.read_ledger(spark, root)
    current = sinks.read_states(read["replay_analysis_versions"], ["sha256", "analyzer_version"])
    count = lambda df, name: df.groupBy(F.lit(name).alias("name"), "status").agg(F.count(F.lit(1)).alias("n"))
    return count(read["replay_processing"], "replay_processing").unionByName(count(current, "replay_analysis_versions"))


@query(
    "player_table_csv", "SNK-06 TOP-02",
    f"""WITH {PLAYER_MATCH_SQL}, {CAREER_SQL} SELECT player_id, name, CAST(matches AS VARCHAR) AS matches FROM scored
    ORDER BY involvement_score DESC, scored.matches DESC, player_id LIMIT 25""",
)
def player_table_csv(spark, folder):
    path = f"{shared_folder(spark, 'csv')}/players"
    sinks.write_csv(P.player_table(adapters.player_match(spark, folder)), path)
    return spark.read.csv(path, header=True).select("player_id", "name", "matches")
