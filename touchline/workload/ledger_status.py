"""Queries over the processing ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline import adapters
from touchline.operators import audits as A
from touchline.operators import ledger as L
from touchline.workload.registry import query

LEDGER_SQL = """
raw AS (SELECT sha256(CAST(o_orderkey AS VARCHAR)) AS sha256, o_orderkey AS replay_no, o_orderkey % 5000 + 100 AS size_bytes, o_orderdate AS first_at FROM orders),
proc AS (
  SELECT sha256(CAST(o_orderkey AS VARCHAR)) AS sha256, CASE o_orderstatus WHEN 'F' THEN 'ok' ELSE 'failed' END AS status,
    o_orderkey % 36000 AS total_frames, (o_orderkey % 36000) / 60.0 AS duration_seconds, o_orderdate + to_seconds(o_orderkey % 86400) AS updated_at
  FROM orders WHERE o_orderstatus IN ('F', 'O')
),
ana AS (
  SELECT sha256(CAST(o_orderkey AS VARCHAR)) AS sha256, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'v1' ELSE 'v2' END AS analyzer_version,
    CASE WHEN o_orderkey % 10 < 7 THEN 'ok' WHEN o_orderkey % 10 < 9 THEN 'failed' ELSE 'retry' END AS status, o_orderkey % 12 AS player_count,
    o_orderkey % 900 AS states, o_orderkey % 5000 AS ticks, o_orderkey % 77 AS evs, o_orderdate + to_seconds(o_orderkey % 86400) AS updated_at
  FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '5-LOW'
),
src AS (
  SELECT 'src/' || o_orderkey AS source_path, CASE WHEN o_orderkey % 9 = 0 THEN 'failed' WHEN o_orderkey % 4 = 0 THEN 'duplicate' ELSE 'archived' END AS status,
    CASE WHEN o_orderkey % 9 = 0 THEN 'read_failed:' || o_orderkey % 3 END AS error, o_orderdate AS last_seen_at FROM orders
)
"""
# A fixed moment for all look-backs.
AS_OF = "1998-07-01 06:00:00"
VERSION = "v2"


def _as_of():
    return F.lit(AS_OF).cast("timestamp")


def _stamp(name):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


@query(
    "unprocessed_queue", "JON-06",
    f"""WITH {LEDGER_SQL} SELECT sha256, replay_no, size_bytes FROM raw WHERE sha256 NOT IN (SELECT sha256 FROM proc)
    ORDER BY first_at, sha256 LIMIT 100""",
)
def unprocessed_queue(spark, folder):
    t = adapters.ledger(spark, folder)
    return L.unprocessed(t["raw"], t["processing"]).select("sha256", "replay_no", "size_bytes")


@query(
    "unanalyzed_queue", "JON-07",
    f"""WITH {LEDGER_SQL} SELECT r.sha256, r.replay_no, r.size_bytes FROM raw r JOIN proc p ON p.sha256 = r.sha256 AND p.status = 'ok'
    LEFT JOIN ana a ON a.sha256 = r.sha256 AND a.analyzer_version = 'v2'
    WHERE a.sha256 IS NULL OR a.status = 'retry' ORDER BY r.first_at, r.sha256 LIMIT 100""",
)
def unanalyzed_queue(spark, folder):
    t = adapters.ledger(spark, folder)
    return L.unanalyzed(t["raw"], t["processing"], t["analysis"], VERSION).select("sha256", "replay_no", "size_bytes")


@query(
    "latest_replays", "JON-08",
    f"""WITH {LEDGER_SQL} SELECT substr(r.sha256, 1, 12) AS id, coalesce(p.status, 'pending') AS processing, coalesce(a.status, 'pending') AS status,
      a.player_count, a.states AS sampled_state_count, strftime(a.updated_at, '%Y-%m-%d %H:%M:%S') AS updated_at
    FROM raw r LEFT JOIN proc p USING (sha256) LEFT JOIN (SELECT * FROM ana WHERE analyzer_version = 'v2') a USING (sha256)
    ORDER BY coalesce(a.updated_at, p.updated_at, r.first_at) DESC, r.sha256 LIMIT 80""",
)
def latest_replays(spark, folder):
    t = adapters.ledger(spark, folder)
    return L.latest_replays(t["raw"], t["processing"], t["analysis"], VERSION).select(
        "id", "processing", "status", "player_count", "sampled_state_count", _stamp("updated_at")
    )


@query(
    "analysis_status_counts", "AGG-11",
    f"WITH {LEDGER_SQL} SELECT analyzer_version, status, count(*) AS n FROM ana GROUP BY ALL",
)
def analysis_status_counts(spark, folder):
    return L.status_counts(adapters.ledger(spark, folder)["analysis"], "analyzer_version")


SNAPSHOT = [
    "raw_unique_replays", "source_archived", "source_duplicates", "source_failed", "processing_ok", "processing_failed",
    "processing_pending", "total_frames_probed", "analysis_ok", "analysis_failed", "analysis_pending",
    "analysis_sampled_states", "analysis_raw_events", "analysis_ticks_reconstructed",
]
SNAPSHOT_SQL = """
cur AS (SELECT * FROM ana WHERE analyzer_version = 'v2'),
base AS (
  SELECT (SELECT count(*) FROM raw) AS raw_unique_replays,
    (SELECT count(*) FROM src WHERE status = 'archived') AS source_archived, (SELECT count(*) FROM src WHERE status = 'duplicate') AS source_duplicates,
    (SELECT count(*) FROM src WHERE status = 'failed') AS source_failed, (SELECT count(*) FROM proc WHERE status = 'ok') AS processing_ok,
    (SELECT count(*) FROM proc WHERE status = 'failed') AS processing_failed, (SELECT count(*) FROM raw) - (SELECT count(*) FROM proc) AS processing_pending,
    (SELECT CAST(coalesce(sum(total_frames), 0) AS BIGINT) FROM proc WHERE status = 'ok') AS total_frames_probed,
    (SELECT round(sum(duration_seconds), 3) FROM proc WHERE status = 'ok') AS duration_seconds_probed,
    (SELECT count(*) FROM cur WHERE status = 'ok') AS analysis_ok, (SELECT count(*) FROM cur WHERE status = 'failed') AS analysis_failed,
    (SELECT count(*) FROM proc WHERE status = 'ok') - (SELECT count(*) FROM cur WHERE status IN ('ok', 'failed')) AS analysis_pending,
    (SELECT CAST(sum(states) AS BIGINT) FROM cur WHERE status = 'ok') AS analysis_sampled_states,
    (SELECT CAST(sum(evs) AS BIGINT) FROM cur WHERE status = 'ok') AS analysis_raw_events,
    (SELECT CAST(sum(ticks) AS BIGINT) FROM cur WHERE status = 'ok') AS analysis_ticks_reconstructed
)
"""


@query(
    "status_snapshot", "AGG-11 AGG-12 AGG-14",
    f"""WITH {LEDGER_SQL}, {SNAPSHOT_SQL} SELECT {', '.join(SNAPSHOT)}, round(100.0 * processing_ok / raw_unique_replays, 2) AS processing_progress_percent,
      round(100.0 * analysis_ok / raw_unique_replays, 2) AS analysis_progress_percent, 0 AS analysis_complete FROM base""",
)
def status_snapshot(spark, folder):
    row = L.status_snapshot(adapters.ledger(spark, folder), VERSION, _as_of())
    return row.select(
        *SNAPSHOT, "processing_progress_percent", "analysis_progress_percent",
        F.col("analysis_complete").cast("int").alias("analysis_complete"),
    )


@query(
    "recent_probe_rate", "AGG-13",
    f"""WITH {LEDGER_SQL}, recent AS (SELECT * FROM proc WHERE updated_at BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL 5 MINUTE AND TIMESTAMP '{AS_OF}')
    SELECT round(coalesce(count(*) / least(5.0, greatest(1.0, (epoch(TIMESTAMP '{AS_OF}') - epoch(min(updated_at))) / 60.0)), 0), 3) AS rate FROM recent""",
)
def recent_probe_rate(spark, folder):
    return L.recent_rate(adapters.ledger(spark, folder)["processing"], _as_of(), "rate")


@query(
    "hourly_activity", "AGG-15",
    f"""WITH {LEDGER_SQL}, hours AS (SELECT TIMESTAMP '{AS_OF}' - to_hours(CAST(h AS INTEGER)) AS hour FROM range(24) t(h))
    SELECT strftime(hour, '%Y-%m-%d %H:%M:%S') AS hour, (SELECT count(*) FROM ana WHERE analyzer_version = 'v2' AND status = 'ok'
      AND date_trunc('hour', updated_at) = hour AND updated_at >= TIMESTAMP '{AS_OF}' - INTERVAL 23 HOUR) AS count FROM hours""",
)
def hourly_activity(spark, folder):
    return L.hourly_activity(adapters.ledger(spark, folder)["analysis"], VERSION, _as_of()).select(_stamp("hour"), "count")


@query(
    "latest_source_failures", "TOP-04",
    f"""WITH {LEDGER_SQL} SELECT source_path, error, strftime(last_seen_at, '%Y-%m-%d %H:%M:%S') AS last_seen_at FROM src
    WHERE status = 'failed' ORDER BY src.last_seen_at DESC, source_path LIMIT 5""",
)
def latest_source_failures(spark, folder):
    return L.latest_failures(adapters.ledger(spark, folder)["sources"]).select("source_path", "error", _stamp("last_seen_at"))


@query(
    "latest_state_per_customer", "WIN-11 SNK-03",
    """SELECT o_custkey, o_orderkey, o_orderstatus FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
)
def latest_state_per_customer(spark, folder):
    rows = adapters.table(spark, folder, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus")
    return L.latest_per_key(rows, ["o_custkey"], "o_orderdate").select("o_custkey", "o_orderkey", "o_orderstatus")


@query(
    "migrated_analysis_versions", "SET-04",
    f"""WITH {LEDGER_SQL}, old AS (SELECT sha256, CASE WHEN replay_no % 3 = 0 THEN 'v1' WHEN replay_no % 3 = 1 THEN 'legacy' ELSE 'v2' END AS analyzer_version,
        CASE WHEN replay_no % 2 = 0 THEN 'ok' ELSE 'failed' END AS status FROM raw)
    SELECT sha256, analyzer_version, status FROM ana UNION ALL SELECT * FROM old WHERE (sha256, analyzer_version) NOT IN (SELECT (sha256, analyzer_version) FROM ana)""",
)
def migrated_analysis_versions(spark, folder):
    t = adapters.ledger(spark, folder)
    no = F.col("replay_no")
    legacy = t["raw"].select(
        "sha256", F.when(no % 3 == 0, "v1").when(no % 3 == 2, "v2").alias("analyzer_version"),
        F.when(no % 2 == 0, "ok").otherwise("failed").alias("status"),
    )
    return L.migrate_versions(legacy, t["analysis"].select("sha256", "analyzer_version", "status"))


@query(
    "recent_ingest_events", "AGG-11",
    """WITH e AS (SELECT CASE event_type WHEN 'click' THEN 'replay_archived' WHEN 'view' THEN 'replay_duplicate' WHEN 'error' THEN 'replay_failed'
        WHEN 'signup' THEN 'replay_disappeared' ELSE 'replay_analyzed' END AS event_type, ts FROM events)
    SELECT k AS event_type, count(ts) AS n FROM (VALUES ('replay_archived'), ('replay_duplicate'), ('replay_failed'), ('replay_disappeared')) v(k)
    LEFT JOIN e ON e.event_type = k AND ts BETWEEN TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 60 MINUTE AND TIMESTAMP '2024-01-15 12:00:00' GROUP BY 1""",
)
def recent_ingest_events(spark, folder):
    kinds = ["replay_archived", "replay_duplicate", "replay_failed", "replay_disappeared"]
    as_of = F.lit("2024-01-15 12:00:00").cast("timestamp")
    return L.recent_event_counts(adapters.runtime_events(spark, folder), as_of, kinds)


@query(
    "snapshot_coherence", "FLT-11",
    "SELECT 'analysis_counts_exceed_processing_ok' AS \"check\", o_orderkey AS row_no FROM orders WHERE o_orderkey % 7 + o_orderkey % 5 + 1 > o_orderkey % 11 "
    "UNION ALL SELECT 'processing_counts_exceed_raw', o_orderkey FROM orders WHERE o_orderkey % 11 + o_orderkey % 3 > o_orderkey % 13",
)
def snapshot_coherence(spark, folder):
    key = F.col("o_orderkey")
    zero = F.lit(0.0)
    rows = adapters.table(spark, folder, "orders").select(
        key, (key % 13).alias("raw_unique_replays"), (key % 11).alias("processing_ok"), (key % 3).alias("processing_failed"),
        F.lit(0).alias("processing_pending"), (key % 7).alias("analysis_ok"), (key % 5).alias("analysis_failed"), F.lit(1).alias("analysis_pending"),
        zero.alias("duration_seconds_probed"), zero.alias("probe_rate_per_minute_5m"), zero.alias("analysis_rate_per_minute_5m"),
    )
    return L.snapshot_violations(rows, F.col("o_orderkey")).select("check", F.col("subject").cast("long").alias("row_no"))


@query(
    "finalization_state", "AUD-11",
    f"WITH {LEDGER_SQL}, {SNAPSHOT_SQL} SELECT CAST(analysis_ok = raw_unique_replays AS INTEGER) AS ready, 0 AS already_finalized, 0 AS finalize_now FROM base",
)
def finalization_state(spark, folder):
    row = L.status_snapshot(adapters.ledger(spark, folder), VERSION, _as_of())
    done = row.select("raw_unique_replays", "analysis_ok", "analysis_ticks_reconstructed")
    return A.finalization_state(row, done).select(*[F.col(c).cast("int").alias(c) for c in ("ready", "already_finalized", "finalize_now")])


@query(
    "content_registration", "SNK-02",
    """WITH f AS (SELECT sha256(text) AS sha256, strlen(text) AS size_bytes, doc_id FROM documents)
    SELECT sha256, substr(sha256, 1, 2) || '/' || substr(sha256, 3, 2) || '/' || sha256 || '.hbr2' AS archive_path, any_value(size_bytes) AS size_bytes
    FROM f GROUP BY sha256 HAVING count(*) FILTER (doc_id % 10 < 3) = 0""",
)
def content_registration(spark, folder):
    from touchline.sources import sinks

    files = adapters.files(spark, folder)
    number = F.substring_index("path", "/", -1).cast("long")
    registry = files.filter(number % 10 < 3).select("sha256").distinct()
    return sinks.new_objects(files, registry)


@query(
    "finalization_versions", "AUD-11",
    """WITH v AS (
      SELECT c_nationkey AS version, count(*) AS raw, count(*) FILTER (NOT (c_nationkey % 3 = 0 AND c_custkey % 10 = 0)) AS ok, count(*) FILTER (c_nationkey % 3 = 0 AND c_custkey % 10 = 0) AS failed
      FROM customer GROUP BY 1)
    SELECT version, CAST(failed = 0 AS INTEGER) AS ready, CAST(failed = 0 AND version % 4 = 0 AS INTEGER) AS already_finalized, CAST(failed = 0 AND version % 4 <> 0 AS INTEGER) AS finalize_now FROM v""",
)
def finalization_versions(spark, folder):
    """One version per nation: some incomplete, some finalised already, some grown since, some never finalised."""
    broken = (F.col("c_nationkey") % 3 == 0) & (F.col("c_custkey") % 10 == 0)
    snapshots = adapters.table(spark, folder, "customer").groupBy(F.col("c_nationkey").alias("version")).agg(
        F.count(F.lit(1)).alias("raw_unique_replays"), F.count_if(~broken).alias("analysis_ok"), F.count_if(broken).alias("analysis_failed"),
        F.lit(0).alias("processing_failed"), F.sum("c_custkey").alias("analysis_ticks_reconstructed"),
    )
    records = ["version", "raw_unique_replays", "analysis_ok", "analysis_ticks_reconstructed"]
    same = snapshots.where("version % 4 = 0").select(records)
    grown = snapshots.where("version % 4 = 1").select("version", *[(F.col(c) - 1).alias(c) for c in records[1:]])
    states = A.finalization_states(snapshots, same.unionByName(grown).unionByName(same), "version")
    return states.select("version", *[F.col(c).cast("int").alias(c) for c in ("ready", "already_finalized", "finalize_now")])


@query(
    "first_coherence_issues", "TOP-04 FLT-11",
    """WITH i AS (SELECT 'processing_counts_exceed_raw' AS "check", CAST(o_orderkey AS VARCHAR) AS subject FROM orders WHERE o_orderkey % 11 + o_orderkey % 3 > o_orderkey % 13)
    SELECT "check", subject, (SELECT count(*) FROM i) AS total, CAST((SELECT count(*) FROM i) > 100 AS INTEGER) AS truncated FROM i ORDER BY "check", subject LIMIT 100""",
)
def first_coherence_issues(spark, folder):
    key = F.col("o_orderkey")
    rows = adapters.table(spark, folder, "orders").select(key.cast("string").alias("subject"), ((key % 11 + key % 3) > key % 13).alias("broken"))
    issues = A.violations(rows, F.col("subject"), {"processing_counts_exceed_raw": F.col("broken")}).select("check", "subject")
    return L.first_issues(issues).withColumn("truncated", F.col("truncated").cast("int"))
