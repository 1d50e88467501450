"""Queries over files, replay headers and chat reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline import adapters
from touchline.functions import scalars as fn
from touchline.operators import ingest as I
from touchline.operators import matching as M
from touchline.session import materialize, shared_folder
from touchline.sources import sinks
from touchline.workload.registry import query

FILES_SQL = "files AS (SELECT 'src/' || doc_id AS path, strlen(text) AS size_bytes, sha256(text) AS sha256, source FROM documents)"

MATCH_SQL = """
r AS (
  SELECT *, printf('%02d', o_custkey % 28 + 1) || '-' || strftime(o_orderdate, '%m-%Y') || '-' || printf('%02d', o_custkey % 4) || 'h' || printf('%02d', o_custkey % 60)
      || '-r' || (o_custkey % 20) AS stem, sha256('r' || o_orderkey) AS sha, o_orderkey // 2 AS turn,
    date_trunc('month', o_orderdate) + to_days(CAST(o_custkey % 28 AS INTEGER)) + to_hours(o_custkey % 4) + to_minutes(o_custkey % 60) AS begun FROM orders
),
all_replays AS (
  SELECT sha AS sha256, stem || CASE WHEN turn % 2 = 1 THEN '-' || substr(sha, 1, 8) ELSE '' END || '.hbr2' AS file_name,
    o_orderkey % 3 AS size_bytes, stem, o_orderkey, turn % 2 = 1 AS hashed,
    begun AS clock
  FROM r
),
all_reports AS (
  SELECT 'm' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS message_id, stem, o_orderkey % 3 AS size_bytes, turn % 7 = 0 AS hashed, turn,
    begun
      + to_seconds(CASE turn % 4 WHEN 0 THEN 0 WHEN 1 THEN 45 WHEN 2 THEN 200 ELSE 4000 END) AS clock, o_orderkey, o_custkey
  FROM r
),
replays AS (SELECT * FROM all_replays WHERE o_orderkey % 2 = 0),
reports AS (SELECT * FROM all_reports WHERE o_orderkey % 2 = 1),
cand AS (
  SELECT a.sha256, a.o_orderkey AS rk, a.file_name, b.message_id,
    CASE WHEN a.hashed AND NOT b.hashed THEN 'dce_hashed_asset_filename'
         WHEN NOT a.hashed AND b.hashed THEN 'dce_hashed_attachment_filename' ELSE 'exact_attachment_filename' END AS reason,
    a.size_bytes = b.size_bytes AS same_size, abs(epoch(a.clock) - epoch(b.clock)) AS apart
  FROM replays a JOIN reports b USING (stem)
  WHERE NOT (a.hashed AND b.hashed)
),
scored AS (
  SELECT *, least(CAST(CASE WHEN reason LIKE 'exact%' THEN 0.90 ELSE 0.84 END AS DOUBLE)
    + CAST(CASE WHEN same_size THEN 0.06 ELSE 0 END AS DOUBLE)
    + CAST(CASE WHEN apart <= 60 THEN 0.08 WHEN apart <= 300 THEN 0.03 ELSE 0 END AS DOUBLE), 1.0::DOUBLE) AS score,
    reason || CASE WHEN same_size THEN ',attachment_size_matches' ELSE '' END
      || CASE WHEN apart <= 60 THEN ',timestamp_within_60s' WHEN apart <= 300 THEN ',timestamp_within_5m' ELSE '' END AS reasons
  FROM cand
)
"""

GREEDY_SQL = """
ordered AS (SELECT *, row_number() OVER (ORDER BY score DESC, sha256, message_id) AS n FROM scored),
walk AS (
  SELECT 0::BIGINT AS n, ['']::VARCHAR[] AS used_a, ['']::VARCHAR[] AS used_b, false AS take
  UNION ALL
  SELECT o.n,
    CASE WHEN list_contains(w.used_a, o.sha256) OR list_contains(w.used_b, o.message_id) THEN w.used_a ELSE list_append(w.used_a, o.sha256) END,
    CASE WHEN list_contains(w.used_a, o.sha256) OR list_contains(w.used_b, o.message_id) THEN w.used_b ELSE list_append(w.used_b, o.message_id) END,
    NOT (list_contains(w.used_a, o.sha256) OR list_contains(w.used_b, o.message_id))
  FROM walk w JOIN ordered o ON o.n = w.n + 1
),
matched AS (SELECT o.* FROM ordered o JOIN walk w USING (n) WHERE w.take)
"""
WITH_MATCH = f"WITH RECURSIVE {MATCH_SQL}, {GREEDY_SQL}"


def _sides(spark, folder):
    return adapters.replay_files(spark, folder), adapters.reports(spark, folder)


@query(
    "content_dedupe", "AGG-01 SRC-01",
    f"""WITH {FILES_SQL} SELECT sha256, arg_min(path, lower(path)) AS path, any_value(size_bytes) AS size_bytes, count(*) AS copies
    FROM files GROUP BY sha256""",
)
def content_dedupe(spark, folder):
    return I.content_groups(adapters.files(spark, folder))


@query(
    "duplicate_paths", "AGG-01",
    f"""WITH {FILES_SQL} SELECT sha256, first_path, path FROM
    (SELECT *, min(path) OVER (PARTITION BY sha256) AS first_path FROM files) WHERE path <> first_path""",
)
def duplicate_paths(spark, folder):
    files = adapters.files(spark, folder)
    return I.duplicate_paths(files, I.content_groups(files))


@query(
    "replay_header_probe", "PRJ-01",
    """SELECT o_orderkey AS file_id,
      CASE WHEN o_orderkey % 19 <> 2 THEN CASE WHEN o_orderkey % 13 = 5 THEN 2 ELSE 3 END END AS version,
      CASE WHEN o_orderkey % 19 <> 2 THEN CASE WHEN o_orderkey % 17 = 7 THEN 0 ELSE o_orderkey * 37 % 100000 END END AS total_frames,
      CASE WHEN o_orderkey % 19 <> 2 THEN round(CASE WHEN o_orderkey % 17 = 7 THEN 0 ELSE o_orderkey * 37 % 100000 END / 60.0, 6) END AS duration_seconds,
      CASE WHEN o_orderkey % 19 = 2 THEN 'truncated_header' WHEN o_orderkey % 11 = 3 THEN 'invalid_magic'
           WHEN o_orderkey % 13 = 5 THEN 'unsupported_version:2'
           WHEN o_orderkey % 17 = 7 OR o_orderkey * 37 % 100000 = 0 THEN 'invalid_total_frames' END AS error FROM orders""",
)
def replay_header_probe(spark, folder):
    return I.probe_headers(adapters.replay_contents(spark, folder)).select(
        "file_id", "version", "total_frames", F.round("duration_seconds", 6).alias("duration_seconds"), "error"
    )


@query(
    "report_fields", "PRJ-03 PRJ-04 PRJ-13",
    f"""WITH {MATCH_SQL}
    SELECT message_id, strftime(clock, '%Y-%m-%d %H:%M:%S') AS local_time,
      CASE WHEN turn % 13 <> 0 THEN 'R' || o_orderkey END AS report_id,
      CASE WHEN turn % 13 <> 0 THEN o_orderkey % 7 END AS red_score, CASE WHEN turn % 13 <> 0 THEN o_orderkey % 5 END AS blue_score,
      CASE WHEN turn % 13 <> 0 THEN o_orderkey % 100 + 0.25::DOUBLE END AS possession_red,
      CASE WHEN turn % 13 <> 0 THEN CAST(100 - o_orderkey % 100 AS DOUBLE) END AS possession_blue FROM all_reports""",
)
def report_fields(spark, folder):
    return I.parse_reports(adapters.all_reports(spark, folder)).select(
        "message_id",
        fn.report_time(F.col("timestamp")).cast("string").alias("local_time"),
        "report_id", "red_score", "blue_score", "possession_red", "possession_blue",
    )


@query(
    "replay_name_parts", "PRJ-11 PRJ-12",
    f"""WITH {MATCH_SQL}
    SELECT sha256, stem AS base_stem, strftime(clock, '%Y-%m-%d %H:%M:%S') AS local_time FROM all_replays""",
)
def replay_name_parts(spark, folder):
    return adapters.all_replay_files(spark, folder).select(
        "sha256",
        fn.base_stem(fn.file_stem(F.col("file_name"))).alias("base_stem"),
        fn.replay_time(F.col("file_name")).cast("string").alias("local_time"),
    )


@query(
    "best_report_per_replay", "JON-01",
    f"""WITH {MATCH_SQL} SELECT sha256, message_id, round(score, 4) AS score, reasons FROM scored
    QUALIFY row_number() OVER (PARTITION BY sha256 ORDER BY score DESC, message_id) = 1""",
)
def best_report_per_replay(spark, folder):
    return M.best_reports(*_sides(spark, folder)).withColumn("reasons", F.array_join("reasons", ","))


@query(
    "replay_report_matches", "JON-01 JON-03",
    f"{WITH_MATCH} SELECT sha256 AS replay_sha256, message_id, round(score, 4) AS confidence, reasons FROM matched",
)
def replay_report_matches(spark, folder):
    return M.match_replays(*_sides(spark, folder)).select(
        "replay_sha256", "message_id", "confidence", F.array_join("reasons", ",").alias("reasons")
    )


@query(
    "time_proximity_matches", "JON-02 JON-03",
    f"""WITH RECURSIVE {MATCH_SQL.replace('scored AS (', 'named AS (')},
    scored AS (
      SELECT a.sha256, b.message_id, coalesce(n.score, CAST(CASE WHEN abs(epoch(a.clock) - epoch(b.clock)) <= 60 THEN 0.08 ELSE 0.03 END AS DOUBLE)) AS score,
        coalesce(n.reasons, CASE WHEN abs(epoch(a.clock) - epoch(b.clock)) <= 60 THEN 'timestamp_within_60s' ELSE 'timestamp_within_5m' END) AS reasons
      FROM replays a JOIN reports b ON abs(epoch(a.clock) - epoch(b.clock)) <= 300 OR a.stem = b.stem
      LEFT JOIN named n ON n.sha256 = a.sha256 AND n.message_id = b.message_id
      WHERE n.sha256 IS NOT NULL OR abs(epoch(a.clock) - epoch(b.clock)) <= 300
    ), {GREEDY_SQL}
    SELECT sha256 AS replay_sha256, message_id, round(score, 4) AS confidence, reasons FROM matched""",
)
def time_proximity_matches(spark, folder):
    return M.match_replays(*_sides(spark, folder), minimum=0.03).select(
        "replay_sha256", "message_id", "confidence", F.array_join("reasons", ",").alias("reasons")
    )


@query(
    "canonical_match_rows", "JON-05 PRJ-16",
    f"""{WITH_MATCH} SELECT 1 AS schema_version,
      CASE WHEN b.turn % 13 <> 0 THEN 'R' || b.o_orderkey ELSE 'hbr2:' || substr(m.sha256, 1, 16) END AS match_id, m.sha256 AS replay_sha256,
      'export/' || m.rk || '/' || m.file_name AS replay_source_path, m.message_id AS source_message_id,
      round(m.score, 4) AS match_confidence, CASE WHEN b.turn % 13 <> 0 THEN b.o_orderkey % 7 END AS red_score
    FROM matched m JOIN reports b USING (message_id)""",
)
def canonical_match_rows(spark, folder):
    replays, reports = _sides(spark, folder)
    parsed = I.parse_reports(reports)
    return I.canonical_matches(M.match_replays(replays, reports), replays, parsed).select(
        "schema_version", "match_id", "replay_sha256", "replay_source_path", "source_message_id", "match_confidence",
        "red_score",
    )


@query(
    "unmatched_sides", "JON-04",
    f"""{WITH_MATCH} SELECT 'replay' AS side, 'export/' || o_orderkey || '/' || file_name AS key FROM replays
      WHERE sha256 NOT IN (SELECT sha256 FROM matched)
    UNION ALL SELECT 'report', message_id FROM reports WHERE message_id NOT IN (SELECT message_id FROM matched)""",
)
def unmatched_sides(spark, folder):
    replays, reports = _sides(spark, folder)
    return I.unmatched(materialize(M.match_replays(replays, reports)), replays, reports)


@query(
    "import_manifest", "AGG-02",
    f"""{WITH_MATCH}, {FILES_SQL} SELECT (SELECT count(*) FROM files) AS replay_count, (SELECT count(DISTINCT sha256) FROM files) AS unique_replay_count,
      (SELECT count(*) - count(DISTINCT sha256) FROM files) AS duplicate_replay_count, (SELECT count(*) FROM reports) AS report_count,
      (SELECT count(*) FROM matched) AS match_count, (SELECT count(*) FROM replays) - (SELECT count(*) FROM matched) AS unmatched_replays,
      (SELECT count(*) FROM reports) - (SELECT count(*) FROM matched) AS unmatched_reports,
      (SELECT count(*) FROM orders WHERE o_orderkey % 19 = 2 OR o_orderkey % 11 = 3 OR o_orderkey % 13 = 5 OR o_orderkey % 17 = 7
         OR o_orderkey * 37 % 100000 = 0) AS failures""",
)
def import_manifest(spark, folder):
    replays, reports = _sides(spark, folder)
    files = adapters.files(spark, folder)
    matches = materialize(M.match_replays(replays, reports))
    failures = I.probe_headers(adapters.replay_contents(spark, folder)).filter("error IS NOT NULL")
    return I.import_manifest(
        files, I.content_groups(files), reports, matches, I.unmatched(matches, replays, reports), failures
    )


@query(
    "published_import", "SNK-01 AGG-02",
    f"""{WITH_MATCH}, {FILES_SQL} SELECT name, n, n AS same_lines, 2 AS version FROM (SELECT 'replays' AS name, count(DISTINCT sha256) AS n FROM files
      UNION ALL SELECT 'duplicates', count(*) - count(DISTINCT sha256) FROM files UNION ALL SELECT 'reports', count(*) FROM reports
      UNION ALL SELECT 'matches', count(*) FROM matched UNION ALL SELECT 'manifest', 1)""",
)
def published_import(spark, folder):
    replays, reports = _sides(spark, folder)
    # what several tables and both versions are made of is made once
    reports, files = materialize(reports), adapters.files(spark, folder)
    groups = materialize(I.content_groups(files))
    matches = materialize(M.match_replays(replays, reports))
    failures = I.probe_headers(adapters.replay_contents(spark, folder)).filter("error IS NOT NULL")
    manifest = materialize(I.import_manifest(files, groups, reports, matches, I.unmatched(matches, replays, reports), failures))
    tables = {
        "replays": (groups, ["path"]),
        "duplicates": (I.duplicate_paths(files, groups), ["sha256", "path"]),
        "reports": (reports, ["message_id"]),
        "matches": (matches, ["replay_sha256", "message_id"]),
        "manifest": (manifest, ["replay_count"]),
    }
    root = shared_folder(spark, "import")
    first, last = (sinks.publish_tables(tables, root) for _ in range(2))
    out = None
    for name, (rows, _) in tables.items():
        # what the last version has, and how many of its lines the first one has too
        now, before = (sinks.read_published(spark, root, name, rows.schema, v).select(F.to_json(F.struct("*")).alias("line")) for v in (last, first))
        both = now.groupBy("line").agg(F.count(F.lit(1)).alias("a")).join(before.groupBy("line").agg(F.count(F.lit(1)).alias("b")), "line", "left")
        row = both.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.least("a", F.coalesce("b", F.lit(0)))), F.lit(0)).alias("same_lines")).select(F.lit(name).alias("name"), "n", "same_lines", F.lit(last).alias("version"))
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "import_failure_triage", "AGG-17",
    """SELECT CASE WHEN o_orderkey % 19 = 2 THEN 'truncated_header' WHEN o_orderkey % 11 = 3 THEN 'invalid_magic' ELSE 'other_stage' END AS stage,
      count(*) AS failures FROM orders WHERE o_orderkey % 19 = 2 OR o_orderkey % 11 = 3 OR o_orderkey % 13 = 5 OR o_orderkey % 17 = 7
         OR o_orderkey * 37 % 100000 = 0 GROUP BY 1""",
)
def import_failure_triage(spark, folder):
    failures = I.probe_headers(adapters.replay_contents(spark, folder)).filter("error IS NOT NULL")
    return I.failure_triage(failures.withColumnRenamed("error", "stage"), ["truncated_header", "invalid_magic"])
