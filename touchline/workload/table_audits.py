"""Queries that audit published tables. The given tables carry faults of every audited kind."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline import adapters
from touchline.functions import scalars as fn
from touchline.operators import audits as A
from touchline.operators import curation as C
from touchline.operators import evaluation as E
from touchline.operators.sequences import rank_within
from touchline.plans.rating import leaderboard
from touchline.workload.curation_gates import RUNS_SQL
from touchline.workload.imports import FILES_SQL
from touchline.workload.registry import query


def _checks(alias, cases):
    """UNION ALL of (subject, check) selections."""
    return " UNION ALL ".join(f"SELECT {s} AS subject, '{n}' AS \"check\" FROM {t} WHERE {c}" for n, s, t, c in cases)


BOARD_SQL = """
lb AS (
  SELECT c_custkey AS row_no, CASE WHEN c_custkey % 61 = 0 THEN c_name || ' ' WHEN c_custkey % 97 = 5 THEN 'Customer#x' ELSE c_name END AS player_id,
    c_nationkey % 5 AS role_no, c_custkey % 50 AS matches, c_acctbal / 10 AS minutes, round(2.5 - c_custkey / 400.0::DOUBLE % 5.2::DOUBLE, 4) AS z,
    CASE WHEN c_custkey % 71 = 0 THEN 1 ELSE 0 END AS off, (c_custkey % 40) / 10.0::DOUBLE - CASE WHEN c_custkey % 67 = 0 THEN 9 ELSE 0 END AS unc,
    (c_custkey % 220) AS mate, (c_custkey % 210) AS opp
  FROM customer
),
lr AS (SELECT *, greatest(20.0, least(80.0, 50 + 10 * z)) + off AS rating FROM lb),
lo AS (SELECT *, lag((rating, -unc, matches)) OVER (ORDER BY row_no) AS prev FROM lr)
"""


@query(
    "leaderboard_audit", "AUD-02 AUD-01",
    f"""WITH {BOARD_SQL} {_checks('', [
        ('player_id', 'player_id', 'lr', "player_id <> trim(player_id)"), ('role', 'player_id', 'lr', 'role_no = 4'),
        ('matches', 'player_id', 'lr', 'matches < 1'), ('minutes', 'player_id', 'lr', 'minutes < 0'),
        ('rating', 'player_id', 'lr', 'rating > 80 OR rating < 20'), ('rating_uncertainty', 'player_id', 'lr', 'unc < 0'),
        ('overall_z', 'player_id', 'lr', 'abs(z) > 3.25'), ('average_teammate_context', 'player_id', 'lr', 'mate < 5 OR mate > 205'),
        ('average_opponent_context', 'player_id', 'lr', 'opp < 5 OR opp > 205'), ('rating_inconsistent', 'player_id', 'lr', 'off = 1'),
        ('not_in_rating_order', 'player_id', 'lo', '(rating, -unc, matches) > prev')])}
      UNION ALL SELECT player_id, 'duplicate_player_id' FROM lr GROUP BY player_id HAVING count(*) > 1""",
)
def leaderboard_audit(spark, folder):
    rows = adapters.published_leaderboard(spark, folder)
    return A.audit_leaderboard(rows, dimensions=False).select("subject", "check")


@query("clean_leaderboard_audit", "AUD-02")
def clean_leaderboard_audit(spark, folder):
    from touchline.session import materialize

    rows = materialize(leaderboard(adapters.player_match(spark, folder)))
    numbered = rows.orderBy(F.desc("rating"), "rating_uncertainty", F.desc("matches"), "player_id").withColumn(
        "row_no", F.monotonically_increasing_id()
    )
    return A.receipt(A.audit_leaderboard(materialize(numbered)))


MANIFEST_SQL = """
man AS (
  SELECT o_orderkey AS k, sha256(CAST(o_orderkey AS VARCHAR)) AS sha, o_orderkey % 20000 AS tf,
    CASE WHEN o_orderkey % 59 = 0 THEN 'train' WHEN CAST('0x' || substr(sha256('holdout-v1:' || sha256(CAST(o_orderkey AS VARCHAR))), 1, 16) AS UBIGINT) % 10 = 0
      THEN 'holdout' ELSE 'train' END AS split,
    CAST('0x' || substr(sha256('holdout-v1:' || sha256(CAST(o_orderkey AS VARCHAR))), 1, 16) AS UBIGINT) % 10 = 0 AS held FROM orders
)
"""


@query(
    "manifest_audit", "AUD-03 PRJ-15",
    f"""WITH {MANIFEST_SQL} {_checks('', [
        ('raw_path', 'sha', 'man', 'k % 31 = 0'), ('analysis_path', 'sha', 'man', 'k % 37 = 0'), ('total_frames', 'sha', 'man', 'tf < 1'),
        ('duration_seconds', 'sha', 'man', 'k % 41 = 0'), ('selected_player_count', 'sha', 'man', 'k % 5 = 0'),
        ('example_weight', 'sha', 'man', 'k % 43 = 0'), ('wrong_split', 'sha', 'man', "held <> (split = 'holdout')")])}""",
)
def manifest_audit(spark, folder):
    key = F.col("o_orderkey")
    sha = F.sha2(key.cast("string"), 256)
    frames = key % 20000
    held = fn.holdout_bucket(sha, 10) == 0
    rows = adapters.table(spark, folder, "orders").select(
        sha.alias("replay_sha256"),
        F.concat(F.when(key % 31 == 0, "elsewhere/").otherwise("raw/"), A.archive_path(sha)).alias("raw_path"),
        F.concat(F.lit("analysis/"), sha, F.when(key % 37 == 0, ".txt").otherwise(".json")).alias("analysis_path"),
        frames.alias("total_frames"),
        (F.bround(frames / 60.0, 3) + F.when(key % 41 == 0, 0.5).otherwise(0.0)).alias("duration_seconds"),
        (key % 5).alias("selected_player_count"),
        F.when(key % 43 == 0, 2.5).otherwise(1.0).alias("example_weight"),
        F.when(key % 59 == 0, "train").when(held, "holdout").otherwise("train").alias("split"),
    )
    return A.audit_manifest_replays(rows).select("subject", "check")


SHARD_SQL = """
sh AS (
  SELECT o_orderkey AS k, sha256(CAST(o_orderkey // CASE WHEN o_orderkey % 97 = 1 THEN 2 ELSE 1 END AS VARCHAR)) AS sha,
    CASE WHEN o_orderkey % 10 = 0 THEN 'holdout' ELSE 'train' END AS split, o_orderkey % 211 AS samples, o_orderkey % 7 AS skipped,
    o_orderkey % 4 + 1 AS req, o_orderkey % 4 + 1 + CASE WHEN o_orderkey % 79 = 0 THEN 1 ELSE -(o_orderkey % 2) END AS seen, o_orderkey % 3001 AS bytes FROM orders
),
tot AS (SELECT split, count(*) AS n, sum(samples) AS samples, sum(bytes) AS bytes, sum(seen) AS seen, sum(skipped) AS skipped FROM sh GROUP BY split)
"""


def _shard_totals(entries):
    return entries.groupBy("split").agg(
        F.count(F.lit(1)).alias("successful_replays"), (F.count(F.lit(1)) + 3).alias("requested_replays"),
        F.when(F.col("split") == "train", 2).otherwise(3).alias("failed_replays"),
        (F.sum("samples") + F.when(F.col("split") == "holdout", 1).otherwise(0)).alias("samples"),
        F.sum("compressed_bytes").alias("compressed_bytes"), F.sum("selected_players_seen").alias("selected_players_seen"),
        F.sum("skipped_unknown_input").alias("skipped_unknown_input"),
    )


@query(
    "shard_index_audit", "AUD-04",
    f"""WITH {SHARD_SQL} {_checks('', [
        ('samples_nonpositive', 'sha', 'sh', 'samples = 0'), ('sample_accounting', 'sha', 'sh', 'k % 83 = 0'),
        ('selected_players_seen_exceeds_requested', 'sha', 'sh', 'seen > req'), ('incomplete_reconstruction', 'sha', 'sh', 'k % 73 = 0'),
        ('compressed_bytes_nonpositive', 'sha', 'sh', 'bytes = 0'), ('index_status', 'sha', 'sh', 'k % 89 = 0'),
        ('total:samples', 'split', 'tot', "split = 'holdout'"), ('total:requested', 'split', 'tot', "split = 'train'")])}
      UNION ALL SELECT sha, 'duplicate_replay' FROM sh GROUP BY sha HAVING count(*) > 1""",
)
def shard_index_audit(spark, folder):
    entries = adapters.shard_entries(spark, folder)
    return A.audit_shard_index(entries, _shard_totals(entries)).select("subject", "check")


_RECORD_FIELDS = {"split": "split", "samples": "samples", "skipped_unknown_input": "skipped", "selected_players_requested": "req", "compressed_bytes": "bytes"}


@query(
    "shard_record_audit", "AUD-04",
    f"""WITH {SHARD_SQL}, rec AS (SELECT o_orderkey AS k, sha256(CAST(o_orderkey AS VARCHAR)) AS sha, CASE WHEN (o_orderkey % 10 = 0) <> (o_orderkey % 107 = 0) THEN 'holdout' ELSE 'train' END AS split,
      CASE WHEN o_orderkey % 103 <> 0 THEN o_orderkey % 211 + CASE WHEN o_orderkey % 101 = 0 THEN 1 ELSE 0 END END AS samples, o_orderkey % 7 AS skipped, o_orderkey % 4 + 1 AS req,
      o_orderkey % 3001 + CASE WHEN o_orderkey % 109 = 0 THEN 1 ELSE 0 END AS bytes FROM orders WHERE o_orderkey % 113 <> 0)
    SELECT sh.sha AS subject, 'shard_record_missing' AS "check" FROM sh WHERE sha NOT IN (SELECT sha FROM rec)
    {' '.join(f"UNION ALL SELECT sh.sha, 'index_meta_mismatch:{n}' FROM sh JOIN rec ON sh.sha = rec.sha WHERE sh.{s} IS DISTINCT FROM rec.{s}" for n, s in _RECORD_FIELDS.items())}""",
)
def shard_record_audit(spark, folder):
    key = F.col("o_orderkey")
    side = (key % 10 == 0) != (key % 107 == 0)
    plus = lambda p: F.when(key % p == 0, 1).otherwise(0)
    records = adapters.table(spark, folder, "orders").filter(key % 113 != 0).select(
        F.sha2(key.cast("string"), 256).alias("replay_sha256"), F.when(side, "holdout").otherwise("train").alias("split"),
        F.when(key % 103 != 0, key % 211 + plus(101)).alias("samples"), (key % 7).alias("skipped_unknown_input"), (key % 4 + 1).alias("selected_players_requested"),
        (key % 3001 + plus(109)).alias("compressed_bytes"),
    )
    entries = adapters.shard_entries(spark, folder)
    found = A.audit_shard_index(entries, _shard_totals(entries), records)
    return found.filter(F.col("check").startswith("index_meta_mismatch") | (F.col("check") == "shard_record_missing")).select("subject", "check")


@query(
    "shard_bundle_audit", "AUD-05 SET-02",
    f"""WITH {SHARD_SQL} SELECT split || '|' || sha AS subject, 'duplicate_replay' AS "check" FROM sh GROUP BY split, sha HAVING count(*) > 1
    UNION ALL SELECT sha, 'cross_split_leakage' FROM (SELECT sha FROM sh WHERE split = 'train' INTERSECT SELECT sha FROM sh WHERE split = 'holdout')
    UNION ALL SELECT 'bundle', 'setting_differs:largest'""",
)
def shard_bundle_audit(spark, folder):
    entries = adapters.shard_entries(spark, folder)
    settings = entries.groupBy("split").agg(F.lit(6).alias("sample_every_ticks"), F.sum("samples").alias("largest"))
    return A.audit_shard_bundle(entries, settings).select("subject", "check")


@query(
    "archive_audit", "AUD-06",
    f"""WITH {FILES_SQL}, reg AS (SELECT *, CAST(split_part(path, '/', 2) AS BIGINT) AS no FROM files) {_checks('', [
        ('archive_missing', 'sha256', 'reg', 'no % 23 = 0'), ('size_mismatch', 'sha256', 'reg', 'no % 29 = 0 AND no % 23 <> 0'),
        ('sha256_mismatch', 'sha256', 'reg', 'no % 31 = 0 AND no % 23 <> 0'), ('content_address_path_mismatch', 'sha256', 'reg', 'true')])}""",
)
def archive_audit(spark, folder):
    no = F.substring_index("path", "/", -1).cast("long")
    files = adapters.files(spark, folder)
    registry = files.select(
        F.when(no % 31 == 0, F.reverse("sha256")).otherwise(F.col("sha256")).alias("claimed"),
        F.col("path").alias("archive_path"),
        (F.col("size_bytes") + F.when(no % 29 == 0, 1).otherwise(0)).alias("size_bytes"),
        F.col("sha256").alias("truth"),
    )
    stored = files.filter(no % 23 != 0).select(
        F.col("path").alias("archive_path"), F.col("size_bytes").alias("length"), F.col("sha256").alias("content_sha256")
    )
    found = A.audit_archive(registry.withColumnRenamed("claimed", "sha256"), stored)
    names = registry.select(F.col("claimed").alias("subject"), "truth").distinct()
    return found.join(names, "subject").select(F.col("truth").alias("subject"), "check")


@query(
    "metric_block_audit", "AUD-07",
    """WITH m AS (SELECT p_partkey AS k, p_size % 7 + 1 AS tp, p_partkey % 5 AS fp, p_partkey % 3 AS fn, p_size AS tn FROM part)
    SELECT CAST(k AS VARCHAR) AS subject, 'confusion_does_not_sum_to_samples' AS "check" FROM m WHERE k % 53 = 0
    UNION ALL SELECT CAST(k AS VARCHAR), 'kick_f1_inconsistent' FROM m WHERE k % 59 = 0
    UNION ALL SELECT CAST(k AS VARCHAR), 'kick_f1_range' FROM m WHERE k % 59 = 0
    UNION ALL SELECT CAST(k AS VARCHAR), unnest(['kick_true_rate_inconsistent', 'kick_predicted_rate_inconsistent', 'always_no_kick_accuracy_inconsistent'])
      FROM m WHERE k % 53 = 0 AND tn + fp > 0
    UNION ALL SELECT CAST(k AS VARCHAR), unnest(['kick_true_rate_inconsistent', 'kick_predicted_rate_inconsistent']) FROM m WHERE k % 53 = 0 AND tn + fp = 0""",
)
def metric_block_audit(spark, folder):
    key = F.col("p_partkey")
    rows = adapters.table(spark, folder, "part").select(
        key.alias("k"), (F.col("p_size") % 7 + 1).alias("tp"), (key % 5).alias("fp"), (key % 3).alias("fn"), F.col("p_size").alias("tn")
    )
    total = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    precision, recall = F.col("tp") / (F.col("tp") + F.col("fp")), F.col("tp") / (F.col("tp") + F.col("fn"))
    blocks = rows.select(
        "*", (total + F.when(F.col("k") % 53 == 0, 1).otherwise(0)).alias("samples"), precision.alias("kick_precision"), recall.alias("kick_recall"),
        F.when(F.col("k") % 59 == 0, 1.5).otherwise(2.0 * precision * recall / (precision + recall)).alias("kick_f1"),
        ((F.col("tp") + F.col("fn")) / total).alias("kick_true_rate"), ((F.col("tp") + F.col("fp")) / total).alias("kick_predicted_rate"),
        ((F.col("tn") + F.col("fp")) / total).alias("always_no_kick_accuracy"),
    )
    return A.audit_metrics(blocks, F.col("k")).select("subject", "check")


@query(
    "training_statistics_audit", "AUD-07 AGG-18",
    f"""WITH s AS (SELECT l_partkey AS k FROM lineitem GROUP BY 1) {_checks('', [
        ('direction_counts_do_not_sum_to_samples', 'CAST(k AS VARCHAR)', 's', 'k % 13 = 0 AND k % 37 <> 0 AND k % 43 <> 0'), ('kick_counts_do_not_sum_to_samples', 'CAST(k AS VARCHAR)', 's', 'k % 17 = 0'),
        ('kick_positive_rate_range', 'CAST(k AS VARCHAR)', 's', 'k % 19 = 0'), ('kick_positive_rate_inconsistent', 'CAST(k AS VARCHAR)', 's', 'k % 19 = 0'),
        ('kick_positive_weight_range', 'CAST(k AS VARCHAR)', 's', 'k % 23 = 0'), ('calibrated_kick_threshold_range', 'CAST(k AS VARCHAR)', 's', 'k % 29 = 0'),
        ('epochs_range', 'CAST(k AS VARCHAR)', 's', 'k % 31 = 0'), ('direction_counts_not_nine', 'CAST(k AS VARCHAR)', 's', 'k % 37 = 0'),
        ('seed_missing', 'CAST(k AS VARCHAR)', 's', 'k % 41 = 0'), ('direction_counts_invalid', 'CAST(k AS VARCHAR)', 's', 'k % 43 = 0 AND k % 37 <> 0'),
        ('holdout_replays_range', 'CAST(k AS VARCHAR)', 's', 'k % 47 = 0')])}""",
)
def training_statistics_audit(spark, folder):
    k = F.col("k")
    rows = adapters.table(spark, folder, "lineitem").select(F.col("l_partkey").alias("k"), (F.col("l_orderkey") % 9).alias("direction"), (F.col("l_linenumber") == 1).alias("kick"))
    plus = lambda p: F.when(k % p == 0, 1).otherwise(0)
    counted = rows.groupBy("k").agg(
        F.count(F.lit(1)).alias("samples"), F.count_if("kick").alias("kick_positive"), *[F.count_if(F.col("direction") == d).alias(f"d{d}") for d in range(9)]
    )
    classes = F.array(F.when(k % 43 != 0, F.col("d0")), *[F.col(f"d{d}") for d in range(1, 8)], F.col("d8") + plus(13))
    negative = F.col("samples") - F.col("kick_positive")
    blocks = counted.select(
        "k", "samples", "kick_positive", (negative + plus(17)).alias("kick_negative"), F.slice(classes, 1, F.when(k % 37 == 0, 8).otherwise(9)).alias("direction_counts"),
        F.when(k % 19 == 0, -0.5).otherwise(F.col("kick_positive") / F.col("samples")).alias("kick_positive_rate"),
        F.when(k % 23 == 0, 30.0).otherwise(F.least(F.lit(25.0), F.greatest(F.lit(1.0), negative / F.greatest(F.lit(1), F.col("kick_positive"))))).alias("kick_positive_weight"),
        F.when(k % 29 == 0, 1.5).otherwise(0.5).alias("calibrated_kick_threshold"), F.when(k % 31 == 0, 0).otherwise(4).alias("epochs"),
        F.when(k % 41 != 0, 1337).alias("seed"), F.lit(8192).alias("batch_size"), F.lit(0.001).alias("learning_rate"), F.lit(0.00001).alias("l2"),
        F.lit(5).alias("train_replays"), F.when(k % 47 != 0, 1).alias("holdout_replays"),
    )
    return A.audit_training(blocks, k).select("subject", "check")


@query(
    "import_manifest_audit", "AUD-08",
    """WITH m AS (SELECT o_orderkey AS k, o_orderkey % 100 AS n, o_orderkey % 60 AS u, o_orderkey % 40 AS d, o_orderkey % 50 AS rep, o_orderkey % 45 AS mat FROM orders)
    SELECT "check", count(*) AS n FROM (
      SELECT 'replay_counts' AS "check" FROM m WHERE n <> u + d UNION ALL SELECT 'matches_exceed_replays' FROM m WHERE mat > u
      UNION ALL SELECT 'matches_exceed_reports' FROM m WHERE mat > rep UNION ALL SELECT 'unmatched_reports' FROM m WHERE k % 9 <> rep - mat
      UNION ALL SELECT 'unmatched_replays' FROM m WHERE k % 8 > u - mat) GROUP BY 1""",
)
def import_manifest_audit(spark, folder):
    key = F.col("o_orderkey")
    rows = adapters.table(spark, folder, "orders").select(
        (key % 100).alias("replay_count"), (key % 60).alias("unique_replay_count"), (key % 40).alias("duplicate_replay_count"),
        (key % 50).alias("report_count"), (key % 45).alias("match_count"), (key % 9).alias("unmatched_reports"), (key % 8).alias("unmatched_replays"),
    )
    return A.violations_by_check(A.audit_import_manifest(rows))


@query(
    "source_receipt_audit", "AUD-09",
    f"""WITH {FILES_SQL}, f AS (SELECT *, CAST(split_part(path, '/', 2) AS BIGINT) AS no FROM files) {_checks('', [
        ('invalid_file_path', "'src/../' || no || '.json'", 'f', 'no % 41 = 0'), ('invalid_file_kind', "path || '.json'", 'f', 'no % 43 = 0 AND no % 41 <> 0'),
        ('invalid_file_kind', "'src/../' || no || '.json'", 'f', 'no % 43 = 0 AND no % 41 = 0'),
        ('file_kind_path_mismatch', "path || '.json'", 'f', 'no % 47 = 0 AND no % 43 <> 0 AND no % 41 <> 0'),
        ('file_kind_path_mismatch', "'src/../' || no || '.json'", 'f', 'no % 47 = 0 AND no % 43 <> 0 AND no % 41 = 0')])}
      UNION ALL SELECT 'receipt', unnest(['hbr2_count_mismatch', 'discord_json_count_mismatch'])""",
)
def source_receipt_audit(spark, folder):
    no = F.substring_index("path", "/", -1).cast("long")
    files = adapters.files(spark, folder)
    entries = files.select(
        F.when(no % 43 == 0, "zip").when(no % 47 == 0, "hbr2").otherwise("discord_json").alias("kind"),
        F.concat(F.when(no % 41 == 0, F.concat(F.lit("src/../"), no.cast("string"))).otherwise(F.col("path")), F.lit(".json")).alias("path"),
        "size_bytes", "sha256",
    )
    claimed = files.agg(
        F.count(F.lit(1)).alias("file_count"), F.lit(0).cast("long").alias("hbr2_count"), F.count(F.lit(1)).alias("discord_json_count"),
        F.sum("size_bytes").alias("total_size_bytes"),
    )
    return A.audit_source_receipt(entries, claimed).select("subject", "check")


@query(
    "generation_audit", "AUD-10",
    f"""WITH {RUNS_SQL.split('usable AS (')[0].rstrip().rstrip(',')},
    g AS (SELECT *, 'gen-' || printf('%04d', generation) AS id FROM runs WHERE generation > 0)
    SELECT id AS subject, 'seed_mismatch' AS "check" FROM g WHERE generation % 19 = 0
    UNION ALL SELECT id, 'champion_score_mismatch' FROM g WHERE ja IS NULL OR generation % 17 = 0
    UNION ALL SELECT id, 'champion_metrics_invalid' FROM g WHERE ja IS NULL OR ja > 1 OR samples IS NULL""",
)
def generation_audit(spark, folder):
    rows = adapters.runs(spark, folder).filter("generation > 0")
    settings = fn.tuned_variant(F.col("generation"))
    score = fn.composite_score(F.col("joint_accuracy"), F.col("kick_f1"))
    recorded = rows.select(
        "*", F.concat(F.lit("gen-"), F.format_string("%04d", "generation")).alias("experiment_id"),
        *[settings[n].alias(n) for n in ("hidden_dim", "epochs", "batch_size", "learning_rate")],
        (settings["seed"] + F.when(F.col("generation") % 19 == 0, 1).otherwise(0)).alias("seed"),
        (score + F.when(F.col("generation") % 17 == 0, 0.1).otherwise(0.0)).alias("score"),
    )
    return A.audit_generations(recorded).select("subject", "check")


@query(
    "inventory_diff", "JON-18",
    f"""WITH {FILES_SQL}, f AS (SELECT *, CAST(split_part(path, '/', 2) AS BIGINT) AS no FROM files)
    SELECT path, CASE WHEN no % 17 = 0 THEN 'missing' WHEN no % 19 = 0 THEN 'unexpected' ELSE 'changed' END AS change
    FROM f WHERE (no % 17 = 0) <> (no % 19 = 0) OR (no % 13 = 0 AND no % 17 <> 0 AND no % 19 <> 0)""",
)
def inventory_diff(spark, folder):
    no = F.substring_index("path", "/", -1).cast("long")
    files = adapters.files(spark, folder)
    now = files.filter(no % 17 != 0).withColumn("sha256", F.when(no % 13 == 0, F.reverse("sha256")).otherwise(F.col("sha256")))
    return A.inventory_diff(files.filter(no % 19 != 0), now)


@query(
    "training_chain_audit", "JON-19",
    f"""WITH one AS (SELECT o_orderkey AS k, sha256(CAST(o_orderkey AS VARCHAR)) AS sha, CASE WHEN o_orderkey % 10 = 0 THEN 'holdout' ELSE 'train' END AS split FROM orders) {_checks('', [
        ('missing_requested_replay', "split || ':' || sha", 'one', 'k % 61 = 0 AND k % 67 <> 0'),
        ('unexpected_requested_replay', "split || ':' || sha", 'one', 'k % 67 = 0 AND k % 61 <> 0'),
        ('manifest_shard_field_mismatch:example_weight', "split || ':' || sha", 'one', 'k % 71 = 0 AND k % 61 <> 0 AND k % 67 <> 0 AND k % 5 <> 0')])}""",
)
def training_chain_audit(spark, folder):
    key = F.col("o_orderkey")
    rows = adapters.table(spark, folder, "orders").select(
        key.alias("k"), F.sha2(key.cast("string"), 256).alias("replay_sha256"), F.when(key % 10 == 0, "holdout").otherwise("train").alias("split"),
        F.lit(1.0).alias("example_weight"), (key % 20000).alias("total_frames"),
    )
    k = F.col("k")
    requested = rows.filter(k % 61 != 0).withColumn("status", F.when(k % 5 == 0, "failure").otherwise("success")).withColumn(
        "example_weight", F.when(k % 71 == 0, 0.5).otherwise(F.col("example_weight"))
    )
    found = A.training_chain(rows.filter(k % 67 != 0), requested, ["example_weight", "total_frames"])
    return found.select("subject", "check")


@query(
    "manifest_recomputation", "JON-20",
    """SELECT o_custkey AS player, count(*) AS n, 'published_only' AS side FROM orders GROUP BY 1 HAVING o_custkey % 83 = 0
    UNION ALL SELECT o_custkey, count(*) + 1, 'recomputed_only' FROM orders GROUP BY 1 HAVING o_custkey % 83 = 0""",
)
def manifest_recomputation(spark, folder):
    published = adapters.table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("player")).agg(F.count(F.lit(1)).alias("n"))
    again = published.withColumn("n", F.col("n") + F.when(F.col("player") % 83 == 0, 1).otherwise(0))
    return A.recomputation_check(published, again)


@query(
    "snapshot_changes", "SET-03",
    f"""WITH {FILES_SQL}, f AS (SELECT *, CAST(split_part(path, '/', 2) AS BIGINT) AS no FROM files)
    SELECT path, CASE WHEN no % 17 = 0 THEN 'removed' WHEN no % 19 = 0 THEN 'added' ELSE 'changed' END AS change
    FROM f WHERE (no % 17 = 0) <> (no % 19 = 0) OR (no % 13 = 0 AND no % 17 <> 0 AND no % 19 <> 0)""",
)
def snapshot_changes(spark, folder):
    no = F.substring_index("path", "/", -1).cast("long")
    files = adapters.files(spark, folder)
    now = files.filter(no % 17 != 0).withColumn("size_bytes", F.col("size_bytes") + F.when(no % 13 == 0, 1).otherwise(0))
    return A.snapshot_changes(files.filter(no % 19 != 0), now, "path")


@query(
    "inventory_digest", "AGG-22",
    f"""WITH {FILES_SQL}, d AS (SELECT source, CAST('0x' || substr(sha256(length(path) || ':' || path || length(CAST(size_bytes AS VARCHAR)) || ':' || size_bytes || length(sha256) || ':' || sha256), 1, 15) AS BIGINT) AS n FROM files)
    SELECT source, count(*) AS rows, sha256(count(*) || '|' || CAST(sum(CAST(n AS HUGEINT)) AS VARCHAR) || '|' || bit_xor(n)) AS digest FROM d GROUP BY source""",
)
def inventory_digest(spark, folder):
    return A.inventory_digest(adapters.files(spark, folder), ["path", "size_bytes", "sha256"], ["source"])


@query(
    "arena_rollup", "AGG-23",
    """WITH e AS (SELECT p_partkey AS episode, CASE WHEN p_partkey % 6 = 4 THEN 'validation' WHEN p_partkey % 6 = 5 THEN 'test' ELSE 'train' END AS split,
        CASE WHEN p_partkey % 3 = 2 THEN 'Classic' ELSE 'BFF' END AS stadium, p_size AS rows FROM part WHERE p_partkey % 101 <> 7)
    SELECT split, count(*) AS episodes, CAST(sum(rows) AS BIGINT) AS rows, count(*) FILTER (stadium = 'Classic') AS classic, count(*) FILTER (stadium = 'BFF') AS bff,
      0 AS misplaced, (SELECT count(*) FROM part WHERE p_partkey % 101 = 7) AS missing_episodes,
      (SELECT CAST(sum(o_orderkey % 5 - o_orderkey % 3) AS BIGINT) FROM orders) AS arena_goal_difference FROM e GROUP BY split""",
)
def arena_rollup(spark, folder):
    key = F.col("p_partkey")
    entries = adapters.table(spark, folder, "part").filter(key % 101 != 7).select(
        key.alias("episode"), F.when(key % 6 == 4, "validation").when(key % 6 == 5, "test").otherwise("train").alias("split"),
        F.when(key % 3 == 2, "Classic").otherwise("BFF").alias("stadium"), F.col("p_size").alias("rows"),
    )
    o = F.col("o_orderkey")
    matches = adapters.table(spark, folder, "orders").select((o % 5).alias("model_goals"), (o % 3).alias("tactical_goals"))
    return A.arena_rollup(entries, matches, adapters.table(spark, folder, "part").select(key.alias("episode")))


@query(
    "contract_violations", "AUD-01",
    """SELECT subject, "check" FROM (
      SELECT CAST(event_id AS VARCHAR) AS subject, 'k_not_integer' AS "check" FROM events WHERE event_id % 37 = 0
      UNION ALL SELECT CAST(event_id AS VARCHAR), 'k_range' FROM events WHERE event_id % 37 <> 0 AND CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) > 95
      UNION ALL SELECT CAST(event_id AS VARCHAR), 'kind_not_allowed' FROM events WHERE event_type = 'signup'
      UNION ALL SELECT CAST(event_id AS VARCHAR), 'value_range' FROM events WHERE value > 200)""",
)
def contract_violations(spark, folder):
    events = adapters.table(spark, folder, "events")
    text = F.when(F.col("event_id") % 37 == 0, F.regexp_replace("props", "([0-9]+)", '"$1"')).otherwise(F.col("props"))
    rows = events.withColumn("doc", F.try_parse_json(text))
    k = F.try_variant_get("doc", "$.k", "variant")
    wrong_type = A.not_native(k, "integer")
    rules = {
        "k_not_integer": wrong_type,
        "k_range": ~wrong_type & A.not_in_range(F.try_variant_get("doc", "$.k", "bigint"), 0, 95),
        "kind_not_allowed": F.col("event_type") == "signup",
        "value_range": A.not_in_range(F.col("value"), -1e9, 200),
    }
    return A.violations(rows, F.col("event_id"), rules).select("subject", "check")


@query(
    "leaderboard_row_validity", "FLT-04",
    """SELECT c_custkey AS row_no, CAST(c_custkey % 40 / 10.0 - CASE WHEN c_custkey % 67 = 0 THEN 9 ELSE 0 END >= 0 AND c_acctbal >= 0 AS INTEGER) AS valid FROM customer""",
)
def leaderboard_row_validity(spark, folder):
    return adapters.published_leaderboard(spark, folder).select("row_no", C.leaderboard_row_is_valid().cast("int").alias("valid"))


PREDICTION_SQL = """
pred AS (
  SELECT l.doc_id, d.source AS role, l.doc_id % 9 AS direction, CASE WHEN d.n_chars % 3 = 0 THEN (l.doc_id + 1) % 9 ELSE l.doc_id % 9 END AS dp,
    l.quality AS kick, (d.n_chars % 100) / 100.0::DOUBLE AS p FROM labels l JOIN documents d USING (doc_id)
)
"""


@query(
    "prediction_metrics", "AGG-19",
    f"""WITH {PREDICTION_SQL}, c AS (SELECT role, count(*) AS n, count(*) FILTER (direction = dp) AS r, count(*) FILTER (direction = dp AND (p >= 0.5) = (kick = 1)) AS j,
        count(*) FILTER (p >= 0.5 AND kick = 1) AS tp, count(*) FILTER (p >= 0.5 AND kick = 0) AS fp, count(*) FILTER (p < 0.5 AND kick = 1) AS fn, count(*) FILTER (p < 0.5 AND kick = 0) AS tn FROM pred GROUP BY role)
    SELECT c.role, n AS samples, round(r / n, 6) AS direction_accuracy, round(j / n, 6) AS joint_accuracy, tp, fp, fn, tn,
      round(2.0 * (tp / greatest(1, tp + fp)) * (tp / greatest(1, tp + fn)) / greatest(1e-12, tp / greatest(1, tp + fp) + tp / greatest(1, tp + fn)), 6) AS kick_f1,
      round((SELECT max(m) FROM (SELECT count(*) AS m FROM pred p WHERE p.role = c.role GROUP BY direction)) / n, 6) AS majority_direction_accuracy
    FROM c""",
)
def prediction_metrics(spark, folder):
    rows = E.evaluate(adapters.predictions(spark, folder), keys=["role"])
    rounded = ["direction_accuracy", "joint_accuracy", "kick_f1", "majority_direction_accuracy"]
    return rows.select("role", "samples", "tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in rounded])


SWEEP_SQL = """
grid AS (SELECT 0.05::DOUBLE + i * 0.9::DOUBLE / 36 AS t FROM range(37) r(i)),
sweep AS (SELECT t, count(*) FILTER (p >= t AND kick = 1) AS tp, count(*) FILTER (p >= t AND kick = 0) AS fp, count(*) FILTER (p < t AND kick = 1) AS fn,
    count(*) FILTER (p < t AND kick = 0) AS tn FROM pred CROSS JOIN grid GROUP BY t),
f AS (SELECT *, 2.0 * (tp / greatest(1, tp + fp)) * (tp / greatest(1, tp + fn)) / greatest(1e-12, tp / greatest(1, tp + fp) + tp / greatest(1, tp + fn)) AS f1 FROM sweep)
"""


@query(
    "threshold_sweep", "AGG-20",
    f"WITH {PREDICTION_SQL}, {SWEEP_SQL} SELECT round(t, 6) AS threshold, tp, fp, fn, tn, round(f1, 6) AS kick_f1 FROM f",
)
def threshold_sweep(spark, folder):
    rows = E.threshold_sweep(adapters.predictions(spark, folder))
    return rows.select(F.round("threshold", 6).alias("threshold"), "tp", "fp", "fn", "tn", F.round("kick_f1", 6).alias("kick_f1"))


@query(
    "best_threshold", "AGG-20",
    f"""WITH {PREDICTION_SQL}, {SWEEP_SQL}, b AS (SELECT t, f1 FROM f ORDER BY f1 DESC, t LIMIT 1),
    h AS (SELECT count(*) FILTER (p >= 0.5 AND kick = 1) AS tp, count(*) FILTER (p >= 0.5 AND kick = 0) AS fp, count(*) FILTER (p < 0.5 AND kick = 1) AS fn FROM pred),
    base AS (SELECT 2.0 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) AS f1 FROM h)
    SELECT round(CASE WHEN b.f1 > base.f1 THEN b.t ELSE 0.5 END, 6) AS kick_threshold, round(greatest(b.f1, base.f1), 6) AS kick_f1 FROM b CROSS JOIN base""",
)
def best_threshold(spark, folder):
    return E.best_threshold(adapters.predictions(spark, folder)).select(
        F.round("kick_threshold", 6).alias("kick_threshold"), F.round("kick_f1", 6).alias("kick_f1")
    )


@query(
    "vector_feature_moments", "AGG-18",
    """SELECT i - 1 AS position, round(avg(v), 6) AS mean,
      round(CASE WHEN sqrt(greatest(avg(v * v) - avg(v) * avg(v), 1e-8)) < 1e-4 THEN 1 ELSE sqrt(greatest(avg(v * v) - avg(v) * avg(v), 1e-8)) END, 6) AS std
    FROM (SELECT unnest(range(1, len(embedding) + 1)) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) GROUP BY i""",
)
def vector_feature_moments(spark, folder):
    rows = E.vector_moments(adapters.vector_samples(spark, folder), "features")
    return rows.select("position", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(
    "sample_label_statistics", "AGG-18",
    """WITH s AS (SELECT label % 9 AS d, vec_id % 30 = 0 AS k FROM embeddings)
    SELECT count(*) AS samples, count(*) FILTER (k) AS kick_positive, count(*) FILTER (NOT k) AS kick_negative, round(count(*) FILTER (k) / count(*), 6) AS kick_positive_rate,
      round(least(25.0, greatest(1.0, count(*) FILTER (NOT k) / count(*) FILTER (k))), 6) AS kick_positive_weight,
      (SELECT string_agg(n, ',' ORDER BY x) FROM (SELECT x, CAST(count(d) AS VARCHAR) AS n FROM range(9) r(x) LEFT JOIN s ON d = x GROUP BY x)) AS direction_counts FROM s""",
)
def sample_label_statistics(spark, folder):
    rows = E.label_statistics(adapters.vector_samples(spark, folder))
    return rows.select(
        "samples", "kick_positive", "kick_negative", F.round("kick_positive_rate", 6).alias("kick_positive_rate"),
        F.round("kick_positive_weight", 6).alias("kick_positive_weight"), F.array_join(F.col("direction_counts").cast("array<string>"), ",").alias("direction_counts"),
    )


def _tree_sql(levels=3, fan_out=1024):
    """A hash tree over ``l0`` (place, d) and its root, for tables of up to ``fan_out ** levels`` rows."""
    steps = [f"l{i} AS (SELECT g AS place, sha256(string_agg(d, '' ORDER BY place)) AS d FROM (SELECT place, d, (place + {fan_out - 1}) // {fan_out} AS g FROM l{i - 1}) GROUP BY g)" for i in range(1, levels + 1)]
    alone = lambda i: f"(SELECT count(*) FROM l{i}) = 1"
    roots = [f"SELECT d FROM l{i} WHERE {alone(i)}" + (f" AND NOT {alone(i - 1)}" if i else "") for i in range(levels + 1)]
    return ", ".join([*steps, f"root AS ({' UNION ALL '.join(roots)})"])


_LEAF_SQL = "sha256(concat(length(path), ':', path, length(CAST(size_bytes AS VARCHAR)), ':', size_bytes, length(sha256), ':', sha256))"


@query(
    "ordered_inventory_root", "AGG-22",
    f"""WITH {FILES_SQL}, l0 AS (SELECT row_number() OVER (ORDER BY path) AS place, {_LEAF_SQL} AS d FROM files), {_tree_sql()}
    SELECT (SELECT count(*) FROM l0) AS rows, d AS root FROM root""",
)
def ordered_inventory_root(spark, folder):
    return A.ordered_root(adapters.files(spark, folder), ["path"], ["path", "size_bytes", "sha256"])


@query(
    "source_receipt_order", "AUD-09 AGG-22",
    "SELECT 'swapped' AS receipt, unnest(['files_not_canonically_ordered', 'receipt_self_digest_mismatch']) AS \"check\" "
    "UNION ALL SELECT 'changed', 'receipt_self_digest_mismatch'",
)
def source_receipt_order(spark, folder):
    """A receipt in order, with two files swapped, and with one size changed, all under the digest of the first."""
    rows = adapters.files(spark, folder).select(F.lit("discord_json").alias("kind"), F.concat("path", F.lit(".json")).alias("path"), "size_bytes", "sha256")
    files = rank_within(rows, [], [F.lower("path"), F.col("path")], rank="position")
    count = F.count(F.lit(1))
    totals = files.agg(count.alias("file_count"), F.lit(0).cast("long").alias("hbr2_count"), count.alias("discord_json_count"), F.sum("size_bytes").alias("total_size_bytes"))
    claimed = A.attach(totals, A.receipt_digest(files, totals))
    at = F.col("position")
    receipts = {
        "kept": files,
        "swapped": files.withColumn("position", F.when(at == 2, 1).when(at == 1, 2).otherwise(at)),
        "changed": files.withColumn("size_bytes", F.col("size_bytes") + F.when(at == 3, 1).otherwise(0)),
    }
    found = [A.audit_receipt_order(f, claimed).select(F.lit(name).alias("receipt"), "check") for name, f in receipts.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])
