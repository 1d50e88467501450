"""Queries that choose replays and players, grade matches and decide on models."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline import adapters
from touchline.functions import scalars as fn
from touchline.operators import audits as A
from touchline.operators import curation as C
from touchline.operators import gates as G
from touchline.operators import players as P
from touchline.operators import quality as Q
from touchline.plans import curation
from touchline.plans.rating import leaderboard
from touchline.workload.player_ratings import WITH_SKILL
from touchline.workload.registry import query

META_SQL = """
meta AS (
  SELECT sha256(CAST(o_orderkey AS VARCHAR)) AS replay_sha256,
    CASE WHEN o_orderkey % 23 <> 0 THEN CASE WHEN o_orderkey % 7 = 0 THEN 3 ELSE 4 END END AS sv,
    CASE WHEN o_orderkey % 29 <> 0 THEN o_orderkey * 13 % 20000 - 50 END AS tf,
    CASE WHEN o_orderkey % 31 <> 0 THEN o_orderkey % 9 * 100 END AS ss,
    CASE WHEN o_orderkey % 37 <> 0 THEN o_orderkey % 13 END AS pl,
    CASE WHEN o_orderkey % 41 <> 0 THEN o_orderkey % 8 * 5 END AS tc, o_orderkey * 13 % 20000 - 50 - o_orderkey % 3 AS fa
  FROM orders
),
graded AS (
  SELECT *, concat_ws(',', CASE WHEN sv IS NULL THEN 'invalid_schema_version' WHEN sv < 4 THEN 'schema_before_v4' END,
    CASE WHEN tf IS NULL OR tf < 0 THEN 'invalid_total_frames' WHEN tf < 7200 THEN 'shorter_than_2m' END,
    CASE WHEN ss IS NULL OR ss <= 0 THEN 'no_sampled_state' END,
    CASE WHEN pl IS NULL THEN 'invalid_players' WHEN pl < 4 THEN 'fewer_than_4_players' END,
    CASE WHEN tc IS NULL THEN 'invalid_feature_summary' WHEN tc <= 0 THEN 'no_touch_evidence' END) AS reasons
  FROM meta
)
"""


@query(
    "replay_quality_gate", "FLT-02",
    f"WITH {META_SQL} SELECT replay_sha256, reasons, CAST(reasons = '' AS INTEGER) AS accepted FROM graded",
)
def replay_quality_gate(spark, folder):
    rows = adapters.replay_meta(spark, folder).withColumn("reasons", C.replay_rejections())
    return rows.select(
        "replay_sha256", F.array_join("reasons", ",").alias("reasons"), (F.size("reasons") == 0).cast("int").alias("accepted")
    )


@query(
    "rejection_reasons", "AGG-16",
    f"WITH {META_SQL} SELECT reason, count(*) AS n FROM (SELECT unnest(string_split(reasons, ',')) AS reason FROM graded WHERE reasons <> '') GROUP BY 1",
)
def rejection_reasons(spark, folder):
    return C.rejection_histogram(adapters.replay_meta(spark, folder).withColumn("reasons", C.replay_rejections()))


@query(
    "analysis_completeness", "FLT-06",
    f"""WITH {META_SQL} SELECT replay_sha256, CASE WHEN tf > 0 AND fa < greatest(tf - 1, 0) THEN 'failed' ELSE 'ok' END AS status,
      CASE WHEN tf > 0 AND fa < greatest(tf - 1, 0) THEN 'incomplete_state_reconstruction:' || fa || '/' || tf END AS error FROM meta""",
)
def analysis_completeness(spark, folder):
    return G.analysis_status(adapters.replay_meta(spark, folder)).select("replay_sha256", "status", "error")


@query(
    "valid_match_rows", "FLT-01",
    """WITH rows AS (SELECT l_orderkey // 8 AS match_id, l_suppkey AS player, sum(l_quantity * 10) AS samples FROM lineitem GROUP BY ALL)
    SELECT match_id, count(*) AS players, CAST(sum(samples) AS BIGINT) AS samples FROM rows
    WHERE match_id NOT IN (SELECT match_id FROM rows WHERE match_id % 9 = 0 AND player % 50 = 0) GROUP BY ALL""",
)
def valid_match_rows(spark, folder):
    rows = adapters.player_match(spark, folder)
    broken = (F.col("match_id") % 9 == 0) & (F.col("player") % 50 == 0)
    # halve the samples so that the nearest-ball counter of the given rows can reach them
    rows = rows.withColumn("samples", (F.col("samples") / 2).cast("long")).withColumn(
        "nearest_ball_samples", F.when(broken, F.col("samples") + 1).otherwise(F.least("nearest_ball_samples", "samples"))
    ).withColumn("close_ball_samples", F.least("close_ball_samples", "samples"))
    return P.rows_of_valid_matches(rows).groupBy("match_id").agg(
        F.count(F.lit(1)).alias("players"), F.sum("samples").alias("samples")
    )


SELECT_SQL = """
eligible AS (
  SELECT *, rating - rating_uncertainty AS cs FROM board WHERE matches >= 30 AND minutes >= 120 AND rating_uncertainty <= 3
),
selected AS (
  SELECT player_id, name, role, rating, rating_uncertainty, cs, matches, minutes FROM (
    SELECT *, row_number() OVER (PARTITION BY role ORDER BY cs DESC, rating DESC, matches DESC, player_id) AS n,
      count(*) OVER (PARTITION BY role) AS size FROM eligible)
  WHERE n <= greatest(5, ceil(size * 0.25))
)
"""


def _selected(spark, folder):
    return curation.selection(leaderboard(adapters.player_match(spark, folder)), max_uncertainty=3.0)


@query(
    "selected_players", "TOP-03 FLT-04",
    f"{WITH_SKILL}, {SELECT_SQL} SELECT player_id, name, role, round(cs, 4) AS conservative_score, matches FROM selected",
)
def selected_players(spark, folder):
    return _selected(spark, folder).select(
        "player_id", "name", "role", F.round("conservative_score", 4).alias("conservative_score"), "matches"
    )


MEMBERS_SQL = f"""
{META_SQL},
inside AS (
  SELECT sha256(CAST(l_orderkey AS VARCHAR)) AS replay_sha256, l_suppkey - 1 AS replay_player_id,
    CASE WHEN l_suppkey % 4 = 0 THEN 'auth:a' || l_suppkey ELSE 'name:player ' || l_suppkey END AS identity,
    max(l_linenumber) % 4 AS team, sum(l_quantity) AS samples FROM lineitem GROUP BY l_orderkey, l_suppkey
),
chosen AS (
  SELECT i.replay_sha256, i.replay_player_id, i.identity, CAST(i.samples AS BIGINT) AS samples, s.cs
  FROM inside i JOIN selected s ON s.player_id = i.identity JOIN graded g USING (replay_sha256)
  WHERE g.reasons = '' AND i.team IN (1, 2) AND i.samples > 0 AND i.replay_player_id >= 0
)
"""


def _members(spark, folder):
    meta = adapters.replay_meta(spark, folder)
    accepted = meta.filter(F.size(C.replay_rejections()) == 0)
    return C.selected_in_replays(adapters.replay_players(spark, folder), accepted, _selected(spark, folder)), meta


@query(
    "selected_players_in_replays", "JON-09 FLT-07",
    f"{WITH_SKILL}, {SELECT_SQL}, {MEMBERS_SQL} SELECT replay_sha256, replay_player_id, identity, samples FROM chosen",
)
def selected_players_in_replays(spark, folder):
    return _members(spark, folder)[0].select("replay_sha256", "replay_player_id", "identity", "samples")


@query(
    "training_manifest_replays", "PRJ-15 PRJ-19 SET-01",
    f"""{WITH_SKILL}, {SELECT_SQL}, {MEMBERS_SQL}
    SELECT m.replay_sha256, any_value(g.tf) AS total_frames, round_even(any_value(g.tf) / 60.0, 3) AS duration_seconds,
      count(*) AS selected_player_count, round(greatest(0.25, least(2.0, 1 + (max(m.cs) - 50) / 10)), 3) AS example_weight,
      CASE WHEN CAST('0x' || substr(sha256('holdout-v1:' || m.replay_sha256), 1, 16) AS UBIGINT) % 10 = 0 THEN 'holdout' ELSE 'train' END AS split
    FROM chosen m JOIN graded g USING (replay_sha256) GROUP BY m.replay_sha256""",
)
def training_manifest_replays(spark, folder):
    members, meta = _members(spark, folder)
    return C.manifest_entries(members, meta).withColumn("example_weight", F.round("example_weight", 3))


@query(
    "cross_split_leakage", "SET-02",
    """WITH e AS (SELECT sha256(CAST(o_orderkey // CASE WHEN o_orderkey % 97 = 1 THEN 2 ELSE 1 END AS VARCHAR)) AS replay_sha256,
      CASE WHEN o_orderkey % 10 = 0 THEN 'holdout' ELSE 'train' END AS split FROM orders)
    SELECT replay_sha256 FROM e WHERE split = 'train' INTERSECT SELECT replay_sha256 FROM e WHERE split = 'holdout'""",
)
def cross_split_leakage(spark, folder):
    return C.cross_split_leakage(adapters.shard_entries(spark, folder))


@query(
    "match_quality", "FLT-03",
    """WITH e AS (
      SELECT o_orderkey AS k, CASE WHEN o_orderkey % 101 <> 0 THEN o_orderkey % 53 <> 0 END AS valid,
        CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey * 7 % 600 - CASE WHEN o_orderkey % 211 = 0 THEN 1000 ELSE 0 END END AS dur,
        CASE WHEN o_orderkey % 13 <> 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN 6 ELSE 8 END END AS expd,
        CASE WHEN o_orderkey % 17 <> 0 THEN c_custkey % 4 + 5 END AS obs,
        CASE WHEN o_orderkey % 19 <> 0 THEN greatest(0, o_orderkey % 8 - 4) END AS disc,
        CASE WHEN o_orderkey % 23 <> 0 THEN c_custkey * 3 % 104 END AS act,
        CASE WHEN o_orderkey % 29 <> 0 THEN o_orderkey * 31 % 101 END AS parse,
        CASE WHEN o_orderkey % 31 <> 0 THEN c_nationkey % 6 <> 0 END AS stad,
        CASE WHEN o_orderkey % 37 <> 0 THEN c_mktsegment <> 'MACHINERY' END AS ident
      FROM orders JOIN customer ON o_custkey = c_custkey
    ), s AS (
      SELECT *, concat_ws(',', CASE WHEN act > 100 THEN 'invalid_activity_ratio' END, CASE WHEN dur < 0 THEN 'invalid_duration_seconds' END,
          CASE WHEN valid IS NULL THEN 'invalid_replay_valid' END) AS inv,
        greatest(0, least(100, 50 + CASE WHEN dur < 60 THEN -30 WHEN dur >= 240 THEN 10 ELSE 0 END
          + CASE WHEN expd IS NULL OR obs IS NULL THEN 0 WHEN obs <> expd THEN -20 ELSE 5 END
          + CASE WHEN disc > 0 THEN -least(25, 8 * disc) WHEN disc = 0 THEN 5 ELSE 0 END
          + CASE WHEN act < 50 THEN -20 WHEN act >= 80 THEN 5 ELSE 0 END
          + CASE WHEN parse < 80 THEN -30 WHEN parse >= 98 THEN 10 ELSE 0 END
          + CASE WHEN NOT stad THEN -20 ELSE 0 END + CASE WHEN NOT ident THEN -10 ELSE 0 END)) AS score,
        concat_ws(',', CASE WHEN act IS NULL THEN 'activity_ratio' END, CASE WHEN disc IS NULL THEN 'disconnect_count' END,
          CASE WHEN dur IS NULL THEN 'duration_seconds' END, CASE WHEN parse IS NULL THEN 'parser_completeness' END,
          CASE WHEN expd IS NULL OR obs IS NULL THEN 'player_count' END, CASE WHEN ident IS NULL THEN 'player_identity_confidence' END,
          CASE WHEN stad IS NULL THEN 'stadium_supported' END) AS miss,
        concat_ws(',', CASE WHEN dur < 60 THEN 'very_short_match' WHEN dur >= 240 THEN 'meaningful_duration' END,
          CASE WHEN expd IS NULL OR obs IS NULL THEN NULL WHEN obs < expd THEN 'incomplete_player_count' WHEN obs > expd THEN 'excess_player_count' ELSE 'expected_player_count_present' END,
          CASE WHEN disc > 0 THEN 'disconnects_present' WHEN disc = 0 THEN 'no_detected_disconnects' END,
          CASE WHEN act < 50 THEN 'low_activity' WHEN act >= 80 THEN 'healthy_activity' END,
          CASE WHEN parse < 80 THEN 'low_parser_completeness' WHEN parse >= 98 THEN 'high_parser_completeness' END,
          CASE WHEN NOT stad THEN 'unsupported_stadium' END, CASE WHEN NOT ident THEN 'uncertain_player_identity' END) AS why
      FROM e)
    SELECT k AS match_no, CASE WHEN inv <> '' OR NOT valid THEN 0 ELSE score / 100 END AS weight,
      CASE WHEN inv <> '' THEN inv WHEN NOT valid THEN 'invalid_replay' WHEN score >= 85 AND miss <> '' THEN why || ',elite_capped_by_missing_evidence' ELSE why END AS reasons,
      CASE WHEN inv <> '' OR NOT valid THEN '' ELSE miss END AS missing_evidence
    FROM s""",
)
def match_quality(spark, folder):
    rows = Q.assess_matches(adapters.quality_evidence(spark, folder))
    return rows.select(
        "match_no", "weight", F.array_join("reasons", ",").alias("reasons"),
        F.array_join("missing_evidence", ",").alias("missing_evidence"),
    )


@query("match_quality_tiers", "FLT-03")
def match_quality_tiers(spark, folder):
    return Q.assess_matches(adapters.quality_evidence(spark, folder)).groupBy("tier").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.min("weight"), 4).alias("lowest"), F.round(F.max("weight"), 4).alias("highest")
    )


@query(
    "promotion_decisions", "FLT-08",
    """WITH e AS (SELECT p_partkey AS run, p_partkey * 7 % 1500 AS games, (p_partkey % 60 + 480) / 1000.0 AS lo, p_partkey % 103 AS ok,
        CASE WHEN p_partkey % 50 = 0 THEN 0 ELSE 102 END AS total, p_size % 5 = 0 AS crit, p_partkey % 9 <> 0 AS rep FROM part)
    SELECT run, CAST(games >= 500 AND lo >= 0.51 AND total > 0 AND ok / total >= 0.98 AND NOT crit AND rep AS INTEGER) AS promote,
      CASE WHEN games >= 500 AND lo >= 0.51 AND total > 0 AND ok / total >= 0.98 AND NOT crit AND rep
        THEN 'head_to_head_gate_passed;frozen_scenarios_passed;no_blocking_regressions;run_reproducible'
        ELSE concat_ws(';', CASE WHEN games < 500 THEN 'insufficient_games:' || games || '<500' END,
          CASE WHEN lo < 0.51 THEN 'head_to_head_confidence_gate_failed:' || printf('%.4f', lo) || '<0.5100' END,
          CASE WHEN total <= 0 THEN 'no_frozen_scenarios' WHEN ok / total < 0.98 THEN 'scenario_pass_rate_failed:' || printf('%.4f', ok / total) || '<0.9800' END,
          CASE WHEN crit THEN 'critical_regressions:corner,press' END, CASE WHEN NOT rep THEN 'run_not_reproducible' END) END AS reasons
    FROM e""",
)
def promotion_decisions(spark, folder):
    key = F.col("p_partkey")
    item = lambda s, v: F.struct(F.lit(s).alias("scenario"), F.lit(v).alias("severity"))
    evidence = adapters.table(spark, folder, "part").select(
        key.alias("run"),
        (key * 7 % 1500).alias("games"),
        ((key % 60 + 480) / F.lit(1000.0)).alias("score_rate_lower_bound"),
        (key % 103).alias("scenarios_passed"),
        F.when(key % 50 == 0, 0).otherwise(102).alias("scenarios_total"),
        F.when(F.col("p_size") % 5 == 0, F.array(item("corner", "Critical"), item("kickoff", "minor"), item("press", "critical")))
        .otherwise(F.array(item("kickoff", "minor"))).alias("regressions"),
        (key % 9 != 0).alias("reproducible"),
    )
    return G.decide_promotions(evidence).select(
        "run", F.col("promote").cast("int").alias("promote"), F.array_join("reasons", ";").alias("reasons")
    )


RUNS_SQL = """
runs AS (
  SELECT p_brand AS lineage, p_partkey AS generation, (p_partkey * 53 % 997 + 300) / 1300.0::DOUBLE AS da,
    CASE WHEN p_partkey % 41 <> 0 THEN (p_partkey * 37 % 991 + CASE WHEN p_partkey % 43 = 0 THEN 1000 ELSE 0 END) / 1000.0::DOUBLE END AS ja,
    (p_size * 19 % 101) / 101.0::DOUBLE AS kf, CASE WHEN p_partkey % 47 <> 0 THEN p_partkey % 500 + 1 END AS samples FROM part
),
usable AS (
  SELECT *, 0.7::DOUBLE * ja + 0.3::DOUBLE * kf AS score, row_number() OVER (PARTITION BY lineage ORDER BY generation) AS n FROM runs
  WHERE ja BETWEEN 0 AND 1 AND da BETWEEN 0 AND 1 AND kf BETWEEN 0 AND 1 AND samples >= 1
),
fold AS (
  SELECT lineage, n, generation, generation AS champ, da, ja, kf, score, true AS crowned FROM usable WHERE n = 1
  UNION ALL
  SELECT u.lineage, u.n, u.generation, CASE WHEN w THEN u.generation ELSE champ END, CASE WHEN w THEN u.da ELSE fda END,
    CASE WHEN w THEN u.ja ELSE fja END, CASE WHEN w THEN u.kf ELSE fkf END, CASE WHEN w THEN u.score ELSE fscore END, w
  FROM (SELECT u.*, f.champ, f.da AS fda, f.ja AS fja, f.kf AS fkf, f.score AS fscore,
          u.score >= f.score + 0.001::DOUBLE AND u.da >= f.da - 0.02::DOUBLE AND u.kf >= f.kf - 0.05::DOUBLE AS w
        FROM fold f JOIN usable u ON u.lineage = f.lineage AND u.n = f.n + 1) u
)
"""


@query(
    "champion_lineage", "WIN-10",
    f"WITH RECURSIVE {RUNS_SQL} SELECT lineage, generation, round(score, 6) AS score FROM fold WHERE crowned",
)
def champion_lineage(spark, folder):
    rows = G.champions(adapters.runs(spark, folder))
    return rows.select(
        "lineage", "generation", F.round(fn.composite_score(F.col("joint_accuracy"), F.col("kick_f1")), 6).alias("score")
    )


JUDGED_SQL = f"""
{RUNS_SQL},
judged AS (
  SELECT r.*, f.champ AS parent, f.da AS pda, f.kf AS pkf, f.score AS pscore, 0.7::DOUBLE * r.ja + 0.3::DOUBLE * r.kf AS score,
    coalesce(r.ja BETWEEN 0 AND 1 AND r.samples >= 1, false) AND f.champ IS NOT NULL AS fine
  FROM runs r ASOF LEFT JOIN (SELECT * FROM fold) f ON f.lineage = r.lineage AND f.generation < r.generation
),
decided AS (
  SELECT *, fine AND score >= pscore + 0.001::DOUBLE AND da >= pda - 0.02::DOUBLE AND kf >= pkf - 0.05::DOUBLE AS promote FROM judged
)
"""


@query(
    "challenger_gate", "FLT-09 WIN-10 PRJ-22",
    f"""WITH RECURSIVE {JUDGED_SQL}
    SELECT lineage, generation, parent AS parent_generation, CAST(coalesce(promote, false) AS INTEGER) AS promote,
      CASE WHEN fine THEN round(score, 6) END AS candidate_score, CASE WHEN fine THEN round(score - pscore, 6) END AS improvement,
      CASE WHEN parent IS NULL THEN 'founding' WHEN promote THEN 'promoted_offline' ELSE 'rejected_offline' END AS status
    FROM decided""",
)
def challenger_gate(spark, folder):
    return G.lineage(adapters.runs(spark, folder)).select(
        "lineage", "generation", "parent_generation", F.coalesce("promote", F.lit(False)).cast("int").alias("promote"),
        F.round("candidate_score", 6).alias("candidate_score"), F.round("improvement", 6).alias("improvement"), "status",
    )


@query(
    "rejected_candidates", "ML-04 FLT-09",
    f"""WITH RECURSIVE {JUDGED_SQL}
    SELECT lineage, generation, parent AS parent_generation, concat_ws(';',
      CASE WHEN NOT fine AND ja IS NULL THEN 'missing_candidate.joint_accuracy' WHEN NOT fine AND ja > 1 THEN 'invalid_candidate.joint_accuracy:above_maximum' END,
      CASE WHEN NOT fine AND samples IS NULL THEN 'missing_candidate.samples' END,
      CASE WHEN fine AND NOT score >= pscore + 0.001::DOUBLE THEN 'insufficient_improvement:' || printf('%.6f', score) || '<' || printf('%.6f', pscore + 0.001::DOUBLE) END,
      CASE WHEN fine AND da < pda - 0.02::DOUBLE THEN 'direction_accuracy_regression' END,
      CASE WHEN fine AND kf < pkf - 0.05::DOUBLE THEN 'kick_f1_regression' END) AS reasons
    FROM decided WHERE parent IS NOT NULL AND NOT coalesce(promote, false)""",
)
def rejected_candidates(spark, folder):
    return G.failure_inventory(G.lineage(adapters.runs(spark, folder))).select(
        "lineage", "generation", "parent_generation", F.array_join("reasons", ";").alias("reasons")
    )


@query(
    "generation_settings", "PRJ-21",
    """SELECT p_partkey AS generation, CAST((p_partkey - 1) % 8 AS INTEGER) AS variant_index,
      ([64, 96, 128, 64, 96, 128, 64, 96])[(p_partkey - 1) % 8 + 1] AS hidden_dim,
      ([4, 4, 4, 6, 5, 3, 8, 6])[(p_partkey - 1) % 8 + 1] AS epochs,
      ([0.001, 0.0008, 0.0006, 0.0005, 0.0004, 0.001, 0.0003, 0.0007])[(p_partkey - 1) % 8 + 1] AS learning_rate,
      1337 + p_partkey * 7919 AS seed FROM part WHERE p_partkey > 0""",
)
def generation_settings(spark, folder):
    settings = fn.tuned_variant(F.col("generation"))
    rows = adapters.runs(spark, folder).filter("generation > 0")
    wanted = ["variant_index", "hidden_dim", "epochs", "learning_rate", "seed"]
    return rows.select("generation", *[settings[n].alias(n) for n in wanted])


def _manifest_sql(side, rating):
    return f"""
board_{side} AS (
  SELECT CASE WHEN s_suppkey % 4 = 0 THEN 'auth:a' || s_suppkey ELSE 'name:player ' || s_suppkey END AS player_id,
    s_suppkey % 3 AS role, {rating} AS rating, s_suppkey % 25 AS uncertainty, 30 + s_suppkey % 50 AS matches FROM supplier WHERE 100 + s_suppkey % 100 >= 120 AND s_suppkey % 25 <= 20
),
selected_{side} AS (
  SELECT player_id, rating - uncertainty AS cs FROM board_{side}
  QUALIFY row_number() OVER (PARTITION BY role ORDER BY rating - uncertainty DESC, rating DESC, matches DESC, player_id) <= greatest(5, ceil(count(*) OVER (PARTITION BY role) * 0.25))
),
manifest_{side} AS (
  SELECT i.replay_sha256, count(*) AS selected_player_count, greatest(25, least(200, 100 + max(s.cs) - 500)) AS weight
  FROM inside i JOIN selected_{side} s ON s.player_id = i.identity JOIN graded g USING (replay_sha256)
  WHERE g.reasons = '' AND i.team IN (1, 2) AND i.samples > 0 AND i.replay_player_id >= 0 GROUP BY 1
)"""


_INSIDE_SQL = MEMBERS_SQL[: MEMBERS_SQL.index("chosen AS (")].rstrip().rstrip(",")
_NOW, _THEN = "500 + s_suppkey * 7 % 200", "500 + (s_suppkey + CASE WHEN s_suppkey % 6 = 0 THEN 90 ELSE 0 END) * 7 % 200"


@query(
    "manifest_from_sources", "JON-20 TOP-03 JON-09 SET-01",
    f"""WITH {_INSIDE_SQL}, {_manifest_sql('published', _THEN)}, {_manifest_sql('again', _NOW)},
    both_sides AS (SELECT coalesce(p.replay_sha256, r.replay_sha256) AS subject, p.replay_sha256 AS p, r.replay_sha256 AS r, p.selected_player_count AS pc, r.selected_player_count AS rc, p.weight AS pw, r.weight AS rw
      FROM manifest_published p FULL JOIN manifest_again r ON p.replay_sha256 = r.replay_sha256)
    SELECT subject, 'not_published' AS "check" FROM both_sides WHERE p IS NULL UNION ALL SELECT subject, 'not_in_sources' FROM both_sides WHERE r IS NULL
    UNION ALL SELECT subject, 'differs:selected_player_count' FROM both_sides WHERE pc <> rc UNION ALL SELECT subject, 'differs:example_weight' FROM both_sides WHERE pw <> rw""",
)
def manifest_from_sources(spark, folder):
    """A manifest published from an older leaderboard, recomputed from the one of now: selection, members and split anew."""
    key = F.col("s_suppkey")
    replays, players = adapters.replay_meta(spark, folder), adapters.replay_players(spark, folder)

    def manifest(number):
        board = adapters.table(spark, folder, "supplier").select(
            F.when(key % 4 == 0, F.concat(F.lit("auth:a"), key)).otherwise(F.concat(F.lit("name:player "), key)).alias("player_id"), F.col("s_name").alias("name"),
            (key % 3).cast("string").alias("role"), ((500 + number * 7 % 200) / 10).alias("rating"), (key % 25 / 10).alias("rating_uncertainty"),
            (30 + key % 50).alias("matches"), (100 + key % 100).cast("double").alias("minutes"),
        )
        return curation.training_manifest(board, players, replays, max_uncertainty=2.0)["replays"]

    published = manifest(key + F.when(key % 6 == 0, 90).otherwise(0))
    fields = ["total_frames", "duration_seconds", "selected_player_count", "example_weight", "split"]
    return A.manifest_differences(published, manifest(key), "replay_sha256", fields).select("subject", "check")
