"""Queries that audit a whole published manifest made from the given tables, with a fault for every rule."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from touchline import adapters
from touchline.functions import scalars as fn
from touchline.operators import manifest_audits as MA
from touchline.operators.sequences import rank_within
from touchline.session import materialize
from touchline.workload.registry import query

_LISTS_SQL = """
sel AS (
  SELECT CASE s_suppkey % 17 WHEN 3 THEN s_suppkey + 1 WHEN 4 THEN s_suppkey - 1 ELSE s_suppkey END AS place,
    'name:player ' || (s_suppkey - CASE WHEN s_suppkey % 23 = 0 THEN 1 ELSE 0 END) || CASE WHEN s_suppkey % 31 = 5 THEN ' ' ELSE '' END AS player_id,
    1000000 - 10 * s_suppkey AS rating, CASE WHEN s_suppkey % 29 = 7 THEN -1 ELSE s_suppkey % 5 END AS unc, s_suppkey % 19 = 1 AS off,
    CASE WHEN s_suppkey % 37 = 2 THEN -1 ELSE s_suppkey % 50 END AS matches, s_acctbal AS minutes, s_suppkey % 41 = 8 AS no_role
  FROM supplier WHERE s_suppkey % 3 <> 0
),
scored AS (SELECT *, rating - unc + CASE WHEN off THEN 5 ELSE 0 END AS score FROM sel),
placed AS (SELECT *, lag((score, rating, matches)) OVER (ORDER BY place) AS prev FROM scored),
lines AS (
  SELECT sha256(CAST(l_orderkey AS VARCHAR)) AS sha, place, 'name:player ' || l_suppkey AS identity,
    CASE WHEN l_orderkey % 37 = 0 AND place = 2 THEN 2 WHEN l_orderkey % 41 = 0 AND place = 3 THEN 1 WHEN l_orderkey % 53 = 0 AND place = 1 THEN -2 ELSE place * 2 END AS pid,
    CASE WHEN l_orderkey % 43 = 0 AND place = 1 THEN 0 ELSE CAST(l_quantity AS BIGINT) END AS samples
  FROM (SELECT l_orderkey, l_suppkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_quantity) AS place FROM lineitem)
),
chained AS (SELECT *, lag((pid, identity)) OVER (PARTITION BY sha ORDER BY place) AS prev FROM lines),
counted AS (SELECT sha, count(*) AS n FROM lines GROUP BY sha),
replays AS (
  SELECT sha256(CAST(o_orderkey AS VARCHAR)) AS sha, o_orderkey, CASE WHEN CAST('0x' || substr(sha256('holdout-v1:' || sha256(CAST(o_orderkey AS VARCHAR))), 1, 16) AS UBIGINT) % 10 = 0
    THEN 'holdout' ELSE 'train' END AS split FROM orders
),
numbered AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY sha) AS r FROM replays),
listed AS (SELECT *, lag(sha) OVER (PARTITION BY split ORDER BY CASE r % 101 WHEN 5 THEN r + 1 WHEN 6 THEN r - 1 ELSE r END) AS prev FROM numbered),
sums AS (SELECT r.sha, coalesce(n, 0) + CASE WHEN o_orderkey % 29 = 0 THEN 1 ELSE 0 END AS said, n FROM replays r LEFT JOIN counted c USING (sha))
"""
_HEADER_RULES = [
    "analysis_version", "generated_at", "analysis_root", "raw_root", "leaderboard_sha256", "leaderboard_size_bytes", "top_fraction_per_role",
    "min_players_per_role", "min_matches", "min_minutes", "max_uncertainty", "holdout_modulus", "holdout_bucket", "rejected_exceeds_scanned",
    "published_exceeds_scanned", "selected_player_count", "train_replay_count", "holdout_replay_count",
]


def _lists(spark, folder):
    """Selected players, replays and members with their published places."""
    key, order, place = F.col("s_suppkey"), F.col("l_orderkey"), F.col("position")
    uncertainty = F.when(key % 29 == 7, -1).otherwise(key % 5)
    score = 1000000 - 10 * key - uncertainty + F.when(key % 19 == 1, 5).otherwise(0)
    selected = adapters.table(spark, folder, "supplier").filter(key % 3 != 0).select(
        F.when(key % 17 == 3, key + 1).when(key % 17 == 4, key - 1).otherwise(key).alias("position"),
        F.concat(F.lit("name:player "), key - F.when(key % 23 == 0, 1).otherwise(0), F.when(key % 31 == 5, " ").otherwise("")).alias("player_id"),
        F.when(key % 41 != 8, "forward").alias("role"), ((1000000 - 10 * key) / 10).alias("rating"), (uncertainty / 10).alias("rating_uncertainty"),
        (score / 10).alias("conservative_score"), F.when(key % 37 == 2, -1).otherwise(key % 50).alias("matches"), F.col("s_acctbal").alias("minutes"),
    )
    lines = adapters.table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    # lines are dealt by their replay as numbers and get its hash where they arrive; an order has few of them
    sha = F.sha2(order.cast("string"), 256)
    dealt = lines.repartition(sha).withColumn("replay_sha256", sha)
    # line numbers repeat, so a line's place is its rank
    placed = dealt.withColumn("position", F.row_number().over(Window.partitionBy("replay_sha256").orderBy("l_linenumber", "l_suppkey", "l_quantity")))
    members = placed.select(
        "replay_sha256", "position",
        F.when((order % 37 == 0) & (place == 2), 2).when((order % 41 == 0) & (place == 3), 1).when((order % 53 == 0) & (place == 1), -2).otherwise(place * 2).alias("replay_player_id"),
        F.concat(F.lit("name:player "), "l_suppkey").alias("identity"), F.when((order % 43 == 0) & (place == 1), 0).otherwise(F.col("l_quantity").cast("long")).alias("samples"),
    )
    counted = lines.groupBy(order.alias("o_orderkey")).agg(F.count(F.lit(1)).alias("_n"))
    sha = F.sha2(F.col("o_orderkey").cast("string"), 256)
    replays = adapters.table(spark, folder, "orders").select("o_orderkey").join(counted, "o_orderkey", "left").select(
        sha.alias("replay_sha256"), F.when(fn.holdout_bucket(sha, 10) == 0, "holdout").otherwise("train").alias("split"),
        (F.coalesce("_n", F.lit(0)) + F.when(F.col("o_orderkey") % 29 == 0, 1).otherwise(0)).alias("selected_player_count"),
    )
    ranked = rank_within(replays, ["split"], [F.col("replay_sha256")], rank="_r")
    at = F.col("_r")
    entries = ranked.select(
        "split", "replay_sha256", F.when(at % 101 == 5, at + 1).when(at % 101 == 6, at - 1).otherwise(at).alias("position"),
        "selected_player_count",
    )
    return selected, materialize(entries), members


@query(
    "published_manifest_lists", "AUD-03",
    f"""WITH {_LISTS_SQL}
    SELECT player_id AS subject, unnest(list_filter([CASE WHEN player_id <> trim(player_id) THEN 'selection.player_id' END, CASE WHEN no_role THEN 'selection.role' END,
      CASE WHEN unc < 0 THEN 'selection.rating_uncertainty' END, CASE WHEN off THEN 'selection.conservative_score' END, CASE WHEN matches < 0 THEN 'selection.matches' END,
      CASE WHEN minutes < 0 THEN 'selection.minutes' END, CASE WHEN (score, rating, matches) > prev THEN 'selection.not_in_order' END], lambda x: x IS NOT NULL)) AS "check" FROM placed
    UNION ALL SELECT player_id, 'selection.duplicate_player' FROM sel GROUP BY 1 HAVING count(*) > 1
    UNION ALL SELECT sha, 'replays.not_in_order' FROM listed WHERE sha <= prev
    UNION ALL SELECT sha, unnest(list_filter([CASE WHEN pid < 0 THEN 'members.replay_player_id' END, CASE WHEN samples < 1 THEN 'members.samples' END,
      CASE WHEN identity NOT IN (SELECT player_id FROM sel) THEN 'members.unselected' END, CASE WHEN (pid, identity) < prev THEN 'members.not_in_order' END], lambda x: x IS NOT NULL)) FROM chained
    UNION ALL SELECT sha, 'members.count' FROM sums WHERE said IS DISTINCT FROM n
    UNION ALL SELECT c.sha, 'members.count' FROM counted c ANTI JOIN replays r ON r.sha = c.sha
    UNION ALL SELECT sha || '|' || pid, 'members.repeated_id' FROM lines GROUP BY sha, pid HAVING count(*) > 1""",
)
def published_manifest_lists(spark, folder):
    selected, entries, members = _lists(spark, folder)
    found = MA.audit_selection(selected).unionByName(MA.audit_replay_order(entries)).unionByName(MA.audit_members(members, entries, selected, few=True))
    return found.select("subject", "check")


@query(
    "published_manifest_headers", "AUD-03",
    f"""WITH {_LISTS_SQL}, lists AS (SELECT count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'holdout') AS holdout FROM replays),
    rules AS (SELECT unnest({_HEADER_RULES}) AS rule, unnest(range({len(_HEADER_RULES)})) AS fault)
    SELECT CAST(n_nationkey AS VARCHAR) AS subject, 'header.' || rule AS "check" FROM nation JOIN rules ON fault = n_nationkey
    UNION ALL SELECT '18', 'header.' || unnest(['train_replay_count', 'holdout_replay_count']) FROM lists WHERE train <> holdout AND EXISTS (SELECT 1 FROM nation WHERE n_nationkey = 18)""",
)
def published_manifest_headers(spark, folder):
    """One header per nation: the first break one rule each, one has its splits exchanged, the others are right."""
    selected, entries, _ = _lists(spark, folder)
    number = F.col("n_nationkey")
    lists = entries.agg(F.count_if(F.col("split") == "train").alias("_t"), F.count_if(F.col("split") == "holdout").alias("_h"))
    players = selected.agg(F.count(F.lit(1)).alias("_s"))
    rows = MA.attach(adapters.table(spark, folder, "nation"), lists, players)
    broken = dict(zip(_HEADER_RULES, range(len(_HEADER_RULES)), strict=True))
    put = lambda rule, right, wrong: F.when(number == broken[rule], wrong).otherwise(right)
    total, swap = F.col("_t") + F.col("_h"), number == 18
    headers = rows.select(
        number.cast("string").alias("manifest"), put("analysis_version", F.lit("v3"), F.lit("v3/x")).alias("analysis_version"),
        put("generated_at", F.lit("2026-01-02T03:04:05Z"), F.lit("2026-01-02T03:04:05")).alias("generated_at"),
        put("analysis_root", F.lit("analysis"), F.lit("analysis/../x")).alias("analysis_root"), put("raw_root", F.lit("raw"), F.lit(None)).alias("raw_root"),
        put("leaderboard_sha256", F.sha2("n_name", 256), F.upper(F.sha2("n_name", 256))).alias("leaderboard_sha256"),
        put("leaderboard_size_bytes", F.lit(10), F.lit(0)).alias("leaderboard_size_bytes"), put("top_fraction_per_role", F.lit(0.25), F.lit(1.5)).alias("top_fraction_per_role"),
        put("min_players_per_role", F.lit(5), F.lit(0)).alias("min_players_per_role"), put("min_matches", F.lit(1), F.lit(None)).alias("min_matches"),
        put("min_minutes", F.lit(0.0), F.lit(float("nan"))).alias("min_minutes"), put("max_uncertainty", F.lit(2.0), F.lit(-1.0)).alias("max_uncertainty"),
        put("holdout_modulus", F.lit(10), F.lit(1)).alias("holdout_modulus"), put("holdout_bucket", F.lit(0), F.lit(10)).alias("holdout_bucket"),
        put("rejected_exceeds_scanned", F.lit(1).cast("long"), total + 10).alias("quality_rejected"), put("published_exceeds_scanned", total + 5, total - 1).alias("analysis_files_scanned"),
        put("selected_player_count", F.col("_s"), F.col("_s") + 1).alias("selected_player_count"),
        F.when(swap, F.col("_h")).otherwise(put("train_replay_count", F.col("_t"), F.col("_t") + 1)).alias("train_replay_count"),
        F.when(swap, F.col("_t")).otherwise(put("holdout_replay_count", F.col("_h"), F.lit(None))).alias("holdout_replay_count"),
    )
    return MA.audit_header(headers, entries, selected).select("subject", "check")
