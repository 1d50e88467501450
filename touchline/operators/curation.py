"""Choosing players, replays and splits for training data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.scalars import example_weight, holdout_bucket
from touchline.operators.sequences import rank_within


def _positive(value: Column) -> Column:
    return F.coalesce(value > 0, F.lit(False))


def replay_rejections() -> Column:
    """Reasons against a replay, an empty array if it is accepted (FLT-02).

    Columns: schema_version, total_frames, sampled_states, players (number, null if unreadable), touches
    (null if the summary is missing).
    """
    c = F.col
    return F.array_compact(
        F.array(
            F.when(c("schema_version").isNull(), "invalid_schema_version").when(
                c("schema_version") < 4, "schema_before_v4"
            ),
            F.when(c("total_frames").isNull() | (c("total_frames") < 0), "invalid_total_frames").when(
                c("total_frames") / 60.0 < 120.0, "shorter_than_2m"
            ),
            F.when(~_positive(c("sampled_states")), "no_sampled_state"),
            F.when(c("players").isNull(), "invalid_players").when(c("players") < 4, "fewer_than_4_players"),
            F.when(c("touches").isNull(), "invalid_feature_summary").when(c("touches") <= 0, "no_touch_evidence"),
        )
    )


def rejection_histogram(replays: DataFrame) -> DataFrame:
    """How often each reason rejected a replay (AGG-16)."""
    return replays.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def leaderboard_row_is_valid() -> Column:
    """A leaderboard row that selection may use (FLT-04)."""
    c = F.col
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    text = lambda x: F.coalesce(F.length(F.trim(x)) > 0, F.lit(False))
    return (
        text(c("player_id"))
        & text(c("role"))
        & F.coalesce(c("matches") >= 0, F.lit(False))
        & finite(c("minutes"))
        & F.coalesce(c("minutes") >= 0, F.lit(False))
        & finite(c("rating"))
        & finite(c("rating_uncertainty"))
        & F.coalesce(c("rating_uncertainty") >= 0, F.lit(False))
    )


def select_players(
    board: DataFrame,
    *,
    top_fraction: float = 0.25,
    min_players: int = 5,
    min_matches: int = 30,
    min_minutes: float = 120.0,
    max_uncertainty: float = 1.5,
) -> DataFrame:
    """The best share of every role by rating minus uncertainty (TOP-03)."""
    if not 0.0 <= top_fraction <= 1.0:
        raise ValueError("top_fraction must be in [0, 1]")
    if min_players < 1 or min_matches < 1 or min_minutes < 0 or max_uncertainty < 0:
        raise ValueError("minimums must be positive and limits not negative")
    eligible = board.filter(
        leaderboard_row_is_valid()
        & (F.col("matches") >= min_matches)
        & (F.col("minutes") >= min_minutes)
        & (F.col("rating_uncertainty") <= max_uncertainty)
    ).select(
        "player_id",
        "name",
        F.trim("role").alias("role"),
        "rating",
        "rating_uncertainty",
        (F.col("rating") - F.col("rating_uncertainty")).alias("conservative_score"),
        "matches",
        "minutes",
    )
    order = [F.desc("conservative_score"), F.desc("rating"), F.desc("matches"), F.asc("player_id")]
    ranked = rank_within(eligible, ["role"], order, rank="_rank", size="_size")
    quota = F.greatest(F.lit(min_players), F.ceil(F.col("_size") * F.lit(top_fraction)))
    return ranked.filter(F.col("_rank") <= quota).drop("_rank", "_size")


def selected_in_replays(players: DataFrame, accepted: DataFrame, selected: DataFrame) -> DataFrame:
    """Selected players that really played in accepted replays (JON-09, FLT-07), one row each.

    ``players``: replay_sha256, replay_player_id, identity, team, samples. Rows stay flat, so a replay may
    have any number of players.
    """
    playing = players.filter(
        F.col("team").isin(1, 2) & (F.col("samples") > 0) & (F.col("replay_player_id") >= 0)
    )
    return playing.join(accepted.select("replay_sha256"), "replay_sha256", "left_semi").join(
        selected.select(F.col("player_id").alias("identity"), "conservative_score"), "identity"
    )


def manifest_entries(
    members: DataFrame, replays: DataFrame, *, modulus: int = 10, bucket: int = 0, salt: str = "holdout-v1:"
) -> DataFrame:
    """One row per training replay with weight and split (PRJ-15, PRJ-19, SET-01)."""
    if modulus < 2 or not 0 <= bucket < modulus:
        raise ValueError("bucket must be in [0, modulus) and modulus at least 2")
    per_replay = members.groupBy("replay_sha256").agg(
        F.count(F.lit(1)).alias("selected_player_count"), F.max("conservative_score").alias("_best")
    )
    holdout = holdout_bucket(F.col("replay_sha256"), modulus, salt) == bucket
    return per_replay.join(replays.select("replay_sha256", "total_frames"), "replay_sha256").select(
        "replay_sha256",
        "total_frames",
        F.bround(F.col("total_frames") / 60.0, 3).alias("duration_seconds"),
        "selected_player_count",
        example_weight(F.col("_best")).alias("example_weight"),
        F.when(holdout, "holdout").otherwise("train").alias("split"),
    )


def cross_split_leakage(entries: DataFrame) -> DataFrame:
    """Replays that are in more than one split (SET-02)."""
    side = lambda name: entries.filter(F.col("split") == name).select("replay_sha256")
    return side("train").intersect(side("holdout"))
