"""Career statistics of players over validated match rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.scalars import display_name, identity_key, ratio_or_zero
from touchline.operators.rows import attach

SAMPLES_PER_MINUTE = 600.0

# Counters of a player row and the sort keys of the player table.
COUNTERS = [
    "samples", "nearest_ball_samples", "close_ball_samples", "input_events", "kick_events", "kick_pressed_inputs",
    "touches", "self_retouches", "team_touch_transfers_out", "turnovers", "recoveries", "pressured_transitions",
    "retained_under_pressure", "touch_progression_events", "touch_goals", "touch_assists",
]

SORT_KEYS = {
    "involvement": "involvement_score",
    "matches": "matches",
    "minutes": "active_minutes",
    "kicks": "kicks_per_min",
    "near-ball": "nearest_ball_pct",
    "close-ball": "close_ball_pct",
    "touches": "touches_per_min",
    "retention": "touch_retention_pct",
    "recoveries": "recoveries_per_min",
    "progression": "touch_progression",
}


def player_row_is_valid(row=None) -> Column:
    """A player row that may count: no negative counter, ball samples within samples, finite progression.

    ``row`` is a struct column (inside an array) or nothing (top-level columns). Null counters are wrong
    here; readers fill absent ones with 0.
    """
    get = (lambda n: row[n]) if row is not None else F.col
    checks = [F.coalesce(get(c) >= 0, F.lit(False)) for c in COUNTERS]
    progression = get("touch_progression_sum")
    checks += [
        F.coalesce(get("nearest_ball_samples") <= get("samples"), F.lit(False)),
        F.coalesce(get("close_ball_samples") <= get("samples"), F.lit(False)),
        progression.isNotNull() & ~F.isnan(progression) & (F.abs(progression) < float("inf")),
    ]
    ok = checks[0]
    for check in checks[1:]:
        ok = ok & check
    return ok


def valid_artifacts(artifacts: DataFrame) -> DataFrame:
    """Artifacts of schema 3 or 4 in which every player row is valid (FLT-01)."""
    return artifacts.filter(
        F.col("schema_version").isin(3, 4) & F.col("players").isNotNull() & F.forall("players", player_row_is_valid)
    )


def rows_of_valid_matches(rows: DataFrame, match: str = "match_id") -> DataFrame:
    """The flat form of the same rule: one invalid row removes its whole match."""
    broken = rows.filter(~player_row_is_valid()).select(match).distinct()
    return rows.join(broken, match, "left_anti")


def career_totals(rows: DataFrame) -> DataFrame:
    """Totals, distinct matches and the usual display name per identity (AGG-03).

    Sums form per identity and name first, which leaves a few rows per player before the shuffle and gives
    the usual name on the way (ties go to the lowest). Distinct matches need only two columns of their own.
    """
    identity = identity_key(F.col("auth_hash"), F.col("name"))
    summed = [*COUNTERS, "touch_progression_sum"]
    # Names as written group first, so the text work is done once per name and not once per row.
    written = rows.groupBy("auth_hash", "name").agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(c) for c in summed]
    )
    named = (
        written.select(identity.alias("player_id"), display_name(F.col("name")).alias("name"), "_n", *summed)
        .filter(F.col("player_id").isNotNull())
        .groupBy("player_id", "name")
        .agg(F.sum("_n").alias("_n"), *[F.sum(c).alias(c) for c in summed])
    )
    shown = F.when(F.length("name") > 0, F.struct((-F.col("_n")).alias("_n"), "name"))
    totals = named.groupBy("player_id").agg(*[F.sum(c).alias(c) for c in summed], F.min(shown)["name"].alias("name"))
    matches = (
        rows.select(identity.alias("player_id"), "match_id")
        .distinct()
        .groupBy("player_id")
        .agg(F.count(F.lit(1)).alias("matches"))
    )
    return totals.join(matches, "player_id")


def career_rates(totals: DataFrame) -> DataFrame:
    """Per-minute rates and percentages; an empty denominator gives 0 (AGG-04)."""
    c = F.col
    minutes = c("samples") / SAMPLES_PER_MINUTE
    retained = c("self_retouches") + c("team_touch_transfers_out")
    return totals.withColumns(
        {
            "active_minutes": minutes,
            "nearest_ball_pct": 100.0 * ratio_or_zero(c("nearest_ball_samples"), c("samples")),
            "close_ball_pct": 100.0 * ratio_or_zero(c("close_ball_samples"), c("samples")),
            "kicks_per_min": ratio_or_zero(c("kick_events"), minutes),
            "inputs_per_min": ratio_or_zero(c("input_events"), minutes),
            "touches_per_min": ratio_or_zero(c("touches"), minutes),
            "touch_retention_pct": 100.0 * ratio_or_zero(retained, retained + c("turnovers")),
            "pressured_retention_pct": 100.0
            * ratio_or_zero(c("retained_under_pressure"), c("pressured_transitions")),
            "touch_progression": ratio_or_zero(c("touch_progression_sum"), c("touch_progression_events")),
            "recoveries_per_min": ratio_or_zero(c("recoveries"), minutes),
            "goal_contrib_per_10": 10.0 * ratio_or_zero(c("touch_goals") + c("touch_assists"), minutes),
        }
    )


def with_minimum(rows: DataFrame, matches: int, minutes: float, minutes_column: str = "active_minutes") -> DataFrame:
    """Players with enough matches and minutes (FLT-05)."""
    return rows.filter(
        (F.col("matches") >= max(1, matches)) & (F.col(minutes_column) >= max(0.0, float(minutes)))
    )


def involvement(rows: DataFrame) -> DataFrame:
    """Involvement score from population z-scores, damped for few matches (WIN-08).

    Means and deviations are one aggregate row, read as a scalar subquery, not a window over all players.
    """
    parts = {"kicks_per_min": 0.50, "close_ball_pct": 0.30, "nearest_ball_pct": 0.20}
    stats = rows.agg(
        *[F.avg(c).alias(f"_mean_{c}") for c in parts], *[F.stddev_pop(c).alias(f"_sd_{c}") for c in parts]
    )
    z = lambda c: F.when(F.col(f"_sd_{c}") > 1e-12, (F.col(c) - F.col(f"_mean_{c}")) / F.col(f"_sd_{c}")).otherwise(0.0)
    raw = sum((F.lit(w) * z(c) for c, w in parts.items()), F.lit(0.0))
    damping = F.least(F.lit(1.0), F.sqrt(F.greatest(F.lit(0), F.col("matches")) / 30.0))
    return attach(rows, stats).select(*rows.columns, (raw * damping).alias("involvement_score"))


def player_table(
    rows: DataFrame, *, sort: str = "involvement", top: int = 25, min_matches: int = 20, min_minutes: float = 30.0
) -> DataFrame:
    """The player report: gates, score and the top rows by one of ten keys (TOP-02)."""
    eligible = with_minimum(career_rates(career_totals(rows)), min_matches, min_minutes)
    return (
        involvement(eligible)
        .orderBy(F.desc(SORT_KEYS[sort]), F.desc("matches"), "player_id")
        .limit(max(1, top))
    )


def dashboard_players(rows: DataFrame, *, top: int = 150) -> DataFrame:
    """The dashboard's player list: five matches and minutes, most matches first (TOP-05)."""
    eligible = with_minimum(career_rates(career_totals(rows)), 5, 5.0)
    return involvement(eligible).orderBy(F.desc("matches"), F.desc("active_minutes"), "player_id").limit(top).select(
        "player_id", "name", "matches", "active_minutes", "touches_per_min", "touch_retention_pct",
        "pressured_retention_pct", "recoveries_per_min", "goal_contrib_per_10", "kicks_per_min",
        "touch_progression", "involvement_score",
    )
