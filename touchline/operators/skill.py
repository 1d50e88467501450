"""Skill ratings: per-match metrics, role-aware normalisation, context, shrinkage, roll-up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.scalars import attack_x, clamp, display_name, identity_key
from touchline.operators.sequences import column_facts, exact_medians
from touchline.session import computed_once, materialize

# Dimensions with their weight in the rating.
DIMENSION_WEIGHTS = {
    "retention": 0.18,
    "progression": 0.14,
    "creation": 0.14,
    "finishing": 0.14,
    "defending": 0.14,
    "positioning": 0.08,
    "pressure_recovery": 0.09,
    "risk_management": 0.09,
}
DIMENSIONS = list(DIMENSION_WEIGHTS)
ROLES = ("defender", "forward", "midfield", "unknown")
# Population floor, scale of a median deviation, prior weights.
LOCAL_POPULATION = 30
MAD_SCALE = 1.4826
STRENGTH_PRIOR = 6.0
RATING_PRIOR = 8.0


def minutes_played() -> Column:
    """Minutes from samples at the replay's sampling step; 60 logic frames a second."""
    step = F.coalesce(F.when(F.col("sample_every_ticks") > 0, F.col("sample_every_ticks")), F.lit(6))
    return F.col("samples") * F.greatest(step, F.lit(1)) / 3600.0


def infer_roles(rows: DataFrame, *, zero_id_unknown: bool = True) -> DataFrame:
    """Role of a player in a match from the rank of the average position along the attack (WIN-07).

    Rows: match_id, team, player, samples, average_x. Ties rank by player id. ``zero_id_unknown`` keeps the
    established behaviour that replay player 0 never gets a role.
    """
    placed = F.coalesce(F.col("team").isin(1, 2) & (F.col("samples") > 0), F.lit(False)) & F.col("average_x").isNotNull()
    marked = rows.withColumns(
        {"_side": F.when(placed, F.col("team")).otherwise(-1), "_ax": attack_x(F.col("team"), F.col("average_x"))}
    )
    # The players of one match are few, so a match stays together and its rows move once; one order serves rank and size.
    side = Window.partitionBy("match_id", "_side").orderBy("_ax", "player")
    everyone = side.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = marked.withColumns({"_rank": F.row_number().over(side), "_players": F.count(F.lit(1)).over(everyone)})
    share = (F.col("_rank") - 1) / F.greatest(F.col("_players") - 1, F.lit(1))
    role = (
        F.when((F.col("_side") == -1) | (F.col("_players") < 3), "unknown")
        .when(share <= 0.33, "defender")
        .when(share >= 0.67, "forward")
        .otherwise("midfield")
    )
    if zero_id_unknown:
        role = F.when(F.col("player") == 0, "unknown").otherwise(role)
    return ranked.select(*rows.columns, role.alias("role"))


def raw_metrics(minutes: Column) -> dict[str, Column]:
    """The eight raw metrics of a match row; null below the evidence floors (PRJ-17)."""
    c = F.col
    new = c("schema_version") >= 4
    pick = lambda touch, kick: F.when(new, c(touch)).otherwise(c(kick))
    transfers = pick("team_touch_transfers_out", "inferred_retained_chains")
    retained = F.when(new, c("team_touch_transfers_out") + c("self_retouches")).otherwise(c("inferred_retained_chains"))
    lost = pick("turnovers", "inferred_lost_chains")
    recoveries = pick("recoveries", "inferred_recoveries")
    goals = pick("touch_goals", "inferred_goals")
    assists = pick("touch_assists", "inferred_assists")
    steps = pick("touch_progression_events", "progression_events")
    progression = pick("touch_progression_sum", "progression_sum")
    seen = c("samples") >= 30
    long_enough = minutes >= 0.5
    pressed = F.when(c("pressured_transitions") >= 3, c("retained_under_pressure") / c("pressured_transitions"))
    close = F.when(seen, c("close_ball_samples") / c("samples"))
    return {
        "retention": F.when(retained + lost >= 3, retained / (retained + lost)),
        "progression": F.when(steps >= 3, progression / steps),
        "creation": F.when(long_enough, assists * 10.0 / minutes + transfers / minutes * 0.05),
        "finishing": F.when(long_enough, goals * 10.0 / minutes),
        "defending": F.when(long_enough, recoveries / minutes),
        "positioning": F.when(seen, c("nearest_ball_samples") / c("samples")),
        "pressure_recovery": F.when(new, pressed).otherwise(close),
        "risk_management": F.when(long_enough, -(lost / minutes)),
    }


def match_evidence(rows: DataFrame) -> DataFrame:
    """Match rows with role, minutes and raw metrics; rows without identity or minutes are dropped.

    Metrics need no role, so the counters end in them before the rows of a match are sorted.
    """
    measured = rows.withColumn("minutes", minutes_played()).select(
        "match_id", "team", "player", "samples", "average_x", "auth_hash", "name", "minutes",
        (F.col("total_frames") / 3600.0).alias("match_minutes"),
        *[m.alias(n) for n, m in raw_metrics(F.col("minutes")).items()],
    )
    placed = computed_once(infer_roles(measured), _shown=display_name(F.col("name")))
    placed = computed_once(placed, player_id=identity_key(F.col("auth_hash"), F.col("_shown"), shown=True))
    evidence = placed.filter(F.col("player_id").isNotNull() & (F.col("minutes") > 0))
    return evidence.select(
        "player_id",
        "match_id",
        "team",
        F.col("_shown").alias("name"),
        "role",
        "minutes",
        "match_minutes",
        *DIMENSIONS,
    )


def _finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))


def normalizers(evidence: DataFrame) -> DataFrame:
    """Centre and scale per role and dimension (AGG-08): median and 1.4826 MAD.

    A role with fewer than 30 values in a dimension uses everybody's. A vanishing MAD falls back to the
    population deviation, then to 1. Appearances under a minute do not shape the population. Everybody's values
    are measured only where a role needs them.
    """
    shaping = F.col("minutes") >= 1.0
    usable = {d: F.when(shaping & _finite(F.col(d)), F.col(d)) for d in DIMENSIONS}
    # Everybody is one more role, in the dimensions alone that some role takes from it.
    facts = column_facts(evidence, ["role"], usable)
    counts = facts.select(*[F.col(f"_{d}")["n"].alias(d) for d in DIMENSIONS]).collect()
    short = {d for d in DIMENSIONS for of_role in counts if of_role[d] < LOCAL_POPULATION}
    own_role = F.col("role") != "*"
    population = evidence.select(F.explode(F.array("role", F.lit("*")) if short else F.array("role")).alias("role"), *[v.alias(d) for d, v in usable.items()])
    population = population.select("role", *[F.col(d) if d in short else F.when(own_role, F.col(d)).alias(d) for d in DIMENSIONS])
    # At most five roles with eight dimensions each; written out as it is read several times.
    medians = materialize(exact_medians(population, ["role"], DIMENSIONS, facts=None if short else facts).coalesce(1))
    centres = medians.groupBy("role").agg(*[F.max(F.when(F.col("name") == d, F.col("median"))).alias(f"_center_{d}") for d in DIMENSIONS])
    away = population.join(F.broadcast(centres), "role").select(
        "role", *[F.abs(F.col(d) - F.col(f"_center_{d}")).alias(d) for d in DIMENSIONS]
    )
    # A median is at most one deviation from the mean, so the middle distance from it is at most two: sd +- sd encloses it.
    enclosed = medians.groupBy("role").agg(*[
        F.max(F.when(F.col("name") == d, F.struct(F.col("sd").alias("mean"), "n", "sd"))).alias(f"_{d}") for d in DIMENSIONS
    ])
    mads = materialize(exact_medians(away, ["role"], DIMENSIONS, facts=materialize(enclosed.coalesce(1))).coalesce(1)).select("role", "name", F.col("median").alias("_mad"))
    robust = F.col("_mad") * MAD_SCALE
    scale = F.when(robust > 1e-9, robust).when(F.col("sd") > 1e-9, F.col("sd")).otherwise(1.0)
    own = medians.join(mads, ["role", "name"]).select(
        "role", F.col("name").alias("dimension"), "n", F.col("median").alias("center"), scale.alias("scale")
    )
    everybody = own.filter(F.col("role") == "*").select(
        "dimension", F.col("center").alias("g_center"), F.col("scale").alias("g_scale")
    )
    wanted = evidence.select("role").distinct().select(
        "role", F.explode(F.array(*[F.lit(d) for d in DIMENSIONS])).alias("dimension")
    )
    keys = ["role", "dimension"]
    local = own.filter((F.col("role") != "*") & (F.col("n") >= LOCAL_POPULATION)).drop("n")
    return (
        wanted.join(local, keys, "left")
        .join(everybody, "dimension", "left")
        .select(*keys, F.coalesce("center", "g_center").alias("center"), F.coalesce("scale", "g_scale").alias("scale"))
        .filter(F.col("center").isNotNull())
    )


def normalize(evidence: DataFrame, norms: DataFrame) -> DataFrame:
    """Replace raw metrics by z values limited to +-3.

    The normalisers become one row per role, so the evidence meets them in a single join of at most a few
    roles.
    """
    own = lambda d: F.col("dimension") == d
    per_role = norms.groupBy("role").agg(
        *[F.max(F.when(own(d), F.col(c))).alias(f"_{c}_{d}") for d in DIMENSIONS for c in ("center", "scale")]
    )
    joined = evidence.join(F.broadcast(per_role), "role", "left")
    z = lambda d: (F.col(d) - F.col(f"_center_{d}")) / F.col(f"_scale_{d}")
    kept = [c for c in evidence.columns if c not in DIMENSIONS]
    return joined.select(*kept, *[clamp(z(d), -3.0, 3.0).alias(d) for d in DIMENSIONS])


def exposure() -> Column:
    """Weight of an appearance from its minutes (PRJ-18)."""
    return clamp(F.sqrt(F.col("minutes") / 3.0), 0.25, 2.0)


def match_quality_weight() -> Column:
    """Weight of a match from its length (PRJ-18)."""
    return clamp(F.col("match_minutes") / 3.0, 0.15, 1.0)


def player_strengths(normalized: DataFrame) -> DataFrame:
    """Preliminary strength of every player, shrunk to 0 and limited to +-2.

    Written out, so that its size is known to the join with the match rows, which need not move for a small one.
    """
    present = [F.when(F.col(d).isNotNull(), 1).otherwise(0) for d in DIMENSIONS]
    count = reduce(lambda a, b: a + b, present)
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(d), F.lit(0.0)) for d in DIMENSIONS])
    rows = normalized.filter(count > 0).select("player_id", exposure().alias("_w"), (total / count).alias("_v"))
    sums = rows.groupBy("player_id").agg(F.sum(F.col("_v") * F.col("_w")).alias("_s"), F.sum("_w").alias("_w"))
    return materialize(sums.select("player_id", clamp(F.col("_s") / (F.col("_w") + STRENGTH_PRIOR), -2.0, 2.0).alias("strength")))


def with_contexts(normalized: DataFrame, strengths: DataFrame) -> DataFrame:
    """Add the mean strength of the others in the team and of the opponents (JON-10), as +-1 values.

    Sums and counts of the two teams answer both, so no pairs of players are formed: team mates are the sum
    without oneself, opponents the other team's sum. The rows of a match, which are few, are brought
    together once; ``_member`` marks the first row of each player in a team, null contexts spectators.
    """
    known = normalized.join(strengths, "player_id", "left").withColumn("_strength", F.coalesce("strength", F.lit(0.0)))
    match = Window.partitionBy("match_id")
    player = Window.partitionBy("match_id", "team", "player_id").orderBy("minutes")
    playing = known.repartition("match_id").withColumn("_member", F.col("team").isin(1, 2) & (F.row_number().over(player) == 1))
    sums = {}
    for team in (1, 2):
        mine = F.col("_member") & (F.col("team") == team)
        sums[f"_sum_{team}"] = F.sum(F.when(mine, F.col("_strength")).otherwise(0.0)).over(match)
        sums[f"_n_{team}"] = F.sum(F.when(mine, 1).otherwise(0)).over(match)
    both = playing.withColumns(sums)
    of = lambda what, own: F.when((F.col("team") == 1) == F.lit(own), F.col(f"_{what}_1")).otherwise(F.col(f"_{what}_2"))
    mates = F.when(of("n", True) > 1, (of("sum", True) - F.col("_strength")) / (of("n", True) - 1)).otherwise(0.0)
    opponents = F.when(of("n", False) > 0, of("sum", False) / of("n", False)).otherwise(0.0)
    plays = F.col("team").isin(1, 2)
    return both.select(
        *normalized.columns,
        "_member",
        F.when(plays, clamp(mates / 2.0, -1.0, 1.0)).alias("teammate_context"),
        F.when(plays, clamp(opponents / 2.0, -1.0, 1.0)).alias("opponent_context"),
    )


def match_contexts(normalized: DataFrame, strengths: DataFrame) -> DataFrame:
    """The contexts of every player of a team, once: (match_id, team, player_id, both contexts)."""
    columns = ["match_id", "team", "player_id", "teammate_context", "opponent_context"]
    return with_contexts(normalized, strengths).filter("_member").select(*columns)


def context_adjustment(teammate: Column, opponent: Column, difficulty: Column | None = None) -> Column:
    """Small bounded correction of an observation."""
    none = F.lit(0.0)
    raw = 0.10 * F.coalesce(opponent, none) - 0.10 * F.coalesce(teammate, none)
    if difficulty is not None:
        raw = raw + 0.10 * F.coalesce(difficulty, none)
    return clamp(raw, -0.25, 0.25)


def _sums() -> dict[str, Column]:
    """Algebraic sums from which a player's estimate follows."""
    weight = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("quality"))) * F.greatest(F.lit(0.0), F.col("exposure"))
    sums = {"observation_count": F.count(F.lit(1)), "_all": F.sum(weight)}
    for d in DIMENSIONS:
        known = F.col(d).isNotNull()
        sums[f"_w_{d}"] = F.sum(F.when(known, weight).otherwise(0.0))
        sums[f"_s_{d}"] = F.sum(F.when(known, (F.col(d) + F.col("adjustment")) * weight).otherwise(0.0))
    return sums


def _estimates(prior_mean: float, prior_weight: float) -> list[Column]:
    def estimate(d: str) -> Column:
        total = F.col(f"_w_{d}") + prior_weight
        return F.struct(
            F.bround((F.col(f"_s_{d}") + prior_mean * prior_weight) / total, 6).alias("mean"),
            F.bround(1.0 / F.sqrt(total), 6).alias("uncertainty"),
            F.bround(total - prior_weight, 6).alias("effective_weight"),
        ).alias(d)

    return [estimate(d) for d in DIMENSIONS]


def shrink(observations: DataFrame, *, prior_mean: float = 0.0, prior_weight: float = 5.0) -> DataFrame:
    """Shrinkage estimate of every dimension per player (AGG-09), one wide row each.

    Input: player_id, the eight dimensions, quality, exposure, adjustment. All sums are algebraic, so a
    player with very many matches is combined before the shuffle.
    """
    sums = observations.groupBy("player_id").agg(*[c.alias(n) for n, c in _sums().items()])
    return sums.select(
        "player_id",
        "observation_count",
        F.bround("_all", 6).alias("effective_weight"),
        *_estimates(prior_mean, prior_weight),
    )


def rating_columns() -> dict[str, Column]:
    """Overall z, rating and uncertainty from a row of dimension estimates."""
    used = {d: F.when(F.col(d)["effective_weight"] > 0, F.lit(w)).otherwise(0.0) for d, w in DIMENSION_WEIGHTS.items()}
    total = reduce(lambda a, b: a + b, used.values())
    mean = reduce(lambda a, b: a + b, [F.col(d)["mean"] * w for d, w in used.items()])
    doubt = reduce(lambda a, b: a + b, [F.col(d)["uncertainty"] * w for d, w in used.items()])
    overall = F.when(total > 0, mean / total).otherwise(0.0)
    return {
        "overall_z": overall,
        "rating": clamp(50.0 + 10.0 * overall, 20.0, 80.0),
        "rating_uncertainty": 10.0 * F.when(total > 0, doubt / total).otherwise(1.0),
    }


def observations(normalized: DataFrame, strengths: DataFrame) -> DataFrame:
    """Normalised rows with contexts and weights, ready for :func:`shrink`."""
    joined = with_contexts(normalized, strengths).drop("_member")
    none = F.lit(0.0)
    mate, opponent = F.coalesce("teammate_context", none), F.coalesce("opponent_context", none)
    return joined.withColumns(
        {
            "teammate_context": mate,
            "opponent_context": opponent,
            "quality": match_quality_weight(),
            "exposure": exposure(),
            "adjustment": context_adjustment(mate, opponent),
        }
    )


def roll_up(rows: DataFrame) -> DataFrame:
    """Leaderboard rows from observations (AGG-10).

    One pass: sums per player, name and role first, from which totals, the usual name and the main role of
    a player follow.
    """
    first = {
        **_sums(),
        "_minutes": F.sum("minutes"),
        "_mate": F.sum("teammate_context"),
        "_opponent": F.sum("opponent_context"),
    }
    parts = rows.groupBy("player_id", "name", "role").agg(*[c.alias(n) for n, c in first.items()])
    by_role = [
        F.sum(F.when(F.col("role") == r, F.col("_minutes")).otherwise(0.0)).alias(f"_r_{r}") for r in ROLES
    ]
    named = parts.groupBy("player_id", "name").agg(*[F.sum(n).alias(n) for n in first], *by_role)
    roles = [f"_r_{r}" for r in ROLES]
    # Minutes are multiples of 1/3600: rounding takes away what the order of summing adds to equal ones.
    played = lambda r: F.round(F.col(f"_r_{r}"), 6)
    shown = F.when(F.length("name") > 0, F.struct((-F.col("observation_count")).alias("_n"), "name"))
    totals = named.groupBy("player_id").agg(
        *[F.sum(n).alias(n) for n in [*first, *roles]], F.min(shown)["name"].alias("name")
    )
    main_role = F.array_min(
        F.array(*[F.struct((-played(r)).alias("_m"), F.lit(r).alias("role")) for r in ROLES])
    )["role"]
    count = F.col("observation_count")
    rated = totals.select(
        "player_id",
        "name",
        count.alias("matches"),
        F.col("_minutes").alias("minutes"),
        main_role.alias("role"),
        (F.col("_mate") / count).alias("average_teammate_context"),
        (F.col("_opponent") / count).alias("average_opponent_context"),
        *_estimates(0.0, RATING_PRIOR),
    )
    dimensions = F.struct(*[F.col(d) for d in DIMENSIONS]).alias("dimensions")
    return rated.select(
        "player_id", "name", "matches", "minutes", "role",
        *[c.alias(n) for n, c in rating_columns().items()],
        "average_teammate_context", "average_opponent_context", dimensions,
    )


def top_of_leaderboard(
    board: DataFrame, *, top: int = 30, min_matches: int = 20, min_minutes: float = 60.0
) -> DataFrame:
    """Best rated players after the gates (TOP-01, FLT-05)."""
    return (
        board.filter((F.col("matches") >= max(1, min_matches)) & (F.col("minutes") >= max(0.0, min_minutes)))
        .orderBy(F.desc("rating"), "rating_uncertainty", F.desc("matches"), "player_id")
        .limit(max(1, top))
    )
