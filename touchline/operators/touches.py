"""From ordered match events to touches, kicks, goals and per-player totals.

Input ``events``: replay, seq (unique and increasing with frame in a replay), frame, kind, player, team,
ball_x, ball_y, pressure_distance, goal_team. Kinds: ``contact``, ``kick``, ``goal``, ``reset`` (game
start or stop); other kinds are ignored here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.scalars import UNDER_PRESSURE_DISTANCE, attack_x, heat_bin
from touchline.operators.sequences import cut, look_around

# Windows in frames, outcome codes and the length of the kick memory.
TOUCH_GAP = 3
KICK_OUTCOME_WINDOW = 240
GOAL_WINDOW = 300
ASSIST_WINDOW = 600
KICK_MEMORY = 12
UNRESOLVED, SELF_RETOUCH, TEAMMATE, OPPONENT, GOAL = 0, 1, 2, 3, 4

_CHAIN_COLUMNS = [
    "replay", "seq", "frame", "kind", "player", "team", "ball_x", "ball_y", "pressure_distance", "goal_team",
]


def _plays(team: Column) -> Column:
    return F.coalesce(team.isin(1, 2), F.lit(False))


def _row(condition: Column, *fields: str) -> Column:
    return F.when(condition, F.struct("seq", *fields))


def play_segments(events: DataFrame, *, parts: int | None = None) -> DataFrame:
    """Number the stretches of play: each goal, start or stop ends one (WIN-01).

    ``segment`` is the seq of the last reset before the row, -1 in the first stretch.
    """
    is_reset = F.col("kind").isin("goal", "reset")
    marked = look_around(events, ["replay"], "seq", before={"_last": _row(is_reset)}, parts=parts)
    return marked.withColumn("segment", F.coalesce(F.col("_last.seq"), F.lit(-1))).drop("_last")


def chain_events(events: DataFrame, *, parts: int | None = None) -> DataFrame:
    """First pass: segment, debounced touches, the kick before and the reset after each row.

    Only the contact right before decides whether a contact is a new touch, and it does so before rows
    without a playing team are dropped (WIN-02).
    """
    is_reset = F.col("kind").isin("goal", "reset")
    kinds = F.col("kind").isin("contact", "kick", "goal", "reset")
    rows = cut(events.select(*_CHAIN_COLUMNS).filter(kinds), ["replay"], ["seq"], parts)
    marked = look_around(
        rows,
        ["replay"],
        "seq",
        before={
            "_reset": _row(is_reset),
            "_contact": _row(F.col("kind") == "contact", "player", "frame"),
            "_kick": _row(F.col("kind") == "kick", "player", "team", "frame", "ball_x"),
        },
        after={"_end": _row(is_reset, "kind", "frame", "goal_team")},
        parts=parts,
    )
    segment = F.coalesce(F.col("_reset.seq"), F.lit(-1).cast("long"))
    same_stretch = lambda c: F.when(F.col(f"{c}.seq") > segment, F.col(c))
    continued = F.coalesce(
        (F.col("_contact.seq") > segment)
        & (F.col("_contact.player") == F.col("player"))
        & (F.col("frame") - F.col("_contact.frame") <= TOUCH_GAP),
        F.lit(False),
    )
    return marked.select(
        *_CHAIN_COLUMNS,
        "_chunk",
        segment.alias("segment"),
        ((F.col("kind") == "contact") & ~continued & _plays(F.col("team"))).alias("is_touch"),
        same_stretch("_kick").alias("last_kick"),
        F.when(F.col("_end.kind") == "goal", F.struct("_end.frame", "_end.goal_team")).alias("end_goal"),
        F.coalesce(F.col("pressure_distance") <= UNDER_PRESSURE_DISTANCE, F.lit(False)).alias("under_pressure"),
    )


def resolve_chain(chain: DataFrame, *, parts: int | None = None) -> DataFrame:
    """Second pass: the next touch after every touch and the touch that settles every kick."""
    kick_age = F.col("frame") - F.col("last_kick.frame")
    settles = F.col("is_touch") & ((F.col("player") != F.col("last_kick.player")) | (kick_age > TOUCH_GAP))
    rows = chain.filter(F.col("is_touch") | F.col("kind").isin("kick", "goal"))
    seen = look_around(
        rows,
        ["replay"],
        "seq",
        after={
            "next_touch": _row(F.col("is_touch"), "segment", "player", "team", "frame", "ball_x"),
            "settling": _row(F.coalesce(settles, F.lit(False)), "last_kick", "player", "team", "frame"),
            "next_kick": _row(F.col("kind") == "kick", "segment"),
        },
        parts=parts,
    )
    return seen.select(
        *chain.columns,
        F.when(F.col("next_touch.segment") == F.col("segment"), F.col("next_touch")).alias("next_touch"),
        F.when(F.col("settling.last_kick.seq") == F.col("seq"), F.col("settling")).alias("settling"),
        F.when(F.col("next_kick.segment") == F.col("segment"), F.col("next_kick")).alias("next_kick"),
    )


def _credited(window: int) -> Column:
    """The goal that ends the stretch is by this row's team and soon enough."""
    return F.coalesce(
        (F.col("end_goal.goal_team") == F.col("team")) & (F.col("end_goal.frame") - F.col("frame") <= window),
        F.lit(False),
    )


def touch_outcomes(resolved: DataFrame) -> DataFrame:
    """One row per touch with outcome, next player and progression (WIN-03, sparse touch layout)."""
    nxt = F.col("next_touch")
    outcome = (
        F.when(nxt.isNull(), F.when(_credited(GOAL_WINDOW), GOAL).otherwise(UNRESOLVED))
        .when(nxt["player"] == F.col("player"), SELF_RETOUCH)
        .when(nxt["team"] == F.col("team"), TEAMMATE)
        .otherwise(OPPONENT)
    )
    progression = attack_x(F.col("team"), nxt["ball_x"]) - attack_x(F.col("team"), F.col("ball_x"))
    return resolved.filter("is_touch").select(
        "replay", "segment", "seq", "frame", "player", "team", "ball_x", "ball_y",
        "pressure_distance", "under_pressure",
        outcome.alias("outcome"), nxt["player"].alias("next_player"), progression.alias("progression"),
    )


def kick_outcomes(resolved: DataFrame) -> DataFrame:
    """One row per kick: who touched the ball next within 240 frames, or the goal it led to (JON-15).

    The chain of kicks (WIN-05) is read from the kick before: same team retained, other team lost.
    """
    by = F.col("settling")
    in_time = by["frame"] - F.col("frame") <= KICK_OUTCOME_WINDOW
    outcome = (
        F.when(by.isNull(), F.when(F.col("next_kick").isNull() & _credited(GOAL_WINDOW), GOAL).otherwise(UNRESOLVED))
        .when(~in_time, UNRESOLVED)
        .when(by["player"] == F.col("player"), SELF_RETOUCH)
        .when(F.coalesce(by["team"] == F.col("team"), F.lit(False)), TEAMMATE)
        .otherwise(OPPONENT)
    )
    previous = F.col("last_kick")
    linked = _plays(previous["team"]) & _plays(F.col("team"))
    retained = linked & (previous["team"] == F.col("team"))
    return (
        resolved.filter(F.col("kind") == "kick")
        .select(
            "replay", "segment", "seq", "frame", "player", "team", "ball_x", "ball_y",
            "pressure_distance", "under_pressure",
            outcome.alias("outcome"),
            F.when(by.isNotNull() & in_time, by["player"]).alias("next_player"),
            F.when(linked, previous["player"]).alias("chain_player"),
            F.when(linked, retained).alias("chain_retained"),
            F.when(
                retained,
                attack_x(previous["team"], F.col("ball_x")) - attack_x(previous["team"], previous["ball_x"]),
            ).alias("chain_progression"),
        )
    )


def goal_credits(touches: DataFrame, goals: DataFrame) -> DataFrame:
    """Scorer and assist of every goal from the touches of its stretch (JON-16, WIN-06).

    The last touch scores if its team does so within 300 frames; the assist is the last touch by somebody
    else, same team, within 600. Each touch belongs to one stretch, so it meets at most one goal.
    """
    by_player = (
        touches.groupBy("replay", "segment", "player")
        .agg(F.max(F.struct("seq", "frame", "team")).alias("t"))
        .select("replay", "segment", "player", "t.*")
    )
    newest = Window.partitionBy("replay", "segment").orderBy(F.desc("seq"))
    last_two = by_player.withColumn("n", F.row_number().over(newest)).filter("n <= 2")
    pairs = last_two.groupBy("replay", "segment").agg(
        F.max(F.when(F.col("n") == 1, F.struct("player", "team", "frame"))).alias("s"),
        F.max(F.when(F.col("n") == 2, F.struct("player", "team", "frame"))).alias("a"),
    )
    age = lambda who: F.col("frame") - F.col(f"{who}.frame")
    scored = (F.col("s.team") == F.col("goal_team")) & (age("s") <= GOAL_WINDOW)
    assisted = scored & (F.col("a.team") == F.col("goal_team")) & (age("a") <= ASSIST_WINDOW)
    return goals.join(pairs, ["replay", "segment"], "left").select(
        "replay", "segment", "seq", "frame", "goal_team",
        F.when(scored, F.col("s.player")).alias("scorer"),
        F.when(assisted, F.col("a.player")).alias("assist"),
    )


def kick_goal_credits(kicks: DataFrame, goals: DataFrame) -> DataFrame:
    """Scorer and assist from the last twelve kicks before a goal (JON-17)."""
    newest = Window.partitionBy("replay", "segment").orderBy(F.desc("seq"))
    recent = (
        kicks.select("replay", "segment", "seq", "frame", "player", "team")
        .withColumn("n", F.row_number().over(newest))
        .filter(F.col("n") <= KICK_MEMORY)
        .groupBy("replay", "segment")
        .agg(F.sort_array(F.collect_list(F.struct("n", "frame", "player", "team"))).alias("recent"))
    )
    nobody = F.lit(None).cast("long")
    start = F.struct(nobody.alias("scorer"), nobody.alias("assist"), F.lit(False).alias("done"))

    def step(state: Column, kick: Column) -> Column:
        age = F.col("frame") - kick["frame"]
        ours = F.coalesce(kick["team"] == F.col("goal_team"), F.lit(False))
        scorer, assist = state["scorer"], state["assist"]
        takes_goal = scorer.isNull() & ours & (age <= GOAL_WINDOW)
        takes_assist = scorer.isNotNull() & ours & (kick["player"] != scorer)
        over = (age > ASSIST_WINDOW) | (scorer.isNotNull() & ~ours)
        return F.when(state["done"], state).when(
            over, F.struct(scorer.alias("scorer"), assist.alias("assist"), F.lit(True).alias("done"))
        ).otherwise(
            F.struct(
                F.when(takes_goal, kick["player"].cast("long")).otherwise(scorer).alias("scorer"),
                F.when(takes_assist, kick["player"].cast("long")).otherwise(assist).alias("assist"),
                takes_assist.alias("done"),
            )
        )

    credit = F.aggregate(F.coalesce(F.col("recent"), F.array()), start, step)
    return (
        goals.join(recent, ["replay", "segment"], "left")
        .withColumn("credit", credit)
        .select(
            "replay", "segment", "seq", "frame", "goal_team",
            F.col("credit.scorer").alias("scorer"), F.col("credit.assist").alias("assist"),
        )
    )


def collapsed_runs(touches: DataFrame) -> DataFrame:
    """Keep the latest touch of every run of touches by one player (WIN-06)."""
    return touches.filter(F.col("next_player").isNull() | (F.col("next_player") != F.col("player")))


def touch_totals(touches: DataFrame) -> DataFrame:
    """Per player and replay: what happened to the touches made and who received them (AGG-07, WIN-04).

    Every touch gives one row to its own player and, when the next touch is by somebody else, one to
    that player; the sums combine before the shuffle.
    """
    one = lambda condition: F.when(condition, 1).otherwise(0)
    out = F.col("outcome")
    moved = out.isin(SELF_RETOUCH, TEAMMATE, OPPONENT)
    pressed = moved & F.col("under_pressure")
    progressed = moved & F.col("progression").isNotNull()
    own = F.struct(
        F.col("player").alias("who"),
        F.lit(1).alias("touches"),
        one(out == SELF_RETOUCH).alias("self_retouches"),
        one(out == TEAMMATE).alias("team_touch_transfers_out"),
        one(F.lit(False)).alias("team_touch_receipts"),
        one(out == OPPONENT).alias("turnovers"),
        one(F.lit(False)).alias("recoveries"),
        one(F.col("pressure_distance").isNotNull()).alias("pressure_observations"),
        F.coalesce(F.col("pressure_distance"), F.lit(0.0)).alias("pressure_distance_sum"),
        one(F.col("under_pressure")).alias("under_pressure_touches"),
        one(pressed).alias("pressured_transitions"),
        one(pressed & (out != OPPONENT)).alias("retained_under_pressure"),
        one(pressed & (out == OPPONENT)).alias("lost_under_pressure"),
        one(progressed).alias("touch_progression_events"),
        F.when(progressed, F.col("progression")).otherwise(0.0).alias("touch_progression_sum"),
    )
    zeros = ["touches", "self_retouches", "team_touch_transfers_out"]
    other = F.struct(
        F.col("next_player").alias("who"),
        *[F.lit(0).alias(n) for n in zeros],
        one(out == TEAMMATE).alias("team_touch_receipts"),
        F.lit(0).alias("turnovers"),
        one(out == OPPONENT).alias("recoveries"),
        F.lit(0).alias("pressure_observations"),
        F.lit(0.0).alias("pressure_distance_sum"),
        *[
            F.lit(0).alias(n)
            for n in (
                "under_pressure_touches", "pressured_transitions", "retained_under_pressure",
                "lost_under_pressure", "touch_progression_events",
            )
        ],
        F.lit(0.0).alias("touch_progression_sum"),
    )
    both = F.when(out.isin(TEAMMATE, OPPONENT), F.array(own, other)).otherwise(F.array(own))
    rows = touches.select("replay", F.inline(both))
    counters = [c for c in rows.columns if c not in ("replay", "who")]
    totals = rows.groupBy("replay", F.col("who").alias("player")).agg(*[F.sum(c).alias(c) for c in counters])
    ratio = lambda a, b: F.when(b > 0, a / b)
    c = F.col
    return totals.select(
        "*",
        ratio(c("pressure_distance_sum"), c("pressure_observations")).alias("average_pressure_distance"),
        ratio(c("under_pressure_touches"), c("pressure_observations")).alias("under_pressure_touch_rate"),
        ratio(c("team_touch_transfers_out"), c("team_touch_transfers_out") + c("turnovers")).alias(
            "touch_retention_rate"
        ),
        ratio(c("retained_under_pressure"), c("pressured_transitions")).alias("pressured_retention_rate"),
        ratio(c("touch_progression_sum"), c("touch_progression_events")).alias("average_touch_progression"),
    )


def kick_totals(kicks: DataFrame) -> DataFrame:
    """Per player and replay: kick outcomes and the older kick-chain counters."""
    one = lambda condition: F.when(F.coalesce(condition, F.lit(False)), 1).otherwise(0)
    out, kept = F.col("outcome"), F.col("chain_retained")
    names = [
        "kick_events", "under_pressure_kick_events", "kick_self_retouches", "kick_transfers_to_teammate",
        "kick_transfers_to_opponent", "received_kick_transfers", "intercepted_kick_transfers",
        "inferred_retained_chains", "inferred_lost_chains", "inferred_recoveries", "progression_events",
        "progression_sum",
    ]

    def part(who: Column, **values: Column) -> Column:
        zero = lambda n: F.lit(0.0) if n == "progression_sum" else F.lit(0)
        return F.struct(who.alias("who"), *[values.get(n, zero(n)).alias(n) for n in names])

    parts = F.array(
        part(
            F.col("player"),
            kick_events=F.lit(1),
            under_pressure_kick_events=one(F.col("under_pressure")),
            kick_self_retouches=one(out == SELF_RETOUCH),
            kick_transfers_to_teammate=one(out == TEAMMATE),
            kick_transfers_to_opponent=one(out == OPPONENT),
            inferred_recoveries=one(~kept),
        ),
        part(
            F.col("next_player"),
            received_kick_transfers=one(out == TEAMMATE),
            intercepted_kick_transfers=one(out == OPPONENT),
        ),
        part(
            F.col("chain_player"),
            inferred_retained_chains=one(kept),
            inferred_lost_chains=one(~kept),
            progression_events=one(F.col("chain_progression").isNotNull()),
            progression_sum=F.coalesce(F.col("chain_progression"), F.lit(0.0)),
        ),
    )
    rows = kicks.select("replay", F.inline(parts)).filter(F.col("who").isNotNull())
    return rows.groupBy("replay", F.col("who").alias("player")).agg(*[F.sum(n).alias(n) for n in names])


def position_histogram(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Counts per pitch square (AGG-05)."""
    return rows.groupBy(*keys, heat_bin(F.col(x), F.col(y)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def as_map(histogram: DataFrame, keys: list[str], bin_column: str = "bin") -> DataFrame:
    """Histogram rows as one map per key; a pitch has a bounded number of squares."""
    pairs = F.collect_list(F.struct(F.col(bin_column), F.col("n")))
    return histogram.groupBy(*keys).agg(F.map_from_entries(F.sort_array(pairs)).alias("histogram"))


def artifact_summary(totals: DataFrame) -> DataFrame:
    """Feature summary of a replay from its player totals (AGG-21)."""
    names = ["touches", "team_touch_transfers_out", "turnovers", "recoveries"]
    return totals.groupBy("replay").agg(
        *[F.sum(n).alias(n) for n in names], F.count(F.lit(1)).alias("players")
    )


def goal_totals(credits: DataFrame) -> DataFrame:
    """Goals and assists per player and replay from credited goals."""
    parts = F.array(
        F.struct(F.col("scorer").alias("who"), F.lit(1).alias("goals"), F.lit(0).alias("assists")),
        F.struct(F.col("assist").alias("who"), F.lit(0).alias("goals"), F.lit(1).alias("assists")),
    )
    rows = credits.select("replay", F.inline(parts)).filter(F.col("who").isNotNull())
    return rows.groupBy("replay", F.col("who").alias("player")).agg(
        F.sum("goals").alias("goals"), F.sum("assists").alias("assists")
    )


