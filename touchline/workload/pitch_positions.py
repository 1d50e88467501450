"""Queries over sampled positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline import adapters
from touchline.functions import scalars as fn
from touchline.operators import positions as X
from touchline.session import materialize
from touchline.workload.registry import query

_PLACES = """round(avg(floor(l_extendedprice / 100)) - 250, 6) AS x, round(avg(l_quantity) * 8 - 200, 6) AS y,
    round(avg(round_even(l_discount * 100, 0)) - 5, 6) AS vx, round(avg(round_even(l_tax * 100, 0)) - 4, 6) AS vy"""
POSITIONS_SQL = f"""
st AS (
  SELECT l_orderkey // 8 AS replay, CAST((l_linenumber % 3) * 6 AS INTEGER) AS frame, l_suppkey AS player,
    CASE WHEN l_suppkey % 10 = 9 THEN 0 ELSE CAST(l_suppkey % 2 + 1 AS INTEGER) END AS team, {_PLACES}
  FROM lineitem GROUP BY ALL
),
ball AS (
  SELECT l_orderkey // 8 AS replay, CAST((l_linenumber % 3) * 6 AS INTEGER) AS frame, {_PLACES} FROM lineitem GROUP BY ALL
),
inp AS (
  SELECT replay, player, frame, q % 3 - 1 AS dir_x, (q // 3) % 3 - 1 AS dir_y, CASE WHEN tax > 0.065 THEN 1 ELSE 0 END AS kick
  FROM (SELECT l_orderkey // 8 AS replay, l_suppkey AS player, CAST((l_linenumber % 7) * 2 AS INTEGER) AS frame,
          CAST(max(l_quantity) AS INTEGER) AS q, max(l_tax) AS tax
        FROM lineitem GROUP BY ALL)
)
"""


def _tables(spark, folder):
    return adapters.states(spark, folder), adapters.balls(spark, folder)


@query(
    "event_pressure", "JON-11",
    f"""WITH {POSITIONS_SQL}, ev AS (SELECT replay, frame, player FROM inp WHERE kick = 1)
    SELECT e.replay, e.frame, e.player,
      round(min(sqrt((o.x - s.x) * (o.x - s.x) + (o.y - s.y) * (o.y - s.y))), 5) AS pressure_distance,
      CAST(coalesce(min(sqrt((o.x - s.x) * (o.x - s.x) + (o.y - s.y) * (o.y - s.y))) <= 45, false) AS INTEGER) AS under_pressure
    FROM ev e LEFT JOIN st s ON s.replay = e.replay AND s.frame = e.frame AND s.player = e.player AND s.team IN (1, 2)
    LEFT JOIN st o ON o.replay = s.replay AND o.frame = s.frame AND o.team = 3 - s.team
    GROUP BY ALL""",
)
def event_pressure(spark, folder):
    states, _ = _tables(spark, folder)
    kicks = adapters.inputs(spark, folder).filter("kick = 1").select("replay", "frame", "player")
    return X.event_pressure(kicks, states).select(
        "replay", "frame", "player", F.round("pressure_distance", 5).alias("pressure_distance"),
        F.col("under_pressure").cast("int").alias("under_pressure"),
    )


@query(
    "nearest_to_ball", "JON-12",
    f"""WITH {POSITIONS_SQL}
    SELECT replay, frame, arg_min(player, (d2, player)) AS player, round(min(d2), 4) AS d2, CAST(min(d2) <= 900 AS INTEGER) AS close
    FROM (SELECT s.*, (s.x - b.x) * (s.x - b.x) + (s.y - b.y) * (s.y - b.y) AS d2 FROM st s JOIN ball b USING (replay, frame))
    GROUP BY ALL""",
)
def nearest_to_ball(spark, folder):
    return X.nearest_to_ball(*_tables(spark, folder)).select(
        "replay", "frame", "player", F.round("d2", 4).alias("d2"), F.col("close").cast("int").alias("close")
    )


@query(
    "ball_samples_per_player", "JON-12 AGG-05",
    f"""WITH {POSITIONS_SQL},
    near AS (
      SELECT replay, frame, arg_min(player, (d2, player)) AS player, min(d2) AS d2
      FROM (SELECT s.*, (s.x - b.x) * (s.x - b.x) + (s.y - b.y) * (s.y - b.y) AS d2 FROM st s JOIN ball b USING (replay, frame))
      GROUP BY ALL)
    SELECT s.replay, s.player, count(*) AS samples, round(avg(s.x), 9) AS average_x, round(avg(s.y), 9) AS average_y,
      count(n.player) AS nearest_ball_samples, count(*) FILTER (n.d2 <= 900) AS close_ball_samples
    FROM st s LEFT JOIN near n USING (replay, frame, player) GROUP BY ALL""",
)
def ball_samples_per_player(spark, folder):
    return X.ball_samples_per_player(*_tables(spark, folder)).select(
        "replay", "player", "samples", F.round("average_x", 9).alias("average_x"),
        F.round("average_y", 9).alias("average_y"), "nearest_ball_samples", "close_ball_samples",
    )


@query(
    "ball_summary", "AGG-06",
    f"""WITH {POSITIONS_SQL}
    SELECT replay, count(*) AS samples, round(avg(x), 9) AS average_x, round(avg(y), 9) AS average_y,
      round(avg(sqrt(vx * vx + vy * vy)), 9) AS average_speed FROM ball GROUP BY ALL""",
)
def ball_summary(spark, folder):
    return X.ball_summary(adapters.balls(spark, folder)).select(
        "replay", "samples", *[F.round(c, 9).alias(c) for c in ("average_x", "average_y", "average_speed")]
    )


@query(
    "ball_heatmap", "AGG-05 PRJ-10",
    f"""WITH {POSITIONS_SQL}
    SELECT replay, concat(CAST(floor(x / 20) AS BIGINT), ':', CAST(floor(y / 20) AS BIGINT)) AS bin, count(*) AS n
    FROM ball GROUP BY ALL""",
)
def ball_heatmap(spark, folder):
    return X.ball_heatmap(adapters.balls(spark, folder))


NEIGHBOUR_SQL = """
rel AS (
  SELECT s.replay, s.frame, s.player, s.team, o.team = s.team AS mate, o.player AS other,
    o.x - s.x AS dx, o.y - s.y AS dy, o.vx - s.vx AS dvx, o.vy - s.vy AS dvy,
    row_number() OVER (PARTITION BY s.replay, s.frame, s.player, o.team = s.team
      ORDER BY (o.x - s.x) * (o.x - s.x) + (o.y - s.y) * (o.y - s.y), o.player) AS n
  FROM st s JOIN st o ON o.replay = s.replay AND o.frame = s.frame AND o.player <> s.player
  WHERE s.team IN (1, 2) AND o.team IN (1, 2)
)
"""


@query(
    "nearest_players_in_frame", "JON-13",
    f"""WITH {POSITIONS_SQL}, {NEIGHBOUR_SQL}
    SELECT replay, frame, player, max(other) FILTER (mate AND n = 1) AS mate_1, max(other) FILTER (mate AND n = 2) AS mate_2,
      max(other) FILTER (NOT mate AND n = 1) AS opponent_1, max(other) FILTER (NOT mate AND n = 2) AS opponent_2,
      max(other) FILTER (NOT mate AND n = 3) AS opponent_3
    FROM (SELECT DISTINCT replay, frame, player FROM st WHERE team IN (1, 2)) LEFT JOIN rel USING (replay, frame, player)
    GROUP BY ALL""",
)
def nearest_players_in_frame(spark, folder):
    states, _ = _tables(spark, folder)
    points = states.filter(F.col("team").isin(1, 2))
    keys = ["replay", "frame", "player"]
    near = X.neighbours(points, states)
    pick = lambda c, i, name: F.get(F.col(c), F.lit(i))["player"].alias(name)
    return near.select(
        *keys, pick("mates", 0, "mate_1"), pick("mates", 1, "mate_2"),
        pick("opponents", 0, "opponent_1"), pick("opponents", 1, "opponent_2"), pick("opponents", 2, "opponent_3"),
    )


@query(
    "latest_input_at_frame", "JON-14",
    f"""WITH {POSITIONS_SQL}
    SELECT s.replay, s.frame, s.player, arg_max(i.dir_x, i.frame) AS dir_x, arg_max(i.dir_y, i.frame) AS dir_y,
      arg_max(i.kick, i.frame) AS kick
    FROM st s LEFT JOIN inp i ON i.replay = s.replay AND i.player = s.player AND i.frame <= s.frame GROUP BY ALL""",
)
def latest_input_at_frame(spark, folder):
    states, _ = _tables(spark, folder)
    return X.with_latest_input(states, adapters.inputs(spark, folder)).select(
        "replay", "frame", "player", "action.dir_x", "action.dir_y", "action.kick"
    )


def _selected(states):
    chosen = states.filter(F.col("team") > 0).select("replay", "player", F.col("player").alias("player_index"))
    return chosen.repartition("replay", "player").distinct()


_SIDES = ["tm1", "tm2", "op1", "op2", "op3"]
_COLUMNS = ["own_x", "own_y", "own_vx", "own_vy", "ball_dx", "ball_dy", "ball_dvx", "ball_dvy"] + [
    f"{s}_{c}" for s in _SIDES for c in ("dx", "dy", "dvx", "dvy", "present")
] + ["dir_x", "dir_y", "kick"]


def _neighbour_columns():
    parts = []
    for side in _SIDES:
        which = f"{'mate' if side.startswith('tm') else 'NOT mate'} AND n = {side[-1]}"
        for c in ("dx", "dy", "dvx", "dvy"):
            sign = "* any_value(m.sign)" if c in ("dx", "dvx") else ""
            parts.append(f"coalesce(max(r.{c}) FILTER ({which}), 0) {sign} AS {side}_{c}")
        parts.append(f"CAST(count(r.other) FILTER ({which}) AS DOUBLE) AS {side}_present")
    return ", ".join(parts)


EXAMPLES_SQL = f"""
mine AS (
  SELECT s.*, CASE WHEN team = 1 THEN 1 ELSE -1 END AS sign, b.x AS qx, b.y AS qy, b.vx AS qvx, b.vy AS qvy
  FROM st s JOIN ball b USING (replay, frame) WHERE team IN (1, 2)
),
acts AS (
  SELECT m.replay, m.frame, m.player, arg_max(i.dir_x, i.frame) AS dx, arg_max(i.dir_y, i.frame) AS dy, arg_max(i.kick, i.frame) AS kick
  FROM mine m JOIN inp i ON i.replay = m.replay AND i.player = m.player AND i.frame <= m.frame GROUP BY ALL
),
neigh AS (
  SELECT m.replay, m.frame, m.player, {_neighbour_columns()}
  FROM mine m LEFT JOIN rel r USING (replay, frame, player) GROUP BY ALL
),
examples AS (
  SELECT m.replay, m.frame, m.player, m.player AS player_index, m.team AS team_id,
    sign * x AS own_x, y AS own_y, sign * vx AS own_vx, vy AS own_vy,
    sign * (qx - x) AS ball_dx, qy - y AS ball_dy, sign * (qvx - vx) AS ball_dvx, qvy - vy AS ball_dvy,
    n.* EXCLUDE (replay, frame, player), sign * a.dx AS dir_x, CAST(a.dy AS DOUBLE) AS dir_y, CAST(a.kick AS DOUBLE) AS kick
  FROM mine m JOIN neigh n USING (replay, frame, player) LEFT JOIN acts a USING (replay, frame, player)
)
"""


def examples(spark, folder):
    states, balls = _tables(spark, folder)
    states = materialize(states)
    return X.imitation_examples(states, balls, adapters.inputs(spark, folder), _selected(states))


@query(
    "imitation_examples", "ML-01 PRJ-20 JON-13 JON-14",
    f"""WITH {POSITIONS_SQL}, {NEIGHBOUR_SQL}, {EXAMPLES_SQL}
    SELECT replay, frame, player, player_index, team_id, {', '.join(f'round({c}, 6) AS {c}' for c in _COLUMNS)}
    FROM examples WHERE dir_x IS NOT NULL""",
)
def imitation_examples(spark, folder):
    return examples(spark, folder).filter(F.col("dir_x").isNotNull()).select(
        "replay", "frame", "player", "player_index", "team_id", *[F.round(c, 6).alias(c) for c in _COLUMNS]
    )


@query(
    "imitation_example_counts", "ML-01",
    f"""WITH {POSITIONS_SQL}, {NEIGHBOUR_SQL}, {EXAMPLES_SQL}
    SELECT replay, count(*) AS selected_state_samples, count(dir_x) AS samples, count(*) - count(dir_x) AS skipped_unknown_input,
      count(DISTINCT player) AS selected_players_seen FROM examples GROUP BY ALL""",
)
def imitation_example_counts(spark, folder):
    return X.example_counts(examples(spark, folder))


@query(
    "direction_round_trip", "PRJ-14",
    f"WITH {POSITIONS_SQL} SELECT (dir_y + 1) * 3 + dir_x + 1 AS class, dir_x, dir_y, count(*) AS n FROM inp GROUP BY ALL",
)
def direction_round_trip(spark, folder):
    """Directions of all inputs from their classes."""
    coded = adapters.inputs(spark, folder).select(fn.direction_class(F.col("dir_x"), F.col("dir_y")).alias("class"))
    dir_x, dir_y = fn.direction_from_class(F.col("class"))
    return coded.groupBy("class", dir_x.alias("dir_x"), dir_y.alias("dir_y")).agg(F.count(F.lit(1)).alias("n"))
