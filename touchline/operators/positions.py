"""Sampled positions: distances, nearest players, ball summaries, imitation examples.

``states``: replay, frame, player, team, x, y, vx, vy. ``balls``: replay, frame, x, y, vx, vy.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.scalars import CLOSE_BALL_DISTANCE, UNDER_PRESSURE_DISTANCE, heat_bin
from touchline.session import materialize

#: A frame of at most this many players is one array; the cells of a larger one hold about ``CELL`` players each.
CROWD, CELL = 128, 32
TEAMMATES, OPPONENTS = 2, 3
#: Frames of one stretch of a player's record.
STRETCH = 600

_PLACE = ["player", "team", "x", "y", "vx", "vy"]
_FRAME = ["replay", "frame"]


def _nearest(members: Column, own_team: bool, limit: int) -> Column:
    """The closest of one array on one side, as (d2, player, dx, dy, dvx, dvy) in distance order, ties by player."""
    if not limit:
        return F.array().cast("array<struct<d2:double,player:long,dx:double,dy:double,dvx:double,dvy:double>>")
    side = F.col("team") if own_team else 3 - F.col("team")
    others = F.filter(members, lambda m: (m["team"] == side) & (m["player"] != F.col("player")))
    dx, dy = (lambda m: m["x"] - F.col("x")), (lambda m: m["y"] - F.col("y"))
    measured = F.transform(
        others,
        lambda m: F.struct(
            (dx(m) * dx(m) + dy(m) * dy(m)).alias("d2"), m["player"].alias("player"), dx(m).alias("dx"), dy(m).alias("dy"),
            (m["vx"] - F.col("vx")).alias("dvx"), (m["vy"] - F.col("vy")).alias("dvy"),
        ),
    )
    return F.slice(F.sort_array(measured), 1, limit)


def _grid(level: int) -> tuple[Column, Column]:
    """Cells a side, and their width, of a frame's grid at a level; each level has half the cells of the one before."""
    side = F.ceil(F.sqrt(F.col("n") / CELL))
    cells = F.ceil(side / F.lit(1 << level))
    return cells, F.greatest(F.col("high_x") - F.col("low_x"), F.col("high_y") - F.col("low_y")) / side * (1 << level)


def _cell(level: int, axis: str) -> Column:
    cells, width = _grid(level)
    return F.when(width > 0, F.least(F.floor((F.col(axis) - F.col(f"low_{axis}")) / width), cells - 1)).otherwise(0)


def _certain(level: int) -> Column:
    """What lies nearer than this to a point is in its cell or one next to it; nothing where these are all."""
    cells, width = _grid(level)
    bounds = []
    for axis in ("x", "y"):
        at, low = F.col(f"cell_{axis}"), F.col(axis) - F.col(f"low_{axis}")
        bounds += [F.when(at > 1, low - (at - 1) * width), F.when(at + 2 < cells, (at + 2) * width - low)]
    return F.least(*bounds) * (1 - 1e-9)


def _crowded_neighbours(points: DataFrame, placed: DataFrame, crowded: DataFrame, mates: int, opponents: int) -> DataFrame:
    """``points`` in crowded frames with both lists, by a grid per frame.

    A point looks into its cell and those around it. It is done when as many as asked for are nearer than
    anything outside can be; the others go on with cells of twice the width, until the grid is one cell.
    Cells travel as arrays of at most ``CROWD`` players, so one that holds very many is several rows.
    """
    keys = [*_FRAME, "player"]
    inside, open_, done, level = placed.join(crowded, _FRAME), points.join(crowded, _FRAME), [], 0
    facts = [c for c in crowded.columns if c not in _FRAME]
    while True:
        cells = inside.select(*_FRAME, *_PLACE, _cell(level, "x").alias("cell_x"), _cell(level, "y").alias("cell_y"))
        of = [*_FRAME, "cell_x", "cell_y"]
        blocks = cells.groupBy(*of).agg(F.ceil(F.count(F.lit(1)) / F.lit(CROWD)).alias("_blocks"))
        spread = cells.join(blocks, of).withColumn("_block", F.pmod(F.xxhash64("player"), F.col("_blocks")))
        arrays = spread.groupBy(*of, "_block").agg(F.collect_list(F.struct(*_PLACE)).alias("members"))
        own = open_.withColumns({"cell_x": _cell(level, "x"), "cell_y": _cell(level, "y")}).withColumn("_certain", _certain(level))
        around = [F.struct((F.col("cell_x") + i).alias("cell_x"), (F.col("cell_y") + j).alias("cell_y")) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        asked = own.select(*keys, "team", "x", "y", "vx", "vy", F.explode(F.array(*around)).alias("_at")).select("*", "_at.*").drop("_at")
        met = asked.join(arrays, of).select(*keys, _nearest(F.col("members"), True, mates).alias("_m"), _nearest(F.col("members"), False, opponents).alias("_o"))
        merged = lambda c, limit: F.slice(F.sort_array(F.flatten(F.collect_list(c))), 1, limit) if limit else F.first(c)
        best = met.groupBy(*keys).agg(merged("_m", mates).alias("mates"), merged("_o", opponents).alias("opponents"))
        near = lambda c, limit: (F.size(c) == limit) & (F.get(c, F.lit(limit - 1))["d2"] < F.col("_certain") * F.col("_certain")) if limit else F.lit(True)
        sure = F.col("_certain").isNull() | F.coalesce(near("mates", mates) & near("opponents", opponents), F.lit(False))
        found = materialize(own.join(best, keys, "left").withColumn("_sure", sure))
        done.append(found.where("_sure").select(*points.columns, "mates", "opponents"))
        left = found.where("NOT _sure").select(*points.columns, *facts)
        if left.isEmpty():
            return reduce(DataFrame.unionByName, done)
        open_, level = left, level + 1


def neighbours(points: DataFrame, states: DataFrame, *, mates: int = TEAMMATES, opponents: int = OPPONENTS) -> DataFrame:
    """``points`` (replay, frame, player, team, x, y, vx, vy and more) with the nearest ``mates`` and ``opponents`` in
    their frame, as arrays in distance order (JON-13). Distances tie by player id; players of no team are nobody's
    neighbours. A point is known by its replay, frame and player.

    Ordinary frames are one array of both teams each, and points meet them in one join. Frames of more than
    ``CROWD`` players are searched by cells (:func:`_crowded_neighbours`).
    """
    return _neighbours(points, materialize(_placed(states)), mates, opponents)


def _placed(states: DataFrame) -> DataFrame:
    return states.filter(F.col("team").isin(1, 2)).select(*_FRAME, *_PLACE)


def _neighbours(points: DataFrame, placed: DataFrame, mates: int, opponents: int) -> DataFrame:
    edge = [f(c).alias(f"{name}_{c}") for c in ("x", "y") for name, f in (("low", F.min), ("high", F.max))]
    crowded = materialize(placed.groupBy(*_FRAME).agg(F.count(F.lit(1)).alias("n"), *edge).where(F.col("n") > CROWD))
    lists = lambda members: [_nearest(members, True, mates).alias("mates"), _nearest(members, False, opponents).alias("opponents")]
    several = not crowded.isEmpty()
    usual = placed.join(crowded.select(*_FRAME), _FRAME, "left_anti") if several else placed
    frames = usual.groupBy(*_FRAME).agg(F.collect_list(F.struct(*_PLACE)).alias("_members"))
    near = points.join(frames, _FRAME, "left").select(*points.columns, *lists(F.coalesce("_members", F.array().cast(frames.schema["_members"].dataType))))
    if not several:
        return near
    near = near.join(crowded.select(*_FRAME), _FRAME, "left_anti")
    return near.unionByName(_crowded_neighbours(points, placed, crowded, mates, opponents))


def event_pressure(events: DataFrame, states: DataFrame) -> DataFrame:
    """Distance of the nearest opponent at the frame of each event, and whether it presses (JON-11).

    ``events``: replay, frame, player (and more). The own position is the state row at the same frame;
    spectators are no opponents.
    """
    own = states.filter(F.col("team").isin(1, 2)).select(*_FRAME, *_PLACE)
    points = own.join(events.select("replay", "frame", "player").distinct(), ["replay", "frame", "player"], "left_semi")
    near = neighbours(points, states, mates=0, opponents=1)
    found = near.select(
        "replay", "frame", "player", F.col("team").alias("own_team"), F.sqrt(F.get("opponents", F.lit(0))["d2"]).alias("pressure_distance")
    )
    return events.join(found, ["replay", "frame", "player"], "left").withColumn(
        "under_pressure", F.coalesce(F.col("pressure_distance") <= UNDER_PRESSURE_DISTANCE, F.lit(False))
    )


def nearest_to_ball(states: DataFrame, balls: DataFrame) -> DataFrame:
    """Per frame the player nearest to the ball and whether it is close (JON-12): one minimum per frame."""
    ball = balls.select("replay", "frame", F.col("x").alias("bx"), F.col("y").alias("by"))
    dx, dy = F.col("x") - F.col("bx"), F.col("y") - F.col("by")
    return (
        states.join(ball, ["replay", "frame"])
        .groupBy("replay", "frame")
        .agg(F.min(F.struct((dx * dx + dy * dy).alias("d2"), "player")).alias("_m"))
        .select(
            "replay", "frame", F.col("_m.player").alias("player"), F.col("_m.d2").alias("d2"),
            (F.col("_m.d2") <= CLOSE_BALL_DISTANCE * CLOSE_BALL_DISTANCE).alias("close"),
        )
    )


def ball_samples_per_player(states: DataFrame, balls: DataFrame) -> DataFrame:
    """Samples, average place, nearest and close ball samples per replay and player."""
    near = nearest_to_ball(states, balls)
    counts = near.groupBy("replay", "player").agg(
        F.count(F.lit(1)).alias("nearest_ball_samples"), F.count_if("close").alias("close_ball_samples")
    )
    seen = states.groupBy("replay", "player").agg(
        F.count(F.lit(1)).alias("samples"), F.avg("x").alias("average_x"), F.avg("y").alias("average_y")
    )
    zero = F.lit(0)
    return seen.join(counts, ["replay", "player"], "left").withColumns(
        {c: F.coalesce(F.col(c), zero) for c in ("nearest_ball_samples", "close_ball_samples")}
    )


def ball_summary(balls: DataFrame) -> DataFrame:
    """Samples, mean place and mean speed of the ball per replay (AGG-06)."""
    return balls.groupBy("replay").agg(
        F.count(F.lit(1)).alias("samples"),
        F.avg("x").alias("average_x"),
        F.avg("y").alias("average_y"),
        F.avg(F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy"))).alias("average_speed"),
    )


def ball_heatmap(balls: DataFrame) -> DataFrame:
    """Pitch squares of the ball per replay."""
    return balls.groupBy("replay", heat_bin(F.col("x"), F.col("y")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def _latest(states: DataFrame, inputs: DataFrame, span: int, several: bool) -> DataFrame:
    """``states`` with the latest input at or before each. Without ``several`` all of their frames are below ``span``."""
    key, stretch = ["replay", "player"], F.greatest(F.floor(F.col("frame") / span), F.lit(0))
    moves = inputs.select(*key, stretch.alias("_part"), F.struct("frame", F.struct("dir_x", "dir_y", "kick").alias("action")).alias("_move"))
    if several:
        at, rows = [*key, "_part"], states.withColumn("_part", stretch)
    else:
        at, rows, moves = key, states, moves.where("_part = 0")
    known = moves.groupBy(*at).agg(F.collect_list("_move").alias("_moves"))
    met = rows.join(known, at, "left")
    latest = F.array_max(F.filter("_moves", lambda m: m["frame"] <= F.col("frame")))
    if several:
        last = known.select(*at, F.array_max("_moves").alias("_last"))
        asked = rows.select(*at, F.lit(None).cast(last.schema["_last"].dataType).alias("_last")).distinct()
        before = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        borders = last.unionByName(asked).groupBy(*at).agg(F.max("_last").alias("_last"))
        met = met.join(borders.select(*at, F.last("_last", ignorenulls=True).over(before).alias("_carry")), at, "left")
        latest = F.coalesce(latest, "_carry")
    return met.select(*states.columns, latest["action"].alias("action"))


def with_latest_input(states: DataFrame, inputs: DataFrame, *, span: int = STRETCH) -> DataFrame:
    """Attach the player's latest input at or before each sampled frame (JON-14); null if none is known yet.

    A record is cut into stretches of ``span`` frames. The inputs of one are an array, which its samples meet in one
    join, and only where samples go beyond the first stretch the last input of each is carried on, one row a
    stretch; so a player with a very long record is not one task, and short records move once.
    """
    return _latest(states, inputs, span, not states.where(F.col("frame") >= span).isEmpty())


def _vector(entry: Column, sign: Column, prefix: str) -> list[Column]:
    """Relative place and speed of another player, mirrored to attack towards +x; zeros if absent (PRJ-20)."""
    here = entry.isNotNull()
    zero = F.lit(0.0)
    pick = lambda field, mirrored: F.when(here, entry[field] * (sign if mirrored else F.lit(1))).otherwise(zero)
    return [
        pick("dx", True).alias(f"{prefix}_dx"),
        pick("dy", False).alias(f"{prefix}_dy"),
        pick("dvx", True).alias(f"{prefix}_dvx"),
        pick("dvy", False).alias(f"{prefix}_dvy"),
        F.when(here, 1.0).otherwise(0.0).alias(f"{prefix}_present"),
    ]


def imitation_examples(
    states: DataFrame, balls: DataFrame, inputs: DataFrame, selected: DataFrame, *, span: int = STRETCH
) -> DataFrame:
    """State-action rows of selected players, the pitch turned so that everybody attacks towards +x (ML-01).

    ``selected``: replay, player, player_index. Rows without a known input have a null ``dir_x``; they are
    the skipped ones and are counted by :func:`example_counts`. ``states`` are read several times: pass written ones.

    Rows meet selection and inputs by player first, then ball and neighbours by frame, so they move once for each.
    """
    placed = _placed(states)
    several = not placed.where(F.col("frame") >= span).isEmpty()
    acted = _latest(placed.join(selected, ["replay", "player"]), inputs, span, several)
    ball = balls.select(
        "replay", "frame", *[F.col(c).alias(f"ball_{c}") for c in ("x", "y", "vx", "vy")]
    )
    near = _neighbours(acted.join(ball, _FRAME), placed, TEAMMATES, OPPONENTS)
    sign = F.when(F.col("team") == 1, 1.0).otherwise(-1.0)
    at = lambda column, i: F.get(column, F.lit(i))
    relative = [
        (sign * (F.col("ball_x") - F.col("x"))).alias("ball_dx"),
        (F.col("ball_y") - F.col("y")).alias("ball_dy"),
        (sign * (F.col("ball_vx") - F.col("vx"))).alias("ball_dvx"),
        (F.col("ball_vy") - F.col("vy")).alias("ball_dvy"),
    ]
    return near.select(
        "replay", "frame", "player", "player_index", F.col("team").alias("team_id"),
        (sign * F.col("x")).alias("own_x"), F.col("y").alias("own_y"),
        (sign * F.col("vx")).alias("own_vx"), F.col("vy").alias("own_vy"),
        *relative,
        *[c for i in range(TEAMMATES) for c in _vector(at("mates", i), sign, f"tm{i + 1}")],
        *[c for i in range(OPPONENTS) for c in _vector(at("opponents", i), sign, f"op{i + 1}")],
        (sign * F.col("action.dir_x")).alias("dir_x"), F.col("action.dir_y").cast("double").alias("dir_y"),
        F.col("action.kick").cast("double").alias("kick"),
    )


def example_counts(examples: DataFrame) -> DataFrame:
    """Selected state samples, written samples and samples skipped for an unknown input per replay."""
    known = F.col("dir_x").isNotNull()
    return examples.groupBy("replay").agg(
        F.count(F.lit(1)).alias("selected_state_samples"),
        F.count_if(known).alias("samples"),
        F.count_if(~known).alias("skipped_unknown_input"),
        F.count_distinct("player").alias("selected_players_seen"),
    )
