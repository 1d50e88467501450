"""Nearest players by grid cells against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from touchline.operators import positions as X

STATES = "replay long, frame int, player long, team int, x double, y double, vx double, vy double"


def brute(rows, mates, opponents):
    out = {}
    for r, f, p, t, x, y, *_ in rows:
        if t not in (1, 2):
            continue
        near = sorted(((ox - x) * (ox - x) + (oy - y) * (oy - y), op, ot) for orr, of, op, ot, ox, oy, *_ in rows if (orr, of) == (r, f) and op != p and ot in (1, 2))
        out[r, f, p] = ([n[1] for n in near if n[2] == t][:mates], [n[1] for n in near if n[2] != t][:opponents])
    return out


def crowd(seed):
    draw = random.Random(seed)
    rows = []
    for replay, n in ((1, 6), (2, 300), (3, 90), (4, 1), (5, 40)):
        for p in range(n):
            kind = draw.random()
            if replay == 3:  # one place for all, but for three
                x, y = (5.0, 5.0) if p > 2 else (draw.uniform(-900, 900), 7.0)
            elif kind < 0.6:  # a knot of players, and some far from all others
                x, y = draw.gauss(100, 3), draw.gauss(50, 3)
            else:
                x, y = draw.uniform(-400, 400), draw.uniform(-200, 200)
            rows.append((replay, 6, p, 0 if p % 10 == 9 else p % 2 + 1, round(x, 1), round(y, 1), 0.5, -0.5))
    return rows


def lists(df):
    return {(r.replay, r.frame, r.player): ([m.player for m in r.mates], [o.player for o in r.opponents]) for r in df.collect()}


@pytest.mark.parametrize(("mates", "opponents"), [(2, 3), (0, 1)])
def test_grid_neighbours_are_those_of_all_pairs(spark, monkeypatch, mates, opponents):
    monkeypatch.setattr(X, "CROWD", 16)
    monkeypatch.setattr(X, "CELL", 4)
    rows = crowd(mates)
    states = spark.createDataFrame(rows, STATES)
    points = states.filter(F.col("team").isin(1, 2))
    assert lists(X.neighbours(points, states, mates=mates, opponents=opponents)) == brute(rows, mates, opponents)


def test_points_without_a_frame_and_no_points(spark):
    states = spark.createDataFrame(crowd(1)[:6], STATES)
    lone = spark.createDataFrame([(9, 9, 1, 1, 0.0, 0.0, 0.0, 0.0)], STATES)
    assert lists(X.neighbours(lone, states)) == {(9, 9, 1): ([], [])}
    assert lists(X.neighbours(states.limit(0), states)) == {} == lists(X.neighbours(states.limit(0), states.limit(0)))


@pytest.mark.parametrize("span", [1, 5, 1000])
def test_latest_input_across_stretches(spark, span):
    """Records of one and of many stretches, stretches without inputs, inputs after the last sample."""
    draw = random.Random(span)
    inputs = sorted({(r, p, draw.randint(0, 40)) for r in range(3) for p in range(3) for _ in range(draw.choice([0, 1, 9]))})
    samples = [(r, p, f) for r in range(3) for p in range(3) for f in range(0, 36, 3)]
    moves = spark.createDataFrame([(r, p, f, f % 3 - 1, f % 2, f) for r, p, f in inputs] or [(9, 9, 0, 0, 0, 0)], "replay long, player long, frame int, dir_x int, dir_y int, kick int")
    states = spark.createDataFrame(samples, "replay long, player long, frame int")
    got = {(s.replay, s.player, s.frame): s.action and s.action.kick for s in X.with_latest_input(states, moves, span=span).collect()}
    assert got == {(r, p, f): max((i[2] for i in inputs if i[:2] == (r, p) and i[2] <= f), default=None) for r, p, f in samples}


def test_examples_move_once_by_player_and_once_by_frame(spark):
    """Rows of short records are dealt by player and by frame, not cut by range and dealt again."""
    states = spark.createDataFrame(crowd(1)[:6], STATES)
    balls = spark.createDataFrame([(1, 6, 0.0, 0.0, 0.0, 0.0)], "replay long, frame int, x double, y double, vx double, vy double")
    inputs = spark.createDataFrame([(1, 1, 3, 1, 0, 1)], "replay long, player long, frame int, dir_x int, dir_y int, kick int")
    selected = spark.createDataFrame([(1, 1, 1)], "replay long, player long, player_index long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = X.imitation_examples(states, balls, inputs, selected)
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "rangepartitioning" not in plan and "Window" not in plan and plan.count("Exchange hashpartitioning") == 6
    assert [(r.player, r.dir_x, r.kick) for r in found.collect()] == [(1, -1.0, 1.0)]
