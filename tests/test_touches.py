"""The declarative event chain against a sequential reading of the rules on random matches."""

import random

import pytest
from pyspark.sql import functions as F

from touchline.operators import touches as T

SCHEMA = (
    "replay string, seq long, frame int, kind string, player long, team int, ball_x double, ball_y double, "
    "pressure_distance double, goal_team int"
)


def random_events(seed, n=400):
    rng = random.Random(seed)
    rows, frame = [], 0
    for seq in range(n):
        frame += rng.choice([0, 1, 2, 5, 40, 130, 350])
        kind = rng.choices(["contact", "kick", "goal", "reset", "input"], [60, 22, 6, 3, 9])[0]
        player = rng.randint(0, 5)
        team = 0 if player == 5 else player % 2 + 1
        pressure = rng.choice([None, 10.0, 44.0, 45.0, 46.0])
        goal_team = rng.choice([1, 2]) if kind == "goal" else None
        rows.append((f"r{seed % 3}", seq, frame, kind, player, team, float(rng.randint(-300, 300)), 0.0, pressure, goal_team))
    return rows


def sequential(rows):
    """State machine over one match: touches, kicks and goals with their outcomes."""
    touches, kicks, goals = [], [], []
    contact = pending = None
    stretch = {"touches": [], "kicks": []}
    for _, seq, frame, kind, player, team, x, _y, _p, goal_team in rows:
        if kind == "contact":
            repeated = contact and contact[0] == player and frame - contact[1] <= 3
            contact = (player, frame)
            if repeated or team not in (1, 2):
                continue
            touch = dict(seq=seq, frame=frame, player=player, team=team, x=x, outcome=0, next=None)
            if stretch["touches"]:
                last = stretch["touches"][-1]
                last["outcome"] = 1 if last["player"] == player else 2 if last["team"] == team else 3
                last["next"] = player
            if pending:
                age = frame - pending["frame"]
                if age > 240:
                    pending = None
                elif player != pending["player"]:
                    pending["outcome"] = 2 if team == pending["team"] else 3
                    pending["next"] = player
                    pending = None
                elif age > 3:
                    pending["outcome"], pending["next"] = 1, player
                    pending = None
            stretch["touches"].append(touch)
            touches.append(touch)
        elif kind == "kick":
            pending = dict(seq=seq, frame=frame, player=player, team=team, outcome=0, next=None)
            stretch["kicks"].append(pending)
            kicks.append(pending)
        elif kind in ("goal", "reset"):
            if kind == "goal":
                goals.append((seq, *credit_touches(stretch["touches"], frame, goal_team), *credit_kicks(stretch["kicks"][-12:], frame, goal_team)))
                last = stretch["touches"][-1] if stretch["touches"] else None
                if last and last["team"] == goal_team and frame - last["frame"] <= 300:
                    last["outcome"] = 4
                if pending and pending["team"] == goal_team and frame - pending["frame"] <= 300:
                    pending["outcome"] = 4
            contact = pending = None
            stretch = {"touches": [], "kicks": []}
    return touches, kicks, goals


def credit_touches(touches, frame, team):
    runs = []
    for t in touches:
        if runs and runs[-1]["player"] == t["player"]:
            runs[-1] = t
        else:
            runs.append(t)
    if not runs or runs[-1]["team"] != team or frame - runs[-1]["frame"] > 300:
        return None, None
    assist = runs[-2] if len(runs) > 1 else None
    ok = assist and assist["team"] == team and frame - assist["frame"] <= 600
    return runs[-1]["player"], assist["player"] if ok else None


def credit_kicks(kicks, frame, team):
    scorer = None
    for k in reversed(kicks):
        age = frame - k["frame"]
        if age > 600 or (scorer is not None and k["team"] != team):
            break
        if k["team"] != team:
            continue
        if scorer is None:
            if age <= 300:
                scorer = k["player"]
        elif k["player"] != scorer:
            return scorer, k["player"]
    return scorer, None


@pytest.mark.parametrize("parts", [5, 61, None])
def test_event_chain(spark, parts):
    for seed in range(2):
        rows = random_events(seed + (parts or 0))
        name = rows[0][0]
        chain = T.chain_events(spark.createDataFrame(rows, SCHEMA), parts=parts)
        resolved = T.resolve_chain(chain, parts=parts)
        touches, kicks, goals = sequential(rows)
        got = {r.seq: r for r in T.touch_outcomes(resolved).collect()}
        assert {s: (r.outcome, r.next_player) for s, r in got.items()} == {
            t["seq"]: (t["outcome"], t["next"]) for t in touches
        }
        got = {r.seq: (r.outcome, r.next_player) for r in T.kick_outcomes(resolved).collect()}
        assert got == {k["seq"]: (k["outcome"], k["next"]) for k in kicks}
        ends = chain.filter("kind = 'goal'")
        by_touch = {r.seq: (r.scorer, r.assist) for r in T.goal_credits(chain.filter("is_touch"), ends).collect()}
        by_kick = {r.seq: (r.scorer, r.assist) for r in T.kick_goal_credits(chain.filter("kind = 'kick'"), ends).collect()}
        assert {s: (*by_touch[s], *by_kick[s]) for s in by_touch} == {g[0]: g[1:] for g in goals}
        assert name == rows[0][0]


def test_heatmap_as_map(spark):
    df = spark.createDataFrame([("a", 1.0, -1.0), ("a", 5.0, -20.0), ("a", 25.0, 0.0)], "p string, x double, y double")
    row = T.as_map(T.position_histogram(df, ["p"], "x", "y"), ["p"]).first()
    assert row.histogram == {"0:-1": 2, "1:0": 1}


def test_stream_equals_batch_with_late_rows(spark, folder):
    from touchline.streaming import jobs
    from touchline.streaming.touch_chain import stream_touches

    rows = random_events(2, n=150)
    df = spark.createDataFrame(rows, SCHEMA)
    for part, (low, high) in enumerate(((0, 60), (60, 100), (100, 150))):
        df.filter((F.col("seq") >= low) & (F.col("seq") < high)).coalesce(1).write.parquet(f"{folder}/in/{part}")
    df.filter("seq = 5").coalesce(1).write.parquet(f"{folder}/in/9")
    import os
    import time

    for i, part in enumerate((0, 1, 2, 9)):
        for name in os.listdir(f"{folder}/in/{part}"):
            os.utime(f"{folder}/in/{part}/{name}", (time.time() - 100 + i, time.time() - 100 + i))
    stream = (
        spark.readStream.schema(df.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1)
        .option("pathGlobFilter", "*.parquet").parquet(f"{folder}/in")
    )
    out = jobs.run_to_table(stream_touches(stream), f"{folder}/run")
    got = {r.seq: (r.outcome, r.next_player) for r in out.filter("late = 0").collect()}
    stops = [r[1] for r in rows if r[3] in ("goal", "reset")]
    want = {t["seq"]: (t["outcome"], t["next"]) for t in sequential(rows)[0] if t["next"] is not None or t["seq"] < max(stops)}
    assert got == want
    expected_late = 1 if rows[5][3] in ("contact", "goal", "reset") else 0
    assert out.agg(F.coalesce(F.sum("late"), F.lit(0))).first()[0] == expected_late
