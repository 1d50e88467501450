"""Golden cases of rules: quality, promotion, selection, estimates, lineage, functions, neighbours."""

import random

import pytest
from pyspark.sql import functions as F

from touchline.functions import scalars as fn
from touchline.operators import curation as C
from touchline.operators import gates as G
from touchline.operators import positions as X
from touchline.operators import quality as Q
from touchline.operators import skill as S

QUALITY = (
    "replay_valid boolean, duration_seconds double, expected_player_count int, observed_player_count int, disconnect_count int, "
    "activity_ratio double, parser_completeness double, stadium_supported boolean, has_reliable_player_identities boolean"
)


@pytest.mark.parametrize(
    "row,weight,tier",
    [
        ((True, None, 8, 8, None, None, None, None, None), 0.55, "silver"),
        ((True, None, 8, 9, None, None, None, None, None), 0.30, "bronze"),
        ((False, 300.0, 8, 8, 0, 0.9, 1.0, True, True), 0.0, "rejected"),
        ((True, -1.0, 8, 8, 0, 0.9, 1.0, True, True), 0.0, "rejected"),
        ((True, 300.0, 8, 8, 0, 0.9, 1.0, True, True), 0.85, "elite"),
        ((True, 300.0, 8, 8, 0, 0.9, 1.0, True, None), 0.85, "gold"),
    ],
)
def test_match_quality(spark, row, weight, tier):
    got = Q.assess_matches(spark.createDataFrame([row], QUALITY)).first()
    assert (got.weight, got.tier) == (weight, tier)


def test_selection_keeps_best_share_per_role(spark):
    rows = [("a", "A", "forward", 60.0, 4.0, 40, 200.0), ("b", "B", "forward", 58.0, 1.0, 40, 200.0), ("c", "C", "defender", 55.0, 0.5, 40, 200.0)]
    board = spark.createDataFrame(rows, "player_id string, name string, role string, rating double, rating_uncertainty double, matches int, minutes double")
    got = C.select_players(board, top_fraction=0.5, min_players=1, max_uncertainty=5.0)
    assert {r.player_id for r in got.collect()} == {"b", "c"}
    with pytest.raises(ValueError):
        C.select_players(board, top_fraction=1.5)


def test_context_moves_the_estimate_a_little(spark):
    def retention(mate, opponent):
        cols = ", ".join(f"{d} double" for d in S.DIMENSIONS)
        row = ("p", *([0.5] + [None] * 7), 1.0, 1.0, mate, opponent)
        df = spark.createDataFrame([row] * 10, f"player_id string, {cols}, quality double, exposure double, mate double, opp double")
        df = df.withColumn("adjustment", S.context_adjustment(F.col("mate"), F.col("opp")))
        return S.shrink(df).first().retention.mean

    assert 0 < retention(0.0, 1.0) - retention(0.0, -1.0) < 0.2
    assert retention(1.0, 0.0) < retention(-1.0, 0.0)


def test_names_and_times(spark):
    df = spark.createDataFrame([(" Straße \t ΣΑΣ ", "24-09-26-22h12-a-c0ffee12.hbr2", "2026-09-24T22:12:27.5+02:00")], "n string, f string, t string")
    row = df.select(
        fn.name_key(F.col("n")).alias("key"), fn.base_stem(fn.file_stem(F.col("f"))).alias("base"), fn.file_suffix(F.col("f")).alias("suffix"),
        fn.replay_time(F.col("f")).cast("string").alias("at"), fn.report_time(F.col("t")).cast("string").alias("told"),
        fn.replay_time(F.lit("99-99-26-22h12")).alias("never"),
        fn.direction_class(F.lit(-0.5), F.lit(1.0)).alias("dir"),
    ).first()
    assert (row.key, row.base, row.suffix) == ("strasse σασ", "24-09-26-22h12-a", ".hbr2")
    assert (row.at, row.told, row.never, row.dir) == ("2026-09-24 22:12:00", "2026-09-24 22:12:27.5", None, 7)


@pytest.mark.parametrize("fold_rows", [1, 3, 1000])
def test_champion_lineage(spark, fold_rows):
    rng = random.Random(7)
    rows = [(f"l{g % 2}", g, rng.random(), rng.random(), rng.random(), 10) for g in range(120)]
    runs = spark.createDataFrame(rows, "lineage string, generation long, direction_accuracy double, joint_accuracy double, kick_f1 double, samples long")
    want = set()
    for name in ("l0", "l1"):
        champion = None
        for _, g, d, j, k, _n in (r for r in rows if r[0] == name):
            score = 0.7 * j + 0.3 * k
            if champion is None or (score >= champion[0] + 0.001 and d >= champion[1] - 0.02 and k >= champion[2] - 0.05):
                champion = (score, d, k)
                want.add((name, g))
    got = {(r.lineage, r.generation) for r in G.champions(runs, fold_rows=fold_rows).collect()}
    assert got == want


@pytest.mark.parametrize("crowd", [2, 64])
def test_nearest_players_in_crowded_frames(spark, monkeypatch, crowd):
    monkeypatch.setattr(X, "CROWD", crowd)
    rng = random.Random(crowd)
    rows = [("r", 0, p, p % 3, float(rng.randint(0, 40)), float(rng.randint(0, 40)), 0.0, 0.0) for p in range(40)]
    states = spark.createDataFrame(rows, "replay string, frame int, player long, team int, x double, y double, vx double, vy double")
    for r in X.neighbours(states.filter("team > 0"), states).collect():
        for got, team, limit in ((r.mates, r.team, 2), (r.opponents, 3 - r.team, 3)):
            others = sorted(((q[4] - r.x) ** 2 + (q[5] - r.y) ** 2, q[2]) for q in rows if q[3] == team and q[2] != r.player)
            assert [(n.d2, n.player) for n in got] == others[:limit]
