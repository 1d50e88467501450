"""Ties of the leaderboard, and how often rows of a match move."""

from pyspark.sql import functions as F

from touchline import adapters
from touchline.operators import skill as S

SMALL = "/root/testdata/sf0.001"


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def observations(spark, rows):
    df = spark.createDataFrame(rows, "player_id string, name string, role string, minutes double")
    return df.select(
        "*", *[F.lit(0.5).alias(d) for d in S.DIMENSIONS], F.lit(1.0).alias("quality"), F.lit(1.0).alias("exposure"),
        *[F.lit(0.0).alias(c) for c in ("adjustment", "teammate_context", "opponent_context")],
    )


def test_equal_minutes_in_two_roles(spark):
    """0.1 + 0.2 is more than 0.3 as doubles; equal minutes go to the first role by name."""
    rows = [("a", "A", "forward", 0.1), ("a", "A", "forward", 0.2), ("a", "A", "defender", 0.3)]
    assert [r.role for r in S.roll_up(observations(spark, rows)).collect()] == ["defender"]


def test_rows_of_a_match_move_once(spark):
    evidence = S.match_evidence(adapters.player_match(spark, SMALL))
    plan = executed(evidence)
    assert plan.count("Exchange ") == 1 and "rangepartitioning" not in plan


def test_contexts_need_no_join_of_match_rows(spark):
    columns = "match_id long, team int, player_id string, minutes double, " + ", ".join(f"{d} double" for d in S.DIMENSIONS)
    some = [0.5] * len(S.DIMENSIONS)
    rows = [(1, 1, "a", 3.0, *some), (1, 1, "a", 2.0, *some), (1, 1, "b", 3.0, *some), (1, 2, "c", 3.0, *some), (1, 3, "d", 3.0, *some)]
    strengths = spark.createDataFrame([("a", 1.0), ("b", 0.5), ("c", -1.0)], "player_id string, strength double")
    found = S.match_contexts(spark.createDataFrame(rows, columns), strengths)
    assert executed(found).count("Join ") == 1
    got = {r.player_id: (r.teammate_context, r.opponent_context) for r in found.collect()}
    assert got == {"a": (0.25, -0.5), "b": (0.5, -0.5), "c": (0.0, 0.375)}


def test_everybody_is_measured_only_where_a_role_needs_it(spark, monkeypatch):
    """29 forwards have a value of pressure_recovery, so that dimension alone takes everybody's."""
    values = ["CAST(id % 37 AS DOUBLE) AS " + d for d in S.DIMENSIONS if d != "pressure_recovery"]
    rows = spark.range(200).selectExpr("IF(id % 2 = 0, 'forward', 'midfield') AS role", "2D AS minutes", "id", *values)
    rows = rows.withColumn("pressure_recovery", F.when((F.col("role") == "midfield") | (F.col("id") < 58), F.col("id").cast("double")))
    asked = []
    measured = S.exact_medians
    monkeypatch.setattr(S, "exact_medians", lambda df, *a, **k: asked.append(df) or measured(df, *a, **k))
    got = {(r.role, r.dimension): r.center for r in S.normalizers(rows).collect()}
    counted = [df.where("role = '*'").agg(*[F.count(d).alias(d) for d in S.DIMENSIONS]).first().asDict() for df in asked]
    assert [{d for d, n in c.items() if n} for c in counted] == [{"pressure_recovery"}] * 2
    everybody = sorted(r.pressure_recovery for r in rows.where("pressure_recovery IS NOT NULL").collect())
    assert got["forward", "pressure_recovery"] == everybody[len(everybody) // 2] and len(got) == 16


def test_middle_distances_need_no_facts_of_their_own(spark, monkeypatch):
    """Means and deviations are measured once; a role of equal values and one far from its mean keep exact results."""
    values = {"defender": [7.0] * 40, "forward": [0.0] * 39 + [1e9], "midfield": [float(i * i) for i in range(41)]}
    rows = [(role, 2.0, *[v] * len(S.DIMENSIONS)) for role, of in values.items() for v in of]
    df = spark.createDataFrame(rows, "role string, minutes double, " + ", ".join(f"{d} double" for d in S.DIMENSIONS))
    facts = []
    measured = S.exact_medians
    monkeypatch.setattr(S, "exact_medians", lambda *a, **k: facts.append(k.get("facts")) or measured(*a, **k))
    got = {(r.role, r.dimension): (r.center, r.scale) for r in S.normalizers(df).collect()}
    assert len(facts) == 2 and None not in facts
    assert got["defender", "retention"] == (7.0, 1.0)
    assert got["midfield", "finishing"] == (400.0, S.MAD_SCALE * sorted(abs(v - 400.0) for v in values["midfield"])[20])
    center, scale = got["forward", "creation"]
    assert center == 0.0 and abs(scale / 1e9 - (39 / 1600) ** 0.5) < 1e-9


def test_match_rows_move_once_for_contexts(spark):
    """Strengths have a known size, so match rows are not dealt by player first."""
    evidence = S.match_evidence(adapters.player_match(spark, SMALL)).localCheckpoint()
    plan = executed(S.match_contexts(evidence, S.player_strengths(evidence)))
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan


def test_roles_take_one_pass_over_narrow_rows(spark):
    """Rank and size of a side come from one window, over rows that hold metrics in place of counters."""
    plan = executed(S.match_evidence(adapters.player_match(spark, SMALL)))
    assert plan.count("Window [") == 1
    window = next(line for line in plan.splitlines() if "Window [" in line)
    below = plan[plan.index(window):].splitlines()[1]
    assert "Sort [" in below and "inferred_" not in plan[: plan.index(below)]
